"""Lazy-loaded chunks named inside bundles (webpack, Vite, Next.js).

Extraction is row local.  Where a live tool would probe a host, candidates are
joined with the table of captured responses instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.arrays import bind, with_known
from ..functions.text import first_non_empty
from ..functions.urls import join_url, origin, resolve_url
from .catalog import jvm_regex
from .store import first_captured, first_per, with_body

# Shapes of the manifests and chunk maps bundlers emit.
_CHUNK_MAP = jvm_regex(r"\(\s*\{([^}]+)\}\s*\[(?:e|t|n|r|o|chunkId)\]", "dU")
_CHUNK_ENTRY = jvm_regex(r'(?:\d+|"[^"]+"):\s*"[^"]+"', "dU")
_HASH_KEY = r'(?:\d+|"[^"]+")\s*:\s*"[a-f0-9]+"\s*'
_HASH_MAP = jvm_regex(rf"\{{(\s*{_HASH_KEY}(?:,\s*{_HASH_KEY})*+)\}}", "dU")
_HASH_ENTRY = jvm_regex(r'\d+:\s*"[a-f0-9]{8,}"', "dU")
_PUBLIC_PATH = jvm_regex(r"""__webpack_require__\.p\s*=\s*["\']([^"\']+)["\']""", "dU")
_VITE_BASE = jvm_regex(r"""__vite__base\s*=\s*["\']([^"\']+)["\']""", "dU")
_NEXT_CHUNK = jvm_regex(r"""/_next/static/chunks/[^\s"\'<>]+\.js""", "dU")
_BUILD_ID = jvm_regex(r'"buildId"\s*:\s*"([^"]+)"', "dU")
_BUILD_ID_IN_PATH = r"/_next/static/([^/]+)/_buildManifest\.js"
_VITE_ASSET = r"""["']([^"']+/assets/[^"']+\.js)["']"""
NEXT_STANDARD_CHUNKS = (
    "/_next/static/chunks/main.js",
    "/_next/static/chunks/pages/_app.js",
    "/_next/static/chunks/pages/_error.js",
    "/_next/static/chunks/webpack.js",
    "/_next/static/chunks/framework.js",
    "/_next/static/chunks/polyfills.js",
)
VITE_MANIFESTS = ("/.vite/manifest.json", "/manifest.json", "/assets/manifest.json")
# Entries are parsed one by one: an entry that is no object is skipped.
VITE_MANIFEST_SCHEMA = "map<string,string>"
VITE_ENTRY_SCHEMA = "file string, imports array<string>"
MAX_PROBED, MAX_MISSES = 1000, 10


def _says_next(text: Column) -> Column:
    return text.contains("_next/") | text.contains("__NEXT_DATA__") | text.contains("self.__BUILD_MANIFEST")


def _says_vite(text: Column) -> Column:
    return F.lower(text).contains("vite")


def framework_of(says_next: Column, says_vite: Column) -> Column:
    """One label per bundle; webpack when nothing tells otherwise."""
    return F.when(says_next, "nextjs").when(says_vite, "vite").otherwise("webpack")


def bundle_framework(script: Column, urls: Column | None = None) -> Column:
    """Framework of a bundle by its text and, if given, the script URLs of its page."""
    text = script if urls is None else F.concat(script, F.array_join(urls, " "))
    return bind(text, lambda t: framework_of(_says_next(t), _says_vite(t)))


def page_framework_hints(refs: DataFrame, page="url", ref="ref_url") -> DataFrame:
    """What the script URLs of each page say about its framework, as two flags."""
    return refs.groupBy(page).agg(
        F.bool_or(_says_next(F.col(ref))).alias("urls_next"), F.bool_or(_says_vite(F.col(ref))).alias("urls_vite"))


def assigned_path(script: Column) -> Column:
    """The public path a bundle assigns, per bundler; '' where it does not."""
    return F.struct(
        F.regexp_extract(script, _PUBLIC_PATH, 1).alias("webpack"), F.regexp_extract(script, _VITE_BASE, 1).alias("vite"))


def _placed_path(assigned: Column, base: Column) -> Column:
    return bind(assigned, lambda f: (
        F.when((f["webpack"] == "") & (f["vite"] == ""), F.concat(origin(base), F.lit("/")))
        .when(f["webpack"].startswith("http"), f["webpack"])
        .otherwise(join_url(base, F.when(f["webpack"] != "", f["webpack"]).otherwise(f["vite"])))))


def public_path(script: Column, base: Column) -> Column:
    """Where chunks are loaded from: as assigned in the bundle, else site root."""
    return _placed_path(assigned_path(script), base)


def _map_entries(bodies: Column, entry: str) -> Column:
    """(id, name) structs of all ``id: "name"`` entries, in text order."""
    texts = F.flatten(F.transform(bodies, lambda b: F.regexp_extract_all(b, F.lit(entry), F.lit(0))))
    return F.transform(texts, lambda t: F.struct(
        F.regexp_extract(t, r'(?s)\A"?(.+?)"?:\s*"[^"]+"\z', 1).alias("chunk_id"),
        F.regexp_extract(t, r'(?s)"([^"]+)"\z', 1).alias("name")))


def _last_value_first_position(entries: Column) -> Column:
    """Map semantics: a repeated id keeps its place and takes the later name."""
    rows = F.transform(entries, lambda x, i: F.struct(x["chunk_id"].alias("id"), i.alias("i"), x["name"].alias("name")))

    def build(s):
        firsts = F.filter(s, lambda e, j: (j == 0) | (F.get(s, j - 1)["id"] != e["id"]))
        lasts = F.filter(s, lambda e, j: (j == F.size(s) - 1) | (F.get(s, j + 1)["id"] != e["id"]))
        placed = F.zip_with(firsts, lasts, lambda f, l: F.struct(f["i"], f["id"].alias("id"), l["name"].alias("name")))
        return F.transform(
            F.sort_array(placed), lambda e: F.struct(e["id"].alias("chunk_id"), e["name"].alias("name")))

    return bind(F.sort_array(rows), build)


def chunk_map(script: Column) -> Column:
    """Webpack id → file entries; names without a dot get ``.chunk.js``."""
    entries = _map_entries(F.regexp_extract_all(script, F.lit(_CHUNK_MAP), F.lit(1)), _CHUNK_ENTRY)
    files = F.filter(entries, lambda e: e["name"].endswith(".js") | ~e["name"].contains("."))
    named = F.transform(files, lambda e: F.struct(
        e["chunk_id"].alias("chunk_id"),
        F.when(e["name"].endswith(".js"), e["name"]).otherwise(F.concat(e["name"], F.lit(".chunk.js"))).alias("name")))
    return _last_value_first_position(named)


def hash_map(script: Column) -> Column:
    """Webpack id → content hash entries of maps that hold nothing else."""
    return _last_value_first_position(
        _map_entries(F.regexp_extract_all(script, F.lit(_HASH_MAP), F.lit(1)), _HASH_ENTRY))


def bundle_facts(assets: DataFrame, keys=("asset_key",), content="content") -> DataFrame:
    """Everything chunk discovery needs from a bundle's text, without the text.

    Nothing in it depends on the page that loads the bundle, so a bundle of many
    pages is read once; ``placed_facts`` adds what does.
    """
    text = F.col(content)
    return assets.select(
        *keys, _says_next(text).alias("says_next"), _says_vite(text).alias("says_vite"),
        assigned_path(text).alias("assigned"), chunk_map(text).alias("chunk_entries"), hash_map(text).alias("hash_entries"),
        next_chunk_paths(text).alias("next_paths"), next_build_id(text).alias("build_id"), _vite_refs(text).alias("vite_refs"))


def placed_facts(facts: DataFrame, base="base_url") -> DataFrame:
    """Facts of a bundle on a page: framework, public path and URLs.

    Rows carry the page in ``base`` and may carry the flags of
    ``page_framework_hints``.  The operators below accept either bundles or
    these rows.
    """
    def flag(own, hint):
        return F.col(own) | F.coalesce(F.col(hint), F.lit(False)) if hint in facts.columns else F.col(own)

    page = F.col(base)
    placed = facts.select(
        "*", framework_of(flag("says_next", "urls_next"), flag("says_vite", "urls_vite")).alias("framework"),
        _placed_path(F.col("assigned"), page).alias("root"),
        _manifest_url(F.col("build_id"), page).alias("manifest_url"),
        _resolved_distinct(F.col("vite_refs"), page).alias("vite_urls"))
    return placed.drop("says_next", "says_vite", "urls_next", "urls_vite", "assigned", "build_id", "vite_refs")


def _fact(rows: DataFrame, name: str, compute) -> Column:
    return F.col(name) if name in rows.columns else compute().alias(name)


def webpack_chunk_map(assets: DataFrame, keys=("asset_key",), content="content") -> DataFrame:
    entries = _fact(assets, "chunk_entries", lambda: chunk_map(F.col(content)))
    return assets.select(*keys, F.posexplode(entries).alias("ord", "e")).select(
        *keys, "ord", "e.chunk_id", F.col("e.name").alias("file"))


def webpack_hash_map(assets: DataFrame, keys=("asset_key",), content="content") -> DataFrame:
    entries = _fact(assets, "hash_entries", lambda: hash_map(F.col(content)))
    return assets.select(*keys, F.posexplode(entries).alias("ord", "e")).select(
        *keys, "ord", "e.chunk_id", F.col("e.name").alias("chunk_hash"))


def _rooted(assets, keys, content, base, name, compute) -> DataFrame:
    return assets.select(
        *dict.fromkeys([*keys, base]),
        _fact(assets, "root", lambda: public_path(F.col(content), F.col(base))),
        F.posexplode(_fact(assets, name, compute)).alias("ord", "e"))


def webpack_chunk_refs(assets: DataFrame, keys=("asset_key",), content="content", base="base_url") -> DataFrame:
    """URLs of the chunk map, resolved against the public path, else the page."""
    rows = _rooted(assets, keys, content, base, "chunk_entries", lambda: chunk_map(F.col(content)))
    start = F.when(F.col("root").startswith("http"), F.col("root")).otherwise(F.col(base))
    return rows.select(*keys, "ord", "e.chunk_id", join_url(start, F.col("e.name")).alias("url"))


def hash_chunk_candidates(assets: DataFrame, keys=("asset_key",), content="content", base="base_url") -> DataFrame:
    """Four ordered candidate URLs per hash map entry."""
    rows = _rooted(assets, keys, content, base, "hash_entries", lambda: hash_map(F.col(content)))
    cid, digest = F.col("e.chunk_id"), F.col("e.name")
    names = F.array(
        F.concat(cid, F.lit("."), digest, F.lit(".chunk.js")),
        F.concat(cid, F.lit(".chunk.js")),
        F.concat(F.lit("chunk."), cid, F.lit(".js")),
        F.concat(digest, F.lit(".chunk.js")))
    return rows.select(
        *keys, "ord", cid.alias("chunk_id"), digest.alias("chunk_hash"), "root",
        F.posexplode(names).alias("candidate", "__name"),
    ).withColumn("url", join_url(F.col("root"), F.col("__name"))).drop("root", "__name")


def hash_chunk_refs(candidates: DataFrame, inventory: DataFrame, keys=("asset_key",)) -> DataFrame:
    """The first captured candidate of every hash map entry."""
    return first_captured(candidates, inventory, [*keys, "chunk_id"], order="candidate")


def next_chunk_paths(script: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(script, F.lit(_NEXT_CHUNK), F.lit(0)))


def next_chunk_refs(assets: DataFrame, keys=("asset_key",), content="content", base="base_url") -> DataFrame:
    """Chunk paths in the text, on the page's origin."""
    paths = _fact(assets, "next_paths", lambda: next_chunk_paths(F.col(content)))
    rows = assets.select(*dict.fromkeys([*keys, base]), F.posexplode(paths).alias("ord", "p"))
    return rows.select(*keys, "ord", F.concat(origin(F.col(base)), F.col("p")).alias("url"))


def next_build_id(script: Column) -> Column:
    return first_non_empty(F.regexp_extract(script, _BUILD_ID, 1), F.regexp_extract(script, _BUILD_ID_IN_PATH, 1))


def next_manifest_url(script: Column, base: Column) -> Column:
    return _manifest_url(next_build_id(script), base)


def _manifest_url(build_id: Column, base: Column) -> Column:
    return F.concat(origin(base), F.lit("/_next/static/"), build_id, F.lit("/_buildManifest.js"))


def build_manifest_refs(body: Column, site: Column) -> Column:
    """Every quoted script of a captured build manifest as an absolute URL."""
    refs = F.regexp_extract_all(body, F.lit(r'"([^"]+\.js)"'), F.lit(1))
    return F.array_distinct(F.transform(refs, lambda r: F.when(r.startswith("http"), r).otherwise(
        F.concat(site, F.lit("/_next/static/"), F.ltrim(r, F.lit("/"))))))


def next_build_manifest_refs(
    assets: DataFrame, bodies: DataFrame, keys=("asset_key",), content="content", base="base_url"
) -> DataFrame:
    wanted = assets.select(
        *keys, origin(F.col(base)).alias("__site"),
        _fact(assets, "manifest_url", lambda: next_manifest_url(F.col(content), F.col(base))),
    ).filter("manifest_url is not null")
    found = with_body(wanted, bodies, "manifest_url")
    return found.select(*keys, F.posexplode(build_manifest_refs(F.col("body"), F.col("__site"))).alias("ord", "url"))


def next_standard_candidates(assets: DataFrame, base="base_url") -> DataFrame:
    """Six well-known chunk URLs per site; sites are made distinct first."""
    sites = assets.select(origin(F.col(base)).alias("site")).distinct()
    paths = F.posexplode(F.array(*[F.lit(p) for p in NEXT_STANDARD_CHUNKS])).alias("ord", "p")
    return sites.select("site", paths).select("site", "ord", F.concat("site", "p").alias("url"))


def vite_manifest_places(assets: DataFrame, base="base_url") -> DataFrame:
    """Where the manifest of each site may lie."""
    sites = assets.select(origin(F.col(base)).alias("site")).distinct()
    return sites.select("site", F.posexplode(F.array(*[F.lit(p) for p in VITE_MANIFESTS])).alias("place", "p")).select(
        "site", "place", F.concat("site", "p").alias("url"))


def vite_manifest_refs(assets: DataFrame, bodies: DataFrame, base="base_url") -> DataFrame:
    """Script files and imports of each site's first readable manifest."""
    places = vite_manifest_places(assets, base)
    entries_of = F.map_values(F.from_json("body", VITE_MANIFEST_SCHEMA))
    parsed = with_known(with_body(places, bodies, "url"), "entries", entries_of)
    first = first_per(parsed.select("site", "place", "entries"), ["site"], ["place"])
    entries = first.select("site", F.posexplode("entries").alias("entry", "__e")).select(
        "site", "entry", F.from_json("__e", VITE_ENTRY_SCHEMA).alias("e"))

    def chunk(name, how):
        return F.struct(
            F.concat(F.col("site"), F.lit("/"), F.ltrim(name, F.lit("/"))).alias("url"), F.lit(how).alias("source"))

    none = F.expr("cast(array() as array<string>)")
    files = F.concat(
        F.transform(F.filter(F.array("e.file"), lambda f: f.endswith(".js")), lambda f: chunk(f, "vite_manifest")),
        F.transform(
            F.filter(F.coalesce("e.imports", none), lambda f: f.endswith(".js")),
            lambda f: chunk(f, "vite_manifest_import")))
    rows = entries.select("site", "entry", F.posexplode(files).alias("pos", "c"))
    return first_per(rows.select("site", "entry", "pos", "c.url", "c.source"), ["site", "url"], ["entry", "pos"])


def vite_asset_urls(script: Column, base: Column) -> Column:
    return _resolved_distinct(_vite_refs(script), base)


def _vite_refs(script: Column) -> Column:
    return F.regexp_extract_all(script, F.lit(_VITE_ASSET), F.lit(1))


def _resolved_distinct(refs: Column, base: Column) -> Column:
    return F.array_distinct(F.transform(refs, lambda r: resolve_url(base, r)))


def vite_asset_refs(assets: DataFrame, keys=("asset_key",), content="content", base="base_url") -> DataFrame:
    urls = _fact(assets, "vite_urls", lambda: vite_asset_urls(F.col(content), F.col(base)))
    return assets.select(*keys, F.posexplode(urls).alias("ord", "url"))


_NUMBERED = r"\A(.*/)(?:chunk\.)?(0|[1-9][0-9]*)(?:\.chunk)?\.js\z"


def numbered_chunks(roots: DataFrame, inventory: DataFrame, compat: bool = False) -> DataFrame:
    """Captured chunks named by a number, below each root.

    ``roots`` holds distinct public paths in ``root``.  Captured URLs are read
    backwards into (folder, number), so the work follows the inventory, and every
    captured number counts.  ``compat`` returns what a probe of 0, 1, 2, … would
    find: numbers below ``MAX_PROBED``, ending at ``MAX_MISSES`` misses in a row.
    """
    name = F.regexp_extract(F.col("url"), r"[^/]*\z", 0)
    captured = inventory.filter(F.col("url").rlike(_NUMBERED) & ~name.rlike(r"\Achunk\..*\.chunk\.js\z")).select(
        F.regexp_extract(F.col("url"), _NUMBERED, 1).alias("folder"),
        F.regexp_extract(F.col("url"), _NUMBERED, 2).alias("n"),
        F.when(name.endswith(".chunk.js"), 0).when(name.startswith("chunk."), 2).otherwise(1).alias("candidate"),
        "url")
    hits = first_per(captured, ["folder", "n"], ["candidate"])
    if compat:
        hits = _probed(hits)
    folders = roots.select("root", F.regexp_replace(join_url(F.col("root"), F.lit("0.js")), r"0\.js\z", "").alias("folder"))
    return folders.join(hits, "folder").select("root", F.col("n").alias("chunk_id"), "url")


def _probed(hits: DataFrame) -> DataFrame:
    """The numbers a probe reaches; a folder has at most ``MAX_PROBED`` rows."""
    n = F.col("n").try_cast("int")
    per_folder = Window.partitionBy("folder").orderBy(n)
    gap = n - F.coalesce(F.lag(n).over(per_folder), F.lit(-1)) - 1
    reached = hits.filter(n < MAX_PROBED).withColumn("gap", gap).withColumn(
        "widest", F.max("gap").over(per_folder.rowsBetween(Window.unboundedPreceding, 0)))
    return reached.filter(F.col("widest") < MAX_MISSES).select("folder", "n", "url")
