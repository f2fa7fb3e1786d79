"""Source maps: finding them, reading them, and the original files in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind, with_known
from ..functions.text import strip
from ..functions.urls import join_url
from ..session import shared_folder, staged
from .catalog import jvm_regex
from .store import first_captured, with_body

# The comment that names a map, and the banner of combined files.
_COMMENT = jvm_regex(r"//[#@]\s*sourceMappingURL\s*=\s*(.+?)(?:\s*$|\*/)", "idmU")
_BANNER = "=" * 60
_DATA = "data:application/json"

MAP_SCHEMA = "sourceRoot string, sources array<string>, sourcesContent array<string>"


def sourcemap_url(script: Column, url: Column) -> Column:
    """The first announced map: a data URI, or an absolute URL; null without one."""
    raw = F.regexp_extract(script, _COMMENT, 1)
    return bind(raw, lambda r: F.when(r != "", bind(strip(r), lambda t: F.when(
        t.startswith(_DATA) | t.startswith("http://") | t.startswith("https://"), t).otherwise(join_url(url, t)))))


def assets_with_sourcemap(assets: DataFrame, url="url", content="content") -> DataFrame:
    return with_known(assets, "sourcemap_url", sourcemap_url(F.col(content), F.col(url)))


def sourcemap_candidates(assets: DataFrame, keys=("asset_key",), url="url") -> DataFrame:
    """Where a map usually lies: ``x.js.map``, then ``x.map``."""
    u = F.col(url)
    places = F.array_compact(F.array(
        F.concat(u, F.lit(".map")),
        F.when(u.endswith(".js"), F.concat(F.regexp_replace(u, r"\.js\z", ""), F.lit(".map")))))
    return assets.select(*keys, F.posexplode(places).alias("ord", "map_url"))


def locate_sourcemaps(
    assets: DataFrame, inventory: DataFrame, keys=("asset_key",), url="url", content="content", probe: bool = True
) -> DataFrame:
    """(keys, map_url): the announced map, else the first captured candidate.

    With ``probe`` the announcements are stored first, without the texts, so no
    text is searched twice.
    """
    keys = list(keys)
    named = sourcemap_url(F.col(content), F.col(url))
    if not probe:
        return with_known(assets, "map_url", named).select(*keys, "map_url")
    places = [c for c in dict.fromkeys([*keys, url])]
    rows = staged(assets.select(*places, named.alias("__named")), shared_folder(assets.sparkSession, "announced-maps"))
    announced = rows.filter("__named is not null").select(*keys, F.col("__named").alias("map_url"))
    silent = rows.filter("__named is null")
    guessed = first_captured(sourcemap_candidates(silent, keys, url), inventory, keys, url="map_url")
    return announced.unionByName(guessed.select(*keys, "map_url"))


def data_uri_body(map_url: Column) -> Column:
    """The JSON text of a data URI; null when it cannot be decoded."""
    packed = F.regexp_replace(F.split(map_url, ";base64,", 2).getItem(1), "[^A-Za-z0-9+/=]", "")
    unpacked = F.try_validate_utf8(F.try_to_binary(packed, F.lit("base64")).cast("string"))
    plain = F.get(F.split(map_url, ",", 2), 1)
    return F.when(map_url.contains(";base64,"), unpacked).otherwise(plain)


def load_sourcemaps(located: DataFrame, bodies: DataFrame, keys=("asset_key",)) -> DataFrame:
    """Parsed maps; unreadable ones drop out."""
    keys = list(keys)
    is_data = F.col("map_url").startswith(_DATA)
    inline = with_known(located.filter(is_data), "body", data_uri_body(F.col("map_url")))
    remote = with_body(located.filter(~is_data), bodies, "map_url")
    both = inline.select(*keys, "map_url", "body").unionByName(remote.select(*keys, "map_url", "body"))
    parsed = F.from_json("body", MAP_SCHEMA)
    readable = bind(parsed, lambda m: F.when(m["sources"].isNotNull(), m))
    return with_known(both, "map", readable).drop("body")


def clean_source_name(path: Column) -> Column:
    """Display path: bundler scheme, leading and inner dots removed."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\Awebpack:/+", ""), r"\A\.?/+", "")

    def step(stack, seg):
        return (
            F.when(seg == "..", F.regexp_replace(stack, "/[^/]*$", ""))
            .when(seg.isin("", "."), stack)
            .otherwise(F.concat(stack, F.lit("/"), seg)))

    def fold(b):
        folded = F.aggregate(F.split(b, "/", -1), F.lit(""), step)
        return bind(folded, lambda f: F.when(f != "", F.substring(f, 2, 1 << 30)).otherwise(b))

    return bind(bare, fold)


def _rooted(root: Column, path: Column) -> Column:
    """A source path below the map's source root."""
    absolute = path.startswith("http://") | path.startswith("https://")
    folder = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(
        (F.coalesce(root, F.lit("")) == "") | absolute, path
    ).otherwise(join_url(folder, F.ltrim(path, F.lit("/"))))


def explode_sources(
    maps: DataFrame, bodies: DataFrame | None = None, keys=("asset_key",), folder: str | None = None
) -> DataFrame:
    """One row per original file: position, display name, URL if any, content.

    Content comes from the map; files it leaves out are looked up among the
    captured bodies.  For that the rows are stored first: only files without
    content then take part in the join, and no map is parsed twice.
    """
    keys = list(keys)
    rows = maps.select(*keys, "map_url", "map", F.posexplode("map.sources").alias("pos", "__path"))
    rows = rows.select(
        *keys, "map_url", "pos", _rooted(F.col("map.sourceRoot"), F.col("__path")).alias("path"),
        F.coalesce(F.get(F.col("map.sourcesContent"), F.col("pos")), F.lit("")).alias("content"))
    rows = rows.select(
        *keys, F.when(F.col("map_url").startswith(_DATA), _DATA).otherwise(F.col("map_url")).alias("map_url"), "pos",
        clean_source_name(F.col("path")).alias("name"),
        F.when(F.col("path").startswith("http"), F.col("path")).alias("source_url"), "content")
    if bodies is None:
        return rows
    folder = folder or shared_folder(maps.sparkSession, "sources")
    rows = staged(rows, f"{folder}/source_rows")
    missing = (F.col("content") == "") & F.coalesce(F.col("source_url").rlike(r"\Ahttps?://"), F.lit(False))
    fetched = with_body(rows.filter(missing), bodies, "source_url", "left").withColumn(
        "content", F.coalesce("body", F.lit("")))
    return rows.filter(~missing).unionByName(fetched.select(*rows.columns))


def combined_sources(source_files: DataFrame, keys=("asset_key",)) -> DataFrame:
    """All files of an asset as one text with banners, in map order.

    A group is one source map, which was a single JSON document to begin with.
    """
    header = F.concat(
        F.lit(f"\n{_BANNER}\n// Source: "), F.col("name"), F.lit(f"\n{_BANNER}\n"), F.col("content"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", header.alias("text"))))
    return source_files.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda s: s["text"]), "\n").alias("source_mapped_content"))
