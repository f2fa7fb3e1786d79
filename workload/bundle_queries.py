"""Queries over chunk maps and build manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptsift.operators import bundles as B
from scriptsift.operators import store
from scriptsift.plans.chunk_discovery import discover_chunks

from .corpus import BUNDLERS, CAPTURE
from .duck import join_url, lit, origin, resolve_url
from .registry import query


def bundlers(spark, sf):
    return BUNDLERS.frame(spark, sf)


def capture(spark, sf):
    return CAPTURE.frame(spark, sf)


OK = "error IS NULL AND status_code BETWEEN 200 AND 399"
_A = BUNDLERS.sql
FRAMEWORK = (
    "CASE WHEN contains(content, '_next/') OR contains(content, '__NEXT_DATA__') OR contains(content, 'self.__BUILD_MANIFEST') "
    "THEN 'nextjs' WHEN contains(lower(content), 'vite') THEN 'vite' ELSE 'webpack' END")
_INVENTORY = f"(SELECT DISTINCT url FROM {CAPTURE.sql} WHERE {OK})"
_BODIES = f"(SELECT url, min_by(content, captured_at) AS body FROM {CAPTURE.sql} WHERE {OK} GROUP BY url)"


@query("bundle_framework", f"SELECT asset_key, {FRAMEWORK} AS framework FROM {_A}")
def bundle_framework(spark, sf):
    return bundlers(spark, sf).select("asset_key", B.bundle_framework(F.col("content")).alias("framework"))


_ASSIGNED = r"""regexp_extract(content, '__webpack_require__\.p\s*=\s*["'']([^"'']+)["'']', 1)"""
_ROOTS = f"""(SELECT * EXCLUDE (root0), CASE WHEN root0 = '' THEN {origin('base_url')} || '/' WHEN root0 LIKE 'http%' THEN root0 ELSE joined END AS root
FROM {join_url(f"(SELECT *, {_ASSIGNED} AS root0 FROM {_A})", 'base_url', 'root0', 'joined', 'asset_key, base_url, content, root0')})"""


@query("public_path", f"SELECT asset_key, root FROM {_ROOTS}")
def public_path(spark, sf):
    return bundlers(spark, sf).select(
        "asset_key", B.public_path(F.col("content"), F.col("base_url")).alias("root"))


def _entries(map_rx, entry_rx, name_group, keep):
    """Ordered (asset, position, id, name): a repeated id keeps its place and
    takes the later name."""
    entry_id = entry_rx.replace("#", "")
    return f"""(SELECT asset_key, base_url, root, chunk_id, cast(row_number() OVER (PARTITION BY asset_key ORDER BY first_at) - 1 AS int) AS ord, name FROM
(SELECT asset_key, base_url, root, chunk_id, min(i) AS first_at, arg_max(name, i) AS name FROM
 (SELECT asset_key, base_url, root, i, trim(regexp_extract(x, {lit(entry_id)}, 1), '"') AS chunk_id, regexp_extract(x, {lit(entry_id)}, 2) AS name FROM
  (SELECT asset_key, base_url, root, unnest(xs) AS x, unnest(range(0, len(xs))) AS i FROM
   (SELECT asset_key, base_url, root, flatten(list_transform(regexp_extract_all(content, {lit(map_rx)}, 1), lambda b: regexp_extract_all(b, {lit(entry_id)}))) AS xs FROM {_ROOTS})))
 WHERE {keep} GROUP BY ALL))"""


# The expressions for chunk maps and hash maps.
_MAP = _entries(
    r"\(\s*\{([^}]+)\}\s*\[(?:e|t|n|r|o|chunkId)\]", r'(\d+|"[^"]+"):\s*"([^"]+)"', 2,
    "(name LIKE '%.js' OR NOT contains(name, '.'))")
_MAP_FILES = f"(SELECT asset_key, base_url, root, ord, chunk_id, CASE WHEN name LIKE '%.js' THEN name ELSE name || '.chunk.js' END AS file FROM {_MAP})"
_KEY = r'(?:\d+|"[^"]+")\s*:\s*"[a-f0-9]+"\s*'
_HASH = _entries(rf"\{{(\s*{_KEY}(?:,\s*{_KEY})*)\}}", r'(\d+):\s*"([a-f0-9]{8,})"', 2, "name <> ''")


@query("webpack_chunk_map", f"SELECT asset_key, ord, chunk_id, file FROM {_MAP_FILES}")
def webpack_chunk_map(spark, sf):
    return B.webpack_chunk_map(bundlers(spark, sf))


@query("webpack_hash_map", f"SELECT asset_key, ord, chunk_id, name AS chunk_hash FROM {_HASH}")
def webpack_hash_map(spark, sf):
    return B.webpack_hash_map(bundlers(spark, sf))


_MAP_REFS = join_url(_MAP_FILES, "root", "file", "url", "asset_key, base_url, ord, chunk_id")


@query("webpack_chunk_refs", f"SELECT asset_key, ord, chunk_id, url FROM {_MAP_REFS}")
def webpack_chunk_refs(spark, sf):
    return B.webpack_chunk_refs(bundlers(spark, sf))


_NAMES = ("list_value(chunk_id||'.'||name||'.chunk.js', chunk_id||'.chunk.js', 'chunk.'||chunk_id||'.js', name||'.chunk.js')")
_CANDIDATES = join_url(
    f"(SELECT asset_key, base_url, root, ord, chunk_id, name AS chunk_hash, unnest({_NAMES}) AS file, unnest(range(0, 4)) AS candidate FROM {_HASH})",
    "root", "file", "url", "asset_key, base_url, ord, chunk_id, chunk_hash, cast(candidate AS int) AS candidate")
_HASH_REFS = f"""(SELECT asset_key, base_url, ord, chunk_id, chunk_hash, min(candidate) AS candidate, arg_min(url, candidate) AS url
FROM {_CANDIDATES} WHERE url IN (SELECT url FROM {_INVENTORY}) GROUP BY ALL)"""


@query("hash_chunk_candidates", f"SELECT asset_key, ord, chunk_id, chunk_hash, candidate, url FROM {_CANDIDATES}")
def hash_chunk_candidates(spark, sf):
    return B.hash_chunk_candidates(bundlers(spark, sf))


@query("hash_chunk_refs", f"SELECT asset_key, ord, chunk_id, chunk_hash, candidate, url FROM {_HASH_REFS}")
def hash_chunk_refs(spark, sf):
    candidates = B.hash_chunk_candidates(bundlers(spark, sf))
    return B.hash_chunk_refs(candidates, store.captured_urls(capture(spark, sf)))


_NEXT_REFS = f"""(SELECT asset_key, base_url, {origin('base_url')} || x AS url, min(i) AS i FROM
(SELECT asset_key, base_url, unnest(xs) AS x, unnest(range(0, len(xs))) AS i FROM
 (SELECT asset_key, base_url, regexp_extract_all(content, '/_next/static/chunks/[^\\s"''<>]+\\.js') AS xs FROM {_A}))
GROUP BY ALL)"""


@query("next_chunk_refs", f"""
SELECT asset_key, url, cast(row_number() OVER (PARTITION BY asset_key ORDER BY i) - 1 AS int) AS ord FROM {_NEXT_REFS}""")
def next_chunk_refs(spark, sf):
    return B.next_chunk_refs(bundlers(spark, sf))


_BUILD_ID = r"""coalesce(nullif(regexp_extract(content, '"buildId"\s*:\s*"([^"]+)"', 1), ''),
  nullif(regexp_extract(content, '/_next/static/([^/]+)/_buildManifest\.js', 1), ''))"""
_MANIFESTS = f"(SELECT asset_key, base_url, content, {_BUILD_ID} AS build_id, {origin('base_url')} || '/_next/static/' || {_BUILD_ID} || '/_buildManifest.js' AS manifest_url FROM {_A})"


@query("next_build_id", f"SELECT asset_key, build_id, manifest_url FROM {_MANIFESTS}")
def next_build_id(spark, sf):
    text, base = F.col("content"), F.col("base_url")
    return bundlers(spark, sf).select(
        "asset_key", B.next_build_id(text).alias("build_id"), B.next_manifest_url(text, base).alias("manifest_url"))


_MANIFEST_REFS = f"""(SELECT asset_key, base_url, url, cast(row_number() OVER (PARTITION BY asset_key ORDER BY i) - 1 AS int) AS ord FROM
(SELECT asset_key, base_url, CASE WHEN x LIKE 'http%' THEN x ELSE {origin('base_url')} || '/_next/static/' || ltrim(x, '/') END AS url, min(i) AS i FROM
 (SELECT asset_key, base_url, unnest(xs) AS x, unnest(range(0, len(xs))) AS i FROM
  (SELECT asset_key, base_url, regexp_extract_all(body, '"([^"]+\\.js)"', 1) AS xs FROM {_MANIFESTS} m JOIN {_BODIES} b ON m.manifest_url = b.url))
 GROUP BY ALL))"""


@query("next_build_manifest_refs", f"SELECT asset_key, ord, url FROM {_MANIFEST_REFS}")
def next_build_manifest_refs(spark, sf):
    return B.next_build_manifest_refs(bundlers(spark, sf), store.captured_bodies(capture(spark, sf)))


_STANDARD = (
    f"(SELECT site, unnest(range(0, 6)) AS ord, site || unnest({list(B.NEXT_STANDARD_CHUNKS)}) AS url FROM "
    f"(SELECT DISTINCT {origin('base_url')} AS site FROM {_A} WHERE {FRAMEWORK} = 'nextjs'))")


@query("next_standard_chunks", f"""
SELECT site, cast(ord AS int) AS ord, url FROM {_STANDARD} WHERE url IN (SELECT url FROM {_INVENTORY})""")
def next_standard_chunks(spark, sf):
    nextjs = bundlers(spark, sf).filter(B.bundle_framework(F.col("content")) == "nextjs")
    return B.next_standard_candidates(nextjs).join(store.captured_urls(capture(spark, sf)), "url", "left_semi").select(
        "site", "ord", "url")


_VITE_SITES = f"(SELECT DISTINCT {origin('base_url')} AS site FROM {_A} WHERE {FRAMEWORK} = 'vite')"
_VITE_FIRST = f"""(SELECT site, arg_min(body, place) AS body FROM
(SELECT site, unnest(range(0, 3)) AS place, site || unnest({list(B.VITE_MANIFESTS)}) AS url FROM {_VITE_SITES}) p
JOIN {_BODIES} b ON p.url = b.url WHERE json_valid(body) GROUP BY site)"""
_VITE_FILES = f"""(SELECT site, url, min(spot) AS spot, arg_min(source, spot) AS source FROM (
  SELECT site, entry * 1000 AS spot, 'vite_manifest' AS source, site || '/' || ltrim(json_extract_string(body, '$.' || key || '.file'), '/') AS url
  FROM (SELECT site, body, unnest(json_keys(body)) AS key, unnest(range(0, len(json_keys(body)))) AS entry FROM {_VITE_FIRST})
  WHERE json_extract_string(body, '$.' || key || '.file') LIKE '%.js'
  UNION ALL
  SELECT site, entry * 1000 + 1 + pos, 'vite_manifest_import', site || '/' || ltrim(imp, '/') FROM
   (SELECT site, entry, unnest(imps) AS imp, unnest(range(0, len(imps))) AS pos FROM
    (SELECT site, entry, from_json(coalesce(json_extract(body, '$.' || key || '.imports'), '[]'), '["VARCHAR"]') AS imps
     FROM (SELECT site, body, unnest(json_keys(body)) AS key, unnest(range(0, len(json_keys(body)))) AS entry FROM {_VITE_FIRST})))
  WHERE imp LIKE '%.js') GROUP BY site, url)"""


@query("vite_manifest_refs", f"SELECT site, url, source FROM {_VITE_FILES}")
def vite_manifest_refs(spark, sf):
    vite = bundlers(spark, sf).filter(B.bundle_framework(F.col("content")) == "vite")
    return B.vite_manifest_refs(vite, store.captured_bodies(capture(spark, sf))).select("site", "url", "source")


_VITE_ASSETS = resolve_url(
    f"""(SELECT asset_key, base_url, unnest(xs) AS x, unnest(range(0, len(xs))) AS i FROM
    (SELECT asset_key, base_url, regexp_extract_all(content, '["'']([^"'']+/assets/[^"'']+\\.js)["'']', 1) AS xs FROM {_A}))""",
    "base_url", "x", "url", "asset_key, base_url, i")


@query("vite_asset_refs", f"""
SELECT asset_key, url, cast(row_number() OVER (PARTITION BY asset_key ORDER BY i) - 1 AS int) AS ord FROM
(SELECT asset_key, url, min(i) AS i FROM {_VITE_ASSETS} GROUP BY ALL)""")
def vite_asset_refs(spark, sf):
    return B.vite_asset_refs(bundlers(spark, sf))


_ALL_NUMBERED = f"""(SELECT root, n, arg_min(url, candidate) AS url FROM (
  SELECT root, url, regexp_extract(name, '^(?:chunk\\.)?([0-9]+)', 1) AS n,
    CASE WHEN name LIKE '%.chunk.js' THEN 0 WHEN name LIKE 'chunk.%' THEN 2 ELSE 1 END AS candidate
  FROM (SELECT root, url, substr(url, length(root) + 1) AS name FROM (SELECT DISTINCT root FROM {_ROOTS}) r JOIN {_INVENTORY} i ON starts_with(url, root))
  WHERE regexp_full_match(name, '(chunk\\.)?(0|[1-9][0-9]*)(\\.chunk)?\\.js') AND NOT name LIKE 'chunk.%.chunk.js') GROUP BY root, n)"""


@query("numbered_chunks", f"SELECT root, n AS chunk_id, url FROM {_ALL_NUMBERED}")
def numbered_chunks(spark, sf):
    roots = bundlers(spark, sf).select(
        B.public_path(F.col("content"), F.col("base_url")).alias("root")).distinct()
    return B.numbered_chunks(roots, store.captured_urls(capture(spark, sf)))


# Numbered chunks the way a probe finds them: candidates 0, 1, 2, … per root.
_PROBED = f"""(SELECT root, n, min(candidate) AS candidate, arg_min(url, candidate) AS url FROM
(SELECT root, n, unnest(range(0, 3)) AS candidate, root || unnest(list_value(n || '.chunk.js', n || '.js', 'chunk.' || n || '.js')) AS url
 FROM (SELECT DISTINCT root FROM {_ROOTS}) r, (SELECT unnest(range(0, 1000)) AS n))
WHERE url IN (SELECT url FROM {_INVENTORY}) GROUP BY root, n)"""
_NUMBERED = f"""(SELECT root, n, url FROM (SELECT root, n, url, max(gap) OVER (PARTITION BY root ORDER BY n) AS widest FROM
(SELECT *, n - coalesce(lag(n) OVER (PARTITION BY root ORDER BY n), -1) - 1 AS gap FROM {_PROBED})) WHERE widest < 10)"""


@query("numbered_chunks_compat", f"SELECT root, cast(n AS varchar) AS chunk_id, url FROM {_NUMBERED}")
def numbered_chunks_compat(spark, sf):
    roots = bundlers(spark, sf).select(
        B.public_path(F.col("content"), F.col("base_url")).alias("root")).distinct()
    return B.numbered_chunks(roots, store.captured_urls(capture(spark, sf)), compat=True)


_FOUND = f"""
WITH a AS MATERIALIZED (SELECT *, {FRAMEWORK} AS framework, {origin('base_url')} AS site FROM {_A}),
heads AS (SELECT base_url, site, framework, min(asset_key) AS asset_key FROM a GROUP BY ALL),
mapped AS MATERIALIZED (SELECT r.* FROM {_MAP_REFS} r JOIN a USING (asset_key) WHERE framework = 'webpack'),
hashed AS MATERIALIZED (SELECT r.* FROM {_HASH_REFS} r JOIN a USING (asset_key) WHERE framework = 'webpack'),
roots AS (SELECT base_url, root, min(asset_key) AS asset_key FROM {_ROOTS} JOIN (SELECT asset_key, framework FROM a) USING (asset_key)
  WHERE framework = 'webpack' AND asset_key NOT IN (SELECT asset_key FROM mapped) AND asset_key NOT IN (SELECT asset_key FROM hashed) GROUP BY ALL),
found AS (
  SELECT r.base_url, r.url, r.asset_key, 0 AS pr, i AS o, NULL AS chunk_id, NULL AS chunk_hash, 'nextjs' AS framework, 'next_static_chunks' AS source
    FROM {_NEXT_REFS} r JOIN a USING (asset_key) WHERE a.framework = 'nextjs'
  UNION ALL SELECT r.base_url, r.url, r.asset_key, 1, ord, NULL, NULL, 'nextjs', 'next_build_manifest' FROM {_MANIFEST_REFS} r JOIN a USING (asset_key) WHERE a.framework = 'nextjs'
  UNION ALL SELECT base_url, s.url, asset_key, 2, ord, NULL, NULL, 'nextjs', 'next_standard' FROM heads JOIN {_STANDARD} s USING (site)
    WHERE framework = 'nextjs' AND s.url IN (SELECT url FROM {_INVENTORY})
  UNION ALL SELECT base_url, v.url, asset_key, 0, spot, NULL, NULL, 'vite', source FROM heads JOIN {_VITE_FILES} v USING (site) WHERE framework = 'vite'
  UNION ALL SELECT r.base_url, r.url, r.asset_key, 1, i, NULL, NULL, 'vite', 'vite_asset_ref' FROM {_VITE_ASSETS} r JOIN a USING (asset_key) WHERE a.framework = 'vite'
  UNION ALL SELECT base_url, url, asset_key, 0, ord, chunk_id, NULL, 'webpack', 'webpack5_map' FROM mapped
  UNION ALL SELECT base_url, url, asset_key, 1, ord, chunk_id, chunk_hash, 'webpack', 'webpack5_hash' FROM hashed
  UNION ALL SELECT base_url, n.url, asset_key, 2, cast(n.n AS int), n.n, NULL, 'webpack', 'numbered' FROM roots JOIN {_ALL_NUMBERED} n USING (root))
SELECT base_url, url, (b).asset_key AS asset_key, (b).chunk_id AS chunk_id, (b).chunk_hash AS chunk_hash, (b).framework AS framework, (b).source AS source
FROM (SELECT base_url, url, arg_min(struct_pack(asset_key, chunk_id, chunk_hash, framework, source), (asset_key, pr, o)) AS b FROM found GROUP BY base_url, url)"""


@query("discover_chunks", _FOUND)
def discover(spark, sf):
    return discover_chunks(bundlers(spark, sf), capture(spark, sf)).drop("priority", "ord")
