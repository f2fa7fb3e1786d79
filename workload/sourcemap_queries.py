"""Queries over source maps and the files recovered from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptsift.operators import rollups, scan, sourcemaps, store
from scriptsift.sources import sinks

from .corpus import LINKS, MAP_CAPTURE, MAPPED
from .duck import findings_by_line, join_url
from .registry import query


def mapped(spark, sf):
    return MAPPED.frame(spark, sf)


def capture(spark, sf):
    return MAP_CAPTURE.frame(spark, sf)


OK = "error IS NULL AND status_code BETWEEN 200 AND 399"
_A = MAPPED.sql
_BODIES = f"(SELECT url, min_by(content, captured_at) AS body FROM {MAP_CAPTURE.sql} WHERE {OK} GROUP BY url)"
_RAW = r"trim(regexp_extract(content, '(?im)//[#@]\s*sourceMappingURL\s*=\s*(.+?)(?:\s*$|\*/)', 1))"
_NAMED = f"""(SELECT asset_key, url, CASE WHEN raw = '' THEN NULL WHEN raw LIKE 'data:application/json%' OR raw LIKE 'http://%' OR raw LIKE 'https://%' THEN raw ELSE joined END AS map_url
FROM {join_url(f"(SELECT asset_key, url, {_RAW} AS raw FROM {_A})", 'url', 'raw', 'joined', 'asset_key, url, raw')})"""


@query("sourcemap_url", f"SELECT asset_key, map_url FROM {_NAMED}")
def sourcemap_url(spark, sf):
    return mapped(spark, sf).select(
        "asset_key", sourcemaps.sourcemap_url(F.col("content"), F.col("url")).alias("map_url"))


@query("assets_with_sourcemap", f"SELECT asset_key, url FROM {_NAMED} WHERE map_url IS NOT NULL")
def assets_with_sourcemap(spark, sf):
    return sourcemaps.assets_with_sourcemap(mapped(spark, sf)).select("asset_key", "url")


_PLACES = f"""(SELECT asset_key, unnest(range(0, 2)) AS ord, unnest(list_value(url || '.map', regexp_replace(url, '\\.js$', '.map'))) AS map_url FROM {_A})"""


@query("sourcemap_candidates", f"SELECT asset_key, cast(ord AS int) AS ord, map_url FROM {_PLACES}")
def sourcemap_candidates(spark, sf):
    return sourcemaps.sourcemap_candidates(mapped(spark, sf))


_LOCATED = f"""(SELECT asset_key, map_url FROM {_NAMED} WHERE map_url IS NOT NULL UNION ALL
SELECT asset_key, arg_min(map_url, ord) FROM {_PLACES} WHERE asset_key IN (SELECT asset_key FROM {_NAMED} WHERE map_url IS NULL)
  AND map_url IN (SELECT url FROM {_BODIES}) GROUP BY asset_key)"""


def located(spark, sf):
    return sourcemaps.locate_sourcemaps(mapped(spark, sf), store.captured_urls(capture(spark, sf)))


@query("locate_sourcemaps", f"SELECT * FROM {_LOCATED}")
def locate_sourcemaps(spark, sf):
    return located(spark, sf)


_LOADED = f"""(SELECT asset_key, map_url, doc FROM (
 SELECT asset_key, map_url, CASE WHEN contains(map_url, ';base64,') THEN decode(from_base64(split_part(map_url, ';base64,', 2)))
   ELSE substr(map_url, strpos(map_url, ',') + 1) END AS doc FROM {_LOCATED} WHERE map_url LIKE 'data:%'
 UNION ALL SELECT asset_key, map_url, body FROM {_LOCATED} l JOIN {_BODIES} b ON l.map_url = b.url) WHERE json_valid(doc))"""


@query("load_sourcemaps", f"""
SELECT asset_key, json_extract_string(doc, '$.sourceRoot') AS source_root, cast(json_array_length(doc, '$.sources') AS int) AS n_sources,
  json_extract_string(doc, '$.sources[0]') AS first_source FROM {_LOADED}""")
def load_sourcemaps(spark, sf):
    maps = sourcemaps.load_sourcemaps(located(spark, sf), store.captured_bodies(capture(spark, sf)))
    return maps.select(
        "asset_key", F.col("map.sourceRoot").alias("source_root"), F.size("map.sources").alias("n_sources"),
        F.col("map.sources").getItem(0).alias("first_source"))


def clean_name(path):
    """Display path in SQL: a fold over the segments with a string as the stack."""
    bare = f"regexp_replace(regexp_replace({path}, '^webpack:/+', ''), '^\\.?/+', '')"
    fold = (f"list_reduce(list_prepend('', string_split({bare}, '/')), lambda a, s: CASE WHEN s = '..' "
            f"THEN regexp_replace(a, '/[^/]*$', '') WHEN s IN ('', '.') THEN a ELSE a || '/' || s END)")
    return f"coalesce(nullif(substr({fold}, 2), ''), {bare})"


_PATHS = f"""(SELECT asset_key, pos, root, raw, content FROM (
 SELECT asset_key, unnest(range(0, 4)) AS pos, json_extract_string(doc, '$.sourceRoot') AS root,
   unnest(from_json(json_extract(doc, '$.sources'), '["VARCHAR"]')) AS raw,
   unnest(list_concat(list_transform(from_json(json_extract(doc, '$.sourcesContent'), '["VARCHAR"]'), lambda c: coalesce(c, '')), [''])) AS content FROM {_LOADED}))"""
_SOURCES = f"""(SELECT asset_key, cast(pos AS int) AS pos, {clean_name('path')} AS name, CASE WHEN path LIKE 'http%' THEN path END AS source_url,
  CASE WHEN content = '' AND (path LIKE 'http://%' OR path LIKE 'https://%') THEN coalesce(body, '') ELSE content END AS content FROM
 (SELECT asset_key, pos, content, CASE WHEN root = '' OR raw LIKE 'http%' THEN raw WHEN root = 'webpack://' THEN ltrim(raw, '/')
    WHEN raw LIKE 'webpack:%' THEN raw WHEN root LIKE '/%' THEN joined ELSE joined END AS path FROM
   {join_url(_PATHS, "CASE WHEN root LIKE 'http%' THEN rtrim(root, '/') || '/' ELSE 'x://h' || rtrim(root, '/') || '/' END",
             "ltrim(raw, '/')", 'joined0', 'asset_key, pos, root, raw, content')}, (SELECT 1) z, LATERAL (SELECT regexp_replace(joined0, '^x://h', '') AS joined) j)
 p LEFT JOIN {_BODIES} b ON p.path = b.url)"""


def source_files(spark, sf):
    bodies = store.captured_bodies(capture(spark, sf))
    return sourcemaps.explode_sources(sourcemaps.load_sourcemaps(located(spark, sf), bodies), bodies)


@query("explode_sources", f"SELECT * FROM {_SOURCES}")
def explode_sources(spark, sf):
    return source_files(spark, sf).drop("map_url")


@query("clean_source_name", f"SELECT k AS id, {clean_name('p')} AS name FROM (SELECT k, CASE WHEN k % 2 = 0 THEN 'webpack:///' || ref ELSE ref END AS p FROM {LINKS.sql})")
def clean_source_name(spark, sf):
    path = F.expr("CASE WHEN k % 2 = 0 THEN 'webpack:///' || ref ELSE ref END")
    return LINKS.frame(spark, sf).select(
        F.col("k").alias("id"), sourcemaps.clean_source_name(path).alias("name"))


_BANNER = "repeat('=', 60)"
_COMBINED = f"""(SELECT asset_key, string_agg(chr(10) || {_BANNER} || chr(10) || '// Source: ' || name || chr(10) || {_BANNER} || chr(10) || content, chr(10) ORDER BY pos) AS content
FROM {_SOURCES} GROUP BY asset_key)"""


@query("combined_sources", f"SELECT asset_key, content AS source_mapped_content FROM {_COMBINED}")
def combined_sources(spark, sf):
    return sourcemaps.combined_sources(source_files(spark, sf))


@query("findings_in_recovered_sources", f"""
WITH {findings_by_line(_COMBINED, 'asset_key')} SELECT asset_key, pattern_name, value, line_number FROM f""")
def findings_in_recovered_sources(spark, sf):
    combined = sourcemaps.combined_sources(source_files(spark, sf))
    return scan.scan_patterns(combined, ("asset_key",), "source_mapped_content").select(
        "asset_key", "pattern_name", "value", "line_number")


@query("sources_per_map", f"SELECT asset_key, count(*) AS n_sources FROM {_SOURCES} GROUP BY asset_key")
def sources_per_map(spark, sf):
    return rollups.sources_per_map(source_files(spark, sf))


@query("sources_export", f"""
SELECT asset_key, pos, regexp_replace(name, '[<>:"|?*\\x00-\\x1f]', '_', 'g') AS path, content FROM {_SOURCES} WHERE content <> ''""")
def sources_export(spark, sf):
    return sinks.sources_export(source_files(spark, sf))
