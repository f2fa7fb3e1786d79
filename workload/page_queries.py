"""Queries over HTML pages and captured responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptsift.operators import pages as P
from scriptsift.operators import predicates, rollups, scan, store
from scriptsift.sources import readers

from .corpus import BUNDLES, LINKS, RESPONSES, SITE_PAGES
from .duck import findings_by_line, lit, origin, part, resolve_url
from .registry import dealt, query, spread


def site_pages(spark, sf):
    return SITE_PAGES.frame(spark, sf)


# The oracle reads the generated pages with simple expressions: titles and
# comments out, then script and link tags.
_CLEAN = (
    f"(SELECT page_id, url, regexp_replace(regexp_replace(html, '<title>.*?</title>', '', 'gs'), '<!--.*?-->', '', 'gs') AS html "
    f"FROM {SITE_PAGES.sql})")
_SRC = r"""<script[^>]*?\ssrc\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_BODY = r"<script(?:>| type=[^>]*>| id=[^>]*>)(.*?)</script>"


def _unquoted(c):
    return f"replace(trim({c}, chr(34)||chr(39)), '&amp;', '&')"


def _numbered(source, expr, keep):
    """Rows of a list expression with their position."""
    return (f"(SELECT {keep}, unnest(xs) AS x, unnest(range(0, len(xs))) AS i FROM "
            f"(SELECT {keep}, {expr} AS xs FROM {source}))")


def _refs(targets, scope):
    """First position per (page, URL), same origin only, numbered from 0."""
    found = resolve_url(targets, "url", "x", "ref_url", "page_id, url, i")
    return f"""SELECT page_id, url, cast(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS int) AS ord, ref_url
FROM (SELECT page_id, url, ref_url, min(i) AS i FROM {found}
  WHERE ref_url IS NOT NULL AND {scope} GROUP BY ALL)"""


_SAME = f"{origin('ref_url')} = {origin('url')}"
_SCRIPTS = _numbered(_CLEAN, f"list_transform(regexp_extract_all(html, {lit(_SRC)}, 1, 'i'), lambda t: {_unquoted('t')})", "page_id, url")
_PRELOADS = _numbered(
    _CLEAN, "list_value(regexp_extract(html, 'modulepreload\" href=\"([^\"]*)\"', 1), "
    "regexp_extract(html, 'rel=.preload. href=([^ >]*)', 1))", "page_id, url")
_INLINE_LIST = (
    f"list_filter(list_transform(regexp_extract_all(html, {lit(_BODY)}, 1, 's'), lambda b: trim(b, ' '||chr(10))), lambda b: b <> '')")
_INLINE = f"""(SELECT page_id, url, content, cast(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS int) AS ord FROM
(SELECT page_id, url, x AS content, min(i) AS i FROM {_numbered(_CLEAN, _INLINE_LIST, 'page_id, url')} GROUP BY ALL))"""
_IMPORT_LIST = (
    r"""list_concat(list_concat(regexp_extract_all(content, 'import\s*\(\s*["'']([^"'']+\.js[^"'']*)["'']', 1, 'i'),
    regexp_extract_all(content, 'require\s*\(\s*["'']([^"'']+\.js[^"'']*)["'']', 1, 'i')),
    regexp_extract_all(content, '["'']src["'']\s*:\s*["'']([^"'']+\.js)["'']', 1, 'i'))""")
_IMPORTS = (
    f"(SELECT page_id, url, x, ord * 1000 + i AS i FROM {_numbered(_INLINE, _IMPORT_LIST, 'page_id, url, ord')})")


@query("script_refs", _refs(_SCRIPTS, _SAME))
def script_refs(spark, sf):
    return P.script_refs(site_pages(spark, sf))


@query("script_refs_cross_origin", _refs(_SCRIPTS, "true"))
def script_refs_cross_origin(spark, sf):
    return P.script_refs(site_pages(spark, sf), cross_origin=True)


@query("script_refs_scoped", _refs(_SCRIPTS, f"({_SAME} OR regexp_matches(ref_url, 'cdn[0-2]\\.'))"))
def script_refs_scoped(spark, sf):
    return P.script_refs(site_pages(spark, sf), scope=[r"cdn[0-2]\."])


@query("preload_refs", _refs(_PRELOADS, _SAME))
def preload_refs(spark, sf):
    return P.preload_refs(site_pages(spark, sf))


@query("inline_scripts", f"""
SELECT page_id, url, ord, content, concat(url, '#inline-script-', ord) AS asset_url FROM {_INLINE}""")
def inline_scripts(spark, sf):
    return P.inline_scripts(site_pages(spark, sf))


@query("inline_scripts_of_pages", r"""
SELECT page_id, url, 0 AS ord, regexp_extract(html, '<script>(.*?)</script>', 1, 's') AS content,
  concat(url, '#inline-script-0') AS asset_url FROM pages""")
def inline_scripts_of_pages(spark, sf):
    return P.inline_scripts(spread(readers.read_pages(spark, f"{sf}/pages.parquet")))


@query("inline_script_findings", f"""
WITH i AS (SELECT concat(url, '#inline-script-', ord) AS asset_url, content FROM {_INLINE}),
{findings_by_line('i', 'asset_url')}
SELECT asset_url, pattern_name, value, line_number, severity FROM f""")
def inline_script_findings(spark, sf):
    return scan.scan_patterns(P.inline_scripts(site_pages(spark, sf)), ("asset_url",)).select(
        "asset_url", "pattern_name", "value", "line_number", "severity")


@query("inline_import_refs", _refs(_IMPORTS, _SAME))
def inline_import_refs(spark, sf):
    return P.inline_import_refs(site_pages(spark, sf))


_ALL_REFS = (
    f"(SELECT page_id, url, x, i, 'script' AS how FROM {_SCRIPTS} UNION ALL "
    f"SELECT page_id, url, x, i + 100000, 'preload' FROM {_PRELOADS} UNION ALL "
    f"SELECT page_id, url, x, i + 200000, 'inline_import' FROM {_IMPORTS})")


@query("page_script_urls", f"""
SELECT page_id, url, ref_url, found_by, cast(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS int) AS ord FROM
(SELECT page_id, url, ref_url, min(i) AS i, min_by(how, i) AS found_by
 FROM {resolve_url(_ALL_REFS, 'url', 'x', 'ref_url', 'page_id, url, i, how')}
 WHERE ref_url IS NOT NULL AND {_SAME} GROUP BY page_id, url, ref_url)""")
def page_script_urls(spark, sf):
    return P.page_script_urls(site_pages(spark, sf))


@query("discovery_counts", f"""
WITH u AS (SELECT page_id, count(DISTINCT ref_url) AS n FROM {resolve_url(_ALL_REFS, 'url', 'x', 'ref_url', 'page_id, url, i, how')}
 WHERE ref_url IS NOT NULL AND {_SAME} GROUP BY page_id),
i AS (SELECT page_id, count(*) AS n FROM {_INLINE} GROUP BY page_id)
SELECT coalesce(u.page_id, i.page_id) AS page_id, coalesce(u.n, 0) AS n_script_urls, coalesce(i.n, 0) AS n_inline
FROM u FULL JOIN i ON u.page_id = i.page_id""")
def discovery_counts(spark, sf):
    pages = site_pages(spark, sf)
    return rollups.discovery_counts(P.page_script_urls(pages), P.inline_scripts(pages))


_MANIFEST = (
    r"""list_transform(regexp_extract_all(regexp_extract(content, '__BUILD_MANIFEST\s*=\s*(\{[^;]+\})', 1), '["'']([^"'']*\.js)["'']', 1),
    lambda r: CASE WHEN regexp_matches(r, '^(https?:)?//') THEN r ELSE '/_next/static/' || ltrim(r, '/') END)""")


@query("page_next_manifest_refs", f"""
SELECT page_id, ord, ref_url FROM ({_refs(
    "(SELECT page_id, url, x, ord * 1000 + i AS i FROM " + _numbered(_INLINE, _MANIFEST, 'page_id, url, ord') + ")",
    'true')})""")
def page_next_manifest_refs(spark, sf):
    return P.page_next_manifest_refs(
        P.inline_scripts(site_pages(spark, sf)), ("page_id", "url")).select("page_id", "ord", "ref_url")


@query("detect_frameworks", f"""
WITH t AS (SELECT page_id, html FROM {SITE_PAGES.sql})
SELECT page_id, 'nextjs' AS framework FROM t WHERE contains(html, '_next/') OR contains(html, '__NEXT_DATA__')
UNION ALL SELECT page_id, f FROM t, (VALUES ('vite'), ('webpack'), ('remix'), ('nuxt')) v(f) WHERE contains(lower(html), f)""")
def detect_frameworks(spark, sf):
    return P.detect_frameworks(site_pages(spark, sf)).select("page_id", "framework")


@query("frameworks_of_pages", """
SELECT coalesce(framework, 'none') AS framework, count(*) AS n_pages FROM pages p LEFT JOIN (
SELECT page_id, 'nextjs' AS framework FROM pages WHERE contains(html, '_next/') OR contains(html, '__NEXT_DATA__')
UNION ALL SELECT page_id, f FROM pages, (VALUES ('vite'), ('webpack'), ('remix'), ('nuxt')) v(f) WHERE contains(lower(html), f)
) f USING (page_id) GROUP BY 1""")
def frameworks_of_pages(spark, sf):
    pages = spread(readers.read_pages(spark, f"{sf}/pages.parquet"))
    labelled = pages.select("page_id").join(P.detect_frameworks(pages), "page_id", "left")
    return labelled.groupBy(F.coalesce("framework", F.lit("none")).alias("framework")).agg(F.count("*").alias("n_pages"))


_EDGE_SCRIPTS = (
    "(SELECT o_orderkey AS k, concat('https://e', cast(o_orderkey % 20 as string), '.example.com/js/m', "
    "cast(o_orderkey % 400 as string), '.js') AS url, concat('import(\"./c', cast(o_orderkey % 50 as string), "
    "'.js\"); Require( \"../v/', cast(o_orderkey % 7 as string), '.js?x\"); a={\"src\": \"/s', "
    "cast(o_orderkey % 30 as string), '.js\"}; import(\"https://other.example.org/z.js\"); import(\"./c', "
    "cast(o_orderkey % 50 as string), '.js\")') AS content FROM orders)")


def edge_scripts(spark, sf):
    dealt(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey")).createOrReplaceTempView("orders")
    return spark.sql(f"SELECT * FROM {_EDGE_SCRIPTS}")


@query("js_import_edges", f"""
SELECT DISTINCT url AS parent_url, ref_url AS child_url FROM {resolve_url(
    _numbered(_EDGE_SCRIPTS, _IMPORT_LIST, 'k, url'), 'url', 'x', 'ref_url', 'k, url')} WHERE {_SAME}""")
def js_import_edges(spark, sf):
    return P.js_import_edges(edge_scripts(spark, sf))


@query("in_scope", f"""
SELECT k AS id, coalesce({origin('ref')} = {origin('base')}, false) OR regexp_matches(ref, 'example\\.net/z') OR regexp_matches(ref, '^data:') AS inside
FROM {LINKS.sql}""")
def in_scope(spark, sf):
    return LINKS.frame(spark, sf).select(
        F.col("k").alias("id"),
        P.in_scope(F.col("ref"), F.col("base"), [r"example\.net/z", "^data:"]).alias("inside"))


# -- responses

def responses(spark, sf):
    return RESPONSES.frame(spark, sf)


_KIND = "lower(coalesce(content_type, ''))"


@query("read_responses", f"""
SELECT response_id, url, status_code, content_type, error, length(content) AS n_chars FROM {RESPONSES.sql}""")
def read_responses(spark, sf):
    """Write the capture in the response schema, then read it back through the source."""
    from scriptsift.session import shared_folder
    path = shared_folder(spark, "responses")
    rows = responses(spark, sf)
    rows.write.parquet(path)
    return readers.read_responses(spark, path).select(
        "response_id", "url", "status_code", "content_type", "error", F.length("content").alias("n_chars"))


@query("classify_response", f"""
SELECT response_id, contains({_KIND}, 'javascript') OR contains({_KIND}, 'ecmascript') OR rtrim(final_url, '?') LIKE '%.js' AS is_javascript,
  contains({_KIND}, 'html') AS is_html, final_url LIKE '%.map' AS is_sourcemap FROM {RESPONSES.sql}""")
def classify_response(spark, sf):
    kind = predicates.classify_response(F.col("content_type"), F.col("final_url"))
    return responses(spark, sf).select("response_id", kind.alias("kind")).select("response_id", "kind.*")


STREAM_KIND = (
    "CASE WHEN " + " OR ".join(f"contains({_KIND}, '{m}')" for m in predicates.SCRIPT_TYPES)
    + f" THEN 'javascript' WHEN contains({_KIND}, 'text/html') THEN 'html' "
    f"WHEN lower({part('url', 3)}) LIKE '%.js' THEN 'javascript' END")


@query("classify_stream_response", f"SELECT response_id, {STREAM_KIND} AS asset_type FROM {RESPONSES.sql}")
def classify_stream_response(spark, sf):
    return responses(spark, sf).select(
        "response_id", predicates.classify_stream_response(F.col("content_type"), F.col("url")).alias("asset_type"))


OK = "error IS NULL AND status_code BETWEEN 200 AND 399"


@query("ok_responses", f"SELECT response_id, url, status_code FROM {RESPONSES.sql} WHERE {OK}")
def ok_responses(spark, sf):
    return predicates.ok_responses(responses(spark, sf)).select("response_id", "url", "status_code")


@query("failed_responses", f"""
SELECT url, coalesce(nullif(error, ''), cast(status_code AS varchar)) AS reason, count(*) AS n
FROM {RESPONSES.sql} WHERE NOT ({OK}) GROUP BY ALL""")
def failed_responses(spark, sf):
    return predicates.failed_responses(responses(spark, sf)).groupBy("url", "reason").agg(F.count("*").alias("n"))


@query("first_responses", f"""
SELECT sha256(content) AS content_hash, min_by(url, (captured_at, response_id)) AS url,
  min_by(response_id, (captured_at, response_id)) AS response_id FROM {RESPONSES.sql} GROUP BY 1""")
def first_responses(spark, sf):
    return store.first_responses(responses(spark, sf)).select("content_hash", "url", "response_id")


@query("captured_bodies", f"""
SELECT url, min_by(content, captured_at) AS body FROM {RESPONSES.sql} WHERE {OK} GROUP BY url""")
def captured_bodies(spark, sf):
    return store.captured_bodies(responses(spark, sf))


@query("unanalyzed_assets", f"""
SELECT asset_key FROM {BUNDLES.sql} WHERE sha256(content) NOT IN
(SELECT sha256(content) FROM {BUNDLES.sql} WHERE project_id = 0)""")
def unanalyzed_assets(spark, sf):
    """One project has been scanned; what is left of all projects?"""
    assets = BUNDLES.frame(spark, sf).withColumn("content_hash", F.sha2("content", 256))
    scanned = assets.filter("project_id = 0").select("content_hash")
    return predicates.unanalyzed_assets(assets, scanned).select("asset_key")
