"""Queries over text, URL and severity columns and single-row extractors."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptsift.functions import severity, text, urls
from scriptsift.functions.arrays import with_known
from scriptsift.operators import extract, predicates, reflow
from scriptsift.sources import readers, sinks

from .corpus import ASSETS, BUNDLES, FINDINGS, LINKS, PROJECTS, RESPONSES
from .duck import RANK, join_url, lit, origin, part, resolve_url
from .registry import query, spread

# Line lengths of non-blank lines, as a list.
_WIDTHS = "list_transform(list_filter(string_split({0}, chr(10)), lambda l: trim(l) <> ''), lambda l: length(l))"
_MINIFIED = f"coalesce(list_sum({_WIDTHS}) > 200 * len({_WIDTHS}), false)"


def minified(column):
    return _MINIFIED.format(column)


@query("is_minified", f"SELECT asset_key, {minified('content')} AS minified FROM {BUNDLES.sql}")
def is_minified(spark, sf):
    return BUNDLES.frame(spark, sf).select("asset_key", text.is_minified(F.col("content")).alias("minified"))


@query("minified_documents", f"""
SELECT source, lang, count(*) AS n, count(*) FILTER ({minified('text')}) AS n_minified FROM documents GROUP BY ALL""")
def minified_documents(spark, sf):
    docs = spread(spark.read.parquet(f"{sf}/documents.parquet"))
    return docs.groupBy("source", "lang").agg(
        F.count("*").alias("n"), F.count_if(text.is_minified(F.col("text"))).alias("n_minified"))


_PIECES = (
    r"""//[^\n]*|"[^"]*"|'[^']*'|`[^`]*`|[{};,]|[^{};,"'`/]+|/""")
REFLOWED = (
    f"array_to_string(list_transform(regexp_extract_all(content, {lit(_PIECES)}), lambda p: "
    "CASE WHEN p IN ('{', ';', ',') THEN p || chr(10) WHEN p = '}' THEN chr(10) || p ELSE p END), '')")


@query("reflow", f"SELECT asset_key, {REFLOWED} AS reflowed FROM {BUNDLES.sql} WHERE {minified('content')}")
def reflow_minified(spark, sf):
    scripts = BUNDLES.frame(spark, sf)
    return with_known(scripts, "reflowed", reflow.reflow_minified(F.col("content"))).select("asset_key", "reflowed")


# Scripts nested up to nine deep, with up to two closing braces too many.
_NESTED = f"(SELECT asset_key, concat(repeat('if(x){{', cast(asset_key % 10 as int)), content, repeat('}}', cast(asset_key % 12 as int)), ';end') AS content FROM {BUNDLES.sql})"


@query("reflow_depth", f"""
WITH t AS (SELECT asset_key, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM (
    SELECT asset_key, regexp_extract_all(content, {lit(_PIECES)}) AS ps FROM {_NESTED})),
s AS (SELECT *, sum(CASE p WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY asset_key ORDER BY i) AS s FROM t),
d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY asset_key ORDER BY i)) AS d FROM s)
SELECT asset_key, max(d)::INTEGER AS max_depth, md5(string_agg(CASE WHEN p IN ('{{', ';', ',') THEN p || chr(10) || repeat('  ', d::BIGINT)
    WHEN p = '}}' THEN chr(10) || repeat('  ', d::BIGINT) || p ELSE p END, '' ORDER BY i)) AS indented FROM d GROUP BY asset_key""")
def reflow_depth(spark, sf):
    nested = BUNDLES.frame(spark, sf).selectExpr(
        "asset_key", "concat(repeat('if(x){', cast(asset_key % 10 as int)), content, repeat('}', cast(asset_key % 12 as int)), ';end') AS content")
    return nested.select(
        "asset_key", reflow.max_depth(F.col("content")).alias("max_depth"), F.md5(reflow.reflow_indented(F.col("content"))).alias("indented"))


@query("best_content", f"""
SELECT asset_key, md5(CASE WHEN asset_key % 4 = 0 THEN concat('mapped ', asset_key)
  WHEN {minified('content')} THEN {REFLOWED} ELSE content END) AS digest FROM {BUNDLES.sql}""")
def best_content(spark, sf):
    mapped = F.expr("CASE WHEN asset_key % 4 = 0 THEN concat('mapped ', asset_key) WHEN asset_key % 4 = 1 THEN '' END")
    best = reflow.best_content(mapped, reflow.reflow_minified(F.col("content")), F.col("content"))
    return BUNDLES.frame(spark, sf).select("asset_key", F.md5(best).alias("digest"))


@query("non_blank", f"SELECT response_id FROM {RESPONSES.sql} WHERE trim(content) <> ''")
def non_blank(spark, sf):
    return predicates.non_blank(RESPONSES.frame(spark, sf)).select("response_id")


@query("cap_text", f"""
SELECT id, substr(value, 1, 500) AS value, substr(context, 1, 1000) AS context FROM {FINDINGS.sql}""")
def cap_text(spark, sf):
    return FINDINGS.frame(spark, sf).select(
        "id", text.cap(F.col("value"), "value").alias("value"), text.cap(F.col("context"), "context").alias("context"))


@query("content_hash", f"SELECT asset_key, sha256(content) AS content_hash, length(content) AS n_chars FROM {BUNDLES.sql}")
def content_hash(spark, sf):
    return BUNDLES.frame(spark, sf).select(
        "asset_key", text.content_hash(F.col("content")).alias("content_hash"), F.length("content").alias("n_chars"))


@query("document_hashes", """
SELECT sha256(text) AS content_hash, count(*) AS n_copies, min(doc_id) AS first_doc FROM documents GROUP BY 1""")
def document_hashes(spark, sf):
    docs = spread(spark.read.parquet(f"{sf}/documents.parquet"))
    return docs.groupBy(text.content_hash(F.col("text")).alias("content_hash")).agg(
        F.count("*").alias("n_copies"), F.min("doc_id").alias("first_doc"))


@query("dedup_key", f"""
SELECT concat(finding_type, ':', category, ':', value) AS dedup_key, count(*) AS n FROM {FINDINGS.sql} GROUP BY 1""")
def dedup_key(spark, sf):
    key = F.concat_ws(":", "finding_type", "category", "value").alias("dedup_key")
    return FINDINGS.frame(spark, sf).groupBy(key).agg(F.count("*").alias("n"))


_SAFE = "regexp_replace(replace(replace(replace(replace({0}, '://', '_'), '/', '_'), '?', '_'), '&', '_'), '[<>:\"|*\\x00-\\x1f]', '_', 'g')"


@query("safe_filename", f"""SELECT k AS id, CASE WHEN length(n) > 200 THEN substr(n, 1, 183) || '_' || substr(sha256(base), 1, 16) ELSE n END AS file_name
FROM (SELECT k, base, {_SAFE.format('base')} AS n FROM (SELECT k, concat(base, ref) AS base FROM {LINKS.sql}))""")
def safe_filename(spark, sf):
    return LINKS.frame(spark, sf).select(
        F.col("k").alias("id"), text.safe_filename(F.concat("base", "ref")).alias("file_name"))


@query("safe_path", f"""SELECT k AS id, regexp_replace(concat(base, ref), '[<>:"|?*\\x00-\\x1f]', '_', 'g') AS path FROM {LINKS.sql}""")
def safe_path(spark, sf):
    return LINKS.frame(spark, sf).select(F.col("k").alias("id"), text.safe_path(F.concat("base", "ref")).alias("path"))


@query("severity_rank", f"SELECT id, severity, {RANK} AS severity_rank FROM {FINDINGS.sql}")
def severity_rank(spark, sf):
    return FINDINGS.frame(spark, sf).select(
        "id", "severity", severity.severity_rank(F.col("severity")).alias("severity_rank"))


@query("preview", f"""
SELECT id, CASE WHEN length(value) > 60 THEN substr(value, 1, 60) || '...' ELSE value END AS shown,
  CASE WHEN length(value) > 30 THEN substr(value, 1, 30) || '...' ELSE value END AS brief FROM {FINDINGS.sql}""")
def preview(spark, sf):
    return FINDINGS.frame(spark, sf).select(
        "id", text.preview(F.col("value"), 60).alias("shown"), text.preview(F.col("value"), 30).alias("brief"))


def _short(url):
    path = part(url, 3)
    return (f"CASE WHEN length({url}) <= 60 THEN {url} ELSE concat({part(url, 2)}, CASE WHEN length({path}) > 40 "
            f"THEN '...' || right({path}, 37) ELSE {path} END) END")


@query("short_url", f"SELECT id, {_short('url')} AS short FROM {ASSETS.sql}")
def short_url(spark, sf):
    return ASSETS.frame(spark, sf).select("id", urls.short_url(F.col("url")).alias("short"))


@query("scope_list", f"""
SELECT id, len(CASE id % 3 WHEN 0 THEN ['a.*b', 'c'] ELSE [] END) AS n_patterns,
  CASE id % 3 WHEN 0 THEN 'a.*b|c' ELSE '' END AS patterns FROM {PROJECTS.sql}""")
def scope_list(spark, sf):
    scopes = readers.scope_list(F.col("scope_patterns"))
    return PROJECTS.frame(spark, sf).select(
        "id", F.size(scopes).alias("n_patterns"), F.array_join(scopes, "|").alias("patterns"))


@query("created_day", f"SELECT id, coalesce(strftime(created_at, '%Y-%m-%d'), '') AS created FROM {PROJECTS.sql}")
def created_day(spark, sf):
    return PROJECTS.frame(spark, sf).select("id", readers.created_day(F.col("created_at")).alias("created"))


@query("resolve_url", f"SELECT k AS id, url FROM {resolve_url(LINKS.sql, 'base', 'ref', 'url', 'k')}")
def resolve(spark, sf):
    return LINKS.frame(spark, sf).select(
        F.col("k").alias("id"), urls.resolve_url(F.col("base"), F.col("ref")).alias("url"))


@query("join_url", f"SELECT k AS id, url FROM {join_url(LINKS.sql, 'base', 'ref', 'url', 'k')}")
def join(spark, sf):
    return LINKS.frame(spark, sf).select(
        F.col("k").alias("id"), urls.join_url(F.col("base"), F.col("ref")).alias("url"))


@query("page_origins", f"SELECT {origin('url')} AS origin, count(*) AS n_pages FROM pages GROUP BY 1")
def page_origins(spark, sf):
    pages = readers.read_pages(spark, f"{sf}/pages.parquet")
    return pages.groupBy(urls.origin(F.col("url")).alias("origin")).agg(F.count("*").alias("n_pages"))


@query("same_origin", f"""
SELECT k AS id, {origin('base')} = {origin('ref')} AS same FROM
(SELECT k, base, CASE WHEN k % 3 = 0 THEN concat('http://b.example.com:8080/z', k) ELSE base || 'x' END AS ref FROM {LINKS.sql})""")
def same_origin(spark, sf):
    other = F.expr("CASE WHEN k % 3 = 0 THEN concat('http://b.example.com:8080/z', k) ELSE base || 'x' END")
    return LINKS.frame(spark, sf).select(
        F.col("k").alias("id"), urls.same_origin(F.col("base"), other).alias("same"))


_ABSOLUTE = r"""https?://[^\s"'<>`,]{5,}"""
_PATHS = r"""["'](/[a-zA-Z0-9_\-/.:{}\[\]?=&%]+)["']"""
_CALLS = r"""(?:fetch|axios(?:\.\w+)?|XMLHttpRequest|http(?:Client)?\.(?:get|post|put|delete|patch))\s*\(\s*["`]([^"'`]{4,})["`]"""


def endpoints_sql(source, key, content):
    return f"""
SELECT {key}, unnest(regexp_extract_all({content}, {lit(_ABSOLUTE)})) AS raw, 1 AS kind FROM {source}
UNION ALL SELECT {key}, unnest(regexp_extract_all({content}, {lit(_PATHS)}, 1)), 2 FROM {source}
UNION ALL SELECT {key}, unnest(regexp_extract_all({content}, {lit(_CALLS)}, 1)), 3 FROM {source}"""


_ENDPOINTS = f"""
SELECT DISTINCT {{key}}, CASE WHEN kind = 1 THEN regexp_replace(raw, '[.,;)''"]+$', '') ELSE raw END AS endpoint FROM ({{rows}})
WHERE kind <> 2 OR (length(raw) >= 4 AND raw NOT LIKE '//%' AND raw NOT LIKE '/*%')"""


@query("extract_endpoints", _ENDPOINTS.format(key="asset_key", rows=endpoints_sql(BUNDLES.sql, "asset_key", "content")))
def extract_endpoints(spark, sf):
    return extract.extract_endpoints(BUNDLES.frame(spark, sf))


@query("endpoints_of_pages", _ENDPOINTS.format(key="page_id", rows=endpoints_sql("pages", "page_id", "html")))
def endpoints_of_pages(spark, sf):
    pages = readers.read_pages(spark, f"{sf}/pages.parquet")
    return extract.extract_endpoints(pages, ("page_id",), "html")


_LABEL = "[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
_HOST = rf"""(?m)(?:^|["'\s(=])({_LABEL}(?:\.{_LABEL})*\.[a-zA-Z]{{2,}})(?:["'\s),;]|$)"""


def hosts_sql(source, key, content):
    # One delimiter can end one name and begin the next; doubling delimiters
    # stands in for the look-ahead.
    doubled = f"regexp_replace({content}, '([\"''\\s(=),;])', '\\1\\1', 'g')"
    return f"""SELECT DISTINCT {key}, lower(h) AS hostname FROM
(SELECT {key}, unnest(regexp_extract_all({doubled}, {lit(_HOST)}, 1)) AS h FROM {source})
WHERE NOT regexp_matches(lower(h), '\\.(js|css|png|jpg|gif)$')"""


@query("extract_hostnames", hosts_sql(BUNDLES.sql, "asset_key", "content"))
def extract_hostnames(spark, sf):
    return extract.extract_hostnames(BUNDLES.frame(spark, sf))


@query("hostnames_of_documents", f"""
SELECT source, count(DISTINCT d.doc_id) AS n_docs, count(hostname) AS n_hostnames FROM documents d
LEFT JOIN ({hosts_sql("documents", "doc_id", "text")}) h ON d.doc_id = h.doc_id GROUP BY source""")
def hostnames_of_documents(spark, sf):
    docs = spread(spark.read.parquet(f"{sf}/documents.parquet"))
    return docs.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum(F.size(extract.hostnames(F.col("text")))).alias("n_hostnames"))


@query("sorted_endpoint_lists", f"""
SELECT a.asset_key, coalesce(string_agg(endpoint, ' ' ORDER BY endpoint), '') AS endpoints FROM {BUNDLES.sql} a LEFT JOIN
({_ENDPOINTS.format(key="asset_key", rows=endpoints_sql(BUNDLES.sql, "asset_key", "content"))}) e
ON a.asset_key = e.asset_key GROUP BY a.asset_key""")
def sorted_endpoint_lists(spark, sf):
    return BUNDLES.frame(spark, sf).select(
        "asset_key", F.array_join(extract.endpoints(F.col("content")), " ").alias("endpoints"))


@query("text_archive", f"""
SELECT CASE WHEN length(n) > 200 THEN substr(n, 1, 183) || '_' || substr(sha256(asset_url), 1, 16) ELSE n END AS file_name, asset_url AS url, md5(content) AS digest FROM (SELECT *, {_SAFE.format('asset_url')} AS n FROM {BUNDLES.sql})""")
def text_archive(spark, sf):
    rows = sinks.text_archive(BUNDLES.frame(spark, sf), "asset_url")
    return rows.select("file_name", "url", F.md5("content").alias("digest"))


@query("redacted_values", f"""
SELECT id, concat(substr(value, 1, 4), '~', substr(sha256(value), 1, 12)) AS shown FROM {FINDINGS.sql}""")
def redacted_values(spark, sf):
    return FINDINGS.frame(spark, sf).select("id", text.redact(F.col("value")).alias("shown"))
