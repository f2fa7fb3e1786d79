"""Files written by the sinks and read back, and operators over the given texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptsift.operators import extract, layout, reflow, scan, store
from scriptsift.operators import pages as P
from scriptsift.session import shared_folder
from scriptsift.sources import readers, sinks
from scriptsift.streaming import live

from .corpus import ASSETS, BUNDLES, FINDINGS, PROJECTS
from .duck import findings_by_line, lit
from .registry import query, spread
from .scan_queries import chosen
from .sourcemap_queries import _SOURCES, source_files
from .store_queries import _GONE, tables
from .text_queries import _SAFE


@query("read_js_files", f"""
SELECT g, md5(string_agg(content, chr(10) ORDER BY asset_key) || chr(10)) AS digest, sum(strlen(content) + 1) AS n_bytes
FROM (SELECT asset_key // 500 AS g, asset_key, content FROM {BUNDLES.sql}) GROUP BY g""")
def read_js_files(spark, sf):
    """Scripts written as plain files, one for so many keys, and read as files: their number grows with the bundles."""
    path = shared_folder(spark, "js-files")
    rows = BUNDLES.frame(spark, sf).select(F.floor(F.col("asset_key") / 500).alias("g"), "asset_key", "content")
    rows.repartition("g").sortWithinPartitions("g", "asset_key").select("g", "content").write.partitionBy("g").text(path)
    files = readers.read_js_files(spark, f"{path}/g=*/*.txt")
    return files.select(
        F.regexp_extract("asset_url", "/g=([0-9]+)/", 1).cast("long").alias("g"), F.md5("content").alias("digest"), "n_bytes")


@query("analysis_export", f"""
WITH {findings_by_line(BUNDLES.sql, 'asset_key, asset_url', chosen(finding_types=['crypto_weakness']))}
SELECT finding_type, category, value, severity, confidence, line_number, pattern_name,
  array_to_string(lines[greatest(line_number - 2, 1):line_number + 2], chr(10)) AS context
FROM f JOIN t ON f.asset_key = t.asset_key""")
def analysis_export(spark, sf):
    """The eight-field export, written and read back."""
    export = sinks.analysis_export(scan.scan_patterns(BUNDLES.frame(spark, sf), finding_types=["crypto_weakness"]))
    path = shared_folder(spark, "analysis")
    sinks.write_findings_json(export, path)
    return spark.read.schema(export.schema).json(path)


@query("written_sources", f"""
SELECT asset_key, pos, regexp_replace(name, '[<>:"|?*\\x00-\\x1f]', '_', 'g') AS path, content FROM {_SOURCES} WHERE content <> ''""")
def written_sources(spark, sf):
    path = shared_folder(spark, "sources-out")
    sinks.write_sources(source_files(spark, sf), path)
    return spark.read.parquet(path)


@query("written_text_archive", f"""
SELECT CASE WHEN length(n) > 200 THEN substr(n, 1, 183) || '_' || substr(sha256(asset_url), 1, 16) ELSE n END AS file_name,
  asset_url AS url, md5(content) AS digest FROM (SELECT *, {_SAFE.format('asset_url')} AS n FROM {BUNDLES.sql})""")
def written_text_archive(spark, sf):
    path = shared_folder(spark, "text-archive")
    sinks.write_assets_text(BUNDLES.frame(spark, sf), path, "asset_url")
    return spark.read.parquet(path).select("file_name", "url", F.md5("content").alias("digest"))


@query("capture_project", f"""
SELECT name, target_url FROM {PROJECTS.sql} UNION ALL SELECT 'proxy_capture', '(proxy capture)'""")
def capture_project(spark, sf):
    """Made once, however often it is asked for."""
    return live.ensure_project(live.ensure_project(PROJECTS.frame(spark, sf))).select("name", "target_url")


@query("rewritten_projects", f"""
SELECT 'projects' AS kind, count(*) AS n, coalesce(sum(id), 0) AS checksum FROM {PROJECTS.sql} WHERE id NOT IN {_GONE}
UNION ALL SELECT 'assets', count(*), coalesce(sum(id), 0) FROM {ASSETS.sql} WHERE project_id NOT IN {_GONE}
UNION ALL SELECT 'findings', count(*), coalesce(sum(id), 0) FROM {FINDINGS.sql} WHERE project_id NOT IN {_GONE}""")
def rewritten_projects(spark, sf):
    """Stored tables without the deleted projects, written anew."""
    root = shared_folder(spark, "store")
    for name, rows in zip(store.STORED, tables(spark, sf)):
        rows.write.parquet(f"{root}/before/{name}")
    names = spark.read.parquet(f"{sf}/supplier.parquet").filter("s_acctbal < 0").selectExpr(
        "concat('proj-', cast(s_suppkey as string)) AS name")
    store.rewrite_without(spark, f"{root}/before", f"{root}/after", names)
    parts = [
        spark.read.parquet(f"{root}/after/{name}").agg(
            F.count("*").alias("n"), F.coalesce(F.sum("id"), F.lit(0)).alias("checksum")).select(F.lit(name).alias("kind"), "n", "checksum")
        for name in store.STORED]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("deleted_in_place", f"""
SELECT 'projects' AS kind, count(*) AS n, coalesce(sum(id), 0) AS checksum FROM {PROJECTS.sql} WHERE id NOT IN {_GONE}
UNION ALL SELECT 'assets', count(*), coalesce(sum(id), 0) FROM {ASSETS.sql} WHERE project_id NOT IN {_GONE}
UNION ALL SELECT 'findings', count(*), coalesce(sum(id), 0) FROM {FINDINGS.sql} WHERE project_id NOT IN {_GONE}""")
def deleted_in_place(spark, sf):
    """The store by project bucket; only the buckets of deleted projects are written anew."""
    root = shared_folder(spark, "store")
    layout.write_store(dict(zip(store.STORED, tables(spark, sf))), root)
    names = spark.read.parquet(f"{sf}/supplier.parquet").filter("s_acctbal < 0").selectExpr(
        "concat('proj-', cast(s_suppkey as string)) AS name")
    layout.delete_in_place(spark, root, names)
    parts = [
        layout.read_store(spark, root, name).agg(
            F.count("*").alias("n"), F.coalesce(F.sum("id"), F.lit(0)).alias("checksum")).select(F.lit(name).alias("kind"), "n", "checksum")
        for name in store.STORED]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("report_documents", f"""
SELECT project_id, 'asset' AS kind, id, url AS label, asset_type AS detail FROM {ASSETS.sql} a WHERE project_id IN (SELECT id FROM {PROJECTS.sql})
UNION ALL SELECT f.project_id, 'finding', f.id, value, coalesce(url, '') FROM {FINDINGS.sql} f LEFT JOIN {ASSETS.sql} a ON f.asset_id = a.id
    WHERE f.project_id IN (SELECT id FROM {PROJECTS.sql})
UNION ALL SELECT id, 'project', id, name, target_url FROM {PROJECTS.sql}""")
def report_documents(spark, sf):
    """The nested documents, written and read back line by line."""
    projects, assets, findings = tables(spark, sf)
    path = shared_folder(spark, "reports")
    sinks.write_report_documents(projects, assets, store.with_asset_url(findings, assets), path, compression="gzip")
    lines = spark.read.schema("value string, project_id long").text(path)
    text = F.regexp_replace("value", "^,", "")
    row = F.from_json(text, "id long, url string, asset_type string, finding_type string, value string, asset_url string")
    head = F.from_json(F.concat(text, F.lit("]}")), "project struct<id:long,name:string,target_url:string>")["project"]
    kind = F.when(text.startswith('{"project"'), "project").when(row["finding_type"].isNotNull(), "finding").otherwise("asset")
    rows = lines.filter("value like '{%' or value like ',{%'").select("project_id", kind.alias("kind"), row.alias("row"), head.alias("head"))
    return rows.select(
        "project_id", "kind", F.coalesce("row.id", "head.id").alias("id"),
        F.when(F.col("kind") == "project", F.col("head.name")).when(F.col("kind") == "asset", F.col("row.url")).otherwise(F.col("row.value")).alias("label"),
        F.when(F.col("kind") == "project", F.col("head.target_url")).when(F.col("kind") == "asset", F.col("row.asset_type")).otherwise(
            F.col("row.asset_url")).alias("detail"))


# -- the given texts

_QUOTED = [lit(f"{q}((?:[^{q}\\\\]|\\\\.)*){q}") for q in ("'", '"', "`")]


@query("string_literals_of_documents", f"""
SELECT doc_id, cast(count(literal) AS int) AS n, md5(coalesce(string_agg(literal, chr(10) ORDER BY literal), '')) AS digest FROM (
  SELECT d.doc_id, literal FROM documents d LEFT JOIN (
    SELECT doc_id, trim(x, chr(32)||chr(9)||chr(10)||chr(13)) AS literal FROM (
      SELECT doc_id, unnest(list_concat(list_concat(regexp_extract_all(text, {_QUOTED[0]}, 1, 's'), regexp_extract_all(text, {_QUOTED[1]}, 1, 's')),
        regexp_extract_all(text, {_QUOTED[2]}, 1, 's'))) AS x FROM documents) WHERE trim(x, chr(32)||chr(9)||chr(10)||chr(13)) <> '') l
  ON d.doc_id = l.doc_id) GROUP BY doc_id""")
def string_literals_of_documents(spark, sf):
    docs = spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    return docs.select("doc_id", extract.string_literals(F.col("text")).alias("found")).select(
        "doc_id", F.size("found").alias("n"), F.md5(F.array_join(F.array_sort("found"), "\n")).alias("digest"))


@query("reflow_of_documents", """
SELECT doc_id, length(text) AS n_chars, length(text) - length(replace(text, chr(10), '')) AS n_lines FROM documents""")
def reflow_of_documents(spark, sf):
    """Reflowing adds line feeds and nothing else."""
    docs = spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    flowed = docs.select("doc_id", "text", reflow.reflow(F.col("text")).alias("r"))
    bare = F.replace("r", F.lit("\n"), F.lit("")) == F.replace("text", F.lit("\n"), F.lit(""))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return flowed.filter(bare & (F.length("r") >= F.length("text"))).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"))


@query("script_urls_of_pages", """
SELECT count(*) AS n_pages, count(*) FILTER (regexp_matches(html, '<script[^>]*\\ssrc\\s*=')) AS n_with_scripts FROM pages""")
def script_urls_of_pages(spark, sf):
    pages = spread(readers.read_pages(spark, f"{sf}/pages.parquet"))
    found = P.page_script_urls(pages, cross_origin=True).select("page_id").distinct().withColumn("has", F.lit(1))
    return pages.select("page_id").join(found, "page_id", "left").agg(
        F.count("*").alias("n_pages"), F.count("has").alias("n_with_scripts"))
