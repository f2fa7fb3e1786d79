"""Queries over the stored tables: joins, rollups, listings, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptsift.operators import listing, predicates, provenance, rollups, store
from scriptsift.session import shared_folder
from scriptsift.sources import sinks

from .corpus import ASSETS, FINDINGS, PROJECTS, PROVENANCE
from .duck import RANK
from .registry import query
from .scan_queries import with_places

P, A, FI = PROJECTS.sql, ASSETS.sql, FINDINGS.sql


def tables(spark, sf):
    return PROJECTS.frame(spark, sf), ASSETS.frame(spark, sf), FINDINGS.frame(spark, sf)


@query("min_severity", f"SELECT id, severity FROM {FI} WHERE {RANK} <= 2")
def min_severity(spark, sf):
    return predicates.min_severity(FINDINGS.frame(spark, sf), "medium").select("id", "severity")


@query("min_severity_unknown_level", f"SELECT severity, count(*) AS n FROM {FI} WHERE {RANK} <= 4 GROUP BY severity")
def min_severity_unknown_level(spark, sf):
    return predicates.min_severity(FINDINGS.frame(spark, sf), "whatever").groupBy("severity").agg(F.count("*").alias("n"))


@query("select_categories", f"SELECT id, category FROM {FI} WHERE category IN ('cat1', 'cat3')")
def select_categories(spark, sf):
    return predicates.select_categories(
        FINDINGS.frame(spark, sf), ["cat1", "cat2", "cat3"], ["cat2", "cat8"]).select("id", "category")


@query("filter_findings", f"""
SELECT id FROM {FI} WHERE finding_type = 'secret' AND severity = 'high' AND category = 'cat4'""")
def filter_findings(spark, sf):
    return predicates.filter_findings(FINDINGS.frame(spark, sf), "secret", "high", "cat4").select("id")


@query("findings_with_asset_url", f"""
SELECT f.id, f.asset_id, coalesce(a.url, '') AS asset_url FROM {FI} f LEFT JOIN {A} a ON f.asset_id = a.id""")
def findings_with_asset_url(spark, sf):
    _, assets, findings = tables(spark, sf)
    return store.with_asset_url(findings, assets).select("id", "asset_id", "asset_url")


@query("assets_of_project", f"""
SELECT a.id, a.url FROM {A} a JOIN {P} p ON a.project_id = p.id WHERE p.name = 'proj-0'""")
def assets_of_project(spark, sf):
    projects, assets, _ = tables(spark, sf)
    return store.of_project(assets, projects, "proj-0").select("id", "url")


@query("findings_of_project", f"""
SELECT f.id, f.value FROM {FI} f JOIN {P} p ON f.project_id = p.id WHERE p.name = 'proj-7'""")
def findings_of_project(spark, sf):
    projects, _, findings = tables(spark, sf)
    return store.of_project(findings, projects, "proj-7").select("id", "value")


@query("findings_of_missing_project", f"""
SELECT f.id FROM {FI} f JOIN {P} p ON f.project_id = p.id WHERE p.name = 'nobody'""")
def findings_of_missing_project(spark, sf):
    projects, _, findings = tables(spark, sf)
    return store.of_project(findings, projects, "nobody").select("id")


# What an earlier run has stored.
_EARLIER = "discovered_at < TIMESTAMP '2024-01-01 09:00:00'"


@query("new_findings", f"""
SELECT id FROM {FI} n WHERE NOT EXISTS (SELECT 1 FROM {FI} s WHERE s.discovered_at < TIMESTAMP '2024-01-01 09:00:00' AND s.project_id = n.project_id AND s.asset_id = n.asset_id
 AND s.finding_type = n.finding_type AND s.category = n.category AND s.value = n.value)""")
def new_findings(spark, sf):
    findings = FINDINGS.frame(spark, sf)
    return store.new_findings(findings, findings.filter(_EARLIER)).select("id")


@query("new_findings_compat", f"""
SELECT id FROM {FI} n WHERE NOT EXISTS (SELECT 1 FROM {FI} s WHERE s.discovered_at < TIMESTAMP '2024-01-01 09:00:00' AND s.project_id = n.project_id AND s.asset_id = n.asset_id
 AND s.finding_type = n.finding_type AND substr(s.value, 1, 500) = substr(n.value, 1, 500))""")
def new_findings_compat(spark, sf):
    findings = FINDINGS.frame(spark, sf)
    return store.new_findings(findings, findings.filter(_EARLIER), compat=True).select("id")


@query("stored_value_dedup", f"""
SELECT project_id, finding_type, category, value, arg_min(id, cast(p_ord as bigint) * 100000000 + m_ord) AS id FROM {FI}
GROUP BY project_id, finding_type, category, value""")
def stored_value_dedup(spark, sf):
    # Contexts are several times as long as all the rest and would pass the shuffle and its sorts with the minima.
    found = FINDINGS.frame(spark, sf).select("project_id", "finding_type", "category", "value", "id", "p_ord", "m_ord")
    return store.persistable_findings(found, ("project_id",)).select(
        "project_id", "finding_type", "category", "value", "id")


_DISCOVERED = f"(SELECT project_id, CASE WHEN is_chunk THEN url ELSE url || '&new' END AS url FROM {A})"


@query("unknown_urls", f"""
SELECT DISTINCT project_id, url FROM {_DISCOVERED} d WHERE NOT EXISTS
(SELECT 1 FROM {A} a WHERE a.project_id = d.project_id AND a.url = d.url)""")
def unknown_urls(spark, sf):
    assets = ASSETS.frame(spark, sf)
    discovered = assets.selectExpr("project_id", "CASE WHEN is_chunk THEN url ELSE url || '&new' END AS url")
    return store.unknown_urls(discovered, assets)


_GONE = f"(SELECT id FROM {P} WHERE name IN (SELECT 'proj-' || cast(s_suppkey AS varchar) FROM supplier WHERE s_acctbal < 0))"


@query("delete_projects", f"""
SELECT 'project' AS kind, count(*) AS n, coalesce(sum(id), 0) AS checksum FROM {P} WHERE id NOT IN {_GONE}
UNION ALL SELECT 'asset', count(*), coalesce(sum(id), 0) FROM {A} WHERE project_id NOT IN {_GONE}
UNION ALL SELECT 'finding', count(*), coalesce(sum(id), 0) FROM {FI} WHERE project_id NOT IN {_GONE}""")
def delete_projects(spark, sf):
    names = spark.read.parquet(f"{sf}/supplier.parquet").filter("s_acctbal < 0").selectExpr(
        "concat('proj-', cast(s_suppkey as string)) AS name")
    left = store.delete_projects(*tables(spark, sf), names)
    parts = [
        rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("id"), F.lit(0)).alias("checksum")).select(
            F.lit(kind).alias("kind"), "n", "checksum")
        for kind, rows in zip(("project", "asset", "finding"), left)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("asset_import_graph", f"""
SELECT c.id, c.url, c.chunk_id, p.id AS parent_id, p.asset_type AS parent_type FROM {A} c JOIN {A} p
ON c.parent_url = p.url AND c.project_id = p.project_id""")
def asset_import_graph(spark, sf):
    return store.asset_import_graph(ASSETS.frame(spark, sf)).select("id", "url", "chunk_id", "parent_id", "parent_type")


_CLOSURE = f"""
WITH RECURSIVE a AS (SELECT * FROM {PROVENANCE.sql}),
e AS (SELECT DISTINCT c.project_id, c.id, p.id AS parent_id FROM a c JOIN a p ON c.project_id = p.project_id AND c.parent_url = p.url),
r AS (SELECT project_id, id, parent_id AS ancestor_id, 1 AS depth, [parent_id] AS path FROM e
    UNION ALL SELECT r.project_id, r.id, e.parent_id, r.depth + 1, list_append(r.path, e.parent_id)
    FROM r JOIN e ON e.project_id = r.project_id AND e.id = r.ancestor_id WHERE NOT list_contains(r.path, e.parent_id)),
c AS (SELECT project_id, id, ancestor_id, depth,
    NOT EXISTS (SELECT 1 FROM e WHERE e.project_id = r.project_id AND e.id = r.ancestor_id) AS root FROM r)"""


@query("asset_import_closure", f"{_CLOSURE} SELECT project_id, id, ancestor_id, depth, root FROM c")
def asset_import_closure(spark, sf):
    return provenance.asset_import_closure(PROVENANCE.frame(spark, sf))


@query("asset_import_roots", f"{_CLOSURE} SELECT project_id, id, ancestor_id AS root_id, depth FROM c WHERE root")
def asset_import_roots(spark, sf):
    return provenance.import_roots(provenance.asset_import_closure(PROVENANCE.frame(spark, sf)))


@query("project_severity_counts", f"""
SELECT project_id, severity, count(*) AS n, {RANK} AS severity_rank FROM {FI}
WHERE severity IN ('critical', 'high', 'medium', 'low', 'info') GROUP BY project_id, severity""")
def project_severity_counts(spark, sf):
    return rollups.severity_counts(FINDINGS.frame(spark, sf))


@query("report_counts", f"SELECT project_id, severity, count(*) AS n FROM {FI} GROUP BY ALL")
def report_counts(spark, sf):
    return rollups.report_counts(FINDINGS.frame(spark, sf))


_TOTALS = f"""SELECT p.id, p.name, p.target_url, coalesce(a.n, 0) AS n_assets, coalesce(f.n, 0) AS n_findings,
  coalesce(strftime(p.created_at, '%Y-%m-%d'), '') AS created, p.created_at FROM {P} p
LEFT JOIN (SELECT project_id, count(*) AS n FROM {A} GROUP BY 1) a ON a.project_id = p.id
LEFT JOIN (SELECT project_id, count(*) AS n FROM {FI} GROUP BY 1) f ON f.project_id = p.id"""


@query("project_list", f"""
SELECT id, name, target_url, n_assets, n_findings, created, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id) AS place FROM ({_TOTALS})""")
def project_list(spark, sf):
    return with_places(rollups.project_list(*tables(spark, sf)))


@query("report_totals", f"SELECT id, n_assets, n_findings FROM ({_TOTALS})")
def report_totals(spark, sf):
    return rollups.report_totals(*tables(spark, sf)).select("id", "n_assets", "n_findings")


@query("projects_newest_first", f"""
SELECT id, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id) AS place FROM {P}""")
def projects_newest_first(spark, sf):
    return with_places(listing.newest_first(PROJECTS.frame(spark, sf)).select("id"))


@query("findings_page", f"SELECT id, severity, value FROM {FI} ORDER BY {RANK}, id LIMIT 100")
def findings_page(spark, sf):
    return listing.findings_page(FINDINGS.frame(spark, sf)).select("id", "severity", "value")


@query("findings_page_compat", f"SELECT id, severity, value FROM {FI} ORDER BY severity, id LIMIT 5000")
def findings_page_compat(spark, sf):
    return listing.findings_page(FINDINGS.frame(spark, sf), 5000, compat=True).select("id", "severity", "value")


@query("report_order", f"""
SELECT id, severity, category, row_number() OVER (ORDER BY {RANK}, category, id) AS place FROM {FI}""")
def report_order(spark, sf):
    return with_places(listing.report_order(FINDINGS.frame(spark, sf)).select("id", "severity", "category"))


@query("listing_columns", f"""
SELECT f.id, severity, finding_type, category, CASE WHEN length(value) > 50 THEN substr(value, 1, 50) || '...' ELSE value END AS value,
  CASE WHEN a.url IS NULL THEN '' ELSE regexp_extract(a.url, '//([^/?#]*)', 1) || '...' || right(regexp_extract(a.url, '//[^/?#]*([^?#]*)', 1), 37) END AS asset
FROM {FI} f LEFT JOIN {A} a ON f.asset_id = a.id""")
def listing_columns(spark, sf):
    _, assets, findings = tables(spark, sf)
    return listing.listing_columns(store.with_asset_url(findings, assets))


@query("all_findings", f"""
SELECT id, project_id, severity FROM {FI} UNION ALL SELECT id, project_id, 'info' FROM {A}""")
def all_findings(spark, sf):
    """Findings of two origins, here with one row per asset as the second."""
    _, assets, findings = tables(spark, sf)
    return store.all_findings(
        findings.select("id", "project_id", "severity"), assets.select("id", "project_id", F.lit("info").alias("severity")))


_EXPORT = f"""SELECT f.id, finding_type AS type, category, value, severity, confidence, coalesce(a.url, '') AS asset
FROM {FI} f LEFT JOIN {A} a ON f.asset_id = a.id"""


@query("findings_json", _EXPORT)
def findings_json(spark, sf):
    """Export as JSON, then read the files back."""
    _, assets, findings = tables(spark, sf)
    export = sinks.findings_export(store.with_asset_url(findings, assets))
    path = shared_folder(spark, "findings-json")
    sinks.write_findings_json(export, path)
    return spark.read.schema(export.schema).json(path)


@query("report_dataset", f"""
SELECT a.project_id, count(*) AS n_assets, min(strftime(discovered_at, '%Y-%m-%d %H:%M:%S')) AS first_asset,
  count(*) FILTER (is_chunk) AS n_chunks, any_value(n_findings) AS n_findings FROM {A} a
JOIN (SELECT project_id, count(*) AS n_findings FROM {FI} GROUP BY 1) f ON f.project_id = a.project_id GROUP BY a.project_id""")
def report_dataset(spark, sf):
    """Write the report data sets, then read them back."""
    projects, assets, findings = tables(spark, sf)
    path = shared_folder(spark, "report")
    sinks.write_report(projects, assets, store.with_asset_url(findings, assets), path)
    written = spark.read.schema(sinks.report_assets(assets).schema).json(f"{path}/assets")
    counts = spark.read.schema("project_id bigint, id bigint").json(f"{path}/findings").groupBy("project_id").agg(
        F.count("*").alias("n_findings"))
    return written.groupBy("project_id").agg(
        F.count("*").alias("n_assets"), F.min("discovered_at").alias("first_asset"),
        F.count_if("is_chunk").alias("n_chunks")).join(counts, "project_id")
