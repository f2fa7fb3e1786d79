"""Counts over findings, assets and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.severity import severity_rank
from .detectors import SEVERITIES


def asset_summary(unique: DataFrame, assets: DataFrame | None = None, keys=("asset_key",)) -> DataFrame:
    """Total and per-severity counts of unique findings, zeros kept."""
    keys = list(keys)
    counts = unique.groupBy(*keys).agg(
        F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    if assets is None:
        return counts
    return assets.select(*keys).join(counts, keys, "left").na.fill(0, ["total", *SEVERITIES])


def severity_counts(findings: DataFrame, keys=("project_id",)) -> DataFrame:
    """Non-zero counts of the five severities."""
    known = findings.filter(F.col("severity").isin(*SEVERITIES))
    return known.groupBy(*keys, "severity").agg(F.count("*").alias("n")).withColumn(
        "severity_rank", severity_rank(F.col("severity")))


def report_counts(findings: DataFrame, keys=("project_id",)) -> DataFrame:
    """Counts per severity; an unknown severity keeps a bucket of its own, a
    missing one counts as info."""
    label = F.coalesce(F.col("severity"), F.lit("info"))
    return findings.groupBy(*keys, label.alias("severity")).agg(F.count("*").alias("n"))


def report_totals(projects: DataFrame, assets: DataFrame, findings: DataFrame) -> DataFrame:
    """Assets and findings per project.  Each side is counted before the join,
    so neither multiplies the other."""
    def per_project(rows, name):
        return rows.groupBy("project_id").agg(F.count("*").alias(name)).withColumnRenamed("project_id", "id")

    return (
        projects.join(per_project(assets, "n_assets"), "id", "left")
        .join(per_project(findings, "n_findings"), "id", "left")
        .na.fill(0, ["n_assets", "n_findings"])
    )


def project_list(projects: DataFrame, assets: DataFrame, findings: DataFrame) -> DataFrame:
    """Listing of projects, newest first."""
    day = F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.lit(""))
    return report_totals(projects, assets, findings).orderBy(F.desc("created_at"), "id").select(
        "id", "name", "target_url", "n_assets", "n_findings", day.alias("created"))


def discovery_counts(script_urls: DataFrame, inline: DataFrame, keys=("page_id",)) -> DataFrame:
    """Script URLs and inline scripts per page."""
    keys = list(keys)
    urls = script_urls.groupBy(*keys).agg(F.count("*").alias("n_script_urls"))
    texts = inline.groupBy(*keys).agg(F.count("*").alias("n_inline"))
    return urls.join(texts, keys, "full").na.fill(0, ["n_script_urls", "n_inline"])


def sources_per_map(source_files: DataFrame, keys=("asset_key",)) -> DataFrame:
    return source_files.groupBy(*keys).agg(F.count("*").alias("n_sources"))
