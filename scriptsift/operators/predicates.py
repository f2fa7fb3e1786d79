"""Filters over responses, assets and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import rank_of, severity_rank
from ..functions.text import is_blank
from ..functions.urls import url_path

# MIME types a live capture accepts as scripts.
SCRIPT_TYPES = (
    "application/javascript",
    "text/javascript",
    "application/x-javascript",
    "application/ecmascript",
    "text/ecmascript",
)


def min_severity(findings: DataFrame, level: str) -> DataFrame:
    return findings.filter(severity_rank(F.col("severity")) <= rank_of(level))


def select_categories(findings: DataFrame, enabled=(), disabled=()) -> DataFrame:
    """Category allow list, then deny list; an empty list filters nothing."""
    if enabled:
        findings = findings.filter(F.col("category").isin(*enabled))
    if disabled:
        findings = findings.filter(~F.col("category").isin(*disabled))
    return findings


def filter_findings(findings: DataFrame, finding_type=None, severity=None, category=None) -> DataFrame:
    for column, wanted in (("finding_type", finding_type), ("severity", severity), ("category", category)):
        if wanted:
            findings = findings.filter(F.col(column) == wanted)
    return findings


def classify_response(content_type: Column, final_url: Column) -> Column:
    """Struct of three flags; a response may carry several."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    script_url = F.rtrim(final_url, F.lit("?")).endswith(".js")
    return F.struct(
        (kind.contains("javascript") | kind.contains("ecmascript") | script_url).alias("is_javascript"),
        kind.contains("html").alias("is_html"),
        final_url.endswith(".map").alias("is_sourcemap"),
    )


def classify_stream_response(content_type: Column, url: Column) -> Column:
    """``javascript``, ``html`` or null; the URL decides only without a known type."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    is_script = F.lit(False)
    for mime in SCRIPT_TYPES:
        is_script = is_script | kind.contains(mime)
    return (
        F.when(is_script, "javascript")
        .when(kind.contains("text/html"), "html")
        .when(F.lower(url_path(url)).endswith(".js"), "javascript")
    )


def is_ok() -> Column:
    return F.col("error").isNull() & F.col("status_code").between(200, 399)


def ok_responses(responses: DataFrame) -> DataFrame:
    return responses.filter(is_ok())


def failed_responses(responses: DataFrame) -> DataFrame:
    reason = F.coalesce(F.nullif(F.col("error"), F.lit("")), F.col("status_code").cast("string"))
    return responses.filter(~F.coalesce(is_ok(), F.lit(False))).select("url", reason.alias("reason"))


def non_blank(texts: DataFrame, content: str = "content") -> DataFrame:
    return texts.filter(~is_blank(F.col(content)))


def unanalyzed_assets(assets: DataFrame, scanned_hashes: DataFrame) -> DataFrame:
    """Assets whose text no earlier scan has covered."""
    return assets.join(scanned_hashes.select("content_hash").distinct(), "content_hash", "left_anti")
