"""Ordered listings and display columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.severity import severity_rank
from ..functions.text import preview
from ..functions.urls import short_url


def ranked(findings: DataFrame, tie_break=("p_ord", "m_ord")) -> DataFrame:
    """Most severe first, otherwise in discovery order."""
    return findings.orderBy(severity_rank(F.col("severity")), *tie_break)


def findings_page(findings: DataFrame, limit: int = 100, compat: bool = False, tie_break=("id",)) -> DataFrame:
    """The top page of a listing.

    ``compat`` picks the rows in alphabetical severity order and only then ranks
    them, which cuts ``medium`` before ``info``.
    """
    first = F.col("severity") if compat else severity_rank(F.col("severity"))
    return ranked(findings.orderBy(first, *tie_break).limit(limit), tie_break)


def report_order(findings: DataFrame, tie_break=("id",)) -> DataFrame:
    rank = severity_rank(F.coalesce(F.col("severity"), F.lit("info")))
    return findings.orderBy(rank, F.coalesce(F.col("category"), F.lit("")), *tie_break)


def newest_first(projects: DataFrame) -> DataFrame:
    return projects.orderBy(F.desc("created_at"), "id")


def listing_columns(findings: DataFrame, width: int = 50) -> DataFrame:
    return findings.select(
        "id", "severity", "finding_type", "category",
        preview(F.col("value"), width).alias("value"), short_url(F.col("asset_url")).alias("asset"))
