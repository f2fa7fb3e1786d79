"""Severity ranks: critical first, anything unknown counts as info."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
UNKNOWN_RANK = 4


def rank_of(severity: str) -> int:
    return SEVERITY_RANK.get(severity, UNKNOWN_RANK)


def severity_rank(severity: Column) -> Column:
    rank = F.lit(UNKNOWN_RANK)
    for name, r in reversed(SEVERITY_RANK.items()):
        rank = F.when(severity == name, r).otherwise(rank)
    return rank
