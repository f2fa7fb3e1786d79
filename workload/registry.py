"""Queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


def spread(rows: DataFrame) -> DataFrame:
    """Give every core a share when the input has fewer splits than cores.

    Large inputs arrive in many splits and pass through without a shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


# Keys that one task turns into texts.
KEYS_PER_TASK = 20_000


def dealt(keys: DataFrame, per_task: int = KEYS_PER_TASK) -> DataFrame:
    """Deal narrow rows, which texts many times their size are made of, into tasks by number.

    The size of a file tells neither the work that its rows cause nor how many of
    its splits hold a row group; only keys are shuffled.
    """
    least = keys.sparkSession.sparkContext.defaultParallelism
    return keys.repartition(max(least, -(-keys.count() // per_task)))
