"""The newest row per key of a stream, as runs merged in powers of a fan-in.

Every micro-batch leaves one run: its rows, one per key, sorted by key.  Four runs
of a level become one run of the next, which holds one row per key again.  So a
reader meets one large run and at most three of each smaller size, however long
the stream has run, and a row is rewritten once per level.

A run is named by its level and number, both of which follow from the batch id
alone, and counts once its write has been committed; until then the runs it
replaces are read.  A repeated batch writes the same runs again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import committed_folders, remove_folder

FAN_IN = 4


def _run(root: str, level: int, number: int) -> str:
    return f"{root}/level={level}/run={number}"


def newest(rows: DataFrame, keys, order) -> DataFrame:
    """The row with the greatest ``order`` per key; nulls in it count as least."""
    keys, order = list(keys), list(order)
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("best")
    return rows.groupBy(*keys).agg(best).select(
        *[(F.col(c) if c in keys else F.col("best")[c].alias(c)) for c in rows.columns])


def _write(rows: DataFrame, path: str, keys) -> None:
    """Sorted by key inside each file, so that a look-up opens few row groups."""
    rows.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def runs(spark: SparkSession, root: str) -> list[tuple[int, int]]:
    """(level, number) of the runs that make up the newest state, largest first."""
    found = []
    for folder in committed_folders(spark, f"{root}/level=*/run=*"):
        level, number = (int(part.rpartition("=")[2]) for part in folder.rstrip("/").split("/")[-2:])
        found.append((level, number))
    chosen, covered = [], []
    for level, number in sorted(found, key=lambda r: (-r[0], r[1])):
        first, end = number * FAN_IN**level, (number + 1) * FAN_IN**level
        if not any(a <= first and end <= b for a, b in covered):
            chosen.append((level, number))
            covered.append((first, end))
    return chosen


def add(rows: DataFrame, root: str, batch_id: int, keys, order) -> None:
    """Store the rows of a batch and merge the runs it completes."""
    spark = rows.sparkSession
    _write(newest(rows, keys, order), _run(root, 0, batch_id), keys)
    level, number = 0, batch_id
    while (number + 1) % FAN_IN == 0:
        wanted = {(level, k) for k in range(number - FAN_IN + 1, number + 1)}
        below = [f for f in committed_folders(spark, f"{root}/level={level}/run=*") if (level, int(f.rstrip("/").rpartition("=")[2])) in wanted]
        merged = newest(spark.read.schema(rows.schema).parquet(*below), keys, order)
        level, number = level + 1, number // FAN_IN
        _write(merged, _run(root, level, number), keys)


def read(spark: SparkSession, root: str, schema, keys, order) -> DataFrame:
    """One row per key, from the runs that make up the newest state; none before the first batch."""
    chosen = [_run(root, *r) for r in runs(spark, root)]
    if not chosen:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*chosen)
    return rows if len(chosen) == 1 else newest(rows, keys, order)


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete runs that a larger one has replaced, once nobody reads them any more."""
    needed = set(runs(spark, root))
    gone = 0
    for folder in committed_folders(spark, f"{root}/level=*/run=*"):
        level, number = (int(part.rpartition("=")[2]) for part in folder.rstrip("/").split("/")[-2:])
        if (level, number) not in needed:
            remove_folder(spark, folder)
            gone += 1
    return gone
