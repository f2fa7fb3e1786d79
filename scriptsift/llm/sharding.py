"""Sharding: minimax contiguous partition of ordered atomic groups.

Rows with equal texts form a group that is never split.  Groups are ordered by
a hash of their text and laid end to end; shards are contiguous stretches.  The
smallest capacity for which greedy filling needs no more than the given number
of shards is found by binary search, and the greedy cuts at that capacity are
the result, so the largest shard is as small as contiguous shards allow.

Nothing whole passes through the driver.  Ends of groups stay in a table sorted
into buckets; the driver holds the ends of the buckets.  One step of the greedy
fill, for many capacities at once, reads only the buckets in which their cuts
fall, and every round narrows the capacity by the number tried.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import stage

SHARDS = 16
BUCKETS = 1024
# Capacities tried at once.
TRIES = 32


class _Ends:
    """Ends of groups, laid end to end, looked up without holding them."""

    def __init__(self, groups: DataFrame, last: dict):
        self.groups = groups
        self.buckets = sorted(last)
        self.ends = [last[b] for b in self.buckets]

    def before(self, limits: list[int]) -> list[int]:
        """For every limit the last group end that does not exceed it (0: none)."""
        out, open_ = {}, {}
        for limit in set(limits):
            at = bisect_left(self.ends, limit + 1)
            if at == len(self.ends):
                out[limit] = self.ends[-1] if self.ends else 0
            else:
                # Ends in the next bucket may still fit.
                out[limit] = self.ends[at - 1] if at else 0
                open_.setdefault(self.buckets[at], []).append(limit)
        if open_:
            asked = sorted((b, x) for b, xs in open_.items() for x in xs)
            hits = [F.max(F.when((F.col("bucket") == b) & (F.col("end") <= x), F.col("end"))).alias(f"e{i}") for i, (b, x) in enumerate(asked)]
            got = self.groups.filter(F.col("bucket").isin(*open_)).agg(*hits).first()
            for (_, x), end in zip(asked, got):
                out[x] = max(out[x], end or 0)
        return [out[limit] for limit in limits]


def _greedy(ends: _Ends, capacities: list[int], shards: int) -> list[list[int]]:
    """Cuts of the greedy fill for every capacity."""
    cuts = [[] for _ in capacities]
    at = [0] * len(capacities)
    for _ in range(shards):
        at = ends.before([a + c for a, c in zip(at, capacities)])
        for cut, end in zip(cuts, at):
            cut.append(end)
    return cuts


def smallest_capacity(ends: _Ends, total: int, largest: int, shards: int, tries: int = TRIES):
    """(capacity, cuts): the smallest capacity whose greedy fill reaches the end."""
    low, high = max(largest, -(-total // shards)), max(largest, -(-total // shards)) + largest
    cuts = None
    while cuts is None or low < high:
        step = max(1, -(-(high - low) // tries))
        capacities = sorted({*range(low, high, step), high})
        fills = _greedy(ends, capacities, shards)
        fits = [k for k, cut in enumerate(fills) if cut[-1] >= total]
        first = fits[0]
        high, cuts = capacities[first], fills[first]
        low = capacities[first - 1] + 1 if first else high
    return high, cuts


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 length of the text (null: 0) plus 1, so rows without
    text weigh too; null counts as the empty text.  ``slot`` numbers the rows of a
    shard from 0 by group, then id (nulls first), then an arbitrary order of
    rows that are equal in both.  Fewer groups than shards leave the last shards
    empty.  Other columns are ignored; an empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = stage(
        docs.select(
            F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(body).cast("long").alias("text_crc32"), F.sha2(body, 256).alias("text_sha"),
            # Tells rows apart that are equal in all else, so that their range can be split.
            F.monotonically_increasing_id().alias("row")), "shard-rows")
    bucket = F.conv(F.substring("text_sha", 1, 8), 16, 10).cast("long") * BUCKETS / F.lit(1 << 32)
    groups = stage(
        rows.groupBy("text_sha").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
        .withColumn("bucket", F.floor(bucket).cast("int")), "shard-groups")
    totals = {r["bucket"]: r for r in groups.groupBy("bucket").agg(
        F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.max("bytes").alias("most")).collect()}
    last, bytes_before, rows_before = {}, {}, {}
    end = count = 0
    for b in sorted(totals):
        bytes_before[b], rows_before[b] = end, count
        end, count = end + totals[b]["bytes"], count + totals[b]["n"]
        last[b] = end
    spark = docs.sparkSession
    starts = spark.createDataFrame(
        [(b, bytes_before[b], rows_before[b]) for b in sorted(totals)], "bucket int, bytes_before long, rows_before long")
    in_bucket = Window.partitionBy("bucket").orderBy("text_sha").rowsBetween(Window.unboundedPreceding, 0)
    laid = stage(
        groups.join(F.broadcast(starts), "bucket")
        .select("bucket", "text_sha", "n", (F.col("bytes_before") + F.sum("bytes").over(in_bucket)).alias("end"),
                (F.col("rows_before") + F.sum("n").over(in_bucket) - F.col("n")).alias("first")), "shard-laid")
    if totals:
        _, cuts = smallest_capacity(_Ends(laid, last), end, max(r["most"] for r in totals.values()), shards)
    else:
        cuts = [0] * shards
    # A group belongs to the first shard whose cut is not before its end.
    number = sum((F.when(F.col("end") > c, 1).otherwise(0) for c in cuts[:-1]), F.lit(0)).alias("shard")
    placed = stage(laid.select("text_sha", number, "first", "n", "end"), "shard-placed")
    firsts = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("first").alias("first")).collect()}
    base = F.element_at(F.create_map(*[F.lit(x) for s in range(shards) for x in (s, firsts.get(s, 0))]), F.col("shard"))
    of_group = placed.select("text_sha", "shard", (F.col("first") - base).alias("first"))
    return _numbered(rows, of_group).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _numbered(rows: DataFrame, of_group: DataFrame) -> DataFrame:
    """Number the rows of every group from its first slot.

    A group may hold a third of all rows, so its rows are ordered in pieces: by
    a range of ids, counted per piece, then numbered inside each piece.
    """
    spark = rows.sparkSession
    pieces = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = stage(
        rows.repartitionByRange(pieces, "text_sha", F.col("doc_id").asc_nulls_first(), "row")
        .sortWithinPartitions("text_sha", F.col("doc_id").asc_nulls_first(), "row")
        .withColumn("piece", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "shard-dealt")
    held = stage(dealt.groupBy("text_sha", "piece").agg(F.min("at").alias("least"), F.count("*").alias("n")), "shard-held")
    earlier = Window.partitionBy("text_sha").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(
        held.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(of_group, "text_sha").select("text_sha", "piece", "least", "shard", (F.col("first") + F.col("before")).alias("start")),
        "shard-offsets")
    return dealt.join(offsets, ["text_sha", "piece"]).withColumn("slot", F.col("start") + F.col("at") - F.col("least"))
