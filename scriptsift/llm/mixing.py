"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, as often round as
its target asks.  A document's virtual finish time is the number of words its
queue has given out once it is through, divided by the queue's target; sorted by
finish time, all queues advance at the pace of their targets.  The order ends
where the budget of words ends, which is time 1 for every queue, as the targets
add up to the budget.  A document still in service at that moment is taken up to
there, so a source gives its target to the word, however long its documents are.

The driver sees totals of one row.  Running sums follow a sort by range, so a
source with a third of all rows is spread over many tasks, and the table of
sources is numbered and summed in the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_ROUNDS = 3
SEED = "mix-1"


def _summed(names: list[str]):
    """Running totals before each row of a task, batch after batch."""
    def add(batches):
        carried = dict.fromkeys(names, 0)
        part = TaskContext.get().partitionId()
        for batch in batches:
            columns = [*batch.columns]
            for name in names:
                values = batch.column(f"__v_{name}").to_numpy(zero_copy_only=False)
                upto = np.cumsum(values) + carried[name]
                columns.append(pa.array(upto - values, pa.int64()))
                carried[name] = int(upto[-1]) if len(upto) else carried[name]
            columns.append(pa.array(np.full(batch.num_rows, part, np.int64)))
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *(f"__b_{n}" for n in names), "__part"])
    return add


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], purpose: str) -> DataFrame:
    """Add, under each name in ``sums``, the total over all rows before a row in the given order.

    Rows are dealt out by range and summed inside their task; the totals of the
    tasks before come from a table with one row per task, whose number bounds what
    is broadcast.  Nulls add nothing; rows alike in the order stand in any order.
    """
    nothing = F.lit(0).cast("long")
    parts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    valued = rows.select("*", *[F.coalesce(v.cast("long"), nothing).alias(f"__v_{k}") for k, v in sums.items()])
    schema = valued.schema
    for k in sums:
        schema = schema.add(f"__b_{k}", "long")
    dealt = stage(
        valued.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .mapInArrow(_summed(list(sums)), schema.add("__part", "long")), purpose)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = dealt.groupBy("__part").agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums])
    offsets = tasks.select("__part", *[F.coalesce(F.sum(f"__t_{k}").over(before), nothing).alias(f"__o_{k}") for k in sums])
    return dealt.join(F.broadcast(offsets), "__part").select(
        *rows.columns, *[(F.col(f"__b_{k}") + F.col(f"__o_{k}")).alias(k) for k in sums])


def targets(sizes: DataFrame, budget: int | None = None, weights=WEIGHTS, most: int = MOST_ROUNDS) -> DataFrame:
    """What each source is to give: source, source_no, source_size, target, quota, rounds.

    ``sizes`` has a row (source, size) per document.  Sources by code point, null
    last, take the weights in turn and share the budget (by default all sizes) by
    them, none more than ``most`` times its own size; what that leaves is shared by
    weight among the others.  Ordered by ceiling over weight the capped sources
    come first, and running sums find where the sharing levels out.  ``quota`` is
    the target in whole words, rounded so that the quotas add up as the targets do.
    A source without words has target 0; an empty table gives no rows.
    """
    turns = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = running(sources, [F.col("source").isNull().asc(), F.col("source").asc()], {"source_no": F.lit(1)}, "mix-sources")
    capped = numbered.select(
        "*", F.element_at(turns, (F.col("source_no") % len(weights) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * most).alias("ceiling"))
    ratio = F.col("ceiling") / F.col("weight")
    laid = stage(running(
        capped, [ratio.asc(), F.col("source_no").asc()], {"capped_before": F.col("ceiling"), "weight_before": F.col("weight")},
        "mix-level"), "mix-laid")
    totals = laid.agg(F.sum("weight").alias("weight"), F.sum("source_size").alias("size")).first()
    words = totals["size"] if budget is None else budget
    level = (F.lit(words) - F.col("capped_before")) / (F.lit(totals["weight"]) - F.col("weight_before"))
    first = laid.filter(level <= ratio).agg(F.min(F.struct("weight_before", "capped_before")).alias("x")).first()["x"]
    ceiling = F.col("ceiling")
    if first is None:  # every source is capped, or there is none
        target, quota = ceiling.cast("double"), ceiling
    else:
        left, share = words - first["capped_before"], totals["weight"] - first["weight_before"]
        shares = F.col("weight_before") >= first["weight_before"]
        target = F.when(shares, F.col("weight") * F.lit(left) / F.lit(share)).otherwise(ceiling.cast("double"))
        # The whole words up to the end of a source, laid end to end, less those up to its start.
        def upto(x):
            return F.expr(f"cast(({x} - {first['weight_before']}) as decimal(19,0)) * cast({left} as decimal(19,0)) div {share}")
        quota = F.when(shares, upto("weight_before + weight") - upto("weight_before")).otherwise(ceiling)
    return stage(
        laid.select("source", "source_no", "source_size", target.alias("target"), quota.cast("long").alias("quota"))
        .withColumn("rounds", F.when(F.col("source_size") > 0, F.greatest(F.lit(1), F.expr("cast((quota + source_size - 1) div source_size as int)"))).otherwise(0)),
        "mix-targets")


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A stored row per document: rid, doc_id, source, size in words.  The texts are read once, here."""
    count = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return stage(docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        count.alias("size")), "mix-sizes")


def schedule(rows: DataFrame, shares: DataFrame, seed: str = SEED) -> DataFrame:
    """The queues: a row per document and round, with the words it gives (``taken``) and its finish time.

    Every round of a source has its own shuffle, by a keyed hash.  Documents
    without words are in no queue.
    """
    shares = shares.filter("rounds > 0")
    # Rounds of the sources before, in words: where a source begins in the order of all queues.
    begins = running(shares, [F.col("source_no").asc()], {"begins": F.col("source_size") * F.col("rounds")}, "mix-begins")
    queued = (
        rows.filter("size > 0").alias("d").join(begins.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        .select("rid", "doc_id", "d.source", "size", "source_no", "quota", "begins", F.explode(F.sequence(F.lit(1), "rounds")).alias("round")))
    key = F.md5(F.concat_ws(":", F.lit(seed), "round", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size"))
    order = [F.col(c) for c in ("source_no", "round", "key")] + [F.col("doc_id").asc_nulls_first(), F.col("size")]
    laid = running(queued.withColumn("key", key), order, {"all_before": F.col("size")}, "mix-queues")
    before = F.col("all_before") - F.col("begins")
    taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("quota") - before))
    return (
        laid.withColumn("before", before).withColumn("taken", taken)
        .select("rid", "doc_id", "source", "source_no", "size", "round", "before", "taken",
                F.when(F.col("taken") > 0, (F.col("before") + F.col("taken")) / F.col("quota")).alias("finish")))


def in_order(queues: DataFrame, budget: int | None = None) -> DataFrame:
    """The mix: all documents by finish time, each with its position and the words before it, up to the budget."""
    order = [F.col("finish").asc(), F.col("source_no").asc(), F.col("before").asc()]
    given = queues.filter("taken > 0")
    mixed = running(given, order, {"position": F.lit(1), "offset": F.col("taken")}, "mix-order")
    if budget is not None:
        mixed = mixed.filter(F.col("offset") < budget).withColumn("taken", F.least("taken", F.lit(budget) - F.col("offset")))
    return mixed


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", budget: int | None = None,
        weights=WEIGHTS, most: int = MOST_ROUNDS, seed: str = SEED) -> DataFrame:
    """The mixed order of ``docs``: position, offset, doc_id, source, round, size, taken, finish.

    A document may stand there up to ``most`` times, once a round; ``taken`` is
    less than ``size`` only for the last document of a source.  Null and blank
    texts have no words and do not occur; a null source is a source; null ids and
    repeated rows are documents of their own; documents alike in id and size have
    no order among each other.  Other columns are ignored; an empty table gives no
    rows.
    """
    rows = sized(docs, doc_id, text, source)
    shares = targets(rows, budget, weights, most)
    total = shares.agg(F.sum("quota")).first()[0] or 0
    return in_order(schedule(rows, shares, seed), total).select(
        "position", "offset", "doc_id", "source", "round", "size", "taken", "finish")


def taken_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", budget: int | None = None,
                weights=WEIGHTS, most: int = MOST_ROUNDS, seed: str = SEED) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, and ``taken``, its words in the mix over all rounds.

    Documents without words stay with 0.
    """
    rows = sized(docs, doc_id, text, source)
    shares = targets(rows, budget, weights, most)
    total = shares.agg(F.sum("quota")).first()[0] or 0
    given = in_order(schedule(rows, shares, seed), total).select("rid", "taken").unionByName(
        rows.select("rid", F.lit(0).cast("long").alias("taken")))
    sums = given.groupBy("rid").agg(F.sum("taken").alias("taken"))
    return (
        rows.join(sums, "rid").alias("d").join(shares.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        .select("doc_id", "size", "source_size", "target", "taken"))
