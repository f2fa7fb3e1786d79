"""Which assets led to an asset, over any number of steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder, staged
from .store import asset_import_graph

KEY = ("project_id", "id")


def import_closure(edges: DataFrame, folder: str | None = None, max_depth: int | None = None) -> DataFrame:
    """All ancestors of every asset: project_id, id, ancestor_id, depth, root.

    ``edges`` has project_id, id, parent_id.  Paths are doubled instead of walked:
    a round joins the paths of exactly ``step`` steps with all shorter ones, so a
    chain of a million assets takes twenty rounds.  Every pair keeps its least
    depth and is found in one round only; a round that finds no new pair is the
    last, which also ends cycles (an asset on a cycle is its own ancestor, at the
    length of the cycle).  ``root`` says that nothing led to the ancestor.

    The pairs known are rows of a few numbers.  A popular parent is the key of many
    paths on one side only; adaptive execution splits it.  Null ids and parents
    lead nowhere; repeated edges count once.
    """
    spark = edges.sparkSession
    folder = folder or shared_folder(spark, "import-closure")
    steps = edges.select("project_id", "id", "parent_id").dropna().distinct()
    steps = staged(steps, f"{folder}/edges")
    known = steps.withColumnRenamed("parent_id", "ancestor_id").withColumn("depth", F.lit(1))
    rounds, step = [staged(known, f"{folder}/round-0")], 1
    while max_depth is None or step < max_depth:
        known = _together(rounds)
        longest = known.filter(F.col("depth") == step).select("project_id", "id", F.col("ancestor_id").alias("via"))
        onward = known.select("project_id", F.col("id").alias("via"), "ancestor_id", "depth")
        found = (
            longest.join(onward, ["project_id", "via"])
            .groupBy("project_id", "id", "ancestor_id").agg((F.min("depth") + step).alias("depth"))
            .join(known.select("project_id", "id", "ancestor_id"), ["project_id", "id", "ancestor_id"], "left_anti"))
        if max_depth is not None:
            found = found.filter(F.col("depth") <= max_depth)
        found = staged(found, f"{folder}/round-{len(rounds)}")
        if found.isEmpty():
            break
        rounds.append(found)
        step *= 2
    led = steps.select("project_id", F.col("id").alias("ancestor_id"), F.lit(True).alias("led")).distinct()
    return _together(rounds).join(led, ["project_id", "ancestor_id"], "left").select(
        "project_id", "id", "ancestor_id", "depth", F.col("led").isNull().alias("root"))


def _together(rounds: list[DataFrame]) -> DataFrame:
    out = rounds[0]
    for rows in rounds[1:]:
        out = out.unionByName(rows)
    return out


def asset_import_closure(assets: DataFrame, folder: str | None = None, max_depth: int | None = None) -> DataFrame:
    """Full provenance of stored assets: every asset with all assets that led to it."""
    return import_closure(asset_import_graph(assets), folder, max_depth)


def import_roots(closure: DataFrame) -> DataFrame:
    """Where each asset's chain begins: project_id, id, root_id, depth.

    With several beginnings the farthest counts, then the least id; assets whose
    ancestors all lie on a cycle have none.
    """
    best = F.max(F.struct("depth", (-F.col("ancestor_id")).alias("least"))).alias("best")
    return closure.filter("root").groupBy(*KEY).agg(best).select(
        *KEY, (-F.col("best.least")).alias("root_id"), F.col("best.depth").alias("depth"))
