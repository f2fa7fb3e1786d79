"""Joins and first-wins rules over the stored tables.

First-wins is always an aggregate with ``min(struct(order, …))`` instead of a
ranked window: it combines before the shuffle, so one asset, URL or value that
owns a large share of the rows never lands in a single task.  No join is hinted;
adaptive execution broadcasts a side once its measured size allows and splits
skewed partitions otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CAPS, cap, content_hash
from .predicates import ok_responses


def first_per(rows: DataFrame, keys, order) -> DataFrame:
    """The row with the least ``order`` per key."""
    keys, order = list(keys), list(order)
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = F.min(F.struct(*order, *rest)).alias("best")
    return rows.groupBy(*keys).agg(best).select(
        *[(F.col(c) if c in keys else F.col("best")[c].alias(c)) for c in rows.columns])


def capped_findings(findings: DataFrame) -> DataFrame:
    return findings.withColumns({"value": cap(F.col("value"), "value"), "context": cap(F.col("context"), "context")})


def persistable_findings(findings: DataFrame, asset=("asset_key",), compat: bool = False) -> DataFrame:
    """One finding per (asset, type, category, value), whole values compared.

    ``compat`` cuts values and contexts to their stored lengths first and leaves
    the category out of the key, so a value reported under two categories of one
    type keeps only the earlier one.
    """
    key = [*asset, "finding_type", *([] if compat else ["category"]), "value"]
    return first_per(capped_findings(findings) if compat else findings, key, ["p_ord", "m_ord"])


def new_findings(
    found: DataFrame, stored: DataFrame, asset=("project_id", "asset_id"), compat: bool = False
) -> DataFrame:
    """Findings not stored yet; ``compat`` compares and returns the cut values."""
    key = [*asset, "finding_type", *([] if compat else ["category"]), "value"]
    if compat:
        found, stored = capped_findings(found), stored.withColumn("value", F.substring("value", 1, CAPS["value"]))
    return found.join(stored.select(*key), key, "left_anti")


def with_asset_url(findings: DataFrame, assets: DataFrame) -> DataFrame:
    """Findings with their asset's URL, '' when the asset is gone."""
    urls = assets.select(F.col("id").alias("asset_id"), F.col("url").alias("asset_url"))
    return findings.join(urls, "asset_id", "left").withColumn("asset_url", F.coalesce("asset_url", F.lit("")))


def of_project(rows: DataFrame, projects: DataFrame, name: str) -> DataFrame:
    """Assets or findings of one project; empty when there is no such project."""
    ids = projects.filter(F.col("name") == name).select(F.col("id").alias("project_id"))
    return rows.join(ids, "project_id", "left_semi")


def delete_projects(projects: DataFrame, assets: DataFrame, findings: DataFrame, names: DataFrame):
    """What remains of the three tables after deleting the named projects."""
    gone = projects.join(names.select("name"), "name", "left_semi").select(F.col("id").alias("project_id"))
    return (
        projects.join(gone, projects["id"] == gone["project_id"], "left_anti"),
        assets.join(gone, "project_id", "left_anti"),
        findings.join(gone, "project_id", "left_anti"),
    )


STORED = ("projects", "assets", "findings")


def rewrite_without(spark: SparkSession, source: str, target: str, names: DataFrame) -> None:
    """Write the stored tables below ``source`` to ``target`` without the named projects.

    The old tables stay as they are until the caller drops them, so a failed run
    loses nothing.
    """
    tables = [spark.read.parquet(f"{source}/{name}") for name in STORED]
    for name, rows in zip(STORED, delete_projects(*tables, names)):
        rows.write.mode("overwrite").parquet(f"{target}/{name}")


def unknown_urls(discovered: DataFrame, assets: DataFrame, key=("project_id", "url")) -> DataFrame:
    """Discovered URLs the project does not hold yet."""
    key = list(key)
    return discovered.dropDuplicates(key).join(assets.select(*key), key, "left_anti")


def _place(columns) -> Column:
    """A number that orders responses by time, then id; fixed width, so minima hash."""
    last = F.col("response_id") if "response_id" in columns else F.abs(F.xxhash64("content") % (1 << 62))
    return (F.unix_micros("captured_at") * F.expr("10000000000000000000BD") + last).cast("decimal(38,0)")


def first_captures(responses: DataFrame) -> DataFrame:
    """(url, place) of the earliest successful response per URL, without texts."""
    ok = ok_responses(responses)
    return ok.groupBy("url").agg(F.min(_place(ok.columns)).alias("place"))


def captured_bodies(responses: DataFrame, firsts: DataFrame | None = None) -> DataFrame:
    """(url, body) of successful responses, the earliest capture per URL.

    The winners are found on numbers and then joined to the texts, so no text
    enters an aggregate.  ``firsts`` is a stored result of ``first_captures``.
    Without a ``response_id``, responses of one URL and time are told apart by
    their content.
    """
    ok = ok_responses(responses)
    bodies = ok.select("url", _place(ok.columns).alias("place"), F.col("content").alias("body"))
    found = bodies.join(first_captures(responses) if firsts is None else firsts, ["url", "place"]).select("url", "body")
    return found if "response_id" in responses.columns else found.distinct()


def wanted_bodies(bodies: DataFrame, refs: DataFrame, url: str) -> DataFrame:
    """The bodies some reference asks for.

    When the references are small enough to broadcast, responses nobody refers
    to are dropped at the scan.
    """
    return bodies.join(refs.select(F.col(url).alias("url")).distinct(), "url", "left_semi")


def captured_urls(responses: DataFrame) -> DataFrame:
    """The inventory that stands in for probing: URLs known to answer."""
    return ok_responses(responses).select("url").distinct()


def with_body(refs: DataFrame, bodies: DataFrame, url: str, how: str = "inner") -> DataFrame:
    """Attach captured bodies to references; by default unmatched ones drop out."""
    found = wanted_bodies(bodies, refs, url).withColumnRenamed("url", url)
    return refs.join(found, url, how)


def first_captured(candidates: DataFrame, inventory: DataFrame, keys, order="ord", url="url") -> DataFrame:
    """Per key, the first candidate URL the inventory holds."""
    hits = candidates.join(inventory.select(F.col("url").alias(url)), url, "left_semi")
    return first_per(hits.select(*candidates.columns), keys, [order])


def asset_import_graph(assets: DataFrame) -> DataFrame:
    """Chunk provenance: each asset with the asset that led to it."""
    parent = assets.select(
        "project_id", F.col("url").alias("parent_url"),
        F.col("id").alias("parent_id"), F.col("asset_type").alias("parent_type"))
    return assets.filter(F.col("parent_url").isNotNull()).join(parent, ["project_id", "parent_url"]).select(
        "project_id", "id", "url", "chunk_id", "parent_id", "parent_url", "parent_type")


def first_responses(responses: DataFrame, order=("captured_at", "response_id")) -> DataFrame:
    """One response per distinct body, the earliest.

    The winner of each hash is found without its text; ``order`` tells all
    responses of one body apart.
    """
    hashed = responses.withColumn("content_hash", content_hash(F.col("content")))
    order = list(order)
    firsts = hashed.groupBy("content_hash").agg(F.min(F.struct(*order)).alias("first")).select("content_hash", "first.*")
    return hashed.join(firsts, ["content_hash", *order]).select(*hashed.columns)


def all_findings(*parts: DataFrame) -> DataFrame:
    """Findings of external and inline assets together."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
