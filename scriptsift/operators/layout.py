"""Stored tables laid out by project, so that a project can be deleted in place.

Each table is partitioned by a bucket of its project.  Deleting projects rewrites
the buckets that hold them and no other; files of all other buckets stay as they
are.  A bucket's rows that remain are staged before the old files are replaced, and
a deletion that was cut short is finished by running it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import folder_exists, remove_folder, shared_folder, staged
from .store import STORED

BUCKETS = 64


def bucket_of(project_id: Column, buckets: int = BUCKETS) -> Column:
    """The partition of a project; rows without one share the partition -1."""
    return F.coalesce(F.pmod(F.xxhash64(project_id.cast("long")), F.lit(buckets)), F.lit(-1)).cast("int")


def _project(name: str) -> str:
    return "id" if name == "projects" else "project_id"


def write_store(tables: dict[str, DataFrame], root: str, buckets: int = BUCKETS) -> None:
    """Write the tables by bucket.  Rebalancing splits a bucket with a large project into several files."""
    for name, rows in tables.items():
        key = F.col(_project(name))
        bucket = F.when(key.isNull(), F.lit(-1)).otherwise(bucket_of(key, buckets))
        rows.withColumn("bucket", bucket).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/{name}")


def read_store(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}").drop("bucket")


def projects_named(spark: SparkSession, root: str, names: DataFrame) -> DataFrame:
    """Ids of the stored projects with these names."""
    projects = spark.read.parquet(f"{root}/projects")
    return projects.join(names.select("name"), "name", "left_semi").select(F.col("id").alias("project_id")).dropna().distinct()


def delete_in_place(spark: SparkSession, root: str, names: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Delete the named projects with their assets and findings; returns the buckets rewritten.

    Projects go last, so that a run that was cut short still finds their names.
    """
    work = shared_folder(spark, "deletion")
    gone = staged(projects_named(spark, root, names), f"{work}/gone")
    # At most as many numbers as there are buckets.
    touched = sorted(r[0] for r in gone.select(bucket_of(F.col("project_id"), buckets).alias("b")).distinct().collect())
    if not touched:
        return []
    for name in reversed(STORED):
        table = f"{root}/{name}"
        there = [b for b in touched if folder_exists(spark, f"{table}/bucket={b}")]
        if not there:
            continue
        old = spark.read.parquet(table).filter(F.col("bucket").isin(there))
        ids = gone.withColumnRenamed("project_id", _project(name))
        kept = staged(old.join(ids, _project(name), "left_anti").select(*old.columns), f"{work}/{name}")
        left = {r[0] for r in kept.select("bucket").distinct().collect()}
        (
            kept.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket").parquet(table))
        # A bucket without rows is not overwritten but dropped.
        for b in there:
            if b not in left:
                remove_folder(spark, f"{table}/bucket={b}")
    return touched
