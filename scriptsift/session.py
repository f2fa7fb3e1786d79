"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Folders handed out, by application.
_STAGED: dict[str, list[str]] = {}


def local_session(cores: int | str = 8, memory: str = "12g", app: str = "scriptsift", **extra) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", memory)
    settings = {**SETTINGS, "spark.sql.shuffle.partitions": str(cores), **extra}
    if "spark.checkpoint.dir" not in settings:
        # One machine: its temporary folder is shared by all there is.
        settings["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="scriptsift-")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can reach.

    Taken from ``spark.checkpoint.dir``, else from the context's checkpoint
    folder; a session without either is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _place(spark: SparkSession, path: str):
    """A path and its file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove_folder(spark: SparkSession, path: str) -> None:
    place, files = _place(spark, path)
    files.delete(place, True)


def make_folder(spark: SparkSession, path: str) -> None:
    place, files = _place(spark, path)
    files.mkdirs(place)


def folder_exists(spark: SparkSession, path: str) -> bool:
    place, files = _place(spark, path)
    return files.exists(place)


def move_folder(spark: SparkSession, path: str, target: str) -> None:
    """Rename a folder within one file system; the parent of the target is made if needed."""
    place, files = _place(spark, path)
    to, _ = _place(spark, target)
    files.mkdirs(to.getParent())
    if not files.rename(place, to):
        raise OSError(f"cannot move {path} to {target}")


def committed_folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders matching a pattern whose write has ended well."""
    place, files = _place(spark, f"{pattern}/_SUCCESS")
    return sorted(f.getPath().getParent().toString() for f in files.globStatus(place) or [])


def remove_staged(spark: SparkSession) -> int:
    """Delete the folders this application has staged; results read from them end with it."""
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove_folder(spark, path)
    return len(paths)


def staged(rows: DataFrame, path: str, **options) -> DataFrame:
    """Write a table that several later steps read, and continue from it.

    Lost executors then cost the running stage only, and nothing upstream is
    computed twice.  ``options`` go to the writer.
    """
    rows.write.mode("overwrite").options(**options).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
