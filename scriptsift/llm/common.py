"""Words, row ids and staged tables shared by the operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, staged

# Words are runs of letters, marks and digits of the lower-cased text.
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"
SHINGLE_WORDS = 5
SIMILARITY = 0.8
# Texts that one Arrow batch may carry to a Python worker; a batch of very long
# texts must still fit beside its results.
BATCH_ROWS = 256


def words(text: Column) -> Column:
    """Lower-cased words of a text; none for null, empty or blank texts."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def word_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, as rows can be whole books."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that all executors share.

    Where ``spark.checkpoint.dir`` is unset and driver and executors are one
    process, as in tests, a temporary folder takes its place.
    """
    alone = spark.sparkContext.master.partition("[")[0] == "local"
    if alone and not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scriptsift-"))
    return shared_folder(spark, purpose)


def stage(rows: DataFrame, purpose: str) -> DataFrame:
    """Write to a fresh shared folder, and read it back."""
    return staged(rows, shared(rows.sparkSession, purpose))


def with_row_ids(rows: DataFrame, purpose: str, *columns) -> DataFrame:
    """The columns asked for plus ``__rid``, a row number that later reads agree on.

    Row numbers are only stable once written: computed twice, a plan may deal its
    rows out differently.
    """
    return stage(rows.select(F.monotonically_increasing_id().alias("__rid"), *columns), purpose)
