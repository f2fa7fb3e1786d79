"""Documents to training ids: five stages, each written before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptsift.llm.common import stage
from scriptsift.llm.decontaminate import decontaminate
from scriptsift.llm.near import with_classes
from scriptsift.llm.pieces import encode_texts
from scriptsift.llm.pii import mask_pii
from scriptsift.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold stay; labels teach, as far as their documents are there.

    Null and empty texts are scored like any other; repeated rows share a score.
    Without labels of both kinds nothing is learned and all documents stay.  Other
    columns pass through; an empty table stays empty.
    """
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked documents stays.

    Of a class the first row stays in the order in which the table is read.  Null,
    empty and wordless texts are copies of each other, so one of them stays.  Null
    ids take part; other columns pass through; an empty table stays empty.
    """
    return with_classes(docs).filter("keeps").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay; an empty benchmark lets all stay;
    repeated rows share their fate.  Other columns pass through; an empty table
    stays empty.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; the length follows the new text.

    Null texts stay null, with a null length.  No row goes; repeated rows are masked
    alike; other columns pass through.
    """
    return mask_pii(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, beside all columns but the text and its length.

    Null and empty texts have no ids; every row stays; columns named like the new
    ones are replaced.
    """
    kept = [c for c in docs.columns if c not in ("text", "n_chars", "n_ids", "ids")]
    return encode_texts(docs).select(*kept, "n_ids", "ids")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("pieces", pieces),
]

# Training a classifier, MinHash and Viterbi are beyond SQL; tests compare the
# stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
