"""Captured tables and local files as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import RESPONSES


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """HTML pages: page_id, url, html."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_js_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Local scripts, one row per file; bytes that are not UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select(
        F.col("path").alias("asset_url"), text.alias("content"), F.col("length").alias("n_bytes"))


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(RESPONSES).format(fmt).load(path)


def stream_responses(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: str = RESPONSES, **options
) -> DataFrame:
    """A live capture: files that keep arriving in one folder."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def scope_list(scope_patterns: Column) -> Column:
    """Scope expressions from their JSON text; anything unreadable is empty."""
    none = F.expr("cast(array() as array<string>)")
    return F.coalesce(F.from_json(scope_patterns, "array<string>"), none)


def created_day(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit(""))
