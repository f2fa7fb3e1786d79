"""Streaming queries.  The capture arrives as a stream over the events table and
runs to the end of what is there; results are the tables the stream wrote."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from scriptsift.session import folder_exists, make_folder, move_folder, shared_folder
from scriptsift.sources.readers import stream_responses
from scriptsift.streaming import live

from .corpus import RESPONSES
from .duck import findings_by_line
from .page_queries import STREAM_KIND
from .registry import query


# Parts the events arrive in, one micro-batch each; events without a time come last.
ARRIVALS = 4


def arrivals(spark, sf):
    """(stream of responses, functions that let the next part of the events arrive), in the order of their time.

    The events are written once, by all tasks, with a folder per part; a part
    arrives when its folder moves to where the stream looks.
    """
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = shared_folder(spark, "arrivals")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(at), F.max(at)).first()
    span = (last - first + 1) if first is not None else 1
    part = F.coalesce(F.floor((at - (first or 0)) * ARRIVALS / span), F.lit(ARRIVALS)).cast("int")
    events.withColumn("arrival", part).write.partitionBy("arrival").parquet(f"{folder}/waiting")
    make_folder(spark, f"{folder}/arrived/none")
    parts = [
        partial(move_folder, spark, f"{folder}/waiting/arrival={k}", f"{folder}/arrived/part-{k}")
        for k in range(ARRIVALS + 1) if folder_exists(spark, f"{folder}/waiting/arrival={k}")]
    stream = stream_responses(spark, f"{folder}/arrived/*", schema=events.schema)
    return RESPONSES.project(stream), parts


_KEPT = f"(SELECT *, {STREAM_KIND} AS asset_type, sha256(content) AS content_hash FROM {RESPONSES.sql} WHERE trim(content) <> '' AND {STREAM_KIND} IS NOT NULL)"
_FRESH = f"""(SELECT content_hash, arg_min(url, (captured_at, url)) AS url, arg_min(asset_type, (captured_at, url)) AS asset_type,
  arg_min(content, (captured_at, url)) AS content FROM {_KEPT} GROUP BY content_hash)"""


def captured(spark, sf, **options):
    """Capture the arrivals one after the other; every part restarts the stream from its checkpoint."""
    root = shared_folder(spark, "capture")
    stream, parts = arrivals(spark, sf)
    for arrive in parts:
        arrive()
        live.start_texts(stream, root, f"{root}/checkpoint", **options).awaitTermination()
    return root


@query("stream_assets", f"SELECT url, asset_type, content_hash, length(content) AS content_length FROM {_FRESH}")
def stream_assets(spark, sf):
    return live.asset_versions(spark, captured(spark, sf)).select("url", "asset_type", "content_hash", "content_length")


@query("stream_latest_assets", f"""
SELECT url, arg_max(content_hash, (t, asset_type, content_hash)) AS content_hash FROM (SELECT f.*, k.t FROM {_FRESH} f
JOIN (SELECT content_hash, min(captured_at) AS t FROM {_KEPT} GROUP BY 1) k USING (content_hash)) GROUP BY url""")
def stream_latest_assets(spark, sf):
    return live.current_versions(spark, captured(spark, sf)).select("url", "content_hash")


@query("stream_findings", f"""
WITH s AS (SELECT url, content_hash, content FROM {_FRESH} WHERE asset_type = 'javascript'),
{findings_by_line('s', 'url, content_hash')}
SELECT url, pattern_name, value, line_number, severity FROM f""")
def stream_findings(spark, sf):
    root = captured(spark, sf, deduplicate=False)
    found = live.captured_findings(spark, root)
    return found.select("url", "pattern_name", "value", "line_number", "severity")


@query("stream_counts", f"""
WITH s AS (SELECT url, content FROM {_FRESH} WHERE asset_type = 'javascript'),
{findings_by_line('s', 'url')}
SELECT url, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
  count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'info') AS info
FROM (SELECT DISTINCT url, finding_type, category, value, severity FROM f) GROUP BY url""")
def stream_counts(spark, sf):
    """Running counts of unique findings, kept by the stream itself."""
    root = captured(spark, sf)
    live.start_unique(spark, root, f"{root}/unique").awaitTermination()
    live.start_counts(spark, root, f"{root}/counted").awaitTermination()
    return live.current_counts(spark, root).drop("low")


@query("stream_bounded_state", f"SELECT content_hash, count(*) AS n FROM {_FRESH} GROUP BY content_hash")
def stream_bounded_state(spark, sf):
    """Copies remembered by watermarked state instead of the stored table."""
    root = captured(spark, sf, watermark="40 days")
    return live.asset_versions(spark, root).groupBy("content_hash").agg(F.count("*").alias("n"))


@query("stream_classified", f"SELECT url, asset_type, count(*) AS n FROM {_KEPT} GROUP BY ALL")
def stream_classified(spark, sf):
    """The stateless part alone, written by an append stream."""
    root = shared_folder(spark, "classified")
    stream, parts = arrivals(spark, sf)
    texts = live.live_texts(stream).select("url", "asset_type")
    for arrive in parts:
        arrive()
        texts.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(
            availableNow=True).start(f"{root}/out").awaitTermination()
    make_folder(spark, f"{root}/out")
    return spark.read.schema("url string, asset_type string").parquet(f"{root}/out").groupBy("url", "asset_type").agg(
        F.count("*").alias("n"))
