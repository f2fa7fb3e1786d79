"""Continuous scan of captured responses, as three streaming queries in a row.

1. ``start_texts``: responses to scripts and pages, each body once.  What has been
   seen is keyed state of the engine (``dropDuplicates`` on the content hash, kept
   in RocksDB).  Copies inside a batch are reduced to the earliest before that,
   inside their task and then per hash, so a body that a third of all responses
   hold reaches the state as one row.  Each batch stores its new bodies, the
   newest version per URL and the findings, all from the stored bodies, so the
   batch itself is computed once.
2. ``start_unique``: findings as they arrive, each (URL, type, category, value)
   once, again by engine state.
3. ``start_counts``: running counts per response, an aggregate in update mode.

No query reads what earlier batches have stored: what it must remember is in its
checkpoint, from which it restarts.  The column functions are the batch ones, so a
stream and a batch over the same responses give the same findings.
"""

from __future__ import annotations

import contextlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_hash, is_blank
from ..operators.detectors import SEVERITIES
from ..operators.pages import in_scope
from ..operators.predicates import classify_stream_response
from ..operators.reflow import best_content, reflow_minified
from ..operators.rollups import asset_summary
from ..operators.scan import scan_patterns
from ..session import committed_folders, make_folder
from . import latest

DEFAULT_PROJECT = "proxy_capture"
ASSET_SCHEMA = (
    "url string, asset_type string, content_hash string, content string, beautified_content string, "
    "content_length bigint, status_code int, captured_at timestamp, batch_id bigint"
)
FINDING_SCHEMA = (
    "url string, finding_type string, category string, value string, context string, line_number int, "
    "confidence string, severity string, pattern_name string, p_ord int, m_ord int, batch_id bigint"
)


def live_texts(responses: DataFrame, scope=(), scope_base: str | None = None) -> DataFrame:
    """Scripts and pages worth keeping, hashed, minified scripts reflowed."""
    kind = classify_stream_response(F.col("content_type"), F.col("url"))
    texts = responses.withColumn("asset_type", kind).filter(F.col("asset_type").isNotNull() & ~is_blank(F.col("content")))
    if scope:
        texts = texts.filter(in_scope(F.col("url"), F.lit(scope_base or ""), scope))
    reflowed = F.when(F.col("asset_type") == "javascript", reflow_minified(F.col("content")))
    return texts.select(
        "url", "asset_type", content_hash(F.col("content")).alias("content_hash"), "content",
        reflowed.alias("beautified_content"), F.length("content").cast("bigint").alias("content_length"),
        "status_code", "captured_at")


def _earliest(batches):
    """The earliest row per hash among the rows of a task; a null time comes last."""
    kept, waiting, rows = None, [], 0
    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        # Reduced whenever the rows waiting outnumber those kept: linear in all.
        if kept is None or rows > kept.num_rows:
            kept, waiting, rows = _reduced(kept, waiting), [], 0
    if kept is not None:
        yield from _reduced(kept, waiting).to_batches()


def _reduced(kept, waiting):
    table = pa.concat_tables([*([kept] if kept is not None else []), *(pa.Table.from_batches([b]) for b in waiting)])
    order = ["captured_at", "url", "asset_type", "status_code"]
    numbers = table.select(["content_hash", *order]).to_pandas()
    first = numbers.sort_values(order, na_position="last", kind="stable").drop_duplicates("content_hash").index
    return table.take(pa.array(first.sort_values()))


def earliest_of_batch(texts: DataFrame) -> DataFrame:
    """One row per body of a micro-batch, the earliest capture, then the least URL."""
    within_tasks = texts.mapInArrow(_earliest, texts.schema)
    return within_tasks.repartition("content_hash").mapInArrow(_earliest, texts.schema)


def first_sightings(texts: DataFrame, watermark: str | None = None) -> DataFrame:
    """Each body once: for good, or with ``watermark`` once in that time, so that the state stays bounded."""
    if watermark:
        return texts.withWatermark("captured_at", watermark).dropDuplicatesWithinWatermark(["content_hash"])
    return texts.dropDuplicates(["content_hash"])


def live_findings(texts: DataFrame, keys=("url",), **options) -> DataFrame:
    """Findings of scripts; pages are kept but not scanned."""
    best = best_content(F.lit(None).cast("string"), F.col("beautified_content"), F.col("content"))
    scripts = texts.filter(F.col("asset_type") == "javascript").select(*keys, best.alias("content"))
    return scan_patterns(scripts, keys, **options)


def stream_counts(findings: DataFrame, keys=("url",)) -> DataFrame:
    """Per response: total and the four levels shown, when there is any finding."""
    return asset_summary(findings, keys=keys).drop("low")


def _read(spark: SparkSession, path: str, schema: str, base: str | None = None) -> DataFrame:
    """A stored table; empty before its first batch.  Any other failure is raised."""
    reader = spark.read.schema(schema)
    try:
        return (reader.option("basePath", base) if base else reader).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def asset_versions(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, f"{root}/assets", ASSET_SCHEMA)


def captured_findings(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, f"{root}/findings", FINDING_SCHEMA)


def latest_assets(versions: DataFrame) -> DataFrame:
    """The current version of every URL."""
    newest = F.max(F.struct("batch_id", "captured_at", *[
        c for c in versions.columns if c not in ("url", "batch_id", "captured_at")])).alias("v")
    return versions.groupBy("url").agg(newest).select("url", "v.*")


def ensure_project(projects: DataFrame, name: str = DEFAULT_PROJECT) -> DataFrame:
    """The projects plus the capture project, unless it exists."""
    wanted = projects.sparkSession.createDataFrame([(name, "(proxy capture)")], "name string, target_url string")
    return projects.unionByName(wanted.join(projects.select("name"), "name", "left_anti"), allowMissingColumns=True)


VERSION_SCHEMA = (
    "url string, asset_type string, content_hash string, content_length bigint, status_code int, captured_at timestamp, "
    "batch_id bigint")
_COUNTED = ("total", *SEVERITIES)
COUNT_SCHEMA = "url string, " + ", ".join(f"{c} bigint" for c in _COUNTED) + ", batch_id bigint"
FINDING_KEY = ["url", "finding_type", "category", "value"]
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextlib.contextmanager
def _state_in_rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's own settings come back."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def current_versions(spark: SparkSession, root: str) -> DataFrame:
    """The newest version of every URL, without its text: one large run and a few small ones are read."""
    return latest.read(spark, f"{root}/versions", VERSION_SCHEMA, ["url"], ["batch_id", "captured_at"])


def current_counts(spark: SparkSession, root: str) -> DataFrame:
    """Running counts per response, as the stream last wrote them."""
    return latest.read(spark, f"{root}/counts", COUNT_SCHEMA, ["url"], ["batch_id"]).drop("batch_id")


def write_batch(batch: DataFrame, batch_id: int, root: str, deduplicate: bool = True, **options) -> None:
    """Store one micro-batch of unseen bodies, their findings and the newest version per URL.

    Everything but the bodies is worked out from the stored bodies.  Folders are
    named by the batch and replaced as a whole, so a repeated batch leaves the same
    result; findings that ``start_unique`` may be reading already are not replaced.
    """
    spark = batch.sparkSession
    target = f"{root}/assets/batch_id={batch_id}"
    # Always computed, also when repeated: the state of the stream moves on with it.
    batch.write.mode("overwrite").parquet(target)
    stored = spark.read.schema(batch.schema).parquet(target)
    findings = live_findings(stored, **options)
    found = f"{root}/found/batch-{batch_id}"
    if not deduplicate:
        findings.write.mode("overwrite").parquet(f"{root}/findings/batch_id={batch_id}")
    elif not committed_folders(spark, found):
        findings.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(found)
    versions = stored.withColumn("batch_id", F.lit(batch_id).cast("bigint")).select(*[c.split()[0] for c in VERSION_SCHEMA.split(", ")])
    latest.add(versions, f"{root}/versions", batch_id, ["url"], ["batch_id", "captured_at"])


def start_texts(
    responses: DataFrame, root: str, checkpoint: str, watermark: str | None = None, deduplicate: bool = True,
    trigger: dict | None = None, scope=(), scope_base: str | None = None, **options,
) -> StreamingQuery:
    """Store each body of the responses once, with its findings.

    Without ``watermark`` a body is remembered for good, with it for that long.
    """
    unseen = first_sightings(earliest_of_batch(live_texts(responses, scope, scope_base)), watermark)
    with _state_in_rocksdb(responses.sparkSession):
        return (
            unseen.writeStream.foreachBatch(lambda b, i: write_batch(b, i, root, deduplicate, **options))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def start_unique(spark: SparkSession, root: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Findings of ``start_texts``, each (URL, type, category, value) once, in the order of its batches."""
    make_folder(spark, f"{root}/found/none")
    found = spark.readStream.schema(FINDING_SCHEMA).parquet(f"{root}/found/*")
    with _state_in_rocksdb(spark):
        return (
            found.dropDuplicates(FINDING_KEY).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(f"{root}/findings"))


def start_counts(spark: SparkSession, root: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Running totals per response over the findings of ``start_unique``; each batch stores the changed ones."""
    make_folder(spark, f"{root}/findings")
    findings = spark.readStream.schema(FINDING_SCHEMA).parquet(f"{root}/findings")

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        latest.add(rows.select("url", *_COUNTED, "batch_id"), f"{root}/counts", batch_id, ["url"], ["batch_id"])

    with _state_in_rocksdb(spark):
        return (
            asset_summary(findings, keys=("url",)).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


class Capture:
    """The queries of a capture.  With ``availableNow`` each starts when the one before it has ended."""

    def __init__(self, starts, one_after_another: bool):
        self._later = list(starts)
        self.queries = [self._later.pop(0)()]
        while self._later and not one_after_another:
            self.queries.append(self._later.pop(0)())

    def awaitTermination(self) -> None:  # noqa: N802 - named as the engine names it
        for query in self.queries:
            query.awaitTermination()
        while self._later:
            self.queries.append(self._later.pop(0)())
            self.queries[-1].awaitTermination()

    def stop(self) -> None:
        self._later.clear()
        for query in self.queries:
            query.stop()

    @property
    def isActive(self) -> bool:  # noqa: N802
        return any(q.isActive for q in self.queries)


def start_capture(
    responses: DataFrame,
    root: str,
    checkpoint: str,
    watermark: str | None = None,
    deduplicate: bool = True,
    trigger: dict | None = None,
    scope=(),
    scope_base: str | None = None,
    counts: bool = False,
    **options,
) -> Capture:
    """Run the capture.  ``root`` and ``checkpoint`` are shared folders.

    Without ``deduplicate`` the findings of all bodies are stored as they are;
    ``counts`` adds the running counts of unique findings.
    """
    spark = responses.sparkSession
    starts = [lambda: start_texts(responses, root, checkpoint, watermark, deduplicate, trigger, scope, scope_base, **options)]
    if deduplicate:
        starts.append(lambda: start_unique(spark, root, f"{checkpoint}-unique", trigger))
        if counts:
            starts.append(lambda: start_counts(spark, root, f"{checkpoint}-counts", trigger))
    return Capture(starts, one_after_another=(trigger or {"availableNow": True}).keys() <= {"availableNow", "once"})
