"""Exports.  Every sink is a distributed write; none passes rows through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import redact, safe_filename, safe_path
from ..session import shared_folder, staged

ANALYSIS_FIELDS = (
    "finding_type", "category", "value", "severity", "confidence", "line_number", "context", "pattern_name")


def analysis_export(findings: DataFrame) -> DataFrame:
    return findings.select(*ANALYSIS_FIELDS)


def findings_export(findings_with_url: DataFrame, redacted: bool = False) -> DataFrame:
    value = redact(F.col("value")) if redacted else F.col("value")
    return findings_with_url.select(
        "id", F.col("finding_type").alias("type"), "category", value.alias("value"),
        "severity", "confidence", F.col("asset_url").alias("asset"))


def write_findings_json(export: DataFrame, path: str) -> None:
    """One JSON object per line."""
    export.write.mode("overwrite").json(path)


def report_assets(assets: DataFrame) -> DataFrame:
    return assets.select(
        "project_id", "id", "url", "asset_type", "is_chunk", "has_sourcemap", "status_code", "content_length",
        F.date_format("discovered_at", "yyyy-MM-dd HH:mm:ss").alias("discovered_at"))


def report_findings(findings_with_url: DataFrame) -> DataFrame:
    return findings_with_url.select(
        "project_id", "id", "finding_type", "category", "value", "context", "line_number", "confidence",
        "severity", "pattern_name", "asset_url", "is_bookmarked", "notes",
        F.date_format("discovered_at", "yyyy-MM-dd HH:mm:ss").alias("discovered_at"))


def report_projects(projects: DataFrame) -> DataFrame:
    return projects.select(
        F.col("id").alias("project_id"), "name", "target_url",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"))


def write_report(
    projects: DataFrame, assets: DataFrame, findings_with_url: DataFrame, path: str, compression: str = "gzip",
) -> None:
    """The report as three JSON data sets, assets and findings by project; Spark's readers unpack them."""
    report_projects(projects).write.mode("overwrite").option("compression", compression).json(f"{path}/projects")
    for name, rows in (("assets", report_assets(assets)), ("findings", report_findings(findings_with_url))):
        # Rebalancing groups small projects into few files and splits large ones.
        rows.hint("rebalance", "project_id").write.mode("overwrite").option("compression", compression).partitionBy(
            "project_id").json(f"{path}/{name}")


# Parts of a report document, in order.
_HEAD, _ASSETS, _BETWEEN, _FINDINGS, _TAIL = range(5)
_LINE = ("project_id", "section", "place", "rid", "line")


def report_lines(projects: DataFrame, assets: DataFrame, findings_with_url: DataFrame) -> DataFrame:
    """The lines of one JSON document per project: project_id, section, place, rid, line.

    A document has ``project``, ``assets``, ``findings`` (both by id) and
    ``generated_at``.  Each asset and finding is a line of its own; all but the
    first of an array begin with the comma that parts them.  Rows of projects that
    are not there have no document.
    """
    spark = projects.sparkSession
    none, nulls = F.lit(None).cast("long"), {"ignoreNullFields": "false"}
    heads = report_projects(projects.filter("id is not null")).dropDuplicates(["project_id"])

    def objects(rows, section):
        there = rows.join(heads.select("project_id"), "project_id", "left_semi")
        json = F.to_json(F.struct(*[c for c in rows.columns if c != "project_id"]), nulls)
        return there.select("project_id", F.lit(section).alias("section"), F.col("id").cast("long").alias("place"), json.alias("line"))

    # Stored with a number each, as only one of several equal rows comes first.
    body = staged(
        objects(report_assets(assets), _ASSETS).unionByName(objects(report_findings(findings_with_url), _FINDINGS))
        .withColumn("rid", F.monotonically_increasing_id()), shared_folder(spark, "report-lines"))
    first = body.groupBy("project_id", "section").agg(F.min(F.struct("place", "rid"))["rid"].alias("first"))
    rows = body.join(first, ["project_id", "section"]).withColumn(
        "line", F.when(F.col("rid") == F.col("first"), F.col("line")).otherwise(F.concat(F.lit(","), "line")))

    def fixed(section, line):
        return heads.select("project_id", F.lit(section).alias("section"), none.alias("place"), none.alias("rid"), line.alias("line"))

    project = F.to_json(F.struct(F.col("project_id").alias("id"), "name", "target_url", "created_at"), nulls)
    return (
        rows.select(*_LINE)
        .unionByName(fixed(_HEAD, F.concat(F.lit('{"project":'), project, F.lit(',"assets":['))))
        .unionByName(fixed(_BETWEEN, F.lit('],"findings":[')))
        .unionByName(fixed(_TAIL, F.concat(F.lit('],"generated_at":"'), "generated_at", F.lit('"}')))))


# Documents with more lines than this are written by range; of the others, each a file, a task gets so many.
_LONG = 2000
_LINES_PER_TASK, _FILES_PER_TASK = 20_000, 200


def write_report_documents(
    projects: DataFrame, assets: DataFrame, findings_with_url: DataFrame, path: str, compression: str = "none",
) -> None:
    """One valid JSON document per project, of any size: the files of its folder, one after the other by name.

    The lines of long documents are dealt out by range of project and place and
    written in order, so no document is ever held as a whole and a large one is
    written by several tasks.  Short documents, which cost their file more than
    their lines, are dealt out whole; by range they would all stand together in a
    few tasks.
    """
    spark = projects.sparkSession
    order = [F.col("project_id"), F.col("section"), F.col("place").asc_nulls_first(), F.col("rid").asc_nulls_first()]
    lines = report_lines(projects, assets, findings_with_url)
    sizes = staged(lines.groupBy("project_id").agg(F.count("*").alias("n")), shared_folder(spark, "report-sizes"))
    short = sizes.filter(F.col("n") <= _LONG)
    n_short = short.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_long = sizes.filter(F.col("n") > _LONG).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def write(rows, mode):
        (
            rows.sortWithinPartitions(*order).select("project_id", F.col("line").alias("value"))
            .write.mode(mode).option("compression", compression).partitionBy("project_id").text(path))

    tasks = 1 + max(n_short[0] // _FILES_PER_TASK, n_short[1] // _LINES_PER_TASK)
    write(lines.join(short.select("project_id"), "project_id", "left_semi").repartition(tasks, "project_id"), "overwrite")
    if n_long:
        rest = lines.join(short.select("project_id"), "project_id", "left_anti")
        write(rest.repartitionByRange(1 + n_long // _LINES_PER_TASK, *order), "append")


def sources_export(source_files: DataFrame, keys=("asset_key",)) -> DataFrame:
    """Recovered files with content, addressed by a safe relative path."""
    return source_files.filter(F.col("content") != "").select(
        *keys, "pos", safe_path(F.col("name")).alias("path"), "content")


def write_sources(source_files: DataFrame, path: str, keys=("asset_key",)) -> None:
    sources_export(source_files, keys).write.mode("overwrite").parquet(path)


def text_archive(assets: DataFrame, url="url", content="content") -> DataFrame:
    return assets.select(safe_filename(F.col(url)).alias("file_name"), F.col(url).alias("url"), F.col(content).alias("content"))


def write_assets_text(assets: DataFrame, path: str, url="url", content="content") -> None:
    text_archive(assets, url, content).write.mode("overwrite").parquet(path)
