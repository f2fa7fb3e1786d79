import glob
import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scriptsift.operators import layout, store
from scriptsift.sources import sinks


def tables(spark):
    projects = spark.createDataFrame([(i, f"p{i}", "t") for i in range(30)] + [(None, "nobody", "t")], "id long, name string, target_url string")
    rows = [(i, None if i % 10 == 9 else 3 if i % 3 == 0 else i % 30, f"u{i}") for i in range(400)]
    assets = spark.createDataFrame(rows, "id long, project_id long, url string")
    return {"projects": projects, "assets": assets, "findings": assets.drop("url")}


def names_of(root):
    return {os.path.relpath(p, root): os.path.getmtime(p) for p in glob.glob(f"{root}/*/bucket=*/part-*.parquet")}


def gone(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def rows_of(spark, root, name):
    rows = layout.read_store(spark, root, name)
    return sorted(map(repr, map(tuple, rows.select(*sorted(rows.columns)).collect())))


def expected(spark, names):
    old = tables(spark)
    kept = store.delete_projects(old["projects"], old["assets"], old["findings"], gone(spark, *names))
    return [sorted(map(repr, map(tuple, t.select(*sorted(t.columns)).collect()))) for t in kept]


def test_only_touched_buckets_are_written(spark, tmp_path):
    root = str(tmp_path)
    layout.write_store(tables(spark), root, buckets=8)
    before = names_of(root)
    touched = layout.delete_in_place(spark, root, gone(spark, "p3", "p4", "unknown"), buckets=8)
    after = names_of(root)
    assert 1 <= len(touched) <= 2
    untouched = {p: t for p, t in before.items() if not any(f"bucket={b}/" in p for b in touched)}
    assert untouched and untouched.items() <= after.items()
    assert not {p for p in before if p not in untouched} & set(after)
    assert [rows_of(spark, root, n) for n in store.STORED] == expected(spark, ["p3", "p4"])


def test_buckets_without_rows_go(spark, tmp_path):
    root = str(tmp_path)
    layout.write_store(tables(spark), root, buckets=1000)  # about one project each
    layout.delete_in_place(spark, root, gone(spark, "p3"), buckets=1000)
    assert [rows_of(spark, root, n) for n in store.STORED] == expected(spark, ["p3"])
    assert layout.delete_in_place(spark, root, gone(spark, "p3"), buckets=1000) == []


def test_a_deletion_cut_short_is_finished(spark, tmp_path, monkeypatch):
    root, calls = str(tmp_path), []
    layout.write_store(tables(spark), root, buckets=8)
    stage = layout.staged

    def fails(rows, path):
        calls.append(path)
        if path.endswith("/projects"):
            raise OSError("lost")
        return stage(rows, path)

    monkeypatch.setattr(layout, "staged", fails)
    with pytest.raises(OSError):
        layout.delete_in_place(spark, root, gone(spark, "p5", "p6"), buckets=8)
    monkeypatch.setattr(layout, "staged", stage)
    layout.delete_in_place(spark, root, gone(spark, "p5", "p6"), buckets=8)
    assert [rows_of(spark, root, n) for n in store.STORED] == expected(spark, ["p5", "p6"])


PROJECTS = "id long, name string, target_url string, created_at timestamp"
ASSETS = (
    "id long, project_id long, url string, asset_type string, is_chunk boolean, has_sourcemap boolean, status_code int, "
    "content_length long, discovered_at timestamp")
FINDINGS = (
    "id long, project_id long, finding_type string, category string, value string, context string, line_number int, confidence string, "
    "severity string, pattern_name string, asset_url string, is_bookmarked boolean, notes string, discovered_at timestamp")


def documents(root):
    out = {}
    for folder in glob.glob(f"{root}/project_id=*"):
        text = "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{folder}/part-*")))
        out[int(folder.rpartition("=")[2])] = (json.loads(text), len(glob.glob(f"{folder}/part-*")))
    return out


def test_documents_are_valid_json(spark, tmp_path):
    odd = 'quo"te \\ \n line  é \U0001F600'
    projects = spark.createDataFrame([(1, odd, "t", None), (2, "two", None, None), (3, "empty", "t", None), (None, "x", "t", None)], PROJECTS)
    assets = spark.createDataFrame(
        [(i, 1 + i % 2, odd, "javascript", None, False, 200, i, None) for i in (5, 3, 3, 9, 4)] + [(None, 1, "u", None, None, None, None, None, None)] * 2
        + [(7, 8, "no project", "x", None, None, None, None, None), (8, None, "null", "x", None, None, None, None, None)], ASSETS)
    findings = spark.createDataFrame(
        [(i, 2, "secret", "c", odd, odd, i, "high", "low", "p", "", False, None, None) for i in range(20, 0, -1)], FINDINGS)
    sinks.write_report_documents(projects, assets, findings, str(tmp_path / "r"))
    docs = {k: d for k, (d, _) in documents(str(tmp_path / "r")).items()}
    assert sorted(docs) == [1, 2, 3]
    assert docs[1]["project"] == {"id": 1, "name": odd, "target_url": "t", "created_at": None}
    assert [a["id"] for a in docs[1]["assets"]] == [None, None, 4]
    assert [a["id"] for a in docs[2]["assets"]] == [3, 3, 5, 9] and docs[2]["assets"][0]["url"] == odd
    assert [f["id"] for f in docs[2]["findings"]] == list(range(1, 21)) and docs[1]["findings"] == []
    assert set(docs[2]["findings"][0]) == {c.split()[0] for c in FINDINGS.split(", ")} - {"project_id"}
    assert docs[3]["assets"] == [] and docs[3]["findings"] == [] and docs[3]["generated_at"]


def test_a_large_document_is_written_by_several_tasks(spark, tmp_path):
    projects = spark.createDataFrame([(i, "n", "t", None) for i in range(3)], PROJECTS)
    assets = spark.createDataFrame([], ASSETS)
    findings = spark.range(30_000).select(
        "id", F.when(F.col("id") % 100 == 0, 1).otherwise(2).cast("long").alias("project_id"), F.lit("t").alias("finding_type"), F.lit("c").alias("category"),
        F.concat(*[F.sha2(F.concat(F.lit(f"{k}-"), "id"), 256) for k in range(3)]).alias("value"), F.lit("x").alias("context"), F.lit(1).alias("line_number"), F.lit("h").alias("confidence"),
        F.lit("low").alias("severity"), F.lit("p").alias("pattern_name"), F.lit("u").alias("asset_url"), F.lit(False).alias("is_bookmarked"),
        F.lit("").alias("notes"), F.lit(None).cast("timestamp").alias("discovered_at"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        sinks.write_report_documents(projects, assets, findings, str(tmp_path / "r"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes") if before is None else spark.conf.set(
            "spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    docs = documents(str(tmp_path / "r"))
    assert [len(docs[k][0]["findings"]) for k in (0, 1, 2)] == [0, 300, 29_700]
    assert [f["id"] for f in docs[2][0]["findings"]] == [i for i in range(30_000) if i % 100]
    assert docs[2][1] > 1


def test_short_documents_are_dealt_out_among_tasks(spark, tmp_path):
    """Each is a file of its own, so a task that wrote them all would grow with their number."""
    projects = spark.range(1000).select("id", F.lit("n").alias("name"), F.lit("t").alias("target_url"), F.lit(None).cast("timestamp").alias("created_at"))
    sinks.write_report_documents(projects, spark.createDataFrame([], ASSETS), spark.createDataFrame([], FINDINGS), str(tmp_path / "r"))
    per_task = Counter(os.path.basename(p).split("-")[1] for p in glob.glob(f"{tmp_path}/r/project_id=*/part-*"))
    assert sum(per_task.values()) == 1000 and max(per_task.values()) < 400
