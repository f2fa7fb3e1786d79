import json

from pyspark.sql import functions as F

from scriptsift.operators import listing, predicates, rollups, store
from scriptsift.sources import sinks

FIELDS = "id int, project_id int, asset_id int, finding_type string, category string, value string, severity string, p_ord int, m_ord int"


def findings(spark, *rows):
    return spark.createDataFrame(rows, FIELDS).withColumn("context", F.col("value"))


def sample(spark):
    return findings(
        spark,
        (1, 1, 10, "secret", "a", "v1", "medium", 0, 0), (2, 1, 10, "secret", "b", "v1", "critical", 1, 0),
        (3, 1, 11, "storage", "c", "v2", "info", 2, 0), (4, 2, 99, "storage", "c", "v3", "weird", 2, 1),
        (5, 2, 11, "secret", "a", "v4", "low", 0, 1), (6, 1, None, "secret", "z", "v5", "high", 3, 0))


def ids(df):
    return [r.id for r in df.collect()]


def test_filters(spark):
    df = sample(spark)
    assert set(ids(predicates.filter_findings(df))) == {1, 2, 3, 4, 5, 6}
    assert set(ids(predicates.filter_findings(df, finding_type="secret", category="a"))) == {1, 5}
    assert set(ids(predicates.min_severity(df, "medium"))) == {1, 2, 6}
    assert set(ids(predicates.min_severity(df, "unknown"))) == {1, 2, 3, 4, 5, 6}
    assert set(ids(predicates.select_categories(df, ["a", "b"], ["b"]))) == {1, 5}
    assert predicates.select_categories(df).count() == 6


def test_ranked_listings(spark):
    df = sample(spark)
    assert ids(listing.ranked(df, ["id"])) == [2, 6, 1, 5, 3, 4]
    assert ids(listing.findings_page(df, 3)) == [2, 6, 1]
    # Alphabetical selection: critical, high, info, low; medium and weird fall out.
    assert ids(listing.findings_page(df, 4, compat=True)) == [2, 6, 5, 3]
    assert ids(listing.report_order(df)) == [2, 6, 1, 5, 3, 4]


def test_first_wins_by_order(spark):
    df = sample(spark)
    kept = store.persistable_findings(df, ("asset_id",))
    assert set(ids(kept)) == {1, 2, 3, 4, 5, 6}
    assert set(ids(store.persistable_findings(df, ("asset_id",), compat=True))) == {1, 3, 4, 5, 6}


def test_new_findings(spark):
    stored = findings(spark, (9, 1, 10, "secret", "a", "v1", "low", 0, 0), (8, 9, 10, "secret", "b", "v1", "low", 0, 0))
    assert set(ids(store.new_findings(sample(spark), stored))) == {2, 3, 4, 5, 6}
    assert set(ids(store.new_findings(sample(spark), stored, compat=True))) == {3, 4, 5, 6}
    long = findings(spark, (1, 1, 1, "t", "c", "x" * 500 + "1", "low", 0, 0))
    other = findings(spark, (2, 1, 1, "t", "c", "x" * 500 + "2", "low", 0, 0))
    assert store.new_findings(long, other).count() == 1
    assert store.new_findings(long, other, compat=True).count() == 0


def assets(spark):
    return spark.createDataFrame([
        (10, 1, "https://h/a.js", "javascript", None, None), (11, 1, "https://h/b.js", "chunk", "https://h/a.js", "3"),
        (12, 2, "https://h/c.js", "chunk", "https://h/a.js", "4")],
        "id int, project_id int, url string, asset_type string, parent_url string, chunk_id string")


def projects(spark):
    return spark.createDataFrame([(1, "one", "t1", 5), (2, "two", "t2", None), (3, "three", "t3", 900_000)],
                                 "id int, name string, target_url string, s int").withColumn(
        "created_at", F.timestamp_seconds("s")).drop("s")


def test_joins(spark):
    rows = store.with_asset_url(sample(spark), assets(spark)).orderBy("id").collect()
    assert [r.asset_url for r in rows] == ["https://h/a.js"] * 2 + ["https://h/b.js", "", "https://h/b.js", ""]
    assert set(ids(store.of_project(sample(spark), projects(spark), "two"))) == {4, 5}
    assert store.of_project(sample(spark), projects(spark), "nobody").count() == 0
    graph = store.asset_import_graph(assets(spark)).collect()
    assert [(r.id, r.parent_id, r.chunk_id) for r in graph] == [(11, 10, "3")]
    found = spark.createDataFrame([(1, "https://h/a.js"), (1, "https://h/n.js"), (1, "https://h/n.js"), (2, "https://h/a.js")],
                                  "project_id int, url string")
    assert {tuple(r) for r in store.unknown_urls(found, assets(spark)).collect()} == {(1, "https://h/n.js"), (2, "https://h/a.js")}


def test_cascade(spark):
    names = spark.createDataFrame([("one",), ("nobody",)], "name string")
    p, a, f = store.delete_projects(projects(spark), assets(spark), sample(spark), names)
    assert set(ids(p)) == {2, 3} and set(ids(a)) == {12} and set(ids(f)) == {4, 5}


def test_first_captured_candidate(spark):
    candidates = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "x")], "k int, ord int, url string")
    inventory = spark.createDataFrame([("c",), ("b",), ("b",)], "url string")
    assert [tuple(r) for r in store.first_captured(candidates, inventory, ["k"]).collect()] == [(1, 1, "b")]


def test_rollups(spark):
    counts = {(r.project_id, r.severity): r.n for r in rollups.severity_counts(sample(spark)).collect()}
    assert counts == {(1, "medium"): 1, (1, "critical"): 1, (1, "info"): 1, (1, "high"): 1, (2, "low"): 1}
    report = {(r.project_id, r.severity): r.n for r in rollups.report_counts(sample(spark)).collect()}
    assert report[(2, "weird")] == 1
    rows = rollups.project_list(projects(spark), assets(spark), sample(spark)).collect()
    assert [(r.id, r.n_assets, r.n_findings, r.created) for r in rows] == [
        (3, 0, 0, "1970-01-11"), (1, 2, 4, "1970-01-01"), (2, 1, 2, "")]


def test_one_hot_key_is_combined_before_the_shuffle(spark):
    """A first-wins rule must not send all rows of a key to one task."""
    df = spark.range(1000).select(
        F.lit(1).alias("asset_key"), F.lit("t").alias("finding_type"), F.lit("c").alias("category"), F.lit("v").alias("value"),
        F.lit("x").alias("context"), F.lit(0).alias("p_ord"), F.col("id").alias("m_ord"))
    plan = store.persistable_findings(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan


def test_responses_with_the_same_body(spark):
    df = spark.createDataFrame([(1, "u1", "body", 5), (2, "u2", "body", 3), (3, "u3", "other", 9)],
                               "response_id int, url string, content string, t int").withColumn(
        "captured_at", F.timestamp_seconds("t"))
    assert {(r.url, r.response_id) for r in store.first_responses(df).collect()} == {("u2", 2), ("u3", 3)}


def test_unanalyzed(spark):
    a = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "h1")], "id int, content_hash string")
    done = spark.createDataFrame([("h1",), ("h1",)], "content_hash string")
    assert ids(predicates.unanalyzed_assets(a, done)) == [2]


def test_exports(spark, tmp_path):
    full = sample(spark).withColumns({
        "confidence": F.lit("high"), "line_number": F.lit(1), "pattern_name": F.lit("p"), "is_bookmarked": F.lit(False),
        "notes": F.lit(""), "discovered_at": F.timestamp_seconds(F.lit(0))})
    linked = store.with_asset_url(full, assets(spark))
    sinks.write_findings_json(sinks.findings_export(linked), str(tmp_path / "f"))
    lines = [json.loads(line) for p in (tmp_path / "f").glob("*.json") for line in p.read_text().splitlines()]
    assert len(lines) == 6 and set(lines[0]) == {"id", "type", "category", "value", "severity", "confidence", "asset"}
    assert list(sinks.analysis_export(full).columns) == [
        "finding_type", "category", "value", "severity", "confidence", "line_number", "context", "pattern_name"]
    shown = [r.value for r in sinks.findings_export(linked, redacted=True).collect()]
    assert all("~" in v and len(v) <= 17 for v in shown)
    a = assets(spark).withColumns({
        "is_chunk": F.lit(True), "has_sourcemap": F.lit(False), "status_code": F.lit(200), "content_length": F.lit(1),
        "discovered_at": F.timestamp_seconds(F.lit(0))})
    sinks.write_report(projects(spark), a, linked, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/findings")).filter("project_id = 1").count() == 4
    assert spark.read.json(str(tmp_path / "r/projects")).count() == 3
    archive = sinks.text_archive(a.withColumn("content", F.lit("x")))
    assert archive.orderBy("url").first().file_name == "https_h_a.js"
