import base64
import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from scriptsift.operators import store
from scriptsift.operators.catalog import custom_detector_pages
from scriptsift.plans.custom_scan import scan_custom
from scriptsift.plans.file_analysis import analyze_files
from scriptsift.plans.site_scan import scan_site
from scriptsift.session import remove_staged, shared_folder, staged


def responses(spark, pairs):
    rows = [(i, u, 200, c, None) for i, (u, c) in enumerate(pairs)]
    return spark.createDataFrame(rows, "response_id int, url string, status_code int, content string, error string").withColumn(
        "captured_at", F.timestamp_seconds("response_id"))


def test_site_scan_follows_chunks_and_maps(spark):
    doc = {"sources": ["webpack:///./src/s.ts"], "sourcesContent": ["let a;\ndocument.write(a)"]}
    uri = "data:application/json;base64," + base64.b64encode(json.dumps(doc).encode()).decode()
    pages = spark.createDataFrame([
        (1, "https://h.example/", '<script src="/main.js"></script><script src="/mapped.js"></script><script>eval(q)</script>'),
        (2, "https://h.example/two", '<script src="/main.js"></script><script src="https://o.example/x.js"></script>')],
        "page_id int, url string, html string")
    scan = scan_site(spark, pages, responses(spark, [
        ("https://h.example/main.js", '__webpack_require__.p="/c/";u=({1:"lazy"}[e]);x.innerHTML = 1'),
        ("https://h.example/c/lazy.chunk.js", "document.cookie"),
        ("https://h.example/mapped.js", f"min()\n//# sourceMappingURL={uri}"),
        ("https://o.example/x.js", "eval(out)")]))
    assert {(r.asset_url, r.asset_type) for r in scan.assets.collect()} == {
        ("https://h.example/main.js", "javascript"), ("https://h.example/mapped.js", "javascript"),
        ("https://h.example/c/lazy.chunk.js", "chunk")}
    assert sorted((r.base_url, r.url, r.chunk_id) for r in scan.chunks.collect()) == [
        (page, "https://h.example/c/lazy.chunk.js", "1") for page in ("https://h.example/", "https://h.example/two")]
    assert [r.name for r in scan.source_files.collect()] == ["src/s.ts"]
    assert {(r.asset_url, r.pattern_name, r.line_number) for r in scan.findings.collect()} == {
        ("https://h.example/main.js", "innerhtml_sink", 1), ("https://h.example/c/lazy.chunk.js", "cookie_access", 1),
        ("https://h.example/mapped.js", "document_write", 6), ("https://h.example/#inline-script-0", "eval_call", 1)}


def test_a_bundle_of_two_sites_is_looked_at_from_both(spark):
    pages = spark.createDataFrame([
        (i, f"https://{site}.example/", '<script src="https://cdn.example/lib.js"></script>') for i, site in enumerate("ab")],
        "page_id int, url string, html string")
    captured = responses(spark, [
        ("https://cdn.example/lib.js", '__webpack_require__.p="/c/";u=({1:"lazy"}[e])'),
        ("https://a.example/c/lazy.chunk.js", "eval(1)"), ("https://b.example/c/lazy.chunk.js", "eval(2)")])
    scan = scan_site(spark, pages, captured, cross_origin=True)
    assert {r.asset_url for r in scan.findings.collect()} == {"https://a.example/c/lazy.chunk.js", "https://b.example/c/lazy.chunk.js"}


def test_urls_of_a_page_tell_the_framework(spark):
    pages = spark.createDataFrame([(1, "https://h.example/", '<script src="/_next/static/chunks/a.js"></script>')],
                                  "page_id int, url string, html string")
    captured = responses(spark, [
        ("https://h.example/_next/static/chunks/a.js", '{"buildId":"B1"}'),
        ("https://h.example/_next/static/B1/_buildManifest.js", '["/p.js"]'),
        ("https://h.example/_next/static/chunks/main.js", "x")])
    assert {(r.url, r.source) for r in scan_site(spark, pages, captured).chunks.collect()} == {
        ("https://h.example/_next/static/p.js", "next_build_manifest"),
        ("https://h.example/_next/static/chunks/main.js", "next_standard")}


def test_sources_are_scanned_to_their_end(spark):
    doc = {"sources": ["s.ts"], "sourcesContent": ["x" * 2_000_100 + "\neval(q)"]}
    pages = spark.createDataFrame([(1, "https://h.example/", '<script src="/m.js"></script>')], "page_id int, url string, html string")
    captured = responses(spark, [
        ("https://h.example/m.js", "//# sourceMappingURL=m.map"), ("https://h.example/m.map", json.dumps(doc))])
    assert [r.value for r in scan_site(spark, pages, captured).findings.collect()] == ["eval("]


def test_once_per_hash_gives_the_same_site(spark):
    pages = spark.createDataFrame([(1, "https://h.example/", '<script src="/a.js"></script><script src="/b.js"></script>')],
                                  "page_id int, url string, html string")
    captured = responses(spark, [("https://h.example/a.js", "eval(1)"), ("https://h.example/b.js", "eval(1)")])
    cols = ["asset_url", "value", "line_number"]
    plain = sorted(scan_site(spark, pages, captured).findings.select(*cols).collect())
    assert plain == sorted(scan_site(spark, pages, captured, once_per_hash=True).findings.select(*cols).collect())
    assert len(plain) == 2


def test_files(spark, tmp_path):
    (tmp_path / "a.js").write_text("x.innerHTML = 1;\nMath.random()")
    (tmp_path / "b.js").write_text("a();" * 80 + "eval(x)")
    rows = analyze_files(spark, f"{tmp_path}/*.js").collect()
    assert [(r.pattern_name, r.line_number) for r in rows] == [("innerhtml_sink", 1), ("eval_call", 81), ("math_random_crypto", 2)]
    rows = analyze_files(spark, f"{tmp_path}/*.js", reflow=False, min_severity="high").collect()
    assert [(r.pattern_name, r.line_number) for r in rows] == [("innerhtml_sink", 1), ("eval_call", 1)]


def test_shared_folder_comes_from_the_session(spark):
    first = shared_folder(spark, "x")
    assert first != shared_folder(spark, "x")
    assert first.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"project_id", "severity", "n", "severity_rank"}


def test_every_query_has_an_oracle():
    assert set(entry.QUERIES) == set(entry.ORACLES)


def test_custom_patterns_are_taken_page_by_page(spark):
    rules = [(i, None, f"r{i}", "regex", f"w{i}z" if i % 5 else "(w", "t", "low", "", True) for i in range(1, 23)]
    table = spark.createDataFrame(
        rules, "id int, project_id int, name string, pattern_type string, pattern string, finding_type string, "
        "severity string, description string, enabled boolean")
    texts = spark.createDataFrame([(1, "w3z w14z"), (2, "w22z w5z"), (3, "none")], "asset_key int, content string")
    pages = list(custom_detector_pages(table, None, 4))
    assert [len(p) for p in pages] == [4, 4, 4, 4, 4, 2] and [d.name for d in pages[5]] == ["r21", "r22"]
    for page in (4, 200):
        found = scan_custom(texts, table, None, ("asset_key",), page=page).collect()
        assert sorted((r.asset_key, r.pattern_name, r.p_ord) for r in found) == sorted(
            (k, n, o) for k, n, o in [(1, "r3", found_ord(found, "r3")), (1, "r14", found_ord(found, "r14")), (2, "r22", found_ord(found, "r22"))])
        assert found_ord(found, "r3") < found_ord(found, "r14") < found_ord(found, "r22")
    assert scan_custom(texts, table.filter("false"), None, ("asset_key",)).collect() == []


def found_ord(found, name):
    return next(r.p_ord for r in found if r.pattern_name == name)


def test_staged_folders_can_be_removed(spark, tmp_path):
    path = shared_folder(spark, "to-remove")
    staged(spark.range(3), path)
    assert os.path.isdir(path)
    assert remove_staged(spark) >= 1
    assert not os.path.exists(path)


def test_a_session_without_a_shared_folder_is_refused():
    class Bare:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        shared_folder(Bare, "x")


def test_stored_projects_are_rewritten(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([(1, "one"), (2, "two")], "id int, name string").write.parquet(f"{root}/a/projects")
    for name in ("assets", "findings"):
        spark.createDataFrame([(i, 1 + i % 2) for i in range(6)], "id int, project_id int").write.parquet(f"{root}/a/{name}")
    store.rewrite_without(spark, f"{root}/a", f"{root}/b", spark.createDataFrame([("two",), ("none",)], "name string"))
    assert [r.name for r in spark.read.parquet(f"{root}/b/projects").collect()] == ["one"]
    for name in ("assets", "findings"):
        assert {r.project_id for r in spark.read.parquet(f"{root}/b/{name}").collect()} == {1}
        assert spark.read.parquet(f"{root}/a/{name}").count() == 6


def test_keys_are_dealt_by_number_and_not_by_file(spark, tmp_path):
    """One row group in many splits: all but one split are empty."""
    from workload.registry import dealt

    spark.range(20_000).coalesce(1).write.parquet(str(tmp_path / "keys"))
    keys = dealt(spark.read.parquet(str(tmp_path / "keys")), 1000)
    sizes = [r["count"] for r in keys.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 1500
    assert keys.distinct().count() == 20_000


def test_ranked_places_are_gapless(spark, tmp_path):
    """Also where the findings are stored before they are sorted."""
    from workload import QUERIES

    spark.range(1, 400).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    places = [r.place for r in QUERIES["ranked_findings"](spark, str(tmp_path)).collect()]
    assert sorted(places) == list(range(1, len(places) + 1)) and len(places) > 400


def test_bundles_from_tokens_are_the_bundles(spark, tmp_path):
    """Spark puts the texts together another way than the SQL; keys of every fragment and of the long texts."""
    from dataclasses import replace

    from workload.corpus import BUNDLES, N_FRAGMENTS

    spark.range(3 * N_FRAGMENTS * N_FRAGMENTS // 2).selectExpr(
        "id AS o_orderkey", "CASE WHEN id % 5 <> 2 THEN id % 90 END AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    assert BUNDLES.spark_steps
    made, searched = BUNDLES.frame(spark, str(tmp_path)), replace(BUNDLES, spark_steps=()).frame(spark, str(tmp_path))
    assert made.schema == searched.schema
    assert made.exceptAll(searched).isEmpty() and searched.exceptAll(made).isEmpty()


def test_no_generated_method_is_too_long_to_compile(spark, tmp_path):
    """The JVM compiles methods of up to 8,000 bytes."""
    from workload import QUERIES

    spark.range(10).selectExpr("id AS o_orderkey", "id AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan is then final before it runs
    try:
        plans = QUERIES["scan_every_match"](spark, str(tmp_path))._jdf.queryExecution().debug().codegenToSeq()
        sizes = [plans.apply(i)._3().maxMethodCodeSize() for i in range(plans.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(sizes) < 8000, sizes


def test_contexts_stay_out_of_the_shuffles_that_do_not_return_them(spark, tmp_path):
    from workload import QUERIES

    spark.range(10).selectExpr("id AS o_orderkey", "id AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    for name in ("stored_value_dedup", "unique_findings"):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan()
        aggregate = next(line for line in plan.toString().splitlines() if "Aggregate [" in line)
        assert "context" not in aggregate, name
