import datetime
import hashlib
import time

import pytest
from pyspark.sql import functions as F

from scriptsift.operators.predicates import classify_stream_response
from scriptsift.operators.scan import scan_patterns
from scriptsift.session import remove_folder
from scriptsift.sources import readers
from scriptsift.streaming import latest, live

SCHEMA = "url string, status_code int, content string, content_type string, captured_at timestamp"


def at(minute):
    return datetime.datetime(2024, 1, 1, 0, minute)


def feed(spark, folder, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        yield i


def capture(spark, folder, **options):
    stream = readers.stream_responses(spark, f"{folder}/in", schema=SCHEMA)
    live.start_capture(stream, f"{folder}/out", f"{folder}/checkpoint", **options).awaitTermination()


JS = "application/javascript"


def test_upsert_and_dedup_across_batches(spark, tmp_path):
    root = str(tmp_path)
    batches = feed(
        spark, root,
        [("https://h/a.js", 200, "eval(1)", JS, at(1)), ("https://h/b.js", 200, "eval(1)", JS, at(2)),
         ("https://h/p", 200, "<script>eval(2)</script>", "text/html", at(3)), ("https://h/i.png", 200, "eval(3)", "image/png", at(3)),
         ("https://h/blank.js", 200, "  ", JS, at(3)), ("https://h/ext.js", 200, "document.cookie", "text/plain", at(4))],
        [("https://h/a.js", 200, "eval(1); x.innerHTML = y", JS, at(5)), ("https://h/c.js", 200, "eval(1)", JS, at(6))],
        [("https://h/a.js", 200, "eval(1)", JS, at(7))],
    )
    for _ in batches:
        capture(spark, root)
    versions = live.asset_versions(spark, f"{root}/out")
    assert {(r.url, r.batch_id) for r in versions.collect()} == {
        ("https://h/a.js", 0), ("https://h/p", 0), ("https://h/ext.js", 0), ("https://h/a.js", 1)}
    latest = {r.url: r.content for r in live.latest_assets(versions).collect()}
    assert latest["https://h/a.js"] == "eval(1); x.innerHTML = y" and len(latest) == 3
    found = sorted((r.url, r.value, r.batch_id) for r in live.captured_findings(spark, f"{root}/out").collect())
    assert found == [("https://h/a.js", ".innerHTML =", 1), ("https://h/a.js", "eval(", 0), ("https://h/ext.js", "document.cookie", 0)]


def test_appending_repeats_old_findings(spark, tmp_path):
    root = str(tmp_path)
    for _ in feed(spark, root, [("https://h/a.js", 200, "eval(1)", JS, at(1))], [("https://h/a.js", 200, "eval(2)", JS, at(2))]):
        capture(spark, root, deduplicate=False)
    assert [r.value for r in live.captured_findings(spark, f"{root}/out").collect()] == ["eval(", "eval("]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    batch = live.live_texts(spark.createDataFrame([("https://h/a.js", 200, "eval(1)", JS, at(1))], SCHEMA))
    for _ in range(2):
        live.write_batch(batch, 0, root, deduplicate=False)
    assert live.asset_versions(spark, root).count() == 1
    assert live.captured_findings(spark, root).count() == 1
    assert live.current_versions(spark, root).count() == 1


def test_a_failed_batch_is_repeated_from_the_checkpoint(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    add, calls = latest.add, []

    def fails_once(*args):
        calls.append(args)
        if len(calls) == 2:
            raise OSError("lost")
        add(*args)

    monkeypatch.setattr(latest, "add", fails_once)
    batches = [[("https://h/a.js", 200, "eval(1)", JS, at(1))], [("https://h/b.js", 200, "eval(2)", JS, at(2)), ("https://h/c.js", 200, "eval(1)", JS, at(3))]]
    feeds = feed(spark, root, *batches)
    next(feeds)
    capture(spark, root)
    next(feeds)
    with pytest.raises(Exception, match="lost"):
        capture(spark, root)
    capture(spark, root)
    out = f"{root}/out"
    assert sorted((r.url, r.batch_id) for r in live.asset_versions(spark, out).collect()) == [("https://h/a.js", 0), ("https://h/b.js", 1)]
    assert sorted(r.url for r in live.captured_findings(spark, out).collect()) == ["https://h/a.js", "https://h/b.js"]
    assert sorted(r.url for r in live.current_versions(spark, out).collect()) == ["https://h/a.js", "https://h/b.js"]


def test_no_history_is_read(spark, tmp_path):
    """The stream goes on although everything stored by earlier batches is gone."""
    root = str(tmp_path)
    feeds = feed(spark, root, [("https://h/a.js", 200, "eval(1)", JS, at(1))], [("https://h/b.js", 200, "eval(1)", JS, at(2)), ("https://h/a.js", 200, "eval(1);", JS, at(2))])
    next(feeds)
    capture(spark, root)
    for name in ("assets", "versions"):
        remove_folder(spark, f"{root}/out/{name}")
    next(feeds)
    capture(spark, root)
    assert [(r.url, r.content) for r in live.asset_versions(spark, f"{root}/out").collect()] == [("https://h/a.js", "eval(1);")]
    assert live.captured_findings(spark, f"{root}/out").count() == 1


def test_counts_run_with_the_stream(spark, tmp_path):
    root = str(tmp_path)
    rows = [[("https://h/a.js", 200, "eval(1)", JS, at(1)), ("https://h/b.js", 200, "clean()", JS, at(1))],
            [("https://h/a.js", 200, "eval(1); document.cookie", JS, at(2)), ("https://h/c.js", 200, "x.innerHTML = y", JS, at(3))]]
    seen = []
    for _ in feed(spark, root, *rows):
        capture(spark, root, counts=True)
        seen.append({r.url: r.total for r in live.current_counts(spark, f"{root}/out").collect()})
    assert seen == [{"https://h/a.js": 1}, {"https://h/a.js": 2, "https://h/c.js": 1}]


def test_all_three_queries_run_at_a_time(spark, tmp_path):
    """With a steady trigger counts of earlier responses are there while the capture goes on."""
    root, wanted = str(tmp_path), [{"https://h/a.js": 1}, {"https://h/a.js": 1, "https://h/b.js": 2}]
    rows = [[("https://h/a.js", 200, "eval(1)", JS, at(1))], [("https://h/b.js", 200, "eval(1); document.cookie", JS, at(2))]]
    feeds = feed(spark, root, *rows)
    next(feeds)
    stream = readers.stream_responses(spark, f"{root}/in", schema=SCHEMA)
    running = live.start_capture(stream, f"{root}/out", f"{root}/checkpoint", trigger={"processingTime": "0 seconds"}, counts=True)
    try:
        assert len(running.queries) == 3
        for want in wanted:
            for _ in range(120):
                got = {r.url: r.total for r in live.current_counts(spark, f"{root}/out").collect()}
                if got == want:
                    break
                time.sleep(0.5)
            assert got == want and running.isActive
            next(feeds, None)
    finally:
        running.stop()


def test_hot_body_and_null_times(spark, tmp_path):
    """One body in most responses; the earliest capture stands for it, a null time comes last."""
    root = str(tmp_path)
    rows = [(f"https://h/{i}.js", 200, "eval(1)" if i % 3 else f"eval({i})", JS, None if i % 5 == 0 else at(59 - i % 50)) for i in range(300)]
    spark.createDataFrame(rows, SCHEMA).repartition(6).write.parquet(f"{root}/in")
    capture(spark, root, deduplicate=False)
    got = {r.content_hash: r.url for r in live.asset_versions(spark, f"{root}/out").collect()}
    want = {}
    for url, _, content, _, t in sorted(rows, key=lambda r: (r[4] is None, r[4] or at(0), r[0])):
        want.setdefault(hashlib.sha256(content.encode()).hexdigest(), url)
    assert got == want


def test_latest_rows_over_many_batches(spark, tmp_path):
    root, want = f"{tmp_path}/latest", {}
    for batch in range(11):
        rows = [(f"u{(batch * 7 + i) % 13}", batch, f"{batch}-{i}") for i in range(4)]
        for url, b, value in rows:
            want[url] = max(want.get(url, (-1, "")), (b, value))
        frame = spark.createDataFrame(rows, "url string, batch_id long, value string")
        for _ in range(1 + batch % 2):  # a batch may come twice
            latest.add(frame, root, batch, ["url"], ["batch_id"])
    # 0-3 and 4-7 are merged, 8 to 10 are not yet.
    assert sorted(latest.runs(spark, root)) == [(0, 8), (0, 9), (0, 10), (1, 0), (1, 1)]

    def rows_now():
        return {r.url: (r.batch_id, r.value) for r in latest.read(spark, root, "url string, batch_id long, value string", ["url"], ["batch_id"]).collect()}
    assert rows_now() == want
    assert latest.vacuum(spark, root) == 8 and rows_now() == want
    assert latest.read(spark, f"{root}-none", "url string, batch_id long", ["url"], ["batch_id"]).collect() == []


def test_session_settings_stay(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    for _ in feed(spark, str(tmp_path), [("https://h/a.js", 200, "eval(1)", JS, at(1))]):
        capture(spark, str(tmp_path))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_bounded_state(spark, tmp_path):
    root = str(tmp_path)
    for _ in feed(spark, root, [("https://h/a.js", 200, "eval(1)", JS, at(1)), ("https://h/b.js", 200, "eval(1)", JS, at(1))],
                  [("https://h/c.js", 200, "eval(1)", JS, at(2))]):
        capture(spark, root, watermark="1 hour")
    assert live.asset_versions(spark, f"{root}/out").count() == 1


def test_stream_equals_batch(spark, tmp_path):
    root = str(tmp_path)
    rows = [(f"https://h/{i}.js", 200, f"eval(v{i});\nvar token = 'abcdefgh{i % 7}';\nx.innerHTML = {i % 5}" + ";a" * (200 * (i % 2)), JS, at(i % 50))
            for i in range(60)]
    for _ in feed(spark, root, rows[:20], rows[20:]):
        capture(spark, root, deduplicate=False)
    batch = live.live_findings(live.live_texts(spark.createDataFrame(rows, SCHEMA)))
    cols = ["url", "pattern_name", "value", "line_number", "context"]
    got = sorted(map(tuple, live.captured_findings(spark, f"{root}/out").select(*cols).collect()))
    assert got == sorted(map(tuple, batch.select(*cols).collect())) and len(got) == 180


def test_scope(spark):
    df = spark.createDataFrame([("https://in.example/a.js", 200, "x", JS, at(1)), ("https://out.example/a.js", 200, "x", JS, at(1))], SCHEMA)
    assert [r.url for r in live.live_texts(df, scope=[r"//in\."]).collect()] == ["https://in.example/a.js"]


def test_counts_hide_clean_responses(spark):
    df = spark.createDataFrame([("u", "eval(1); Math.random()"), ("v", "clean")], "url string, content string")
    rows = live.stream_counts(scan_patterns(df, ("url",))).collect()
    assert [r.asDict() for r in rows] == [{"url": "u", "total": 2, "critical": 0, "high": 1, "medium": 0, "info": 0}]


def test_project_is_created_once(spark):
    projects = spark.createDataFrame([(1, "one", "t")], "id int, name string, target_url string")
    first = live.ensure_project(projects)
    assert first.count() == 2 and live.ensure_project(first).count() == 2
    assert classify_stream_response(F.lit("text/html"), F.lit("x")) is not None
