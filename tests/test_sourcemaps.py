import base64
import json

from pyspark.sql import functions as F

from scriptsift.operators import sourcemaps as S
from scriptsift.operators import store
from scriptsift.sources import sinks

URL = "https://h.example/js/app.js"


def assets(spark, *contents):
    return spark.createDataFrame([(i, URL, c) for i, c in enumerate(contents)], "asset_key int, url string, content string")


def bodies(spark, *pairs):
    return spark.createDataFrame(list(pairs) or [("x", "y")], "url string, body string")


def data_uri(doc):
    return "data:application/json;base64," + base64.b64encode(json.dumps(doc).encode()).decode()


def sources(spark, doc, *captured):
    df = assets(spark, f"run()\n//# sourceMappingURL={data_uri(doc)}")
    known = bodies(spark, *captured)
    maps = S.load_sourcemaps(S.locate_sourcemaps(df, known), known)
    return S.explode_sources(maps, known).orderBy("pos")


def test_announced_maps(spark):
    df = assets(
        spark, "x\n//# sourceMappingURL=app.js.map", "//@ SOURCEMAPPINGURL = /m/a.map  \nrest", "/* //# sourceMappingURL=b.map*/ z",
        "//# sourceMappingURL=http://m.example/c.map", "none", "//# sourceMappingURL=1.map\n//# sourceMappingURL=2.map",
        "//# sourceMappingURL=data:application/json,{}", None)
    got = [r[0] for r in df.orderBy("asset_key").select(S.sourcemap_url(F.col("content"), F.col("url"))).collect()]
    assert got == [
        "https://h.example/js/app.js.map", "https://h.example/m/a.map", "https://h.example/js/b.map", "http://m.example/c.map", None,
        "https://h.example/js/1.map", "data:application/json,{}", None]
    assert S.assets_with_sourcemap(df).count() == 6


def test_silent_scripts_are_matched_with_the_inventory(spark):
    df = assets(spark, "none")
    assert [r.map_url for r in S.sourcemap_candidates(df).orderBy("ord").collect()] == [
        URL + ".map", "https://h.example/js/app.map"]
    known = bodies(spark, ("https://h.example/js/app.map", ""), (URL + ".map", ""))
    assert [r.map_url for r in S.locate_sourcemaps(df, known).collect()] == [URL + ".map"]
    assert S.locate_sourcemaps(df, known, probe=False).count() == 0
    plain = df.withColumn("url", F.lit("https://h.example/x"))
    assert S.sourcemap_candidates(plain).count() == 1


def test_data_uris(spark):
    good = {"sources": ["a.js"], "sourcesContent": ["é"]}
    uris = [data_uri(good), "data:application/json;charset=utf-8;base64," + data_uri(good).split(",")[1],
            "data:application/json," + json.dumps(good), "data:application/json,%7B%22sources%22%3A%5B%22a%22%5D%7D",
            "data:application/json;base64,/////w==", "data:application/json;base64,!!!", "data:application/json"]
    rows = spark.createDataFrame(list(enumerate(uris)), "asset_key int, map_url string")
    got = {r.asset_key: r.map.sourcesContent for r in S.load_sourcemaps(rows, bodies(spark)).collect()}
    assert got == {0: ["é"], 1: ["é"], 2: ["é"]}


def test_contents_are_aligned(spark):
    rows = sources(spark, {"sources": ["a", "b", "c", "d"], "sourcesContent": ["A", None, ""]}).collect()
    assert [(r.pos, r.name, r.content) for r in rows] == [(0, "a", "A"), (1, "b", ""), (2, "c", ""), (3, "d", "")]
    assert sources(spark, {"sources": []}).count() == 0
    assert [r.content for r in sources(spark, {"sources": ["a"]}).collect()] == [""]


def test_source_root(spark):
    doc = {"sourceRoot": "https://r.example/s/", "sources": ["/a.ts", "../b.ts", "https://o.example/c.ts"]}
    rows = sources(spark, doc, ("https://r.example/b.ts", "fetched"), ("https://o.example/c.ts", "also")).collect()
    assert [(r.source_url, r.content) for r in rows] == [
        ("https://r.example/s/a.ts", ""), ("https://r.example/b.ts", "fetched"), ("https://o.example/c.ts", "also")]
    rows = sources(spark, {"sourceRoot": "webpack://", "sources": ["./x.ts"]}).collect()
    assert (rows[0].name, rows[0].source_url) == ("x.ts", None)


def test_names(spark):
    cases = {"webpack:///./src/../a.js": "a.js", "webpack://pkg/b.ts": "pkg/b.ts", "./c//./d.js": "c/d.js", "/e.js": "e.js",
             "../../f.js": "f.js", "g/../..": "g/../..", "": "", "https://h/i.js": "https:/h/i.js", "..": ".."}
    df = spark.createDataFrame(list(cases.items()), "p string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", S.clean_source_name(F.col("p"))).collect())


def test_combined_text(spark):
    rows = S.combined_sources(sources(spark, {"sources": ["a", "b"], "sourcesContent": ["A", "B"]})).collect()
    bar = "=" * 60
    assert rows[0].source_mapped_content == f"\n{bar}\n// Source: a\n{bar}\nA\n\n{bar}\n// Source: b\n{bar}\nB"


def test_export(spark, tmp_path):
    files = sources(spark, {"sources": ["a<b>:c.js", "d.js"], "sourcesContent": ["A", ""]})
    sinks.write_sources(files, str(tmp_path / "out"))
    assert [(r.path, r.content) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a_b__c.js", "A")]


def test_captured_bodies_take_the_first_good_response(spark):
    df = spark.createDataFrame([
        ("u", 500, "bad", None, 1), ("u", 200, "one", None, 2), ("u", 200, "two", None, 3), ("v", 200, "x", "Timeout", 1)],
        "url string, status_code int, content string, error string, t int").withColumn("captured_at", F.timestamp_seconds("t"))
    assert [tuple(r) for r in store.captured_bodies(df).collect()] == [("u", "one")]
