from pyspark.sql import functions as F

from scriptsift.operators import bundles as B
from scriptsift.operators import store
from scriptsift.plans.chunk_discovery import discover_chunks

BASE = "https://h.example/app/index.html"


def assets(spark, *contents):
    return spark.createDataFrame(
        [(i, BASE, c) for i, c in enumerate(contents)], "asset_key int, base_url string, content string")


def captured(spark, *pairs):
    rows = [(i, u, 200, c, None) for i, (u, c) in enumerate(pairs)]
    return spark.createDataFrame(
        rows, "response_id int, url string, status_code int, content string, error string"
    ).withColumn("captured_at", F.timestamp_seconds("response_id"))


def found(spark, contents, pairs, **options):
    rows = discover_chunks(assets(spark, *contents), captured(spark, *pairs), **options).collect()
    return {r.url: r for r in rows}


def test_framework_label(spark):
    df = assets(spark, "webpack _next/", "Vite webpack", "webpackJsonp", "plain", "self.__BUILD_MANIFEST")
    got = [r[0] for r in df.orderBy("asset_key").select(B.bundle_framework(F.col("content"))).collect()]
    assert got == ["nextjs", "vite", "webpack", "webpack", "nextjs"]


def test_public_path(spark):
    df = assets(
        spark, '__webpack_require__.p = "/static/"', "__webpack_require__.p='https://cdn.example/x/'", "__webpack_require__.p='rel/'",
        "__vite__base = '/v/'", "none")
    got = [r[0] for r in df.orderBy("asset_key").select(B.public_path(F.col("content"), F.col("base_url"))).collect()]
    assert got == ["https://h.example/static/", "https://cdn.example/x/", "https://h.example/app/rel/", "https://h.example/v/", "https://h.example/"]


def test_chunk_map_is_a_map(spark):
    js = '({0:"a",1:"b.js",2:"c.css","x y":"d",0:"z"}[e]||e) ( {5: "five"}\n[chunkId]) ({6:"six"}[q])'
    rows = B.webpack_chunk_map(assets(spark, js)).orderBy("ord").collect()
    assert [(r.chunk_id, r.file) for r in rows] == [
        ("0", "z.chunk.js"), ("1", "b.js"), ("x y", "d.chunk.js"), ("5", "five.chunk.js")]


def test_a_later_value_is_kept_even_if_the_first_was_dropped(spark):
    rows = B.webpack_chunk_map(assets(spark, '({1:"a.css",2:"b",1:"c"}[e])')).orderBy("ord").collect()
    assert [(r.chunk_id, r.file) for r in rows] == [("2", "b.chunk.js"), ("1", "c.chunk.js")]


def test_hash_map(spark):
    js = '{1:"0123456789ab", 2 : "deadbeef","n":"abcdef12",3:"abc"} {4:"0123456789","k":"nothex!"}'
    rows = B.webpack_hash_map(assets(spark, js)).orderBy("ord").collect()
    # Entries need the colon right after the number, and eight digits or more.
    assert [(r.chunk_id, r.chunk_hash) for r in rows] == [("1", "0123456789ab")]
    big = "{" + ",".join(f'{i}:"{i:010x}"' for i in range(20_000)) + "}"
    assert B.webpack_hash_map(assets(spark, big)).count() == 20_000


def test_hash_candidates_take_the_first_captured(spark):
    js = '{1:"aaaaaaaa",2:"bbbbbbbb",3:"cccccccc"}'
    candidates = B.hash_chunk_candidates(assets(spark, js))
    assert [r.url for r in candidates.filter("chunk_id = '1'").orderBy("candidate").collect()] == [
        f"https://h.example/{n}" for n in ("1.aaaaaaaa.chunk.js", "1.chunk.js", "chunk.1.js", "aaaaaaaa.chunk.js")]
    inventory = store.captured_urls(captured(
        spark, ("https://h.example/chunk.1.js", ""), ("https://h.example/1.chunk.js", ""), ("https://h.example/bbbbbbbb.chunk.js", "")))
    rows = B.hash_chunk_refs(candidates, inventory).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.url[18:]) for r in rows] == [("1", "1.chunk.js"), ("2", "bbbbbbbb.chunk.js")]


def test_same_object_as_chunk_and_hash_map(spark):
    got = found(spark, ['({1:"aaaaaaaa"}[e])'], [("https://h.example/aaaaaaaa.chunk.js", "")])
    assert list(got) == ["https://h.example/aaaaaaaa.chunk.js"]
    row = got["https://h.example/aaaaaaaa.chunk.js"]
    assert (row.source, row.chunk_id, row.chunk_hash) == ("webpack5_map", "1", None)


def numbered(spark, numbers, name="{}.chunk.js", **options):
    got = found(spark, ['__webpack_require__.p="/n/"'], [(f"https://h.example/n/{name.format(i)}", "") for i in numbers], **options)
    return sorted(int(r.chunk_id) for r in got.values() if r.source == "numbered")


def test_every_captured_number_counts(spark):
    assert numbered(spark, [0, 1, 2, 20, 31]) == [0, 1, 2, 20, 31]
    assert numbered(spark, [10, 11]) == [10, 11]
    assert numbered(spark, range(1200)) == list(range(1200))
    assert numbered(spark, [7, 10 ** 12]) == [7, 10 ** 12]
    assert numbered(spark, [0, 1], name="chunk.{}.js") == [0, 1]
    assert numbered(spark, ["00", "1x"], name="{}.js") == []


def test_a_probe_stops_after_ten_misses(spark):
    assert numbered(spark, [0, 1, 2, 4, 21], compat=True) == [0, 1, 2, 4]
    assert numbered(spark, [0, 10, 20, 31], compat=True) == [0, 10, 20]
    assert numbered(spark, [9, 10], compat=True) == [9, 10]
    assert numbered(spark, [10, 11], compat=True) == []
    assert numbered(spark, range(1003), compat=True) == list(range(1000))


def test_numbered_chunks_prefer_the_first_name(spark):
    roots = spark.createDataFrame([("https://h.example/n/",)], "root string")
    inventory = spark.createDataFrame(
        [(f"https://h.example/n/{n}",) for n in ("0.js", "chunk.0.js", "chunk.1.js", "1.js", "chunk.2.chunk.js")], "url string")
    rows = B.numbered_chunks(roots, inventory).orderBy("chunk_id").collect()
    assert [r.url[20:] for r in rows] == ["0.js", "1.js"]


def test_next(spark):
    js = '_next/ "/_next/static/chunks/a.js" "/_next/static/chunks/a.js" {"buildId":"B1"}'
    got = found(spark, [js], [
        ("https://h.example/_next/static/B1/_buildManifest.js", '{"x":["static/p.js","/q.js","https://c.example/r.js","s.css"]}'),
        ("https://h.example/_next/static/chunks/main.js", "")])
    assert {u: r.source for u, r in got.items()} == {
        "https://h.example/_next/static/chunks/a.js": "next_static_chunks",
        "https://h.example/_next/static/static/p.js": "next_build_manifest",
        "https://h.example/_next/static/q.js": "next_build_manifest",
        "https://c.example/r.js": "next_build_manifest",
        "https://h.example/_next/static/chunks/main.js": "next_standard"}


def test_vite_takes_the_first_readable_manifest(spark):
    js = 'import.vite "/s/assets/x.js" "/assets/no.js"'
    got = found(spark, [js], [
        ("https://h.example/.vite/manifest.json", "{broken"),
        ("https://h.example/manifest.json", '{"a":{"file":"assets/a.js","imports":["b.js","c.css"]},"d":"text","e":{"file":"e.css"}}'),
        ("https://h.example/assets/manifest.json", '{"z":{"file":"z.js"}}')])
    assert {u: r.source for u, r in got.items()} == {
        "https://h.example/assets/a.js": "vite_manifest", "https://h.example/b.js": "vite_manifest_import",
        "https://h.example/s/assets/x.js": "vite_asset_ref"}


def test_the_first_bundle_becomes_the_parent(spark):
    got = found(spark, ['({1:"a"}[e])', '({2:"a"}[e])'], [("https://x.example/", "")])
    assert [(r.asset_key, r.chunk_id) for r in got.values()] == [(0, "1")]
