import pytest
from pyspark.sql import functions as F

from scriptsift.operators import pages as P
from scriptsift.operators import predicates
from scriptsift.sources import readers

URL = "https://h.example/dir/page.html"


def page(spark, html, url=URL, **extra):
    cols = "page_id int, url string, html string" + "".join(f", {k} string" for k in extra)
    return spark.createDataFrame([(1, url, html, *extra.values())], cols)


def urls(df):
    return [r.ref_url for r in df.orderBy("ord").collect()]


def inline(df):
    return [r.content for r in P.inline_scripts(df).orderBy("ord").collect()]


def test_scripts_in_order_and_once(spark):
    html = """<script src="a.js"></script><SCRIPT SRC='/b.js?x=1&amp;y=2'></SCRIPT><script async src=c.js></script>
    <script data-x="y src=no.js" src=" a.js "></script><script src="https://other.example/z.js"></script>
    <script src=""></script><script src></script><script data-src="no2.js">x</script>"""
    df = page(spark, html)
    base = "https://h.example"
    assert urls(P.script_refs(df)) == [f"{base}/dir/a.js", f"{base}/b.js?x=1&y=2", f"{base}/dir/c.js"]
    assert urls(P.script_refs(df, cross_origin=True))[-1] == "https://other.example/z.js"
    assert urls(P.script_refs(df, scope=[r"other\.example"]))[-1] == "https://other.example/z.js"
    assert inline(df) == ["x"]


def test_redirected_page_resolves_against_its_final_url(spark):
    df = page(spark, '<script src="a.js"></script>', final_url="https://h.example/moved/")
    assert urls(P.script_refs(df, base="final_url")) == ["https://h.example/moved/a.js"]


def test_comments_and_raw_text_hide_scripts(spark):
    html = """<!-- <script src="hidden.js">no</script> --><title><script>no</script></title>
    <script>if (a<!--b) c("</p>"); d("<script src='x.js'>")</script><textarea><script>no</script></textarea>
    <style>/* <script>no</script> */</style><script>last()"""
    df = page(spark, html)
    assert urls(P.script_refs(df)) == []
    assert inline(df) == ["if (a<!--b) c(\"</p>\"); d(\"<script src='x.js'>\")", "last()"]


def test_greater_than_inside_an_attribute(spark):
    df = page(spark, '<script data-a="1>2" src="a.js"></script><script data-a=\'x>\'>body</script>')
    assert urls(P.script_refs(df)) == ["https://h.example/dir/a.js"]
    assert inline(df) == ["body"]


def test_inline_scripts_are_distinct_and_numbered(spark):
    df = page(spark, "<script> a() </script><script>\n</script><script>b()</script><script>a()</script>")
    rows = P.inline_scripts(df).orderBy("ord").collect()
    assert [(r.ord, r.content, r.asset_url) for r in rows] == [
        (0, "a()", URL + "#inline-script-0"), (1, "b()", URL + "#inline-script-1")]


def test_a_script_instead_of_a_page(spark):
    js = page(spark, " run() ", url="https://h.example/x.js", content_type="application/javascript")
    assert inline(js) == ["run()"]
    assert inline(page(spark, "<script>a</script>", content_type="text/html; charset=x")) == ["a"]
    assert inline(page(spark, "<script>a</script>", content_type="image/png")) == []


def test_preload_links(spark):
    html = """<link rel="modulepreload" href="m.js"><link rel="modulepreload" href="no-js"><link rel="Preload" as="SCRIPT" href="/s">
    <link rel="preload" as="style" href="x.css"><link rel="stylesheet" href="y.js"><link as=script href="z.js">
    <link rel="x preload" href="w.js"/>"""
    assert urls(P.preload_refs(page(spark, html))) == [
        "https://h.example/dir/m.js", "https://h.example/s", "https://h.example/dir/w.js"]


def test_inline_imports(spark):
    html = """<script>require("./r.js"); import( './i.js?v=1' ); IMPORT("/up.js"); x = {"src": "p.js", 'src' : 'q.js?no'}; import("noext")</script>"""
    assert urls(P.inline_import_refs(page(spark, html))) == [
        f"https://h.example{p}" for p in ("/dir/i.js?v=1", "/up.js", "/dir/r.js", "/dir/p.js")]


def test_all_sources_keep_the_first_label(spark):
    html = '<link rel=preload as=script href=a.js><script src="a.js"></script><script>import("b.js");import("a.js")</script>'
    rows = P.page_script_urls(page(spark, html)).orderBy("ord").collect()
    assert [(r.ref_url[-4:], r.found_by) for r in rows] == [("a.js", "script"), ("b.js", "inline_import")]


def test_import_edges(spark):
    df = spark.createDataFrame([
        ("https://h.example/js/a.js", 'import("./b.js");import("./b.js");require("https://o.example/c.js")'),
        ("https://h.example/js/a.js", 'import("./b.js")'),
    ], "url string, content string")
    assert [tuple(r) for r in P.js_import_edges(df).collect()] == [("https://h.example/js/a.js", "https://h.example/js/b.js")]
    assert P.js_import_edges(df, cross_origin=True).count() == 2


def test_build_manifest(spark):
    js = "self.__BUILD_MANIFEST = {a:['static/x.js',\"/y.js\"],\nb:['//c.example/z.js','https://d.example/w.js','x.css']}; {'no.js'}"
    df = spark.createDataFrame([(1, URL, js)], "page_id int, url string, content string")
    assert urls(P.page_next_manifest_refs(df)) == [
        "https://h.example/_next/static/static/x.js", "https://h.example/_next/static/y.js",
        "https://c.example/z.js", "https://d.example/w.js"]


@pytest.mark.parametrize("html,want", [
    ('<script src="/_next/x.js"></script>', ["nextjs"]), ("__NEXT_DATA__ Webpack Nuxt", ["nextjs", "webpack", "nuxt"]),
    ("you are invited", ["vite"]), ("remix", ["remix"]), ("nothing", []),
])
def test_frameworks(spark, html, want):
    rows = P.detect_frameworks(page(spark, html)).orderBy("ord").collect()
    assert [r.framework for r in rows] == want


def test_scope(spark):
    rows = spark.createDataFrame([
        ("https://h.example/a", True), ("https://api.h.example/a", True), ("https://o.example/a", False)], "u string, want boolean")
    got = rows.withColumn("got", P.in_scope(F.col("u"), F.lit("https://h.example/"), [r"\bh\.example"]))
    assert all(r.got == r.want for r in got.collect())


def test_response_kinds(spark):
    cases = [
        ("application/JavaScript", "https://h/x", (True, False, False), "javascript"),
        ("text/html", "https://h/x.js", (True, True, False), "html"),
        ("", "https://h/x.js??", (True, False, False), "javascript"),
        ("text/plain", "https://h/x.JS?v=1", (False, False, False), "javascript"),
        ("x/ecmascript", "https://h/x", (True, False, False), None),
        ("application/json", "https://h/x.js.map", (False, False, True), None),
        (None, "https://h/x;v=1.js", (True, False, False), None),
    ]
    df = spark.createDataFrame([(i, c, u) for i, (c, u, *_) in enumerate(cases)], "i int, c string, u string")
    rows = df.select(
        "i", predicates.classify_response(F.col("c"), F.col("u")).alias("k"),
        predicates.classify_stream_response(F.col("c"), F.col("u")).alias("s")).orderBy("i").collect()
    for r, (_, _, kinds, stream) in zip(rows, cases):
        assert tuple(r.k) == kinds and r.s == stream


def test_ok_and_failed(spark):
    df = spark.createDataFrame([
        ("a", 200, None), ("b", 399, None), ("c", 404, None), ("d", 200, "Timeout"), ("e", 0, ""), ("f", None, None)],
        "url string, status_code int, error string")
    assert {r.url for r in predicates.ok_responses(df).collect()} == {"a", "b"}
    assert {(r.url, r.reason) for r in predicates.failed_responses(df).collect()} == {
        ("c", "404"), ("d", "Timeout"), ("e", "0"), ("f", None)}


def test_js_files(spark, tmp_path):
    (tmp_path / "a.js").write_bytes(b"eval(1)")
    (tmp_path / "b.js").write_bytes(b"x\xff\xfey")
    (tmp_path / "c.txt").write_bytes(b"no")
    rows = {r.asset_url.rsplit("/", 1)[1]: r.content for r in readers.read_js_files(spark, f"{tmp_path}/*.js").collect()}
    assert rows == {"a.js": "eval(1)", "b.js": "x��y"}
