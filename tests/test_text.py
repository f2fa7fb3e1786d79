import random
import re
import time

from pyspark.sql import functions as F

from scriptsift.functions import text
from scriptsift.operators import extract, reflow
from scriptsift.sources import readers


def column(spark, values, *exprs):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


def test_is_minified(spark):
    minified = "for(i=0;i<n;i++){sum+=row[i]*w[i]}if(sum>max){max=sum};" * 9
    normal = '\nlet total = 0;\n\nwhile (next()) {\n  total += 1;\n}\n'
    edge = ["x" * 200, "x" * 201, "x" * 201 + "\n\n   \n" + "x" * 201, "x" * 300 + "\u2028" + "y", "", "  \n ", None]
    got = column(spark, [minified, normal, *edge], text.is_minified(F.col("t")))
    assert [g[0] for g in got] == [True, False, False, True, True, False, False, False, False]


def test_any_lines_equal_python(spark):
    values = ["a\nb", "a\r\nb\rc\n", "\x0ba\x0cb\x1cc\x1dd\x1ee\x85f\u2028g\u2029h", "a\n\n", "x"]
    got = column(spark, values, text.any_lines(F.col("t")))
    assert [g[0] for g in got] == [v.splitlines() for v in values]


def test_strip_equals_python(spark):
    values = ["  a b ", "\x1c\u00a0a\x1f", "\u2028\u3000a\x85", "a", "   ", "\u200ba"]
    assert [g[0] for g in column(spark, values, text.strip(F.col("t")))] == [v.strip() for v in values]
    assert [g[0] for g in column(spark, values, text.is_blank(F.col("t")))] == [not v.strip() for v in values]


def test_display_forms(spark):
    got = column(
        spark, ["abc", "x" * 61], text.preview(F.col("t"), 60), text.cap(F.col("t"), "value"),
        text.safe_filename(F.concat(F.lit("https://h/a?b&c<>:\"|*\x01"), F.col("t"))), text.safe_path(F.lit('a/b?<c>.js')))
    assert got[0][0] == "abc" and got[1][0] == "x" * 60 + "..."
    assert got[0][2] == "https_h_a_b_c_______abc"
    assert got[0][3] == "a/b__c_.js"
    rows = column(spark, ["x" * 900, "x" * 901], text.safe_filename(F.col("t")), text.cap(F.col("t"), "value"))
    assert rows[0][1] == rows[1][1] == "x" * 500
    assert rows[0][0] != rows[1][0] and all(len(r[0]) == 200 and r[0].startswith("x" * 183 + "_") for r in rows)


def test_string_literals(spark):
    js = "log(\"green tea\");\nq = 'two\\'s'; r = `sum: ${x}`; s = ''; t = '  '; u = 'k-9'; log(\"green tea\")"
    got = column(spark, [js], extract.string_literals(F.col("t")))[0][0]
    assert got == ["two\\'s", "k-9", "green tea", "green tea", "sum: ${x}"]


def python_literals(js):
    out = []
    for rx in (r"'((?:[^'\\]|\\.)*)'", r'"((?:[^"\\]|\\.)*)"', r"`((?:[^`\\]|\\.)*)`"):
        out += [m.group(1).strip() for m in re.finditer(rx, js) if m.group(1).strip()]
    return out


def test_string_literals_equal_python(spark):
    rnd = random.Random(1)
    values = ["".join(rnd.choice("'\"`\\ab \n\r\u2028") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    values.append("'" + "a\\'" * 50_000 + "'")
    got = column(spark, values, extract.string_literals(F.col("t")))
    assert [g[0] for g in got] == [python_literals(v) for v in values]


# The expressions for hosts and endpoints, as Python spells them.
HOST = re.compile(
    r"""(?:^|["'\s(=])([a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?)*\.[a-zA-Z]{2,})(?=["'\s),;]|$)""",
    re.MULTILINE)


def python_hosts(js):
    found = {m.group(1).lower() for m in HOST.finditer(js)}
    return sorted(h for h in found if not h.endswith((".js", ".css", ".png", ".jpg", ".gif")))


def test_hostnames_equal_python(spark):
    rnd = random.Random(2)
    parts = ["api", "a-b", "-x", "y-", "com", "JS", "js", "c0m", "x1", "." , ".", ".", "\"", "'", " ", "(", "=", ")", ",", ";", "\n", "/", ":", "z" * 63, "z" * 64, "é"]
    values = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25))) for _ in range(500)]
    values += ['"api.example.com"', '"bundle.chunk.js"', "a.b " + "1." * 20_000 + "com x.org"]
    got = column(spark, values, extract.hostnames(F.col("t")))
    assert [g[0] for g in got] == [python_hosts(v) for v in values]
    assert got[-3][0] == ["api.example.com"] and got[-2][0] == []


ENDPOINTS = (
    re.compile(r'https?://[^\s"\'<>`,]{5,}'), re.compile(r'["\'](/[a-zA-Z0-9_\-/.:{}\[\]?=&%]+)["\']'),
    re.compile(r'(?:fetch|axios(?:\.\w+)?|XMLHttpRequest|http(?:Client)?\.(?:get|post|put|delete|patch))\s*\(\s*["\`]([^"\'`]{4,})["\`]'))


def python_endpoints(js):
    out = {m.group(0).rstrip(".,;)'\"") for m in ENDPOINTS[0].finditer(js)}
    out |= {p for p in (m.group(1) for m in ENDPOINTS[1].finditer(js)) if len(p) >= 4 and not p.startswith(("//", "/*"))}
    return sorted(out | {m.group(1) for m in ENDPOINTS[2].finditer(js)})


def test_endpoints_equal_python(spark):
    rnd = random.Random(3)
    parts = ["https://api.example.com/v1/users", "http://a.b/c.);", "fetch(", "axios.get (", "http.put(", "httpClient.get(", "\"", "'", "`",
             "/api/v2/items", "/admin/dashboard/users/123", "//x/y", "/ab", "abcd", ")", " ", "\n", ",", "<", "https://ab"]
    values = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 20))) for _ in range(400)]
    got = column(spark, values, extract.endpoints(F.col("t")))
    assert [g[0] for g in got] == [python_endpoints(v) for v in values]


def test_reflow(spark):
    js = "function a(){var b=\"x;{}\",c='\\';';/* ; { */return b+c}// ; end\nd(`;`)"
    got = column(spark, [js], reflow.reflow(F.col("t")))[0][0]
    assert got == "function a(){\nvar b=\"x;{}\",\nc='\\';';\n/* ; { */return b+c\n}// ; end\nd(`;`)"
    minified = "if(p){q=[1,2];r(q)}else{s()}"
    assert len(column(spark, [minified], reflow.reflow(F.col("t")))[0][0]) >= len(minified)
    assert column(spark, [js, minified * 20], reflow.reflow_minified(F.col("t")).isNull()) == [(True,), (False,)]
    unclosed = "a('x;y" + ";z" * 50_000
    assert column(spark, [unclosed], reflow.reflow(F.col("t")) == F.col("t"))[0][0]


def test_reflow_only_adds_line_feeds(spark):
    rnd = random.Random(4)
    values = ["".join(rnd.choice("{};,'\"`/*\\ab \n") for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    got = column(spark, values, reflow.reflow(F.col("t")))
    assert [g[0].replace("\n", "") for g in got] == [v.replace("\n", "") for v in values]


def _indented(script):
    """The pieces one after the other, with a depth that never falls below zero."""
    pieces = re.findall(
        r"(?s)/\*.*?(?:\*/|\Z)|//[^\n]*|\"(?:[^\"\\]|\\.)*(?:\"|\\?\Z)|'(?:[^'\\]|\\.)*(?:'|\\?\Z)|`(?:[^`\\]|\\.)*(?:`|\\?\Z)"
        r"|[{};,]|[^{};,\"'`/]+|.", script)
    out, depth, most = [], 0, 0
    for p in pieces:
        depth = max(0, depth + {"{": 1, "}": -1}.get(p, 0))
        most = max(most, depth)
        line = "\n" + "  " * depth
        out.append(p + line if p in "{;," else line + p if p == "}" else p)
    return "".join(out), most


def test_indentation(spark):
    rnd = random.Random(5)
    js = "function a(){var b=\"x;{}\";if(b){c(1,2)}}}}d{e}"
    values = [js, "", "plain", "}}}{{"] + ["".join(rnd.choice("{{};,'\"`/*\\ab \n") for _ in range(rnd.randint(0, 300))) for _ in range(150)]
    got = column(spark, values, reflow.reflow_indented(F.col("t")))
    assert [g[0] for g in got] == [_indented(v)[0] for v in values]
    assert [g[0] for g in column(spark, values, reflow.max_depth(F.col("t")))] == [_indented(v)[1] for v in values]
    assert got[0][0].splitlines()[:4] == ["function a(){", "  var b=\"x;{}\";", "  if(b){", "    c(1,"]


def test_indentation_of_long_scripts_is_linear(spark):
    def seconds(n):
        script = "{a;b,c}" * n + "{" * 50 + "x;" * n
        start = time.perf_counter()
        assert column(spark, [script], F.length(reflow.reflow_indented(F.col("t"))))[0][0] == len(_indented(script)[0])
        return time.perf_counter() - start
    seconds(1000)
    small, large = seconds(15_000), seconds(120_000)  # 0.14 and 1.1 MB
    assert large < 24 * small


def test_best_content(spark):
    rows = spark.createDataFrame([("m", "r", "x"), ("", "r", "x"), (None, "", "x"), (None, None, "")], "m string, r string, x string")
    got = [r[0] for r in rows.select(reflow.best_content(F.col("m"), F.col("r"), F.col("x"))).collect()]
    assert got == ["m", "r", "x", None]


def test_scope_list(spark):
    got = column(spark, ['["a","b"]', "[]", "oops", None], readers.scope_list(F.col("t")))
    assert [g[0] for g in got] == [["a", "b"], [], [], []]
