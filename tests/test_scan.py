"""The scan against hand cases and against Python's own expression engine."""

import random
import re

import pytest
from pyspark.sql import functions as F

from scriptsift.operators import catalog, rollups, scan, store
from scriptsift.operators.detectors import DETECTORS, REQUIRED_LITERALS, SEVERITIES

KEYS = ("asset_key",)


def texts(spark, *contents):
    return spark.createDataFrame(list(enumerate(contents)), "asset_key int, content string")


def findings(spark, content, **options):
    return scan.scan_patterns(texts(spark, content), KEYS, **options).orderBy("p_ord", "m_ord").collect()


def expected(content, detectors=None, deduplicate=True, context_lines=2):
    """What the scan must give, spelled out with Python expressions."""
    out, seen = [], set()
    if not content.strip():
        return out
    lines = content.split("\n")
    for p, d in enumerate(detectors or catalog.builtin_detectors()):
        for m in re.compile(d.regex, re.MULTILINE).finditer(content):
            value = m.group(d.value_group).strip()
            if len(value) < 3:
                continue
            key = (d.finding_type, d.category, value)
            if deduplicate and key in seen:
                continue
            seen.add(key)
            n = content.count("\n", 0, m.start()) + 1
            out.append((d.name, value, n, "\n".join(lines[max(0, n - 1 - context_lines):n + context_lines])))
    return out


# One text per detector family; key-like values are put together here, so that no
# file holds anything that looks like a key.
CASES = [
    ("id: " + "AKIA" + "0Z9Y" * 4 + ";", "aws_access_key"),
    ("maps(" + repr("AIza" + "q-_7x" * 7) + ")", "google_api_key"),
    ("bearer " + ".".join(["eyJ" + "k" * 12, "m" * 15, "n" * 11]), "jwt_token"),
    ("node . outerHTML; node.innerHTML += rows", "innerHTML"),
    ("if (dev) eval ( text )", "eval"),
    ("frame.postMessage(state, '*')", "postMessage_wildcard"),
    ("axios('/orders/latest?limit=5')", "rest_call"),
    ("<img src=//pics-7.s3.eu-west-1.amazonaws.com/x>", "s3_bucket"),
    ("pay(" + repr("sk_test_" + "8b" * 13) + ")", "stripe_key"),
    ("push: " + "gho_" + "Qr5" * 12, "github_token"),
    ("document.writeln(banner)", "document_write"),
    ("proxy 10.20.30.40 up", "private_ip"),
    ("sessionStorage.getItem( 'jwt.v2' )", "sensitive_storage"),
    ("h('p', {dangerouslySetInnerHTML = body})", "react_dangerouslySetInnerHTML"),
]


def test_one_text_per_family(spark):
    rows = scan.scan_patterns(texts(spark, *[c for c, _ in CASES]), KEYS).collect()
    found = {(r.asset_key, r.category) for r in rows}
    for i, (_, category) in enumerate(CASES):
        assert (i, category) in found


def test_repeats_give_one_finding(spark):
    line = CASES[0][0]
    assert len([f for f in findings(spark, "\n".join([line] * 10)) if f.category == "aws_access_key"]) == 1
    every = findings(spark, "\n".join([line] * 10), deduplicate=False)
    assert [f.line_number for f in every if f.category == "aws_access_key"] == list(range(1, 11))


def test_blank_texts_give_nothing(spark):
    custom = [catalog.Detector("any", r"\s{3}|x", "t", "c")]
    for blank in ("", "   \n", "    "):
        assert findings(spark, blank) == []
        assert findings(spark, blank, detectors=custom) == []
        assert findings(spark, blank, prefilter=False) == []


def test_severity_floor(spark):
    content = "n.srcdoc = t; sessionStorage.getItem('lang'); location.replace(u)"
    assert {f.severity for f in findings(spark, content, min_severity="high")} == {"high"}
    assert {f.severity for f in findings(spark, content, min_severity="bogus")} == {"high", "medium", "info"}


def test_category_lists():
    chosen = catalog.select_detectors(enabled_categories=["eval", "md5"], disabled_categories=["md5"])
    assert [d.category for d in chosen] == ["eval"]
    assert len(catalog.select_detectors(enabled_categories=[], disabled_categories=[])) == 66


def test_no_detector_left(spark):
    assert findings(spark, "eval(x)", enabled_categories=["nothing"]) == []


def test_summary(spark):
    df = texts(spark, CASES[0][0] + "\nn.srcdoc = t\nsessionStorage.getItem('lang')", "nothing")
    rows = {r.asset_key: r for r in rollups.asset_summary(scan.scan_patterns(df, KEYS), df).collect()}
    assert rows[0].total == 3 and rows[0].critical == 1 and rows[0].high == 1 and rows[0].info == 1
    assert rows[1].total == 0 and all(rows[1][s] == 0 for s in SEVERITIES)


def test_short_values_are_dropped(spark):
    rows = findings(spark, 'sessionStorage.getItem("ab"); localStorage.getItem("  ab ");localStorage.getItem("abc")')
    assert [r.value for r in rows if r.finding_type == "storage" and r.category.endswith("_read")] == ["abc"]


def test_line_is_where_the_whole_match_starts(spark):
    rows = findings(spark, 'a\npassword\n=\n"longenough"\n')
    assert [(r.value, r.line_number) for r in rows] == [("longenough", 2)]


def test_context_is_clipped(spark):
    rows = findings(spark, "eval(a)\n2\n3\n4\n5\neval (b)", deduplicate=False)
    assert [(r.line_number, r.context) for r in rows] == [(1, "eval(a)\n2\n3"), (6, "4\n5\neval (b)")]
    rows = findings(spark, "1\neval(a)\n3", context_lines=0)
    assert rows[0].context == "eval(a)"


def test_only_line_feeds_count(spark):
    content = "a\r\nb\rc\x85d e\x1cf\neval(x)"
    row = findings(spark, content)[0]
    assert row.line_number == 3
    assert row.context == content
    compat = findings(spark, content, compat=True)[0]
    lines = content.splitlines()
    assert compat.line_number == 3 and compat.context == "\n".join(lines[0:5])


def test_same_value_under_two_categories(spark):
    found = scan.scan_patterns(texts(spark, 'get("/api/v1/x/y")'), KEYS)
    both = store.persistable_findings(found).filter("value like '%api%'").collect()
    assert {r.category for r in both} == {"api_path", "url_path", "internal_path"}
    first = store.persistable_findings(found, compat=True).filter("value like '%api%'").collect()
    assert [r.category for r in first] == ["api_path"]


def test_whole_values_are_compared(spark):
    long = "x" * 600
    found = scan.scan_patterns(texts(spark, f'token="{long}1"; token="{long}2"'), KEYS)
    assert found.count() == 2
    assert store.persistable_findings(found).count() == 2
    assert store.persistable_findings(found, compat=True).count() == 1


@pytest.mark.parametrize("n", [63, 64, 65, 66])
def test_few_and_many_matches_give_the_same_lines(spark, n):
    content = "\n".join(f"a\n\neval (v{i})" for i in range(n))
    rows = findings(spark, content, deduplicate=False)
    assert [(f.line_number, f.context) for f in rows] == [(w[2], w[3]) for w in expected(content, deduplicate=False)]
    assert len(rows) == n


def test_long_runs_take_linear_time(spark):
    """A megabyte of characters that three detectors begin with."""
    import time
    run = "0123456789abcdef" * 65_536
    rows = texts(spark, run + "x.amazonaws.com", run + ".blob.core.example", "1" * 1_000_000 + "-x.apps.googleusercontent.com")
    for d in catalog.builtin_detectors():
        if d.name in ("s3_bucket", "azure_blob", "google_oauth"):
            start = time.time()
            assert scan.scan_patterns(rows, KEYS, detectors=[d]).count() == 0
            assert time.time() - start < 10


def test_linear_expressions_give_the_same_matches(spark):
    rnd = random.Random(11)
    bits = ["a", "-", "_", ".s3", "s3", ".", ".amazonaws.com", "/b", ".eu-1", ".blob.core.windows.net", " ", "7", "12-" + "k" * 32,
            ".apps.googleusercontent.com", "x.s3.amazonaws.com", "s3.amazonaws.com/q", "\n"]
    chosen = [d for d in catalog.builtin_detectors() if d.name in ("s3_bucket", "azure_blob", "google_oauth")]
    contents = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 30))) for _ in range(500)]
    rows = scan.scan_patterns(texts(spark, *contents), KEYS, detectors=chosen, deduplicate=False).orderBy("asset_key", "p_ord", "m_ord").collect()
    got = [(r.asset_key, r.pattern_name, r.value, r.line_number) for r in rows]
    assert got == [(i, *w[:3]) for i, c in enumerate(contents) for w in expected(c, chosen, deduplicate=False)]


def test_required_literals_cover_the_catalog():
    assert list(REQUIRED_LITERALS) == [d[0] for d in DETECTORS]
    for d in catalog.builtin_detectors():
        assert d.severity in SEVERITIES and d.finding_type and d.regex and d.description
        if d.ignores_case:
            assert all(lit == lit.lower() for group in d.required for lit in group)
    assert len(DETECTORS) == 66 and len({d[3] for d in DETECTORS}) == 66


PIECES = [c for c, _ in CASES] + [
    "aws = 'a' \"" + "A1b2" * 10 + '"', "amzn.mws." + "0a1b2c3d-0a1b-0a1b-0a1b-0a1b2c3d4e5f", "77-" + "a" * 32 + ".apps.googleusercontent.com",
    "GitHub: '" + "z9" * 20 + "'", "rk_" + "test_" + "q" * 24, "xoxb" + "-1234567890",
    "https://hooks.slack.com/" + "services/T0A/B0B/c0C", "-----BEGIN EC PRIVATE KEY-----",
    "AAAA" + "a" * 7 + ":" + "b" * 140, "SG" + "." + "a" * 22 + "." + "b" * 43, "AC" + "0f" * 16, "SK" + "0F" * 16,
    "0f" * 16 + "-us12", "key-" + "0Z" * 16, "Heroku x 01234567-89AB-CDEF-0123-456789ABCDEF",
    "paſſword='abcdefgh'", "ſecret : \"12345678\"", "APİ_KEY='abcdefghi'", "toKen=\"abcdefghij\"",
    "https://u:p@h.example/x", "npm" + "_" + "a" * 36, "M" + "a1" * 11 + "b" + "." + "abc-_d" + "." + "e" * 27,
    "defaultendpointsprotocol=https;accountname=q;accountkey=" + "A" * 88, "'/graphql?x'", "\"https://h.example/gql/\"",
    "axios ( '/abc/def')", "wss://h.example/s", "'/ab/cd:e/{f}'", "https://cdn.a.example/x https://a.example/y?z=1", "'/admin/xyz'",
    "storage.googleapis.com/b-1", "acc.blob.core.windows.net", "'https://STAGING.a.example'", "10.1.2.3 110.1.2.3 10.1.2.3٣",
    "localhost:80/x", "x.outerHTML+=1", "setTimeout( 'x'", "new Function(", "a.insertAdjacentHTML(", "a.src = 'x'", "a.src='https:'",
    "$('#a').html(b c)", "window.location = 1", "location.replace(", "f.srcdoc=", "addEventListener('message', function(e){ a(); })",
    "addEventListener('message', h(e) { if (e.origin) {} })", "x.__proto__ [", "a.constructor.prototype", "Object.assign(a, body",
    "'/api/v2/ab'", "sessionStorage.getItem('key1')", 'localStorage.getItem("user")', "document.cookie", "cryptojs.md5 (", "ſha1(", "ıv = '" + "0a" * 8 + "'", "IV: \"" + "0A" * 9 + "\"",
    "Math.random ()", "medieval(x)", "éval(", "eval\x1f(",
]
ODD = ["\n", "\r", "\r\n", "\x85", " ", " ", "\x0b", "\x1c", "\t", "\xa0", "١", "\U0001f600", "﷐", "﷑", "'", '"', ";", "=", "\xe9"]


def random_texts(n, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randint(1, 14)):
            parts.append(rnd.choice(PIECES) if rnd.random() < 0.6 else rnd.choice(ODD) * rnd.randint(1, 3))
            if rnd.random() < 0.4:
                parts.append(rnd.choice(["\n", " ", ";\n"]))
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("deduplicate", [True, False])
def test_agrees_with_python_expressions(spark, deduplicate):
    contents = random_texts(400, 7)
    want = sorted((i, *f) for i, c in enumerate(contents) for f in expected(c, deduplicate=deduplicate))
    for prefilter in (True, False):
        df = scan.scan_patterns(texts(spark, *contents), KEYS, deduplicate=deduplicate, prefilter=prefilter)
        got = sorted(
            (r.asset_key, r.pattern_name, r.value, r.line_number, r.context) for r in df.collect())
        assert len(want) > 1500
        assert got == want


def test_every_detector_fires_in_the_random_texts():
    fired = {f[0] for c in random_texts(400, 7) for f in expected(c)}
    assert fired == {d[0] for d in DETECTORS}


def test_long_texts_are_scanned_whole(spark):
    filler = "x();\n" * 200_000
    content = filler + 'token="' + "s" * 100_000 + '"\n"/' + "ab/" * 20_000 + 'cd"\neval(1)'
    rows = {r.pattern_name: r for r in findings(spark, content)}
    assert rows["eval_call"].line_number == 200_003
    assert len(rows["generic_secret"].value) == 100_000
    assert rows["url_path_string"].line_number == 200_002
    many = findings(spark, "\n".join(f"v{i}.innerHTML = 1; eval ({i})" for i in range(30_000)), deduplicate=False)
    assert len(many) == 60_000
    assert max(r.line_number for r in many) == 30_000


def test_custom_detectors_share_a_label(spark):
    rules = [catalog.Detector("a", "x[0-9]+", "t", "c", "low"), catalog.Detector("b", "(?:y|x)([0-9]+)|x[0-9]+", "t", "c", "low"),
             catalog.Detector("c", "x[0-9]+", "t", "c", "low")]
    rows = findings(spark, "x12 x345 x12 y678", detectors=rules)
    assert [(r.pattern_name, r.value) for r in rows] == [("a", "x12"), ("a", "x345"), ("b", "345"), ("b", "678")]


def test_more_detectors_than_one_pass_holds(spark):
    rules = [catalog.Detector(f"n{i}", rf"\bw{i}z\b", "t", f"c{i}") for i in range(450)]
    rows = findings(spark, "w3z w210z w449z w450z", detectors=rules)
    assert [(r.pattern_name, r.p_ord) for r in rows] == [("n3", 3), ("n210", 210), ("n449", 449)]


def test_invalid_patterns_are_reported(spark):
    good, bad = catalog.valid_detectors(spark, [
        catalog.Detector("ok", r"(?P<n>a)(?P=n)", "t", "c"), catalog.Detector("open", "(a", "t", "c"),
        catalog.Detector("cls", "[[a&&b]x", "t", "d")])
    assert [d.name for d in good] == ["ok", "cls"]
    assert [r.name for r in bad.collect()] == ["open"]
    rows = findings(spark, "aaa [[[ &&& xxx", detectors=[catalog.Detector("cls", "[[a&&b]{3}", "t", "d")])
    assert [r.value for r in rows] == ["aaa", "[[[", "&&&"]


def test_custom_pattern_table(spark):
    table = spark.createDataFrame([
        (1, None, "g", "regex", "glob[0-9]+", "t", "high", "", True), (2, 5, "p", "regex", "proj[0-9]+", "t", "low", "", True),
        (3, 6, "o", "regex", "x", "t", "low", "", True), (4, None, "off", "regex", "x", "t", "low", "", False),
        (5, None, "s", "script", "x", "t", "low", "", True),
    ], "id int, project_id int, name string, pattern_type string, pattern string, finding_type string, severity string, description string, enabled boolean")
    rules = catalog.custom_detectors(table, 5)
    assert [d.name for d in rules] == ["g", "p"]
    assert [r.value for r in findings(spark, "glob12 proj34 x", detectors=rules)] == ["glob12", "proj34"]


def test_string_literals_only(spark):
    rows = scan.scan_string_literals(texts(spark, "eval(x); a = 'eval(1)'; b = \"x\"; c = `location.replace(y)`"), KEYS)
    got = {(r.pattern_name, r.line_number) for r in rows.collect()}
    assert got == {("eval_call", 1), ("location_replace", 3)}


def test_once_per_hash_equals_plain_scan(spark):
    contents = random_texts(40, 3) * 3
    df = texts(spark, *contents)
    cols = ["asset_key", "pattern_name", "value", "line_number", "context"]
    assert sorted(scan.scan_once_per_hash(df, KEYS).select(*cols).collect()) == sorted(
        scan.scan_patterns(df, KEYS).select(*cols).collect())


def test_unique_after_the_scan_equals_unique_in_the_scan(spark):
    df = texts(spark, *random_texts(60, 9))
    cols = ["asset_key", "category", "value", "line_number", "p_ord", "m_ord"]
    after = scan.unique_findings(scan.scan_patterns(df, KEYS, deduplicate=False), KEYS)
    assert sorted(after.select(*cols).collect()) == sorted(scan.scan_patterns(df, KEYS).select(*cols).collect())


def test_the_scan_needs_no_shuffle(spark):
    df = spark.range(10).select(F.col("id").alias("asset_key"), F.lit("eval(x)").alias("content"))
    plan = scan.scan_patterns(df, KEYS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
