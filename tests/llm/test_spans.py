"""Base spans of personal data and secrets against Python's expressions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from scriptsift.llm import pii, secrets
from scriptsift.llm.spans import running_sum

TWELVE = "4539 1488 0343 6467"


def luhn(d):
    return sum((int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m[0])) <= 15),
)
SECRETS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
)


def base(text, rules):
    found = sorted(
        (m.start(), k, m.end(), kind) for k, (kind, pattern, valid) in enumerate(rules)
        for m in re.finditer(pattern, text or "", re.A) if valid(m))
    written = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in found)
    return [sum(f[3] == kind for f in found) for kind, _, _ in rules], written, hashlib.sha256(written.encode()).hexdigest()


def check(rows, texts, rules, names):
    assert len(rows) == len(texts)
    for r in rows:
        counts, written, sha = base(texts[r["n"]], rules)
        assert [r[f"n_{k}"] for k in names] == counts, texts[r["n"]]
        assert r["base_sha256"] == sha
        assert set(filter(None, written.split(","))) <= set(r["spans"].split(","))


def texts():
    rng = random.Random(8)
    bits = ["a@b.c", "x.y+z@mail-1.example.com", "@", ".", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.255", TWELVE, "4539148803436467",
            "+1 (487) 555-7209", "+49 30 1234567", "+", "-", " ", "  ", "é", "\U0001F600", "12", "7", "token = \"abcdef12\"", "API_KEY:", "apikey=='x'",
            "Password: hunter2", "secret=abc", "AKIA" + "Q" * 16, "AKIAQ", "deadbeef" * 4, "cafe", "\n", "_", "%", "x", "﷐", "=", "'", "\""]
    out = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    return out + [None, "", " ", "1" * 300, "1.1." * 400, "a@" * 300 + "b.c", "9 " * 900, "a.b@c." + "d." * 500 + "e", "+1 " * 300, "f" * 5000]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(n, t, "x", "y") for n, t in enumerate(texts())], "n long, text string, spans string, proposed string")


def test_personal_data(table):
    check(pii.find_pii(table, "n").collect(), texts(), PII, pii.BASE)


def test_secrets(table):
    check(secrets.scan_secrets(table, doc_id="n").collect(), texts(), SECRETS, secrets.BASE)


def test_documents(documents):
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in pii.find_pii(documents).collect():
        assert [r[f"n_{k}"] for k in pii.BASE] == base(rows[r["doc_id"]], PII)[0]


def test_running_sum(spark):
    values = [list(range(n)) for n in (1, 2, 63, 64, 65, 128, 129, 1000, 9000)]
    got = spark.createDataFrame([(v,) for v in values], "v array<int>").select("v", running_sum(F.col("v")).alias("s")).collect()
    for r in got:
        total, want = 0, []
        for x in r["v"]:
            total += x
            want.append(total)
        assert r["s"] == want


def test_long_runs_take_linear_time(spark):
    import time
    long = ["a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "1 " * 150_000, "+1" * 100_000, "a@b." * 50_000, "ab-" * 100_000 + "@x.y"]
    table = spark.createDataFrame([(n, t) for n, t in enumerate(long)], "n long, text string")
    start = time.time()
    rows = pii.find_pii(table, "n").collect()
    assert len(rows) == len(long) and time.time() - start < 60
    assert {r["n"]: r["n_email"] for r in rows}[6] == 1


def test_more_personal_data(spark):
    table = spark.createDataFrame([
        (1, "My IBAN: DE89 3704 0044 0532 0130 00 is here"), (2, "IBAN: DE89 3704 0044 0532 0130 01 no"),
        (3, "signed, Mr John Smith and others"), (4, "number 20240131 and 11111111 here"), (5, "her SSN 123-45-6789, social security"),
    ], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.find_pii(table).collect()}
    assert spans[1] == "iban:9:36" and spans[5].startswith("ssn:8:19") and spans[4] == ""


def test_expectation_maximisation_finds_the_reliable_labeler():
    rng = random.Random(1)
    counts = {}
    for _ in range(4000):
        right = rng.random() < 0.4
        vote = tuple(
            (1 if right else -1) if rng.random() < p else (-1 if right else 1) for p in (0.95, 0.85, 0.55, 0.8))
        counts[7, vote] = counts.get((7, vote), 0) + 1
    posterior, tables, prior = pii.estimate(counts)
    assert abs(prior[7] - 0.4) < 0.05
    assert [round(r[1] + w[-1]) for r, w in tables][0] == 2 and tables[0][0][1] > tables[3][0][1] > tables[2][0][1]
    model = pii.fit(counts, posterior)
    assert model[1][0][1] > model[1][0][-1]


def test_masking(spark):
    table = spark.createDataFrame([
        (1, "é mail a.b@c.de or +1 (487) 555-7209.", "s"), (2, None, "t"), (3, "nothing", None), (4, "", ""), (5, "9.9.9.9", ""),
        (6, "a@b.de.+1 (487) 555-7209", "")], "doc_id long, text string, __x string")
    got = {r["doc_id"]: r["text"] for r in pii.mask_pii(table).collect()}
    assert got == {1: "é mail [EMAIL] or [PHONE].", 2: None, 3: "nothing", 4: "", 5: "[IP]", 6: "[EMAIL].[PHONE]"}
    assert pii.mask_pii(table).columns == table.columns
    assert pii.mask_pii(table.filter("false")).collect() == []


def test_odd_rows(odd_documents, no_documents):
    for run in (pii.find_pii, secrets.scan_secrets):
        assert sorted((r["doc_id"] for r in run(odd_documents).collect()), key=repr) == sorted((r["doc_id"] for r in odd_documents.collect()), key=repr)
        assert run(no_documents).collect() == []


def test_ledger_scans_unseen_pairs_only(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = spark.createDataFrame([(1, "token = abcdef1"), (2, "token = abcdef1"), (3, None)], "doc_id long, text string")
    assert secrets.update_ledger(first, path) == 2
    assert secrets.update_ledger(first, path) == 0
    more = first.union(spark.createDataFrame([(4, "AKIA" + "Z" * 20), (5, "")], first.schema))
    assert secrets.update_ledger(more, path) == 1
    rows = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(more, path).collect()}
    assert rows == {1: "assign:0:15", 2: "assign:0:15", 3: "", 4: "access:0:24", 5: ""}
    # Fewer rules have all been here; a new one and a changed one run alone.
    assert secrets.update_ledger(more, path, rules=secrets.RULES[:3]) == 0
    new = (("abc", "abc[a-z]+", ("abc",), False), *secrets.RULES)
    assert secrets.update_ledger(more, path, rules=new) == 3
    entries = secrets._entries(spark, path)
    assert entries.filter(F.size("scanned") == 1).count() == 3
    assert entries.filter(F.size("scanned") == len(secrets.RULES)).count() == 3
    rows = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(more, path, rules=new).collect()}
    assert rows == {1: "assign:0:15,abc:8:14", 2: "assign:0:15,abc:8:14", 3: "", 4: "access:0:24", 5: ""}
    changed = (*secrets.RULES[:1], ("access", "AKIA[A-Z0-9]{30,}", ("AKIA",), False), *secrets.RULES[2:])
    assert secrets.update_ledger(more, path, rules=changed) == 3
    rows = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(more, path, rules=changed).collect()}
    assert rows == {1: "assign:0:15", 2: "assign:0:15", 3: "", 4: "", 5: ""}


def test_overlapping_runs_give_single_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "token = abcdef1"), (2, None)], "doc_id long, text string")
    for name in ("a", "b"):
        secrets.update_ledger(docs, str(tmp_path / name))
    # Both runs found the same ledger empty.
    spark.read.schema(secrets.LEDGER).option("recursiveFileLookup", True).parquet(str(tmp_path / "b")).write.parquet(str(tmp_path / "a" / "run-other"))
    rows = sorted((r["doc_id"], r["spans"], r["n_assign"]) for r in secrets.scan_secrets(docs, str(tmp_path / "a")).collect())
    assert rows == [(1, "assign:0:15", 1), (2, "", 0)]
    assert secrets.update_ledger(docs, str(tmp_path / "a")) == 0
