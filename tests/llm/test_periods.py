import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from scriptsift.llm import periods
from scriptsift.llm.queries import op12_periods, with_planted_runs

SF = "/root/testdata/sf0.001"


def brute(words):
    """Every stretch at every distance; those that a shorter period covers go."""
    n, found = len(words), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                found.append((i, j + p, p))
            i = max(j, i + 1)
    return sorted((s, e - s, p) for s, e, p in found if not any(q < p and s2 <= s and e2 >= e for s2, e2, q in found))


def _kept(words, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def _planted(rng, n, v):
    words = [str(rng.randrange(v)) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n < 8:
            break
        a, p, length = rng.randrange(n), rng.randint(1, max(1, n // 5)), rng.randint(2, n)
        for i in range(a + p, min(n, a + length)):
            words[i] = words[i - p]
    return words


def _in_one_process(words):
    pieces = {}
    for octave, first, count, lo, window in periods.tiles(periods.codes_of(words)):
        for p, s, e in periods.fragments(octave, first, count, lo, window.tolist()):
            pieces.setdefault(p, set()).add((s, e))
    out = []
    for p, spans in pieces.items():
        open_ = None
        for s, e in sorted(spans):
            if open_ and s <= open_[1]:
                open_[1] = max(open_[1], e)
            else:
                open_ = [s, e, p]
                out.append(open_)
    return sorted((s, e - s + p, p) for s, e, p in out if e - s + p >= max(6, 4 * p))


def test_tiles_and_fragments_like_brute_force():
    rng = random.Random(3)
    for _ in range(1500):
        words = _planted(rng, rng.randint(0, 140), rng.choice([1, 2, 3, 5, 30]))
        assert _in_one_process(words) == brute(words), words


def test_runs_across_many_tiles():
    rng = np.random.default_rng(5)
    for p, times in ((1, 30_000), (3, 7_000), (37, 900), (1000, 9), (6000, 4)):
        words = [*map(str, rng.integers(10**6, 10**9, 501)), *[f"x{i}" for i in range(p)] * times, "end"]
        assert _in_one_process(words) == [(501, p * times, p)]


def test_documents_like_brute_force(spark):
    rng = random.Random(4)
    texts = [_planted(rng, rng.randint(0, 300), rng.choice([2, 4, 40])) for _ in range(60)]
    docs = spark.createDataFrame([(i, "\n ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in periods.collapse(docs).collect()}
    assert len(got) == len(texts)
    for i, words in enumerate(texts):
        runs, r = brute(words), got[i]
        assert [tuple(x) for x in r["runs"]] == runs
        assert r["n_words"] == len(words)
        assert r["collapsed"] == (_kept(words, runs) if runs else None)
        assert r["collapsed_sha256"] == hashlib.sha256(_kept(words, runs).encode()).hexdigest()


def test_overlapping_runs(spark):
    """a b a b a b a b b b b b b: the last b of the first run begins the second."""
    docs = spark.createDataFrame([(1, "a b " * 4 + "b " * 6)], "doc_id long, text string")
    r = periods.collapse(docs).first()
    assert [tuple(x) for x in r["runs"]] == [(0, 8, 2), (7, 7, 1)]
    assert r["collapsed"] == "a b"


def test_query_on_given_documents(spark):
    rows = op12_periods(spark, SF).collect()
    texts = with_planted_runs(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    want = sorted(
        (r["doc_id"], len(runs), hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
         hashlib.sha256(_kept(words, runs).encode()).hexdigest())
        for r in texts for words in [periods._WORDS.findall(r["text"] or "")] for runs in [brute(words)])
    assert sorted((r["doc_id"], r["n_runs"], r["runs_sha256"], r["collapsed_sha256"]) for r in rows) == want
    assert any(r["n_runs"] for r in rows)
    for r in rows:
        assert (r["start"] is None) == (r["n_runs"] == 0)
        if r["n_runs"]:
            assert r["exponent_milli"] == 1000 * r["length"] // r["period"]


def test_odd_tables(spark, odd_documents, no_documents):
    odd = odd_documents.withColumn("rid", F.lit("x")).withColumn("runs", F.lit(1))
    rows = periods.collapse(odd).collect()
    assert len(rows) == odd.count()
    long = [r for r in rows if r["doc_id"] == 3]
    assert len(long) == 2 and all([tuple(x) for x in r["runs"]] == [(0, 120_000, 4)] and r["collapsed"] == "alpha beta gamma delta" for r in long)
    assert all(r["runs"] == [] for r in rows if r["doc_id"] != 3)
    assert periods.collapse(no_documents).collect() == []
