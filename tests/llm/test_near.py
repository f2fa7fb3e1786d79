"""Jaccard join against brute force over all pairs."""

import random
from itertools import combinations

import numpy as np
import regex

from scriptsift.llm import near
from scriptsift.llm.components import components
from scriptsift.llm.near import jaccard_join, linked, prefix_length, shingles, with_classes

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def brute(rows):
    """{row: (copy id, class id, links)} by comparing all pairs of different word sequences."""
    words = [tuple(WORD.findall((t or "").lower())) for _, t in rows]
    sets = {w: frozenset(w[i:i + 5] for i in range(max(len(w) - 4, 1))) if w else frozenset() for w in set(words)}
    ids = {w: min((i for (i, _), v in zip(rows, words) if v == w and i is not None), default=None) for w in sets}
    group = {w: w for w in sets}

    def find(w):
        while group[w] != w:
            w = group[w]
        return w

    links = dict.fromkeys(sets, 0)
    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            links[a] += 1
            links[b] += 1
            group[find(a)] = find(b)
    least = {}
    for w in sets:
        if ids[w] is not None:
            least[find(w)] = min(least.get(find(w), ids[w]), ids[w])
    return sorted(((i, ids[w], least.get(find(w)), links[w]) for (i, _), w in zip(rows, words)), key=repr)


def found(docs):
    return sorted((tuple(r[c] for c in ("doc_id", "copy_id", "class_id", "n_links")) for r in jaccard_join(docs).collect()), key=repr)


def test_prefix_is_shortened_to_the_recall():
    assert prefix_length(0.8, 20, 0.999) == 5
    assert prefix_length(0.8, 20, 0.9999999) < 5
    assert prefix_length(1.0, 1, 0.5, 12) == 12


def test_shingles_of_short_and_long_texts():
    hashes = np.arange(1, 14, dtype=np.uint64)
    got, starts = shingles(hashes, np.array([0, 0, 3, 8, 13]))
    assert starts.tolist() == [0, 0, 1, 2, 3]
    again, _ = shingles(hashes[3:8], np.array([0, 5]))
    assert got[1] == again[0]


def test_linked_is_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64)) for _ in range(60)] + [np.array([], np.uint64)]
    sets += [sets[3][:-1], sets[4][1:]]
    got = linked(sets, 0.6)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            assert got[i, j] == (i != j and either > 0 and len(a) > 0 and len(b) > 0 and both >= 0.6 * either - 1e-9)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (20, 20), (5, None), (30, 4)] + [(100, k) for k in range(101, 160)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 30: 1, 10: 10, 11: 10, 12: 10, 100: 100, **{k: 100 for k in range(101, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_documents_against_all_pairs(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert found(documents) == brute(rows)


def test_large_group_of_near_copies(spark, monkeypatch):
    """Far more members than a block holds; every link is counted."""
    monkeypatch.setattr(near, "BLOCK", 20)
    random.seed(5)
    base = [f"w{random.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(random.randrange(4)):
            words[random.randrange(len(words))] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    want, got = brute(rows), found(spark.createDataFrame(rows, "doc_id long, text string"))
    # The forest meets pairs at the threshold with a recall of 0.999.
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert sum(r[3] for r in got) >= 0.999 * sum(r[3] for r in want)
    assert all(g[3] <= w[3] for g, w in zip(got, want))


def test_odd_rows(odd_documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    assert found(odd_documents) == brute(rows)
    assert found(no_documents) == []
    kept = with_classes(odd_documents).filter("keeps")
    assert kept.count() == 4 and kept.columns[:4] == odd_documents.columns
