"""The smallest capacity against trying every partition."""

import random
import zlib
from collections import defaultdict
from itertools import combinations

import pytest

from scriptsift.llm import sharding
from scriptsift.llm.sharding import shard


def load(rows, shards):
    """Bytes of every shard, after checking that the rows are whole and slots gapless."""
    total, slots, of_text = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        of_text[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    return total


def least_capacity(sizes, shards):
    """By trying all cuts."""
    best = sum(sizes)
    for cuts in combinations(range(len(sizes) + 1), shards - 1):
        edges = [0, *cuts, len(sizes)]
        best = min(best, max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:])))
    return best


@pytest.mark.parametrize("seed", range(3))
def test_minimax(spark, seed, monkeypatch):
    monkeypatch.setattr(sharding, "TRIES", 5)
    import hashlib
    rng = random.Random(seed)
    texts = ["".join(rng.choice("abé") for _ in range(int(rng.paretovariate(0.8)) % 300)) for _ in range(11)]
    rows = [(i, t) for i, t in enumerate(texts * 2 + texts[:3] * 4)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect()
    assert sorted(r["doc_id"] for r in got) == [i for i, _ in rows]
    assert all(r["size"] == len(rows[r["doc_id"]][1].encode()) + 1 for r in got)
    assert all(r["text_crc32"] == zlib.crc32(rows[r["doc_id"]][1].encode()) for r in got)
    sizes = defaultdict(int)
    for _, t in rows:
        sizes[hashlib.sha256(t.encode()).hexdigest()] += len(t.encode()) + 1
    assert max(load(got, 4).values()) == least_capacity([sizes[k] for k in sorted(sizes)], 4)


def test_documents(documents):
    got = shard(documents).collect()
    total = load(got, 16)
    assert len(got) == documents.count() and len(total) == 16
    largest = max(r["size"] for r in got)
    assert max(total.values()) <= sum(total.values()) / 16 + 2 * largest


def test_one_group_of_most_rows(spark):
    rows = [(i, "same text") for i in range(500)] + [(1000 + i, f"text {i}") for i in range(200)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    total = load(got, 16)
    assert max(total.values()) == 500 * 10 and len({r["shard"] for r in got if r["doc_id"] < 500}) == 1


def test_odd_rows(odd_documents, no_documents):
    got = shard(odd_documents).collect()
    assert len(got) == odd_documents.count()
    load(got, 16)
    assert sorted((r["size"] for r in got))[:3] == [1, 1, 1]
    assert shard(no_documents).collect() == []


def test_it_is_the_same_again(documents):
    a, b = (sorted(tuple(r) for r in shard(d).select("doc_id", "shard", "slot").collect()) for d in (documents, documents.repartition(5)))
    assert a == b
