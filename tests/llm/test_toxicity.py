"""Held-out accuracy, what a factorization machine adds, and odd rows."""

import numpy as np
from pyspark.sql import functions as F

from scriptsift.llm.toxicity import Machine, association, features, held_out, paired, with_toxicity, without_toxic

SF = "/root/testdata/sf0.1"


def test_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = (
        with_toxicity(docs, labels).join(labels, "doc_id").filter(held_out("doc_id")).filter("toxic is not null")
        .select("score", "toxic").collect())
    caught = sum(r["score"] >= 0.3 for r in rows if r["toxic"])
    assert caught >= 0.8 * sum(r["toxic"] for r in rows)
    assert sum(r["score"] >= 0.3 for r in rows if not r["toxic"]) <= 0.01 * len(rows)


def test_pairs_count_beyond_single_terms():
    """Neither term alone is toxic, both together are."""
    rng = np.random.default_rng(0)
    docs, labels = [], []
    for _ in range(1200):
        a, b = rng.random(2) < 0.5
        docs.append([1] * int(a) + [2] * int(b) + rng.integers(10, 40, 5).tolist())
        labels.append(float(a and b))
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    doc, slot, x = features(np.concatenate(docs), offsets, 64)
    machine = Machine(64).fit(doc, slot, x, np.array(labels, np.float32), epochs=60)
    pair = float(machine.factor[1] @ machine.factor[2])
    score = machine.score(doc, slot, x, len(docs))
    assert pair > 0
    assert ((score >= 0.5) == np.array(labels, bool)).mean() > 0.95


def test_pairs_of_terms_that_are_neutral_alone():
    """Each of two terms leaves the share of toxic texts as it is; only both or neither tell."""
    rng = np.random.default_rng(1)
    docs = [[1] * (k % 2) + [2] * (k // 2 % 2) + rng.integers(10, 400, 12).tolist() for k in range(1200)]
    labels = np.array([k % 2 == k // 2 % 2 for k in range(1200)], np.float32)
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    doc, slot, x = features(np.concatenate(docs), offsets, 400)
    alone = association(slot, labels[doc].astype(np.float64), 1200, 600, 400)
    assert alone[1] < 1e-6 and alone[2] < 1e-6
    assert np.flatnonzero(paired(doc, slot, labels, 400)).tolist() == [1, 2]
    machine = Machine(400).fit(doc, slot, x, labels, epochs=60)
    assert ((machine.score(doc, slot, x, 1200) >= 0.5) == (labels > 0)).mean() > 0.9


def test_a_term_beside_a_telling_one_does_not_count():
    """Where one term decides, the common terms around it stay out."""
    rng = np.random.default_rng(2)
    docs = [[1] * (k % 3 == 0) + [t for t in range(2, 12) if rng.random() < 0.5] for k in range(1500)]
    labels = np.array([k % 3 == 0 and k % 10 > 0 for k in range(1500)], np.float32)
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    doc, slot, _ = features(np.concatenate(docs), offsets, 32)
    assert not paired(doc, slot, labels, 32).any()


def test_pair_sum_equals_the_double_loop():
    machine = Machine(32, 4)
    machine.weight = np.linspace(-1, 1, 32).astype(np.float32)
    doc, slot, x = features(np.array([1, 2, 2, 9, 5, 5, 7]), np.array([0, 4, 4, 7]), 32)
    raw, _ = machine.raw(doc, slot, x, 3)
    for d in range(3):
        terms = [(s, v) for e, s, v in zip(doc, slot, x) if e == d]
        want = sum(machine.weight[s] * v for s, v in terms) + sum(
            float(machine.factor[s] @ machine.factor[t]) * v * w for k, (s, v) in enumerate(terms) for t, w in terms[:k])
        assert abs(raw[d] - want) < 1e-4


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame(
        [(1, 0), (3, 1), (3, 0), (None, 1), (4, None), (5, 7)], "doc_id long, toxic int")
    rows = with_toxicity(odd_documents, labels, name="tox").collect()
    assert len(rows) == odd_documents.count() and all(0 <= r["tox"] <= 1 for r in rows)
    assert with_toxicity(no_documents, labels, name="tox").collect() == []
    none = with_toxicity(odd_documents, labels.filter("false"), name="tox").collect()
    assert all(r["tox"] == 0.5 for r in none)
    assert without_toxic(odd_documents, labels, threshold=1.1).columns == odd_documents.columns


def test_scores_see_the_text_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    plain = {r["doc_id"]: r["score"] for r in with_toxicity(docs, labels).collect()}
    flipped = labels.withColumn("toxic", F.when(held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert plain == {r["doc_id"]: r["score"] for r in with_toxicity(docs, flipped).collect()}
