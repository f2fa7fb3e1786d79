"""Permutation, exact round trip and layout of the shards."""

import glob
import os

import numpy as np
import pytest

from scriptsift.llm.training_order import (
    END, HEADER, PAD, VOCABULARY, _encodings, feistel, materialise, ordered, read_shards, slots, stride)


@pytest.mark.parametrize("bits", [2, 4, 10, 14])
def test_feistel_is_a_permutation(bits):
    n = np.arange(1 << bits, dtype=np.uint64)
    assert sorted(feistel(n, bits, 5).tolist()) == list(range(1 << bits))
    assert feistel(n, bits, 5).tolist() != feistel(n, bits, 6).tolist() or bits == 2


@pytest.mark.parametrize("total", [1, 2, 3, 5, 17, 1000, 1025, 4099])
def test_slots_are_gapless(total):
    assert sorted(slots(np.arange(total), total, 9).tolist()) == list(range(total))


def sequences(text, length):
    ids = [*_encodings(VOCABULARY)[0](text), END]
    return [ids[a:a + length] for a in range(0, len(ids), length)]


def check(docs, rows, length):
    want = sorted(
        ((r["doc_id"], k, tuple(part)) for r in docs.collect() if r["text"] for k, part in enumerate(sequences(r["text"], length))), key=repr)
    got = sorted(
        ((r["doc_id"], r["sequence"], tuple(np.frombuffer(r["ids"], ">u2")[:r["n_tokens"]].tolist())) for r in rows), key=repr)
    assert got == want
    assert sorted(r["slot"] for r in rows) == list(range(len(want)))
    assert all(set(np.frombuffer(r["ids"], ">u2")[r["n_tokens"]:].tolist()) <= {PAD} for r in rows)


def test_documents(documents):
    check(documents, ordered(documents).collect(), 256)


def test_odd_rows(odd_documents, no_documents):
    check(odd_documents, ordered(odd_documents, length=32, shard_rows=100).collect(), 32)
    assert ordered(no_documents).collect() == []


def test_shards_have_a_fixed_stride_and_reading_resumes(spark, documents, tmp_path):
    path = str(tmp_path / "shards")
    total = materialise(documents, path, length=64, shard_rows=500)
    files = {int(f.split("shard=")[1].split("/")[0]): f for f in glob.glob(f"{path}/shard=*/part-*")}
    assert sorted(files) == list(range(-(-total // 500)))
    for k, f in files.items():
        assert os.path.getsize(f) == stride(64) * min(500, total - 500 * k)
    with open(files[1], "rb") as f:
        f.seek(stride(64) * 123)
        record = f.read(stride(64))
    rows = {r["slot"]: r for r in read_shards(spark, path, 64, 500, 600).collect()}
    assert sorted(rows) == list(range(600, total))
    assert record[HEADER:-1] == bytes(rows[623]["ids"]) and record[-1:] == b"\n"


def test_key_decides_the_order(documents):
    a, b, c = (
        [(r["slot"], r["doc_id"], r["sequence"]) for r in ordered(documents, key=k).sort("slot").collect()] for k in (1, 1, 2))
    assert a == b != c


def test_both_encodings_agree(spark):
    texts = ["a b\nc", "two  blanks", "tab\t\tx", "nbsp\u00a0 x", "wide\u2003\u2003y", " lead", "trail \n", "line\n\n\nline", "\u3000 z", "it's 12 o'clock!!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(docs, ordered(docs, length=8).collect(), 8)
