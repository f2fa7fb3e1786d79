"""Retrieval against exhaustive BM25, and planted items."""

import random

import numpy as np
from pyspark.sql import functions as F

from scriptsift.llm.decontaminate import B, K1, ItemIndex, build_indexes, decontaminate, leaks


def random_index(seed, items=120, vocabulary=300):
    rng = random.Random(seed)
    word = lambda: int(rng.paretovariate(0.6)) % vocabulary + 1
    rows = [(i, [word() for _ in range(rng.randrange(1, 30))], [word() for _ in range(rng.randrange(0, 8))]) for i in range(items)]
    return rows, ItemIndex(rows), rng


def test_block_max_wand_finds_all_items_above_the_threshold():
    rows, index, rng = random_index(3)
    n = len(rows)
    lengths = [len(q) + len(a) for _, q, a in rows]
    mean = sum(lengths) / n
    df = {}
    for _, q, a in rows:
        for w in {*q, *a}:
            df[w] = df.get(w, 0) + 1

    def weights(item):
        words = rows[item][1] + rows[item][2]
        raw = {w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * words.count(w) * (K1 + 1) / (
            words.count(w) + K1 * (1 - B + B * len(words) / mean)) for w in words}
        total = sum(raw.values())
        return {w: x / total for w, x in raw.items()}

    all_weights = [weights(i) for i in range(n)]
    for _ in range(40):
        query = set(rng.choice(rows)[1]) | {rng.randrange(1, 300) for _ in range(20)}
        terms = [t for t, h in enumerate(index.terms.view(np.int64).tolist()) if h in query]
        for threshold in (0.2, 0.5, 0.8):
            want = {i: s for i in range(n) if (s := sum(x for w, x in all_weights[i].items() if w in query)) >= threshold}
            got = dict(index.search(terms, threshold))
            assert got.keys() == want.keys()
            assert all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_passages_miss_no_item():
    rows, index, rng = random_index(4)
    text = [rng.randrange(1, 300) for _ in range(900)]
    for at, item in ((0, 5), (431, 17), (880, 30)):
        text[at:at] = rows[item][1] + rows[item][2]
    hashes = np.array(text, np.int64).view(np.uint64)
    seen = {k for _, a, b, terms in index.passages(hashes, np.array([0, len(text)]), 0.6)
            for k, _ in index.search(terms, 0.6)}
    want = set()
    span = index.span
    for a in range(0, max(len(text) - span, 1), span):
        inside = set(text[a:a + 2 * span])
        terms = [t for t, h in enumerate(index.terms.view(np.int64).tolist()) if h in inside]
        want |= {k for k, _ in index.search(terms, 0.6)}
    assert seen == want and {5, 17, 30} <= seen


def single_index(items):
    part, = build_indexes(items)
    return part.index()


def items_table(spark):
    return spark.createDataFrame([
        (1, "Which river runs through the old northern town of Kelderon? It is the broad and silent river Wend."),
        (2, "Name three metals that float on liquid quicksilver when poured. Iron, lead and common tin."),
        (2, "Name three metals that float on liquid quicksilver when poured. Iron, lead and common tin."),
        (3, "short item"), (4, None), (5, ""), (None, "A nameless question about seven purple lanterns? They burn whale oil."),
    ], "item_id long, text string")


def test_planted_and_clean_texts(spark):
    filler = " ".join(f"filler{i % 97}" for i in range(400))
    item = "which RIVER runs through the old northern town of Kelderon?? it is the broad and silent river Wend"
    docs = spark.createDataFrame([
        (1, f"{filler} {item} {filler}", "a"),
        (2, f"{filler} the broad river Wend and an old northern town {filler}", "b"),
        (3, f"{filler} Name three metals that float on liquid quicksilver when poured. Nothing else.", "c"),
        (4, "Name three metals that float on liquid quicksilver when poured. Iron, lead and common tin.", "d"),
        (4, "Name three metals that float on liquid quicksilver when poured. Iron, lead and common tin.", "d"),
        (5, "a short item here", "e"), (6, None, None), (None, "", ""),
        (7, f"{filler} A nameless question about seven purple lanterns? They burn whale oil.", "f"),
    ], "doc_id long, text string, leaks string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in leaks(docs, items_table(spark)).collect()), key=repr)
    assert got == sorted([(1, 1), (4, 2), (4, 2), (5, 3), (7, None)], key=repr)
    kept = decontaminate(docs, items_table(spark))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([2, 3, 6, None], key=repr)


def test_documents_against_word_search(spark, documents):
    """Every text that holds a whole item is found, and nothing without most of one."""
    import regex
    word = regex.compile(r"[\p{L}\p{M}\p{N}]+")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    flat = lambda t: " " + " ".join(word.findall((t or "").lower())) + " "
    tests = [(r["item_id"], flat(r["text"])) for r in items.collect()]
    whole = {(r["doc_id"], i) for r in documents.collect() for i, t in tests if t in flat(r["text"])}
    got = {(r["doc_id"], r["item_id"]): r for r in leaks(documents, items).collect()}
    assert whole <= got.keys()
    assert all(got[k]["question_overlap"] >= 0.5 for k in got.keys() - whole)


def test_items_with_changed_and_added_words(spark):
    """One and two words replaced, or words put between question and answer, still count; the words shuffled rarely do."""
    items = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")
    index = single_index(items)
    rng = random.Random(5)
    filler = [rng.randrange(1, 1 << 60) for _ in range(500)]
    planted = {}
    for item in range(len(index.ids)):
        own, cut = index.words[item].view(np.int64).tolist(), index.split[item]
        if min(cut, len(own) - cut) < 3:
            continue  # a changed word would be half of the question or the answer
        one, two, added, mixed = own[:], own[:], own[:], own[:]
        one[cut // 2] = 7
        two[cut // 3], two[cut - cut // 3 - 1] = 7, 8
        added[cut:cut] = [7, 8]
        rng.shuffle(mixed)
        for name, words in (("one", one), ("two", two), ("added", added), ("mixed", mixed)):
            planted[item, name] = filler[:150 + 7 * item % 200] + words + filler[350:]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in planted.values()])])
    found = index.leaks(np.concatenate([np.array(w, np.int64) for w in planted.values()]).view(np.uint64), offsets, 0.6, 0.5)
    missed = {name: sum(n == name and i not in f for (i, n), f in zip(planted, found)) for name in ("one", "two", "added")}
    assert len(planted) > 400 and missed == {"one": 0, "two": 0, "added": 0}
    assert sum(n == "mixed" and i in f for (i, n), f in zip(planted, found)) < len(planted) / 4 / 10


def test_parts_of_the_items_change_nothing(spark, documents, monkeypatch):
    """Scores, places and items are those of one index, and each part is written before the next one is read."""
    from scriptsift.llm import decontaminate as module
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").unionByName(items_table(spark))
    copies = items.select((F.coalesce("item_id", F.lit(50)) + 9000).alias("doc_id"), "text")
    docs = documents.select("doc_id", "text").unionByName(copies)
    key = lambda r: (r["doc_id"], repr(r["item_id"]))
    tagged = docs.select("doc_id", F.lit("x").alias("leaks"), "text")
    want = sorted(leaks(docs, items).collect(), key=key)
    want_kept = sorted(map(repr, decontaminate(tagged, items).collect()))
    monkeypatch.setattr(module, "PART_WORDS", 150)
    parts = build_indexes(items)
    assert len(parts) > 3 and all(len(p.index().ids) < items.count() for p in parts)
    got = sorted(leaks(docs, items).collect(), key=key)
    assert len(want) == len(got) > 5
    for a, b in zip(want, got):
        assert abs(a["score"] - b["score"]) < 1e-9
        assert {**a.asDict(), "score": 0} == {**b.asDict(), "score": 0}
    kept = decontaminate(tagged, items)
    assert kept.columns == tagged.columns and sorted(map(repr, kept.collect())) == want_kept


def test_odd_rows(spark, odd_documents, no_documents):
    none = items_table(spark).filter("false")
    assert leaks(odd_documents, items_table(spark)).collect() == []
    assert leaks(no_documents, items_table(spark)).collect() == []
    assert build_indexes(none) == []
    assert decontaminate(odd_documents, none).count() == odd_documents.count()
