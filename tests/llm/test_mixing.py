from pyspark.sql import functions as F

from scriptsift.llm import mixing


def _shares(sizes, budget=None):
    """Targets by capping and sharing again until no source is above its ceiling."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    budget = sum(sizes.values()) if budget is None else budget
    capped = {}
    while True:
        open_ = [s for s in names if s not in capped]
        left = budget - sum(capped.values())
        target = {s: left * weight[s] / max(1, sum(weight[x] for x in open_)) for s in open_}
        above = [s for s in open_ if target[s] > 3 * sizes[s]]
        if not above:
            return {**target, **capped}
        capped.update({s: 3 * sizes[s] for s in above})


def _docs(spark, sizes):
    """A document per entry of each source's list, with that many words."""
    rows, n = [], 0
    for source, lengths in sizes.items():
        for words in lengths:
            rows.append((n, "w " * words, source))
            n += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_like_repeated_sharing(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 70}, {"a": 0, "b": 9, "c": 1, "d": 50, "é": 7}):
        rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r["source"]: r for r in mixing.targets(rows).collect()}
        want = _shares(sizes)
        assert all(abs(got[s]["target"] - want[s]) < 1e-6 for s in sizes), (sizes, got, want)
        assert sum(r["quota"] for r in got.values()) == round(sum(want.values()))
        assert all(abs(r["quota"] - r["target"]) < 1 and r["quota"] <= 3 * r["source_size"] for r in got.values())


def test_budget_above_all_ceilings(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 20)], "source string, size long")
    assert {r["source"]: r["quota"] for r in mixing.targets(rows, budget=1000).collect()} == {"a": 30, "b": 60}


def test_sources_get_their_words_and_advance_together(spark):
    sizes = {"a": [40] * 30, "b": [1, 2, 3] * 10, "c": [300, 5, 5], None: [7] * 50}
    docs = _docs(spark, sizes)
    rows = mixing.mix(docs).collect()
    want = _shares({s: sum(x) for s, x in sizes.items()})
    given = {}
    for r in sorted(rows, key=lambda r: r["position"]):
        assert r["offset"] == sum(given.values())
        given[r["source"]] = given.get(r["source"], 0) + r["taken"]
        # The queue has given its share of the time that has passed.
        assert abs(given[r["source"]] / want[r["source"]] - r["finish"]) < 1 / want[r["source"]] + 1e-9
    assert [r["finish"] for r in sorted(rows, key=lambda r: r["position"])] == sorted(r["finish"] for r in rows)
    assert sorted(r["position"] for r in rows) == list(range(len(rows)))
    assert all(abs(given[s] - want[s]) < 1 for s in sizes)
    counts = {}
    for r in rows:
        assert r["taken"] <= r["size"]
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + r["taken"]
    taken = {r["doc_id"]: r for r in mixing.taken_words(docs).collect()}
    assert len(taken) == docs.count()
    assert all(r["taken"] == counts.get(i, 0) <= 3 * r["size"] for i, r in taken.items())


def test_reruns_agree_however_rows_are_dealt(spark):
    docs = _docs(spark, {"a": [3] * 40, "b": [50, 1, 1], "c": [9] * 11})
    once = sorted(map(tuple, mixing.mix(docs).collect()))
    assert once == sorted(map(tuple, mixing.mix(docs.repartition(5, "text")).collect()))


def test_rounds_differ_in_order(spark):
    docs = _docs(spark, {"a": [2] * 40, "b": [4000]})
    rows = mixing.mix(docs).filter("source = 'a'").orderBy("position").collect()
    first, second = ([r["doc_id"] for r in rows if r["round"] == k] for k in (1, 2))
    assert sorted(first) == list(range(40)) and sorted(second) == list(range(40)) and first != second


def test_odd_tables(spark, odd_documents, no_documents):
    odd = odd_documents.withColumn("source", F.col("words")).withColumn("taken", F.lit("x")).withColumn("size", F.lit("y")).withColumn("rid", F.lit(0))
    rows = mixing.taken_words(odd).collect()
    assert len(rows) == odd.count()
    assert sum(r["taken"] for r in rows) <= sum(r["size"] for r in rows)
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    empty = no_documents.withColumn("source", F.col("words"))
    assert mixing.taken_words(empty).collect() == [] and mixing.mix(empty).collect() == []
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in mixing.taken_words(blank).collect()] == [(0, 0.0), (0, 0.0)]
    assert mixing.mix(blank).collect() == []
