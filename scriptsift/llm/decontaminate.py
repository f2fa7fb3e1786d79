"""Benchmark decontamination: BM25 index of test items, block-max WAND, overlap check.

The items are indexed once: per term a posting list of (item, impact), cut into
blocks that carry their largest impact.  Impacts are BM25 weights divided by the
score an item gives its own text, so one threshold is meant for all items.
Every training text is cut into overlapping passages three times as long as the
longest item, so that each item lies in one whole, with half as many words again
put in; each is a query for all items above the threshold.  Bounds over the rare
terms of the items dismiss, for a whole batch at a time, the passages in which no
item can reach it; the rest run block-max WAND.  The words of question and of
answer of retrieved items are then looked up, and aligned in order, which leaves
room for changed, added and missing words.

Items are indexed in parts of about ``PART_WORDS`` words, one part at a time: its
hits are written before the next part is read, so what the driver holds and sends
to the executors is bounded however long the benchmark.  Every part meets all
texts, and weights come from the statistics of all items, so scores do not depend
on the parts.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, shared, small_batches, stage, with_row_ids, word_hashes, words
from .near import _flat

THRESHOLD = 0.6
PART_OVERLAP = 0.5
# Share of an item's words that stand in its order, question and answer each in one place.
IN_ORDER = 0.5
# Worth of the common terms of an item, as a share of its own score.
COMMON = 0.3
PART_WORDS = 500_000
BLOCK = 32
K1, B = 1.2, 0.75
LEAKS = "array<struct<item:long,score:double,question:double,answer:double,at:int>>"


def in_order(own: np.ndarray, passage: np.ndarray) -> int:
    """Words of ``own`` found in their order in one place of the passage.

    The longest common subsequence with the windows of the passage; a place is
    any stretch half as long again as ``own``, so every such stretch lies in a
    window.
    """
    if not len(own):
        return 0
    length = len(own) + len(own) // 2 + 1
    step = max(length // 2, 1)
    held = np.concatenate([[0], np.cumsum(np.isin(passage, own))])
    starts = np.arange(0, max(len(passage) - length, 0) + step, step)
    held = held[np.minimum(starts + length + step, len(passage))] - held[np.minimum(starts, len(passage))]
    masks = {}
    for k, w in enumerate(own.tolist()):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(own)) - 1
    best = 0
    # Windows that hold most of the words come first.
    for k in np.argsort(-held, kind="stable").tolist():
        if held[k] <= best or best == len(own):
            break
        row = full
        for w in passage[starts[k]:starts[k] + length + step].tolist():
            if w in masks:
                match = row & masks[w]
                row = (row + match | row - match) & full
        best = max(best, len(own) - row.bit_count())
    return best


class Statistics(NamedTuple):
    """What weights and passages depend on, over all items."""

    items: int
    mean: float
    longest: int


class ItemIndex:
    """Inverted index of some items; ``rows`` are (item id, words of question, words of answer).

    ``whole`` and ``holders`` ({word: items that hold it}) describe all items, where ``rows`` are a part of them.
    """

    def __init__(self, rows, whole: Statistics | None = None, holders: dict[int, int] | None = None):
        self.ids = [r[0] for r in rows]
        self.split = [len(r[1]) for r in rows]
        self.words = [np.array([*r[1], *r[2]], np.int64).view(np.uint64) for r in rows]
        lengths = np.array([len(w) for w in self.words])
        n, mean, longest = whole or (len(rows), lengths.mean() if len(rows) else 1, int(lengths.max(initial=1)))
        mean, longest = max(mean, 1), max(longest, SHINGLE_WORDS)
        self.span = longest + longest // 2
        tfs = [np.unique(w, return_counts=True) for w in self.words]
        self.terms, df = np.unique(np.concatenate([t for t, _ in tfs] or [np.array([], np.uint64)]), return_counts=True)
        if holders is not None:
            df = np.array([holders[t] for t in self.terms.view(np.int64).tolist()], np.int64)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        lists = [[] for _ in self.terms]
        for item, (terms, tf) in enumerate(tfs):
            at = np.searchsorted(self.terms, terms)
            impact = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / mean))
            for t, x in zip(at.tolist(), (impact / max(impact.sum(), 1e-12)).tolist()):
                lists[t].append((item, x))
        self.items = [[i for i, _ in postings] for postings in lists]
        self.impacts = [[x for _, x in postings] for postings in lists]
        self.block_max = [[max(x[a:a + BLOCK]) for a in range(0, len(x), BLOCK)] for x in self.impacts]
        self.top = np.array([max(x) for x in self.impacts] or [], np.float64)
        self._rare(df)

    def _rare(self, df) -> None:
        """Split the terms of each item: its most common ones, worth at most ``COMMON`` together, and the rest.

        A passage whose rare terms of an item stay below the threshold less that
        worth cannot reach the threshold, whatever else it holds.
        """
        common = np.zeros(len(self.ids))
        postings = sorted(
            ((-df[t], t, i, x) for t in range(len(self.terms)) for i, x in zip(self.items[t], self.impacts[t])))
        rare = []
        for _, t, i, x in postings:
            if common[i] + x <= COMMON:
                common[i] += x
            else:
                rare.append((t, i, x))
        self.worth = common
        rare.sort()
        self.rare_terms, sizes = np.unique(np.array([t for t, _, _ in rare], np.int64), return_counts=True)
        self.rare_hashes = self.terms[self.rare_terms] if len(rare) else np.array([], np.uint64)
        self.rare_starts = np.concatenate([[0], np.cumsum(sizes)])
        self.rare_items = np.array([i for _, i, _ in rare], np.int64)
        self.rare_impacts = np.array([x for _, _, x in rare], np.float64)
        self.maybe_rare = np.zeros(1 << 16, bool)
        self.maybe_rare[(self.rare_hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def search(self, terms, threshold: float):
        """[(item, score)] of all items scoring at least ``threshold``, by block-max WAND."""
        cursors = [[0, t] for t in terms]
        found = []
        end = len(self.ids)
        low = threshold - 1e-9

        def item(c):
            ids = self.items[c[1]]
            return ids[c[0]] if c[0] < len(ids) else end

        while True:
            cursors = sorted((c for c in cursors if item(c) < end), key=item)
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.top[c[1]]
                if bound >= low:
                    pivot = k
                    break
            if pivot < 0:
                return found
            target = item(cursors[pivot])
            while pivot + 1 < len(cursors) and item(cursors[pivot + 1]) == target:
                pivot += 1
            # Sharper bound: the blocks in which the pivot item would lie.
            bound, until = 0.0, end
            for c in cursors[:pivot + 1]:
                ids = self.items[c[1]]
                block = bisect_left(ids, target, c[0]) // BLOCK
                if block < len(self.block_max[c[1]]):
                    bound += self.block_max[c[1]][block]
                    last = min((block + 1) * BLOCK, len(ids)) - 1
                    until = min(until, ids[last] + 1)
            if bound < low:
                skip = min(until, item(cursors[pivot + 1]) if pivot + 1 < len(cursors) else end)
                skip = max(skip, target + 1)
                for c in cursors[:pivot + 1]:
                    c[0] = bisect_left(self.items[c[1]], skip, c[0])
            elif item(cursors[0]) == target:
                score = 0.0
                for c in cursors[:pivot + 1]:
                    score += self.impacts[c[1]][c[0]]
                    c[0] += 1
                if score >= low:
                    found.append((target, score))
            else:
                for c in cursors[:pivot + 1]:
                    c[0] = bisect_left(self.items[c[1]], target, c[0])

    def overlaps(self, item: int, passage: np.ndarray):
        """Share of the item's words found in order, and shares of its question and answer words found in the passage."""
        own, cut = self.words[item], self.split[item]
        question, answer = own[:cut], own[cut:]
        share = lambda a: float(np.isin(a, passage).mean()) if len(a) else 1.0
        return (in_order(question, passage) + in_order(answer, passage)) / len(own), share(question), share(answer)

    def passages(self, hashes: np.ndarray, offsets: np.ndarray, threshold: float):
        """(document, first word, end, distinct terms) of passages in which some item can reach the threshold."""
        span = self.span
        lengths = np.diff(offsets)
        counts = np.where(lengths > 0, np.maximum(-(-lengths // span) - 1, 1), 0)
        first = np.concatenate([[0], np.cumsum(counts)])
        # Rare terms by passage; a word lies in two passages but at the edges of a text.
        at = np.flatnonzero(self.maybe_rare[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        term = np.searchsorted(self.rare_hashes, hashes[at])
        known = term < len(self.rare_hashes)
        known[known] = self.rare_hashes[term[known]] == hashes[at[known]]
        at, term = at[known], term[known]
        doc = np.searchsorted(offsets, at, side="right") - 1
        part = (at - offsets[doc]) // span
        later, earlier = part < counts[doc], part > 0
        passage = np.concatenate([(first[doc] + part)[later], (first[doc] + part - 1)[earlier]])
        term = np.concatenate([term[later], term[earlier]])
        cells = np.unique(passage * np.int64(len(self.rare_hashes) + 1) + term)
        passage, term = cells // (len(self.rare_hashes) + 1), cells % (len(self.rare_hashes) + 1)
        sizes = np.diff(self.rare_starts)[term]
        posting = np.repeat(self.rare_starts[:-1][term] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        pair, back = np.unique(np.repeat(passage, sizes) * np.int64(len(self.ids) + 1) + self.rare_items[posting], return_inverse=True)
        reached = np.bincount(back, self.rare_impacts[posting], len(pair)) + self.worth[pair % (len(self.ids) + 1)] if len(pair) else np.array([])
        for k in np.unique(pair[reached >= threshold - 1e-6] // (len(self.ids) + 1)):
            d = int(np.searchsorted(first, k, side="right")) - 1
            a = int(offsets[d] + (k - first[d]) * span)
            b = int(min(a + 2 * span, offsets[d + 1]))
            terms = np.unique(np.searchsorted(self.terms, hashes[a:b]))
            terms = terms[terms < len(self.terms)]
            yield d, a, b, terms[np.isin(self.terms[terms], hashes[a:b])].tolist()

    def leaks(self, hashes: np.ndarray, offsets: np.ndarray, threshold: float, order: float):
        """Per document the items it holds: {item: (score, question, answer, first word)}."""
        found = [{} for _ in range(len(offsets) - 1)]
        for doc, a, b, terms in self.passages(hashes, offsets, threshold):
            for item, score in self.search(terms, threshold):
                ordered, question, answer = self.overlaps(item, hashes[a:b])
                if ordered >= order and question >= PART_OVERLAP and answer >= PART_OVERLAP:
                    if item not in found[doc] or found[doc][item][0] < score:
                        found[doc][item] = (score, question, answer, a - int(offsets[doc]))
        return found


class ItemPart:
    """Some of the items; they are read only when their index is built."""

    def __init__(self, rows: DataFrame, whole: Statistics | None = None, holders: DataFrame | None = None):
        self.rows, self.whole, self.holders = rows, whole, holders

    def index(self) -> ItemIndex:
        rows = sorted(((r["id"], r["question"], r["answer"]) for r in self.rows.collect()), key=repr)
        if self.whole is None:
            return ItemIndex(rows)
        own = self.rows.select(F.explode(F.concat("question", "answer")).alias("term")).distinct()
        return ItemIndex(rows, self.whole, {r["term"]: r["df"] for r in self.holders.join(own, "term").collect()})


def build_indexes(items: DataFrame, item_id: str = "item_id", text: str = "text") -> list[ItemPart]:
    """Parts of bounded size of the items, each to be indexed by itself.

    The answer is what follows the first question mark, else the last sentence;
    an item of one sentence is all question.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    asked = F.regexp_extract(body, r"(?s)^(.*?\?)\s+\S", 1)
    before = F.regexp_extract(body, r"(?s)^(.*[.?!])\s+\S", 1)
    cut = F.when(asked != "", F.length(asked)).when(before != "", F.length(before)).otherwise(F.length(body))
    hashed = (
        items.select(F.col(item_id).cast("long").alias("id"), body.alias("body"), cut.alias("cut"))
        .select("id", word_hashes(words(F.expr("substr(body, 1, cut)"))).alias("question"),
                word_hashes(words(F.expr("substr(body, cut + 1)"))).alias("answer"))
        .filter("size(question) + size(answer) > 0").distinct())
    size = F.size("question") + F.size("answer")
    n, total, longest = hashed.agg(F.count("*"), F.sum(size), F.max(size)).first()
    parts = math.ceil((total or 0) / PART_WORDS)
    if parts <= 1:
        return [ItemPart(hashed)] * parts
    hashed = stage(hashed.withColumn("part", F.pmod(F.xxhash64("id", "question", "answer"), F.lit(parts))), "decontaminate-items")
    holders = stage(
        hashed.select(F.explode(F.array_distinct(F.concat("question", "answer"))).alias("term"))
        .groupBy("term").agg(F.count("*").alias("df")), "decontaminate-terms")
    return [ItemPart(hashed.filter(F.col("part") == part), Statistics(n, total / n, longest), holders) for part in range(parts)]


def with_leaks(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    threshold: float = THRESHOLD, order: float = IN_ORDER, name: str = "leaks",
) -> DataFrame:
    """``docs`` plus an array of the test items each text holds.

    A text holds an item if one of its passages scores at least ``threshold`` of
    the item's own score and has half the words of its question and of its answer,
    and if ``order`` of its words stand there in the item's order, question and
    answer each in one place; words between them may be changed, added or missing.  Null and empty texts hold
    nothing; an empty benchmark gives empty arrays; equal items under several ids
    are all reported; rows are judged one by one, so repeated rows agree.  A column
    called ``name`` is replaced.
    """
    small_batches(docs.sparkSession)
    hashes, none = word_hashes(words(F.col(text))), F.expr(f"cast(array() as {LEAKS})")
    parts = build_indexes(items, item_id, item_text)
    if not parts:
        return docs.withColumn(name, none)
    if len(parts) == 1:
        rows = docs.withColumn("__hashes", hashes)
        return rows.withColumn(name, _leak_column(parts[0].index(), threshold, order)(F.col("__hashes"))).drop("__hashes")
    rows = with_row_ids(docs, "decontaminate-rows", "*")
    path = shared(docs.sparkSession, "decontaminate-hits")
    for part in parts:
        hits = (
            rows.select("__rid", hashes.alias("__hashes"))
            .select("__rid", _leak_column(part.index(), threshold, order)(F.col("__hashes")).alias("__found"))
            .filter(F.size("__found") > 0))
        hits.write.mode("append").parquet(path)
    found = (
        docs.sparkSession.read.schema(hits.schema).parquet(path)
        .groupBy("__rid").agg(F.array_sort(F.flatten(F.collect_list("__found"))).alias("__found")))
    return rows.join(found, "__rid", "left").withColumn(name, F.coalesce("__found", none)).drop("__rid", "__found")


def _leak_column(index: ItemIndex, threshold: float, order: float):
    @F.arrow_udf(LEAKS)
    def leaks(hashes: pa.Array) -> pa.Array:
        found = index.leaks(*_flat(hashes), threshold, order)
        kind = pa.list_(pa.struct([
            ("item", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64()), ("at", pa.int32())]))
        return pa.array([
            [{"item": index.ids[i], "score": s, "question": q, "answer": a, "at": at}
             for i, (s, q, a, at) in sorted(of.items())] for of in found], kind)
    return leaks.asNondeterministic()


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per document and test item it holds."""
    return (
        with_leaks(docs, items, name="__leaks", **options)
        .select(F.col(doc_id), F.inline("__leaks"))
        .select(doc_id, F.col("item").alias("item_id"), "score", F.col("question").alias("question_overlap"),
                F.col("answer").alias("answer_overlap"), F.col("at").alias("first_word")))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that hold no test item, with their own columns."""
    return with_leaks(docs, items, text, name="__leaks", **options).filter(F.size("__leaks") == 0).select(*docs.columns)
