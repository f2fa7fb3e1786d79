"""N-gram Jaccard join: MinHash LSH forest, then exact verification.

Every document has one label per tree: a sequence of minima of its word-shingle
hashes under independent permutations.  Documents whose labels share a prefix
meet.  The prefix is shortened until pairs at the similarity threshold meet in
some tree with the target recall; sorted labels with a common prefix are a
subtree of that tree's trie, so grouping by the prefix visits all subtrees at
once.

Whatever meets gathers around small rows, in blocks of bounded size.  Two blocks are compared if some subtree holds rows of both, and then
every pair between them is verified on the full shingle sets.  A pair of blocks
is one task's work and returns one row per document (its number of links and
the smallest document linked to it there), never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, SIMILARITY, small_batches, stage, with_row_ids, word_hashes, words
from .components import components

TREES = 20
DEEPEST = 12
RECALL = 0.999
BLOCK = 192
# Columns of the shingle matrix multiplied at a time.
_CHUNK = 2048


def prefix_length(similarity: float = SIMILARITY, trees: int = TREES, recall: float = RECALL, deepest: int = DEEPEST) -> int:
    """Shorten the matched prefix until pairs at ``similarity`` are met with ``recall``."""
    length = deepest
    while length > 1 and 1 - (1 - similarity ** length) ** trees < recall:
        length -= 1
    return length


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on the input."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS):
    """(hash of every window of ``size`` words, offsets by document).

    A document with fewer words has one shingle of all its words; one without
    words has none.
    """
    lengths = np.diff(offsets)
    counts = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    starts = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(lengths)), counts)
    first = offsets[:-1][owner] + np.arange(starts[-1]) - starts[:-1][owner]
    padded = np.concatenate([_mix(hashes), np.zeros(size, np.uint64)])
    ends = offsets[1:][owner]
    out = np.zeros(len(owner), np.uint64)
    for k in range(size):
        at = first + k
        out = out * np.uint64(0x100000001B3) + np.where(at < ends, padded[at], np.uint64(0))
    return _mix(out), starts


def _flat(column: pa.Array):
    """Values and offsets of a list column of one batch, nulls read as empty."""
    lists = column.fill_null([]) if column.null_count else column
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), offsets - offsets[0]


def _sketcher(trees: int, length: int):
    def run(batches):
        rng = np.random.default_rng(20)
        mult = rng.integers(1, 1 << 63, trees * length, dtype=np.uint64) | np.uint64(1)
        add = rng.integers(0, 1 << 63, trees * length, dtype=np.uint64)
        for batch in batches:
            hashes, offsets = _flat(batch.column("hashes"))
            sh, starts = shingles(hashes, offsets)
            full = np.flatnonzero(np.diff(starts))
            keys = np.zeros((len(full), trees), np.uint64)
            for tree in range(trees):
                label = np.full(len(full), np.uint64(tree + 1))
                for k in range(tree * length, (tree + 1) * length):
                    label = _mix(label ^ np.minimum.reduceat(sh * mult[k] + add[k], starts[:-1][full])) if len(full) else label
                keys[:, tree] = label
            sizes = np.zeros(len(offsets), np.int32)
            sizes[full + 1] = trees
            lists = pa.ListArray.from_arrays(
                pa.array(np.cumsum(sizes), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("__rid"), batch.column("doc"), batch.column("words_md5"), lists],
                ["__rid", "doc", "words_md5", "keys"])
    return run


def _sets(batches):
    """Word hashes to the sorted distinct shingles of each document, as bytes."""
    for batch in batches:
        hashes, offsets = _flat(batch.column("hashes"))
        sh, starts = shingles(hashes, offsets)
        sets = [np.unique(sh[a:b]).tobytes() for a, b in zip(starts[:-1], starts[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("__rid"), batch.column("block"), batch.column("others"), pa.array(sets, pa.binary())],
            ["__rid", "block", "others", "shingles"])


def linked(sets: list, similarity: float) -> np.ndarray:
    """Matrix of the pairs whose Jaccard similarity reaches the threshold, exactly."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[column] > 1
    owner, column = owner[keep], (np.cumsum(count > 1) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float64)
    for a in range(0, column[-1] + 1 if len(column) else 0, _CHUNK):
        lo, hi = np.searchsorted(column, [a, a + _CHUNK])
        part = np.zeros((len(sets), _CHUNK), np.float32)
        part[owner[lo:hi], column[lo:hi] - a] = 1
        common += part @ part.T
    out = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    out &= sizes[:, None] > 0
    np.fill_diagonal(out, False)
    return out


def _verifier(similarity: float):
    def verify(key, rows):
        import pandas as pd
        i, j = key
        rows = rows.sort_values("__rid")
        ids, side = rows["__rid"].to_numpy(), rows["block"].to_numpy()
        links = linked([np.frombuffer(b, np.uint64) for b in rows["shingles"]], similarity)
        if i != j:
            links &= side[:, None] != side[None, :]
        count = links.sum(axis=1)
        # Smallest row linked to each, directly or over others of this block pair.
        root = np.arange(len(ids))
        while True:
            near = np.minimum(root, np.where(links, root[None, :], len(ids)).min(axis=1, initial=len(ids)))
            near = near[near]
            if (near == root).all():
                break
            root = near
        hit = count > 0
        return pd.DataFrame({"__rid": ids[hit], "links": count[hit].astype(np.int64), "root": ids[root[hit]]})
    return verify


def jaccard_join(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
    trees: int = TREES, recall: float = RECALL,
) -> DataFrame:
    """One row per document with its class and its links.

    ``copy_id``: smallest id among documents with the same sequence of words;
    ``n_links``: other such sequences whose sets of five-word shingles are similar
    to this one's; ``class_id``: smallest id among all documents reached over
    links; ``keeps``: true for exactly one row of each class.  Null, empty and
    wordless texts are copies of each other and have no links.  Null ids take
    part; an id column that is null throughout a class gives a null class_id.
    Repeated rows are copies.  Other columns are ignored.  Ties go to the smaller
    row number.
    """
    rows = with_row_ids(docs, "near-docs", F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    return _classes(rows, similarity, trees, recall).select(
        F.col("doc").alias(doc_id), "copy_id", "class_id", "n_links", "keeps")


def with_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the columns of ``jaccard_join``, row by row."""
    rows = with_row_ids(docs, "near-docs", F.struct(*docs.columns).alias("__row"))
    texts = rows.select("__rid", F.col("__row")[doc_id].alias("doc"), F.col("__row")[text].alias("text"))
    found = stage(_classes(texts, **options).select("__rid", "copy_id", "class_id", "n_links", "keeps"), "near-found")
    # Rows and texts always meet their narrow side in a merge, so that disk and
    # time grow in proportion at every size.
    return rows.select("__rid", "__row").hint("merge").join(found, "__rid").select("__row.*", "copy_id", "class_id", "n_links", "keeps")


def _classes(rows: DataFrame, similarity: float = SIMILARITY, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """Classes of rows (__rid, doc, text)."""
    small_batches(rows.sparkSession)
    tokens = rows.select("__rid", "doc", words(F.col("text")).alias("words"))
    length = prefix_length(similarity, trees, recall)
    sketch = stage(
        tokens.select("__rid", "doc", F.md5(F.array_join("words", " ")).alias("words_md5"), word_hashes(F.col("words")).alias("hashes"))
        .mapInArrow(_sketcher(trees, length), "__rid long, doc long, words_md5 string, keys array<long>"), "near-sketch")
    # One row stands for all copies.
    copies = stage(
        sketch.groupBy("words_md5").agg(F.min("__rid").alias("rep"), F.min("doc").alias("copy_id")), "near-copies")
    tries = (
        sketch.join(copies.select(F.col("rep").alias("__rid")), "__rid", "left_semi")
        .select("__rid", F.explode("keys").alias("key")))
    hubs = stage(
        tries.groupBy("key").agg(F.min("__rid").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("key", "hub"),
        "near-hubs")
    met = stage(tries.join(hubs, "key"), "near-met")
    # Neighbours gather around the smallest row they meet, and then around the one
    # that row has met, in blocks of bounded size.
    nearest = stage(met.groupBy("__rid").agg(F.min("hub").alias("hub")), "near-nearest")
    gathered = stage(
        nearest.join(nearest.select(F.col("__rid").alias("hub"), F.col("hub").alias("centre")), "hub")
        .select("__rid", "centre"), "near-centres")
    sizes = stage(
        gathered.groupBy("centre").agg(F.count("*").alias("n"))
        .select("centre", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "near-sizes")
    part = F.pmod(F.xxhash64("__rid"), F.col("blocks"))
    members = stage(
        gathered.join(sizes, "centre").select("__rid", F.xxhash64("centre", part).alias("block")), "near-members")
    # Blocks are compared if some subtree holds rows of both.
    places = stage(met.select("__rid", "key").join(members, "__rid").select("key", "block").distinct(), "near-places")
    partners = stage(
        places.join(places.withColumnRenamed("block", "other"), "key")
        .groupBy("block").agg(F.collect_set("other").alias("others")), "near-partners")
    sets = (
        rows.select("__rid", "text").hint("merge").join(members.join(partners, "block"), "__rid")
        .select("__rid", "block", "others", word_hashes(words(F.col("text"))).alias("hashes"))
        .mapInArrow(_sets, "__rid long, block long, others array<long>, shingles binary"))
    pairs = sets.select("__rid", "block", "shingles", F.explode("others").alias("other"))
    links = stage(
        pairs.groupBy(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        .applyInPandas(_verifier(similarity), "__rid long, links long, root long"), "near-links")
    groups = components(links.select(F.col("__rid").alias("a"), F.col("root").alias("b")), "near-groups")
    counts = links.groupBy("__rid").agg(F.sum("links").alias("n_links"))
    of_copy = stage(
        copies.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .join(counts.withColumnRenamed("__rid", "rep"), "rep", "left")
        .select("words_md5", "rep", "copy_id", F.coalesce("label", "rep").alias("label"),
                F.coalesce("n_links", F.lit(0)).alias("n_links")), "near-classes")
    of_group = stage(
        of_copy.groupBy("label").agg(F.min("copy_id").alias("class_id"), F.min("rep").alias("first")), "near-firsts")
    classes = stage(of_copy.join(of_group, "label").select("words_md5", "copy_id", "class_id", "n_links", "first"), "near-result")
    return (
        sketch.select("__rid", "doc", "words_md5").join(classes, "words_md5")
        .select("__rid", "doc", "copy_id", "class_id", "n_links", (F.col("__rid") == F.col("first")).alias("keeps")))
