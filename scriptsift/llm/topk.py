"""Exact top-k by inner product: pivot-table elimination.

Distances of every vector to a set of pivots are computed once.  For a query q
and a candidate x the largest |d(q,p) - d(x,p)| over all pivots p bounds their
distance from below, and so, with the norms, their inner product from above.
Candidates are evaluated in the order of that bound; as soon as the k-th best
score exceeds every bound left, the search ends with the exact result.

Queries and candidates meet in blocks of bounded size, each pair of blocks in a
task of its own.  A pair returns k rows' worth per query as one packed row;
packed rows are merged in groups of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

K = 20
SCALE = 64
PIVOTS = 64
PIVOT_SAMPLE = 1024
QUERY_BLOCK = 512
BLOCK = 4096
# Packed rows merged at a time.
FAN = 64
# Share of candidates evaluated before the first test for the end.
FIRST = 4
HEAP = "array<struct<score:long,vec_id:long>>"


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Farthest-first pivots: each next one is farthest from those chosen; ties to the first."""
    if not len(sample):
        return sample
    chosen = [0]
    gap = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def pivot_table(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the pivots, one row per pivot."""
    v = vectors.astype(np.float64)
    p = pivots.astype(np.float64)
    square = (v * v).sum(axis=1)[None, :] + (p * p).sum(axis=1)[:, None] - 2 * (p @ v.T)
    return np.sqrt(np.maximum(square, 0)).astype(np.float32)


def _products(queries: np.ndarray, vectors: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; doubles are exact while sums stay below 2**53."""
    if exact:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries @ vectors.T


def search_block(queries, query_rows, query_table, vectors, rows, ids, table, k: int):
    """Per query the best (scores, ids) of one block of candidates, exactly.

    A candidate that is the query's own row takes no part.  Rounds grow by
    powers of ``FIRST``; a round takes, for each query still open, the candidates
    next in the order of the bound, and a query closes when its k-th score
    exceeds the bound of all that follow.
    """
    nq, nx = len(queries), len(vectors)
    lower = np.zeros((nq, nx), np.float32)
    for p in range(len(table)):
        np.maximum(lower, np.abs(query_table[p][:, None] - table[p][None, :]), out=lower)
    square_q = (queries.astype(np.float64) ** 2).sum(axis=1)
    square_x = (vectors.astype(np.float64) ** 2).sum(axis=1)
    # Distances carry rounding errors, so the bound is taken a little wider.
    slack = 1e-4 * (square_q.max(initial=1) + square_x.max(initial=1)) + 1
    upper = ((square_q[:, None] + square_x[None, :] - lower.astype(np.float64) ** 2) / 2 + slack).astype(np.float32)
    own = query_rows[:, None] == rows[None, :]
    upper[own] = -np.inf
    big = max(square_q.max(initial=0), square_x.max(initial=0)) >= 2 ** 52
    scores = np.full((nq, nx), np.iinfo(np.int64).min)
    done = np.zeros((nq, nx), bool)
    done[own] = True
    active = np.arange(nq)
    taken = min(nx, max(FIRST * k, 1))
    while len(active):
        bounds = upper[active]
        cut = -np.partition(-bounds, taken - 1, axis=1)[:, taken - 1] if taken < nx else np.full(len(active), -np.inf)
        now = (bounds >= cut[:, None]) & ~done[active]
        columns = np.flatnonzero(now.any(axis=0))
        if len(columns):
            part = _products(queries[active], vectors[columns], not big)
            fresh = now[:, columns]
            block = scores[np.ix_(active, columns)]
            scores[np.ix_(active, columns)] = np.where(fresh, part, block)
            done[active] |= now
        if taken >= nx:
            break
        kth = np.partition(scores[active], max(nx - k, 0), axis=1)[:, max(nx - k, 0)] if nx >= k else np.full(len(active), np.iinfo(np.int64).min)
        left = np.where(done[active], -np.inf, bounds).max(axis=1)
        active = active[left >= kth.astype(np.float64) - slack]
        taken = min(nx, taken * FIRST)
    out = []
    for q in range(nq):
        at = np.flatnonzero(done[q] & ~own[q])
        if len(at) > k:
            least = np.partition(scores[q, at], len(at) - k)[len(at) - k]
            at = at[scores[q, at] >= least]
        best = at[np.lexsort((ids[at], -scores[q, at]))][:k]
        out.append((scores[q, best], ids[best]))
    return out


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in column])


def _cell(pivots_by_size: dict, k: int):
    def run(key, rows):
        queries = rows[rows["__side"] == 0].sort_values("__rid")
        others = rows[rows["__side"] == 1].sort_values("__rid")
        size, block = int(key[0]), int(key[2])
        if not len(queries) or not len(others):
            return pd.DataFrame({"__rid": [], "query_id": [], "block": [], "best": []})
        pivots = pivots_by_size[size]
        q, x = _matrix(queries["v"]), _matrix(others["v"])
        best = search_block(
            q, queries["__rid"].to_numpy(), pivot_table(q, pivots),
            x, others["__rid"].to_numpy(), others["id"].to_numpy(), pivot_table(x, pivots), k)
        return pd.DataFrame({
            "__rid": queries["__rid"].to_numpy(), "query_id": queries["id"].to_numpy(), "block": block,
            "best": [[{"score": int(s), "vec_id": int(i)} for s, i in zip(*b)] for b in best]})
    return run


def top_k(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, queries=None, pivots: int = PIVOTS) -> DataFrame:
    """The k best partners of every query row: query_id, rank, vec_id, score.

    Components become floor(64·x); the score is their integer inner product.
    ``queries`` is a condition on rows (default: id divisible by 20).  A row is
    never its own partner, but other rows of the same id or vector are.  Ties go
    to the smaller id.  Rows with a null id, a null, empty or shorter vector, or a
    component that is null or not finite take no part; vectors meet those of
    their own length only.  Scores beyond 64 bits wrap.
    """
    chosen = F.pmod(F.col("id"), F.lit(20)) == 0 if queries is None else queries
    value = F.transform(F.col(embedding), lambda x: x.cast("double"))
    fit = F.col(embedding).isNotNull() & (F.size(embedding) > 0) & F.forall(
        value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = stage(
        vectors.filter(F.col(vec_id).isNotNull()).filter(F.coalesce(fit, F.lit(False)))
        .select(F.monotonically_increasing_id().alias("__rid"), F.col(vec_id).cast("long").alias("id"),
                F.transform(value, lambda x: F.floor(x * SCALE)).alias("v"))
        .select("__rid", "id", "v", F.size("v").alias("size"), chosen.alias("asks")), "topk-vectors")
    sizes = rows.groupBy("size").agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).filter("q > 0").collect()
    out = None
    for size in sorted(sizes):
        part = _of_size(rows.filter(F.col("size") == size["size"]), size["size"], size["n"], size["q"], k, pivots)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.limit(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    return out


def _of_size(rows: DataFrame, size: int, n: int, asking: int, k: int, pivots: int) -> DataFrame:
    # Pivots come from a sample of bounded size, taken by a hash of the row.
    share = int(min(1.0, 2 * PIVOT_SAMPLE / n) * 1_000_000) + 1
    sample = rows.filter(F.pmod(F.xxhash64("__rid"), F.lit(1_000_000)) < share).orderBy(F.xxhash64("__rid")).limit(PIVOT_SAMPLE).select("v").collect()
    table = choose_pivots(np.array([r["v"] for r in sample], np.float64).reshape(-1, size), pivots)
    blocks, groups = -(-n // BLOCK), -(-asking // QUERY_BLOCK)
    ask = rows.filter("asks").select(
        "__rid", "id", "v", F.lit(0).alias("__side"), F.lit(size).alias("size"),
        F.pmod(F.xxhash64("__rid", F.lit(1)), F.lit(groups)).cast("int").alias("group"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    answer = rows.select(
        "__rid", "id", "v", F.lit(1).alias("__side"), F.lit(size).alias("size"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
        F.pmod(F.xxhash64("__rid", F.lit(2)), F.lit(blocks)).cast("int").alias("block"))
    best = (
        ask.unionByName(answer.select(*ask.columns)).groupBy("size", "group", "block")
        .applyInPandas(_cell({size: table}, k), f"__rid long, query_id long, block int, best {HEAP}"))
    order = lambda a, b: (
        F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1)
        .when(a["vec_id"] < b["vec_id"], -1).when(a["vec_id"] > b["vec_id"], 1).otherwise(0))
    while True:
        best = (
            best.groupBy("__rid", "query_id", F.floor(F.col("block") / FAN).cast("int").alias("block"))
            .agg(F.slice(F.array_sort(F.flatten(F.collect_list("best")), order), 1, k).alias("best")))
        blocks = -(-blocks // FAN)
        if blocks == 1:
            break
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("b")["vec_id"].alias("vec_id"), F.col("b")["score"].alias("score"))
