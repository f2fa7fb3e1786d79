"""Periodic runs: stretches of words that repeat a shorter stretch, each as long as it goes.

A run of smallest period p is a maximal stretch in which every word equals the
one p words on.  Octave k looks for periods from B = 2**k to 2B - 1.  A document
is cut into overlapping tiles per octave, around boundaries that lie 2B words
apart.  At each boundary two Z-functions, one over the words from the boundary
on and one over the reversed words around it, tell for every lag how far both
sides agree with themselves that many words on.  Lags that a smaller one explains
(its stretch covers theirs) are multiples and go.  What is left are fragments of
runs, cut at the edges of the tile; they are dealt out by document and period and
stitched where they touch.

A run of period p agrees with itself at 3p places or more, so a boundary lies
inside, and each short group of words at these places comes again within 2B
words.  Only such places make tiles; they are found by sorting the groups of a
document that come more than once.  Words that repeat a period below the octave
hold no run of the octave and make no tile either.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import small_batches, stage

WORD = r"[^\x20\x09-\x0D]+"
# A run counts from this many words and this many periods on.
LEAST = 6
TIMES = 4
# Words whose boundaries share one tile; longer octaves have one boundary a tile.
TILE = 4096
_WORDS = re.compile(WORD)
_GRAM = 4
# Words of tiles, or characters of texts, sent on at a time.
_SENT = 1 << 22
_MIX = np.uint64(0x9E3779B97F4A7C15)


def codes_of(words: list[str]) -> np.ndarray:
    """A number per word, alike for equal words and no others."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int32, len(words))


def _grams(codes: np.ndarray, group: int) -> np.ndarray:
    """A hash per group of one, two or four words; a clash costs a tile and no run."""
    out = codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        for width in range(group.bit_length() - 1):
            out = out[:-1 << width] * _MIX + out[1 << width:]
            out ^= out >> np.uint64(29)
    return out


def _distance(grams: np.ndarray) -> np.ndarray:
    """For each group of words the distance to the next equal group, or the number of groups."""
    n = len(grams)
    out = np.full(n, n + 1, np.int64)
    # Groups alone in their hash bucket come once; only the others are sorted.
    bits = n.bit_length() + 2
    bucket = ((grams * _MIX) >> np.uint64(64 - bits)).astype(np.int64)
    again = np.flatnonzero(np.bincount(bucket, minlength=1 << bits)[bucket] > 1)
    order = again[np.argsort(grams[again], kind="stable")]
    same = grams[order[1:]] == grams[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _stretches(near: np.ndarray, least: int):
    """(start, end) of the stretches of true values that are long enough."""
    if np.count_nonzero(near) < least:
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([0], near.view(np.int8), [0]))))
    start, end = edges[::2], edges[1::2]
    long = end - start >= least
    return list(zip(start[long].tolist(), end[long].tolist()))


def _reach(step: int) -> int:
    """How far on both sides of a boundary a fragment is followed."""
    return 2 * step + _GRAM


def _worth(codes: np.ndarray, grams: np.ndarray, distance: np.ndarray, step: int, at: int) -> bool:
    """Whether a run of the octave may stand around a boundary.

    Its group of words must come again within the octave, and the words around must
    not repeat a period below the octave as a whole.
    """
    if not (grams[at + step:at + 2 * step] == grams[at]).any():
        return False
    return not _repeats(codes[max(0, at - _reach(step)):at + _reach(step) + 2 * step], int(distance[at]), step)


def _repeats(window: np.ndarray, period: int, step: int) -> bool:
    """Whether words repeat a period below the octave as a whole."""
    return period < step and np.array_equal(window[period:], window[:-period])


def tiles(codes: np.ndarray):
    """(octave, first boundary, boundaries, window start, words of the window) wherever a run may be.

    Boundaries lie two steps apart and stand where every group of words comes again
    within the octave, for as long as the shortest run of the octave asks.
    """
    n = len(codes)
    octave, step, group = 0, 1, 0
    while n >= LEAST and TIMES * step <= n:
        if group < min(step, _GRAM):
            group = min(step, _GRAM)
            grams = _grams(codes, group)
            distance = _distance(grams)
        # Places that agree one period on, less the words of a group.
        least = max((TIMES - 1) * step, LEAST - step) - group + 1
        places = _stretches(distance < 2 * step, least)
        if not places and group == _GRAM and not _stretches(distance <= n, least):
            return
        marked = [
            at for start, end in places for at in range(-(-start // (2 * step)) * 2 * step, end, 2 * step)
            if step < 16 or _worth(codes, grams, distance, step, at)]
        most = max(1, TILE // step)
        while marked:
            # Neighbouring boundaries share a tile.
            count = 1
            while count < min(most, len(marked)) and marked[count] == marked[0] + 2 * step * count:
                count += 1
            lo = max(0, marked[0] - _reach(step))
            window = codes[lo:marked[count - 1] + _reach(step) + 2 * step]
            if not _repeats(window, int(distance[marked[0]]), step):
                yield octave, marked[0], count, lo, window
            marked = marked[count:]
        octave, step = octave + 1, step * 2


def _z(text: list, upto: int) -> list:
    """For each place below ``upto`` the length of the longest common beginning with the whole text."""
    n = len(text)
    z = [0] * min(upto, n)
    left = right = 0
    for i in range(1, len(z)):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and text[k] == text[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def fragments(octave: int, first: int, count: int, lo: int, words: list):
    """(period, start, end) of places that agree with themselves one period on, around each boundary of a tile.

    A fragment that ends inside the reach on both sides is whole; if it is too short
    for a run, it is left out.
    """
    step = 1 << octave
    reach = _reach(step)
    for boundary in range(first, first + count * 2 * step, 2 * step):
        a = boundary - lo
        begin, lags = max(0, a - reach), min(2 * step, len(words) - a)
        if lags <= step:
            continue
        ahead = np.array(_z(words[a:a + reach + 2 * step], lags), np.int64)
        back = words[begin:a][::-1]
        around = words[begin:a + lags - 1][::-1]
        # Lag q meets the reversed words where the last word before boundary + q stands.
        z = _z(back + [-1] + around, len(back) + lags)
        behind = np.zeros(lags, np.int64)
        behind[1:] = z[len(back) + 1:len(back) + lags][::-1]
        lag = np.arange(lags)
        cut = np.minimum(ahead, reach)
        left = np.flatnonzero(ahead + behind >= lag)[1:]
        while len(left):
            q = left[0]
            whole = cut[q] < reach and behind[q] < reach
            if q >= step and (not whole or cut[q] + behind[q] >= max((TIMES - 1) * q, LEAST - q)):
                yield int(q), int(boundary - behind[q]), int(boundary + cut[q])
            left = left[1:]
            left = left[(ahead[q] + q < cut[left] + left) | (behind[q] < behind[left])]


_TILE_SCHEMA = "octave int, first long, count int, lo long, words binary"


def _explode(batches):
    """A row per document, then a row per tile; texts only of documents with tiles."""
    names = ["rid", "doc_id", "n_words", "words_sha256", "text", "octave", "first", "count", "lo", "words"]
    schema = None
    rows, sent = [], 0
    for batch in batches:
        if schema is None:
            schema = pa.schema([
                ("rid", pa.int64()), ("doc_id", batch.schema.field("doc_id").type), ("n_words", pa.int64()), ("words_sha256", pa.string()),
                ("text", pa.string()), ("octave", pa.int32()), ("first", pa.int64()), ("count", pa.int32()), ("lo", pa.int64()),
                ("words", pa.binary())])
        for rid, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("rid", "doc_id", "text"))):
            words = _WORDS.findall(text or "")
            joined = " ".join(words)
            digest = hashlib.sha256(joined.encode("utf-8", "surrogatepass")).hexdigest()
            here = 0
            for octave, first, count, lo, window in tiles(codes_of(words)):
                rows.append((rid, None, None, None, None, octave, first, count, lo, window.tobytes()))
                here, sent = here + 1, sent + len(window)
                if sent > _SENT:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], names)
                    rows, sent = [], 0
            rows.append((rid, doc_id, len(words), digest, joined if here else None, None, None, None, None, None))
            sent += len(joined) // 4 if here else 64
            if sent > _SENT:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], names)
                rows, sent = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], names)


def _solve(batches):
    for batch in batches:
        out = []
        for rid, octave, first, count, lo, words in zip(*(batch.column(c).to_pylist() for c in ("rid", "octave", "first", "count", "lo", "words"))):
            out.extend((rid, *f) for f in fragments(octave, first, count, lo, np.frombuffer(words, np.int32).tolist()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["rid", "period", "start", "end"])


def stitched(pieces: DataFrame) -> DataFrame:
    """Runs from fragments (rid, period, start, end): those of one document and period that touch are one."""
    order = Window.partitionBy("rid", "period").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = F.when(reached >= F.col("start"), 0).otherwise(1)
    runs = (
        pieces.distinct().withColumn("begun", begun)
        .withColumn("run", F.sum("begun").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("rid", "period", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")))
    length = F.col("end") - F.col("start") + F.col("period")
    return runs.select("rid", "start", length.alias("length"), "period").filter(
        F.col("length") >= F.greatest(F.lit(LEAST), F.lit(TIMES) * F.col("period")))


def _kept(batches):
    """Documents with the words that no run repeats."""
    for batch in batches:
        texts, digests = [], []
        for text, runs, digest in zip(*(batch.column(c).to_pylist() for c in ("text", "runs", "words_sha256"))):
            if runs:
                words = text.split(" ")
                # +1 where a repeat begins and -1 behind its end: dropped where the sum is above 0.
                steps = np.zeros(len(words) + 1, np.int64)
                for r in runs:
                    steps[r["start"] + r["period"]] += 1
                    steps[r["start"] + r["length"]] -= 1
                text = " ".join([words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()])
                digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
            else:
                text = None
            texts.append(text)
            digests.append(digest)
        yield pa.RecordBatch.from_arrays(
            [batch.column("rid"), batch.column("doc_id"), batch.column("n_words"), batch.column("runs"), pa.array(texts, pa.string()), pa.array(digests, pa.string())],
            ["rid", "doc_id", "n_words", "runs", "collapsed", "collapsed_sha256"])


def collapse(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: rid, doc_id, n_words, runs, collapsed, collapsed_sha256.

    ``runs`` are sorted by start, then period; each counts ``LEAST`` words and
    ``TIMES`` periods at least.  ``collapsed`` is the text without the words that a
    run repeats, i.e. all of it after its first period, joined by single spaces;
    it is null where there is no run.  ``collapsed_sha256`` is the digest of what
    is left in any case (of all words, if there is no run).

    Null and blank texts have no words and no runs; null ids and repeated rows
    are documents of their own; other columns are ignored; an empty table gives
    no rows.  A document travels whole only if it has tiles.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    exploded = stage(
        rows.mapInArrow(_explode, f"rid long, doc_id {id_type}, n_words long, words_sha256 string, text string, {_TILE_SCHEMA}"),
        "period-tiles")
    cut = exploded.filter("octave is not null").select("rid", "octave", "first", "count", "lo", "words")
    # A number of its own, as tiles are few bytes but much work and would be put into few tasks.
    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pieces = cut.repartition(parts, "rid", "octave", "first").mapInArrow(_solve, "rid long, period long, start long, end long")
    runs = stitched(pieces).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    runs_type = "array<struct<start:bigint,length:bigint,period:bigint>>"
    whole = exploded.filter("octave is null").select("rid", "doc_id", "n_words", "words_sha256", "text")
    runs = stage(runs, "period-runs")
    joined = (
        whole.filter("text is not null").hint("merge").join(runs, "rid", "left")
        .select("rid", "doc_id", "n_words", "words_sha256", "text", F.coalesce("runs", F.expr(f"cast(array() as {runs_type})")).alias("runs"))
        .mapInArrow(_kept, f"rid long, doc_id {id_type}, n_words long, runs {runs_type}, collapsed string, collapsed_sha256 string"))
    plain = whole.filter("text is null").select(
        "rid", "doc_id", "n_words", F.expr(f"cast(array() as {runs_type})").alias("runs"), F.lit(None).cast("string").alias("collapsed"),
        F.col("words_sha256").alias("collapsed_sha256"))
    return joined.unionByName(plain)
