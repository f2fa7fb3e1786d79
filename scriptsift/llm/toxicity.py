"""Toxicity: a factorization machine over hashed terms.

Terms are words and word beginnings, hashed into a fixed number of slots.  The
score of a text is a bias, a weight per term, and for every pair of terms the
inner product of their factors, so a pair can count for more than its parts
(an insult beside a named group).  The pair sum costs one pass over the terms.

The machine is trained on a sample of labelled texts of bounded size (chosen by
a hash of the id, alike at every scale); scoring runs over all texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind
from .common import small_batches, words
from .near import _flat

SLOTS = 1 << 18
FACTORS = 8
SAMPLE = 12_000
BEGINNING = 5
THRESHOLD = 0.3
EPOCHS = 8
MIN_TEXTS = 3
MIN_RATIO = 6.0
# Texts and terms multiplied at a time while pairs of terms are counted.
CHUNK = 1024
PAIR_ROWS = 256
STEPS = 600
SEED = 7


def term_slots(text: Column, slots: int = SLOTS) -> Column:
    """Slot numbers of all words and of the beginnings of longer words."""
    def of(tokens):
        begin = F.transform(
            F.filter(tokens, lambda w: F.length(w) > BEGINNING),
            lambda w: F.pmod(F.xxhash64(F.substring(w, 1, BEGINNING), F.lit(1)), F.lit(slots)))
        return F.concat(F.transform(tokens, lambda w: F.pmod(F.xxhash64(w), F.lit(slots))), begin)
    return bind(words(text), of)


def features(values: np.ndarray, offsets: np.ndarray, slots: int = SLOTS):
    """(document, slot, value) of distinct terms; values grow with the log of the count."""
    docs = len(offsets) - 1
    owner = np.repeat(np.arange(docs), np.diff(offsets))
    cells, counts = np.unique(owner * np.int64(slots) + values.astype(np.int64), return_counts=True)
    doc, slot = cells // slots, cells % slots
    return doc, slot, np.log1p(counts).astype(np.float32)


def association(slot, labels_of_rows, docs: int, positive: int, slots: int) -> np.ndarray:
    """Likelihood-ratio statistic of every term's presence against the label."""
    seen = np.bincount(slot, minlength=slots).astype(np.float64)
    hits = np.bincount(slot, labels_of_rows, slots)
    rest, other = positive - hits, docs - positive - (seen - hits)
    total = np.zeros(slots)
    for count, expected in (
        (hits, seen * positive / docs), (seen - hits, seen * (docs - positive) / docs),
        (rest, (docs - seen) * positive / docs), (other, (docs - seen) * (docs - positive) / docs),
    ):
        total += np.where(count > 0, 2 * count * np.log(np.maximum(count, 1e-12) / np.maximum(expected, 1e-12)), 0)
    return total


def paired(doc, slot, labels: np.ndarray, slots: int, ratio: float = MIN_RATIO) -> np.ndarray:
    """Terms that tell about the label beside some other term, however neutral alone.

    For two terms, the label is compared with the second among the texts that
    hold the first, and the other way round; the smaller likelihood ratio counts,
    so a term does not qualify by standing beside a telling one.  As all pairs
    are tried, ``ratio`` grows by twice the log of their number.  A ratio cannot
    exceed the entropy of the labels of a term's texts, which leaves the terms
    worth pairing; all pairs of these are tried, some rows of the matrix at a time.
    """
    docs = len(labels)
    log = np.concatenate([[0], np.arange(1, docs + 1) * np.log(np.arange(1, docs + 1))]).astype(np.float32)
    seen = np.bincount(slot, minlength=slots)
    hits = np.bincount(slot, labels[doc], slots).astype(np.int64)
    entropy = 2 * (log[seen] - log[hits] - log[seen - hits])
    out = np.zeros(slots, bool)
    terms = np.flatnonzero((seen >= MIN_TEXTS) & (entropy >= ratio))
    while True:
        pairs = max(len(terms) * (len(terms) - 1) / 2, 1)
        fewer = terms[entropy[terms] >= ratio + 2 * np.log(pairs)]
        if len(fewer) == len(terms):
            break
        terms = fewer
    bound = ratio + 2 * np.log(pairs)
    number = np.full(slots, -1)
    number[terms] = np.arange(len(terms))
    kept = number[slot] >= 0
    doc, term = doc[kept], number[slot[kept]]
    bounds = np.searchsorted(doc, np.arange(0, docs + CHUNK, CHUNK))
    n, h = seen[terms], hits[terms]

    def conditional(s, x, n, h):
        # Texts of one term by label and by presence of the other.
        return 2 * (log[x] + log[s - x] + log[h - x] + log[n - h - s + x] - log[s] - log[n - s] - log[h] - log[n - h] + log[n])

    for a in range(0, len(terms), PAIR_ROWS):
        b = min(a + PAIR_ROWS, len(terms))
        both, toxic = np.zeros((b - a, len(terms) - a), np.float32), np.zeros((b - a, len(terms) - a), np.float32)
        for k, (start, end) in enumerate(zip(bounds[:-1], bounds[1:])):
            size = min(CHUNK, docs - k * CHUNK)
            some = np.flatnonzero(term[start:end] >= a) + start
            holds = np.zeros((size, len(terms) - a), np.float32)
            holds[doc[some] - k * CHUNK, term[some] - a] = 1
            both += holds[:, :b - a].T @ holds
            holds = holds[labels[k * CHUNK:k * CHUNK + size] > 0]
            toxic += holds[:, :b - a].T @ holds
        both, toxic = both.astype(np.int32), toxic.astype(np.int32)
        least = np.minimum(
            conditional(both, toxic, n[a:b, None], h[a:b, None]), conditional(both, toxic, n[None, a:], h[None, a:]))
        least[np.arange(b - a), np.arange(b - a)] = 0
        row, column = np.nonzero(least >= bound)
        out[terms[a + row]] = out[terms[a + column]] = True
    return out


class Machine:
    """Factorization machine with logistic output."""

    def __init__(self, slots: int = SLOTS, factors: int = FACTORS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.slots = slots
        self.bias = 0.0
        self.weight = np.zeros(slots, np.float32)
        self.factor = rng.normal(0, 0.05, (slots, factors)).astype(np.float32)

    def raw(self, doc, slot, x, docs: int):
        """(score before the logistic, factor sums per document)."""
        scaled = self.factor[slot] * x[:, None]
        bounds = np.searchsorted(doc, np.arange(docs + 1))
        full = np.flatnonzero(np.diff(bounds))
        sums = np.zeros((docs, self.factor.shape[1]), np.float32)
        squares = np.zeros(docs, np.float32)
        linear = np.zeros(docs, np.float32)
        if len(full):
            at = bounds[full]
            sums[full] = np.add.reduceat(scaled, at)
            squares[full] = np.add.reduceat((scaled * scaled).sum(axis=1), at)
            linear[full] = np.add.reduceat(self.weight[slot] * x, at)
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def score(self, doc, slot, x, docs: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(doc, slot, x, docs)[0].astype(np.float64), -30, 30)))

    def fit(self, doc, slot, x, labels, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.3, decay: float = 1e-5, seed: int = SEED):
        """AdaGrad over shuffled batches.

        Only terms tied to the label learn: seen in ``MIN_TEXTS`` texts, with a
        likelihood ratio of ``MIN_RATIO`` of their own or, as ``paired`` says,
        beside another term.  All others stay at zero.
        """
        docs = len(labels)
        self.weight[:] = 0
        if not docs:
            self.factor[:] = 0
            return self
        tied = association(slot, labels[doc].astype(np.float64), docs, int(labels.sum()), self.slots) >= MIN_RATIO
        tied &= np.bincount(slot, minlength=self.slots) >= MIN_TEXTS
        tied |= paired(doc, slot, labels, self.slots)
        self.factor[~tied] = 0
        keep = tied[slot]
        doc, slot, x = doc[keep], slot[keep], x[keep]
        epochs = max(epochs, -(-STEPS * batch // docs))
        rate_bias = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
        self.bias = float(np.log(rate_bias / (1 - rate_bias)))
        bounds = np.searchsorted(doc, np.arange(docs + 1))
        g_w, g_v, g_b = np.full(self.slots, 1e-6, np.float32), np.full_like(self.factor, 1e-6), 1e-6
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(docs)
            for a in range(0, docs, batch):
                some = order[a:a + batch]
                sizes = bounds[some + 1] - bounds[some]
                at = np.repeat(bounds[some] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                d, s, v = np.repeat(np.arange(len(some)), sizes), slot[at], x[at]
                raw, sums = self.raw(d, s, v, len(some))
                error = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[some]) / len(some)).astype(np.float32)
                self.bias -= rate * error.sum() / np.sqrt(g_b := g_b + float(error.sum()) ** 2)
                touched, back = np.unique(s, return_inverse=True)
                step = error[d] * v
                grad_w = np.bincount(back, step, len(touched)).astype(np.float32) + decay * self.weight[touched]
                each = step[:, None] * (sums[d] - self.factor[s] * v[:, None])
                by = np.argsort(back, kind="stable")
                starts = np.searchsorted(back[by], np.arange(len(touched)))
                grad_v = (np.add.reduceat(each[by], starts) if len(touched) else each) + decay * self.factor[touched]
                g_w[touched] += grad_w ** 2
                g_v[touched] += grad_v ** 2
                self.weight[touched] -= rate * grad_w / np.sqrt(g_w[touched])
                self.factor[touched] -= 0.5 * rate * grad_v / np.sqrt(g_v[touched])
        return self


def held_out(doc_id: str) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Machine:
    """Fit on at most about ``sample`` labelled texts outside the held-out quarter.

    The sample takes ids whose hash lies below a bound set by their number, so
    it spreads over the whole table; the driver receives its term slots only.
    Labels other than 0 and 1, null ids and null texts do not teach.
    """
    small_batches(docs.sparkSession)
    known = (
        labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__label"))
        .filter(F.col("__id").isNotNull() & F.col("__label").isin(0, 1)).filter(~held_out("__id"))
        .groupBy("__id").agg(F.max("__label").alias("__label")))
    share = min(1.0, sample / max(known.count(), 1))
    chosen = known.filter(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = (
        docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
        .filter(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(share * 1_000_000))
        .join(chosen, "__id").filter(F.col("__text").isNotNull())
        .select("__id", "__label", term_slots(F.col("__text")).alias("hashes")))

    def reduce(batches):
        for batch in batches:
            doc, slot, x = features(*_flat(batch.column("hashes")))
            sizes = np.bincount(doc, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column("__label"),
                 pa.array([s.astype(np.int32).tobytes() for s in np.split(slot, np.cumsum(sizes)[:-1])], pa.binary()),
                 pa.array([v.tobytes() for v in np.split(x, np.cumsum(sizes)[:-1])], pa.binary())],
                ["id", "label", "slots", "values"])

    got = rows.mapInArrow(reduce, "id long, label int, slots binary, values binary").toArrow()
    # Sorted by id once, straight into the arrays to learn from; the table goes before learning begins.
    order = np.argsort(got["id"].to_numpy(), kind="stable")
    taken = got.take(pa.array(order)).combine_chunks()
    labels_ = taken["label"].to_numpy().astype(np.float32)
    (slot, sizes), (x, _) = _joined(taken["slots"], np.int32), _joined(taken["values"], np.float32)
    del got, taken
    return Machine().fit(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), slot, x, labels_)


def _joined(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all rows one after the other, how many each row has) of a binary column."""
    values = column.combine_chunks()
    if isinstance(values, pa.ChunkedArray):  # no rows
        values = pa.array([], pa.binary())
    if not len(values):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data.copy().view(kind), np.diff(offsets) // 4


def scores(text: Column, machine: Machine) -> Column:
    """Column of scores between 0 and 1; texts without terms score the bias."""
    active = np.flatnonzero(machine.weight.astype(bool) | machine.factor.any(axis=1))
    packed = (machine.slots, machine.bias, active, machine.weight[active], machine.factor[active])

    @F.arrow_udf("double")
    def score(slots: pa.Array) -> pa.Array:
        size, bias, known, weight, factor = packed
        own = Machine.__new__(Machine)
        own.slots, own.bias, own.weight, own.factor = len(known), bias, weight, factor
        number = np.full(size, -1, np.int32)
        number[known] = np.arange(len(known))
        values, offsets = _flat(slots)
        # Terms without weight and factors add nothing.
        values = number[values.astype(np.int64)]
        kept = np.concatenate([[0], np.cumsum(values >= 0)])[offsets]
        return pa.array(own.score(*features(values[values >= 0], kept, max(len(known), 1)), len(offsets) - 1))
    return score.asNondeterministic()(term_slots(text, machine.slots))


def with_toxicity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = "score", **options,
) -> DataFrame:
    """``docs`` plus a toxicity score of each whole text.

    Null and empty texts get the score of a text without terms; repeated rows
    agree; without usable labels every score is 0.5.  A column called ``name`` is
    replaced.
    """
    machine = train(docs, labels, doc_id, text, **options)
    return docs.withColumn(name, scores(F.col(text), machine))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that score below the threshold; all of them, where the labels teach nothing.

    Rows pass as ``with_toxicity`` scores them, with their own columns.
    """
    machine = train(docs, labels, doc_id, text, **options)
    if not (machine.weight.any() or machine.factor.any()):
        return docs
    return docs.withColumn("__toxicity", scores(F.col(text), machine)).filter(F.col("__toxicity") < threshold).select(*docs.columns)
