"""Training-order materialisation: token sequences in fixed-stride shards.

Texts are tokenised and cut into sequences of equal length; a keyed Feistel
permutation of the sequence numbers, walked along its cycle until it falls
inside the range, gives each sequence its slot.  Shard k holds slots k·S to
(k+1)·S-1 in order and every record takes ``stride`` bytes, so slot s is at a
computed place and reading resumes anywhere.

A record is the document id (8 bytes), the number of the sequence in its
document (4 bytes), the number of ids (2 bytes), the ids (2 bytes each, most
significant first, padded) and one line feed.  Shards are written by Spark's own file writer, which commits
each as a whole: a lost executor costs a repeated task, never half a shard.

Sequences are numbered by scan partition and place in it.  A first pass counts
them, a second one cuts them; texts are tokenised twice so that tokens are
never stored between the two.  The second pass checks for each partition that
it sees the same texts as the first and fails otherwise.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared, small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
LENGTH = 256
SHARD_ROWS = 8192
KEY = 2024
ROUNDS = 6
# Ids the ranks leave free: behind the last token of a text, and after it.
END, PAD = 50_256, 65_535
HEADER = 14
# Stands for a null document id in a record.
NO_ID = -(1 << 63)
_ENCODINGS: dict[str, tuple] = {}
# White space as the expression's \s has it: one byte, or begun by one of these pairs.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_WIDE_BLANK = ((0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80))


def _encodings(path: str):
    """Two encodings of the same ranks: of any text, and of texts without runs of white space.

    Without such runs the look-ahead of the expression decides nothing, and the
    expression is faster without it.
    """
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = public_tokenizers.PATTERN
        _ENCODINGS[path] = tuple(
            tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            for name, p in (("any", pattern), ("plain", pattern.replace(r"|\s+(?!\S)", ""))))
    return _ENCODINGS[path]


def _with_runs(texts: pa.Array) -> np.ndarray:
    """Which texts may hold two white-space characters in a row."""
    out = np.zeros(len(texts), bool)
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return out
    offsets = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    blank = _BLANK[raw]
    odd = blank[:-1] & blank[1:]
    for first, second in _WIDE_BLANK:
        at = np.flatnonzero(raw[:-1] == first)
        odd[at[raw[at + 1] == second]] = True
    out[np.searchsorted(offsets - offsets[0], np.flatnonzero(odd), side="right") - 1] = True
    return out


def _tokenised(batch, vocabulary: str):
    """(row, ids) of every non-empty text of a batch."""
    any_, plain = _encodings(vocabulary)
    texts = batch.column("text")
    for row, (text, runs) in enumerate(zip(texts.to_pylist(), _with_runs(texts))):
        if text:
            yield row, (any_ if runs else plain)(text)


def _sign(batch, sign: int) -> int:
    """A digest of the texts seen so far, in order."""
    with np.errstate(over="ignore"):
        hashes = batch.column("mark").to_numpy(zero_copy_only=False).view(np.uint64)
        return int((hashes * (np.arange(len(hashes), dtype=np.uint64) * np.uint64(2) + np.uint64(sign % (1 << 32) * 2 + 1))).sum()) % (1 << 62)


def feistel(numbers: np.ndarray, bits: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """Keyed permutation of the integers below 2**bits; ``bits`` is even.

    Each round adds a keyed hash of one half of the number to the other and swaps
    them, which can be undone whatever the hash.
    """
    half, mask = np.uint64(bits // 2), np.uint64((1 << bits // 2) - 1)
    left, right = numbers >> half, numbers & mask
    for k in range(rounds):
        x = (right + np.uint64((key * 0x9E3779B97F4A7C15 + k * 0xD1B54A32D192ED03) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        left, right = right, left ^ ((x ^ (x >> np.uint64(32))) & mask)
    return (left << half) | right


def slots(numbers: np.ndarray, total: int, key: int) -> np.ndarray:
    """Permutation of 0..total-1: numbers that leave the range walk on along their cycle."""
    bits = max(2, (total - 1).bit_length() + (total - 1).bit_length() % 2)
    out = feistel(numbers.astype(np.uint64), bits, key)
    while (outside := out >= total).any():
        out[outside] = feistel(out[outside], bits, key)
    return out.astype(np.int64)


def _counter(vocabulary: str, length: int):
    def count(batches):
        rows = sign = 0
        for batch in batches:
            rows += sum(-(-(len(ids) + 1) // length) for _, ids in _tokenised(batch, vocabulary))
            sign = _sign(batch, sign)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([TaskContext.get().partitionId()], pa.int32()),
            "rows": pa.array([rows], pa.int64()), "sign": pa.array([sign], pa.int64())})
    return count


def _cutter(vocabulary: str, length: int, parts: dict, total: int, key: int, shard_rows: int):
    def cut(batches):
        first, expected, expected_sign = parts.get(TaskContext.get().partitionId(), (0, 0, 0))
        done = sign = 0
        for batch in batches:
            sign = _sign(batch, sign)
            docs = batch.column("doc").fill_null(NO_ID).to_numpy()
            blocks = []
            for row, ids in _tokenised(batch, vocabulary):
                n = -(-(len(ids) + 1) // length)
                padded = np.full(n * length, PAD, ">u2")
                padded[:len(ids)] = ids
                padded[len(ids)] = END
                block = np.empty((n, HEADER + 2 * length), np.uint8)
                block[:, :8] = docs[row:row + 1].astype(">i8").view(np.uint8)
                block[:, 8:12] = np.arange(n).astype(">i4").view(np.uint8).reshape(n, 4)
                block[:, 12:HEADER] = np.minimum(len(ids) + 1 - np.arange(n) * length, length).astype(">u2").view(np.uint8).reshape(n, 2)
                block[:, HEADER:] = padded.view(np.uint8).reshape(n, 2 * length)
                blocks.append(block)
            if not blocks:
                continue
            records = np.concatenate(blocks)
            n = len(records)
            at = slots(first + done + np.arange(n), total, key)
            done += n
            data = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(records.shape[1]), n, [None, pa.py_buffer(records.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array((at // shard_rows).astype(np.int32)), pa.array(at), data], ["shard", "slot", "record"])
        if (done, sign) != (expected, expected_sign):
            raise RuntimeError("the texts were dealt out differently in the two passes; write them to a table first")
    return cut


def materialise(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
    length: int = LENGTH, shard_rows: int = SHARD_ROWS, key: int = KEY,
) -> int:
    """Write the shards of ``docs`` below ``path``; returns the number of sequences.

    Null and empty texts give no sequence; repeated rows give one each; null ids
    are written as ``NO_ID``; other columns are ignored; an empty table gives an
    empty folder.  The driver holds three numbers per scan partition.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("mark"))
    counts = sorted(
        tuple(r) for r in rows.mapInArrow(_counter(vocabulary, length), "part int, rows long, sign long").collect())
    parts, total = {}, 0
    for part, n, sign in counts:
        parts[part] = (total, n, sign)
        total += n
    records = rows.mapInArrow(
        _cutter(vocabulary, length, parts, total, key, shard_rows), "shard int, slot long, record binary")
    # Ranges of slots of equal length, so no sample has to find their bounds.
    shards = max(1, -(-total // shard_rows))
    (
        records.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "slot")
        .select("shard", F.col("record").cast("string").alias("value"))
        .write.mode("overwrite").partitionBy("shard").text(path)
    )
    return total


def stride(length: int = LENGTH) -> int:
    return HEADER + 2 * length + 1


def _number(data: Column, at: Column, size: int) -> Column:
    return F.conv(F.hex(data.substr(at, F.lit(size))), 16, -10).cast("long")


def read_shards(spark: SparkSession, path: str, length: int = LENGTH, shard_rows: int = SHARD_ROWS, first: int = 0) -> DataFrame:
    """Records from slot ``first`` on: slot, shard, doc_id, sequence, ids as bytes, number of tokens.

    Shards before it are not opened.
    """
    size = stride(length)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    if "shard" not in files.columns:  # no sequence, so no shard
        files = files.withColumn("shard", F.lit(0))
    files = files.filter(F.col("shard") >= first // shard_rows)
    k = F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("content") / size).cast("int") - 1)).alias("k")
    record = F.col("content").substr(F.col("k") * size + 1, F.lit(size - 1))
    ids = F.col("record").substr(F.lit(HEADER + 1), F.lit(2 * length))
    doc = _number(F.col("record"), F.lit(1), 8)
    return (
        files.filter(F.octet_length("content") > 0).select("shard", "content", k)
        .select((F.col("shard").cast("long") * shard_rows + F.col("k")).alias("slot"), "shard", record.alias("record"))
        .filter(F.col("slot") >= first)
        .select("slot", "shard", F.nullif(doc, F.lit(NO_ID)).alias("doc_id"),
                _number(F.col("record"), F.lit(9), 4).cast("int").alias("sequence"),
                _number(F.col("record"), F.lit(13), 2).cast("int").alias("n_tokens"), ids.alias("ids")))


def ordered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Write the shards to a fresh shared folder and read their records back."""
    spark = docs.sparkSession
    path = shared(spark, "training-order")
    materialise(docs, path, doc_id, text, **options)
    return read_shards(spark, path, options.get("length", LENGTH), options.get("shard_rows", SHARD_ROWS))
