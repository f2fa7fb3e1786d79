"""Alignment of the tokens of two tokenizers over the bytes of a text.

A token's end is the byte where it stops.  Merging the ends of both tokenizers
in order gives everything: each distinct end closes one overlap of an A and a B
token, and each end common to both closes a group.

The merge is cut by merge paths: on a diagonal, a binary search finds how many
ends of A and of B are among the first so many of the merge.  Pieces of equal
work come out, however unlike the two sides are, and each knows all it needs: its
ends, the offset before it and the tokens that reach beyond it.  A piece emits its
overlaps; groups inside it are closed, those across its edges are stitched per
document.  Links between ids are counted over the whole corpus and the counts
brought back to every document.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage

# Ends in one piece of a merge.
PIECE = 32_768
# Id pairs whose counts are sent to every task: those with the most links.  The others are joined.
FREQUENT = 1 << 17
# Ids must stay below this, so that a pair and its number of links fit one integer.
MOST_IDS = 1 << 20
_TIMES_BITS = 23
# Ids a batch sends on.
_SENT = 1 << 21
_LOADED: dict[tuple[str, str], tuple] = {}


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_decoder() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + k): b for k, b in enumerate(rest)}}


def _by_rank(parts: dict) -> bool:
    """Whether ids follow the order of merges, and texts are split by the byte-level expression alone."""
    vocab, split = parts["model"].get("vocab"), parts.get("pre_tokenizer") or {}
    merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in parts["model"].get("merges", [])]
    return (
        merged == list(range(256, 256 + len(merged))) and split.get("type") == "ByteLevel" and split.get("use_regex", True)
        and not split.get("add_prefix_space") and not parts.get("normalizer"))


def byte_level(path: str):
    """(encode texts to ids, bytes of each id) of a byte-level BPE; strings of special tokens are plain text."""
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    decoder = _byte_decoder()
    special = {x["id"] for x in json.loads(tokenizer.to_str())["added_tokens"]}
    table = [b""] * (max(tokenizer.get_vocab().values()) + 1)
    for token, i in tokenizer.get_vocab().items():
        table[i] = b"" if i in special else bytes(decoder[c] for c in token)
    if _by_rank(json.loads(tokenizer.to_str())):
        # Ids in the order of their merges and the usual split: the same ids come faster from ranks.
        import public_tokenizers
        import tiktoken
        encode = tiktoken.Encoding(
            path, pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in enumerate(table) if b}, special_tokens={}).encode_ordinary
        return (lambda texts: [encode(t) for t in texts]), table
    tokenizer.encode_special_tokens = True
    return (lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]), table


def pieces_model(path: str):
    """The same of a SentencePiece model, which puts the space before a text itself."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = [
        bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
        for i, p in enumerate(map(model.id_to_piece, range(model.get_piece_size())))]
    return (lambda texts: model.encode([t[1:] for t in texts], num_threads=1)), table


def _tokenizers(a: str, b: str):
    """Both encoders, with the bytes and lengths of their ids, once per worker."""
    if (a, b) not in _LOADED:
        loaded = []
        for load, path in ((byte_level, a), (pieces_model, b)):
            encode, table = load(path)
            if len(table) > MOST_IDS:
                raise ValueError(f"{path}: more than {MOST_IDS} ids")
            loaded.append((encode, table, np.array([len(x) for x in table], np.int64)))
        _LOADED[a, b] = tuple(loaded)
    return _LOADED[a, b]


def crossing(a: np.ndarray, b: np.ndarray, diagonal: int) -> tuple[int, int]:
    """How many of ``a`` and of ``b`` are among the first ``diagonal`` of their merge, A first where equal.

    Ends common to both are not parted: the B end joins the A end.
    """
    low, high = max(0, diagonal - len(b)), min(diagonal, len(a))
    while low < high:
        i = (low + high) // 2
        if a[i] <= b[diagonal - i - 1]:
            low = i + 1
        else:
            high = i
    j = diagonal - low
    if 0 < low and j < len(b) and a[low - 1] == b[j]:
        j += 1
    return low, j


def cut(ends_a: np.ndarray, ends_b: np.ndarray, piece: int = PIECE) -> list[tuple[int, int, int, int]]:
    """(first A, end A, first B, end B) of the pieces of a merge."""
    total = len(ends_a) + len(ends_b)
    at = [(0, 0), *(crossing(ends_a, ends_b, d) for d in range(piece, total, piece)), (len(ends_a), len(ends_b))]
    return [(i0, i1, j0, j1) for (i0, j0), (i1, j1) in zip(at, at[1:]) if (i0, j0) != (i1, j1)]


def solve(ids_a: np.ndarray, ends_a: np.ndarray, ids_b: np.ndarray, ends_b: np.ndarray, n_a: int, n_b: int):
    """Overlaps and groups of a piece: (links, group number, side, id in group order).

    The first ``n_a`` and ``n_b`` tokens end inside the piece; one more on a side
    is the token that reaches beyond it.  Links are (b << 20 | a), one per distinct
    end.  A token's group number counts the common ends before its own end.
    """
    inside_a, inside_b = ends_a[:n_a], ends_b[:n_b]
    place = np.searchsorted(inside_a, inside_b)
    common = np.zeros(n_b, bool)
    if n_a:
        common = (place < n_a) & (inside_a[np.minimum(place, n_a - 1)] == inside_b)
    # Every A end, and the B ends that are no A ends.
    over_b = ids_b[np.searchsorted(ends_b, inside_a)].astype(np.int64)
    alone = ~common
    links = np.concatenate([
        over_b << 20 | ids_a[:n_a].astype(np.int64),
        ids_b[:n_b][alone].astype(np.int64) << 20 | ids_a[place[alone]].astype(np.int64)])
    shared = inside_b[common]
    group_a = np.searchsorted(shared, inside_a)
    group_b = np.searchsorted(shared, inside_b)
    # Merged by group, A before B.
    order_a = np.arange(n_a) + np.searchsorted(group_b, group_a)
    order_b = np.arange(n_b) + np.searchsorted(group_a, group_b, side="right")
    group = np.empty(n_a + n_b, np.int64)
    ids = np.empty(n_a + n_b, np.int64)
    side = np.zeros(n_a + n_b, np.int64)
    group[order_a], group[order_b] = group_a, group_b
    ids[order_a], ids[order_b] = ids_a[:n_a], ids_b[:n_b]
    side[order_b] = 1
    return links, group, side, ids, len(shared)


_WRITTEN: list[list[str]] = []


def written(group: np.ndarray, side: np.ndarray, ids: np.ndarray) -> str:
    """a1,a2|b1;a3|b2 for tokens in group order; every token is followed by the sign before its successor."""
    if not len(ids):
        return ""
    most = int(ids.max()) + 1
    if not _WRITTEN or len(_WRITTEN[0]) < most:
        _WRITTEN[:] = [[f"{i}{sign}" for i in range(most)] for sign in ",|;"]
    flat = _WRITTEN[0], _WRITTEN[1], _WRITTEN[2]
    sign = np.zeros(len(ids), np.int64)
    sign[:-1] = np.where(group[1:] != group[:-1], 2, side[1:] != side[:-1])
    sign[-1] = 2
    return "".join([flat[s][i] for s, i in zip(sign.tolist(), ids.tolist())])[:-1]


def _ends(ids: list[int], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array(ids, np.int32)
    return ids, np.cumsum(lengths[ids])


_CUT = "rid long, doc_id {}, piece int, pieces int, n_a int, n_b int, ids_a binary, ends_a binary, ids_b binary, ends_b binary"
_NAMES = ["rid", "doc_id", "piece", "pieces", "n_a", "n_b", "ids_a", "ends_a", "ids_b", "ends_b"]


def _cutter(a: str, b: str, piece: int):
    """Texts to pieces of their merge; a text without tokens gives one empty piece."""
    def run(batches):
        (encode_a, bytes_a, len_a), (encode_b, bytes_b, len_b) = _tokenizers(a, b)
        for batch in batches:
            types = [pa.int64(), batch.schema.field("doc_id").type, *[pa.int32()] * 4, *[pa.binary()] * 4]
            texts = [" " + t if t else "" for t in batch.column("text").to_pylist()]
            rows, sent = [], 0
            all_a, all_b = encode_a(texts), encode_b(texts)
            for rid, doc_id, text, ids_a, ids_b in zip(batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist(), texts, all_a, all_b):
                raw = text.encode("utf-8", "surrogatepass")
                if not raw or b"".join([bytes_a[i] for i in ids_a]) != raw or b"".join([bytes_b[i] for i in ids_b]) != raw:
                    rows.append((rid, doc_id, 0, 1, 0, 0, b"", b"", b"", b""))
                    continue
                (ids_a, ends_a), (ids_b, ends_b) = _ends(ids_a, len_a), _ends(ids_b, len_b)
                parts = cut(ends_a, ends_b, piece)
                for k, (i0, i1, j0, j1) in enumerate(parts):
                    # One token more on each side: the one that reaches beyond the piece.
                    rows.append((
                        rid, doc_id, k, len(parts), i1 - i0, j1 - j0, ids_a[i0:i1 + 1].tobytes(), ends_a[i0:i1 + 1].tobytes(),
                        ids_b[j0:j1 + 1].tobytes(), ends_b[j0:j1 + 1].tobytes()))
                    sent += i1 - i0 + j1 - j0
                if sent > _SENT:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], _NAMES)
                    rows, sent = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], _NAMES)
    return run


_SOLVED = (
    "rid long, doc_id {}, piece int, pieces int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "closes boolean, head_a string, head_b string, body string, tail_a string, tail_b string, links array<long>")


def _joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _solver(batches):
    """Pieces to their links with multiplicities, and the groups as text.

    A document of one piece is finished here.  Of a longer one each piece gives
    the tokens before its first common end, its whole groups and the tokens behind
    its last common end.
    """
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in _NAMES]
        out = []
        for rid, doc_id, piece, pieces, n_a, n_b, ids_a, ends_a, ids_b, ends_b in zip(*columns):
            links, group, side, ids, n_groups = solve(
                np.frombuffer(ids_a, np.int32), np.frombuffer(ends_a, np.int64),
                np.frombuffer(ids_b, np.int32), np.frombuffer(ends_b, np.int64), n_a, n_b)
            pairs, times = np.unique(links, return_counts=True)
            packed = pairs << _TIMES_BITS | times
            if pieces == 1:
                text = written(group, side, ids)
                rest = (hashlib.sha256(text.encode()).hexdigest() if text else "", True, None, None, None, None, None)
            else:
                parts = []
                for inside in (group == 0, group == n_groups):
                    parts += [_joined(ids[inside & (side == 0)]), _joined(ids[inside & (side == 1)])]
                if n_groups == 0:  # no common end: all of it lies in one group
                    parts[2:] = ["", ""]
                middle = (group > 0) & (group < n_groups)
                rest = (None, n_groups > 0, *parts[:2], written(group[middle], side[middle], ids[middle]), *parts[2:])
            out.append((rid, doc_id, piece, pieces, n_a, n_b, n_groups, len(links), *rest, packed))
        doc_type = batch.schema.field("doc_id").type
        types = [pa.int64(), doc_type, pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.bool_(), *[pa.string()] * 5, pa.list_(pa.int64())]
        names = [x.split()[0] for x in _SOLVED.split(", ")]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def _stitch(batches):
    """Documents of several pieces: their groups in order, hashed."""
    for batch in batches:
        digests = []
        for parts in batch.column("parts").to_pylist():
            digest, open_a, open_b, any_ = hashlib.sha256(), "", "", False
            for p in sorted(parts, key=lambda p: p["piece"]):
                open_a = ",".join(filter(None, (open_a, p["head_a"])))
                open_b = ",".join(filter(None, (open_b, p["head_b"])))
                if p["closes"]:
                    closed = f"{open_a}|{open_b}" + (f";{p['body']}" if p["body"] else "")
                    digest.update((f";{closed}" if any_ else closed).encode())
                    open_a, open_b, any_ = p["tail_a"], p["tail_b"], True
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(digests, pa.string())], ["rid", "stitched"])


def aligned(docs: DataFrame, a: str | None = None, b: str | None = None, doc_id: str = "doc_id", text: str = "text", piece: int = PIECE) -> DataFrame:
    """A stored row per piece: its place, token, group and link counts, its links and the groups across its edges.

    ``links`` packs (B id, A id, times).  Null and empty texts, and texts that
    either tokenizer does not give back byte by byte, give one piece without
    tokens.  Null ids and repeated rows are documents of their own; other columns
    are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    a, b = a or vocabulary("byte_bpe_50k.json"), b or vocabulary("piece_bpe_32k.model")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    pieces = rows.mapInArrow(_cutter(a, b, piece), _CUT.format(id_type))
    return stage(pieces.mapInArrow(_solver, _SOLVED.format(id_type)), "aligned")


def unpacked(pieces: DataFrame, *keys) -> DataFrame:
    """A row per piece and id pair: the keys, pair (b << 20 | a), times."""
    return pieces.select(*keys, F.explode("links").alias("link")).select(
        *keys, F.shiftright("link", _TIMES_BITS).alias("pair"), F.col("link").bitwiseAND((1 << _TIMES_BITS) - 1).alias("times"))


def link_counts(pieces: DataFrame) -> DataFrame:
    """Corpus-wide: a, b, n (links that hold the pair) and ``best``, whether none of the same B id has more."""
    counts = stage(unpacked(pieces).groupBy("pair").agg(F.sum("times").alias("n")), "link-counts")
    b = F.shiftright("pair", 20)
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return stage(
        counts.withColumn("b", b).join(most, "b")
        .select("pair", "b", F.col("pair").bitwiseAND(MOST_IDS - 1).alias("a"), "n", (F.col("n") == F.col("most")).alias("best")),
        "link-best")


def _threshold(counts: DataFrame, most: int) -> int:
    """The least count such that no more than ``most`` pairs have it or more."""
    # Counts by size: eight classes per power of two, so a few hundred rows at most.
    level = F.floor(F.log2("n") * 8)
    rows = counts.groupBy(level.alias("level")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).collect()
    found, held = 1 << 62, 0
    for r in sorted(rows, key=lambda r: -r["level"]):
        held += r["pairs"]
        if held > most:
            break
        found = r["least"]
    return found


def alignment(docs: DataFrame, a: str | None = None, b: str | None = None, doc_id: str = "doc_id", text: str = "text",
              piece: int = PIECE, frequent: int = FREQUENT) -> DataFrame:
    """A row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Counts of at most ``frequent`` id pairs are broadcast, those with the most
    links; pairs below meet their counts in a join, where no key is hot because
    each has fewer links than any pair broadcast.  See ``aligned`` for nulls,
    empty tables and the like.
    """
    pieces = aligned(docs, a, b, doc_id, text, piece)
    counts = link_counts(pieces)
    least = _threshold(counts, frequent)
    known = counts.select("pair", "n", "best")
    sums = [F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")]
    links = unpacked(pieces, "rid")
    common = F.broadcast(known.filter(F.col("n") >= least))
    per_doc = links.join(common, "pair").groupBy("rid").agg(*sums)
    if not known.filter(F.col("n") < least).isEmpty():
        rare = links.join(common, "pair", "left_anti").join(known.filter(F.col("n") < least), "pair").groupBy("rid").agg(*sums)
        per_doc = per_doc.unionByName(rare)
    whole = pieces.select("rid", "doc_id", "piece", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    nothing = F.lit(0).cast("long")
    parts = [c for c in ("piece", "closes", "head_a", "head_b", "body", "tail_a", "tail_b")]
    stitched = (
        pieces.filter("pieces > 1").groupBy("rid").agg(F.collect_list(F.struct(*parts)).alias("parts"))
        .mapInArrow(_stitch, "rid long, stitched string"))
    totals = whole.select(
        "rid", F.when(F.col("piece") == 0, F.struct("doc_id")).alias("doc"), "n_a", "n_b", "n_groups", "n_links",
        "groups_sha256", nothing.alias("n_best"), nothing.alias("count_sum"))
    more = per_doc.select("rid", "n_best", "count_sum")
    strings = stitched.select("rid", F.col("stitched").alias("groups_sha256"))
    return (
        totals.unionByName(more, allowMissingColumns=True).unionByName(strings, allowMissingColumns=True)
        .groupBy("rid").agg(
            F.max("doc").alias("doc"), *[F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
            F.max("groups_sha256").alias("groups_sha256"))
        .select("doc.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
