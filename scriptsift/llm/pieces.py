"""SentencePiece encoding and decoding by streaming Viterbi.

A text is scored as the best sum of piece scores.  Only the boundaries within
one maximum piece length of the end can begin a later piece; once their
backpointer paths share a boundary, everything before it is settled and its ids
are committed, so a text of any length needs a window, not a lattice.

No piece of the vocabulary has a space mark behind another character, so all
paths meet before every word.  Words are therefore independent, and the ids of
short ones are remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Stands for a space mark that the text itself holds; no text has this code point.
_LITERAL = "\ud800"
# Score of a byte below the worst piece.
BYTE_PENALTY = 10.0
# Words remembered by a task, and the length up to which a word is one window.
REMEMBERED = 600_000
SHORT = 48
_NEVER = -1e300
_WORD = re.compile(f"{SPACE}*[^{SPACE}]*")


class Pieces:
    """Vocabulary with scores: ``rows`` are (piece, score, is_byte, is_normal)."""

    def __init__(self, rows):
        self.text = [p for p, _, _, _ in rows]
        self.ids = {p: i for i, (p, _, _, normal) in enumerate(rows) if normal}
        self.scores = [s for _, s, _, _ in rows]
        self.longest = max(map(len, self.ids), default=1)
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, _, byte, _) in enumerate(rows) if byte}
        self.byte_score = min((s for _, s, _, normal in rows if normal and s > -1e8), default=0.0) - BYTE_PENALTY
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space mark behind another character")
        raw = {i: bytes([b]) for b, i in self.byte_ids.items()}
        raw.update({i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()})
        self.bytes = [raw.get(i, b"") for i in range(len(rows))]
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.known = _Known(self)
        self.kind = np.dtype("<u2" if len(rows) <= 65536 else "<u4")
        self.packed = [np.array(i, self.kind).tobytes() for i in range(len(rows))]
        if not {c for p in self.ids for c in p} <= self.ids.keys():
            raise ValueError("a piece holds a character that is no piece")
        self.matcher = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.matcher.add_word(piece, (i, len(piece), self.scores[i]))
        self.matcher.make_automaton()

    @classmethod
    def load(cls, path: str = MODEL) -> "Pieces":
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls([
            (sp.id_to_piece(i), sp.get_score(i), sp.is_byte(i), not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)))
            for i in range(sp.get_piece_size())])

    def steps(self, window: str, end: int):
        """(start, score, ids) of all pieces that end at ``end``, shortest first."""
        char = window[end - 1]
        if char not in self.ids:
            data = (SPACE if char == _LITERAL else char).encode()
            yield end - 1, self.byte_score * len(data), tuple(self.byte_ids[b] for b in data)
        for start in range(end - 1, max(end - self.longest, 0) - 1, -1):
            i = self.ids.get(window[start:end])
            if i is not None:
                yield start, self.scores[i], (i,)

    def word(self, marked: str) -> bytes:
        """Ids of one word that begins with its space marks, as bytes.

        A short word is one window: its path is found over all matches of pieces
        at once.  A character that is no piece leaves its end out of reach; such
        words, and long ones, are streamed.
        """
        size = len(marked)
        if size <= SHORT:
            # The boundary behind character k has place k; the one before all, -1, is the last of each list.
            top, back, piece = [_NEVER] * size + [0.0], [0] * size, [0] * size
            # Matches come by their end, longest first.
            for end, (i, length, score) in self.matcher.iter(marked):
                total = top[end - length] + score
                if total > top[end]:
                    top[end], back[end], piece[end] = total, end - length, i
            if top[size - 1] > _NEVER / 2:
                ids, packed, end = [], self.packed, size - 1
                while end >= 0:
                    ids.append(packed[piece[end]])
                    end = back[end]
                return b"".join(ids[::-1])
        viterbi = StreamingViterbi(self)
        return b"".join([self.packed[i] for i in (*viterbi.feed(marked), *viterbi.finish())])

    def encode(self, text: str | None) -> bytes:
        """Ids as bytes; none for null and empty texts."""
        if not text:
            return b""
        if SPACE in text:
            text = text.replace(SPACE, _LITERAL)
        if "  " in text or text[0] == " " or text[-1] == " ":
            return b"".join([self.word(p) for p in _WORD.findall(SPACE + text.replace(" ", SPACE)) if p])
        return b"".join(map(self.known.__getitem__, text.split(" ")))

    def decode(self, ids) -> str:
        """The text of some ids; the space before the first word goes."""
        ids = np.asarray(ids, np.int64)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        data = self.blob[at].tobytes().decode(errors="replace")
        return data[1:] if data[:1] == " " else data


class _Known(dict):
    """Ids of words behind one space; a new word is kept while there is room."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces

    def __missing__(self, word: str) -> bytes:
        ids = self.pieces.word(SPACE + word)
        if len(self) < REMEMBERED and len(word) < SHORT:
            self[word] = ids
        return ids


class StreamingViterbi:
    """Best segmentation of characters that arrive in parts.

    Ties go to the longer last piece.  ``width`` is the largest window held so far.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.window = ""
        self.best = [0.0]
        self.back = [(0, ())]
        self.width = 0

    def feed(self, chars: str) -> list[int]:
        """Take more characters; returns the ids settled by them."""
        out = []
        span = 4 * self.pieces.longest
        for a in range(0, len(chars), span):
            self._extend(chars[a:a + span])
            if len(self.window) > span:
                out += self._commit()
        return out

    def finish(self) -> list[int]:
        out = self._path(len(self.window), 0)
        self.window, self.best, self.back = "", [0.0], [(0, ())]
        return out

    def _extend(self, chars: str) -> None:
        first = len(self.window) + 1
        self.window += chars
        self.width = max(self.width, len(self.window))
        for end in range(first, len(self.window) + 1):
            top, how = float("-inf"), None
            for start, score, ids in self.pieces.steps(self.window, end):
                total = self.best[start] + score
                if total >= top:
                    top, how = total, (start, ids)
            self.best.append(top)
            self.back.append(how)

    def _path(self, end: int, stop: int) -> list[int]:
        parts = []
        while end > stop:
            end, ids = self.back[end]
            parts.append(ids)
        return [i for ids in reversed(parts) for i in ids]

    def _commit(self) -> list[int]:
        end = len(self.window)
        alive = set(range(max(end - self.pieces.longest + 1, 0), end + 1))
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(self.back[last][0])
        settled = alive.pop()
        if not settled:
            return []
        out = self._path(settled, 0)
        base = self.best[settled]
        self.window = self.window[settled:]
        self.best = [b - base for b in self.best[settled:]]
        self.back = [(0, ())] + [(start - settled, ids) for start, ids in self.back[settled + 1:]]
        return out


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    """The vocabulary, read once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Pieces.load(path)
    return _LOADED[path]


def encoded(text, model: str = MODEL):
    """Column of ids of a text column; empty for null and empty texts."""
    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = loaded(model)
        for texts in batches:
            flat = [pieces.encode(t.as_py()) for t in texts]
            sizes = np.array([0, *map(len, flat)]) // pieces.kind.itemsize
            ids = np.frombuffer(b"".join(flat), pieces.kind).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(ids))
        # Idle workers should not hold words.
        pieces.known.clear()
    return encode.asNondeterministic()(text)


def decoded(ids, model: str = MODEL):
    """Column of texts of a column of ids; null for null."""
    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        pieces = loaded(model)
        values, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        return pa.array([
            pieces.decode(values[a:b]) if known else None
            for a, b, known in zip(offsets[:-1], offsets[1:], lists.is_valid().to_pylist())], pa.string())
    return decode.asNondeterministic()(ids)


def encode_texts(docs: DataFrame, text: str = "text", model: str = MODEL, ids: str = "ids") -> DataFrame:
    """``docs`` plus the ids of each whole text and their number.

    Rows are handled one by one: nulls and empty texts give no ids, repeated rows
    agree, an empty table stays empty; columns of the new names are replaced.
    ``decoded`` gives the text back exactly.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn(ids, encoded(F.col(text), model)).withColumn(f"n_{ids}", F.size(ids))
