"""Viterbi against all segmentations, and exact round trips."""

import random
from functools import lru_cache

import numpy as np
import pytest

from scriptsift.llm.pieces import MODEL, Pieces, SPACE, StreamingViterbi, decoded, encode_texts, loaded

ROWS = [(f"<0x{b:02X}>", 0.0, True, False) for b in range(256)] + [
    (p, s, False, True) for p, s in (
        (SPACE, -9.0), ("a", -3.0), ("b", -3.5), ("ab", -4.0), ("ba", -4.0), ("aba", -6.5), (SPACE + "a", -3.0), (SPACE * 2, -8.0),
        ("abab", -9.0), ("bb", -6.5))]


def best_score(pieces, text):
    @lru_cache(None)
    def to(end):
        if not end:
            return 0.0
        return max(to(start) + score for start, score, _ in pieces.steps(text, end))
    return to(len(text))


def path_score(pieces, ids):
    return sum(pieces.byte_score if i < 256 else pieces.scores[i] for i in ids)


def test_best_of_all_segmentations():
    pieces = Pieces(ROWS)
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", SPACE, "é", "ab"]) for _ in range(rng.randrange(1, 60)))
        viterbi = StreamingViterbi(pieces)
        ids = []
        for a in range(0, len(text), 7):
            ids += viterbi.feed(text[a:a + 7])
        ids += viterbi.finish()
        assert b"".join(pieces.bytes[i] for i in ids).decode() == text.replace(SPACE, " ")
        assert path_score(pieces, ids) == pytest.approx(best_score(pieces, text))
        plain = text.replace(SPACE, " ")
        cached = np.frombuffer(pieces.encode(plain), pieces.kind).tolist()
        assert path_score(pieces, cached) == pytest.approx(best_score(pieces, SPACE + text))


def test_window_stays_bounded():
    pieces = loaded(MODEL)
    viterbi = StreamingViterbi(pieces)
    ids = viterbi.feed("thequickbrownfoxjumps" * 4000)
    assert viterbi.width <= 12 * pieces.longest
    ids += viterbi.finish()
    assert pieces.decode(ids) == "thequickbrownfoxjumps" * 4000


@pytest.mark.parametrize("text", [
    "", " ", "a", " a", "a ", "  two  spaces  ", "line\nbreak\r\n\ttab", "▁mark ▁▁", "\u0000\uFDD0 é 漢字 😀", "x" * 70, "\uFDD0"])
def test_round_trip(text):
    pieces = loaded(MODEL)
    assert pieces.decode(np.frombuffer(pieces.encode(text), pieces.kind).tolist()) == text


def test_space_inside_a_piece_is_refused():
    for piece in ("a" + SPACE, "ac"):
        with pytest.raises(ValueError):
            Pieces([*ROWS, (piece, -1.0, False, True)])


def test_short_words_take_the_streamed_path():
    pieces = loaded(MODEL)
    for word in "the thndhain. Onhalyti éèpaaux%%% 漢字x ñí \n\t \U0001F600".split(" "):
        viterbi = StreamingViterbi(pieces)
        streamed = [*viterbi.feed(SPACE + word), *viterbi.finish()]
        assert np.frombuffer(pieces.word(SPACE + word), pieces.kind).tolist() == streamed


def test_documents(documents, odd_documents, no_documents):
    for docs in (documents, odd_documents):
        rows = encode_texts(docs).withColumn("back", decoded("ids")).collect()
        assert len(rows) == docs.count()
        assert all(r["back"] == (r["text"] or "") and r["n_ids"] == len(r["ids"]) for r in rows)
    assert encode_texts(no_documents).collect() == []
