import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptsift.llm import alignment

A, B = alignment.vocabulary("byte_bpe_50k.json"), alignment.vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Both tokenizers without the operator's code: text to (start, end, id)."""
    import sentencepiece
    from tokenizers import Tokenizer
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    decoder = alignment._byte_decoder()

    def of_a(text):
        return [(i, len(bytes(decoder[c] for c in a.id_to_token(i)))) for i in a.encode(" " + text, add_special_tokens=False).ids]

    def of_b(text):
        return [(i, 1 if b.is_byte(i) else len(b.id_to_piece(i).replace("▁", " ").encode())) for i in b.encode(text)]

    def spans(tokens):
        at, out = 0, []
        for i, n in tokens:
            out.append((at, at + n, i))
            at += n
        return out
    return lambda text: (spans(of_a(text)), spans(of_b(text)))


def brute(text, plain):
    """(links, groups) by comparing all byte ranges."""
    if not text or "▁" in text:
        return [], []
    a, b = plain(text)
    links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
    groups, before = [], 0
    for end in sorted({x[1] for x in a} & {y[1] for y in b}):
        groups.append(tuple(tuple(t[2] for t in side if before < t[1] <= end) for side in (a, b)))
        before = end
    return links, groups


def _digest(groups):
    text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
    return hashlib.sha256(text.encode()).hexdigest() if text else ""


def expected(texts, plain):
    found = [brute(t, plain) for t in texts]
    counts = Counter(link for links, _ in found for link in links)
    best = {}
    for (a, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
         sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), _digest(groups))
        for links, groups in found]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
TEXTS = [
    "Hello world, a plain sentence.", "  two  spaces\n\nand\tmore  ", "émigré 日本語 \U0001F600\U0001F600 x", "<|endoftext|><s></s> are text",
    "it's 'LL we'd ﬁ Ａ ½", "0000000 123456789 3.14159", "a▁b is not given back", "x", " ", "\n", "", None, "aaaa" * 200, "Hello world, a plain sentence.",
]


def _rows(frame):
    return {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in frame.collect()}


@pytest.mark.parametrize("piece,frequent", [(alignment.PIECE, alignment.FREQUENT), (7, 20), (1, 0), (64, 3)])
def test_like_brute_force(spark, plain, piece, frequent):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert _rows(alignment.alignment(docs, piece=piece, frequent=frequent)) == dict(enumerate(expected(TEXTS, plain)))


def test_given_documents(spark, plain, documents):
    docs = documents.filter(F.length("text") < 1500).filter("doc_id < 60").select("doc_id", "text")
    rows = docs.collect()
    want = dict(zip([r["doc_id"] for r in rows], expected([r["text"] for r in rows], plain)))
    assert _rows(alignment.alignment(docs)) == want
    assert _rows(alignment.alignment(docs, piece=100, frequent=500)) == want


def test_merge_paths():
    rng = np.random.default_rng(2)
    for _ in range(300):
        total = int(rng.integers(1, 400))
        a, b = (np.union1d(rng.integers(1, total + 1, rng.integers(1, 80)), [total]) for _ in range(2))
        for piece in (1, 2, 5, 64, 1000):
            parts = alignment.cut(a, b, piece)
            assert [p[0] for p in parts] == [0, *(p[1] for p in parts[:-1])] and parts[-1][1] == len(a)
            assert [p[2] for p in parts] == [0, *(p[3] for p in parts[:-1])] and parts[-1][3] == len(b)
            for i0, i1, j0, j1 in parts:
                # Equal work, up to a common end that stays in one piece.
                assert i1 - i0 + j1 - j0 <= piece + 1
                ends = [*a[i0:i1], *b[j0:j1]]
                later = [*a[i1:], *b[j1:]]
                assert not later or max(ends) < min(later)


def test_ids_of_the_tokenizer_itself(documents):
    from tokenizers import Tokenizer
    slow = Tokenizer.from_file(A)
    slow.encode_special_tokens = True
    encode, table = alignment.byte_level(A)
    texts = [" " + r["text"] for r in documents.filter("length(text) between 1 and 3000").limit(80).collect()] + [" <|endoftext|>  \n x"]
    assert encode(texts) == [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]
    assert all(b"".join(table[i] for i in ids).decode() == t for ids, t in zip(encode(texts), texts))


def test_odd_tables(spark, odd_documents, no_documents):
    odd = odd_documents.withColumn("rid", F.lit("x")).withColumn("links", F.lit(1)).withColumn("n", F.lit(2))
    rows = alignment.alignment(odd, piece=50_000).collect()
    assert len(rows) == odd.count()
    long = [r for r in rows if r["doc_id"] == 3]
    assert len(long) == 2 and long[0] == long[1] and long[0]["n_a"] > 100_000
    assert all(tuple(r[c] for c in COLUMNS) == (0, 0, 0, 0, 0, 0, "") for r in rows if r["doc_id"] is None)
    assert alignment.alignment(no_documents).collect() == []
