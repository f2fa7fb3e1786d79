"""Registered queries of the operators, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import bind
from .alignment import alignment
from .decontaminate import leaks
from .html_text import extract_pages
from .mixing import WORD, taken_words
from .near import jaccard_join
from .periods import collapse
from .pieces import decoded, encode_texts
from .pii import find_pii
from .secrets import scan_secrets
from .sharding import shard
from .topk import top_k
from .toxicity import THRESHOLD, held_out, with_toxicity
from .training_order import ordered


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark, sf_dir):
    return find_pii(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark, sf_dir):
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_secrets(spark, sf_dir):
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op4_top_k(spark, sf_dir):
    return top_k(_table(spark, sf_dir, "embeddings"))


def op5_pieces(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return (
        encode_texts(docs)
        .withColumn("exact", decoded(F.col("ids")) == F.coalesce("text", F.lit("")))
        .select("doc_id", "n_ids", "exact", "ids"))


def op6_training_order(spark, sf_dir):
    return ordered(_table(spark, sf_dir, "documents")).select(
        "slot", "shard", "doc_id", "sequence", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_toxicity(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    return with_toxicity(docs, labels).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op8_html_text(spark, sf_dir):
    return extract_pages(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_near_duplicates(spark, sf_dir):
    return jaccard_join(_table(spark, sf_dir, "documents"))


def op10_sharding(spark, sf_dir):
    return shard(_table(spark, sf_dir, "documents"))


def op11_mixing(spark, sf_dir):
    return taken_words(_table(spark, sf_dir, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Texts with a repeated stretch from some word on, in the documents whose id says so; others as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def planted(words):
        n = F.size(words)
        g = F.floor(h / 10)
        start = (g % n).cast("int")
        period = (F.lit(1) + F.floor((n - start) / (g % 8 + 3))).cast("int")
        return F.array_join(F.transform(words, lambda w, i: F.when(i < start, w).otherwise(
            F.get(words, start + (i - start) % period))), " ")

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, bind(words, lambda w: F.when(F.size(w) > 0, planted(w)))).otherwise(F.col("text")).alias("text"))


def op12_periods(spark, sf_dir):
    found = collapse(with_planted_runs(_table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("-1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), "collapsed_sha256")


def op13_alignment(spark, sf_dir):
    return alignment(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f for f in (
        op1_pii, op2_decontamination, op3_secrets, op4_top_k, op5_pieces, op6_training_order, op7_toxicity,
        op8_html_text, op9_near_duplicates, op10_sharding, op11_mixing, op12_periods, op13_alignment)}

_KEYS = "(?:(?i:password|passwd|secret|token|api_?key))"
_SQL_RULES = (
    ("assign", _KEYS + r"""[\"'']?\x20*[:=]\x20*[\"'']?[A-Za-z0-9+/_.=-]+"""),
    ("access", "AKIA[A-Z0-9]{16,}"),
    ("hex", "[0-9a-f]{24,}"),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
)


def _sql_spans(ord_: int, kind: str, pattern: str) -> str:
    """Spans of one rule: pieces between matches and the matches give the places."""
    value = rf"length(regexp_extract(v, '^{_KEYS}[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6" if kind == "assign" else "true"
    return f"""
        SELECT doc_id, text_no, {ord_} AS o, '{kind}' AS kind, v, s, s + length(v) AS e FROM (
            SELECT doc_id, text_no, ms[i] AS v,
                list_sum([length(x) for x in ps[1:i]]) + coalesce(list_sum([length(x) for x in ms[1:i-1]]), 0) AS s
            FROM (
                SELECT doc_id, text_no, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
                    SELECT doc_id, text_no, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS ps
                    FROM docs)))
        WHERE {value}"""


OP3_SQL = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS text_no, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(_sql_spans(i, k, p) for i, (k, p) in enumerate(_SQL_RULES))})
SELECT d.doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
    sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o < 3), '')) AS base_sha256,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o), '') AS spans, sha256(any_value(t)) AS blob
FROM docs d LEFT JOIN found f ON d.text_no = f.text_no GROUP BY d.text_no, d.doc_id
"""

OP4_SQL = """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = len(embedding)),
scored AS (
    SELECT q.vec_id AS query_id, q.r, c.vec_id, list_sum([p[1] * p[2] for p in list_zip(q.e, c.e)])::BIGINT AS score
    FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""

# All pairs of word sequences that share a shingle, compared one by one.
OP9_SQL = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT w, min(doc_id) AS copy_id, min(r) AS rep FROM t GROUP BY w),
s AS (SELECT rep, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM c),
e AS (SELECT rep, unnest(sh) AS g FROM s),
p AS (SELECT a.rep AS x, b.rep AS y, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.rep <> b.rep GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN s sx ON sx.rep = x JOIN s sy ON sy.rep = y WHERE n >= 0.8 * (len(sx.sh) + len(sy.sh) - n) - 1e-9),
reach(rep, label) AS (SELECT rep, rep FROM c UNION SELECT l.y, reach.label FROM reach JOIN l ON l.x = reach.rep),
g AS (SELECT rep, min(label) AS label FROM reach GROUP BY rep),
k AS (SELECT c.w, c.copy_id, g.label, min(c.copy_id) OVER (PARTITION BY g.label) AS class_id, min(c.rep) OVER (PARTITION BY g.label) AS first,
    (SELECT count(*) FROM l WHERE l.x = c.rep) AS n_links FROM c JOIN g USING (rep))
SELECT t.doc_id, k.copy_id, k.class_id, k.n_links, t.r = k.first AS keeps FROM t JOIN k ON t.w = k.w
"""

# The least largest shard by trying every last cut, then the greedy cuts at that size.
OP10_SQL = """
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS x, coalesce(strlen(text), 0) + 1 AS size, sha256(coalesce(text, '')) AS sha FROM documents),
g AS (SELECT sha, sum(sum(size)) OVER (ORDER BY sha) AS e FROM t GROUP BY sha),
f(k, e, cost) AS (SELECT 1, e, e FROM g
    UNION ALL SELECT f.k + 1, g.e, min(greatest(f.cost, g.e - f.e)) FROM f JOIN g ON g.e >= f.e WHERE f.k < 16 GROUP BY f.k + 1, g.e),
cap AS (SELECT min(cost) AS c FROM f WHERE e = (SELECT max(e) FROM g)),
cut(k, e) AS (SELECT 0, 0::HUGEINT
    UNION ALL SELECT cut.k + 1, max(g.e) FROM cut JOIN cap ON true JOIN g ON g.e <= cut.e + cap.c WHERE cut.k < 15 GROUP BY cut.k + 1),
place AS (SELECT g.sha, (SELECT count(*) FROM cut WHERE cut.k > 0 AND cut.e < g.e) AS shard FROM g),
steps AS (SELECT [list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) for i in range(256)] AS s),
sums AS (SELECT sha, xor(4294967295, list_reduce(list_prepend(4294967295, [('0x' || h)::BIGINT for h in regexp_extract_all(hex(x), '..')]),
    lambda c, b: xor(c >> 8, s[(xor(c, b) & 255) + 1]))) AS crc FROM (SELECT DISTINCT sha, x FROM t), steps)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY sha, doc_id NULLS FIRST) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM t JOIN place USING (sha) JOIN sums USING (sha)
"""

# The level of the sharing by sorted ceilings, then each queue in the order of its keyed hash.
OP11_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM t GROUP BY source),
w AS (SELECT *, (no - 1) % 3 + 1 AS weight, source_size * 3 AS ceiling, ceiling / weight AS ratio FROM s),
l AS (SELECT *, coalesce(sum(ceiling) OVER b, 0)::BIGINT AS capped, coalesce(sum(weight) OVER b, 0)::BIGINT AS upto,
    sum(source_size) OVER ()::BIGINT AS words, sum(weight) OVER ()::BIGINT AS weights FROM w
    WINDOW b AS (ORDER BY ratio, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(upto, upto) AS upto0, arg_min(words - capped, upto) AS room, arg_min(weights - upto, upto) AS share
    FROM l WHERE (words - capped) / (weights - upto) <= ratio),
q AS (SELECT source, no, source_size, CASE WHEN upto >= upto0 THEN (weight * room) / share ELSE ceiling END::DOUBLE AS target,
    CASE WHEN upto >= upto0 THEN ((upto - upto0 + weight)::HUGEINT * room) // share - ((upto - upto0)::HUGEINT * room) // share
        ELSE ceiling END::BIGINT AS quota FROM l LEFT JOIN f ON true),
c AS (SELECT t.*, source_size, target, quota, unnest(range(1, greatest(1, (quota + source_size - 1) // source_size) + 1)) AS round
    FROM t JOIN q ON t.source IS NOT DISTINCT FROM q.source WHERE size > 0),
o AS (SELECT r, greatest(0, least(size, quota - coalesce(sum(size) OVER (PARTITION BY source
    ORDER BY round, md5(concat_ws(':', 'mix-1', round, coalesce(doc_id::VARCHAR, ''), size)), doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS taken FROM c)
SELECT doc_id, size, source_size, target, coalesce((SELECT sum(taken) FROM o WHERE o.r = t.r), 0)::BIGINT AS taken
FROM t JOIN q ON t.source IS NOT DISTINCT FROM q.source
"""

# Pairs of equal words at every distance, joined to stretches; a stretch that a shorter period covers is no run of its own.
OP12_SQL = r"""
WITH steps AS (SELECT [list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) for i in range(256)] AS s),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o,
    xor(4294967295, list_reduce(list_prepend(4294967295, [('0x' || x)::BIGINT for x in regexp_extract_all(hex(doc_id::VARCHAR), '..')]),
        lambda c, b: xor(c >> 8, s[(xor(c, b) & 255) + 1]))) AS h FROM documents, steps),
e AS (SELECT *, len(o) AS n, (h // 10) % len(o) AS a, (h // 10) % 8 + 3 AS k FROM d),
t AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN [CASE WHEN i < a THEN o[i + 1] ELSE o[a + (i - a) % (1 + (n - a) // k) + 1] END for i in range(n)] ELSE o END AS w FROM e),
x AS (SELECT r, n, unnest(w) AS w, unnest(range(n)) AS i FROM t),
p AS (SELECT x.r, y.i - x.i AS q, x.i FROM x JOIN x y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
l AS (SELECT r, q, min(i) AS s, max(i) + q + 1 AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS grp FROM p)
    GROUP BY r, q, grp HAVING count(*) >= greatest(6 - q, 3 * q)),
u AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM l m WHERE m.r = l.r AND m.q < l.q AND m.s <= l.s AND m.e >= l.e)),
g AS (SELECT r, count(*) AS n_runs, arg_min(u, (s - e, s, q)) AS best, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM u GROUP BY r),
c AS (SELECT x.r, string_agg(x.w, ' ' ORDER BY x.i) AS kept FROM x
    WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.r = x.r AND x.i >= u.s + u.q AND x.i < u.e) GROUP BY x.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.e - best.s AS length, best.q AS period,
    1000 * (best.e - best.s) // best.q AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN g USING (r) LEFT JOIN c USING (r)
"""

ORACLES = {"op12_periods": OP12_SQL, "op11_mixing": OP11_SQL, "op3_secrets": OP3_SQL, "op4_top_k": OP4_SQL, "op9_near_duplicates": OP9_SQL, "op10_sharding": OP10_SQL}
