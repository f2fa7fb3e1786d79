"""Secret scans over an incremental blob ledger.

A blob is a text under the hash of its content.  The ledger says for every blob
which rule versions have scanned it and what they found; a scan looks at unseen
pairs of blob and rule version only, appends them, and joins the findings back to
all rows that hold the blob.  Copies, renamed paths and earlier runs therefore cost
no second scan, and a new or changed rule runs alone.  Runs that overlap may append
a pair twice; it is read once.

DataFrame functions only.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import shared, stage
from .spans import SPAN, count_kind, in_order, matches, of_kinds, written

BASE = ("assign", "access", "hex")


def _any_of(text: Column, *literals) -> Column:
    out = F.lit(False)
    for literal in literals:
        out = out | text.contains(literal)
    return out


# (kind, pattern, literals of which one must occur, whether they are sought in the lower-cased text)
# The first three are the base rules; a hex run shorter than 24 and an access
# key shorter than 20 never become matches, which equals dropping them.
RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
     ("password", "passwd", "secret", "token", "apikey", "api_key"), True),
    ("access", r"AKIA[A-Z0-9]{16,}+", ("AKIA",), False),
    ("hex", r"[0-9a-f]{24,}+", (), False),
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", ("PRIVATE KEY-----",), False),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", ("eyJ",), False),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}+", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), False),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+", ("xox",), False),
)
_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""


LEDGER = f"blob string, scanned array<string>, spans array<struct<version:string,span:{SPAN}>>"


def rule_version(rule) -> str:
    """A digest of all that a rule's findings depend on."""
    return hashlib.sha256(repr((rule, _VALUE if rule[0] == "assign" else None)).encode()).hexdigest()[:16]


def secret_spans(text: Column, lowered: Column, rules=RULES, todo: Column | None = None) -> Column:
    """All spans of a text, by start, then rule; with ``todo`` those of the rule versions in it."""
    arrays = []
    for order, rule in enumerate(rules):
        kind, pattern, literals, caseless = rule
        guard = _any_of(lowered if caseless else text, *literals) if literals else None
        if todo is not None:
            asked = F.array_contains(todo, rule_version(rule))
            guard = asked if guard is None else asked & guard
        valid = (lambda v: F.length(F.regexp_extract(v, _VALUE, 1)) >= 6) if kind == "assign" else None
        arrays.append(matches(text, kind, order, pattern, guard, valid))
    return in_order(*arrays)


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, text, todo) to (blob, scanned, spans): the rule versions in ``todo`` and what they find."""
    spans = secret_spans(F.col("text"), F.col("lowered"), rules, F.col("todo"))
    versions = F.array(*[F.lit(rule_version(r)) for r in rules])
    return blobs.withColumn("lowered", F.lower("text")).select(
        "blob", F.col("todo").alias("scanned"),
        F.transform(spans, lambda s: F.struct(F.get(versions, s["ord"]).alias("version"), s.alias("span"))).alias("spans"))


def _entries(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of the ledger; None before the first scan."""
    try:
        return spark.read.schema(LEDGER).option("recursiveFileLookup", True).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_ledger(spark: SparkSession, path: str, rules=RULES) -> DataFrame | None:
    """(blob, spans) of these rules, one row per blob, whichever runs found them; None before the first scan.

    Spans carry the place of their rule among ``rules``.
    """
    rows = _entries(spark, path)
    if rows is None:
        return None
    versions = [rule_version(r) for r in rules]
    place = F.create_map(*[x for i, v in enumerate(versions) for x in (F.lit(v), F.lit(i))])
    mine = F.filter("spans", lambda s: s["version"].isin(versions))
    spans = F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_list(mine))), lambda s: F.struct(
        s["span"]["start"].alias("start"), F.element_at(place, s["version"]).alias("ord"), s["span"]["end"].alias("end"),
        s["span"]["kind"].alias("kind"), s["span"]["value"].alias("value"), s["span"]["before"].alias("before"), s["span"]["after"].alias("after"))))
    return rows.filter(F.arrays_overlap("scanned", F.array(*[F.lit(v) for v in versions]))).groupBy("blob").agg(spans.alias("spans"))


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def update_ledger(docs: DataFrame, path: str, text: str = "text", rules=RULES) -> int:
    """Scan the pairs of blob and rule that the ledger lacks; returns the number of blobs looked at.

    Each run writes a folder of its own below ``path``.  Copies combine before the
    shuffle, so a text held by a third of all rows reaches its task once per map
    task.
    """
    spark = docs.sparkSession
    blobs = docs.select(blob_id(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    every = F.array(*[F.lit(rule_version(r)) for r in rules])
    known = _entries(spark, path)
    if known is None:
        fresh = blobs.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", every)
    else:
        seen = known.select("blob", F.explode("scanned").alias("version")).groupBy("blob").agg(F.collect_set("version").alias("seen"))
        todo = F.when(F.col("seen").isNull(), every).otherwise(F.array_except(every, F.col("seen")))
        lacking = blobs.select("blob").distinct().join(seen, "blob", "left").select("blob", todo.alias("todo")).filter(F.size("todo") > 0)
        lacking = stage(lacking, "secret-todo")
        # Only texts with something to do are shuffled, where the others can be told apart without it.
        wanted = blobs.join(lacking.select("blob"), "blob", "left_semi")
        fresh = wanted.groupBy("blob").agg(F.first("text").alias("text")).join(lacking, "blob")
    run = f"{path}/run-{uuid.uuid4().hex}"
    scan_blobs(fresh, rules).write.parquet(run)
    return spark.read.schema(LEDGER).parquet(run).count()


def scan_secrets(docs: DataFrame, ledger: str | None = None, doc_id: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """One row per document with the secrets of its whole text.

    Columns: the id, number of spans of each base rule, ``base_sha256``,
    ``spans`` and ``blob``.  Null reads as empty; repeated rows are repeated; null
    ids stay null; other columns are ignored; an empty table gives no rows.
    Without ``ledger`` a fresh one is kept in the shared folder.
    """
    spark = docs.sparkSession
    path = ledger or shared(spark, "secret-ledger")
    update_ledger(docs, path, text, rules)
    base = of_kinds(F.col("spans"), BASE)
    findings = read_ledger(spark, path, rules).select(
        "blob", *[count_kind(F.col("spans"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
    paths = stage(docs.select(F.col(doc_id).alias(doc_id), blob_id(F.col(text)).alias("blob")), "secret-paths")
    return paths.join(findings, "blob").select(doc_id, *[f"n_{k}" for k in BASE], "base_sha256", "spans", "blob")
