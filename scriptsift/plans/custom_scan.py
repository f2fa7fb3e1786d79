"""Scan with a table of custom patterns of any size, reading the texts once.

An inverted index of byte groups says which rules a text can match at all.  Each
rule is put down to the literals it needs, each literal to its rarest group in
these very texts; texts and rules meet where they share a group, and only such
pairs are run.  A group has about half the bytes of its literal or more: groups of
three are shared by ever more rules as these grow in number.  Rules and texts are both data: neither the plan nor the driver
grows with the number of rules, and a text is read once for all of them.

Rules without such literals meet every text, as they must.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..operators import literals
from ..operators.catalog import Detector, custom_detector_pages, detector_regex, enabled_custom_patterns, rejections
from ..operators.scan import RULE, scan_with_rules, unique_findings
from ..session import shared_folder, staged

# Rules that the driver checks at a time.
PAGE = 2000
# Bits of the bitmap of wanted groups.
_BITS = 1 << 26
_INDEXED = "p_ord long, rule " + RULE + ", folds boolean, literal string, level int, codes array<long>"


def _index(batches):
    """A row per rule and literal it may need, with the literal's byte groups; one without, if nothing is known."""
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            d = Detector(row.name, row.pattern, row.finding_type, row.name, row.severity, "medium")
            rule = {
                "p_ord": row.id, "regex": detector_regex(d), "value_group": d.value_group, "finding_type": row.finding_type,
                "category": row.name, "severity": row.severity, "confidence": "medium", "pattern_name": row.name}
            folds, needed = literals.required_literals(row.pattern)
            for literal in needed or [None]:
                level = literals.level_of(literal.encode()) if literal else literals.GRAM
                codes = np.unique(literals.groups(literal.encode(), {level})).tolist() if literal else [literals.ALWAYS]
                out.append((row.id, rule, folds and bool(needed), literal, level, codes))
        yield pd.DataFrame(out, columns=["p_ord", "rule", "folds", "literal", "level", "codes"])


def rejected_rules(custom: DataFrame, project_id=None, page: int = PAGE, folder: str | None = None) -> DataFrame:
    """(name, regex, reason) of a project's enabled rules that cannot be compiled.

    Expressions are checked page by page on the driver, where they cost nothing but
    the check; which ones failed is written down whenever a page of them has come
    together, and not kept.
    """
    spark = custom.sparkSession
    folder = folder or shared_folder(spark, "rejected-rules")
    schema = "name string, regex string, reason string"
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/page=0")
    found, number = [], 0

    def write():
        spark.createDataFrame(found, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/page={number}")

    for detectors in custom_detector_pages(custom, project_id, page):
        found += rejections(spark, detectors)
        if len(found) >= PAGE:
            number += 1
            write()
            found = []
    if found:
        number += 1
        write()
    return spark.read.schema(f"{schema}, page int").parquet(folder).drop("page")


def rule_index(custom: DataFrame, project_id=None, page: int = PAGE, folder: str | None = None) -> DataFrame:
    """The enabled rules of a project that compile, with the literals they need."""
    spark = custom.sparkSession
    folder = folder or shared_folder(spark, "rule-index")
    rules = (
        enabled_custom_patterns(custom, project_id).filter((F.col("pattern_type") == "regex") & F.col("id").isNotNull())
        .select(F.col("id").cast("long").alias("id"), "name", "pattern", "finding_type", "severity"))
    bad = rejected_rules(custom, project_id, page, f"{folder}/rejected")
    same = (F.col("r.name").eqNullSafe(F.col("b.name"))) & (F.col("r.pattern") == F.col("b.regex"))
    good = rules.alias("r").join(bad.alias("b"), same, "left_anti")
    return staged(good.mapInPandas(_index, _INDEXED), f"{folder}/rules")


def _with_codes(batches, content: str, wanted: bytes, levels: set, folding: bool, always: bool):
    """Texts with the byte groups they hold, as far as the bitmap wants them; others stay behind."""
    asked = np.unpackbits(np.frombuffer(wanted, np.uint8)).view(bool)
    for batch in batches:
        found, kept = [], []
        for row, text in enumerate(batch.column(content).to_pylist()):
            if text is None:
                continue
            codes = literals.groups(text.encode("utf-8", "surrogatepass"), levels) if levels else np.zeros(0, np.int64)
            codes = np.unique(codes[asked[codes % _BITS]]).tolist()
            if folding and not text.isascii() and any(c in text for c in literals.FOLDING_LETTERS):
                codes.append(literals.FOLDING)
            if always:
                codes.append(literals.ALWAYS)
            if codes:
                found.append(codes)
                kept.append(row)
        taken = pa.Table.from_batches([batch]).take(pa.array(kept, pa.int64()))
        yield from taken.append_column("__codes", pa.array(found, pa.list_(pa.int64()))).combine_chunks().to_batches()


def candidates(texts: DataFrame, index: DataFrame, content: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """(texts that some rule can match, pairs of a text and the rules to run on it).

    The wanted groups are a bitmap of 8 MB, however many rules there are; what it
    lets through by chance meets no rule.
    """
    flags = index.agg(F.max("folds").alias("folds"), F.max(F.col("literal").isNull()).alias("always")).first()
    literal = index.filter("literal is not null")
    levels = {r["level"] for r in literal.select("level").distinct().collect()}
    wanted = np.zeros(_BITS, bool)
    wanted[literal.select(F.explode("codes").alias("code")).select((F.col("code") % _BITS).alias("bit")).distinct().toArrow()["bit"].to_numpy()] = True
    find = partial(
        _with_codes, content=content, wanted=np.packbits(wanted).tobytes(), levels=levels, folding=bool(flags["folds"]), always=bool(flags["always"]))
    schema = StructType([*texts.schema.fields, StructField("__codes", ArrayType(LongType()))])
    held = staged(texts.mapInArrow(find, schema).withColumn("__rid", F.monotonically_increasing_id()), f"{folder}/texts")
    places = held.select("__rid", F.explode("__codes").alias("code"))

    # Of a literal's groups the one that fewest texts hold; a group that no text holds rules the literal out.
    counts = places.groupBy("code").agg(F.count("*").alias("n"))
    each = index.select("p_ord", "literal", F.size("codes").alias("size"), F.explode("codes").alias("code")).join(counts, "code")
    rarest = (
        each.groupBy("p_ord", "literal").agg(F.min(F.struct("n", "code")).alias("best"), F.count("*").alias("there"), F.first("size").alias("size"))
        .filter("there = size").select("p_ord", "literal", F.col("best.code").alias("code")))
    folding = index.filter("folds").select("p_ord", F.lit(None).cast("string").alias("literal"), F.lit(literals.FOLDING).cast("long").alias("code"))
    keys = staged(rarest.unionByName(folding.distinct()), f"{folder}/keys")
    pairs = places.join(keys, "code").select("__rid", "p_ord", "literal")
    return held, staged(pairs.distinct(), f"{folder}/pairs")


def scan_custom(
    texts: DataFrame, custom: DataFrame, project_id=None, keys=("asset_key", "asset_url"), content: str = "content",
    page: int = PAGE, folder: str | None = None, **options,
) -> DataFrame:
    """Findings of all enabled patterns of a project; ``p_ord`` is the id of the pattern.

    The texts are read once, whatever the number of patterns.  Patterns that
    cannot be compiled are left out.  Each run stages its tables anew, so a
    repeated run repeats no finding.
    """
    spark = texts.sparkSession
    folder = shared_folder(spark, "custom-scan") if folder is None else folder
    index = rule_index(custom, project_id, page, f"{folder}/index")
    held, pairs = candidates(texts.select(*keys, content), index, content, folder)
    rules = index.select("p_ord", "rule").dropDuplicates(["p_ord"])
    asked = pairs.join(rules, "p_ord").groupBy("__rid").agg(F.collect_list(F.struct("literal", "rule")).alias("__asked"))
    # A literal that the text does not hold as a whole is no candidate after all.
    lower = F.translate(F.col(content), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    joined = held.join(asked, "__rid").withColumn("__lower", lower)
    there = F.filter("__asked", lambda a: a["literal"].isNull() | F.contains(F.col("__lower"), a["literal"]))
    ready = joined.withColumn("__run", F.array_sort(F.array_distinct(F.transform(there, lambda a: a["rule"]))))
    found = scan_with_rules(ready, keys, content, "__run", **options)
    labels = rules.groupBy("rule.finding_type", "rule.category").count().filter("count > 1")
    if options.get("deduplicate", True) and not labels.isEmpty():
        # Rules that share a label may repeat each other's findings.
        found = unique_findings(found, keys)
    return found
