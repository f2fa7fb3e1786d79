"""Queries over the pattern scan."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptsift.operators import catalog, extract, listing, rollups, scan, store
from scriptsift.operators.detectors import SEVERITIES
from scriptsift.plans.custom_scan import rejected_rules, scan_custom
from scriptsift.plans.file_analysis import analyze_texts
from scriptsift.plans.incremental import scan_incremental
from scriptsift.session import shared_folder, staged

from .corpus import BUNDLES, SITE_PAGES, Derived, keyed
from .duck import RANK, findings_by_line, lit, matches_by_line, matches_in_text
from .registry import query, spread

KEYS = "asset_key, asset_url"
BUNDLE_FINDINGS = findings_by_line(BUNDLES.sql, KEYS)


def bundles(spark, sf):
    return BUNDLES.frame(spark, sf)


def chosen(**selection):
    return catalog.select_detectors(**selection)


COLUMNS = ("asset_key", "finding_type", "category", "value", "line_number", "severity", "confidence", "pattern_name")


def scan_by_type(finding_type):
    detectors = chosen(finding_types=[finding_type])
    sql = f"WITH {findings_by_line(BUNDLES.sql, KEYS, detectors)} SELECT {', '.join(COLUMNS)} FROM f"

    @query(f"scan_{finding_type}", sql)
    def run(spark, sf):
        return scan.scan_patterns(bundles(spark, sf), finding_types=[finding_type]).select(*COLUMNS)


for _type in ("secret", "endpoint", "hostname", "dom_sink", "postmessage", "prototype_pollution", "storage",
              "crypto_weakness"):
    scan_by_type(_type)


@query("leaked_secret_summary", f"""
WITH {findings_by_line(BUNDLES.sql, KEYS + ', project_id', chosen(finding_types=['secret']))}
SELECT project_id, severity, count(*) AS n, {RANK} AS severity_rank FROM f GROUP BY project_id, severity""")
def leaked_secret_summary(spark, sf):
    found = scan.scan_patterns(
        bundles(spark, sf), ("asset_key", "asset_url", "project_id"), finding_types=["secret"])
    return rollups.severity_counts(found)


@query("scan_pattern_totals", f"""
WITH {BUNDLE_FINDINGS}
SELECT pattern_name, finding_type, severity, count(*) AS n_findings, count(DISTINCT asset_key) AS n_assets
FROM f GROUP BY ALL""")
def scan_pattern_totals(spark, sf):
    found = scan.scan_patterns(bundles(spark, sf))
    return found.groupBy("pattern_name", "finding_type", "severity").agg(
        F.count("*").alias("n_findings"), F.countDistinct("asset_key").alias("n_assets"))


@query("scan_every_match", f"""
WITH {matches_by_line(BUNDLES.sql, KEYS)}
SELECT asset_key, pattern_name, v AS value, cast(n as int) AS line_number FROM m""")
def scan_every_match(spark, sf):
    return scan.scan_patterns(bundles(spark, sf), deduplicate=False).select(
        "asset_key", "pattern_name", "value", "line_number")


@query("unique_findings", f"WITH {BUNDLE_FINDINGS} SELECT asset_key, category, value, line_number FROM f")
def unique_findings(spark, sf):
    every = scan.scan_patterns(bundles(spark, sf), deduplicate=False).drop("context")
    return scan.unique_findings(every).select("asset_key", "category", "value", "line_number")


@query("match_lines", f"""
WITH {BUNDLE_FINDINGS}
SELECT asset_key, count(*) AS n_findings, min(line_number) AS first_line, max(line_number) AS last_line FROM f GROUP BY asset_key""")
def match_lines(spark, sf):
    return scan.scan_patterns(bundles(spark, sf)).groupBy("asset_key").agg(
        F.count("*").alias("n_findings"), F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line"))


@query("match_context", f"""
WITH {findings_by_line(BUNDLES.sql, KEYS, chosen(finding_types=['dom_sink']))}
SELECT f.asset_key, pattern_name, value, line_number,
  array_to_string(lines[greatest(line_number - 2, 1):line_number + 2], chr(10)) AS context
FROM f JOIN t ON f.asset_key = t.asset_key""")
def match_context(spark, sf):
    return scan.scan_patterns(bundles(spark, sf), finding_types=["dom_sink"]).select(
        "asset_key", "pattern_name", "value", "line_number", "context")


@query("match_context_one_line", f"""
WITH {findings_by_line(BUNDLES.sql, KEYS, chosen(finding_types=['storage']))}
SELECT f.asset_key, pattern_name, value, lines[line_number] AS context
FROM f JOIN t ON f.asset_key = t.asset_key""")
def match_context_one_line(spark, sf):
    return scan.scan_patterns(bundles(spark, sf), finding_types=["storage"], context_lines=0).select(
        "asset_key", "pattern_name", "value", "context")


@query("scan_min_severity", f"""
WITH {findings_by_line(BUNDLES.sql, KEYS, chosen(min_severity='high'))}
SELECT asset_key, pattern_name, severity, value FROM f""")
def scan_min_severity(spark, sf):
    return scan.scan_patterns(bundles(spark, sf), min_severity="high").select(
        "asset_key", "pattern_name", "severity", "value")


_ENABLED = ["innerHTML", "eval", "jwt_token", "generic_secret", "full_url"]
_DISABLED = ["eval", "full_url"]


@query("scan_selected_categories", f"""
WITH {BUNDLE_FINDINGS} SELECT asset_key, category, value FROM f
WHERE category IN ('innerHTML', 'jwt_token', 'generic_secret')""")
def scan_selected_categories(spark, sf):
    return scan.scan_patterns(
        bundles(spark, sf), enabled_categories=_ENABLED, disabled_categories=_DISABLED,
    ).select("asset_key", "category", "value")


@query("scan_documents", f"""
WITH {matches_in_text('documents', 'doc_id', content='text')}
SELECT DISTINCT doc_id, pattern_name, v AS value FROM m""")
def scan_documents(spark, sf):
    docs = spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    return scan.scan_patterns(docs, ("doc_id",), "text").select("doc_id", "pattern_name", "value")


@query("scan_conversations", f"""
WITH {matches_in_text('conversations', 'conv_id, turn, role', content='text')}
SELECT c.role, c.n_turns, coalesce(m.n, 0) AS n_findings FROM (SELECT role, count(*) AS n_turns FROM conversations GROUP BY role) c
LEFT JOIN (SELECT role, count(DISTINCT (conv_id, turn, pattern_name, v)) AS n FROM m GROUP BY role) m ON c.role = m.role""")
def scan_conversations(spark, sf):
    turns = spread(spark.read.parquet(f"{sf}/conversations.parquet"))
    found = scan.scan_patterns(turns, ("conv_id", "turn", "role"), "text")
    return turns.groupBy("role").agg(F.count("*").alias("n_turns")).join(
        found.groupBy("role").agg(F.count("*").alias("n_findings")), "role", "left").na.fill(0, ["n_findings"])


@query("scan_page_html", f"""
WITH {matches_in_text(SITE_PAGES.sql, 'page_id', content='html')}
SELECT page_id, pattern_name, v AS value, count(*) AS n FROM m GROUP BY ALL""")
def scan_page_html(spark, sf):
    pages = SITE_PAGES.frame(spark, sf)
    found = scan.scan_patterns(pages, ("page_id",), "html", deduplicate=False)
    return found.groupBy("page_id", "pattern_name", "value").agg(F.count("*").alias("n"))


@query("scan_once_per_hash", f"""
WITH a AS (SELECT k AS asset_key, fa AS content FROM (SELECT asset_key AS k,
  concat('var token=\"', md5(cast(asset_key % 500 as string)), '\";', chr(10), 'eval(x)') AS fa FROM {BUNDLES.sql})),
{findings_by_line('a', 'asset_key')}
SELECT asset_key, pattern_name, value, line_number FROM f""")
def scan_once_per_hash(spark, sf):
    copies = bundles(spark, sf).selectExpr(
        "asset_key",
        "concat('var token=\"', md5(cast(asset_key % 500 as string)), '\";', chr(10), 'eval(x)') as content")
    return scan.scan_once_per_hash(copies, ("asset_key",)).select("asset_key", "pattern_name", "value", "line_number")


@query("incremental_findings", f"WITH {BUNDLE_FINDINGS} SELECT {', '.join(COLUMNS)} FROM f")
def incremental_findings(spark, sf):
    """All bundles scanned without the secret detectors first, then with the whole catalog, of which only these run."""
    ledger = shared_folder(spark, "ledger")
    texts = staged(bundles(spark, sf), shared_folder(spark, "bundles"), compression="zstd")
    types = [t for t in dict.fromkeys(d.finding_type for d in chosen()) if t != "secret"]
    scan_incremental(texts, ledger, finding_types=types)
    return scan_incremental(texts, ledger).select(*COLUMNS)


_LITERALS = f"""s0 AS (SELECT asset_key, list_filter(list_concat(list_concat(
    regexp_extract_all(content, {lit("'((?:[^'" + chr(92)*2 + "]|" + chr(92)*2 + ".)*)'")}, 1),
    regexp_extract_all(content, {lit('"((?:[^"' + chr(92)*2 + ']|' + chr(92)*2 + '.)*)"')}, 1)),
    regexp_extract_all(content, {lit('`((?:[^`' + chr(92)*2 + ']|' + chr(92)*2 + '.)*)`')}, 1)), lambda x: trim(x) <> '') AS ls
  FROM {BUNDLES.sql}),
s AS (SELECT asset_key, trim(unnest(ls)) AS literal, unnest(range(0, len(ls))) AS pos FROM s0)"""


@query("string_literals", f"WITH {_LITERALS} SELECT asset_key, cast(pos as int) AS pos, literal FROM s")
def string_literals(spark, sf):
    return extract.extract_literals(bundles(spark, sf))


@query("scan_string_literals", f"""
WITH {_LITERALS}, j AS (SELECT asset_key, string_agg(literal, chr(10) ORDER BY pos) AS content FROM s GROUP BY asset_key),
{findings_by_line('j', 'asset_key')}
SELECT asset_key, pattern_name, value, line_number FROM f""")
def scan_string_literals(spark, sf):
    return scan.scan_string_literals(bundles(spark, sf), ("asset_key",)).select(
        "asset_key", "pattern_name", "value", "line_number")


_SUMMARY = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in SEVERITIES)


@query("asset_summary", f"""
WITH {BUNDLE_FINDINGS}, c AS (SELECT asset_key, count(*) AS total, {_SUMMARY} FROM f GROUP BY asset_key)
SELECT a.asset_key, coalesce(total, 0) AS total, {', '.join(f'coalesce({s}, 0) AS {s}' for s in SEVERITIES)}
FROM {BUNDLES.sql} a LEFT JOIN c ON a.asset_key = c.asset_key""")
def asset_summary(spark, sf):
    assets = bundles(spark, sf)
    return rollups.asset_summary(scan.scan_patterns(assets), assets)


@query("ranked_findings", f"""
WITH {BUNDLE_FINDINGS}
SELECT asset_key, severity, category, value, row_number() OVER (ORDER BY {RANK}, asset_key, category, value) AS place FROM f""")
def ranked_findings(spark, sf):
    """The place makes the order visible to an order-insensitive comparison."""
    found = scan.scan_patterns(bundles(spark, sf)).select("asset_key", "severity", "category", "value")
    # Stored, as a sort reads its input twice: for the bounds of its ranges and for the rows.
    found = staged(found, shared_folder(spark, "to-rank"))
    ordered = listing.ranked(found, ("asset_key", "category", "value"))
    return with_places(ordered)


def with_places(ordered):
    """Number the rows of a sorted frame without moving them to one task.

    Rows are counted per partition of the sort, and each partition starts where
    the ones before it end.  The sorted rows are stored, so that counts and rows
    come from one and the same sort.
    """
    part = staged(
        ordered.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()}),
        shared_folder(ordered.sparkSession, "places"))
    counts = part.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.withColumn(
        "__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    low_bits = F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))
    # A row per partition of the sort, so the sorted rows stay where they are.
    return part.join(F.broadcast(before), "__p").withColumn("place", F.col("__before") + low_bits + 1).drop(
        "__p", "__i", "__n", "__before")


@query("persisted_findings", f"""
WITH {BUNDLE_FINDINGS}
SELECT asset_key, finding_type, category, value, min(line_number) AS line_number FROM f
GROUP BY ALL""")
def persisted_findings(spark, sf):
    found = scan.scan_patterns(bundles(spark, sf))
    return store.persistable_findings(found).select("asset_key", "finding_type", "category", "value", "line_number")


# Catalog position of a pattern.
_ORD = "CASE pattern_name " + " ".join(
    f"WHEN {lit(d.name)} THEN {i}" for i, d in enumerate(catalog.builtin_detectors())) + " END"


@query("persisted_findings_compat", f"""
WITH {BUNDLE_FINDINGS}
SELECT asset_key, finding_type, substr(value, 1, 500) AS value, min_by(category, {_ORD}) AS category FROM f
GROUP BY asset_key, finding_type, substr(value, 1, 500)""")
def persisted_findings_compat(spark, sf):
    found = scan.scan_patterns(bundles(spark, sf))
    return store.persistable_findings(found, compat=True).select("asset_key", "finding_type", "value", "category")


_CATALOG_ROWS = ", ".join(
    f"({i}, {lit(d.name)}, {lit(d.finding_type)}, {lit(d.category)}, {lit(d.severity)}, {lit(d.confidence)}, {lit(d.description)})"
    for i, d in enumerate(catalog.builtin_detectors()))


@query("pattern_catalog", f"""
WITH {BUNDLE_FINDINGS}
SELECT c.*, coalesce(n, 0) AS n_findings FROM (VALUES {_CATALOG_ROWS}) c(ord, name, finding_type, category, severity, confidence, description)
LEFT JOIN (SELECT pattern_name, count(*) AS n FROM f GROUP BY 1) ON name = pattern_name""")
def pattern_catalog(spark, sf):
    """The catalog with the number of findings each row has in the corpus."""
    seen = scan.scan_patterns(bundles(spark, sf)).groupBy(F.col("pattern_name").alias("name")).agg(
        F.count("*").alias("n_findings"))
    listed = catalog.pattern_catalog(spark).join(seen, "name", "left").na.fill(0, ["n_findings"])
    return listed.select("ord", "name", "finding_type", "category", "severity", "confidence", "description", "n_findings")


@query("pattern_type_counts", f"""
WITH {BUNDLE_FINDINGS}
SELECT finding_type, severity, count(DISTINCT pattern_name) AS n_patterns, count(*) AS n_findings FROM f GROUP BY ALL""")
def pattern_type_counts(spark, sf):
    found = scan.scan_patterns(bundles(spark, sf)).groupBy("finding_type", "severity").agg(
        F.count("*").alias("n_findings"))
    return catalog.pattern_type_counts(catalog.pattern_catalog(spark)).join(
        found, ["finding_type", "severity"])


CUSTOM_SQL = (
    "(SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey % 4 END AS project_id, "
    "concat('rule', cast(n_nationkey as string)) AS name, "
    "CASE WHEN n_nationkey % 8 = 5 THEN 'script' ELSE 'regex' END AS pattern_type, "
    "CASE WHEN n_nationkey % 2 = 0 THEN concat('v', cast(n_nationkey as string), '[0-9]+') "
    "ELSE concat('(?i)b', cast(n_nationkey as string), '[0-9]{2,3}') END AS pattern, "
    "'custom' AS finding_type, CASE WHEN n_nationkey % 2 = 0 THEN 'low' ELSE 'high' END AS severity, "
    "'' AS description, n_nationkey % 7 <> 6 AS enabled FROM nation)")


def custom_table(spark, sf):
    spark.read.parquet(f"{sf}/nation.parquet").createOrReplaceTempView("nation")
    return spark.sql(CUSTOM_SQL.strip("()"))


_CUSTOM_ON = "enabled AND pattern_type = 'regex' AND (project_id IS NULL OR project_id = 1)"


@query("enabled_custom_patterns", f"""
SELECT id, project_id, name, pattern FROM {CUSTOM_SQL} WHERE enabled AND (project_id IS NULL OR project_id = 2)""")
def enabled_custom_patterns(spark, sf):
    return catalog.enabled_custom_patterns(custom_table(spark, sf), 2).select("id", "project_id", "name", "pattern")


@query("scan_custom_patterns", f"""
SELECT DISTINCT asset_key, name AS pattern_name, unnest(regexp_extract_all(content, pattern)) AS value
FROM {BUNDLES.sql} a, {CUSTOM_SQL} p WHERE {_CUSTOM_ON.replace('project_id', 'p.project_id')}""")
def scan_custom_patterns(spark, sf):
    rules = catalog.custom_detectors(custom_table(spark, sf), 1)
    good, _ = catalog.valid_detectors(spark, rules)
    return scan.scan_patterns(bundles(spark, sf), detectors=good).select("asset_key", "pattern_name", "value")


@query("catalog_with_extra_patterns", f"""
WITH {BUNDLE_FINDINGS}
SELECT pattern_name, count(*) AS n FROM f WHERE severity IN ('critical', 'high') GROUP BY pattern_name
UNION ALL SELECT 'todo', count(*) FROM (SELECT DISTINCT asset_key, unnest(regexp_extract_all(content, 'bundle [0-9]+')) FROM {BUNDLES.sql})""")
def catalog_with_extra_patterns(spark, sf):
    extra = [catalog.Detector("todo", "bundle [0-9]+", "note", "todo", "high")]
    found = scan.scan_patterns(bundles(spark, sf), extra=extra, min_severity="high")
    return found.groupBy("pattern_name").agg(F.count("*").alias("n"))


@query("findings_of_reflowed_scripts", f"""
WITH {matches_in_text(f"(SELECT asset_key, content FROM {BUNDLES.sql})", 'asset_key', chosen(finding_types=['crypto_weakness', 'storage']))}
SELECT DISTINCT asset_key, pattern_name, v AS value FROM m""")
def findings_of_reflowed_scripts(spark, sf):
    return analyze_texts(
        bundles(spark, sf), ("asset_key",), finding_types=["crypto_weakness", "storage"],
    ).select("asset_key", "pattern_name", "value")


# Addresses that are equal in their first 500 characters and more.
_LONG_VALUES = Derived("customer", (
    keyed("c_custkey"),
    (("asset_key", "k % 40"), ("content", "concat('u = \"https://h.example.com/', repeat('a', 520 + cast(k % 3 as int)), cast(k as string), '\"')")),
))


@query("long_value_findings", f"""
SELECT DISTINCT asset_key, regexp_extract(content, 'https://[^"]*') AS value FROM {_LONG_VALUES.sql}""")
def long_value_findings(spark, sf):
    found = scan.scan_patterns(_LONG_VALUES.frame(spark, sf), ("asset_key",), finding_types=["endpoint"], enabled_categories=["full_url"])
    return store.persistable_findings(found).select("asset_key", "value")


@query("scan_documents_once_per_hash", f"""
WITH {matches_in_text('documents', 'doc_id', content='text')}
SELECT DISTINCT doc_id, pattern_name, v AS value FROM m""")
def scan_documents_once_per_hash(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return scan.scan_once_per_hash(docs, ("doc_id",), "text").select("doc_id", "pattern_name", "value")


# Rules that grow with the suppliers; every ninth cannot be compiled.
RULES_SQL = (
    "(SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 7 END AS project_id, concat('rule', cast(s_suppkey as string)) AS name, "
    "'regex' AS pattern_type, CASE WHEN s_suppkey % 9 = 4 THEN concat('(', cast(s_suppkey as string)) "
    "ELSE concat('bundle ', cast(s_suppkey as string), '[0-9]?;') END AS pattern, "
    "'custom' AS finding_type, 'low' AS severity, '' AS description, s_suppkey % 5 <> 1 AS enabled FROM supplier)")


def rules(spark, sf):
    spark.read.parquet(f"{sf}/supplier.parquet").createOrReplaceTempView("supplier")
    return spark.sql(RULES_SQL.strip("()"))


@query("rejected_patterns", f"""
SELECT name, pattern AS regex FROM {RULES_SQL} WHERE enabled AND id % 9 = 4 AND (project_id IS NULL OR project_id = 7)""")
def rejected_patterns(spark, sf):
    return rejected_rules(rules(spark, sf), 7, page=500).select("name", "regex")


_RULE_TEXTS = Derived("orders", (
    keyed("o_orderkey"), (("asset_key", "k"), ("content", "concat('x; bundle ', cast(k % 700 as string), '; y')"))))


@query("scan_custom_table", f"""
SELECT DISTINCT asset_key, name AS pattern_name, regexp_extract(content, 'bundle [0-9]+;') AS value FROM {_RULE_TEXTS.sql} a
JOIN (SELECT *, unnest(list_concat([''], [cast(d AS varchar) for d in range(10)])) AS digit FROM {RULES_SQL} WHERE enabled AND id % 9 <> 4 AND (project_id IS NULL OR project_id = 7)) p
ON contains(a.content, 'bundle ' || p.id || p.digit || ';')""")
def scan_custom_table(spark, sf):
    found = scan_custom(_RULE_TEXTS.frame(spark, sf), rules(spark, sf), 7, ("asset_key",), page=40)
    return found.select("asset_key", "pattern_name", "value")
