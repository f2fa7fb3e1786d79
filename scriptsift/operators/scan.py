"""Pattern scan: every match of every detector, with line and context.

Shape of the plan for one input row::

    text ─► cheap literal tests: the detectors that can match
         ─► per such detector one pass over the text: values, lines, context
         ─► inline(findings)

The scan is row local.  It needs no shuffle, the text never leaves the task
that read it, and the plan does not grow with the number of matches.  Only
findings (value, line, at most a few lines of context) flow downstream.

The row expression is composed as SQL text: as thousands of separate column
objects it would cost seconds on the driver.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import EDGE_SPACE, any_lines, content_hash, is_blank
from ..session import shared_folder, staged
from .catalog import Detector, detector_regex, select_detectors
from .extract import string_literals

MIN_VALUE_LENGTH = 3
# Detectors handled in one pass over the text; larger catalogs take more passes.
DETECTORS_PER_PASS = 200

# Noncharacters no detector tells apart.  The first marks a match, the second
# ends the copy of its value, the third stands in for both where the text itself
# holds them.
_MARK, _END, _STAND_IN = "\ufdd0", "\ufdd1", "\ufdd2"

# Letters outside ASCII that fold to i and s; where they occur the lower-case
# literal test cannot be trusted.
_FOLDING = ("İ", "ı", "ſ")

FINDING_COLUMNS = [
    "finding_type", "category", "value", "context", "line_number",
    "confidence", "severity", "pattern_name", "p_ord", "m_ord",
]
# What the detector alone tells of a finding.
LABELS = ["finding_type", "category", "confidence", "severity", "pattern_name"]


def _quoted(literal: str) -> str:
    return "'" + literal.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _has(subject: str, group) -> str:
    return "(" + " OR ".join(f"contains({subject}, {_quoted(lit)})" for lit in group) + ")"


def _is_caseless(group) -> bool:
    """Groups without letters read the same in the lower-cased text."""
    return not any(c.isalpha() for lit in group for c in lit)


def _shared_groups(detectors) -> dict:
    """Literal groups of more than one detector, with the column they get."""
    uses = Counter(g for d in detectors for g in set(d.required) if not d.ignores_case or _is_caseless(g))
    return {g: f"__g{i}" for i, g in enumerate(g for g, n in uses.items() if n > 1)}


def _can_match(d: Detector, shared: dict) -> str:
    """Necessary condition for a match, from literals alone."""
    if not d.required:
        return "NOT __blank"
    subject = "__lower" if d.ignores_case else "__text"
    test = " AND ".join(
        shared[g] if g in shared and (not d.ignores_case or _is_caseless(g)) else _has(subject, g) for g in d.required)
    return f"({test}) OR __folding" if d.ignores_case else test


def _candidates(detectors, shared: dict, prefilter: bool) -> Column:
    """Indexes of the detectors worth running on a row.

    A lambda drops the others: hundreds of tests generated into one method would be
    too long for the JVM to compile, and such a method runs several times slower.
    """
    arms = [
        f"CASE WHEN {_can_match(d, shared) if prefilter else 'NOT __blank'} THEN {i} ELSE -1 END"
        for i, d in enumerate(detectors)]
    return F.expr(f"filter(array({', '.join(arms)}), i -> i >= 0)")


def _switch(name: str, arms, first: int = 0) -> str:
    """SQL: the arm ``name`` points at, found by halving."""
    if len(arms) == 1:
        return arms[0]
    half = len(arms) // 2
    return (f"CASE WHEN {name} < {first + half} THEN {_switch(name, arms[:half], first)} "
            f"ELSE {_switch(name, arms[half:], first + half)} END")


def _labels(detectors, first_ord: int) -> Column:
    """Catalog rows of the pass as one constant array."""
    rows = ", ".join(
        f"named_struct('finding_type', {_quoted(d.finding_type)}, 'category', {_quoted(d.category)}, "
        f"'confidence', {_quoted(d.confidence)}, 'severity', {_quoted(d.severity)}, "
        f"'pattern_name', {_quoted(d.name)}, 'p_ord', {first_ord + i})"
        for i, d in enumerate(detectors))
    return F.expr(f"get(array({rows}), __i)")


def with_labels(findings: DataFrame, detectors) -> DataFrame:
    """Findings with the labels of the detector that ``p_ord`` points at."""
    label = F.col("__d")
    return findings.withColumn("__i", F.col("p_ord")).withColumn("__d", _labels(detectors, 0)).withColumns(
        {c: label[c] for c in LABELS}).drop("__i", "__d")


def _let(name: str, value: str, body: str) -> str:
    """SQL: evaluate ``value`` once and use it as ``name`` in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


# With few matches a running sum of line feeds gives their lines; its cost is
# quadratic in the matches, so many matches take the way that is linear in the
# lines of the text.
_FEW = 64


_NOTHING = "cast(array() as array<struct<__i:{0},value:string,m_ord:int,line_number:int,context:string>>)"
_CLEAN = f"CASE WHEN __odd THEN translate(__text, '{_MARK}{_END}', '{_STAND_IN}{_STAND_IN}') ELSE __text END"


def _of_detector(label: str, marked: str, again: str, context_lines: int, deduplicate: bool, nothing: str) -> str:
    """SQL: array of (label, value, m_ord, line_number, context) of one detector on one text.

    A detector's pass marks each match with mark, value, end.  Cut at the marks,
    the result yields values and places at once.  ``again`` extracts the values of
    a text that holds the marks itself; ``ls`` are the lines of the text.
    """
    n = context_lines
    values = (
        f"CASE WHEN __odd THEN {again} "
        f"ELSE transform(slice(ps, 2, size(ps) - 1), p -> substring_index(p, '{_END}', 1)) END")
    bare = f"transform(ps, (p, i) -> CASE WHEN i = 0 THEN p ELSE split_part(p, '{_END}', 2) END)"
    few = (
        "aggregate(slice(bs, 1, size(bs) - 1), cast(array() as array<int>), (a, p) -> "
        r"array_append(a, coalesce(get(a, size(a) - 1), 1) + length(p) - length(replace(p, '\n', ''))))")
    many = (
        rf"flatten(transform(split(array_join(bs, '{_MARK}'), '\n', -1), (l, i) -> "
        f"array_repeat(i + 1, length(l) - length(replace(l, '{_MARK}', '')))))")
    at = _let("bs", bare, f"CASE WHEN size(bs) <= {_FEW + 1} THEN {few} ELSE {many} END")
    strip_ = f"regexp_replace(v, {_quoted(EDGE_SPACE)}, '')"
    found = _let("at", at, (
        f"filter(transform({values}, (v, i) -> named_struct('value', {strip_}, 'm_ord', i, 'line_number', get(at, i))), "
        f"f -> length(f.value) >= {MIN_VALUE_LENGTH})"))
    if deduplicate:
        # Sorted by value, then position: the first of each value stays.
        found = _let("fs", f"sort_array({found})", (
            "CASE WHEN size(fs) < 2 THEN fs ELSE filter(fs, (f, i) -> i = 0 OR f.value <> get(fs, i - 1).value) END"))
    shown = (
        f"transform({found}, f -> named_struct('__i', {label}, 'value', f.value, 'm_ord', f.m_ord, 'line_number', f.line_number, "
        f"'context', array_join(slice(ls, greatest(f.line_number - {n}, 1), "
        rf"f.line_number + {n} - greatest(f.line_number - {n}, 1) + 1), '\n')))")
    return _let("m", marked, (
        f"CASE WHEN contains(m, '{_MARK}') THEN {_let('ps', f'split(m, {_quoted(_MARK)}, -1)', shown)} ELSE {nothing} END"))


def _lines_sql(compat: bool) -> str:
    return "__lines" if compat else r"split(__text, '\n', -1)"


def _row_findings(detectors, context_lines: int, deduplicate: bool, compat: bool) -> Column:
    """Array of (i, value, m_ord, line_number, context) of one text."""
    marked = _switch("d", [
        f"regexp_replace({_CLEAN}, {_quoted(detector_regex(d))}, '{_MARK}${d.value_group}{_END}$0')" for d in detectors])
    regexes = ", ".join(_quoted(detector_regex(d)) for d in detectors)
    groups = ", ".join(str(d.value_group) for d in detectors)
    again = f"regexp_extract_all(__text, get(array({regexes}), d), get(array({groups}), d))"
    nothing = _NOTHING.format("int")
    of_detector = _of_detector("d", marked, again, context_lines, deduplicate, nothing)
    of_text = _let("ls", _lines_sql(compat), f"flatten(transform(__run, d -> {of_detector}))")
    return F.expr(f"CASE WHEN size(__run) > 0 THEN {of_text} ELSE {nothing} END")


# A rule as data: its place, its expression for the JVM, and what its findings are labelled with.
RULE = (
    "struct<p_ord:bigint,regex:string,value_group:int,finding_type:string,category:string,severity:string,"
    "confidence:string,pattern_name:string>")


def scan_with_rules(
    texts: DataFrame, keys=("asset_key", "asset_url"), content: str = "content", rules: str = "rules",
    context_lines: int = 2, deduplicate: bool = True, compat: bool = False,
) -> DataFrame:
    """Findings of the rules that stand in a column of the texts, an array of ``RULE``.

    Rules are data, so a plan serves any number of them; an expression is compiled
    anew wherever it follows another one.
    """
    text = F.col("__text")
    src = texts.select(*keys, F.col(content).alias("__text"), F.col(rules).alias("__rules")).withColumns({
        "__blank": is_blank(text), "__wide": F.octet_length(text) > F.length(text)}).withColumns({
            "__odd": F.col("__wide") & (text.contains(_MARK) | text.contains(_END))})
    if compat:
        src = src.withColumn("__lines", any_lines(text))
    marked = f"regexp_replace({_CLEAN}, r.regex, concat('{_MARK}$', r.value_group, '{_END}$0'))"
    again = "regexp_extract_all(__text, r.regex, r.value_group)"
    nothing = _NOTHING.format(RULE)
    of_rule = _of_detector("r", marked, again, context_lines, deduplicate, nothing)
    of_text = _let("ls", _lines_sql(compat), f"flatten(transform(__rules, r -> {of_rule}))")
    found = F.expr(f"CASE WHEN size(__rules) > 0 AND NOT __blank THEN {of_text} ELSE {nothing} END")
    return src.select(*keys, F.inline(found)).select(
        *keys, "__i.finding_type", "__i.category", "value", "context", "line_number", "__i.confidence", "__i.severity",
        "__i.pattern_name", "__i.p_ord", "m_ord")


def _scan_pass(texts, keys, content, detectors, first_ord, context_lines, deduplicate, compat, prefilter, todo):
    text = F.col("__text")
    asked = [F.col(todo).alias("__todo")] if todo else []
    # Blank texts drop out with their candidates: a filter here would make the
    # optimizer compute a derived text twice.
    src = texts.select(*keys, F.col(content).alias("__text"), *asked).withColumns({
        "__blank": is_blank(text), "__wide": F.octet_length(text) > F.length(text)})
    rare = {"__odd": F.col("__wide") & (text.contains(_MARK) | text.contains(_END))}
    shared = _shared_groups(detectors) if prefilter else {}
    rare.update({name: F.expr(_has("__text", group)) for group, name in shared.items()})
    if prefilter and any(d.ignores_case for d in detectors):
        folding = F.lit(False)
        for letter in _FOLDING:
            folding = folding | text.contains(letter)
        rare.update({"__lower": F.lower(text), "__folding": F.col("__wide") & folding})
    src = src.withColumns(rare)
    extra = [any_lines(text).alias("__lines")] if compat else []
    label = F.col("__d")
    run = _candidates(detectors, shared, prefilter)
    if todo:
        run = F.filter(run, lambda d: F.array_contains("__todo", d + first_ord))
    return (
        src.select(*keys, "__text", "__odd", run.alias("__run"), *extra)
        .select(*keys, F.inline(_row_findings(detectors, context_lines, deduplicate, compat)))
        .withColumn("__d", _labels(detectors, first_ord))
        .select(
            *keys, label["finding_type"].alias("finding_type"), label["category"].alias("category"),
            "value", "context", "line_number", label["confidence"].alias("confidence"),
            label["severity"].alias("severity"), label["pattern_name"].alias("pattern_name"),
            label["p_ord"].alias("p_ord"), "m_ord")
    )


def scan_patterns(
    texts: DataFrame,
    keys=("asset_key", "asset_url"),
    content: str = "content",
    detectors=None,
    context_lines: int = 2,
    deduplicate: bool = True,
    compat: bool = False,
    prefilter: bool = True,
    todo: str | None = None,
    **selection,
) -> DataFrame:
    """One row per finding: ``keys`` + type, category, value, context, line, …

    ``todo`` names a column with the places of the detectors to run on a row.

    ``selection`` is handed to ``select_detectors`` when ``detectors`` is not
    given.  ``deduplicate`` keeps the first match per (row, type, category,
    value).  ``compat`` cuts context at every Unicode line break, although line
    numbers count line feeds only.
    """
    chosen = select_detectors(**selection) if detectors is None else list(detectors)
    keys = list(keys)
    if not chosen:
        chosen_schema = texts.select(*keys).limit(0)
        return chosen_schema.selectExpr(
            *keys, "'' finding_type", "'' category", "'' value", "'' context", "1 line_number",
            "'' confidence", "'' severity", "'' pattern_name", "0 p_ord", "0 m_ord")
    out = None
    for start in range(0, len(chosen), DETECTORS_PER_PASS):
        part = _scan_pass(
            texts, keys, content, chosen[start:start + DETECTORS_PER_PASS], start,
            context_lines, deduplicate, compat, prefilter, todo)
        out = part if out is None else out.unionByName(part)
    labels = Counter((d.finding_type, d.category) for d in chosen)
    if deduplicate and max(labels.values()) > 1:
        # Two detectors share a label, so their findings can repeat each other.
        out = unique_findings(out, keys)
    return out


def unique_findings(findings: DataFrame, keys=("asset_key", "asset_url")) -> DataFrame:
    """First finding per (asset, type, category, value), by detector then position.

    A plain aggregate: it combines on the map side, so an asset or value that
    holds a large share of all rows does not end up in one task.
    """
    keys = list(keys)
    group = [*keys, "finding_type", "category", "value"]
    rest = [c for c in findings.columns if c not in (*group, "p_ord", "m_ord")]
    best = F.min(F.struct("p_ord", "m_ord", *rest)).alias("best")
    return findings.groupBy(*group).agg(best).select(
        *[(F.col(c) if c in group else F.col("best")[c].alias(c)) for c in findings.columns])


def scan_string_literals(texts: DataFrame, keys=("asset_key", "asset_url"), content="content", **options) -> DataFrame:
    """Scan only the string literals; line numbers count literals."""
    joined = texts.select(*keys, F.array_join(string_literals(F.col(content)), "\n").alias("__literals"))
    return scan_patterns(joined, keys, "__literals", **options)


def distinct_contents(texts: DataFrame, content: str = "content") -> DataFrame:
    """Hash-keyed texts, each once.  Copies are combined before the shuffle."""
    return (
        texts.filter(~is_blank(F.col(content)))
        .select(content_hash(F.col(content)).alias("content_hash"), F.col(content).alias("content"))
        .groupBy("content_hash").agg(F.first("content").alias("content"))
    )


def scan_once_per_hash(texts: DataFrame, keys=("asset_key", "asset_url"), content="content", **options) -> DataFrame:
    """Scan each distinct text once and hand its findings to all assets holding it.

    Worth the shuffle of the texts when copies are common; otherwise
    ``scan_patterns`` alone is cheaper.  The findings are stored before they meet
    the holders: joined straight from their aggregate they would have to stay where
    it put them, and a text held by a third of all assets would be one task's.
    """
    by_hash = scan_patterns(distinct_contents(texts, content), ("content_hash",), "content", **options)
    by_hash = staged(by_hash, shared_folder(texts.sparkSession, "findings-by-hash"))
    return to_holders(by_hash, texts, keys, content)


def to_holders(by_hash: DataFrame, texts: DataFrame, keys, content: str = "content") -> DataFrame:
    """Findings per content hash, handed to all assets that hold it.

    Both sides arrive from stored rows, so adaptive execution may split the rows of
    a hash among tasks.
    """
    holders = texts.select(*keys, content_hash(F.col(content)).alias("content_hash"))
    return holders.join(by_hash, "content_hash").drop("content_hash")
