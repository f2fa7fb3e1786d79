"""SQL building blocks of the oracles."""

from __future__ import annotations

from scriptsift.operators.catalog import builtin_detectors

# Detectors with look-around, rewritten for an engine without it: neighbours are
# consumed and the value is taken from a group, or rows are filtered afterwards.
REWRITTEN = {
    "aws_access_key": (r"(?:^|[^A-Z0-9])(AKIA[0-9A-Z]{16})(?:[^A-Z0-9]|$)", 1, None),
    "ip_address": (
        r"(?:^|[^0-9])(10\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|172\.(?:1[6-9]|2[0-9]|3[01])\.[0-9]{1,3}\.[0-9]{1,3}"
        r"|192\.168\.[0-9]{1,3}\.[0-9]{1,3})(?:[^0-9]|$)", 1, None),
    "eval_call": (r"(?:^|[^a-zA-Z])(eval\s*\()", 1, None),
    "script_src_assign": (r"\.src\s*=\s*", 0, None),
    "full_url": (
        r"""https?://[a-zA-Z0-9\-._]+\.[a-zA-Z]{2,}(?:/[^\s"'<>]*)?""", 0,
        r"NOT regexp_matches(v, '^https?://(cdn|static|fonts|images)\.')"),
    "missing_origin_check": (
        r"""addEventListener\s*\(\s*["']message["']\s*,\s*(?:function|\w+)\s*\([^)]*\)\s*\{[^\n]{0,200}\}""", 0,
        "NOT contains(v, '.origin')"),
}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def detector_arm(d, source: str, columns: str, text: str) -> str:
    """All matches of one detector over ``source``, one row each."""
    rx, group, keep = REWRITTEN.get(d.name, (d.regex, d.value_group, None))
    rows = (
        f"SELECT {columns}, trim(unnest(regexp_extract_all({text}, {lit(rx)}, {group})), chr(32)||chr(9)||chr(10)) AS v FROM {source}")
    where = " AND ".join(["length(v) >= 3"] + ([keep] if keep else []))
    return (
        f"SELECT *, {lit(d.finding_type)} AS finding_type, {lit(d.category)} AS category, "
        f"{lit(d.severity)} AS severity, {lit(d.confidence)} AS confidence, {lit(d.name)} AS pattern_name "
        f"FROM ({rows}) WHERE {where}")


def matches_by_line(source: str, keys: str, detectors=None, content: str = "content") -> str:
    """CTE list: ``m`` has every match with its line, detector by detector.

    Works line by line, unlike the engine, which scans whole texts.
    """
    arms = " UNION ALL ".join(
        detector_arm(d, "l", f"{keys}, n", "line") for d in (detectors or builtin_detectors()))
    return (
        f"t AS MATERIALIZED (SELECT {keys}, string_split({content}, chr(10)) AS lines FROM {source}), "
        f"l AS MATERIALIZED (SELECT {keys}, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS n FROM t), "
        f"m AS ({arms})")


def findings_by_line(source: str, keys: str, detectors=None, content: str = "content") -> str:
    """CTE list ending in ``f``: first match per key, type, category and value."""
    return (
        matches_by_line(source, keys, detectors, content)
        + f", f AS (SELECT {keys}, finding_type, category, v AS value, severity, confidence, pattern_name, "
        f"cast(min(n) as int) AS line_number FROM m "
        f"GROUP BY {keys}, finding_type, category, v, severity, confidence, pattern_name)")


def matches_in_text(source: str, keys: str, detectors=None, content: str = "content") -> str:
    """CTE list: ``m`` has every match in whole texts, without lines."""
    arms = " UNION ALL ".join(
        detector_arm(d, source, keys, content) for d in (detectors or builtin_detectors()))
    return f"m AS ({arms})"


RANK = ("CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END")

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: str, i: int) -> str:
    got = f"regexp_extract({url}, {lit(_URL)}, {i}, 's')"
    return f"lower({got})" if i == 1 else got


def origin(url: str) -> str:
    return f"concat({part(url, 1)}, '://', {part(url, 2)})"


def join_url(source: str, base: str, ref: str, out: str, keep: str) -> str:
    """Subquery: ``source`` plus ``out``, the reference resolved by RFC 3986.

    ``keep`` lists the columns to carry.
    """
    fields = ", ".join(
        f"{part(c, i)} AS {p}{n}" for p, c in (("b", "b0"), ("r", "r0"))
        for i, n in ((1, "s"), (2, "n"), (3, "p"), (4, "q"), (5, "f")))
    return f"""(
SELECT {keep}, CASE
  WHEN r00 = '' THEN b0
  WHEN rs <> '' AND rs <> bs THEN r00
  WHEN rn <> '' THEN concat(bs, '://', rn, rp, CASE WHEN rq <> '' THEN '?'||rq ELSE '' END, CASE WHEN rf <> '' THEN '#'||rf ELSE '' END)
  WHEN rp = '' THEN concat(bs, '://', bn, bp, CASE WHEN rq <> '' THEN '?'||rq WHEN bq <> '' THEN '?'||bq ELSE '' END, CASE WHEN rf <> '' THEN '#'||rf ELSE '' END)
  ELSE concat(bs, '://', bn, CASE WHEN path LIKE '/%' THEN path ELSE '/'||path END, CASE WHEN rq <> '' THEN '?'||rq ELSE '' END, CASE WHEN rf <> '' THEN '#'||rf ELSE '' END)
  END AS {out}
FROM (SELECT *, CASE WHEN list_reduce(list_prepend('', kept), lambda a, s: CASE WHEN s = '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN s = '.' THEN a ELSE a || '/' || s END) IN ('', '/') AND segs[-1] NOT IN ('.', '..')
        THEN '/' ELSE substr(list_reduce(list_prepend('', kept), lambda a, s: CASE WHEN s = '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN s = '.' THEN a ELSE a || '/' || s END)
          || CASE WHEN segs[-1] IN ('.', '..') THEN '/' ELSE '' END, 2) END AS path
  FROM (SELECT *, CASE WHEN rp LIKE '/%' THEN segs ELSE list_filter(segs, lambda x, i: x <> '' OR i = 1 OR i = len(segs)) END AS kept
    FROM (SELECT *, string_split(CASE WHEN rp LIKE '/%' THEN rp WHEN bp = '' THEN '/'||rp ELSE regexp_replace(bp, '[^/]*$', '')||rp END, '/') AS segs
      FROM (SELECT *, {fields} FROM (SELECT *, {base} AS b0, {ref} AS r00, ltrim({ref}) AS r0 FROM {source}))))))"""


def resolve_url(source: str, base: str, ref: str, out: str, keep: str) -> str:
    """Subquery like ``join_url`` with the shortcuts for absolute references."""
    inner = join_url(source, base, f"trim({ref})", "joined", f"{keep}, {base} AS b9, {ref} AS r9")
    return f"""(
SELECT {keep}, CASE WHEN r9 IS NULL OR r9 = '' THEN NULL
  WHEN trim(r9) LIKE '//%' THEN concat({part('b9', 1)}, ':', trim(r9))
  WHEN trim(r9) LIKE 'http://%' OR trim(r9) LIKE 'https://%' THEN trim(r9) ELSE joined END AS {out}
FROM {inner})"""
