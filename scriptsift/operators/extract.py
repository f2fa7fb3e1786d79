"""Row-local extractors: string literals, endpoints, host names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# Escape-aware literals.  The loops are possessive: a closing quote can never be
# part of what the loop took, and a long literal costs no stack.
_LITERALS = (
    r"(?d)'((?:[^'\\]|\\.)*+)'",
    r'(?d)"((?:[^"\\]|\\.)*+)"',
    r"(?d)`((?:[^`\\]|\\.)*+)`",
)


def string_literals(text: Column) -> Column:
    """Trimmed, non-blank literals: all single-quoted, then double-quoted, then
    template literals, each in text order; repeats stay."""
    raw = F.concat(*[F.regexp_extract_all(text, F.lit(rx), F.lit(1)) for rx in _LITERALS])
    return F.filter(F.transform(raw, strip), lambda s: s != "")


def extract_literals(texts: DataFrame, keys=("asset_key",), content="content") -> DataFrame:
    return texts.select(*keys, F.posexplode(string_literals(F.col(content))).alias("pos", "literal"))


# What counts as an endpoint or a host name in a script.
_ABSOLUTE = r"""(?U)https?://[^\s\x1c-\x1f"'<>`,]{5,}"""
_ROOT_PATH = r"""["'](/[a-zA-Z0-9_\-/.:{}\[\]?=&%]+)["']"""
_CALL = (
    r"""(?U)(?:fetch|axios(?:\.\w+)?|XMLHttpRequest|http(?:Client)?\.(?:get|post|put|delete|patch))"""
    r"""[\s\x1c-\x1f]*\([\s\x1c-\x1f]*["`]([^"'`]{4,})["`]"""
)
_LABEL = r"[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?(?![a-zA-Z0-9\-])"
_HOST = (
    rf"""(?dmU)(?:^|["'\s\x1c-\x1f(=])({_LABEL}(?:\.{_LABEL})*+(?:\.[a-zA-Z]{{2,}})?+)(?=["'\s\x1c-\x1f),;]|$)"""
)
ASSET_SUFFIXES = (".js", ".css", ".png", ".jpg", ".gif")


def endpoints(text: Column) -> Column:
    """Sorted distinct absolute URLs, quoted root paths and call arguments."""
    absolute = F.transform(
        F.regexp_extract_all(text, F.lit(_ABSOLUTE), F.lit(0)), lambda u: F.regexp_replace(u, r"""[.,;)'"]+\z""", ""))
    paths = F.filter(
        F.regexp_extract_all(text, F.lit(_ROOT_PATH), F.lit(1)),
        lambda p: (F.length(p) >= 4) & ~p.startswith("//") & ~p.startswith("/*"))
    calls = F.regexp_extract_all(text, F.lit(_CALL), F.lit(1))
    return F.array_sort(F.array_union(F.array_union(absolute, paths), calls))


def extract_endpoints(texts: DataFrame, keys=("asset_key",), content="content") -> DataFrame:
    return texts.select(*keys, F.explode(endpoints(F.col(content))).alias("endpoint"))


def hostnames(text: Column) -> Column:
    """Sorted distinct lower-case host names, file names excluded."""
    # The expression takes a whole dotted run; a run whose last label is not a
    # top-level domain is dropped afterwards, so the loop need not backtrack.
    runs = F.filter(
        F.regexp_extract_all(text, F.lit(_HOST), F.lit(1)), lambda h: h.rlike(r"\.[a-zA-Z]{2,}\z"))
    hosts = F.transform(runs, lambda h: F.lower(h))
    files = "(?:" + "|".join(s.replace(".", r"\.") for s in ASSET_SUFFIXES) + r")\z"
    return F.array_sort(F.array_distinct(F.filter(hosts, lambda h: ~h.rlike(files))))


def extract_hostnames(texts: DataFrame, keys=("asset_key",), content="content") -> DataFrame:
    return texts.select(*keys, F.explode(hostnames(F.col(content))).alias("hostname"))
