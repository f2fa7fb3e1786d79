"""Text columns: trimming, lines, minification, display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bind

# White space as the detectors understand it: Unicode white space plus the four
# ASCII separators, which the JVM leaves out of \s.
SPACE = r"[\s\x1c-\x1f]"
EDGE_SPACE = rf"(?U)\A{SPACE}+|{SPACE}+\z"
_BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
_ANY_BREAK = rf"\r\n|[{_BREAKS}]"
# Blank lines between two lines, and before the first or behind the last one.
_BLANK_LINES = rf"(?U)[{_BREAKS}]{SPACE}*[{_BREAKS}]"
_BLANK_ENDS = rf"(?U)\A{SPACE}*[{_BREAKS}]|[{_BREAKS}]{SPACE}*\z"
MINIFIED_MEAN_LINE = 200

# Text caps of the stored columns, in characters.
CAPS = {
    "content": 1_000_000,
    "beautified_content": 1_000_000,
    "source_mapped_content": 2_000_000,
    "inline_content": 500_000,
    "value": 500,
    "context": 1000,
}


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_SPACE, "")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)[^\s\x1c-\x1f]")


def any_lines(text: Column) -> Column:
    """Lines at every kind of line break; a final break opens no new line."""
    lines = F.split(text, _ANY_BREAK, -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def is_minified(text: Column) -> Column:
    """True when the non-blank lines are longer than 200 characters on average."""
    full = F.regexp_replace(F.regexp_replace(text, _BLANK_LINES, "\n"), _BLANK_ENDS, "")

    def wide(t):
        breaks = F.length(t) - F.length(F.regexp_replace(t, f"[{_BREAKS}]", ""))
        return bind(breaks, lambda n: F.length(t) - n > (n + 1) * MINIFIED_MEAN_LINE)
    return F.coalesce(~is_blank(text) & bind(full, wide), F.lit(False))


def cap(text: Column, field: str) -> Column:
    return F.substring(text, 1, CAPS[field])


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def first_non_empty(*texts: Column) -> Column:
    """The first text with any character; each is computed once, and only if needed."""
    return F.coalesce(*[bind(t, lambda v: F.when(v != "", v)) for t in texts])


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def redact(value: Column) -> Column:
    """Keep four characters and a digest prefix, for exports that leave the team."""
    return F.concat(F.substring(value, 1, 4), F.lit("~"), F.substring(F.sha2(value, 256), 1, 12))


def safe_filename(url: Column) -> Column:
    """One flat file name for a URL, at most 200 characters.

    A longer name ends in a digest of its URL, so two URLs do not share it.
    """
    name = url
    for piece in ("://", "/", "?", "&"):
        name = F.replace(name, F.lit(piece), F.lit("_"))
    flat = F.regexp_replace(name, r'[<>:"|*\x00-\x1f]', "_")
    cut = F.concat(F.substring(flat, 1, 183), F.lit("_"), F.substring(F.sha2(url, 256), 1, 16))
    return bind(flat, lambda f: F.when(F.length(f) > 200, cut).otherwise(f))


def safe_path(name: Column) -> Column:
    """A relative path without reserved characters; slashes stay."""
    return F.regexp_replace(name, r'[<>:"|?*\x00-\x1f]', "_")
