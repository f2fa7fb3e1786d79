"""One statement per line for minified scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import bind, running
from ..functions.text import first_non_empty, is_minified

# Comments and strings pass through whole; the loops are possessive.
_PIECES = (
    r"(?s)/\*.*?(?:\*/|\z)|//[^\n]*"
    r"""|"(?:[^"\\]|\\.)*+(?:"|\\?\z)|'(?:[^'\\]|\\.)*+(?:'|\\?\z)|`(?:[^`\\]|\\.)*+(?:`|\\?\z)"""
    r"|[{};,]|[^{};,\"'`/]+|."
)


INDENT = "  "


def _pieces(script: Column) -> Column:
    return F.regexp_extract_all(script, F.lit(_PIECES), F.lit(0))


def reflow(script: Column) -> Column:
    """Break after ``{``, ``;`` and ``,`` and before ``}``, outside strings and
    comments, so that line numbers and context mean something."""
    pieces = _pieces(script)
    return F.array_join(F.transform(pieces, lambda p: (
        F.when(p.isin("{", ";", ","), F.concat(p, F.lit("\n")))
        .when(p == "}", F.lit("\n}"))
        .otherwise(p))), "")


def _depths(pieces: Column) -> Column:
    """How many braces are open behind each piece.

    Running sums of +1 and -1; a closing brace without an opening one counts for
    nothing, so what the sums have fallen below zero so far is taken off again.
    """
    steps = F.transform(pieces, lambda p: F.when(p == "{", 1).when(p == "}", -1).otherwise(0))

    def lifted(sums):
        lowest = running(F.transform(sums, lambda s: F.least(s, F.lit(0))), F.least)
        return bind(lowest, lambda low: F.transform(sums, lambda s, i: s - F.get(low, i)))
    return bind(running(steps, lambda a, b: a + b), lifted)


def max_depth(script: Column) -> Column:
    """The most braces open at a time, outside strings and comments; 0 without text."""
    return F.coalesce(F.array_max(_depths(_pieces(script))), F.lit(0))


def reflow_indented(script: Column, indent: str = INDENT) -> Column:
    """``reflow`` with every new line indented by the braces open there."""
    def of(pieces):
        def shown(depths):
            def line(i):
                return F.concat(F.lit("\n"), F.repeat(F.lit(indent), F.get(depths, i)))
            return F.array_join(F.transform(pieces, lambda p, i: (
                F.when(p.isin("{", ";", ","), F.concat(p, line(i))).when(p == "}", F.concat(line(i), p)).otherwise(p))), "")
        return bind(_depths(pieces), shown)
    return bind(_pieces(script), of)


def reflow_minified(script: Column, indented: bool = False) -> Column:
    """The reflowed text of a minified script, null for any other."""
    return F.when(is_minified(script), reflow_indented(script) if indented else reflow(script))


def best_content(source_mapped: Column, reflowed: Column, raw: Column) -> Column:
    return first_non_empty(source_mapped, reflowed, raw)
