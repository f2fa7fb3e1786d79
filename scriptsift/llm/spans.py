"""Places of pattern matches in a text, with DataFrame functions only.

Cut at its matches, a text gives pieces; lengths of pieces and matches add up to
the places, in code points.  The work is linear in the text; running sums are
taken in blocks, as growing one array by single elements is quadratic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import bind

SPAN = "struct<start:int,ord:int,end:int,kind:string,value:string,before:string,after:string>"
NONE = f"cast(array() as array<{SPAN}>)"
_BLOCK = 64


def _running(values: Column) -> Column:
    """Running sums by growing an array; for few values."""
    empty = F.expr("cast(array() as array<int>)")
    return F.aggregate(values, empty, lambda a, x: F.array_append(a, F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + x))


def running_sum(values: Column) -> Column:
    """Running sums of a non-empty array of integers."""
    def of(v):
        def joined(p):
            totals = _running(F.transform(p, lambda x: F.get(x, F.size(x) - 1)))
            return bind(totals, lambda t: F.flatten(F.transform(
                p, lambda x, i: F.transform(x, lambda y: y + F.coalesce(F.get(t, i - 1), F.lit(0))))))
        return F.when(F.size(v) <= _BLOCK, _running(v)).otherwise(bind(
            F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / F.lit(_BLOCK)).cast("int")),
                        lambda b: _running(F.slice(v, b * _BLOCK + 1, _BLOCK))), joined))
    return bind(values, of)


def matches(text: Column, kind: str, order: int, pattern: str, guard: Column | None = None, valid=None, context: int = 0) -> Column:
    """Array of spans of the leftmost non-overlapping matches that are ``valid``.

    ``guard`` is a cheap condition without which the pattern cannot match.
    ``context`` code points around a match are kept, up to its neighbours.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(values, pieces):
        steps = F.transform(values, lambda v, i: F.length(F.get(pieces, i)) + F.coalesce(F.length(F.get(values, i - 1)), F.lit(0)))

        def spans(starts):
            near = (lambda i: (F.right(F.get(pieces, i), F.lit(context)), F.left(F.get(pieces, i + 1), F.lit(context)))) if context else (
                lambda i: (F.lit(""), F.lit("")))
            return F.transform(values, lambda v, i: F.struct(
                F.get(starts, i).alias("start"), F.lit(order).alias("ord"),
                (F.get(starts, i) + F.length(v)).alias("end"), F.lit(kind).alias("kind"), v.alias("value"),
                near(i)[0].alias("before"), near(i)[1].alias("after")))
        return bind(running_sum(steps), spans)

    none = F.expr(NONE)
    all_ = bind(found, lambda values: F.when(F.size(values) == 0, none).otherwise(
        bind(F.split(text, pattern, -1), lambda pieces: placed(values, pieces))))
    kept = F.filter(all_, lambda s: valid(s["value"])) if valid else all_
    return F.when(guard, kept).otherwise(none) if guard is not None else kept


def in_order(*arrays: Column) -> Column:
    """Spans of several kinds by start, then kind as listed."""
    return F.array_sort(F.concat(*arrays))


def written(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def of_kinds(spans: Column, kinds) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
