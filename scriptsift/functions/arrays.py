"""Array helpers built on higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a variable.

    Without this a sub-expression used inside a lambda is evaluated again for
    every element.
    """
    return F.transform(F.array(value), body).getItem(0)


def first_by_key(items: Column, key: str) -> Column:
    """Drop array elements whose ``key`` field occurred before, keeping order.

    Sorts by (key, position), so it costs n log n where a nested search would
    be quadratic in the array length.
    """
    def dedupe(all_items):
        indexed = F.transform(all_items, lambda x, i: F.struct(x[key].alias("k"), i.alias("i"), x.alias("x")))
        firsts = bind(
            F.sort_array(indexed),
            lambda s: F.filter(s, lambda e, j: (j == 0) | ~e["k"].eqNullSafe(F.get(s, j - 1)["k"])),
        )
        by_position = F.sort_array(F.transform(firsts, lambda e: F.struct(e["i"], e["x"])))
        return F.transform(by_position, lambda e: e["x"])

    return bind(items, lambda all_items: F.when(F.size(all_items) < 2, all_items).otherwise(dedupe(all_items)))



def with_known(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column and drop the rows where it is null, computing it once.

    A filter on a computed column is pushed below the projection, which makes
    an expensive expression run twice; a generator stops that.
    """
    return rows.select("*", F.explode(F.array_compact(F.array(value))).alias(name))


# Values whose running totals are built by growing an array.
_BLOCK = 64


def _grown(values: Column, merge) -> Column:
    empty = F.expr("cast(array() as array<int>)")
    return F.aggregate(values, empty, lambda a, x: F.array_append(
        a, F.when(F.size(a) == 0, x).otherwise(merge(F.get(a, F.size(a) - 1), x))))


def running(values: Column, merge, levels: int = 3) -> Column:
    """Running totals of an array of integers under an associative ``merge``, such as a sum or a minimum.

    Growing an array by single elements is quadratic, so totals are built in blocks,
    and the totals of the blocks in blocks again.
    """
    def of(v):
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(v) - 1) / F.lit(_BLOCK)).cast("int")),
            lambda b: _grown(F.slice(v, b * _BLOCK + 1, _BLOCK), merge))

        def joined(found):
            ends = F.transform(found, lambda x: F.element_at(x, -1))
            before = running(ends, merge, levels - 1) if levels > 1 else _grown(ends, merge)
            return bind(before, lambda t: F.flatten(F.transform(found, lambda x, i: F.when(i == 0, x).otherwise(
                F.transform(x, lambda y: merge(F.get(t, i - 1), y))))))
        return F.when(F.size(v) <= _BLOCK, _grown(v, merge)).otherwise(bind(blocks, joined))
    return bind(values, of)
