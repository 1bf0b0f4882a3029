"""Column helpers for operators that stay within built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, though nested lambdas refer to it again and again."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """Words of a text that is not null."""
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def total(values: Column) -> Column:
    """Sum of an array of numbers, as long."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


#: Elements that one aggregate appends to an array; longer arrays are worked on in blocks of so many.
BLOCK = 256


def pieces(values: Column) -> Column:
    """An array cut into arrays of at most BLOCK elements; none for an empty array."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(BLOCK))
    return F.filter(F.transform(starts, lambda k: F.slice(values, k + 1, F.lit(BLOCK))), lambda x: F.size(x) > 0)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of longs what ``join`` (associative, such as + or greatest) makes of it and all before.
    An aggregate that appends copies its array each time, so it is used on blocks and on the ends of blocks."""
    none = F.expr("cast(array() as array<bigint>)")

    def within(block: Column) -> Column:
        add = lambda out, x: F.array_append(out, F.when(F.size(out) == 0, x).otherwise(join(F.element_at(out, -1), x)))
        return F.aggregate(block, none, add)

    def whole(parts: Column) -> Column:
        ends = within(F.transform(parts, lambda p: F.element_at(p, -1)))
        ahead = lambda e: F.flatten(F.transform(parts, lambda p, k: F.transform(p, lambda x: F.when(k == 0, x).otherwise(join(F.get(e, k - 1), x)))))
        return let(ends, ahead)

    return let(F.transform(pieces(values), within), whole)


def count_below(spots: Column, limit: Column, of: Callable[[Column], Column], or_equal: bool = False) -> Column:
    """How many elements of ``spots``, sorted by ``of``, have of(x) < limit (or <=): a binary search."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(31))))

    def step(at: Column, width: Column) -> Column:
        value = of(F.get(spots, at + width - 1))
        fits = (width <= F.size(spots) - at) & ((value <= limit) if or_equal else (value < limit))
        return F.when(fits, at + width).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)
