"""Predicates and masks. Ranges are half-open; a mask is two-valued, so null counts as false before any algebra."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltine.schema import ColumnDef


def _wide(value: int | str | Column) -> Column:
    if isinstance(value, Column):
        return value
    # literals outside a column's domain compare as they are, so they are never cast down to its type
    return F.lit(value).cast("bigint") if isinstance(value, int) else F.lit(value)


def check_literal(column: ColumnDef, *values: int | str) -> None:
    """Numbers for numeric columns (integers that doubles can hold), strings for string columns."""
    for v in values:
        if column.kind == "string":
            if not isinstance(v, str):
                raise TypeError("a string column is compared with strings")
        elif isinstance(v, bool) or not isinstance(v, int) or abs(v) > (1 << 53) - 1:
            raise TypeError("a numeric column is compared with safe integers")


def eq(column: str, value: int | str) -> Column:
    return F.col(column) == _wide(value)


def lt(column: str, value: int | str) -> Column:
    return F.col(column) < _wide(value)


def between(column: str, low: int | str | Column, high: int | str | Column) -> Column:
    """low <= value < high; nothing where low >= high. Bounds of other types are literals of the column's own."""
    if not isinstance(low, Column) and low >= high:
        return F.lit(False)
    return (F.col(column) >= _wide(low)) & (F.col(column) < _wide(high))


def between_inclusive(column: str, low: int, high: int) -> Column:
    """low <= value <= high, as the bit-sliced column has it."""
    return F.col(column).between(_wide(low), _wide(high))


def mask(predicate: Column) -> Column:
    """A predicate as a two-valued mask."""
    return F.coalesce(predicate, F.lit(False))


def all_of(*masks: Column) -> Column:
    return reduce(lambda a, b: a & b, map(mask, masks), F.lit(True))


def any_of(*masks: Column) -> Column:
    return reduce(lambda a, b: a | b, map(mask, masks), F.lit(False))


def and_not(a: Column, b: Column) -> Column:
    return mask(a) & ~mask(b)


def invert(a: Column) -> Column:
    return ~mask(a)


def positions(df: DataFrame, predicate: Column, row_id: str) -> DataFrame:
    """The row ids that a mask selects."""
    return df.where(predicate).select(row_id)


def select_measures(df: DataFrame, ranges: dict[str, tuple[int, int]], measures: list[str]) -> DataFrame:
    """count, sum, min and max of several measures under one selection by ranges; no ranges: all rows."""
    chosen = df
    for c, (a, b) in ranges.items():
        chosen = chosen.where(between(c, a, b))
    per = [f(F.col(m)).alias(f"{n}_{m}") for m in measures for n, f in (("count", F.count), ("sum", lambda c: F.coalesce(F.sum(c), F.lit(0))), ("min", F.min), ("max", F.max))]
    return chosen.agg(*per)
