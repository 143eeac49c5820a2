"""Range aggregates, dense and sparse group-bys, mergeable states and other reductions.

Spark splits each into a partial aggregate on the map side, one exchange of partial states and a final aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltine.operators.predicates import between

#: Groups of a dense group-by.
DENSE = 256


def range_aggregate(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """count and sum of the values in [low, high); 0 and 0 where there are none."""
    inside = df.where(between(column, low, high))
    return inside.agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(F.col(column).cast("bigint")), F.lit(0).cast("bigint")).alias("sum"))


def group_dense(df: DataFrame, filter_column: str, value: str, group: str, low: int, high: int, groups: int = DENSE) -> DataFrame:
    """count, sum, min and max of a value for each of at most 256 groups with a row in [low, high).

    A group number outside 0 to ``groups`` - 1 fails the query.
    """
    if not 1 <= groups <= DENSE:
        raise ValueError(f"a dense group-by has 1 to {DENSE} groups")
    key = F.col(group)
    checked = F.when((key >= 0) & (key < groups), key).otherwise(F.raise_error(F.lit("a group number is out of range")))
    v = F.col(value)
    return (
        df.where(between(filter_column, low, high))
        .groupBy(checked.alias(group))
        .agg(F.count(F.lit(1)).alias("count"), F.sum(v.cast("bigint")).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"))
    )


def state(value: str) -> list[Column]:
    """The mergeable state of a nullable value: count, null_count, sum, min, max."""
    v = F.col(value)
    return [
        F.count(v).alias("count"),
        (F.count(F.lit(1)) - F.count(v)).alias("null_count"),
        F.coalesce(F.sum(v.cast("bigint")), F.lit(0).cast("bigint")).alias("sum"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    ]


def with_average(states: DataFrame) -> DataFrame:
    """States with ``average``, null where nothing was counted."""
    return states.withColumn("average", F.when(F.col("count") > 0, F.col("sum") / F.col("count")))


def group_sparse(df: DataFrame, key: str, value: str, filter_column: str | None = None, low: int = 0, high: int = 0) -> DataFrame:
    """The state and average of a nullable value per key, of all rows or those in [low, high) of another column."""
    rows = df if filter_column is None else df.where(between(filter_column, low, high))
    return with_average(rows.groupBy(key).agg(*state(value)))


def merge_states(states: DataFrame, *keys: str) -> DataFrame:
    """Stored states merged per key, as if their rows had been aggregated together."""
    merged = states.groupBy(*keys).agg(
        F.sum("count").alias("count"), F.sum("null_count").alias("null_count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max")
    )
    return with_average(merged)


def positional_popcount(df: DataFrame, column: str, bits: int = 32) -> DataFrame:
    """bit, ones: how many values have each bit set."""
    sums = df.agg(*[F.coalesce(F.sum(F.shiftright(F.col(column).cast("bigint"), b).bitwiseAND(F.lit(1))), F.lit(0).cast("bigint")).alias(f"b{b}") for b in range(bits)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.col(f"b{b}").alias("ones")) for b in range(bits)])).alias("x")).select("x.*")


def histogram(df: DataFrame, column: str, width: int) -> DataFrame:
    """bucket, count over buckets of equal width."""
    return df.groupBy(F.floor(F.col(column) / width).alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def reduce_words(df: DataFrame, key: str, word: str) -> DataFrame:
    """Per key the words of all shards combined by or, and, and sum."""
    return df.groupBy(key).agg(F.bit_or(word).alias("any"), F.bit_and(word).alias("every"), F.sum(word).alias("total"))


def extremes(df: DataFrame, column: str) -> DataFrame:
    """sum, min and max of a column that must have rows; an empty one fails the query."""
    c = F.col(column)
    found = df.agg(F.count(c).alias("n"), F.coalesce(F.sum(c.cast("bigint")), F.lit(0).cast("bigint")).alias("sum"), F.min(c).alias("min"), F.max(c).alias("max"))
    checked = lambda name: F.when(F.col("n") == 0, F.raise_error(F.lit("no value to take the least of"))).otherwise(F.col(name)).alias(name)
    return found.select("sum", checked("min"), checked("max"))


def same_values(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row, ``equal``: whether two keyed columns hold the same values at the same places."""
    left, right = a.select(key, F.col(value).alias("x")), b.select(key, F.col(value).alias("y"))
    both = left.withColumn("l", F.lit(1)).join(right.withColumn("r", F.lit(1)), key, "full")
    off = F.count_if(F.col("l").isNull() | F.col("r").isNull() | ~F.col("x").eqNullSafe(F.col("y")))
    return both.agg((off == 0).alias("equal"))
