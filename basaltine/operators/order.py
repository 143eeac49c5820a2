"""Stable orders, places in them, and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basaltine.sources.scratch import saved


def numbered(df: DataFrame, *by: str, name: str = "position") -> DataFrame:
    """``df`` with its rows' places (from 0) in the order of some columns, nulls last, without one sorting task.

    The rows are range-partitioned and sorted, numbered within their partitions and written; then each partition's
    numbers go up by the rows of those before it. Rows that tie in all columns are ordered arbitrarily.
    """
    keys = [F.col(c).asc_nulls_last() for c in by]
    local = F.monotonically_increasing_id()
    row = F.struct(*[df[c] for c in df.columns]).alias("d")
    parts = saved(df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(row, F.shiftright(local, 33).alias("part"), local.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    before = rows_before(parts)
    return parts.join(before, "part").select("d.*", (F.col("before") + F.col("at")).alias(name))


def rows_before(parts: DataFrame, weight: Column | None = None) -> DataFrame:
    """part, before, n: the rows (or their weight) of each partition and of all before it; a row per partition."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.groupBy("part").agg(n.alias("n")).select("part", "n", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))


def _no_nulls(key: str) -> Column:
    return F.when(F.col(key).isNull(), F.raise_error(F.lit("an order key is null"))).otherwise(F.col(key))


def stable_order(df: DataFrame, key: str, row_id: str) -> DataFrame:
    """The rows by key, equal keys by row id: a range-partitioned sort, the id is what makes it stable.

    A null key fails the query: orders are of non-nullable keys.
    """
    return df.select(_no_nulls(key).alias(key), F.col(row_id).alias("row_id")).orderBy(key, "row_id")


def order_positions(df: DataFrame, key: str, row_id: str, within: str | None = None) -> DataFrame:
    """Each row's place (from 0) in the stable order, within groups or overall (see ``numbered``)."""
    if within is None:
        return numbered(df.select(_no_nulls(key).alias(key), F.col(row_id).alias("row_id")), key, "row_id")
    window = Window.partitionBy(within).orderBy(key, row_id)
    return df.select(within, key, F.col(row_id).alias("row_id"), (F.row_number().over(window) - 1).cast("bigint").alias("position"))


def top_k(df: DataFrame, score: Column, row_id: str, k: int, largest: bool = False) -> DataFrame:
    """The k rows of smallest (or largest) score, ties by row id: every task keeps k rows, one merges them."""
    scored = df.withColumn("score", score)
    return scored.orderBy(F.desc("score") if largest else F.asc("score"), row_id).limit(k)


def top_k_per_group(df: DataFrame, group: str, score: str, row_id: str, k: int, largest: bool = False) -> DataFrame:
    """The k first rows of every group with their rank; Spark keeps k rows a group on the map side."""
    order = Window.partitionBy(group).orderBy(F.desc(score) if largest else F.asc(score), row_id)
    return df.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def in_priority(df: DataFrame, priority: str, row_id: str, taken: int = 0) -> DataFrame:
    """What a priority queue holds after its ``taken`` first rows have left it: the rest, with their places."""
    return numbered(df, priority, row_id).where(F.col("position") >= taken)
