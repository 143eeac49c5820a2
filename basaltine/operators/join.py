"""Joins of row ids and lookups. Sides are broadcast only where Spark finds them small; hot keys are left to AQE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_id_pairs(probe: DataFrame, build: DataFrame, key: str, probe_id: str, build_id: str) -> DataFrame:
    """All pairs (probe_row_id, build_row_id) with one key; nulls match nothing."""
    left = probe.select(key, F.col(probe_id).alias("probe_row_id"))
    right = build.select(key, F.col(build_id).alias("build_row_id"))
    return left.join(right, key).select("probe_row_id", "build_row_id")


def capped_pairs(pairs: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame]:
    """The first ``capacity`` pairs in probe-major, then build order; and match_count, written, truncated."""
    written = pairs.orderBy("probe_row_id", "build_row_id").limit(capacity)
    facts = pairs.agg(F.count(F.lit(1)).alias("match_count"))
    facts = facts.select("match_count", F.least("match_count", F.lit(capacity)).alias("written"), (F.col("match_count") > capacity).alias("truncated"))
    return written, facts


def match_count(probe: DataFrame, build: DataFrame, key: str) -> DataFrame:
    """How many pairs the join has, without making them: the keys of both sides are counted first."""
    a = probe.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("a"))
    b = build.groupBy(key).agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, key).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0).cast("bigint")).alias("match_count"))


def build_facts(build: DataFrame, key: str) -> DataFrame:
    """build_rows and distinct_keys of a build side."""
    counts = build.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("build_rows"), F.count(key).alias("distinct_keys"))


def lookup(probe: DataFrame, mapping: DataFrame, key: str, value: str) -> DataFrame:
    """Every probe row with the value of its key and whether there is one; a key that the mapping repeats fails the query."""
    once = mapping.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.first(value).alias(value))
    known = once.select(key, F.when(F.col("__n") > 1, F.raise_error(F.lit("a key of the mapping is repeated"))).otherwise(F.col(value)).alias(value), F.lit(True).alias("present"))
    return probe.join(known, key, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def gather(rows: DataFrame, row_ids: DataFrame, column: str, zero: int | str = 0) -> DataFrame:
    """row_ids (place, row_id) to place, value, valid: the values at rows in the order asked; null gives ``zero`` and 0."""
    found = row_ids.join(rows.select("row_id", F.col(column).alias("value"), F.lit(True).alias("there")), "row_id", "left")
    checked = F.when(F.col("there").isNull(), F.raise_error(F.lit("a row id is out of range"))).otherwise(F.col("value"))
    return found.select("place", F.coalesce(checked, F.lit(zero)).alias("value"), F.col("value").isNotNull().cast("int").alias("valid"))


def point(rows: DataFrame, row_id: int, *columns: str) -> DataFrame:
    """The row of one id, or none; the id is a filter that reaches the scan."""
    return rows.where(F.col("row_id") == row_id).select(*columns)


def equals_many(table: DataFrame, queries: DataFrame) -> DataFrame:
    """table (id, value), queries (query, id, value) to query, equal: whether the entry of an id has a value."""
    known = table.select("id", F.col("value").alias("entry"))
    return queries.join(known, "id", "left").select("query", F.coalesce(F.col("entry") == F.col("value"), F.lit(False)).alias("equal"))


def members(probe: DataFrame, keys: DataFrame, key: str, absent: bool = False) -> DataFrame:
    """The probe rows whose key is in (or, with ``absent``, not in) a set."""
    return probe.join(keys.select(key), key, "left_anti" if absent else "left_semi")


def marked(probe: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Every probe row with whether its key is in a set."""
    known = keys.select(key).distinct().withColumn("present", F.lit(True))
    return probe.join(known, key, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def upsert(base: DataFrame, changes: DataFrame, key: str, value: str, sequence: str) -> DataFrame:
    """A map after changes in order: the last value of a key wins, a null value deletes it."""
    rows = base.select(key, value, F.lit(None).cast("bigint").alias(sequence)).unionByName(changes.select(key, value, F.col(sequence).cast("bigint")))
    last = rows.groupBy(key).agg(F.max_by(F.struct(value), F.struct(F.col(sequence).isNotNull().alias("changed"), sequence)).alias("last"))
    return last.select(key, F.col(f"last.{value}").alias(value)).where(F.col(value).isNotNull())


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Each left row with the latest right value at or before it within its key (beyond the inventory).

    One exchange and one window over both sides; no pairs are made.
    """
    a = left.withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__left", F.lit(1))
    b = right.select(by, at, F.col(value).alias("__v")).withColumn("__left", F.lit(0))
    order = Window.partitionBy(by).orderBy(at, "__left").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(f"{value}_as_of", F.last("__v", ignorenulls=True).over(order))
    return both.where("__left = 1").drop("__v", "__left")


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points with the spans [start, end) that hold them, by way of buckets of a width (beyond the inventory)."""
    p = points.withColumn("__bucket", F.floor(F.col(at) / width))
    s = spans.where(F.col(start) < F.col(end)).withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    inside: Column = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    return p.join(s, "__bucket").where(inside).drop("__bucket")
