"""Set algebra over distinct rows, its cardinalities, runs and dictionaries. A set is a one-column DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basaltine.operators.order import numbered


def _value(df: DataFrame) -> DataFrame:
    return df.toDF("value")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return _value(a).union(_value(b)).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return _value(a).intersect(_value(b))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return _value(a).subtract(_value(b))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Values in just one set: one aggregation over both."""
    both = _value(a).distinct().withColumn("side", F.lit(1)).union(_value(b).distinct().withColumn("side", F.lit(2)))
    return both.groupBy("value").agg(F.sum("side").alias("sides")).where("sides < 3").select("value")


def cardinalities(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: sizes of both, of and, or, xor, andnot, whether they intersect, and Jaccard (1 for two empty sets)."""
    both = _value(a).withColumn("l", F.lit(1)).withColumn("r", F.lit(0)).union(_value(b).withColumn("l", F.lit(0)).withColumn("r", F.lit(1)))
    sides = both.groupBy("value").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    n = sides.agg(F.count_if(F.col("l") == 1).alias("left_size"), F.count_if(F.col("r") == 1).alias("right_size"), F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("and_size"), F.count(F.lit(1)).alias("or_size"))
    return n.select(
        "*",
        (F.col("or_size") - F.col("and_size")).alias("xor_size"),
        (F.col("left_size") - F.col("and_size")).alias("andnot_size"),
        (F.col("and_size") > 0).alias("intersects"),
        F.when(F.col("or_size") == 0, F.lit(1.0)).otherwise(F.col("and_size") / F.nullif(F.col("or_size"), F.lit(0))).alias("jaccard"),
    )


def pair_intersections(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """sets (set_id, value), pairs (pair_id, left_id, right_id) to pair_id, size of the intersection."""
    left = sets.select(F.col("set_id").alias("left_id"), "value")
    right = sets.select(F.col("set_id").alias("right_id"), "value")
    common = pairs.join(left, "left_id").join(right, ["right_id", "value"]).groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.select("pair_id").join(common, "pair_id", "left").select("pair_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("size"))


def words(a: DataFrame) -> DataFrame:
    """word, bits: the set as 32-bit words."""
    v = _value(a)
    bit = F.expr("shiftleft(1L, cast(value % 32 as int))")
    return v.groupBy(F.floor(F.col("value") / 32).alias("word")).agg(F.bit_or(bit).alias("bits"))


def bitmaps(a: DataFrame) -> DataFrame:
    """bucket, bitmap: the set in compressed chunks, mergeable by ``bitmap_or_agg``."""
    v = _value(a)
    return v.groupBy(F.bitmap_bucket_number("value").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("value")).alias("bitmap"))


def ranges(a: DataFrame, span: int = 1 << 20) -> DataFrame:
    """Maximal runs of consecutive values, both ends included.

    Runs are found within spans of the domain, each a window of its own, and then joined at the spans' edges: the
    second step sees as many rows as there are runs.
    """
    v = _value(a).distinct().withColumn("span", F.floor(F.col("value") / span))
    order = Window.partitionBy("span").orderBy("value")
    runs = v.withColumn("run", F.col("value") - F.row_number().over(order)).groupBy("span", "run").agg(F.min("value").alias("first"), F.max("value").alias("last"))
    # runs that touch an edge of their span are chained; the others are whole
    touches = (F.col("first") == F.col("span") * span) | (F.col("last") == (F.col("span") + 1) * span - 1)
    whole, edge = runs.where(~touches).select("first", "last"), runs.where(touches)
    chain = Window.orderBy("first")  # at most two rows a span
    starts = edge.withColumn("new", (F.col("first") != F.coalesce(F.lag("last").over(chain) + 1, F.lit(None))).cast("int"))
    chained = starts.withColumn("chain", F.sum(F.coalesce("new", F.lit(1))).over(chain.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = chained.groupBy("chain").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("first", "last")
    return whole.union(joined)


def dictionary(a: DataFrame) -> DataFrame:
    """Each distinct value with a dense id in the order of the values, null last."""
    return numbered(_value(a).distinct(), "value", name="id")


def frozen_dictionary(a: DataFrame) -> DataFrame:
    """As ``dictionary``, of keys that must be distinct: a repeated key fails the query."""
    once = _value(a).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    once = once.select(F.when(F.col("n") > 1, F.raise_error(F.lit("a key is repeated"))).otherwise(F.col("value")).alias("value"))
    return numbered(once, "value", name="id")


def encode(values: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows with the id of their value, -1 for values that the dictionary lacks."""
    return values.join(ids.withColumnRenamed("value", column), column, "left").withColumn("id", F.coalesce("id", F.lit(-1).cast("bigint")))
