"""Matrices as coordinates (b, i, j, v): dense, batched, Boolean and sparse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product per batch: a join on the inner index, summed with a map-side combine."""
    left = a.select("b", "i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select("b", F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, ["b", "k"]).groupBy("b", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("b", "i", "j").agg(F.sum("v").alias("v"))


def scale(a: DataFrame, factor: float) -> DataFrame:
    return a.withColumn("v", F.col("v") * factor)


def transpose(a: DataFrame) -> DataFrame:
    return a.select("b", F.col("j").alias("i"), F.col("i").alias("j"), "v")


def gemm(a: DataFrame, b: DataFrame, c: DataFrame | None = None, alpha: float = 1.0, beta: float = 0.0, bias: DataFrame | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """clamp(alpha A B + beta C + bias): ``bias`` (j, w) is added to each column; low 0 makes it a rectifier."""
    out = scale(multiply(a, b), alpha)
    if c is not None:
        out = add(out, scale(c, beta))
    if bias is not None:
        out = out.join(bias, "j", "left").select("b", "i", "j", (F.col("v") + F.coalesce("w", F.lit(0.0))).alias("v"))
    value = F.col("v")
    if low is not None:
        value = F.greatest(value, F.lit(float(low)))
    if high is not None:
        value = F.least(value, F.lit(float(high)))
    return out.withColumn("v", value)


def boolean(a: DataFrame) -> DataFrame:
    """The set cells (i, j) of a Boolean matrix, each once."""
    return a.select("i", "j").distinct()


def boolean_multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product over or and and."""
    return a.select("i", F.col("j").alias("k")).join(b.select(F.col("i").alias("k"), "j"), "k").select("i", "j").distinct()


def get(a: DataFrame, i: int, j: int, b: int = 0) -> DataFrame:
    """v: one cell, 0 where it is not stored."""
    return a.where((F.col("b") == b) & (F.col("i") == i) & (F.col("j") == j)).agg(F.coalesce(F.max("v"), F.lit(0)).alias("v"))


def with_cells(a: DataFrame, cells: DataFrame) -> DataFrame:
    """The matrix with some cells set to new values; where a cell is set, its old value goes."""
    both = a.select("b", "i", "j", "v", F.lit(0).alias("n")).unionByName(cells.select("b", "i", "j", "v", F.lit(1).alias("n")))
    return both.groupBy("b", "i", "j").agg(F.max_by("v", "n").alias("v"))


def filled(a: DataFrame, value: float) -> DataFrame:
    """Every stored cell at one value."""
    return a.withColumn("v", F.lit(value))


def row_positions(a: DataFrame, i: int) -> DataFrame:
    """j: the set cells of one row of a Boolean matrix."""
    return a.where(F.col("i") == i).select("j").distinct()


def row_ones(a: DataFrame) -> DataFrame:
    """i, ones: set cells of each row that has some."""
    return a.groupBy("i").agg(F.count(F.lit(1)).alias("ones"))


def elementwise_add_i32(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two sequences (pos, value) added place by place, wrapping as 32-bit integers."""
    from basaltine.functions.bits import wrap_i32

    both = a.join(b.select("pos", F.col("value").alias("other")), "pos")
    return both.select("pos", wrap_i32(F.col("value").cast("bigint") + F.col("other").cast("bigint")).alias("value"))
