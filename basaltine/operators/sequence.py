"""Positional queries over a sequence (pos, value), pos from 0. -1 says that there is no answer.

Queries come as a DataFrame and are answered together: each joins the sequence only through a condition that bounds
its rows, or reads a running count that one window per value computes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basaltine.sources.scratch import saved


#: Positions of a span: what one task compares or counts up in order.
SPAN = 1 << 16


def _answer(value: Column) -> Column:
    return F.coalesce(value, F.lit(-1)).cast("bigint")


def rank(seq: DataFrame, value: int, end: int) -> DataFrame:
    """How many of the first ``end`` values equal a value."""
    return seq.agg(F.count_if((F.col("pos") < end) & (F.col("value") == value)).alias("rank"))


def select(seq: DataFrame, value: int, n: int) -> DataFrame:
    """The position of the n-th (from 0) occurrence of a value."""
    found = seq.where(F.col("value") == value).orderBy("pos").limit(n + 1)
    return found.agg(_answer(F.when(F.count(F.lit(1)) == n + 1, F.max("pos"))).alias("select"))


def running_ranks(seq: DataFrame) -> DataFrame:
    """pos, value, rank: occurrences of each position's own value before it (a window per value)."""
    order = Window.partitionBy("value").orderBy("pos")
    return seq.select("pos", "value", (F.row_number().over(order) - 1).cast("bigint").alias("rank"))


def select_many(seq: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (query, value, n) to query, select."""
    ranked = running_ranks(seq).select(F.col("value"), F.col("rank").alias("n"), "pos")
    return queries.join(ranked, ["value", "n"], "left").select("query", _answer(F.col("pos")).alias("select"))


def access_many(seq: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (query, pos) to query, value."""
    return queries.join(seq, "pos", "left").select("query", "value")


def rank_many(seq: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (query, value, end) to query, rank: how many of the first ``end`` values equal a value.

    The occurrences of the values asked for, in spans of positions, are counted up; a query adds those of its own
    span. No query meets more than the occurrences of its value in one span.
    """
    q = queries.select("query", F.col("value").alias("qv"), "end", F.floor(F.col("end") / SPAN).alias("qs"))
    asked = queries.select("value").distinct()
    hits = seq.join(asked, "value", "left_semi").select("value", "pos", F.floor(F.col("pos") / SPAN).alias("span"))
    per = hits.groupBy("value", "span").agg(F.count(F.lit(1)).alias("n"), F.collect_list("pos").alias("at"))
    order = Window.partitionBy("value").orderBy("span")
    upto = per.select("value", "span", "at", (F.sum("n").over(order) - F.col("n")).alias("before"), F.sum("n").over(order).alias("after"), F.lead("span").over(order).alias("next"))
    # the last span with an occurrence up to the query's
    on = (F.col("value") == F.col("qv")) & (F.col("span") <= F.col("qs")) & (F.col("next").isNull() | (F.col("next") > F.col("qs")))
    inside = F.size(F.filter("at", lambda p: p < F.col("end")))
    rank = F.when(F.col("span") == F.col("qs"), F.col("before") + inside).otherwise(F.col("after"))
    return q.join(upto, on, "left").select("query", F.coalesce(rank, F.lit(0)).cast("bigint").alias("rank"))


def range_frequency(seq: DataFrame, left: int, right: int, low: int, high: int) -> DataFrame:
    """How many values in [low, high) there are at positions [left, right); ValueError if low > high."""
    if low > high:
        raise ValueError("low is above high")
    p, v = F.col("pos"), F.col("value")
    return seq.agg(F.count_if((p >= left) & (p < right) & (v >= low) & (v < high)).alias("count"))


def quantile(seq: DataFrame, left: int, right: int, k: int) -> DataFrame:
    """The k-th smallest (from 0) value at positions [left, right), by the places of the counted values."""
    inside = seq.where((F.col("pos") >= left) & (F.col("pos") < right)).select(F.lit(0).alias("query"), F.lit(k).alias("k"), "value")
    return _kth(inside).agg(_answer(F.min("v")).alias("quantile"))


def quantile_many(seq: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (query, left, right, k) to query, quantile: each meets the positions in the spans that it touches."""
    touched = F.sequence(F.floor(F.col("left") / SPAN), F.floor((F.greatest(F.col("right") - 1, F.col("left"))) / SPAN))
    asked = queries.select("*", F.explode(touched).alias("span"))
    inside = asked.join(seq.withColumn("span", F.floor(F.col("pos") / SPAN)), "span").where((F.col("pos") >= F.col("left")) & (F.col("pos") < F.col("right")))
    return queries.select("query").join(_kth(inside.select("query", "k", "value")), "query", "left").select("query", _answer(F.col("v")).alias("quantile"))


def _kth(inside: DataFrame) -> DataFrame:
    """(query, k, value) to query, v: the k-th smallest value of each query that has as many.

    Values are counted per query, the counts range-partitioned by query and value, and summed up within partitions;
    what the partitions before hold is added to each.
    """
    counts = inside.groupBy("query", "k", "value").agg(F.count(F.lit(1)).alias("n"))
    parts = saved(counts.repartitionByRange("query", "value").select("*", F.spark_partition_id().alias("part")))
    sums = parts.groupBy("query", "part").agg(F.sum("n").alias("m"))
    earlier = F.sum("m").over(Window.partitionBy("query").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = sums.select("query", "part", F.coalesce(earlier, F.lit(0)).alias("before"), "m")
    open_ = parts.join(before, ["query", "part"]).where((F.col("before") <= F.col("k")) & (F.col("k") < F.col("before") + F.col("m")))
    upto = open_.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("query", "part").orderBy("value")))
    return upto.where(F.col("upto") > F.col("k")).groupBy("query").agg(F.min("value").alias("v"))


def predecessor(seq: DataFrame, left: int, right: int, value: int) -> DataFrame:
    """The largest value strictly below another at positions [left, right)."""
    p, v = F.col("pos"), F.col("value")
    return seq.where((p >= left) & (p < right) & (v < value)).agg(_answer(F.max("value")).alias("predecessor"))


def neighbours(seq: DataFrame, value: int, at: int) -> DataFrame:
    """next: the nearest position from ``at`` on that has a value; prev: the nearest up to it."""
    hit = F.col("value") == value
    return seq.agg(_answer(F.min(F.when(hit & (F.col("pos") >= at), F.col("pos")))).alias("next"), _answer(F.max(F.when(hit & (F.col("pos") <= at), F.col("pos")))).alias("prev"))


def bits_of_words(words: DataFrame) -> DataFrame:
    """words (word, bits) of 32 bits to a sequence of 0 and 1."""
    return words.select(F.explode(F.sequence(F.lit(0), F.lit(31))).alias("b"), "word", "bits").select((F.col("word") * 32 + F.col("b")).alias("pos"), F.expr("shiftright(bits, b) & 1").alias("value"))


def monotone_queries(seq: DataFrame, value: int) -> DataFrame:
    """Of a non-decreasing sequence: rank (values below), lower_bound (its position), next_geq and predecessor."""
    v = F.col("value")
    return seq.agg(
        F.count_if(v < value).alias("rank"),
        _answer(F.min(F.when(v >= value, F.col("pos")))).alias("lower_bound"),
        _answer(F.min(F.when(v >= value, v))).alias("next_geq"),
        _answer(F.max(F.when(v < value, v))).alias("predecessor"),
    )


def _steps(df: DataFrame, row_id: str, value: str, within: str | None, bad) -> DataFrame:
    """One row, ``n``: neighbours (before, after) in the order of row ids of which ``bad`` holds.

    They are compared within groups (spans of row ids if none are given), and then the groups' edges: a row per group.
    """
    group = F.floor(F.col(row_id) / SPAN) if within is None else F.col(within)
    rows = df.select(group.alias("g"), F.col(row_id).alias("r"), F.col(value).alias("v"))
    before = F.lag("v").over(Window.partitionBy("g").orderBy("r"))
    groups = rows.select("g", "r", "v", bad(before, F.col("v")).alias("bad")).groupBy("g").agg(F.count_if("bad").alias("n"), F.min_by("v", "r").alias("first"), F.max_by("v", "r").alias("last"))
    edge = bad(F.lag("last").over(Window.orderBy("g")), F.col("first"))
    return groups.select("n", edge.alias("edge")).agg((F.coalesce(F.sum("n"), F.lit(0)) + F.count_if("edge")).alias("n"))


def inversions(df: DataFrame, row_id: str, value: str, within: str | None = None) -> DataFrame:
    """How many rows are smaller than the one before them, within groups and from the last row of one group to the
    first of the next."""
    return _steps(df, row_id, value, within, lambda a, b: a > b).select(F.col("n").alias("inversions"))


def is_monotone(df: DataFrame, row_id: str, value: str, strict: bool = False) -> DataFrame:
    """Whether a sequence never decreases (or, strictly, always increases)."""
    found = _steps(df, row_id, value, None, (lambda a, b: a >= b) if strict else (lambda a, b: a > b))
    return found.select((F.col("n") == 0).alias("monotone"))


def parents(shape: DataFrame) -> DataFrame:
    """A tree in level order as bits (pos, value): each node is a 1 in its parent's list, which a 0 ends.

    Returns node, parent, by the order of the ones: the parent of a node is the number of zeros before its one, less
    one for the list of the root itself; the root's parent is -1.
    """
    ones = running_ranks(shape).where("value = 1").select(F.col("rank").alias("node"), (F.col("pos") - F.col("rank") - 1).cast("bigint").alias("parent"))
    return ones


def intersect_lists(a: DataFrame, b: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` common values of two strictly increasing lists."""
    return a.select("value").join(b.select("value"), "value").orderBy("value").limit(cap)
