"""Mergeable sketches as relations: distinct counts with history bits, and blocked Bloom filters.

Both are states of a fixed size whatever the input, built by one aggregation and merged by another.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltine.functions.bits import mix32, u32

#: Seeds of the two halves of a value's hash, and of a Bloom mask. Fixed values.
HIGH, LOW, MASK = 0x9E3779B9, 0x85EBCA6B, 0x9E3779B9
PRECISIONS = range(3, 21)


def _leading_zeros(value: Column, bits: int) -> Column:
    return F.when(value == 0, bits).otherwise(bits - F.length(F.bin(value)))


def distinct_ranks(df: DataFrame, column: str, precision: int) -> DataFrame:
    """register, rank: the distinct events of the values' hashes. All states follow from this relation."""
    if precision not in PRECISIONS:
        raise ValueError("the precision is from 3 to 20")
    v = F.col(column).cast("bigint")
    hashed = df.where(F.col(column).isNotNull()).select(mix32(v.bitwiseXOR(F.lit(HIGH))).alias("h"), mix32(v.bitwiseXOR(F.lit(LOW))).alias("l"))
    rest_high = u32(F.shiftleft("h", precision)).bitwiseOR(F.shiftright("l", 32 - precision))
    rest_low = u32(F.shiftleft("l", precision))
    zeros = F.when(rest_high != 0, _leading_zeros(rest_high, 32)).otherwise(F.least(F.lit(64 - precision), 32 + _leading_zeros(rest_low, 32)))
    return hashed.select(F.shiftright("h", 32 - precision).alias("register"), (zeros + precision - 1).alias("rank")).distinct()


def distinct_state(ranks: DataFrame) -> DataFrame:
    """register, state: the largest rank with two bits for the ranks one and two below it.

    A register's ranks are at most 64, so they are held as bits of one long.
    """
    bits = ranks.groupBy("register").agg(F.max("rank").alias("top"), F.bit_or(F.expr("shiftleft(1L, rank)")).alias("seen"))
    one = F.when(F.col("top") >= 1, F.expr("shiftright(seen, top - 1) & 1")).otherwise(0)
    two = F.when(F.col("top") >= 2, F.expr("shiftright(seen, top - 2) & 1")).otherwise(0)
    return bits.select("register", (F.col("top") * 4 + one * 2 + two).cast("bigint").alias("state"))


def merge_states(states: DataFrame) -> DataFrame:
    """States of several sketches merged: their ranks are read back from the bits."""
    top = F.floor(F.col("state") / 4).cast("int")
    each = F.explode(F.array_compact(F.array(top, F.when(F.col("state") % 4 >= 2, top - 1), F.when(F.col("state") % 2 == 1, top - 2))))
    return distinct_state(states.select("register", each.alias("rank")))


def estimate(states: DataFrame, precision: int) -> float:
    """The distinct count that is most likely for a state (of at most 2 to the precision rows, counted by value).

    An update has rank precision - 1 + k with probability 2^-(k + 1). For a register with top rank R the likelihood of
    n values is the product of the chances that no rank above R came, that R came, and what the two bits say of the
    ranks below it; its logarithm is concave in log n and its maximum is found by bisection.
    """
    m, most = 1 << precision, 64 - precision
    counts = [(r["state"], r["n"]) for r in states.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()]
    empty = m - sum(n for _, n in counts)
    if empty == m:
        return 0.0

    def chance(k: int) -> float:
        return 2.0 ** -(min(k, most - 1) + 1) if k < most else 2.0**-most

    absent = float(empty)
    present: dict[float, int] = {}
    for state, n in counts:
        k = state // 4 - precision + 1
        absent += n * (1.0 - sum(chance(j) for j in range(k + 1)))
        present[chance(k)] = present.get(chance(k), 0) + n
        for step, bit in ((1, 2), (2, 1)):
            if k - step >= 0:
                p = chance(k - step)
                if state & bit:
                    present[p] = present.get(p, 0) + n
                else:
                    absent += n * p

    def slope(x: float) -> float:
        return -absent + sum(c * p / math.expm1(min(700.0, x * p)) for p, c in present.items())

    low, high = 1e-9, 2.0
    while slope(high) > 0 and high < 1e30:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if slope(middle) > 0 else (low, middle)
    return m * low


def bloom_filter(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """block, l0..l3: a filter of 128-bit blocks, four words of 32 bits with one bit each per key."""
    h = mix32(F.col(column))
    second = mix32(h.bitwiseXOR(F.lit(MASK)))
    bits = [F.expr("1L").alias("one")]
    base = keys.where(F.col(column).isNotNull()).select((h % blocks).alias("block"), second.alias("s"), *bits)
    return base.groupBy("block").agg(*[F.bit_or(F.expr(f"shiftleft(1L, cast(shiftright(s, {8 * k}) & 31 as int))")).alias(f"l{k}") for k in range(4)])


def merge_blooms(a: DataFrame, b: DataFrame) -> DataFrame:
    """The filter of both key sets; both have the same number of blocks."""
    return a.unionByName(b).groupBy("block").agg(*[F.bit_or(f"l{k}").alias(f"l{k}") for k in range(4)])


#: Blocks of a filter that is broadcast: 36 bytes each. Beyond them the probe is shuffled to meet it.
BROADCAST_BLOCKS = 1 << 21


def prefiltered(probe: DataFrame, column: str, build: DataFrame, blocks: int = 1 << 16) -> DataFrame:
    """The probe rows whose key may be among the build side's: for a join whose probe would else be shuffled whole."""
    rows = may_contain(probe, column, bloom_filter(build, column, blocks), blocks)
    return rows.where("maybe").drop("maybe")


def may_contain(probe: DataFrame, column: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """Probe rows with ``maybe``: false only for keys that were never added.

    A filter has a row a block at most, so its size is known by the number of blocks: small ones go to the rows.
    """
    if blocks <= BROADCAST_BLOCKS:
        bloom = F.broadcast(bloom)
    h = mix32(F.col(column))
    rows = probe.withColumn("block", h % blocks).withColumn("__s", mix32(h.bitwiseXOR(F.lit(MASK))))
    hits = [F.expr(f"shiftright(l{k}, cast(shiftright(__s, {8 * k}) & 31 as int)) & 1") == 1 for k in range(4)]
    maybe = F.coalesce(hits[0] & hits[1] & hits[2] & hits[3], F.lit(False))
    return rows.join(bloom, "block", "left").withColumn("maybe", maybe).select(*probe.columns, "maybe")
