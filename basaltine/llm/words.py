"""Columns for words and normalised text that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but these seven white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole(text: Column | str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and all else as it is; ``lower`` does the same where a text is ASCII only."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    """The number of words of a text (long)."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """``df.where(condition)`` on columns as computed.

    The optimiser would otherwise move the condition below the columns it reads and compute them once more in it, in
    lambdas even once an element. It moves nothing below a row number that the condition reads.
    """
    return df.withColumn("__row", F.monotonically_increasing_id()).where(condition & (F.col("__row") >= 0)).drop("__row")
