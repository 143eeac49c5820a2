"""Searches in bytes and texts. Places count from 0, and -1 says that there is none."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Characters of patterns that are looked for together.
MANY = 1 << 20


def index_of(text: Column, pattern: str) -> Column:
    """The first place of a pattern; 0 for an empty one."""
    return F.lit(0) if pattern == "" else F.instr(text, F.lit(pattern)) - 1


def index_of_byte(data: Column, byte: int, start: int = 0, end: int | None = None) -> Column:
    """The first place of a byte in [start, end) of binary data."""
    return index_of_bytes(data, bytes([byte]), start, end)


def _bytes_as_text(data: Column) -> Column:
    """One character a byte, so that places in the text are places in the data."""
    return F.decode(data, "ISO-8859-1")


def index_of_bytes(data: Column, pattern: bytes, start: int = 0, end: int | None = None) -> Column:
    """The first place from ``start`` on of some bytes that end at ``end`` or before; ``start`` for an empty pattern."""
    part = F.substring(data, F.lit(start + 1), F.lit((1 << 30) if end is None else max(0, end - start)))
    if not pattern:
        return F.when(F.octet_length(data) >= start, F.lit(start)).otherwise(F.lit(-1))
    at = F.instr(_bytes_as_text(part), F.lit(pattern.decode("latin-1")))
    return F.when(at == 0, F.lit(-1)).otherwise(at - 1 + start)


def last_index_of_bytes(data: Column, pattern: bytes, end: int | None = None) -> Column:
    """The last place of some bytes that end at ``end`` or before; for an empty pattern, where the search begins."""
    part = data if end is None else F.substring(data, F.lit(1), F.lit(end))
    if not pattern:
        return F.octet_length(part)
    back = F.instr(F.reverse(_bytes_as_text(part)), F.lit(pattern[::-1].decode("latin-1")))
    return F.when(back == 0, F.lit(-1)).otherwise(F.octet_length(part) - back - len(pattern) + 1)


def index_of_utf16(text: Column, pattern: str) -> Column:
    """The first place of a pattern in 16-bit units, of which characters over U+FFFF take two; 0 for an empty one."""
    at = F.instr(text, F.lit(pattern))
    before = F.substring(text, F.lit(1), at - 1)
    units = F.length(before) + F.regexp_count(before, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return F.lit(0) if pattern == "" else F.when(at == 0, F.lit(-1)).otherwise(units)


def last_index_of(text: Column, character: str) -> Column:
    """The last place of one character."""
    back = F.instr(F.reverse(text), F.lit(character))
    return F.when(back == 0, -1).otherwise(F.length(text) - back)


def index_of_non_ascii(text: Column) -> Column:
    """The first place of a character over U+007F: also that of its first byte."""
    return F.regexp_instr(text, F.lit(r"[^\x00-\x7F]")) - 1


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by bytes, then by length."""
    x, y = a.cast("binary"), b.cast("binary")
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def compare_shortlex(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by length in bytes first."""
    m, n = F.octet_length(a), F.octet_length(b)
    return F.when(m < n, -1).when(m > n, 1).otherwise(compare(a, b))


def count_overlapping(text: Column, pattern: str) -> Column:
    """How often a pattern comes, overlaps included; an empty one once more than there are characters."""
    if pattern == "":
        return (F.length(text) + 1).cast("bigint")
    return F.regexp_count(text, F.lit(f"(?={re.escape(pattern)})")).cast("bigint")


def locate_all(df: DataFrame, row_id: str, text: str, pattern: str) -> DataFrame:
    """row_id, at: every place of a pattern, overlaps included; one scan of each text that has it."""
    t = F.col(text)
    parts = F.split(t, f"(?={re.escape(pattern)})", -1)
    # each part but the first starts with the pattern, and so does the first if the text does
    ends = F.aggregate(
        F.transform(parts, F.length), F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at")),
        lambda acc, n: F.struct((acc["n"] + n).alias("n"), F.concat(acc["at"], F.array(acc["n"])).alias("at")),
    )["at"]
    starts = F.when(F.startswith(t, F.lit(pattern)), ends).otherwise(F.slice(ends, F.lit(2), F.greatest(F.size(ends) - 1, F.lit(0))))
    return df.where(F.instr(t, F.lit(pattern)) > 0).select(row_id, F.explode(starts).alias("at"))


def count_many(df: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """patterns (query, pattern) to query, count: how often each comes in all texts together, overlaps included.

    The patterns are joined as one array, a row, so each text is read once; they fit in it by their sum of lengths,
    of which ``MANY`` is the bound.
    """
    asked = patterns.agg(F.collect_list(F.struct("query", "pattern")).alias("asked"), F.coalesce(F.sum(F.length("pattern")), F.lit(0)).alias("size"))
    asked = asked.select(F.when(F.col("size") > MANY, F.raise_error(F.lit("too many patterns at once"))).otherwise(F.col("asked")).alias("asked"))
    # one row of bounded size
    each = df.select(text).crossJoin(F.broadcast(asked)).select(F.explode(F.transform("asked", lambda a: F.struct(a["query"].alias("query"), _count_of(F.col(text), a["pattern"]).alias("n")))).alias("x"))
    found = each.select("x.*").groupBy("query").agg(F.sum("n").alias("n"))
    return patterns.select("query").join(found, "query", "left").select("query", F.coalesce("n", F.lit(0)).cast("bigint").alias("count"))


def _count_of(text: Column, pattern: Column) -> Column:
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(pattern, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    return F.regexp_count(text, quoted)
