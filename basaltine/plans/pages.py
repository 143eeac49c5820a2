"""Pages of a column in row order: which a range would scan, and what that would cost. For explaining only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest spread of a frame-of-reference page. Fixed value.
FRAME = 1 << 16


def page_table(df: DataFrame, row_id: str, column: str, rows: int) -> DataFrame:
    """page, row_offset, row_count, min, max, encoding of each run of ``rows`` row ids."""
    page = F.floor(F.col(row_id) / rows)
    pages = df.groupBy(page.alias("page")).agg(F.count(F.lit(1)).alias("row_count"), F.min(column).alias("min"), F.max(column).alias("max"))
    spread = F.col("max").cast("bigint") - F.col("min")
    kind = F.when(spread == 0, "constant").when(spread < FRAME, "frame-of-reference").otherwise("raw")
    return pages.select("page", (F.col("page") * rows).alias("row_offset"), "row_count", "min", "max", kind.alias("encoding"))


def _meets(low: int, high: int) -> Column:
    return (F.col("min") < high) & (F.col("max") >= low) if low < high else F.lit(False)


def estimate(pages: DataFrame, low: int, high: int) -> DataFrame:
    """pages_scanned, pages_skipped and rows_scanned of a half-open range."""
    hit = F.coalesce(_meets(low, high), F.lit(False))
    return pages.agg(F.count_if(hit).alias("pages_scanned"), F.count_if(~hit).alias("pages_skipped"), F.coalesce(F.sum(F.when(hit, F.col("row_count"))), F.lit(0).cast("bigint")).alias("rows_scanned"))
