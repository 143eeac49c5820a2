"""Exact deduplication by deterministic block naming (native).

A normalised text is cut into blocks of a fixed number of bytes. The distinct blocks are sorted and each gets an
integer name. Then adjacent names are paired and the distinct pairs are sorted and named in turn, until one name per
document is left: two documents have the same number of blocks and the same last name exactly when their texts are
the same. No text hash decides: a 64-bit hash only routes a block to its name, that no two blocks share one is
checked, and where two do the blocks themselves are the join key.

Hot blocks and names: the distinct blocks come from an aggregation that combines on the map side, and names return to
the rows by joins of written tables, of which Spark can split a hot side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltine.llm.scratch import saved
from basaltine.llm.words import lower_ascii, whole

#: Bytes in a block.
BLOCK_BYTES = 4096
#: Bits of the hash that routes a block to its name.
ROUTE_BITS = 64


def _cut(docs: DataFrame, text: str, block_bytes: int) -> DataFrame:
    """row, id, normalised text as bytes, and its blocks (at least one, which may be empty)."""
    data = F.col("norm").cast("binary")
    last = F.greatest(F.ceil(F.octet_length("norm") / block_bytes).cast("int"), F.lit(1)) - 1
    return docs.select(
        "row", "id", F.col("norm"), F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * block_bytes + 1, F.lit(block_bytes))).alias("blocks")
    )


def _route(block: Column, bits: int) -> Column:
    h = F.xxhash64(block)
    return h if bits == 64 else F.pmod(h, F.lit(1 << bits))


def _named(distinct: DataFrame, *keys: str) -> DataFrame:
    """Sorts the distinct keys and names them: the partition's number, then the rank in it."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def block_identity(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, route_bits: int = ROUTE_BITS) -> DataFrame:
    """One row per row of ``docs``: row, id, text_sha256, level, name.

    Rows are equal in (level, name) exactly when their normalised texts are equal. Null texts count as empty, an
    empty text has one empty block. ``row`` numbers the rows, so equal ids stay apart.
    """
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"), lower_ascii(whole(text)).alias("norm"))
    cut = _cut(base, text, block_bytes)
    rows = saved(
        cut.select("row", "id", F.sha2("norm", 256).alias("text_sha256"), F.transform("blocks", lambda b: _route(b, route_bits)).alias("routes"))
    )
    distinct = cut.select(F.explode("blocks").alias("block")).distinct()
    names = saved(_named(distinct, "block").select(_route(F.col("block"), route_bits).alias("route"), "name"))
    sized = rows.select("row", F.size("routes").alias("n"), F.posexplode("routes").alias("at", "route"))
    if names.groupBy("route").count().where("count > 1").isEmpty():
        current = sized.join(names, "route").select("row", "n", "at", "name")
    else:  # two blocks share a hash: the blocks are the key
        names = saved(_named(distinct, "block"))
        blocks = cut.select("row", F.size("blocks").alias("n"), F.posexplode("blocks").alias("at", "block"))
        current = blocks.join(names, "block").select("row", "n", "at", "name")
    current, level, done = saved(current), 0, []
    most = current.agg(F.max("n")).first()[0] or 1
    done.append(current.where("n = 1"))
    while (1 << level) < most:
        left = current.where(F.col("n") > (1 << level))
        first = F.col("at") % 2 == 0
        pairs = saved(
            left.groupBy("row", "n", F.floor(F.col("at") / 2).cast("int").alias("at")).agg(
                F.max(F.when(first, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~first, F.col("name"))), F.lit(-1)).alias("b")
            )
        )
        names = saved(_named(pairs.select("a", "b").distinct(), "a", "b"))
        current, level = saved(pairs.join(names, ["a", "b"]).select("row", "n", "at", "name")), level + 1
        done.append(current.where(F.col("n") <= (1 << level)))
    found = reduce(DataFrame.unionAll, (d.select("row", F.lit(k).alias("level"), "name") for k, d in enumerate(done)))
    return rows.drop("routes").join(found, "row")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, route_bits: int = ROUTE_BITS) -> DataFrame:
    """One row per row of ``docs``, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text equals an empty one. Of equal texts the row
    with the largest doc_id stays (null ids are the smallest); if that id comes more than once, one of its rows.
    An empty table gives no rows. Other columns of ``docs`` are neither read nor returned.
    """
    ident = saved(block_identity(docs, doc_id, text, block_bytes, route_bits))
    classes = saved(ident.groupBy("level", "name").agg(F.max(F.struct("id", "row")).alias("last"), F.count("*").alias("group_size")))
    return ident.join(classes, ["level", "name"]).select(
        F.col("id").alias("doc_id"), F.col("last.id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), "text_sha256"
    )


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns, whatever their names.

    Null texts are empty ones, so one of both stays; of rows with the same id and text one stays.
    """
    verdict = exact_dedup(docs, doc_id, text).where("kept").select(F.col("doc_id").alias("i"), F.col("text_sha256").alias("s"))
    here = docs.select(F.struct("*").alias("d"), F.col(doc_id).alias("id"), F.sha2(lower_ascii(whole(text)), 256).alias("sha"))
    found = here.join(verdict, F.col("id").eqNullSafe(F.col("i")) & (F.col("sha") == F.col("s")))
    if not docs.groupBy(doc_id).count().where("count > 1").isEmpty():  # the same id and text more than once: one of them stays
        found = found.dropDuplicates(["id", "sha"])
    return found.select("d.*")
