"""SimHash near-duplicates by a Gray-order hierarchical index.

A fingerprint has 64 bits; two texts are linked where theirs differ in at most three. Three differences leave one of
four 16-bit blocks as it is, so the index is kept in four rotations, each led by another block: rows with one leading
block are sorted by the Gray rank of the rotated fingerprint, which puts alike bit patterns side by side. Runs of
neighbours form nodes that hold the bits all of them share; nodes form upper nodes in the same way, each keeping only
the shared bits that its parent lacks. A query adds up its differences from the root down and leaves a whole group as
soon as they exceed three, or as soon as all of the group is known to be in its component.

Equal fingerprints are one entry. A task returns a spanning forest of its entries' links, never all pairs. A leading
block with too many entries is split by further blocks of the other bits and then into pairs of chunks, both exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basaltine.llm.components import components
from basaltine.llm.scratch import saved
from basaltine.llm.ship import ship
from basaltine.llm.words import whole

BITS, SEED, SHINGLE, DISTANCE = 64, 42, 3, 3
#: Entries of one bucket that one task takes; larger buckets are split.
BUCKET = 8192
#: Children of a node; queries times entries in the air at once.
FANOUT, FRONTIER = 16, 1 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED, piece: int = 1 << 18) -> int:
    """The fingerprint of one text; shingles are hashed ``piece`` at a time, so that memory is bounded."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n], ends[min(shingle, len(words)) - 1 :]
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, piece):
        part = [digest(joined[a:b], seed) for a, b in zip(starts[k : k + piece].tolist(), ends[k : k + piece].tolist(), strict=True)]
        octets = np.array(part, np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def _rotated(fp: Column, by: int) -> Column:
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def gray_rank(fp: Column) -> Column:
    """The place of a 64-bit pattern in the reflected Gray order (as a signed long)."""
    return reduce(lambda r, s: r.bitwiseXOR(F.shiftrightunsigned(r, s)), (1, 2, 4, 8, 16, 32), fp)


class Forest:
    """Labels of entries; joined entries get the smallest label."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label[:] = label[label]


class Index:
    """The hierarchical index of some buckets: ``x`` in order of bucket and Gray rank, ``size`` the buckets' sizes."""

    def __init__(self, x: np.ndarray, size: np.ndarray, fanout: int = FANOUT):
        self.x, self.n = x, len(x)
        mask, value, count = np.full(len(x), _ALL), x, size
        #: From the entries up: shared bits, their values, first child, one past the last child.
        self.levels: list[tuple] = [(mask, value, None, None)]
        while len(self.levels) == 1 or (count > 1).any():
            # runs of fanout children, cut where a bucket ends
            groups = -(-count // fanout)
            first_child = np.repeat(np.cumsum(count) - count, groups)
            nth = np.arange(groups.sum()) - np.repeat(np.cumsum(groups) - groups, groups)
            lo = first_child + nth * fanout
            hi = np.minimum(lo + fanout, np.repeat(np.cumsum(count), groups))
            lead = np.repeat(value[lo], hi - lo)
            shared = np.bitwise_and.reduceat(mask & ~(value ^ lead), lo)
            mask, value, count = shared, value[lo] & shared, groups
            self.levels.append((mask, value, lo, hi))
        self.rest = [m & ~np.repeat(p[0], p[3] - p[2]) for (m, *_), p in zip(self.levels, self.levels[1:], strict=False)]
        self.rest.append(self.levels[-1][0])

    def link(self, size: np.ndarray, distance: int = DISTANCE, frontier: int = FRONTIER) -> np.ndarray:
        """The label of every entry after all links are joined."""
        forest, top = Forest(self.n), len(self.levels) - 1
        root, cost = np.repeat(np.arange(len(size)), size), np.cumsum(np.repeat(size, size))
        start = 0
        while start < self.n:
            stop = max(start + 1, int(np.searchsorted(cost, cost[start] + frontier)))
            query = np.arange(start, stop)
            node, acc = root[start:stop], np.zeros(stop - start, np.int64)
            low, high = self._bounds(forest.label)
            for level in range(top, -1, -1):
                mask, value, lo, hi = self.levels[level]
                acc = acc + np.bitwise_count((self.x[query] ^ value[node]) & self.rest[level][node])
                same = (low[level][node] == forest.label[query]) & (high[level][node] == forest.label[query])
                keep = (acc <= distance) & ~same
                query, node, acc = query[keep], node[keep], acc[keep]
                if level:
                    each = (hi - lo)[node]
                    nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    query, acc, node = np.repeat(query, each), np.repeat(acc, each), np.repeat(lo[node], each) + nth
            forest.join(query, node)
            start = stop
        return forest.label

    def _bounds(self, label: np.ndarray) -> tuple[list, list]:
        """The smallest and the largest label below every node."""
        low, high = [label], [label]
        for _, _, lo, _ in self.levels[1:]:
            low.append(np.minimum.reduceat(low[-1], lo))
            high.append(np.maximum.reduceat(high[-1], lo))
        return low, high


def spanning_links(fps: np.ndarray, bucket: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components within each bucket; the buckets are runs, in Gray order inside."""
    new = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    size = np.diff(np.r_[new, len(bucket)])
    several = np.repeat(size > 1, size)
    fps, size = fps[several], size[size > 1]
    if not len(size):
        return fps[:0], fps[:0]
    label = Index(fps, size).link(size, distance)
    away = label != np.arange(len(fps))
    return fps[away], fps[label[away]]


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole buckets of each batch; the last one may go on in the next batch and is held back."""
    held_b, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        b = np.r_[held_b, batch["bucket"].to_numpy()]
        f = np.r_[held_f, batch["fp"].to_numpy().view(np.uint64)]
        cut = int(np.flatnonzero(b != b[-1])[-1]) + 1 if len(b) and b[0] != b[-1] else 0
        held_b, held_f = b[cut:], f[cut:]
        x, y = spanning_links(f[:cut], b[:cut])
        yield pd.DataFrame({"a": x.view(np.int64), "b": y.view(np.int64)})
    x, y = spanning_links(held_f, held_b)
    yield pd.DataFrame({"a": x.view(np.int64), "b": y.view(np.int64)})


def _masks(free: list[int]) -> list[int]:
    """Four masks that share out the given bits in runs."""
    return [sum(1 << b for b in free[k * len(free) // 4 : (k + 1) * len(free) // 4]) for k in range(4)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _buckets(fps: DataFrame, limit: int) -> DataFrame:
    """fp, bucket, rank: each fingerprint under each of its four leading blocks.

    A bucket is named by the hash of its block's number and bits; should two share a name they are searched as one,
    which finds no false link. Buckets over ``limit`` are split by four blocks of the 48 other bits (three differences
    leave one of them too), and those still over it into pairs of chunks.
    """

    def under(k: int, fp: Column) -> Column:
        return F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(_signed(_masks(list(range(BITS)))[k]))))

    rows = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), under(k, F.col("fp")).alias("bucket")) for k in range(4)])).alias("s")).select("fp", "s.*")
    for depth in range(2):
        sizes = rows.groupBy("bucket").count().where(F.col("count") > limit)
        if depth == 0:
            large = saved(sizes.drop("count"))
            if large.isEmpty():
                return rows
            marked = rows.join(large.withColumn("large", F.lit(True)), "bucket", "left")
            small, rest = marked.where("large is null").select("fp", "k", "bucket"), marked.where("large")
            parts = []
            for k in range(4):
                other = [b for b in range(BITS) if not _masks(list(range(BITS)))[k] >> b & 1]
                parts += [F.struct(F.lit(k).alias("k"), F.xxhash64("bucket", F.lit(j), F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias("bucket")) for j, m in enumerate(_masks(other))]
            pick = [F.when(F.col("k") == k, F.array(*parts[4 * k : 4 * k + 4])) for k in range(4)]
            split = rest.select("fp", F.explode(F.coalesce(*pick)).alias("s")).select("fp", "s.*")
            rows = saved(small.unionAll(split))
        else:
            large = saved(sizes.select("bucket", F.ceil(F.col("count") * 2 / limit).alias("chunks")))
            if large.isEmpty():
                return rows
            marked = rows.join(large, "bucket", "left")
            mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks"))
            pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: F.xxhash64("bucket", F.least(mine, j), F.greatest(mine, j)))
            cut = marked.where("chunks is not null").select("fp", "k", F.explode(pairs).alias("bucket"))
            rows = marked.where("chunks is null").select("fp", "k", "bucket").unionAll(cut)
    return rows


def near_links(fps: DataFrame, limit: int = BUCKET) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) that span their components."""
    rows = _buckets(fps, limit)
    rank = F.coalesce(*[F.when(F.col("k") == k, gray_rank(_rotated(F.col("fp"), (BITS - 16 * (k + 1)) % BITS))) for k in range(4)])
    ordered = rows.select("fp", "bucket", rank.alias("rank")).repartition("bucket").sortWithinPartitions("bucket", "rank")
    return ordered.select("fp", "bucket").mapInPandas(_linked, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (long), component_id, text_hash, kept.

    ``component_id`` is the smallest doc_id that links reach, itself included; ``kept`` marks the rows that have the
    component's smallest id (equal rows alike). Null and empty texts, and texts without words, have fingerprint zero
    and are linked like any other. Null ids come last. An empty table gives no rows; other columns are not read.
    """
    ship(docs.sparkSession)
    rows = saved(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole(text)).alias("text_hash"), _fingerprints(whole(text)).alias("fp")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    fps = saved(rows.groupBy("fp").agg(first.alias("first")))
    roots = components(near_links(fps.select("fp"), limit))
    rooted = saved(fps.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    firsts = saved(rooted.groupBy("root").agg(F.min("first").alias("best")))
    found = saved(rooted.select("fp", "root").join(firsts, "root").select("fp", "best"))
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    return rows.join(found, "fp").select("doc_id", F.col("fp").alias("fingerprint"), F.col("best.doc_id").alias("component_id"), "text_hash", kept.alias("kept"))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, that of the smallest id, with all its columns, whatever their names.

    Texts without words are one component; of rows with the same id and text one stays.
    """
    verdict = near_duplicates(docs, doc_id, text).where("kept").select(F.col("doc_id").alias("i"), F.col("text_hash").alias("t")).distinct()
    here = docs.select(F.struct("*").alias("d"), F.col(doc_id).alias("id"), F.xxhash64(whole(text)).alias("hash"))
    found = here.join(verdict, F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("t")))
    if not docs.groupBy(doc_id).count().where("count > 1").isEmpty():  # equal rows: one of them stays
        found = found.dropDuplicates(["id", "hash"])
    return found.select("d.*")
