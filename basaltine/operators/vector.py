"""Vector distances, exact and two-stage nearest neighbours, and hybrid filters. Sums are in double precision."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _constant(query: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _pairs(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: (x - y) * (x - y)))


def l1_distance(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: F.abs(x - y)))


def inner_product(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(inner_product(a, a))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors, NaN if one has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(float("nan"))).otherwise(inner_product(a, b) / F.nullif(n, F.lit(0.0)))


def add_scaled(a: Column, b: Column, factor: float) -> Column:
    return _pairs(a, b, lambda x, y: x + y * F.lit(float(factor)))


SCORES = {"l2": squared_distance, "l1": l1_distance, "ip": inner_product}


def scores(df: DataFrame, vector: str, query: Sequence[float], kind: str = "l2") -> DataFrame:
    """Every row with its score against one query; the length of the vectors is checked."""
    v = F.col(vector)
    checked = F.when(F.size(v) == len(query), v).otherwise(F.raise_error(F.lit("a vector has another length than the query")))
    return df.withColumn("score", SCORES[kind](checked, _constant(query)))


def nearest(df: DataFrame, vector: str, row_id: str, query: Sequence[float], k: int, kind: str = "l2") -> DataFrame:
    """row_id, score of the k best rows, ties by row id: k rows a task, one merge."""
    best = F.desc("score") if kind == "ip" else F.asc("score")
    return scores(df.select(row_id, vector), vector, query, kind).select(row_id, "score").orderBy(best, row_id).limit(k)


#: Queries in a block and rows in a chunk: what is scored at once.
BLOCK, CHUNK = 1024, 8192
#: Bytes of vectors in a block or chunk, blocks in a partition, and pairs whose scores a worker holds at once.
PACKED, BLOCKS, HELD = 1 << 22, 16, 1 << 21


def _element(rows: DataFrame) -> str:
    """numpy's type for a column of vectors: single precision stays so, all else goes as doubles."""
    kind = rows.schema["vector"].dataType
    return "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"


def _packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows (id, vector) in chunks of at most ``size``: ids in order, length and bytes of the vectors, places of those with nulls.

    The length is -1 for a chunk that holds a null vector or several lengths.
    """
    element, most = _element(rows), PACKED

    def chunk(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        t = t.take(pc.sort_indices(t, [("id", "ascending")], null_placement="at_start")).combine_chunks()
        ids, vectors = (t[c].chunk(0) for c in ("id", "vector"))
        lengths, flat = pc.list_value_length(vectors), vectors.flatten()
        width = lengths[0].as_py() if not vectors.null_count and len(lengths.unique()) == 1 else -1
        blank = np.empty(0, "i4")
        if flat.null_count:
            if width > 0:
                blank = np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, width).any(1)).astype("i4")
            flat = flat.fill_null(0)
        columns = [
            pa.ListArray.from_arrays(pa.array([0, len(ids)], "int32"), ids),
            pa.array([width], "int32"),
            pa.array([flat.to_numpy().astype(element, copy=False).tobytes()], "binary"),
            pa.array([blank], pa.list_(pa.int32())),
        ]
        return pa.RecordBatch.from_arrays(columns, [f"{name}_{c}" for c in ("ids", "width", "vectors", "blank")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows and held.num_rows >= (full := max(1, min(size, most * held.num_rows // max(1, held.nbytes)))):
                yield chunk(held.slice(0, full))
                held = held.slice(full)
        if held is not None and held.num_rows:
            yield chunk(held)

    kind = rows.schema["id"].dataType.simpleString()
    ready = rows if element == "<f4" else rows.withColumn("vector", F.col("vector").cast("array<double>"))
    return ready.mapInArrow(pack, f"{name}_ids array<{kind}>, {name}_width int, {name}_vectors binary, {name}_blank array<int>")


def nearest_many(df: DataFrame, vector: str, row_id: str, queries: DataFrame, k: int, kind: str = "l2") -> DataFrame:
    """query, row_id, score, rank for each of many queries (query, wanted): their k best rows, ties by row id.

    Blocks of queries meet chunks of rows in Python workers; each meeting returns k rows a query, and only these are
    ranked. A matrix product bounds the scores of a meeting from below and above; pairs that the bounds leave open are
    scored as by ``SCORES``, term by term, so results are the same to the last bit. Nothing is broadcast, and a task
    holds one chunk, one group of blocks and ``HELD`` scores, whatever the number of queries and rows. Vectors of another
    length than their query's are an error. The functions are nested, so that workers need not have this package.
    """
    asked = queries.select(F.col("query").cast("bigint").alias("id"), F.col("wanted").alias("vector"))
    rows = df.select(F.col(row_id).alias("id"), F.col(vector).alias("vector"))
    n, width = asked.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    parts = max(1, -(-n // (BLOCK * BLOCKS)), -(-n * 8 * (width or 0) // (PACKED * BLOCKS)))
    blocks = _packed(asked.repartition(parts), BLOCK, "q").hint("shuffle_replicate_nl")
    chunks = _packed(rows, CHUNK, "r").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    elements, held = {"q": _element(asked), "r": _element(rows)}, HELD

    def unpacked(name: str, width: int, data: pa.Buffer, blank: list[int], n: int) -> tuple[np.ndarray, ...]:
        """Vectors as doubles, their squared lengths, which have nulls, and which no bound holds for."""
        v = np.frombuffer(data, elements[name]).astype("f8").reshape(n, width)
        void, square = np.zeros(n, bool), np.einsum("ij,ij->i", v, v)
        void[blank] = True
        return v, square, void, void | ~(square < 1e300)

    def first_copies(v: np.ndarray, void: np.ndarray) -> np.ndarray:
        """Places of the first k of equal vectors: their scores are equal, so later ones are never among the k best."""
        sums = np.column_stack([v, void])
        sums[np.isnan(v).any(1)] = np.nan  # every score is NaN
        sums[void] = np.r_[np.zeros(v.shape[1]), 1]
        _, of = np.unique(sums.view(f"V{sums.itemsize * sums.shape[1]}").ravel(), return_inverse=True)
        order = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[order], np.arange(of.max() + 1))
        return np.sort(order[np.arange(len(of)) - starts[of[order]] < k])

    def terms(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return x * y if kind == "ip" else np.abs(x - y) if kind == "l1" else (x - y) * (x - y)

    def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for d in range(x.shape[1]):
            total += terms(x[:, d], y[:, d])
        return total

    class Rows:
        """A chunk, ready to be scored."""

        def __init__(self, ids: pa.Array, width: int, data: pa.Buffer, blank: list[int]):
            v, square, void, odd = unpacked("r", width, data, blank, len(ids))
            self.places = first_copies(v, void)
            self.v, self.void, self.odd = v[self.places], void[self.places], odd[self.places]
            square = np.where(self.odd, 0.0, square[self.places])
            # rounding of sums of width + 1 terms, in the product and in the score; nothing of it in l1, which is no product
            self.share = 0.0 if kind == "l1" else (width + 8) * 2.0**-49
            self.slack = 2 * self.share * square
            plain = np.where(self.odd[:, None], 0.0, self.v)
            last = (0.0 if kind == "ip" else square) - self.share * square
            self.right = plain.T if kind == "l1" else np.vstack([plain.T, last])

        def low(self, w: np.ndarray) -> np.ndarray:
            """Lower bounds of keys, less what is the same for all rows of a query; infinite for rows without bounds."""
            if kind == "l1":
                low = np.zeros((len(w), len(self.places)))
                for d in range(w.shape[1]):
                    low += np.abs(self.right[d][None, :] - w[:, d, None])
            else:
                low = np.column_stack([w * (-1.0 if kind == "ip" else -2.0), np.ones(len(w))]) @ self.right
            low[:, self.odd] = np.inf
            return low

        def open_(self, w: np.ndarray, square: np.ndarray, odd: np.ndarray) -> np.ndarray:
            """Pairs, as flat numbers, that may be among the k best of their query."""
            n = len(self.places)
            found = np.ones((len(w), n), bool)
            if n > k:
                low = self.low(np.where(odd[:, None], 0.0, w))
                kth = np.partition(low, k - 1, axis=1)[:, k - 1]
                at = np.flatnonzero(low <= kth[:, None])  # k rows a query at least: none of the k best is over all of their upper bounds
                high = low.ravel()[at] + self.slack[at % n]
                tiny = 0.0 if kind == "l1" else 1e-300  # for products that underflow
                limit = np.maximum.reduceat(high, np.searchsorted(at, np.arange(len(w)) * n)) + 2 * self.share * square + tiny
                found = (low <= limit[:, None]) | self.odd | odd[:, None]
            return np.flatnonzero(found)

        def best(self, w: np.ndarray, square: np.ndarray, void: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, ...]:
            """Of the k best rows of each query: the query's place, the row's, its score and whether that is null."""
            at = self.open_(w, np.where(odd, 0.0, square), odd)
            q, r = np.divmod(at, len(self.places))
            step = max(1, held // (4 * max(1, w.shape[1])))
            score = np.concatenate([exact(self.v[r[s : s + step]], w[q[s : s + step]]) for s in range(0, len(at), step)])
            null = void[q] | self.void[r]
            score[null] = 0.0
            order = np.lexsort((r, -score if kind == "ip" else score, ~null, q))
            order = order[np.arange(len(q)) - np.searchsorted(q, q) < k]
            return q[order], self.places[r[order]], score[order], null[order]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            for i in range(b.num_rows if k > 0 else 0):
                (ids, width, data, blank), (q_ids, q_width, q_data, q_blank) = (
                    (b[f"{c}_ids"][i].values, b[f"{c}_width"][i].as_py(), b[f"{c}_vectors"][i].as_buffer(), b[f"{c}_blank"][i].as_py()) for c in "rq"
                )
                if width < 0 or width != q_width:
                    raise ValueError("a vector has another length than the query")
                with np.errstate(all="ignore"):
                    if last is None or not (last[0].equals(ids) and last[1].equals(data) and last[2] == blank):
                        last = ids, data, blank, Rows(ids, width, data, blank)
                    wanted = unpacked("q", width, q_data, q_blank, len(q_ids))
                    step = max(1, held // len(ids))
                    for s in range(0, len(q_ids), step):
                        q, r, score, null = last[3].best(*(x[s : s + step] for x in wanted))
                        yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(q + s)), ids.take(pa.array(r)), pa.array(score, mask=null)], ["query", "row", "score"])

    met = chunks.crossJoin(blocks).mapInArrow(meet, f"query bigint, row {rows.schema['id'].dataType.simpleString()}, score double")
    key = F.asc("key" if kind == "ip" else "score")
    ranked = met.withColumn("key", -F.col("score")).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(key, "row")))
    return ranked.where(F.col("rank") <= k).select("query", F.col("row").alias(row_id), "score", F.col("rank").cast("bigint").alias("rank"))


def signature(vector: Column, threshold: float = 0.0) -> Column:
    """array<bigint>: a bit per dimension that is over a threshold, 32 a word."""
    bits = F.transform(vector, lambda x: F.when(x > threshold, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    count = F.ceil(F.size(vector) / 32).cast("int")

    def word(w: Column) -> Column:
        part = F.reverse(F.slice(bits, w * 32 + 1, F.lit(32)))
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda a, b: a * 2 + b)

    return F.transform(F.sequence(F.lit(0), count - 1), word)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, n: s + n)


def query_signature(query: Sequence[float], threshold: float = 0.0) -> list[int]:
    return [sum(1 << b for b, x in enumerate(query[w : w + 32]) if x > threshold) for w in range(0, len(query), 32)]


def nearest_hamming(df: DataFrame, vector: str, row_id: str, query: Sequence[float], k: int, threshold: float = 0.0) -> DataFrame:
    """row_id, distance of the k rows with the fewest differing signs."""
    own = F.array(*[F.lit(w).cast("bigint") for w in query_signature(query, threshold)])
    return df.select(row_id, hamming(signature(F.col(vector), threshold), own).alias("distance")).orderBy("distance", row_id).limit(k)


def rerank(df: DataFrame, vector: str, row_id: str, query: Sequence[float], k: int, candidates: int, shards: int = 1) -> DataFrame:
    """The k nearest among ``candidates`` per shard by signature, by exact distance."""
    own = F.array(*[F.lit(w).cast("bigint") for w in query_signature(query)])
    rows = df.select(row_id, vector, F.pmod(F.col(row_id), F.lit(shards)).alias("shard"), hamming(signature(F.col(vector)), own).alias("bits"))
    place = F.row_number().over(Window.partitionBy("shard").orderBy("bits", row_id))
    return nearest(rows.withColumn("place", place).where(F.col("place") <= candidates), vector, row_id, query, k)


def hybrid_rerank(df: DataFrame, predicate: Column, vector: str, row_id: str, query: Sequence[float], k: int, candidates: int, shards: int = 1) -> DataFrame:
    """Filter, then a shortlist by signature per shard, then exact distances: ``rerank`` of the rows that a predicate selects."""
    return rerank(df.where(predicate), vector, row_id, query, k, candidates, shards)


def distance_selected(df: DataFrame, predicate: Column, vector: str, row_id: str, query: Sequence[float], kind: str = "l2") -> DataFrame:
    """row_id, score of the rows that a predicate selects, and of no other."""
    return scores(df.where(predicate).select(row_id, vector), vector, query, kind).select(row_id, "score")


def hybrid(df: DataFrame, predicate: Column, vector: str, row_id: str, query: Sequence[float], k: int, kind: str = "l2") -> DataFrame:
    """The k best among the rows that a predicate selects: the filter reaches the scan, only they are scored."""
    return nearest(df.where(predicate), vector, row_id, query, k, kind)


def check_range(low: int, high: int) -> None:
    """A hybrid search refuses an empty range instead of returning nothing."""
    if low >= high:
        raise ValueError("the range of a hybrid search is empty")


def block_bounds(df: DataFrame, vector: str, row_id: str, rows: int = 64, dimensions: int | None = None) -> DataFrame:
    """block, low, high: the smallest and largest value of each dimension in blocks of row ids.

    One aggregation with a combine on the map side; it is meant to be written beside the vectors and used many times.
    ``dimensions`` is read from the first row where it is not given.
    """
    if dimensions is None:
        first = df.select(F.size(vector).alias("n")).first()
        dimensions = first["n"] if first else 0
    each = [f(F.get(F.col(vector), F.lit(d))).alias(f"{n}{d}") for d in range(dimensions) for n, f in (("lo", F.min), ("hi", F.max))]
    per = df.groupBy(F.floor(F.col(row_id) / rows).alias("block")).agg(F.count(F.lit(1)).alias("n"), *each)
    return per.select("block", F.array(*[F.col(f"lo{d}") for d in range(dimensions)]).alias("low"), F.array(*[F.col(f"hi{d}") for d in range(dimensions)]).alias("high"))


#: Blocks up to which a scan names their row ids, so that the files are pruned; more are joined.
NAMED = 256


def _in_blocks(df: DataFrame, row_id: str, blocks: list[int], rows: int) -> DataFrame:
    """The rows of some blocks, by ranges of row ids that reach the scan."""
    ranges: list[list[int]] = []
    for b in sorted(blocks):
        if ranges and ranges[-1][1] == b:
            ranges[-1][1] = b + 1
        else:
            ranges.append([b, b + 1])
    condition = F.lit(False)
    for a, b in ranges:
        condition = condition | ((F.col(row_id) >= a * rows) & (F.col(row_id) < b * rows))
    return df.where(condition)


def pruned_nearest(df: DataFrame, bounds: DataFrame, vector: str, row_id: str, query: Sequence[float], k: int, rows: int = 64) -> DataFrame:
    """The k nearest, exactly, reading only blocks whose bound is not beyond a k-th distance already found.

    The k blocks with the smallest bounds give the limit; blocks beyond it cannot hold a nearer row.
    """
    q = _constant(query)
    gap = F.zip_with(F.zip_with("low", q, lambda lo, x: F.greatest(lo.cast("double") - x, F.lit(0.0))), F.zip_with("high", q, lambda hi, x: F.greatest(x - hi.cast("double"), F.lit(0.0))), lambda a, b: F.greatest(a, b))
    bounded = bounds.select("block", _sum(F.transform(gap, lambda g: g * g)).alias("bound"))
    placed = df.select(row_id, vector)
    first = [r["block"] for r in bounded.orderBy("bound", "block").limit(min(k, NAMED)).collect()]
    found = nearest(_in_blocks(placed, row_id, first, rows), vector, row_id, query, k).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("limit")).first()
    open_ = bounded if found["n"] < k else bounded.where(F.col("bound") <= found["limit"])
    few = [r["block"] for r in open_.select("block").limit(NAMED + 1).collect()]
    if len(few) <= NAMED:
        return nearest(_in_blocks(placed, row_id, few, rows), vector, row_id, query, k)
    kept = placed.withColumn("block", F.floor(F.col(row_id) / rows)).join(open_, "block", "left_semi")
    return nearest(kept, vector, row_id, query, k)
