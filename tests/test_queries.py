"""Every query of the engine against its SQL, at the smallest scale."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from basaltine import queries as q
from basaltine.operators import matrix, vector

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return [plain(v) for v in value] if isinstance(value, list | tuple) else value


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query(spark, duck, name):
    df = q.QUERIES[name](spark, SF)
    found = duck.execute(q.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(plain(x) for x in r) for r in found.fetchall()), key=key)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=key)
    assert got == want


def test_searches_in_whole_texts(spark, duck, rows):
    docs = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    assert max(len(t) for _, t in docs) > 2000
    places = {d: [i for i in range(len(t)) if t.startswith("ana", i)] for d, t in docs}
    assert rows(q.QUERIES["text_locate"](spark, SF)) == sorted((d, i) for d, at in places.items() for i in at)
    assert rows(q.QUERIES["text_count_overlap"](spark, SF)) == sorted((d, len(at)) for d, at in places.items())
    assert rows(q.QUERIES["text_non_ascii"](spark, SF)) == sorted((d, next((i for i, c in enumerate(t) if ord(c) > 127), -1)) for d, t in docs)


def test_whole_tables_in_matrices_and_joins(spark, duck, rows):
    cells = {(i, j): v for _, i, j, v in rows(q._cells(spark, SF, 12))}
    want = {}
    for i, j, v in duck.execute("SELECT l_orderkey % 12, l_suppkey % 12, l_quantity::BIGINT FROM lineitem").fetchall():
        want[i, j] = want.get((i, j), 0) + v
    assert cells == want
    product = {}
    for i, k in want:
        for j in range(12):
            if (k, j) in want:
                product[i, j] = product.get((i, j), 0) + want[i, k] * want[k, j]
    assert rows(q.QUERIES["matrix_multiply"](spark, SF)) == sorted((0, i, j, v) for (i, j), v in product.items())
    # without the clamp of the registered query
    a = q._cells(spark, SF, 12)
    assert {(i, j): v for _, i, j, v in rows(matrix.gemm(a, a, alpha=0.5))} == {k: v * 0.5 for k, v in product.items()}

    events = duck.execute("SELECT event_id, user_id, event_type FROM events ORDER BY event_id").fetchall()
    last, as_of = {}, []
    for event, user, kind in events:
        if kind == "purchase":
            last[user] = event
        else:
            as_of.append((event, last.get(user)))
    assert rows(q.QUERIES["join_as_of"](spark, SF)) == as_of
    ids = [e for e, _, _ in events]
    assert rows(q.QUERIES["join_interval"](spark, SF)) == sorted((e, s) for s in ids for e in range(s, s + s % 40) if e <= ids[-1])


def test_every_hundredth_vector_is_searched_for(spark, duck, rows, monkeypatch):
    vectors = dict(duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall())

    def nearest(query):
        return sorted((sum((x - y) * (x - y) for x, y in zip(v, vectors[query], strict=True)), i) for i, v in vectors.items())[:5]

    want = sorted((query, i, n + 1) for query in vectors if query % 100 == 0 for n, (_, i) in enumerate(nearest(query)))
    assert len(want) > 15 and rows(q.QUERIES["topk_batch"](spark, SF)) == want
    monkeypatch.setattr(vector, "BLOCK", 2)
    monkeypatch.setattr(vector, "CHUNK", 7)
    assert rows(q.QUERIES["topk_batch"](spark, SF)) == want


def test_sets_differ(spark, rows):
    one = rows(q.QUERIES["set_cardinalities"](spark, SF))[0]
    assert 0 < q.QUERIES["set_difference"](spark, SF).count() < q.QUERIES["set_union"](spark, SF).count() and q.QUERIES["set_ranges"](spark, SF).count() > 5
    assert one[2] < min(one[0], one[1]) and one[4] > 0 and 0 < one[-1] < 1
    assert q.QUERIES["set_intersect"](spark, SF).count() not in (0, q.QUERIES["set_union"](spark, SF).count())


def test_pruned_vectors_are_not_read(spark):
    """A query near one block reads that block's rows only."""
    rows = spark.range(4096).select(F.col("id").alias("vec_id"), F.array(F.floor(F.col("id") / 64).cast("float"), (F.col("id") % 64 / 64).cast("float")).alias("v"))
    bounds = vector.block_bounds(rows, "v", "vec_id")
    found = vector.pruned_nearest(rows, bounds, "v", "vec_id", [20.0, 0.5], 5)
    assert sorted(r["vec_id"] for r in found.collect()) == [20 * 64 + k for k in range(30, 35)]
    assert "vec_id" in found._jdf.queryExecution().optimizedPlan().toString() and "1280" in found._jdf.queryExecution().optimizedPlan().toString()


def test_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = lambda name: q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan("topk_l2") and "TakeOrderedAndProject" in plan("order_top_k")
    assert "GreaterThanOrEqual(label" in plan("hybrid_topk").partition("PushedFilters")[2]
    assert "GreaterThanOrEqual(l_partkey" in plan("masked_multi_measure").partition("PushedFilters")[2]
    pushed = {
        "range_aggregate": ("GreaterThanOrEqual(l_quantity,10.0)", "LessThan(l_quantity,20.0)"),
        "group_dense": ("GreaterThanOrEqual(l_shipdate,", "LessThan(l_shipdate,"),
        "builder_between_eq": ("GreaterThanOrEqual(o_custkey,40)", "EqualTo(o_orderpriority,2-HIGH)", "LessThan(o_orderstatus,P)"),
        "distance_selected": ("EqualTo(label,3)",),
        "point_get": ("EqualTo(event_id,77)",),
    }
    for name, filters in pushed.items():
        assert all(f in plan(name).partition("PushedFilters")[2] for f in filters), name
    # no order of all rows in one task: only the partitions' counts meet in one
    for name in ("order_stable", "seq_monotone", "dictionary_encode", "order_remaining"):
        assert all("specifiedwindowframe(RowFrame, unboundedpreceding$(), -1)" in line and "[part#" in line for line in plan(name).splitlines() if "- Window [" in line), name
    scan = plan("group_dense")
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string,l_shipdate:" in scan and scan.count("Exchange") <= 2
    assert plan("join_match_count").count("partial_") >= 2
    assert not any("CartesianProduct" in plan(n) for n in q.ORACLES if n.startswith(("join_", "set_")))
