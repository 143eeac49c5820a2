"""Operators against literal results and scalar loops."""

import math
import os
import random
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from basaltine.functions import bits, fused, text
from basaltine.operators import aggregate, graph, join, matrix, order, predicates, sequence, sets, sketch, validate, vector
from basaltine.plans import pages


def frame(spark, data, ddl):
    return spark.createDataFrame(data, ddl)


@pytest.mark.parametrize("n", [0, 1, 3, 31, 32, 33, 127, 255, 256, 257, 511, 777])
def test_half_open_ranges(spark, n):
    rng = random.Random(n)
    values = [None if rng.random() < 0.1 else rng.randrange(-1000, 1000) for _ in range(n)]
    df = frame(spark, list(enumerate(values)), "i long, v int")
    for low, high in ((0, 0), (-(1 << 31), (1 << 31) - 1), (-(1 << 53) + 1, (1 << 53) - 1), (-50, 50)):
        want = [v for v in values if v is not None and low <= v < high]
        got = aggregate.range_aggregate(df, "v", low, high).first()
        assert tuple(got) == (len(want), sum(want))


def test_masks_are_two_valued(spark):
    rng = random.Random(22)
    values = [None if rng.random() < 0.2 else rng.randrange(50) for _ in range(407)]
    df = frame(spark, list(enumerate(values)), "i long, v int")
    count = lambda m: df.agg(F.count_if(m)).first()[0]
    low, odd = predicates.lt("v", 20), F.col("v") % 2 == 1
    is_low, is_odd = [v is not None and v < 20 for v in values], [v is not None and v % 2 == 1 for v in values]
    pairs = list(zip(is_low, is_odd, strict=True))
    assert count(predicates.and_not(low, odd)) == sum(a and not b for a, b in pairs)
    assert count(predicates.invert(low)) == is_low.count(False) and count(predicates.any_of(low, odd)) == sum(a or b for a, b in pairs)
    assert count(predicates.all_of(low, odd)) == sum(a and b for a, b in pairs)


def test_nullable_group_states(spark, rows):
    rng = random.Random(21)
    data = [(rng.choice([0, 3, 40, 2**31, 2**32 - 1]), None if rng.random() < 0.3 else rng.randrange(-90, 90)) for _ in range(170)]
    got = {r[0]: tuple(r)[1:] for r in aggregate.group_sparse(frame(spark, data, "k long, v int"), "k", "v").collect()}
    assert set(got) == {k for k, _ in data}
    for key, state in got.items():
        all_, some = [v for k, v in data if k == key], [v for k, v in data if k == key and v is not None]
        assert state == (len(some), len(all_) - len(some), sum(some), min(some), max(some), sum(some) / len(some))
    empty = aggregate.group_sparse(frame(spark, [(1, None)], "k long, v int"), "k", "v").first()
    assert tuple(empty) == (1, 0, 1, 0, None, None, None)


def test_dense_groups_stay_in_range(spark):
    df = frame(spark, [(i, (i * 31) % 257 - 128, i % 7) for i in range(1037)], "f int, v int, g int")
    got = {r["g"]: tuple(r)[1:] for r in aggregate.group_dense(df, "f", "v", "g", 300, 340, 8).collect()}
    for g in range(7):
        vs = [(i * 31) % 257 - 128 for i in range(300, 340) if i % 7 == g]
        assert got[g] == (len(vs), sum(vs), min(vs), max(vs))
    assert 7 not in got
    with pytest.raises(Exception, match="out of range"):
        aggregate.group_dense(df, "f", "v", "g", 300, 340, 3).collect()


def test_page_estimate(spark):
    table = pages.page_table(spark.range(1024).select("id", F.col("id").cast("int").alias("v")), "id", "v", 128)
    assert tuple(pages.estimate(table, 300, 340).first()) == (1, 7, 128)
    assert tuple(pages.estimate(table, 5, 5).first()) == (0, 8, 0)


def test_join_pairs(spark, rows):
    rng = random.Random(23)
    left, right = ([(None if rng.random() < 0.1 else rng.randrange(12), n) for n in range(size)] for size in (40, 25))
    probe, build = frame(spark, left, "k long, p long"), frame(spark, right, "k long, b long")
    pairs = join.row_id_pairs(probe, build, "k", "p", "b")
    want = sorted((p, b) for k, p in left for j, b in right if k is not None and k == j)
    assert rows(pairs) == want and join.match_count(probe, build, "k").first()[0] == len(want)
    assert tuple(join.build_facts(build, "k").first()) == (len(right), len({k for k, _ in right if k is not None}))
    written, facts = join.capped_pairs(pairs, 9)
    assert rows(written) == want[:9] and tuple(facts.first()) == (len(want), 9, True)
    with pytest.raises(Exception, match="repeated"):
        join.lookup(frame(spark, [(1,)], "k long"), frame(spark, [(1, 2), (1, 3)], "k long, v long"), "k", "v").collect()


def test_order_is_stable(spark):
    rng = random.Random(24)
    data = [(i, rng.randrange(30)) for i in range(500)]
    df, want = frame(spark, data, "i long, k long"), sorted((k, i) for i, k in data)
    assert [tuple(r) for r in order.stable_order(df, "k", "i").collect()] == want
    assert sorted(tuple(r) for r in order.order_positions(df.repartition(5), "k", "i").collect()) == [(k, i, n) for n, (k, i) in enumerate(want)]
    with pytest.raises(Exception, match="null"):
        order.stable_order(frame(spark, [(0, None)], "i long, k long"), "k", "i").collect()


def test_sets(spark, rows):
    rng = random.Random(5)
    a, b = ({rng.randrange(300) for _ in range(120)} for _ in range(2))
    x, y = (frame(spark, [(v,) for v in s], "value long") for s in (a, b))
    assert [r[0] for r in rows(sets.symmetric_difference(x, y))] == sorted(a ^ b)
    c = sets.cardinalities(x, y).first().asDict()
    assert (c["and_size"], c["or_size"], c["jaccard"]) == (len(a & b), len(a | b), len(a & b) / len(a | b))
    runs = []
    for v in sorted(a):
        if runs and runs[-1][1] == v - 1:
            runs[-1][1] = v
        else:
            runs.append([v, v])
    assert rows(sets.ranges(x, span=16)) == [tuple(r) for r in runs]
    none = frame(spark, [], "value long")
    assert sets.cardinalities(none, none).first()["jaccard"] == 1.0


def test_distinct_sketch_merges_and_estimates(spark, rows):
    df = spark.range(20_000).select((F.col("id") * 2654435761 % (1 << 32)).alias("v"))
    whole = sketch.distinct_state(sketch.distinct_ranks(df, "v", 11))
    halves = [sketch.distinct_state(sketch.distinct_ranks(df.where(f"v % 2 = {k}"), "v", 11)) for k in (0, 1)]
    assert rows(sketch.merge_states(halves[0].unionAll(halves[1]))) == rows(whole)
    assert abs(sketch.estimate(whole, 11) / 20_000 - 1) < 0.08
    assert sketch.estimate(whole.limit(0), 11) == 0.0
    few = sketch.distinct_state(sketch.distinct_ranks(df.limit(50), "v", 11))
    assert abs(sketch.estimate(few, 11) - 50) < 5


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(0, 2000, 2).select(F.col("id").alias("v"))
    bloom = sketch.bloom_filter(keys, "v", 256)
    found = sketch.may_contain(spark.range(2000).select(F.col("id").alias("v")), "v", bloom, 256)
    assert found.where("v % 2 = 0 and not maybe").count() == 0
    assert found.where("v % 2 = 1 and maybe").count() < 100


def test_mix_is_modular(spark):
    def mix(v):
        v = ((v ^ v >> 16) * 0x7FEB352D) & 0xFFFFFFFF
        v = ((v ^ v >> 15) * 0x846CA68B) & 0xFFFFFFFF
        return v ^ v >> 16

    values = [0, 1, 2, 65535, 1 << 31, (1 << 32) - 1, 123456789]
    got = frame(spark, [(v,) for v in values], "v long").select(bits.mix32(F.col("v"))).collect()
    assert [r[0] for r in got] == [mix(v) for v in values]


def test_sequences(spark):
    seq = frame(spark, list(enumerate([3, 1, 4, 1, 5, 9])), "pos long, value long")
    assert sequence.rank(seq, 1, 6).first()[0] == 2 and sequence.range_frequency(seq, 0, 6, 1, 5).first()[0] == 4
    assert sequence.quantile(seq, 0, 6, 3).first()[0] == 4 and sequence.predecessor(seq, 0, 6, 4).first()[0] == 3
    assert sequence.select(seq, 1, 1).first()[0] == 3 and sequence.select(seq, 1, 2).first()[0] == -1
    ones = frame(spark, [(1, 1), (10, 1), (999_999, 1), (2, 0)], "pos long, value long")
    assert tuple(sequence.neighbours(ones, 1, 11).first()) == (999_999, 10)
    with pytest.raises(ValueError):
        sequence.range_frequency(seq, 0, 6, 5, 1)
    assert not sequence.is_monotone(seq, "pos", "value").first()[0]
    rng = random.Random(25)
    values = [rng.randrange(20) for _ in range(300)]
    many, before = frame(spark, list(enumerate(values)), "pos long, value long"), sequence.SPAN
    sequence.SPAN = 64  # several spans
    try:
        asked = [(n, rng.randrange(22), rng.randrange(0, 310)) for n in range(60)]
        found = {r["query"]: r["rank"] for r in sequence.rank_many(many, frame(spark, asked, "query int, value long, end long")).collect()}
        assert found == {n: values[:end].count(v) for n, v, end in asked}
        spans = [(n, a, a + rng.randrange(0, 150), rng.randrange(100)) for n, a in enumerate(rng.sample(range(290), 30))]
        found = {r["query"]: r["quantile"] for r in sequence.quantile_many(many, frame(spark, spans, "query int, left long, right long, k long")).collect()}
        assert found == {n: (sorted(values[a:b])[k] if k < len(values[a:b]) else -1) for n, a, b, k in spans}
        assert sequence.inversions(many, "pos", "value").first()[0] == sum(a > b for a, b in zip(values, values[1:], strict=False))
        up = frame(spark, [(k, k // 3) for k in range(300)], "pos long, value long")
        assert sequence.is_monotone(up, "pos", "value").first()[0] and not sequence.is_monotone(up, "pos", "value", strict=True).first()[0]
    finally:
        sequence.SPAN = before


def test_texts(spark, rows):
    df = frame(spark, [(0, "banana"), (1, "left:right"), (2, "é"), (3, "")], "i long, t string")
    t = F.col("t")
    got = df.select(text.count_overlapping(t, "ana"), text.count_overlapping(t, ""), text.index_of(t, ":"), text.last_index_of(t, "a"), text.index_of_non_ascii(t)).collect()
    assert tuple(got[0]) == (2, 7, -1, 5, -1) and got[1][2] == 4 and got[2][4] == 0 and tuple(got[3]) == (0, 1, -1, -1, -1)
    assert rows(text.locate_all(df, "i", "t", "ana")) == [(0, 1), (0, 3)]
    data = frame(spark, [(b"\x12\x23\x23",)], "d binary")
    assert data.select(text.index_of_byte(F.col("d"), 0x23), text.index_of_byte(F.col("d"), 0x22), text.index_of_byte(F.col("d"), 0x23, 2)).first() == (1, -1, 2)
    rng = random.Random(26)
    raw = bytes(rng.choice([0, 1, 2, 1, 255]) for _ in range(200))
    d, one = F.col("d"), frame(spark, [(raw,)], "d binary")
    for needle in (b"", raw[5:7], raw[100:103], b"\xff\x01", b"\x07", b"\x00\x00"):
        found = one.select(text.index_of_bytes(d, needle), text.index_of_bytes(d, needle, 20), text.index_of_bytes(d, needle, 20, 120), text.last_index_of_bytes(d, needle), text.last_index_of_bytes(d, needle, 90)).first()
        assert tuple(found) == (raw.find(needle), raw.find(needle, 20), raw.find(needle, 20, 120), raw.rfind(needle), raw.rfind(needle, 0, 90))
    assert frame(spark, [("a😀b\\Ec",)], "t string").select(text.index_of_utf16(t, "b"), text.index_of_utf16(t, ""), text.index_of_utf16(t, "z")).first() == (3, 0, -1)
    asked = frame(spark, [(1, "ana"), (2, "\\E"), (3, "none")], "query int, pattern string")
    assert rows(text.count_many(frame(spark, [("banana \\E",), ("ana",), (None,)], "t string"), "t", asked)) == [(1, 3), (2, 1), (3, 0)]
    word = frame(spark, [(bytes([1, 0, 0, 0, 255, 255, 255, 255]),)], "d binary")
    assert word.select(bits.decode_u32(F.col("d"))).first()[0] == [1, (1 << 32) - 1]


def test_vectors(spark, rows):
    rng = random.Random(3)
    data = [(i, [rng.uniform(-1, 1) for _ in range(40)]) for i in range(300)]
    df, q = frame(spark, data, "id long, v array<float>"), [rng.uniform(-1, 1) for _ in range(40)]
    exact = sorted(data, key=lambda r: (sum((a - b) ** 2 for a, b in zip(r[1], q, strict=True)), r[0]))[:7]
    want = [r[0] for r in exact]
    assert [r[0] for r in vector.nearest(df, "v", "id", q, 7).collect()] == want
    assert [r[0] for r in vector.pruned_nearest(df, vector.block_bounds(df, "v", "id", 16), "v", "id", q, 7, 16).collect()] == want
    assert [r[0] for r in vector.rerank(df, "v", "id", q, 7, 300).collect()] == want
    signs = sorted((sum((a > 0) != (b > 0) for a, b in zip(v, q, strict=True)), i) for i, v in data)[:5]
    assert [tuple(r) for r in vector.nearest_hamming(df, "v", "id", q, 5).collect()] == [(i, d) for d, i in signs]
    zero = frame(spark, [(0, [0.0], [1.0])], "id long, a array<double>, b array<double>")
    assert math.isnan(zero.select(vector.cosine(F.col("a"), F.col("b"))).first()[0])
    with pytest.raises(ValueError):
        vector.check_range(3, 3)
    with pytest.raises(Exception, match="length"):
        vector.nearest(df, "v", "id", q[:3], 2).collect()


@pytest.mark.parametrize("kind", ["l2", "ip", "l1"])
def test_many_queries_in_blocks(spark, rows, monkeypatch, kind):
    """Copies, ties, nulls, NaN, infinities and lengths beyond any bound rank as by scores of one pair at a time."""
    rng = random.Random(9)
    draws = (lambda: float(rng.randrange(3)), lambda: rng.gauss(0, 1), lambda: 1 + rng.randrange(4) * 2.0**-52, lambda: rng.choice([1e200, 1e-170, 1e8]) * rng.gauss(0, 1))
    data = [[rng.choice(draws)() for _ in range(4)] if n % 3 else [draws[n % 4]() for _ in range(4)] for n in range(150)]
    data += [[1.0, odd, -0.0, 2.0] for odd in (math.nan, math.inf, -math.inf, None)] + [rng.choice(data) for _ in range(50)]
    df = frame(spark, list(enumerate(data)), "id long, v array<double>").repartition(3)

    def score(x, y):
        total = 0.0
        for a, b in zip(x, y, strict=True):
            if a is None or b is None:
                return None
            total += a * b if kind == "ip" else abs(a - b) if kind == "l1" else (a - b) * (a - b)
        return total

    def order(s):
        return (0, 0.0) if s is None else (2, 0.0) if math.isnan(s) else (1, -s if kind == "ip" else s)

    asked = [n for n in range(len(data)) if n % 5 == 0 or 150 <= n < 154]
    want = [(q, n, place + 1) for q in asked for place, n in enumerate(sorted(range(len(data)), key=lambda n: (order(score(data[n], data[q])), n))[:6])]
    queries = df.where(F.col("id").isin(asked)).select(F.col("id").alias("query"), F.col("v").alias("wanted"))
    for block, chunk, held, packed in ((1024, 8192, 1 << 21, 1 << 22), (5, 40, 200, 1 << 22), (1024, 8192, 200, 100)):
        monkeypatch.setattr(vector, "BLOCK", block)
        monkeypatch.setattr(vector, "CHUNK", chunk)
        monkeypatch.setattr(vector, "HELD", held)
        monkeypatch.setattr(vector, "PACKED", packed)
        found = vector.nearest_many(df, "v", "id", queries, 6, kind)
        assert rows(found.select("query", "id", "rank")) == sorted(want)
    assert all(repr(r["score"]) == repr(score(data[r["id"]], data[r["query"]])) for r in found.collect())
    with pytest.raises(Exception, match="length"):
        vector.nearest_many(df, "v", "id", queries.withColumn("wanted", F.slice("wanted", 1, 3)), 6, kind).collect()


def test_many_queries_at_size(spark):
    """Eight million pairs are a matrix product, not an expression a pair, and no side of the meeting is broadcast."""
    df = spark.range(20_000).select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda d: (F.pmod(F.xxhash64("id", d), F.lit(2001)) / 1000 - 1).cast("float")).alias("v"))
    found = vector.nearest_many(df, "v", "id", df.where("id % 50 = 0").select(F.col("id").alias("query"), F.col("v").alias("wanted")), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Broadcast" not in plan
    start = time.monotonic()
    assert {r["query"]: r["id"] for r in found.where("rank = 1").collect()} == {n: n for n in range(0, 20_000, 50)}
    assert time.monotonic() - start < 30


def test_batched_product(spark, rows):
    cells = lambda m: [(b, i, j, float(v)) for b, part in enumerate(m) for i, row in enumerate(part) for j, v in enumerate(row)]
    a = frame(spark, cells([[[1, 2], [3, 4]], [[1, 0], [0, 1]]]), "b int, i int, j int, v double")
    c = frame(spark, cells([[[5, 6], [7, 8]], [[2, 6], [9, 7]]]), "b int, i int, j int, v double")
    assert [r[3] for r in rows(matrix.multiply(a, c))] == [19, 22, 43, 50, 2, 6, 9, 7]
    only = a.where("b = 0")
    assert matrix.get(only, 1, 0).first()[0] == 3 and matrix.get(only, 7, 7).first()[0] == 0
    assert [r[3] for r in rows(matrix.with_cells(only, frame(spark, [(0, 1, 0, 9.0), (0, 5, 5, 1.0)], "b int, i int, j int, v double")))] == [1, 2, 9, 4, 1]
    assert [r[3] for r in rows(matrix.add(only, matrix.scale(matrix.transpose(only), 2.0)))] == [3, 8, 7, 12] and {r[3] for r in rows(matrix.filled(only, 2.0))} == {2.0}
    assert rows(matrix.row_positions(a.where("v > 1"), 0)) == [(1,)]
    assert rows(matrix.row_ones(matrix.boolean(a.where("b = 1 and v > 0")))) == [(0, 1), (1, 1)]


def test_fused_expression_and_bounds(spark):
    df = frame(spark, [(1.5, -2.0)], "x double, y double")
    tree = fused.relu(fused.add(fused.multiply(fused.input_(0), fused.constant(2)), fused.absolute(fused.input_(1))))
    assert df.select(fused.compile_(tree, F.col("x"), F.col("y"))).first()[0] == 5.0
    deep = fused.input_(0)
    for _ in range(70):
        deep = fused.absolute(deep)
    with pytest.raises(ValueError):
        fused.compile_(deep, F.col("x"))


def test_validation(spark):
    df = frame(spark, [(0, 1.0), (1, float("nan")), (2, None), (3, 9.0)], "i long, v double")
    assert tuple(validate.check_column(df, "v", "i", "f64", 0, 5).first()) == (False, 3, 1)
    assert tuple(validate.check_column(df.where("i = 0"), "v", "i", "f64", 0, 5).first()) == (True, 0, -1)
    assert validate.bounds("i32", 1.2, 3.7) == (2, 3)
    low, high = validate.bounds("f32", 0.1, 0.1)
    assert low > 0.1 and high < 0.1
    # 0.1 is no single-precision number: a double of that value is within, the nearest single is not
    assert [df.where("i = 0").select(validate.invalid(F.lit(0.1).cast(kind), "f32", 0.1, 0.1)).first()[0] for kind in ("double", "float")] == [False, True]
    rule = validate.rule_of({"type": "object", "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "items": {"type": "string", "maxLength": 2}}}, "required": ["a"]})
    texts = ['{"a": 2, "b": ["x", "yé"]}', '{"a": 0}', '{"b": []}', '{"a": 1}', "oops", '{"a": 3, "b": ["long"]}']
    found = validate.check_json(frame(spark, [(t,) for t in texts], "t string"), "t", "a double, b array<string>", rule).collect()
    assert [r["valid"] for r in found] == [True, False, False, True, False, False]
    with pytest.raises(validate.UnsupportedSchema):
        validate.rule_of({"type": "string", "pattern": "x"})
    for refused in ({"type": "object", "additionalProperties": False}, {"type": "array", "minLength": 1}, {"type": "string", "minimum": 0}):
        with pytest.raises(validate.UnsupportedSchema):
            validate.rule_of(refused)
    row = frame(spark, [(1, [("x", 5), (None, 70)]), (None, None)], "a int, b array<struct<c: string, d: int>>")
    inner = {"type": "object", "properties": {"c": {"type": "string"}, "d": {"type": "integer", "maximum": 9}}, "required": ["c", "d"]}
    rule = validate.rule_of({"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": inner}}, "required": ["a"]})
    found = row.select(validate.issues(F.struct("a", "b"), rule).alias("i")).collect()
    assert [[(x["code"], x["path"]) for x in r["i"]] for r in found] == [[("type", "b[1].c"), ("range", "b[1].d")], [("type", "a")]]


def test_searches_on_grids_need_no_package_on_the_workers(spark, tmp_path):
    """A session that is started elsewhere: its Python workers cannot import this package."""
    root = Path(__file__).resolve().parents[1]
    code = f"import sys; sys.path.insert(0, {str(root)!r})\nfrom basaltine.operators import graph\nfrom basaltine.session import local_session\ns = local_session(1, '512m', 1)\n"
    code += "print(graph.grid_paths(s.createDataFrame([(1, 'S.G')], 'grid long, cells string')).first()['steps'])"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")})
    assert done.stdout.split()[-1:] == ["2"], done.stderr[-500:]


def test_paths(spark, rows):
    edges = frame(spark, [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0), (2, 3, 1.0), (9, 8, 1.0)], "src long, dst long, weight double")
    found = graph.shortest_distances(edges, 0)
    assert {r["node"]: r["distance"] for r in found.collect()} == {0: 0.0, 1: 1.0, 2: 2.0, 3: 3.0}
    assert graph.shortest_path(found, 3) == [0, 1, 2, 3] and graph.shortest_path(found, 8) == []
    grids = frame(spark, [(1, "S.#\n..#\n#.G"), (2, "S#G")], "grid long, cells string")
    assert {r["grid"]: (r["steps"], len(r["path"])) for r in graph.grid_paths(grids).collect()} == {1: (4, 5), 2: (-1, 0)}


def test_as_of_and_intervals(spark, rows):
    left = frame(spark, [(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = frame(spark, [(1, 2, 20), (1, 5, 50), (2, 10, 99)], "k int, t int, v int")
    assert rows(join.as_of(left, right, "k", "t", "v")) == [(1, 1, None), (1, 5, 50), (2, 9, None)]
    points, spans = frame(spark, [(1,), (5,), (9,)], "t int"), frame(spark, [(0, 5, "a"), (4, 10, "b"), (7, 7, "c")], "a int, b int, n string")
    assert rows(join.interval_join(points, spans, "t", "a", "b", 4).select("t", "n")) == [(1, "a"), (5, "b"), (9, "b")]
