"""Stored tables against scalar loops over the same rows: pruning, updates, versions, and what damages them."""

import json
import random
from pathlib import Path

import pytest

from basaltine.operators import aggregate
from basaltine.plans.query import query
from basaltine.schema import TableDef, i32, string, u8, u32
from basaltine.sources import store as stores
from basaltine.sources.store import Store

#: Parcels: a number that rises, a weight in random order, a zone of 4 bits, and a nullable place.
PARCELS = TableDef({"number": u32(), "weight": i32(), "zone": u8(4), "place": string(nullable=True)}, 512)
rng = random.Random(31)
ROWS = [(k, 3 * k + rng.randrange(3), rng.randrange(-9000, 9000), rng.randrange(16), rng.choice(["bay", "dock", "yard", None])) for k in range(2700)]
DDL = "row_id long, number long, weight int, zone smallint, place string"


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path), {"parcels": PARCELS})
    s.replace("parcels", spark.createDataFrame(ROWS, DDL).repartition(7))
    return s


@pytest.mark.parametrize("named", [512, 1])
def test_queries_read_what_may_match(store, rows, monkeypatch, named):
    monkeypatch.setattr(stores, "NAMED", named)
    for low, high in ((0, 50), (1500, 1700), (3000, 7000), (9000, 9001), (40, 40)):
        q = query(store, "parcels").where("number", "between", low, high).where("zone", "lt", 11).select("weight", "place")
        want = [(r[0], r[2], r[4]) for r in ROWS if low <= r[1] < high and r[3] < 11]
        assert rows(q.execute()) == sorted(want, key=lambda t: t[0])
        facts = q.statistics()
        meets = {r[0] // 512 for r in ROWS if low <= r[1] < high}
        assert facts["groups_total"] == 6 and facts["groups_skipped"] == 6 - len(meets) and facts["pages_read"] == len(meets) * 4
        assert facts["rows_matched"] == len(want) and facts["rows_scanned"] == sum(min(512, 2700 - 512 * g) for g in meets) and facts["cache_hits"] == 0
    assert rows(query(store, "parcels").where_null("place").where("weight", "lt", 0).select("zone").execute()) == [(r[0], r[3]) for r in ROWS if r[4] is None and r[2] < 0]
    assert rows(query(store, "parcels").where("place", "between", "c", "e").mask().where("selected").select("row_id")) == [(r[0],) for r in ROWS if r[4] == "dock"]


def test_a_query_is_never_changed_by_another(store):
    heavy = query(store, "parcels").where("weight", "between", 5000, 9000)
    in_bay, elsewhere = heavy.where("place", "eq", "bay"), heavy.where_null("place")
    count = lambda test: sum(1 for r in ROWS if 5000 <= r[2] < 9000 and test(r))
    assert in_bay.count().first()[0] == count(lambda r: r[4] == "bay") and elsewhere.count().first()[0] == count(lambda r: r[4] is None)
    assert heavy.count().first()[0] == count(lambda r: True)


def test_what_a_query_refuses(store):
    q = query(store, "parcels")
    for wrong, error in (
        (lambda: q.where("colour", "eq", 1), KeyError), (lambda: q.select("zone", "weight", "zone"), ValueError), (lambda: q.where("place", "lt", 4), TypeError),
        (lambda: q.where("weight", "eq", 2**53), TypeError), (lambda: q.where("weight", "over", 3), ValueError), (lambda: q.where("weight", "lt", 3, 4), ValueError),
    ):
        with pytest.raises(error):
            wrong()


def test_sums_from_the_zone_map(store):
    for low, high in ((0, 10_000), (700, 5555), (1536, 1537), (9, 9), (-5, 100)):
        inside = [r[1] for r in ROWS if low <= r[1] < high]
        assert tuple(store.range_aggregate("parcels", "number", low, high).first()) == (len(inside), sum(inside))
        assert tuple(store.range_aggregate("parcels", "number", low, high).first()) == tuple(aggregate.range_aggregate(store.table("parcels"), "number", low, high).first())
    weights = [r[2] for r in ROWS if -100 <= r[2] < 4000]
    assert tuple(store.range_aggregate("parcels", "weight", -100, 4000).first()) == (len(weights), sum(weights))
    # groups that lie wholly inside are not read: only the two that the bounds cut
    plan = store.range_aggregate("parcels", "number", 700, 5555)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_group" in plan and "IN (0,3)" in plan.replace(" INSET ", " IN ") or "0,3" in plan
    with pytest.raises(ValueError):
        store.range_aggregate("parcels", "place", 0, 1)


def test_updates_and_generations(spark, store, tmp_path, rows):
    reader = Store(spark, str(tmp_path), {"parcels": PARCELS})
    assert reader.manifest("parcels")["generation"] == 1
    pin, text = reader.pin("parcels"), reader.snapshot("parcels")
    changed = spark.createDataFrame([(k, k % 7) for k in range(1024, 1536)], "row_id long, weight int")
    with pytest.raises(ValueError, match="in part"):
        store.update_row_groups("parcels", changed.where("row_id <> 1100"))
    with pytest.raises(ValueError, match="unknown"):
        store.update_row_groups("parcels", changed.withColumnRenamed("weight", "colour"))
    assert store.update_row_groups("parcels", changed) == 2
    now = [(r[0], r[1], r[0] % 7 if 1024 <= r[0] < 1536 else r[2], *r[3:]) for r in ROWS]
    assert rows(store.table("parcels")) == now and rows(reader.table("parcels")) == ROWS
    # another process's pin holds the old files
    other = Store(spark, str(tmp_path), {"parcels": PARCELS})
    other.vacuum("parcels")
    assert rows(other.restore(text)) == ROWS
    other.release(pin)
    last = spark.createDataFrame([(k, -1) for k in range(2560, 2700)], "row_id long, weight int")
    with pytest.raises(FileExistsError):
        reader.update_row_groups("parcels", last)
    assert reader.refresh("parcels") == 2 and rows(reader.table("parcels")) == now
    reader.replace("parcels", spark.createDataFrame(ROWS[:600], DDL))
    assert reader.vacuum("parcels") >= 2 and rows(reader.table("parcels")) == ROWS[:600]
    assert [p.name for p in (tmp_path / "parcels" / "manifests").glob("*.json")] == ["000000000003.json"]


def test_two_writers_of_one_generation(store):
    manifest = store.manifest("parcels")
    with pytest.raises(FileExistsError):
        store._publish("parcels", manifest)


def test_damaged_manifests(spark, store, tmp_path):
    folder = Path(tmp_path) / "parcels" / "manifests"
    fresh = lambda: Store(spark, str(tmp_path), {"parcels": PARCELS})
    (folder / "000000000002.json").write_text('{"generation": 2, "wri')  # a writer that has not come to its end
    assert fresh().manifest("parcels")["generation"] == 1
    good = json.loads((folder / "000000000001.json").read_text())
    for harm in ({"rows": -1}, {"groups": 99}, {"columns": {}}, {"write": "unknown"}, {"more": 1}):
        (folder / "000000000002.json").write_text(json.dumps(good | harm))
        with pytest.raises(ValueError):
            fresh().manifest("parcels")
    with pytest.raises(ValueError):
        store.restore(json.dumps({"table": "parcels"}))
    with pytest.raises(FileNotFoundError):
        Store(spark, str(tmp_path), {"empty": PARCELS}).table("empty")


def test_columns_that_come_later(spark, store, tmp_path, rows):
    wide = TableDef({**PARCELS.columns, "fee": i32(default=12), "remark": string(nullable=True)}, 512)
    q = query(Store(spark, str(tmp_path), {"parcels": wide}), "parcels").where("fee", "between", 10, 20).where_null("remark").where("zone", "eq", 3)
    assert rows(q.select("fee", "remark", "zone").execute()) == [(r[0], 12, None, 3) for r in ROWS if r[3] == 3]
    assert query(Store(spark, str(tmp_path), {"parcels": wide}), "parcels").where("fee", "eq", 11).statistics()["groups_skipped"] == 6
    for columns in ({"number": u32()}, {**PARCELS.columns, "weight": u32()}, {**PARCELS.columns, "fee": i32()}):
        with pytest.raises(ValueError):
            query(Store(spark, str(tmp_path), {"parcels": TableDef(columns, 512)}), "parcels").count()


def test_order_facts(spark, store, rows):
    facts = store.order_facts("parcels", "number")
    numbers = [r[1] for r in ROWS]
    assert facts == {"row_count": 2700, "ascending": True, "inversions": 0, "min": min(numbers), "max": max(numbers), "range": max(numbers) - min(numbers) + 1, "groups": 6, "first": numbers[0], "last": numbers[-1]}
    assert "Exchange" not in store.order("parcels", "number")._jdf.queryExecution().executedPlan().toString()
    mixed = [rng.randrange(10_000) for _ in range(512)]
    store.update_row_groups("parcels", spark.createDataFrame([(512 + k, v) for k, v in enumerate(mixed)], "row_id long, number long"))
    numbers[512:1024] = mixed
    assert store.order_facts("parcels", "number")["inversions"] == sum(a > b for a, b in zip(numbers, numbers[1:], strict=False))
    want = sorted((n, k) for k, n in enumerate(numbers))
    assert sorted(tuple(r) for r in store.order("parcels", "number").collect()) == [(n, k, p) for p, (n, k) in enumerate(want)]


def test_domains_caches_and_names(spark, store, tmp_path):
    assert store.read_i32("parcels", "weight").count() == 2700
    for column in ("number", "place"):
        with pytest.raises(ValueError):
            store.read_i32("parcels", column)
    store.cache("parcels")
    assert query(store, "parcels").where("zone", "eq", 1).statistics()["cache_hits"] > 0
    store.uncache("parcels")
    with pytest.raises(Exception, match="outside its domain"):
        store.replace("parcels", spark.createDataFrame([(0, 1, 1, 16, None)], DDL))
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path), {"a/b": PARCELS})
    with pytest.raises(ValueError):
        TableDef({"a": i32()}, 500)
    with pytest.raises(ValueError):
        u8(2, default=4)
