"""The engine's own queries by name, each beside DuckDB SQL with the same result.

Amounts are cents and days are numbers since 1970-01-01, so that sums are exact in any order.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltine.functions import bits, fused, text
from basaltine.operators import aggregate, graph, join, matrix, order, predicates, sequence, sets, sketch, validate, vector
from basaltine.plans import pages
from basaltine.plans.query import query as stored_query
from basaltine.plans.query import query_rows
from basaltine.schema import TableDef, i32, string, u8, u32
from basaltine.sources.scratch import new_folder
from basaltine.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def _day(c: str) -> Column:
    return F.unix_date(F.to_date(c))


def _row(df: DataFrame) -> Column:
    return F.col("l_orderkey") * 8 + F.col("l_linenumber")


DAY = "date_diff('day', DATE '1970-01-01', {}::DATE)"
ROW = "l_orderkey * 8 + l_linenumber"

# range aggregates and group-bys


@query("SELECT count(*) AS count, coalesce(sum(l_quantity::INT), 0)::BIGINT AS sum FROM lineitem WHERE l_quantity::INT >= 10 AND l_quantity::INT < 20")
def range_aggregate(spark, sf):
    return aggregate.range_aggregate(_table(spark, sf, "lineitem"), "l_quantity", 10, 20)


@query("SELECT 0::BIGINT AS count, 0::BIGINT AS sum")
def range_aggregate_empty(spark, sf):
    return aggregate.range_aggregate(_table(spark, sf, "lineitem"), "l_quantity", 20, 20)


@query(f"""SELECT (ascii(l_returnflag) - 65)::INT AS grp, count(*) AS count, sum(round(l_extendedprice * 100))::BIGINT AS sum,
 min(round(l_extendedprice * 100))::BIGINT AS min, max(round(l_extendedprice * 100))::BIGINT AS max
 FROM lineitem WHERE {DAY.format("l_shipdate")} >= 9000 AND {DAY.format("l_shipdate")} < 10200 GROUP BY 1""")
def group_dense(spark, sf):
    rows = _table(spark, sf, "lineitem").select("l_shipdate", _cents("l_extendedprice").alias("v"), (F.ascii("l_returnflag") - 65).alias("grp"))
    # days as values of the stored column's own type, so that the range reaches the scan
    low, high = (F.lit(str(date(1970, 1, 1) + timedelta(d))).cast(rows.schema["l_shipdate"].dataType) for d in (9000, 10200))
    return aggregate.group_dense(rows, "l_shipdate", "v", "grp", low, high, 32)


@query("""SELECT user_id, count(v) AS count, count(*) - count(v) AS null_count, coalesce(sum(v), 0)::BIGINT AS sum, min(v) AS min, max(v) AS max,
 CASE WHEN count(v) > 0 THEN sum(v)::DOUBLE / count(v) END AS average
 FROM (SELECT user_id, CASE WHEN event_id % 7 <> 0 THEN round(value * 100)::BIGINT END AS v FROM events) GROUP BY user_id""")
def group_sparse_nullable(spark, sf):
    rows = _table(spark, sf, "events").select("user_id", F.when(F.col("event_id") % 7 != 0, _cents("value")).alias("v"))
    return aggregate.group_sparse(rows, "user_id", "v")


@query("""SELECT user_id, count(v) AS count, count(*) - count(v) AS null_count, coalesce(sum(v), 0)::BIGINT AS sum, min(v) AS min, max(v) AS max,
 CASE WHEN count(v) > 0 THEN sum(v)::DOUBLE / count(v) END AS average
 FROM (SELECT event_id, user_id, CASE WHEN event_id % 7 <> 0 THEN round(value * 100)::BIGINT END AS v FROM events) WHERE event_id >= 100 AND event_id < 4000 GROUP BY user_id""")
def group_sparse_filtered(spark, sf):
    rows = _table(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_id") % 7 != 0, _cents("value")).alias("v"))
    return aggregate.group_sparse(rows, "user_id", "v", "event_id", 100, 4000)


@query("""SELECT user_id, count(v) AS count, count(*) - count(v) AS null_count, coalesce(sum(v), 0)::BIGINT AS sum, min(v) AS min, max(v) AS max,
 CASE WHEN count(v) > 0 THEN sum(v)::DOUBLE / count(v) END AS average
 FROM (SELECT user_id, CASE WHEN event_id % 7 <> 0 THEN round(value * 100)::BIGINT END AS v FROM events) GROUP BY user_id""")
def merge_partial_states(spark, sf):
    rows = _table(spark, sf, "events").select("event_type", "user_id", F.when(F.col("event_id") % 7 != 0, _cents("value")).alias("v"))
    return aggregate.merge_states(rows.groupBy("event_type", "user_id").agg(*aggregate.state("v")), "user_id")


@query("""SELECT count(*) AS count_l_quantity, sum(l_quantity::BIGINT)::BIGINT AS sum_l_quantity, min(l_quantity::BIGINT) AS min_l_quantity, max(l_quantity::BIGINT) AS max_l_quantity,
 count(*) AS count_l_suppkey, sum(l_suppkey)::BIGINT AS sum_l_suppkey, min(l_suppkey) AS min_l_suppkey, max(l_suppkey) AS max_l_suppkey
 FROM lineitem WHERE l_partkey >= 100 AND l_partkey < 1500 AND l_linenumber >= 2 AND l_linenumber < 5""")
def masked_multi_measure(spark, sf):
    rows = _table(spark, sf, "lineitem").select("l_partkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("l_quantity"), "l_suppkey")
    return predicates.select_measures(rows, {"l_partkey": (100, 1500), "l_linenumber": (2, 5)}, ["l_quantity", "l_suppkey"])


@query("SELECT b::INT AS bit, (SELECT coalesce(sum((l_partkey >> b::INT) & 1), 0)::BIGINT FROM lineitem) AS ones FROM range(32) AS t(b)")
def bit_positional_count(spark, sf):
    return aggregate.positional_popcount(_table(spark, sf, "lineitem"), "l_partkey")


@query("SELECT floor(o_custkey / 100)::BIGINT AS bucket, count(*) AS count FROM orders GROUP BY 1")
def histogram_buckets(spark, sf):
    return aggregate.histogram(_table(spark, sf, "orders"), "o_custkey", 100)


@query("SELECT l_suppkey, bit_or(l_partkey) AS \"any\", bit_and(l_partkey) AS every, sum(l_partkey)::BIGINT AS total FROM lineitem GROUP BY l_suppkey")
def reduce_shards(spark, sf):
    return aggregate.reduce_words(_table(spark, sf, "lineitem"), "l_suppkey", "l_partkey")


@query("SELECT 'equal' AS against, true AS equal UNION ALL SELECT 'one value', false UNION ALL SELECT 'one row', false")
def columns_equal(spark, sf):
    rows = _table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    other = {"equal": rows.orderBy(F.desc("o_orderkey")), "one value": rows.withColumn("o_custkey", F.when(F.col("o_orderkey") != 17, F.col("o_custkey"))), "one row": rows.where("o_orderkey <> 17")}
    found = [aggregate.same_values(rows, b, "o_orderkey", "o_custkey").select(F.lit(name).alias("against"), "equal") for name, b in other.items()]
    return found[0].unionAll(found[1]).unionAll(found[2])


@query("SELECT sum(o_custkey)::BIGINT AS sum, min(o_custkey) AS min, max(o_custkey) AS max FROM orders")
def column_extremes(spark, sf):
    return aggregate.extremes(_table(spark, sf, "orders"), "o_custkey")


@query("SELECT count(DISTINCT l_partkey) AS n FROM lineitem")
def distinct_exact(spark, sf):
    return _table(spark, sf, "lineitem").agg(F.countDistinct("l_partkey").alias("n"))


# predicates, masks, the query builder

ORDERS = TableDef({"o_orderkey": u32(), "o_custkey": u32(nullable=True), "priority": u8(3), "o_orderstatus": string(nullable=True), "cents": i32()})


def _orders(spark, sf) -> DataFrame:
    custkey = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey"))
    status = F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderstatus"))
    priority = F.substring("o_orderpriority", 1, 1).cast("smallint")
    return _table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderkey", custkey.alias("o_custkey"), priority.alias("priority"), status.alias("o_orderstatus"), _cents("o_totalprice").cast("int").alias("cents"))


ORDERS_SQL = """(SELECT o_orderkey AS row_id, o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS o_custkey, substr(o_orderpriority, 1, 1)::SMALLINT AS priority,
 CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END AS o_orderstatus, round(o_totalprice * 100)::INT AS cents FROM orders)"""


STORED = TableDef({"o_orderkey": u32(), "o_custkey": u32(), "o_orderstatus": string(), "o_orderpriority": string()})


def _stored_orders(spark, sf) -> DataFrame:
    return _table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("SELECT o_orderkey AS row_id, o_custkey, o_orderpriority FROM orders WHERE o_custkey >= 40 AND o_custkey < 700 AND o_orderpriority = '2-HIGH' AND o_orderstatus >= 'G' AND o_orderstatus < 'P'")
def builder_between_eq(spark, sf):
    q = query_rows(STORED, _stored_orders(spark, sf)).where("o_custkey", "between", 40, 700).where("o_orderpriority", "eq", "2-HIGH").where("o_orderstatus", "between", "G", "P")
    return q.select("o_custkey", "o_orderpriority").execute()


@query("SELECT o_orderkey AS row_id, coalesce(o_custkey < 300 AND o_orderstatus = 'O', false) AS selected FROM orders")
def mask_published(spark, sf):
    return query_rows(STORED, _stored_orders(spark, sf)).where("o_custkey", "lt", 300).where("o_orderstatus", "eq", "O").mask()


@query(f"SELECT row_id, o_custkey, cents FROM {ORDERS_SQL} WHERE cents >= 5000000 AND cents < 20000000 AND priority = 2")
def builder_computed_columns(spark, sf):
    return query_rows(ORDERS, _orders(spark, sf)).where("cents", "between", 5_000_000, 20_000_000).where("priority", "eq", 2).select("o_custkey", "cents").execute()


@query(f"SELECT row_id, o_orderstatus FROM {ORDERS_SQL} WHERE o_custkey IS NULL AND o_orderstatus IS NOT NULL")
def builder_null_tests(spark, sf):
    return query_rows(ORDERS, _orders(spark, sf)).where_null("o_custkey").where_not_null("o_orderstatus").select("o_orderstatus").execute()


@query(f"SELECT row_id, o_orderkey, o_custkey, priority, o_orderstatus, cents FROM {ORDERS_SQL} WHERE o_orderstatus >= 'G' AND o_orderstatus < 'P' AND o_custkey < 500")
def builder_string_range(spark, sf):
    return query_rows(ORDERS, _orders(spark, sf)).where("o_orderstatus", "between", "G", "P").where("o_custkey", "lt", 500).execute()


@query(f"SELECT count(*) AS count FROM {ORDERS_SQL} WHERE o_custkey < 4294967296000")
def builder_count_out_of_domain(spark, sf):
    return query_rows(ORDERS, _orders(spark, sf)).where("o_custkey", "lt", 4_294_967_296_000).count()


@query(f"""SELECT count(*) FILTER (coalesce(o_custkey < 300, false) AND NOT coalesce(priority < 3, false)) AS and_not,
 count(*) FILTER (NOT coalesce(o_custkey < 300, false)) AS inverted, count(*) FILTER (coalesce(o_custkey < 300, false) OR coalesce(priority = 1, false)) AS either,
 count(*) FILTER (o_custkey < 300 AND priority = 1) AS both_, count(*) FILTER (priority BETWEEN 2 AND 4) AS inclusive FROM {ORDERS_SQL}""")
def mask_algebra(spark, sf):
    a, b, c = predicates.lt("o_custkey", 300), predicates.lt("priority", 3), predicates.eq("priority", 1)
    return _orders(spark, sf).agg(
        F.count_if(predicates.and_not(a, b)).alias("and_not"), F.count_if(predicates.invert(a)).alias("inverted"), F.count_if(predicates.any_of(a, c)).alias("either"),
        F.count_if(predicates.all_of(a, c)).alias("both_"), F.count_if(predicates.between_inclusive("priority", 2, 4)).alias("inclusive"),
    )


@query(f"SELECT row_id FROM {ORDERS_SQL} WHERE o_custkey >= 100 AND o_custkey < 110")
def mask_positions(spark, sf):
    return predicates.positions(_orders(spark, sf), predicates.between("o_custkey", 100, 110), "row_id")


# joins and lookups


@query(f"SELECT {ROW} AS probe_row_id, o_orderkey AS build_row_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 150000")
def join_rowid_pairs(spark, sf):
    build = _table(spark, sf, "orders").where("o_totalprice > 150000").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("id"))
    probe = _table(spark, sf, "lineitem")
    return join.row_id_pairs(probe.select(F.col("l_orderkey").alias("k"), _row(probe).alias("pid")), build, "k", "pid", "id")


@query("SELECT count(*) AS match_count FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey")
def join_match_count(spark, sf):
    rows = _table(spark, sf, "lineitem").select("l_partkey")
    return join.match_count(rows, rows, "l_partkey")


@query("SELECT count(*) AS build_rows, count(DISTINCT l_partkey) AS distinct_keys FROM lineitem")
def join_build_facts(spark, sf):
    return join.build_facts(_table(spark, sf, "lineitem"), "l_partkey")


@query(f"""SELECT probe_row_id, build_row_id FROM (SELECT o_orderkey AS probe_row_id, {ROW} AS build_row_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
 ORDER BY 1, 2 LIMIT 100""")
def join_truncated(spark, sf):
    build = _table(spark, sf, "lineitem")
    probe = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("pid"))
    return join.capped_pairs(join.row_id_pairs(probe, build.select(F.col("l_orderkey").alias("k"), _row(build).alias("id")), "k", "pid", "id"), 100)[0]


@query("SELECT count(*) AS match_count, least(count(*), 100)::BIGINT AS written, count(*) > 100 AS truncated FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def join_truncation_facts(spark, sf):
    build = _table(spark, sf, "lineitem")
    probe = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("pid"))
    return join.capped_pairs(join.row_id_pairs(probe, build.select(F.col("l_orderkey").alias("k"), _row(build).alias("id")), "k", "pid", "id"), 100)[1]


@query("SELECT o_orderkey, o_custkey, c_nationkey, c_custkey IS NOT NULL AS present FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON o_custkey = c_custkey")
def map_lookup(spark, sf):
    known = _table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return join.lookup(_table(spark, sf, "orders").select("o_orderkey", "o_custkey"), known, "o_custkey", "c_nationkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def semi_membership(spark, sf):
    keys = _table(spark, sf, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return join.members(_table(spark, sf, "orders"), keys, "o_custkey").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def anti_membership(spark, sf):
    keys = _table(spark, sf, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return join.members(_table(spark, sf, "orders"), keys, "o_custkey", absent=True).select("o_orderkey")


@query("SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AS present FROM orders")
def mark_membership(spark, sf):
    keys = _table(spark, sf, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return join.marked(_table(spark, sf, "orders").select("o_orderkey", "o_custkey"), keys, "o_custkey").select("o_orderkey", "present")


@query("""SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY s DESC NULLS LAST) AS n FROM
 (SELECT c_custkey AS k, c_nationkey::BIGINT AS v, NULL AS s FROM customer UNION ALL SELECT o_custkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END, o_orderkey FROM orders)) WHERE n = 1 AND v IS NOT NULL""")
def map_upsert(spark, sf):
    base = _table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("bigint").alias("v"))
    changes = _table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey")).alias("v"), F.col("o_orderkey").alias("s"))
    return join.upsert(base, changes, "k", "v", "s")


@query("""SELECT e.event_id, (SELECT max(f.event_id) FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'purchase' AND f.event_id <= e.event_id) AS v_as_of
 FROM events e WHERE e.event_type IS DISTINCT FROM 'purchase'""")
def join_as_of(spark, sf):
    rows = _table(spark, sf, "events").select("event_id", "user_id", "event_type")
    right = rows.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("at"), F.col("event_id").alias("v"))
    left = rows.where("event_type IS DISTINCT FROM 'purchase'").select("event_id", "user_id", F.col("event_id").alias("at"))
    return join.as_of(left, right, "user_id", "at", "v").select("event_id", "v_as_of")


@query("SELECT e.event_id, s.event_id AS span FROM events e JOIN (SELECT event_id, event_id AS a, event_id + event_id % 40 AS b FROM events) s ON e.event_id >= s.a AND e.event_id < s.b")
def join_interval(spark, sf):
    rows = _table(spark, sf, "events").select("event_id")
    spans = rows.select(F.col("event_id").alias("span"), F.col("event_id").alias("a"), (F.col("event_id") + F.col("event_id") % 40).alias("b"))
    return join.interval_join(rows, spans, "event_id", "a", "b", 64).select("event_id", "span")


@query(ORACLES["join_rowid_pairs"])
def join_prefiltered(spark, sf):
    """The same pairs, the probe side thinned by a Bloom filter of the build side's keys first."""
    build = _table(spark, sf, "orders").where("o_totalprice > 150000").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("id"))
    probe = _table(spark, sf, "lineitem")
    return join.row_id_pairs(sketch.prefiltered(probe.select(F.col("l_orderkey").alias("k"), _row(probe).alias("pid")), "k", build), build, "k", "pid", "id")


SPARSE = "(SELECT event_id AS row_id, CASE WHEN event_id % 7 <> 0 THEN user_id END AS v FROM events)"


@query(f"SELECT event_id AS place, coalesce(v, 0) AS value, (v IS NOT NULL)::INT AS valid FROM events JOIN {SPARSE} ON row_id = event_id - event_id % 10")
def gather_values(spark, sf):
    events = _table(spark, sf, "events")
    rows = events.select(F.col("event_id").alias("row_id"), F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("v"))
    return join.gather(rows, events.select(F.col("event_id").alias("place"), (F.col("event_id") - F.col("event_id") % 10).alias("row_id")), "v")


@query("SELECT user_id, event_type FROM events WHERE event_id = 77")
def point_get(spark, sf):
    return join.point(_table(spark, sf, "events").withColumnRenamed("event_id", "row_id"), 77, "user_id", "event_type")


@query("SELECT p_partkey AS query, p_brand = 'Brand#' || (p_partkey % 50)::VARCHAR AS equal FROM part")
def table_equals_many(spark, sf):
    part = _table(spark, sf, "part")
    asked = part.select(F.col("p_partkey").alias("query"), F.col("p_partkey").alias("id"), F.concat(F.lit("Brand#"), (F.col("p_partkey") % 50).cast("string")).alias("value"))
    return join.equals_many(part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("value")), asked)


# orders and top-k


@query("SELECT o_custkey, row_id, position FROM (SELECT o_custkey, o_orderkey AS row_id, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS position FROM orders) WHERE position >= 100")
def order_remaining(spark, sf):
    return order.in_priority(_table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("row_id")), "o_custkey", "row_id", 100)


@query("SELECT o_custkey, o_orderkey AS row_id, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS position FROM orders")
def order_stable(spark, sf):
    return order.order_positions(_table(spark, sf, "orders"), "o_custkey", "o_orderkey")


@query(f"SELECT {ROW} AS row_id, l_extendedprice AS score FROM lineitem ORDER BY l_extendedprice DESC, 1 LIMIT 20")
def order_top_k(spark, sf):
    rows = _table(spark, sf, "lineitem")
    return order.top_k(rows.select(_row(rows).alias("row_id"), "l_extendedprice"), F.col("l_extendedprice"), "row_id", 20, largest=True).select("row_id", "score")


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def order_top_k_per_group(spark, sf):
    return order.top_k_per_group(_table(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderkey", 3, largest=True).select("o_custkey", "o_orderkey", "rank")


# sets and sketches


def _parts(spark, sf, condition: str) -> DataFrame:
    return _table(spark, sf, "lineitem").where(condition).select("l_partkey")


A, B = "l_quantity < 2 AND l_partkey % 3 <> 0", "l_quantity >= 49 AND l_partkey % 5 <> 0"


@query(f"SELECT l_partkey AS value FROM lineitem WHERE {A} UNION SELECT l_partkey FROM lineitem WHERE {B}")
def set_union(spark, sf):
    return sets.union(_parts(spark, sf, A), _parts(spark, sf, B))


@query(f"SELECT l_partkey AS value FROM lineitem WHERE {A} INTERSECT SELECT l_partkey FROM lineitem WHERE {B}")
def set_intersect(spark, sf):
    return sets.intersect(_parts(spark, sf, A), _parts(spark, sf, B))


@query(f"SELECT l_partkey AS value FROM lineitem WHERE {A} EXCEPT SELECT l_partkey FROM lineitem WHERE {B}")
def set_difference(spark, sf):
    return sets.difference(_parts(spark, sf, A), _parts(spark, sf, B))


@query(f"""(SELECT l_partkey AS value FROM lineitem WHERE {A} EXCEPT SELECT l_partkey FROM lineitem WHERE {B}) UNION
 (SELECT l_partkey AS value FROM lineitem WHERE {B} EXCEPT SELECT l_partkey FROM lineitem WHERE {A})""")
def set_symmetric_difference(spark, sf):
    return sets.symmetric_difference(_parts(spark, sf, A), _parts(spark, sf, B))


@query(f"""SELECT left_size, right_size, and_size, or_size, or_size - and_size AS xor_size, left_size - and_size AS andnot_size, and_size > 0 AS intersects, and_size / or_size AS jaccard FROM
 (SELECT count(*) FILTER (l) AS left_size, count(*) FILTER (r) AS right_size, count(*) FILTER (l AND r) AS and_size, count(*) AS or_size FROM
 (SELECT l_partkey, bool_or({A}) AS l, bool_or({B}) AS r FROM lineitem GROUP BY 1) WHERE l OR r)""")
def set_cardinalities(spark, sf):
    return sets.cardinalities(_parts(spark, sf, A), _parts(spark, sf, B))


@query("""SELECT pair_id, count(r.p) AS size FROM (SELECT unnest([1, 2, 3]) AS pair_id, unnest([1, 2, 3]) AS left_id, unnest([4, 5, 6]) AS right_id)
 LEFT JOIN (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) l ON l.s = left_id
 LEFT JOIN (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) r ON r.s = right_id AND r.p = l.p GROUP BY pair_id""")
def set_pair_intersections(spark, sf):
    every = _table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("value")).distinct()
    pairs = spark.createDataFrame([(1, 1, 4), (2, 2, 5), (3, 3, 6)], "pair_id int, left_id bigint, right_id bigint")
    return sets.pair_intersections(every, pairs)


@query(f"SELECT min(v) AS first, max(v) AS last FROM (SELECT v, v - row_number() OVER (ORDER BY v) AS g FROM (SELECT DISTINCT l_partkey AS v FROM lineitem WHERE {A})) GROUP BY g")
def set_ranges(spark, sf):
    return sets.ranges(_parts(spark, sf, A), span=256)


@query(f"SELECT floor(v / 32)::BIGINT AS word, bit_or((1::BIGINT << (v % 32)::INT)) AS bits FROM (SELECT DISTINCT l_partkey AS v FROM lineitem WHERE {A}) GROUP BY 1")
def set_words(spark, sf):
    return sets.words(_parts(spark, sf, A))


@query(f"SELECT count(DISTINCT l_partkey) AS n FROM lineitem WHERE {A}")
def set_bitmap_count(spark, sf):
    return sets.bitmaps(_parts(spark, sf, A)).agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0).cast("bigint")).alias("n"))


@query("SELECT p_partkey, coalesce(id, -1) AS id FROM part LEFT JOIN (SELECT b, row_number() OVER (ORDER BY b) - 1 AS id FROM (SELECT DISTINCT p_brand AS b FROM part WHERE p_size < 10)) ON p_brand = b")
def dictionary_encode(spark, sf):
    part = _table(spark, sf, "part")
    return sets.encode(part.select("p_partkey", "p_brand"), "p_brand", sets.dictionary(part.where("p_size < 10").select("p_brand"))).select("p_partkey", "id")


@query(f"SELECT l_partkey AS v, true AS maybe FROM lineitem WHERE {A}")
def bloom_no_false_negatives(spark, sf):
    keys = _parts(spark, sf, A).toDF("v")
    return sketch.may_contain(keys, "v", sketch.bloom_filter(keys, "v", 1024), 1024)


@query("""WITH v AS (SELECT DISTINCT l_partkey AS x FROM lineitem),
 s AS (SELECT x, xor(x, 2654435769) AS a, xor(x, 2246822507) AS b FROM v),
 m1 AS (SELECT x, (xor(a, a >> 16)::HUGEINT * 2146121005 % 4294967296)::BIGINT AS a, (xor(b, b >> 16)::HUGEINT * 2146121005 % 4294967296)::BIGINT AS b FROM s),
 m2 AS (SELECT x, (xor(a, a >> 15)::HUGEINT * 2221713035 % 4294967296)::BIGINT AS a, (xor(b, b >> 15)::HUGEINT * 2221713035 % 4294967296)::BIGINT AS b FROM m1),
 m3 AS (SELECT x, xor(a, a >> 16) AS h, xor(b, b >> 16) AS l FROM m2),
 r AS (SELECT h >> 22 AS register, ((h << 10) & 4294967295) | (l >> 22) AS hi, (l << 10) & 4294967295 AS lo FROM m3),
 z AS (SELECT DISTINCT register, 9 + CASE WHEN hi <> 0 THEN 32 - length(bin(hi)) ELSE least(54, 32 + CASE WHEN lo = 0 THEN 32 ELSE 32 - length(bin(lo)) END) END AS rank FROM r),
 t AS (SELECT register, max(rank) AS top, list(rank) AS ranks FROM z GROUP BY register)
 SELECT register, (top * 4 + CASE WHEN list_contains(ranks, top - 1) THEN 2 ELSE 0 END + CASE WHEN list_contains(ranks, top - 2) THEN 1 ELSE 0 END)::BIGINT AS state FROM t""")
def approx_distinct_state(spark, sf):
    return sketch.distinct_state(sketch.distinct_ranks(_table(spark, sf, "lineitem"), "l_partkey", 10))


@query(ORACLES["approx_distinct_state"])
def approx_distinct_merged(spark, sf):
    rows = _table(spark, sf, "lineitem")
    halves = [sketch.distinct_state(sketch.distinct_ranks(rows.where(f"l_orderkey % 2 = {k}"), "l_partkey", 10)) for k in (0, 1)]
    return sketch.merge_states(halves[0].unionAll(halves[1]))


@query("SELECT count(DISTINCT l_partkey) AS n, true AS within FROM lineitem")
def approx_distinct(spark, sf):
    """The exact count, and whether the estimate is within 3 % of it."""
    rows = _table(spark, sf, "lineitem")
    found = sketch.estimate(sketch.distinct_state(sketch.distinct_ranks(rows, "l_partkey", 12)), 12)
    return rows.agg(F.countDistinct("l_partkey").alias("n")).select("n", (F.abs(F.lit(found) / F.col("n") - 1) < 0.03).alias("within"))


# sequences: the events' users in order of event


def _sequence(spark, sf) -> DataFrame:
    return _table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("value"))


@query("SELECT count(*) AS rank FROM events WHERE event_id < 3000 AND user_id = 7")
def seq_rank(spark, sf):
    return sequence.rank(_sequence(spark, sf), 7, 3000)


@query("SELECT coalesce((SELECT event_id FROM events WHERE user_id = 7 ORDER BY event_id LIMIT 1 OFFSET 3), -1) AS \"select\"")
def seq_select(spark, sf):
    return sequence.select(_sequence(spark, sf), 7, 3)


@query("""SELECT query, coalesce(pos, -1) AS "select" FROM (SELECT unnest([0, 1, 2]) AS query, unnest([7, 8, 9]) AS value, unnest([0, 2, 100000]) AS n)
 LEFT JOIN (SELECT event_id AS pos, user_id AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events) ON v = value AND k = n""")
def seq_select_many(spark, sf):
    asked = spark.createDataFrame([(0, 7, 0), (1, 8, 2), (2, 9, 100000)], "query int, value bigint, n bigint")
    return sequence.select_many(_sequence(spark, sf), asked)


@query("SELECT event_id AS pos, user_id AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rank FROM events")
def seq_running_ranks(spark, sf):
    return sequence.running_ranks(_sequence(spark, sf))


@query("SELECT event_id // 100 AS query, user_id AS value FROM events WHERE event_id % 100 = 0")
def seq_access_many(spark, sf):
    rows = _sequence(spark, sf)
    return sequence.access_many(rows, rows.where("pos % 100 = 0").select(F.expr("pos div 100").alias("query"), "pos"))


@query("SELECT count(*) AS count FROM events WHERE event_id >= 100 AND event_id < 3000 AND user_id >= 10 AND user_id < 60")
def seq_range_frequency(spark, sf):
    return sequence.range_frequency(_sequence(spark, sf), 100, 3000, 10, 60)


@query("SELECT coalesce((SELECT user_id FROM events WHERE event_id >= 100 AND event_id < 900 ORDER BY user_id LIMIT 1 OFFSET 350), -1) AS quantile")
def seq_quantile(spark, sf):
    return sequence.quantile(_sequence(spark, sf), 100, 900, 350)


@query("SELECT coalesce(max(user_id), -1) AS predecessor FROM events WHERE event_id >= 100 AND event_id < 900 AND user_id < 42")
def seq_predecessor(spark, sf):
    return sequence.predecessor(_sequence(spark, sf), 100, 900, 42)


@query("SELECT coalesce(min(event_id) FILTER (event_id >= 500), -1) AS next, coalesce(max(event_id) FILTER (event_id <= 500), -1) AS prev FROM events WHERE user_id = 7")
def seq_neighbours(spark, sf):
    return sequence.neighbours(_sequence(spark, sf), 7, 500)


@query("""SELECT count(*) FILTER (k < 777) AS rank, coalesce(min(pos) FILTER (k >= 777), -1) AS lower_bound, coalesce(min(k) FILTER (k >= 777), -1) AS next_geq, coalesce(max(k) FILTER (k < 777), -1) AS predecessor
 FROM (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)""")
def seq_monotone(spark, sf):
    seq = order.order_positions(_table(spark, sf, "orders"), "o_orderkey", "o_orderkey").select(F.col("position").alias("pos"), F.col("o_orderkey").alias("value"))
    return sequence.monotone_queries(seq, 777)


@query("SELECT count(*) FILTER (p > user_id) AS inversions FROM (SELECT user_id, lag(user_id) OVER (ORDER BY event_id) AS p FROM events)")
def seq_inversions(spark, sf):
    rows = _sequence(spark, sf).withColumn("part", F.floor(F.col("pos") / 1000))
    return sequence.inversions(rows, "pos", "value", "part")


@query("SELECT DISTINCT l_partkey AS value FROM lineitem WHERE l_suppkey = 1 AND l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey <> 1) ORDER BY 1 LIMIT 25")
def seq_intersect_lists(spark, sf):
    rows = _table(spark, sf, "lineitem")
    a, b = (rows.where(c).select(F.col("l_partkey").alias("value")).distinct() for c in ("l_suppkey = 1", "l_suppkey <> 1"))
    return sequence.intersect_lists(a, b, 25)


@query("SELECT event_id AS query, rank FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rank FROM events) WHERE event_id % 100 = 0")
def seq_rank_many(spark, sf):
    rows = _sequence(spark, sf)
    return sequence.rank_many(rows, rows.where("pos % 100 = 0").select(F.col("pos").alias("query"), "value", F.col("pos").alias("end")))


@query("SELECT query, user_id AS quantile FROM (SELECT event_id // 1000 AS query, user_id, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY user_id) AS n FROM events) WHERE n = 501")
def seq_quantile_many(spark, sf):
    rows = _sequence(spark, sf)
    spans = rows.where("pos % 1000 = 0")
    return sequence.quantile_many(rows, spans.select(F.expr("pos div 1000").alias("query"), F.col("pos").alias("left"), (F.col("pos") + 1000).alias("right"), F.lit(500).alias("k")))


@query("SELECT count(*) FILTER (p > user_id) = 0 AS monotone FROM (SELECT user_id, lag(user_id) OVER (ORDER BY event_id) AS p FROM events)")
def seq_is_monotone(spark, sf):
    return sequence.is_monotone(_sequence(spark, sf), "pos", "value")


#: A tree whose nodes have two children each while there are customers left, as bits in level order.
TREE = "SELECT c_custkey AS node, CASE WHEN c_custkey = 0 THEN -1 ELSE (c_custkey - 1) // 2 END AS parent FROM customer"


@query(TREE)
def seq_tree_parents(spark, sf):
    """Node k (its number from 0) has the children 2k + 1 and 2k + 2; a list is a 1 per child and a 0."""
    nodes = _table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    n = nodes.count()
    # one root above all: its list is 1, 0; list k ends at place 1 + k + 1 + the children of nodes up to k
    ends = nodes.select(F.lit(0).alias("value"), (F.col("k") + 2 + F.least(2 * F.col("k") + 2, F.lit(n - 1))).alias("pos"))
    ones = nodes.where("k > 0").select(F.lit(1).alias("value"), (F.col("k") + 1 + F.floor((F.col("k") - 1) / 2)).alias("pos"))
    root = spark.range(2).select((1 - F.col("id")).cast("int").alias("value"), F.col("id").alias("pos"))
    return sequence.parents(root.unionByName(ends).unionByName(ones))


# bytes and texts


@query(r"""SELECT doc_id, CASE WHEN contains(text, 'the') THEN strlen(split_part(text, 'the', 1)) ELSE -1 END AS first,
 CASE WHEN contains(text, 'the') THEN strlen(text) - strlen(split_part(reverse(text), 'eht', 1)) - 3 ELSE -1 END AS last,
 CASE WHEN contains(text, 'the') THEN length(split_part(text, 'the', 1)) + length(regexp_replace(split_part(text, 'the', 1), '[^\x{10000}-\x{10FFFF}]', '', 'g')) ELSE -1 END AS units FROM documents""")
def bytes_index_of(spark, sf):
    data = F.col("text").cast("binary")
    found = text.index_of_bytes(data, b"the"), text.last_index_of_bytes(data, b"the"), text.index_of_utf16(F.col("text"), "the")
    return _table(spark, sf, "documents").select("doc_id", *[c.cast("bigint").alias(n) for c, n in zip(found, ("first", "last", "units"), strict=True)])


@query("SELECT query, sum((length(text) - length(replace(text, p, ''))) // length(p))::BIGINT AS count FROM documents, (VALUES (1, 'the'), (2, 'on'), (3, 'e'), (4, 'z.')) v(query, p) GROUP BY query")
def text_count_many(spark, sf):
    patterns = spark.createDataFrame([(1, "the"), (2, "on"), (3, "e"), (4, "z.")], "query int, pattern string")
    return text.count_many(_table(spark, sf, "documents"), "text", patterns)


@query("SELECT doc_id, instr(text, 'the') - 1 AS at, CASE WHEN contains(text, 'e') THEN length(text) - instr(reverse(text), 'e') ELSE -1 END AS last FROM documents")
def text_index_of(spark, sf):
    t = F.col("text")
    return _table(spark, sf, "documents").select("doc_id", text.index_of(t, "the").cast("bigint").alias("at"), text.last_index_of(t, "e").cast("bigint").alias("last"))


@query("SELECT doc_id, coalesce((SELECT min(i) - 1 FROM range(1, length(text) + 1) r(i) WHERE unicode(substr(text, i, 1)) > 127), -1)::BIGINT AS at FROM documents")
def text_non_ascii(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", text.index_of_non_ascii(F.col("text")).cast("bigint").alias("at"))


@query("SELECT doc_id, (SELECT count(*) FROM range(1, length(text) + 1) r(i) WHERE substr(text, i, 3) = 'ana') AS n FROM documents")
def text_count_overlap(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", text.count_overlapping(F.col("text"), "ana").alias("n"))


@query()  # in SQL, a substring of each place of whole texts takes too long
def text_locate(spark, sf):
    return text.locate_all(_table(spark, sf, "documents"), "doc_id", "text", "ana")


@query("""SELECT p_partkey, CASE WHEN p_brand < p_type THEN -1 WHEN p_brand > p_type THEN 1 ELSE 0 END AS cmp,
 CASE WHEN strlen(p_brand) < strlen(p_type) THEN -1 WHEN strlen(p_brand) > strlen(p_type) THEN 1 WHEN p_brand < p_type THEN -1 WHEN p_brand > p_type THEN 1 ELSE 0 END AS shortlex FROM part""")
def text_compare(spark, sf):
    a, b = F.col("p_brand"), F.col("p_type")
    return _table(spark, sf, "part").select("p_partkey", text.compare(a, b).alias("cmp"), text.compare_shortlex(a, b).alias("shortlex"))


@query("SELECT n_nationkey, (256::BIGINT * 256 * 256 * 7 + n_nationkey) AS big, (256::BIGINT * 256 * 256 * n_nationkey + 7) AS little FROM nation")
def decode_words(spark, sf):
    data = F.unhex(F.concat(F.lit("070000"), F.lpad(F.hex(F.col("n_nationkey").cast("bigint")), 2, "0")))
    rows = _table(spark, sf, "nation").select("n_nationkey", data.alias("d"))
    return rows.select("n_nationkey", bits.decode_u32(F.col("d"), True)[0].alias("big"), bits.decode_u32(F.col("d"))[0].alias("little"))


@query(f"SELECT {ROW} AS row_id, greatest(abs(l_quantity::FLOAT * 2::FLOAT + (-50)::FLOAT), 3::FLOAT)::FLOAT AS y FROM lineitem")
def fused_expression(spark, sf):
    rows = _table(spark, sf, "lineitem")
    tree = fused.maximum(fused.absolute(fused.add(fused.multiply(fused.input_(0), fused.constant(2)), fused.constant(-50))), fused.constant(3))
    return rows.select(_row(rows).alias("row_id"), fused.compile_(tree, F.col("l_quantity")).alias("y"))


# vectors

QUERY = [((k * 37) % 17 - 8) / 8 for k in range(64)]
Q = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY) + "]"
VECTORS = "(SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


def _embeddings(spark, sf) -> DataFrame:
    return _table(spark, sf, "embeddings")


@query(f"SELECT vec_id FROM {VECTORS} ORDER BY list_sum(list_transform(list_zip(e, {Q}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), vec_id LIMIT 10")
def topk_l2(spark, sf):
    return vector.nearest(_embeddings(spark, sf), "embedding", "vec_id", QUERY, 10).select("vec_id")


@query(f"SELECT vec_id FROM {VECTORS} ORDER BY list_sum(list_transform(list_zip(e, {Q}), lambda p: p[1] * p[2])) DESC, vec_id LIMIT 10")
def topk_ip(spark, sf):
    return vector.nearest(_embeddings(spark, sf), "embedding", "vec_id", QUERY, 10, "ip").select("vec_id")


@query(f"SELECT vec_id FROM {VECTORS} WHERE label >= 2 AND label < 5 ORDER BY list_sum(list_transform(list_zip(e, {Q}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), vec_id LIMIT 10")
def hybrid_topk(spark, sf):
    vector.check_range(2, 5)
    return vector.hybrid(_embeddings(spark, sf), predicates.between("label", 2, 5), "embedding", "vec_id", QUERY, 10).select("vec_id")


@query(f"""SELECT vec_id, round(list_sum(list_transform(list_zip(e, {Q}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS l2,
 round(list_sum(list_transform(list_zip(e, {Q}), lambda p: abs(p[1] - p[2]))), 6) AS l1, round(list_sum(list_transform(list_zip(e, {Q}), lambda p: p[1] * p[2])), 6) AS ip FROM {VECTORS}""")
def vector_scores(spark, sf):
    rows, q, e = _embeddings(spark, sf), F.array(*map(F.lit, QUERY)), F.col("embedding")
    return rows.select("vec_id", F.round(vector.squared_distance(e, q), 6).alias("l2"), F.round(vector.l1_distance(e, q), 6).alias("l1"), F.round(vector.inner_product(e, q), 6).alias("ip"))


@query(f"""SELECT query, vec_id, rank FROM (SELECT q.vec_id AS query, d.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(list_zip(d.e, q.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), d.vec_id) AS rank
 FROM {VECTORS} d, {VECTORS} q WHERE q.vec_id % 100 = 0) WHERE rank <= 5""")
def topk_batch(spark, sf):
    rows = _embeddings(spark, sf)
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("wanted"))
    return vector.nearest_many(rows, "embedding", "vec_id", asked, 5).select("query", "vec_id", "rank")


@query(f"SELECT vec_id, distance FROM (SELECT vec_id, len(list_filter(list_zip(e, {Q}), lambda p: (p[1] > 0) <> (p[2] > 0)))::BIGINT AS distance FROM {VECTORS}) ORDER BY distance, vec_id LIMIT 10")
def topk_hamming(spark, sf):
    return vector.nearest_hamming(_embeddings(spark, sf), "embedding", "vec_id", QUERY, 10)


@query(f"""WITH h AS (SELECT vec_id, e, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY len(list_filter(list_zip(e, {Q}), lambda p: (p[1] > 0) <> (p[2] > 0))), vec_id) AS n FROM {VECTORS})
 SELECT vec_id FROM h WHERE n <= 40 ORDER BY list_sum(list_transform(list_zip(e, {Q}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), vec_id LIMIT 10""")
def topk_rerank(spark, sf):
    return vector.rerank(_embeddings(spark, sf), "embedding", "vec_id", QUERY, 10, 40, shards=4).select("vec_id")


@query(f"""WITH h AS (SELECT vec_id, e, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY len(list_filter(list_zip(e, {Q}), lambda p: (p[1] > 0) <> (p[2] > 0))), vec_id) AS n FROM {VECTORS} WHERE label >= 2 AND label < 5)
 SELECT vec_id FROM h WHERE n <= 20 ORDER BY list_sum(list_transform(list_zip(e, {Q}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), vec_id LIMIT 10""")
def hybrid_rerank(spark, sf):
    return vector.hybrid_rerank(_embeddings(spark, sf), predicates.between("label", 2, 5), "embedding", "vec_id", QUERY, 10, 20, shards=4).select("vec_id")


@query(f"SELECT vec_id, round(list_sum(list_transform(list_zip(e, {Q}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS score FROM {VECTORS} WHERE label = 3")
def distance_selected(spark, sf):
    found = vector.distance_selected(_embeddings(spark, sf), predicates.eq("label", 3), "embedding", "vec_id", QUERY)
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query(ORACLES["topk_l2"])
def topk_block_pruned(spark, sf):
    rows = _embeddings(spark, sf)
    return vector.pruned_nearest(rows, vector.block_bounds(rows, "embedding", "vec_id"), "embedding", "vec_id", QUERY, 10).select("vec_id")


# matrices: orders by customer and status, as coordinates


def _cells(spark, sf, modulo: int) -> DataFrame:
    rows = _table(spark, sf, "lineitem")
    return rows.groupBy(F.lit(0).alias("b"), (F.col("l_orderkey") % modulo).alias("i"), (F.col("l_suppkey") % modulo).alias("j")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("v"))


CELLS = "(SELECT 0 AS b, l_orderkey % 12 AS i, l_suppkey % 12 AS j, sum(l_quantity::BIGINT)::BIGINT AS v FROM lineitem GROUP BY ALL)"


@query(f"SELECT x.b, x.i, y.j, sum(x.v * y.v)::BIGINT AS v FROM {CELLS} x JOIN {CELLS} y ON x.b = y.b AND x.j = y.i GROUP BY ALL")
def matrix_multiply(spark, sf):
    a = _cells(spark, sf, 12)
    return matrix.multiply(a, a)


@query(f"SELECT x.b, x.i, y.j, least(greatest(sum(x.v * y.v) * 0.5 - 1000.0, 0.0), 5000000.0)::DOUBLE AS v FROM {CELLS} x JOIN {CELLS} y ON x.b = y.b AND x.j = y.i GROUP BY ALL")
def matrix_gemm(spark, sf):
    a = _cells(spark, sf, 12)
    bias = spark.range(12).select(F.col("id").alias("j"), F.lit(-1000.0).alias("w"))
    return matrix.gemm(a, a, alpha=0.5, bias=bias, low=0.0, high=5_000_000.0)


@query(f"SELECT DISTINCT x.i, y.j FROM {CELLS} x JOIN {CELLS} y ON x.j = y.i WHERE x.v > 100 AND y.v > 100")
def matrix_boolean(spark, sf):
    a = matrix.boolean(_cells(spark, sf, 12).where("v > 100"))
    return matrix.boolean_multiply(a, a)


@query("SELECT l_partkey AS pos, CASE WHEN s >= 2147483648 THEN s - 4294967296 ELSE s END::INT AS value FROM (SELECT DISTINCT l_partkey, (l_partkey * 2000000 + l_partkey * 7) & 4294967295 AS s FROM lineitem)")
def i32_add_wrapping(spark, sf):
    keys = _table(spark, sf, "lineitem").select(F.col("l_partkey").alias("pos")).distinct()
    return matrix.elementwise_add_i32(keys.withColumn("value", F.col("pos") * 2_000_000), keys.withColumn("value", F.col("pos") * 7))


# validation


@query("SELECT count(*) FILTER (v IS NULL OR v < 5 OR v > 40) = 0 AS valid, count(*) FILTER (v IS NULL OR v < 5 OR v > 40) AS invalid_count, coalesce(min(event_id) FILTER (v IS NULL OR v < 5 OR v > 40), -1) AS first_invalid FROM (SELECT event_id, CASE WHEN event_id % 50 <> 3 THEN value END AS v FROM events)")
def validate_column(spark, sf):
    rows = _table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 50 != 3, F.col("value")).alias("v"))
    return validate.check_column(rows, "v", "event_id", "f64", 5, 40)


@query("SELECT p_partkey, CASE WHEN NOT (p_size >= 5 AND p_size < 45) THEN 'p_size' WHEN length(p_brand) > 8 THEN 'p_brand' WHEN NOT (p_type IN ('STANDARD', 'PROMO') OR length(p_type) <= 7) THEN 'p_type' END AS issue FROM part")
def validate_rows(spark, sf):
    rules = {
        "p_size": validate.rule_of({"type": "integer", "minimum": 5, "exclusiveMaximum": 45}), "p_brand": validate.rule_of({"type": "string", "maxLength": 8}),
        "p_type": validate.rule_of({"anyOf": [{"enum": ["STANDARD", "PROMO"]}, {"type": "string", "maxLength": 7}]}),
    }
    return _table(spark, sf, "part").select("p_partkey", validate.first_issue(rules).alias("issue"))


@query("""SELECT p_partkey, 'range' AS code, 'size' AS path FROM part WHERE NOT (p_size >= 5 AND p_size < 45)
 UNION ALL SELECT p_partkey, 'type', 'about.brand' FROM part WHERE p_partkey % 9 = 0
 UNION ALL SELECT p_partkey, 'length', 'about.brand' FROM part WHERE p_partkey % 9 <> 0 AND length(p_brand) > 7
 UNION ALL SELECT p_partkey, 'length', 'about.words[' || (i - 1)::VARCHAR || ']' FROM part, unnest(range(1, len(string_split(p_name, ' ')) + 1)) u(i) WHERE length(string_split(p_name, ' ')[i]) > 4""")
def validate_issues(spark, sf):
    rule = validate.rule_of({"type": "object", "required": ["size", "about"], "properties": {
        "size": {"type": "integer", "minimum": 5, "exclusiveMaximum": 45},
        "about": {"type": "object", "required": ["brand", "words"], "properties": {"brand": {"type": "string", "maxLength": 7}, "words": {"type": "array", "items": {"type": "string", "maxLength": 4}}}},
    }})
    about = F.struct(F.when(F.col("p_partkey") % 9 != 0, F.col("p_brand")).alias("brand"), F.split("p_name", " ").alias("words"))
    rows = _table(spark, sf, "part").select("p_partkey", F.struct(F.col("p_size").alias("size"), about.alias("about")).alias("row"))
    return rows.select("p_partkey", F.explode(validate.issues(F.col("row"), rule)).alias("x")).select("p_partkey", "x.code", "x.path")


@query("SELECT p_partkey, p_size < 30 AND p_partkey % 5 <> 0 AS valid FROM part")
def validate_json(spark, sf):
    """Rows as JSON texts, every fifth cut short."""
    part = _table(spark, sf, "part")
    full = F.to_json(F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand")))
    texts = part.select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, full).otherwise(F.substring(full, F.lit(1), F.length(full) - 3)).alias("t"))
    rule = validate.rule_of({"type": "object", "properties": {"size": {"type": "integer", "exclusiveMaximum": 30}, "brand": {"type": "string"}}, "required": ["size", "brand"]})
    return validate.check_json(texts, "t", "size double, brand string", rule).select("p_partkey", "valid")


@query("SELECT 'f32' AS kind, count(*) FILTER (p_retailprice < 950.1 OR p_retailprice > 1400.3) AS invalid_count FROM part UNION ALL SELECT 'u8', count(*) FILTER (p_size < 3 OR p_size > 40) FROM part")
def validate_kinds(spark, sf):
    part = _table(spark, sf, "part")
    f32 = validate.check_column(part, "p_retailprice", "p_partkey", "f32", 950.1, 1400.3).select(F.lit("f32").alias("kind"), "invalid_count")
    return f32.unionAll(validate.check_column(part, "p_size", "p_partkey", "u8", 2.5, 40.5).select(F.lit("u8").alias("kind"), "invalid_count"))


# stored tables

KEPT = {"orders": TableDef({"o_orderkey": u32(), "o_custkey": u32(), "cents": i32(), "status": string(nullable=True)}, 4096)}
KEPT_SQL = "(SELECT o_orderkey AS row_id, o_orderkey, o_custkey, round(o_totalprice * 100)::INT AS cents, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END AS status FROM orders)"


def _kept_orders(spark, sf) -> DataFrame:
    status = F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderstatus"))
    return _table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderkey", "o_custkey", _cents("o_totalprice").cast("int").alias("cents"), status.alias("status"))


def _store(spark, sf) -> Store:
    """The orders in a store of their own."""
    store = Store(spark, new_folder(spark, "store"), KEPT)
    store.replace("orders", _kept_orders(spark, sf))
    return store


def _changed(spark, sf) -> DataFrame:
    """New values of the first row group."""
    return _kept_orders(spark, sf).where("row_id < 4096").select("row_id", (-F.col("o_orderkey")).cast("int").alias("cents"))


@query(f"SELECT row_id, o_orderkey, o_custkey, cents, status FROM {KEPT_SQL}")
def store_scan(spark, sf):
    return _store(spark, sf).table("orders")


@query(f"SELECT row_id, o_custkey, cents FROM {KEPT_SQL} WHERE o_orderkey >= 100 AND o_orderkey < 900 AND status = 'O'")
def store_pruned_query(spark, sf):
    return stored_query(_store(spark, sf), "orders").where("o_orderkey", "between", 100, 900).where("status", "eq", "O").select("o_custkey", "cents").execute()


@query(f"SELECT row_id, o_orderkey, o_custkey, CASE WHEN row_id < 4096 THEN -row_id ELSE cents END::INT AS cents, status FROM {KEPT_SQL}")
def store_update(spark, sf):
    store = _store(spark, sf)
    store.update_row_groups("orders", _changed(spark, sf))
    return store.table("orders")


@query(f"SELECT count(*) AS count, coalesce(sum(o_orderkey), 0)::BIGINT AS sum FROM {KEPT_SQL} WHERE o_orderkey >= 500 AND o_orderkey < 13000")
def store_range_aggregate(spark, sf):
    return _store(spark, sf).range_aggregate("orders", "o_orderkey", 500, 13000)


@query(f"""SELECT count(*) AS row_count, count(*) FILTER (p > o_custkey) AS inversions, min(o_custkey) AS "min", max(o_custkey) AS "max" FROM (SELECT o_custkey, lag(o_custkey) OVER (ORDER BY row_id) AS p FROM {KEPT_SQL})""")
def store_order_facts(spark, sf):
    facts = _store(spark, sf).order_facts("orders", "o_custkey")
    return spark.createDataFrame([tuple(facts[k] for k in ("row_count", "inversions", "min", "max"))], "row_count long, inversions long, min long, max long")


@query(f"SELECT o_orderkey, row_id, row_id AS position FROM {KEPT_SQL}")
def store_order_skips_the_sort(spark, sf):
    return _store(spark, sf).order("orders", "o_orderkey")


@query(f"SELECT row_id, cents, 7::BIGINT AS score, NULL::VARCHAR AS note FROM {KEPT_SQL} WHERE o_custkey < 200")
def store_added_columns(spark, sf):
    store = _store(spark, sf)
    wider = TableDef({**KEPT["orders"].columns, "score": u32(default=7), "note": string(nullable=True)}, 4096)
    return stored_query(Store(spark, store.root, {"orders": wider}), "orders").where("score", "eq", 7).where("o_custkey", "lt", 200).select("cents", "score", "note").execute()


@query(f"SELECT row_id, cents, 'before' AS seen FROM {KEPT_SQL} UNION ALL SELECT row_id, CASE WHEN row_id < 4096 THEN -row_id ELSE cents END::INT, 'after' FROM {KEPT_SQL}")
def store_snapshots(spark, sf):
    """A snapshot that is pinned outlives an update and a vacuum; the new generation is read beside it."""
    store = _store(spark, sf)
    old, _pin = store.snapshot("orders"), store.pin("orders")
    store.update_row_groups("orders", _changed(spark, sf))
    store.vacuum("orders")
    before = store.restore(old).select("row_id", "cents", F.lit("before").alias("seen"))
    return before.unionAll(store.table("orders").select("row_id", "cents", F.lit("after").alias("seen")))


# pages and plans


@query(f"""WITH p AS (SELECT floor(({ROW}) / 4096)::BIGINT AS page, min(l_partkey) AS lo, max(l_partkey) AS hi, count(*) AS n FROM lineitem GROUP BY 1)
 SELECT count(*) FILTER (lo < 30 AND hi >= 10) AS pages_scanned, count(*) FILTER (NOT (lo < 30 AND hi >= 10)) AS pages_skipped, coalesce(sum(n) FILTER (lo < 30 AND hi >= 10), 0)::BIGINT AS rows_scanned FROM p""")
def pages_estimate(spark, sf):
    rows = _table(spark, sf, "lineitem")
    return pages.estimate(pages.page_table(rows.select(_row(rows).alias("row_id"), "l_partkey"), "row_id", "l_partkey", 4096), 10, 30)


@query("SELECT floor(o_orderkey / 1024)::BIGINT AS page, floor(o_orderkey / 1024)::BIGINT * 1024 AS row_offset, count(*) AS row_count, min(o_custkey) AS min, max(o_custkey) AS max, CASE WHEN max(o_custkey) = min(o_custkey) THEN 'constant' WHEN max(o_custkey) - min(o_custkey) < 65536 THEN 'frame-of-reference' ELSE 'raw' END AS encoding FROM orders GROUP BY 1")
def pages_zone_map(spark, sf):
    return pages.page_table(_table(spark, sf, "orders"), "o_orderkey", "o_custkey", 1024)


# graphs: nations tied by their numbers


@query("""WITH RECURSIVE e AS (SELECT n_nationkey::BIGINT AS src, ((n_nationkey * 7 + k * 3) % 25)::BIGINT AS dst, (1 + (n_nationkey + k) % 5)::DOUBLE AS weight FROM nation, range(1, 4) t(k)),
 w(node, distance, hops) AS (SELECT 0::BIGINT, 0.0::DOUBLE, 0 UNION SELECT dst, distance + weight, hops + 1 FROM w JOIN e ON src = node WHERE hops < 8)
 SELECT node, min(distance) AS distance FROM w GROUP BY node""")
def graph_shortest(spark, sf):
    nations = _table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"))
    edges = nations.select("src", ((F.col("src") * 7 + F.col("k") * 3) % 25).cast("bigint").alias("dst"), (1 + (F.col("src") + F.col("k")) % 5).cast("double").alias("weight"))
    return graph.shortest_distances(edges, 0).select("node", "distance")


@query("""WITH RECURSIVE e AS (SELECT n_nationkey::BIGINT AS src, ((n_nationkey * 7 + k * 3) % 25)::BIGINT AS dst, (1 + (n_nationkey + k) % 5)::DOUBLE AS weight FROM nation, range(1, 4) t(k)),
 w(node, distance, hops) AS (SELECT 0::BIGINT, 0.0::DOUBLE, 0 UNION SELECT dst, distance + weight, hops + 1 FROM w JOIN e ON src = node WHERE hops < 8)
 SELECT 0::BIGINT AS first, 13::BIGINT AS last, min(distance) AS length FROM w WHERE node = 13""")
def graph_path(spark, sf):
    """The ends of a shortest path and the sum of the least weights along it."""
    nations = _table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"))
    edges = nations.select("src", ((F.col("src") * 7 + F.col("k") * 3) % 25).cast("bigint").alias("dst"), (1 + (F.col("src") + F.col("k")) % 5).cast("double").alias("weight"))
    path = graph.shortest_path(graph.shortest_distances(edges, 0), 13)
    steps = spark.createDataFrame(list(zip(path, path[1:], strict=False)), "src bigint, dst bigint")
    taken = steps.join(edges, ["src", "dst"]).groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    return taken.agg(F.lit(path[0]).cast("bigint").alias("first"), F.lit(path[-1]).cast("bigint").alias("last"), F.sum("weight").alias("length"))


@query("""WITH RECURSIVE c AS (SELECT n_nationkey::BIGINT AS grid, x, y FROM nation, range(6) a(x), range(6) b(y) WHERE (x = 0 AND y = 0) OR (x = 5 AND y = 5) OR (x * 7 + y * 5 + x * y + n_nationkey * 3) % 4 <> 0),
 w(grid, x, y, steps) AS (SELECT n_nationkey::BIGINT, 0::BIGINT, 0::BIGINT, 0 FROM nation UNION SELECT c.grid, c.x, c.y, w.steps + 1 FROM w JOIN c ON c.grid = w.grid AND abs(c.x - w.x) + abs(c.y - w.y) = 1 WHERE w.steps < 24)
 SELECT n_nationkey::BIGINT AS grid, coalesce(min(steps), -1)::BIGINT AS steps FROM nation LEFT JOIN w ON grid = n_nationkey AND x = 5 AND y = 5 GROUP BY n_nationkey""")
def grid_paths(spark, sf):
    """Steps of a shortest way over a grid of 6 by 6 for each nation."""
    cell = lambda y: F.transform(F.sequence(F.lit(0), F.lit(5)), lambda x: F.when((x == 0) & (y == 0), "S").when((x == 5) & (y == 5), "G").when((x * 7 + y * 5 + x * y + F.col("n_nationkey") * 3) % 4 != 0, ".").otherwise("#"))
    lines = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda y: F.array_join(cell(y), ""))
    grids = _table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("grid"), F.array_join(lines, "\n").alias("cells"))
    return graph.grid_paths(grids).select("grid", "steps")
