"""Joins, aggregates, windows, vectors and the stress shapes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom import streaming
from lakeloom.functions import vectors
from lakeloom.operators import aggregates as agg
from lakeloom.operators import vector, windows
from lakeloom.plans.registry import frame, sql

# --- J: joins ---

sql("flagship", "SELECT c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_mktsegment ORDER BY c_mktsegment")
for _kind in ("INNER", "LEFT", "RIGHT", "FULL"):
    sql(f"j1_{_kind.lower()}_join", f"SELECT c.c_custkey, o.o_orderkey FROM customer c {_kind} JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS o_custkey FROM orders) o ON c.c_custkey = o.o_custkey")
sql("j2_dimension_join", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
sql("j3_theta_join", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("j3_non_equi_join", "SELECT r.r_regionkey, count(*) AS n FROM region r JOIN nation n ON n.n_nationkey > r.r_regionkey * 5 GROUP BY r.r_regionkey")
sql("j4_cross_join", "SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region")
sql("j4_comma_join", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
sql("j5_using", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x JOIN (SELECT c_nationkey AS k, count(*) AS b FROM customer GROUP BY c_nationkey) y USING (k)")
sql("j6_natural", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT s_nationkey AS k, count(*) AS b FROM supplier GROUP BY s_nationkey) y")
sql("j7_lateral", "SELECT n.n_nationkey, t.n_high, t.best FROM nation n, LATERAL (SELECT count(*) AS n_high, max(c.c_acctbal) AS best FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 5000) t")
sql("j7_lateral_top_k", "SELECT n.n_nationkey, t.s_suppkey FROM nation n JOIN LATERAL (SELECT s.s_suppkey FROM supplier s WHERE s.s_nationkey = n.n_nationkey ORDER BY s.s_acctbal DESC NULLS LAST, s.s_suppkey LIMIT 2) t ON TRUE")
sql("j7_lateral_series", "SELECT r_regionkey, g FROM region LATERAL VIEW explode(sequence(0, r_regionkey)) s AS g", "SELECT r_regionkey, CAST(g AS INT) AS g FROM region, LATERAL (SELECT unnest(generate_series(0, r_regionkey)) AS g) s")
sql("j8_multi_join", "SELECT r_name, n_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name, n_name")
sql("j9_join_aggregate", "SELECT s_suppkey, round(sum(l_extendedprice), 2) AS total FROM supplier JOIN lineitem ON s_suppkey = l_suppkey WHERE l_returnflag = 'R' GROUP BY s_suppkey ORDER BY total DESC, s_suppkey LIMIT 20")
sql("j10_semi_join", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
sql("j11_anti_join", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 40)")
sql("j12_self_join", "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate AND a.o_orderkey < b.o_orderkey")

# --- A: aggregation ---

sql("a1_group_by", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, round(avg(l_discount), 6) AS d, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql("a2_scalar", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem")
sql("a3_group_by_expression", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)")
sql("a3_group_by_alias", "SELECT o_custkey % 10 AS bucket, count(*) AS n FROM orders GROUP BY bucket")
sql("a3_group_by_position", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
sql("a4_rollup", "SELECT l_returnflag, l_linestatus, grouping(l_linestatus) AS g, sum(l_quantity) AS q FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)")
sql("a5_cube", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g, grouping(l_linestatus) AS h, sum(l_quantity) AS q FROM lineitem GROUP BY CUBE(l_returnflag, l_linestatus)")
sql("a5_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
sql("a6_filter", "SELECT o_custkey, count(*) FILTER (WHERE o_totalprice > 200000) AS high, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS f FROM orders GROUP BY o_custkey")
sql("a7_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS c, sum(DISTINCT o_custkey % 100) AS s, round(avg(DISTINCT o_custkey % 100), 6) AS a FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS c, CAST(sum(DISTINCT o_custkey % 100) AS BIGINT) AS s, round(avg(DISTINCT o_custkey % 100), 6) AS a FROM orders GROUP BY o_orderpriority")
sql("a8_expressions", "SELECT o_custkey, round(sum(o_totalprice) / count(*), 2) AS mean, coalesce(sum(CASE WHEN o_orderstatus = 'X' THEN 1 END), 0) AS x FROM orders GROUP BY o_custkey", "SELECT o_custkey, round(sum(o_totalprice) / count(*), 2) AS mean, CAST(coalesce(sum(CASE WHEN o_orderstatus = 'X' THEN 1 END), 0) AS BIGINT) AS x FROM orders GROUP BY o_custkey")
sql("af1_count", "SELECT count(*) AS a, count(x) AS b, count(DISTINCT x) AS c FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS x FROM orders) t")
sql("af2_sum", "SELECT sum(p_size) AS i, round(sum(p_retailprice), 2) AS f, sum(CASE WHEN p_size < 0 THEN p_size END) AS none FROM part", "SELECT CAST(sum(p_size) AS BIGINT) AS i, round(sum(p_retailprice), 2) AS f, CAST(sum(CASE WHEN p_size < 0 THEN p_size END) AS BIGINT) AS none FROM part")
sql("af3_avg", "SELECT p_brand, round(avg(p_size), 6) AS a FROM part GROUP BY p_brand")
sql("af4_min_max", "SELECT p_brand, min(p_name) AS a, max(p_name) AS z, min(p_retailprice) AS lo, max(p_size) AS hi FROM part GROUP BY p_brand")


@frame("af5_string_agg", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def _(load, spark):
    return load("nation").groupBy("n_regionkey").agg(agg.string_agg("n_name", ", ", "n_name").alias("names"))


@frame("af6_array_agg", "SELECT n_regionkey, '{' || array_to_string(list_transform(array_agg(CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_name END ORDER BY n_nationkey), lambda x: coalesce(x, 'NULL')), ',') || '}' AS names FROM nation GROUP BY n_regionkey")
def _(load, spark):
    rows = load("nation").withColumn("x", F.expr("CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_name END"))
    return rows.groupBy("n_regionkey").agg(agg.array_text(agg.array_agg("x", "n_nationkey")).alias("names"))


sql("af7_bool", "SELECT l_returnflag, bool_and(l_quantity < 50) AS a, bool_or(l_quantity >= 50) AS o, bool_and(CASE WHEN l_quantity < 0 THEN true END) AS none FROM lineitem GROUP BY l_returnflag")
sql("af8_stddev", "SELECT p_brand, round(stddev_samp(p_size), 6) AS s, round(var_samp(p_size), 6) AS v FROM part GROUP BY p_brand")
sql("af8_stddev_single", "SELECT p_partkey, stddev_samp(p_size) AS s FROM part GROUP BY p_partkey")

# --- W: windows ---

_O = "SELECT o_orderkey, o_custkey, "
sql("w1_row_number", _O + "CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS n FROM orders")
sql("w2_w3_ranks", "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS d FROM part")
sql("w4_ntile", _O + "CAST(ntile(3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS t FROM orders")
sql("w5_w6_distribution", "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS p, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS c FROM part")
sql("w7_lag_lead", _O + "lag(o_orderkey) OVER w AS a, lag(o_orderkey, 2, 0) OVER w AS b, lead(o_totalprice) OVER w AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)", _O + "lag(o_orderkey) OVER w AS a, lag(o_orderkey, 2, 0::BIGINT) OVER w AS b, lead(o_totalprice) OVER w AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
_FULL = "(PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
sql("w8_first_last", _O + f"first_value(o_totalprice) OVER {_FULL} AS a, last_value(o_totalprice) OVER {_FULL} AS z FROM orders")
sql("w9_nth_value", _O + f"nth_value(o_totalprice, 2) OVER {_FULL} AS second FROM orders")
sql("w10_sum_count_avg", _O + "count(*) OVER (PARTITION BY o_custkey) AS n, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS a, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS s FROM orders")


@frame("w11_w12_multi_key", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS BIGINT) AS n FROM lineitem")
def _(load, spark):
    rows = load("lineitem").select("l_returnflag", "l_linestatus", "l_shipdate", "l_orderkey", "l_linenumber")
    out = windows.spread_row_number(rows, ["l_returnflag", "l_linestatus"], "l_shipdate", [F.col("l_orderkey").asc_nulls_last(), F.col("l_linenumber").asc_nulls_last()], descending=True)
    return out.select("l_orderkey", "l_linenumber", "n")


sql("w13_rows_frame", _O + "sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS s, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM orders", _O + "CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM orders")
sql("w14_range_offset", "SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS s FROM part", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS BIGINT) AS s FROM part")


@frame("w15_groups_frame", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM part")
def _(load, spark):
    out = windows.groups_frame(load("part"), ["p_brand"], [F.col("p_size").asc_nulls_last()], -1, 1, s=F.sum("p_size"), n=F.count("*"))
    return out.select("p_partkey", "s", "n")


@frame("w16_exclude_current", "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS s, count(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS n FROM orders")
def _(load, spark):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(-1, 1)
    return load("orders").select("o_orderkey", windows.sum_excluding_current("o_orderkey", w).alias("s"), windows.count_excluding_current("o_orderkey", w).alias("n"))


_WHOLE = "PARTITION BY p_brand ORDER BY p_size ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


@frame("w16_exclude_group_ties", f"SELECT p_partkey, CAST(sum(p_partkey) OVER ({_WHOLE} EXCLUDE GROUP) AS BIGINT) AS g, CAST(sum(p_partkey) OVER ({_WHOLE} EXCLUDE TIES) AS BIGINT) AS t FROM part")
def _(load, spark):
    w = Window.partitionBy("p_brand")
    return load("part").select("p_partkey", windows.sum_excluding_peers("p_partkey", ["p_brand"], ["p_size"], w).alias("g"), windows.sum_excluding_peers("p_partkey", ["p_brand"], ["p_size"], w, True).alias("t"))


sql("w17_running_rows", _O + "round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS s FROM orders")


@frame("w18_window_filter", "SELECT o_orderkey, CAST(sum(o_orderkey) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM orders")
def _(load, spark):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return load("orders").select("o_orderkey", windows.filtered(F.sum, F.col("o_orderkey"), F.col("o_orderstatus") == "F", w).alias("s"))


sql("w19_named_windows", _O + "count(*) OVER a AS n, max(o_totalprice) OVER b AS m FROM orders WINDOW a AS (PARTITION BY o_custkey), b AS (PARTITION BY o_orderpriority)")
sql("w20_window_in_expression", _O + "round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders")
sql("w21_different_windows", "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS BIGINT) AS a, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) AS BIGINT) AS b FROM part")

# --- vectors ---

_QUERY = [round(((i * 37) % 64) / 64 - 0.5, 4) for i in range(64)]
_TEXT = "[" + ", ".join(map(str, _QUERY)) + "]::DOUBLE[]"


@frame("vector_distances", f"SELECT vec_id, round(power(list_distance(embedding::DOUBLE[], {_TEXT}), 2), 4) AS l2, round(list_cosine_distance(embedding::DOUBLE[], {_TEXT}), 6) AS cosine, round(list_negative_inner_product(embedding::DOUBLE[], {_TEXT}), 4) AS ip FROM embeddings")
def _(load, spark):
    v, q = F.col("embedding"), vectors.literal(_QUERY)
    return load("embeddings").select("vec_id", F.round(vectors.l2_squared(v, q), 4).alias("l2"), F.round(vectors.cosine_distance(v, q), 6).alias("cosine"), F.round(vectors.negative_inner_product(v, q), 4).alias("ip"))


@frame("o6_nearest", f"SELECT vec_id FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_TEXT}), vec_id LIMIT 10")
def _(load, spark):
    return vector.nearest(load("embeddings"), "embedding", _QUERY, 10, "l2", ["vec_id"]).select("vec_id")


@frame("o6_nearest_of_each", "SELECT query_id, vec_id, place FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id) AS place FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) t WHERE place <= 3")
def _(load, spark):
    found = vector.nearest_of_each(load("embeddings"), load("embeddings").where("vec_id % 20 = 0"), "embedding", "vec_id", "vec_id", 3)
    return found.select("query_id", "vec_id", F.col("place").cast("long").alias("place"))


# --- stress shapes ---

sql("stress_full_agg", "SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total, round(avg(l_quantity), 4) AS q, min(l_shipdate) AS a, max(l_shipdate) AS z FROM lineitem GROUP BY l_returnflag")
sql("stress_high_card_gb", "SELECT l_partkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_partkey HAVING count(*) > 10 ORDER BY total DESC, l_partkey LIMIT 100")
sql("stress_large_sort", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 1000")
sql("stress_join_2way", "SELECT o_orderpriority, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
sql("stress_join_3way", "SELECT p_brand, s_nationkey, round(sum(l_quantity), 2) AS q FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY p_brand, s_nationkey")
sql("stress_filtered_expr", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 2) AS net FROM lineitem WHERE l_quantity > 25 AND l_discount >= 0.05 ORDER BY net DESC, l_orderkey, l_linenumber LIMIT 500")
sql("stress_window", "SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r FROM orders WHERE o_totalprice > 100000) t WHERE r <= 3")
sql("stress_nested_cte", "WITH a AS (SELECT l_orderkey, sum(l_extendedprice) AS total FROM lineitem GROUP BY l_orderkey), b AS (SELECT o_custkey, count(*) AS n, sum(total) AS total FROM a JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey) SELECT c_mktsegment, sum(n) AS n, round(sum(total), 2) AS total FROM b JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment", "WITH a AS (SELECT l_orderkey, sum(l_extendedprice) AS total FROM lineitem GROUP BY l_orderkey), b AS (SELECT o_custkey, count(*) AS n, sum(total) AS total FROM a JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey) SELECT c_mktsegment, CAST(sum(n) AS BIGINT) AS n, round(sum(total), 2) AS total FROM b JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")

# --- time buckets ---

@frame("time_buckets", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(load, spark):
    return streaming.tumbling(load("events").select("ts", "event_type", "value")).withColumn("start", F.col("start").cast("timestamp_ntz"))
