"""Scans, projections, expressions, predicates, sorting and set operations."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from lakeloom.functions import scalar as fn
from lakeloom.operators import relational as rel
from lakeloom.plans.registry import frame, sql
from lakeloom.sources import catalog, copy, tables

# --- S: sources ---

sql("s1_seq_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
sql("s2_index_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7 AND o_custkey IS NOT NULL")


@frame("s3_foreign_table", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def _(load, spark):
    files = load("nation").inputFiles()
    path = files[0] if len(files) == 1 else files[0].rpartition("/")[0]
    return tables.foreign_table(spark, "foreign_nation", path).where("n_regionkey = 1").select("n_nationkey", "n_name")


@frame("s4_disk_table", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey < 3 UNION ALL SELECT r_regionkey + 100, r_name FROM region WHERE r_regionkey < 3")
def _(load, spark):
    folder = scratch_path(spark, "disk_table")
    part = load("region").where("r_regionkey < 3").select("r_regionkey", "r_name")
    part.write.mode("overwrite").parquet(folder)
    part.select((F.col("r_regionkey") + 100).cast("int").alias("r_regionkey"), "r_name").write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def scratch_path(spark, name: str) -> str:
    """A folder for files of a query: in the cluster's shared checkpoint folder, which only a local master (tests) may leave unset."""
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that the driver and all executors share")
    return f"{shared or tempfile.mkdtemp()}/{name}-{uuid.uuid4().hex}"


sql("s5_values", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(k, v)")
sql("s6_tableless", "SELECT 1 + 2 AS three, 'x' AS x")


@frame("s7_series_int", "SELECT generate_series AS n FROM generate_series(1, 100, 7)")
def _(load, spark):
    return rel.series(spark, 1, 100, 7, "n")


@frame("s7_series_down", "SELECT generate_series AS n FROM generate_series(10, -10, -3)")
def _(load, spark):
    return rel.series(spark, 10, -10, -3, "n")


@frame("s8_series_date", "SELECT CAST(generate_series AS TIMESTAMP) AS d FROM generate_series(TIMESTAMP '2024-01-31', TIMESTAMP '2024-12-31', INTERVAL 1 MONTH)")
def _(load, spark):
    return rel.date_series(spark, "2024-01-31", "2024-12-31", "1 month", "d")


@frame("s9_view", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment")
def _(load, spark):
    load("customer").where("c_acctbal > 0").createOrReplaceTempView("rich_customer")
    return spark.sql("SELECT c_mktsegment, count(*) AS n FROM rich_customer GROUP BY c_mktsegment")


sql("s10_from_subquery", "SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) AS s WHERE n > 5")
sql("s11_cte_chain", "WITH a(k, v) AS (SELECT o_custkey, o_totalprice FROM orders), b AS (SELECT k, count(*) AS n FROM a GROUP BY k) SELECT n, count(*) AS customers FROM b GROUP BY n")
sql("s12_recursive_all", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n FROM t")


@frame("s12_recursive_union", "WITH RECURSIVE t(n) AS (SELECT 1 UNION SELECT (n * 3 + 1) % 50 FROM t) SELECT n FROM t")
def _(load, spark):
    return rel.recursive(spark.sql("SELECT 1 AS n"), lambda t: t.select(((F.col("n") * 3 + 1) % 50).alias("n")))


@frame("s12_recursive_hierarchy", "WITH RECURSIVE t(part, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey = 1 UNION ALL SELECT p.p_partkey, t.depth + 1 FROM t JOIN part p ON p.p_partkey // 2 = t.part WHERE p.p_partkey > 1) SELECT depth, count(*) AS n FROM t GROUP BY depth")
def _(load, spark):
    part = load("part").where("p_partkey > 1").select("p_partkey", F.expr("p_partkey div 2").alias("parent"))
    seed = load("part").where("p_partkey = 1").select(F.col("p_partkey").alias("part"), F.lit(0).alias("depth"))
    step = lambda t: t.join(part, F.col("part") == F.col("parent")).select(F.col("p_partkey").alias("part"), (F.col("depth") + 1).alias("depth"))
    return rel.recursive(seed, step, distinct=False).groupBy("depth").agg(F.count("*").alias("n"))


@frame("s13_information_schema", "SELECT column_name, CAST(ordinal_position AS INT) AS ordinal_position FROM information_schema.columns WHERE table_name = 'nation'")
def _(load, spark):
    load("nation").createOrReplaceTempView("nation")
    return catalog.columns(spark).where("table_name = 'nation'").select("column_name", "ordinal_position")


@frame("s13_pg_class", "SELECT 'region' AS relname, 'r_name' AS attname")
def _(load, spark):
    load("region").createOrReplaceTempView("region")
    pg = catalog.pg_tables(spark)
    joined = pg["pg_class"].join(pg["pg_attribute"], F.col("oid") == F.col("attrelid")).join(pg["pg_type"].withColumnRenamed("oid", "type_oid"), F.col("atttypid") == F.col("type_oid"))
    return joined.where("relname = 'region' AND typname = 'text'").select("relname", "attname")


@frame("s14_s15_copy_text", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END AS n_name FROM nation")
def _(load, spark):
    path = scratch_path(spark, "copy_text")
    copy.copy_to(load("nation").select("n_nationkey", F.expr("CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END").alias("n_name")), path)
    return copy.copy_from(spark, path, "n_nationkey int, n_name string")


@frame("s14_s15_copy_csv", "SELECT s_suppkey, s_name FROM supplier")
def _(load, spark):
    path = scratch_path(spark, "copy_csv")
    copy.copy_to(load("supplier").select("s_suppkey", "s_name"), path, csv=True, header=True)
    return copy.copy_from(spark, path, "s_suppkey bigint, s_name string", csv=True, header=True)


# --- P: expressions and predicates ---

sql("p1_projection", "SELECT p_partkey, p_brand FROM part")
sql("p2_p3_expressions", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 4) AS charge FROM lineitem")
sql("p4_star", "SELECT n.*, r.r_name AS region FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
sql("p5_arithmetic", "SELECT o_orderkey, o_orderkey div 7 AS q, o_orderkey % 7 AS m, -o_orderkey AS neg, o_custkey * 2 - 1 AS t, (-7) div 2 AS cut FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS m, -o_orderkey AS neg, o_custkey * 2 - 1 AS t, CAST(-3 AS BIGINT) AS cut FROM orders")
sql("p6_power", "SELECT p_partkey, power(p_size, 2) AS sq, power(2.0, 10) AS kilo FROM part", "SELECT p_partkey, CAST(p_size ^ 2 AS DOUBLE) AS sq, CAST(2.0 ^ 10 AS DOUBLE) AS kilo FROM part")
sql("p7_bitwise", "SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS o, p_size ^ 5 AS x, ~p_size AS n, shiftleft(p_size, 2) AS l, shiftright(p_size, 1) AS r FROM part", "SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS o, xor(p_size, 5) AS x, ~p_size AS n, p_size << 2 AS l, p_size >> 1 AS r FROM part")
sql("p8_concat", "SELECT n_nationkey, n_name || '-' || n_nationkey AS label, n_name || NULL AS nothing FROM nation", "SELECT n_nationkey, n_name || '-' || n_nationkey AS label, CAST(NULL AS VARCHAR) AS nothing FROM nation")
sql("p9_comparison", "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size < 20 AND p_size <> 15 AND p_retailprice <= 1500")
sql("p10_three_valued", "SELECT p_partkey, (x > 10 AND y > 5) AS a, (x > 10 OR y > 5) AS o, NOT (x > 10) AS n FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS x, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END AS y FROM part) t")
sql("p11_is_null", "SELECT count(*) AS n, count(x) AS k, count(*) - count(x) AS nulls FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS x FROM orders) t")
sql("p12_distinct_from", "SELECT a, b, a IS DISTINCT FROM b AS d, a IS NOT DISTINCT FROM b AS s FROM (VALUES (1, 1), (1, 2), (NULL, 1), (NULL, NULL)) AS t(a, b)")
sql("p13_is_not_true", "SELECT o_orderkey, (x > 100000) IS NOT TRUE AS nt, (x > 100000) IS NOT FALSE AS nf FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS x FROM orders) t")


@frame("p14_between", "SELECT p_partkey, p_size BETWEEN 10 AND 20 AS b, p_size NOT BETWEEN 10 AND 20 AS nb, p_size BETWEEN 10 AND 20 AS s FROM part")
def _(load, spark):
    size = F.col("p_size")
    return load("part").select("p_partkey", size.between(10, 20).alias("b"), (~size.between(10, 20)).alias("nb"), fn.between_symmetric("p_size", 20, 10).alias("s"))


sql("p15_in_list", "SELECT p_partkey, p_size IN (1, 2, NULL) AS i, p_size NOT IN (1, 2, 3) AS n FROM part")
sql("p16_row_in", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('N', 'O'))")
sql("p17_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
sql("p17_not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
sql("p17_not_in_null", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey = 1 THEN NULL ELSE o_custkey END FROM orders)")
sql("p18_exists", "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49)")
sql("p18_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
sql("p19_scalar_subquery", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS best FROM customer c")
sql("p19_scalar_uncorrelated", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 2 FROM orders)")


@frame("p20_any_all_array", "SELECT p_partkey, p_size = ANY ([1, 5, 9]) AS a, p_size > ALL ([10, 20]) AS b, p_size < ANY ([3, 40]) AS c FROM part")
def _(load, spark):
    return load("part").select("p_partkey", fn.any_of("p_size", "=", [1, 5, 9]).alias("a"), fn.all_of("p_size", ">", [10, 20]).alias("b"), fn.any_of("p_size", "<", [3, 40]).alias("c"))


@frame("p21_any_subquery", "SELECT p_partkey FROM part WHERE p_size < ANY (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)")
def _(load, spark):
    return rel.compare_any(load("part"), "p_size", "<", load("supplier").where("s_acctbal > 0").select("s_nationkey")).select("p_partkey")


@frame("p21_all_subquery", "SELECT p_partkey FROM part WHERE p_size >= ALL (SELECT s_nationkey FROM supplier)")
def _(load, spark):
    return rel.compare_all(load("part"), "p_size", ">=", load("supplier").select("s_nationkey")).select("p_partkey")


sql("p22_like", "SELECT p_partkey, p_name LIKE '%a%' AS l, p_name ILIKE '%A%' AS i, p_name NOT LIKE 'p%' AS n, 'a%b' LIKE 'a!%b' ESCAPE '!' AS e FROM part")


@frame("p23_similar_to", "SELECT p_partkey, p_brand SIMILAR TO '(Brand#1|Brand#2).*' AS s FROM part")
def _(load, spark):
    return load("part").select("p_partkey", fn.similar_to("p_brand", "(Brand#1|Brand#2)%").alias("s"))


@frame("p24_regex", "SELECT p_partkey, regexp_matches(p_brand, '[0-9]$') AS m, NOT regexp_matches(p_brand, '^B') AS nm, regexp_matches(p_brand, '^brand', 'i') AS i FROM part")
def _(load, spark):
    return load("part").select("p_partkey", fn.regex_match("p_brand", "[0-9]$").alias("m"), (~fn.regex_match("p_brand", "^B")).alias("nm"), fn.regex_match("p_brand", "^brand", True).alias("i"))


sql("p25_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'big' END AS c, CASE p_size % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' END AS s FROM part")
sql("p26_cast", "SELECT o_orderkey, CAST(o_orderkey AS STRING) AS s, CAST('12' AS INT) + 1 AS i, CAST(o_orderdate AS DATE) AS d, CAST(o_custkey AS DOUBLE) AS f, CAST(CAST(o_orderkey % 2 AS INT) AS BOOLEAN) AS b FROM orders", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST('12' AS INT) + 1 AS i, CAST(o_orderdate AS DATE) AS d, CAST(o_custkey AS DOUBLE) AS f, CAST(CAST(o_orderkey % 2 AS INT) AS BOOLEAN) AS b FROM orders")


@frame("p26_cast_round", "SELECT l_orderkey, l_linenumber, CAST(floor(abs(l_extendedprice) + 0.5) AS INT) AS rounded, CAST(floor(l_extendedprice) AS INT) AS cut FROM lineitem")
def _(load, spark):
    return load("lineitem").select("l_orderkey", "l_linenumber", fn.cast_round_int("l_extendedprice").alias("rounded"), F.col("l_extendedprice").cast("int").alias("cut"))


sql("p27_filter_generic", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity * l_discount > 2 AND (l_returnflag = 'R' OR l_tax BETWEEN 0.02 AND 0.04)")
sql("p28_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) / count(*) > 100000")
sql("p28_having_no_group", "SELECT count(*) AS n FROM orders HAVING count(*) > 1")

# --- O: order, limit, distinct ---


@frame("o1_order_nulls", "SELECT o_orderkey, x FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS x FROM orders) t ORDER BY x DESC NULLS FIRST, o_orderkey ASC NULLS LAST")
def _(load, spark):
    rows = load("orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END").alias("x"))
    return rows.orderBy(fn.pg_order("x", descending=True), fn.pg_order("o_orderkey"))


sql("o2_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey ASC NULLS LAST LIMIT 10 OFFSET 5")
sql("o3_top_n", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 100")
sql("o4_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")


@frame("o5_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def _(load, spark):
    return rel.distinct_on(load("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc_nulls_last()])


# --- U: set operations ---

sql("u1_union", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
sql("u2_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
sql("u3_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
sql("u4_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
sql("u5_except", "SELECT p_size AS k FROM part EXCEPT SELECT s_nationkey FROM supplier")
sql("u6_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
sql("u7_ordered_union", "SELECT k FROM (SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier) t ORDER BY k DESC NULLS LAST LIMIT 20")
sql("u8_chained", "(SELECT n_regionkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region WHERE r_regionkey = 2) UNION ALL SELECT 99 AS k")
