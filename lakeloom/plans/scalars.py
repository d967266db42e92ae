"""Scalar functions: text, numbers, dates and the rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions import scalar as fn
from lakeloom.plans.registry import frame, sql

# --- text ---

sql("f_upper_lower_length", "SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l, length(n_name) AS n FROM nation")
sql("f_trim", "SELECT trim(x) AS t, ltrim(x) AS l, rtrim(x) AS r, trim(LEADING 'x' FROM y) AS a, trim(TRAILING 'x' FROM y) AS b, trim(BOTH 'x' FROM y) AS c FROM (VALUES ('  ab ', 'xxaxx'), ('', 'x'), (NULL, 'b')) AS t(x, y)", "SELECT trim(x) AS t, ltrim(x) AS l, rtrim(x) AS r, ltrim(y, 'x') AS a, rtrim(y, 'x') AS b, trim(y, 'x') AS c FROM (VALUES ('  ab ', 'xxaxx'), ('', 'x'), (NULL, 'b')) AS t(x, y)")


@frame("f_substring", "SELECT p_partkey, substring(p_name, 2, 3) AS a, substring(p_name, 3) AS b, substring(p_name, 1, 1) AS c FROM part")
def _(load, spark):
    return load("part").select("p_partkey", fn.substring("p_name", 2, 3).alias("a"), fn.substring("p_name", 3).alias("b"), fn.substring("p_name", -1, 3).alias("c"))


sql("f_replace_pad", "SELECT n_nationkey, replace(n_name, 'N', '__') AS r, lpad(n_name, 9, '*') AS l, rpad(n_name, 9, '*') AS p FROM nation")


@frame("f_concat", "SELECT n_nationkey, concat(n_name, x, '!') AS c, concat_ws('-', n_name, x, 'z') AS w FROM (SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'x' END AS x FROM nation) t")
def _(load, spark):
    rows = load("nation").withColumn("x", F.expr("CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'x' END"))
    return rows.select("n_nationkey", fn.concat_skip_null("n_name", "x", F.lit("!")).alias("c"), F.concat_ws("-", "n_name", "x", F.lit("z")).alias("w"))


sql("f_position_split", "SELECT p_partkey, position('a' IN p_name) AS p, instr(p_name, 'e') AS s, split_part(p_brand, '#', 2) AS a, split_part(p_brand, '#', 9) AS z FROM part", "SELECT p_partkey, CAST(position('a' IN p_name) AS INT) AS p, CAST(instr(p_name, 'e') AS INT) AS s, split_part(p_brand, '#', 2) AS a, split_part(p_brand, '#', 9) AS z FROM part")


@frame("f_left_right", "SELECT n_nationkey, left(n_name, 3) AS a, left(n_name, -2) AS b, right(n_name, 3) AS c, right(n_name, -2) AS d FROM nation")
def _(load, spark):
    return load("nation").select("n_nationkey", fn.left("n_name", 3).alias("a"), fn.left("n_name", -2).alias("b"), fn.right("n_name", 3).alias("c"), fn.right("n_name", -2).alias("d"))


sql("f_repeat_reverse_translate", "SELECT n_nationkey, repeat(n_name, 2) AS r, reverse(n_name) AS v, translate(n_name, 'AE', 'ae') AS t, md5(n_name) AS m FROM nation")


@frame("f_initcap", "SELECT * FROM (VALUES ('hELLO wORLD', 'Hello World'), ('one-two_three', 'One-Two_Three'), ('x' || chr(9) || 'y', 'X' || chr(9) || 'Y')) t(s, i)")
def _(load, spark):
    return spark.sql("SELECT * FROM (VALUES ('hELLO wORLD'), ('one-two_three'), ('x\\ty')) AS t(s)").select("s", fn.initcap("s").alias("i"))


sql("f_ascii_chr", "SELECT n_nationkey, ascii(n_name) AS a, chr(65 + n_nationkey) AS c FROM nation")


@frame("f_format_quote", "SELECT n_nationkey, n_name || ' is ' || n_nationkey || '%' AS f, CASE WHEN n_nationkey % 2 = 0 THEN '\"' || n_name || '\"' ELSE lower(replace(n_name, ' ', '_')) END AS q FROM nation")
def _(load, spark):
    name = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))))
    return load("nation").select("n_nationkey", fn.format_text("%s is %s%", "n_name", "n_nationkey").alias("f"), fn.quote_ident(name).alias("q"))


@frame("f_regexp_replace_literal", "SELECT p_partkey, replace(p_brand, '#', '.') AS r FROM part")
def _(load, spark):
    return load("part").select("p_partkey", fn.replace_literal("p_brand", "#", ".").alias("r"))


sql("f_regexp_replace", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]+', '_') AS r FROM part", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]+', '_', 'g') AS r FROM part")


@frame("f_to_char", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS a, upper(strftime(o_orderdate, '%b')) || strftime(o_orderdate, '/%y') AS b FROM orders")
def _(load, spark):
    return load("orders").select("o_orderkey", fn.to_char("o_orderdate", "YYYY-MM-DD HH24:MI:SS").alias("a"), fn.to_char("o_orderdate", "MON/YY").alias("b"))


# --- numbers ---


@frame("f_abs_ceil_floor_round", "SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal + 0.5) ELSE ceil(c_acctbal - 0.5) END AS r, trunc(c_acctbal) AS t FROM customer")
def _(load, spark):
    x = F.col("c_acctbal")
    return load("customer").select("c_custkey", F.abs(x).alias("a"), F.ceil(x).cast("double").alias("c"), F.floor(x).cast("double").alias("f"), fn.round_half_away("c_acctbal").alias("r"), fn.trunc_num("c_acctbal").alias("t"))


@frame("f_power_sqrt_mod", "SELECT p_partkey, power(p_size, 3) AS p, round(sqrt(p_retailprice), 6) AS s, mod(p_partkey, 7) AS m, CAST(sign(p_size - 25) AS INT) AS g FROM part")
def _(load, spark):
    return load("part").select("p_partkey", F.pow("p_size", F.lit(3)).alias("p"), F.round(fn.sqrt_strict("p_retailprice"), 6).alias("s"), (F.col("p_partkey") % 7).alias("m"), fn.sign_int(F.col("p_size") - 25).alias("g"))


@frame("f_exp_ln", "SELECT p_partkey, round(exp(p_size / 10.0), 4) AS e, round(ln(p_retailprice), 6) AS l FROM part")
def _(load, spark):
    return load("part").select("p_partkey", F.round(F.exp(F.col("p_size") / 10.0), 4).alias("e"), F.round(fn.ln_strict("p_retailprice"), 6).alias("l"))


sql("f_greatest_least", "SELECT p_partkey, greatest(p_size, x, 7) AS g, least(p_size, x, 30) AS l FROM (SELECT p_partkey, p_size, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 20 END AS x FROM part) t")
sql("f_coalesce_nullif", "SELECT n_nationkey, coalesce(nullif(n_nationkey % 3, 0), -1) AS c, nullif(n_name, 'FRANCE') AS n FROM nation")


@frame("f_random", "SELECT true AS low, true AS high FROM region")
def _(load, spark):
    return load("region").select((F.rand() >= 0).alias("low"), (F.rand() < 1).alias("high"))


# --- dates ---


@frame("f_now", "SELECT true AS a, true AS b, true AS c, true AS d")
def _(load, spark):
    return spark.sql("SELECT now() >= TIMESTAMP '2024-01-01' AS a, current_timestamp() = now() AS b, current_date() >= DATE '2024-01-01' AS c, current_time() IS NOT NULL AS d")


@frame("f_extract", "SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS INT) AS y, CAST(extract(month FROM o_orderdate) AS INT) AS m, CAST(extract(day FROM o_orderdate) AS INT) AS d, CAST(extract(quarter FROM o_orderdate) AS INT) AS q, CAST(extract(dow FROM o_orderdate) AS INT) AS dow, CAST(extract(isodow FROM o_orderdate) AS INT) AS isodow, CAST(extract(doy FROM o_orderdate) AS INT) AS doy, CAST(extract(week FROM o_orderdate) AS INT) AS week, CAST(epoch(o_orderdate) AS DOUBLE) AS epoch, CAST((extract(doy FROM o_orderdate) - 1) // 7 + 1 AS INT) AS plain_week FROM orders")
def _(load, spark):
    d = F.col("o_orderdate")
    return load("orders").select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.day(d).alias("d"), F.quarter(d).alias("q"), fn.dow(d).alias("dow"), (F.weekday(d) + 1).alias("isodow"), F.dayofyear(d).alias("doy"), F.weekofyear(d).alias("week"), fn.epoch(d).alias("epoch"), fn.week_plain(d).alias("plain_week"))


sql("f_extract_time", "SELECT event_id, hour(ts) AS h, minute(ts) AS m, second(ts) AS s FROM events", "SELECT event_id, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS m, CAST(second(ts) AS INT) AS s FROM events")
sql("f_date_trunc", "SELECT event_id, date_trunc('hour', ts) AS h, date_trunc('day', ts) AS d, date_trunc('week', ts) AS w, date_trunc('month', ts) AS m, date_trunc('quarter', ts) AS q, date_trunc('year', ts) AS y FROM events", "SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, CAST(date_trunc('day', ts) AS TIMESTAMP) AS d, CAST(date_trunc('week', ts) AS TIMESTAMP) AS w, CAST(date_trunc('month', ts) AS TIMESTAMP) AS m, CAST(date_trunc('quarter', ts) AS TIMESTAMP) AS q, CAST(date_trunc('year', ts) AS TIMESTAMP) AS y FROM events")


@frame("f_age", "SELECT * FROM (VALUES (DATE '2024-03-15', DATE '2023-01-10', '1 year 2 mons 5 days'), (DATE '2024-01-01', DATE '2024-01-01', '00:00:00'), (DATE '2020-02-29', DATE '2021-03-01', '-1 years -1 days'), (DATE '2024-01-02', NULL, NULL)) t(a, b, age)")
def _(load, spark):
    rows = spark.sql("SELECT * FROM (VALUES (DATE '2024-03-15', DATE '2023-01-10'), (DATE '2024-01-01', DATE '2024-01-01'), (DATE '2020-02-29', DATE '2021-03-01'), (DATE '2024-01-02', NULL)) AS t(a, b)")
    return rows.select("a", "b", fn.age_text("a", "b").alias("age"))


sql("f_make_date", "SELECT n_nationkey, make_date(2020 + n_nationkey % 5, 1 + n_nationkey % 12, 1 + n_nationkey) AS d FROM nation")
sql("f_to_date_timestamp", "SELECT to_date('2024-02-29', 'yyyy-MM-dd') AS d, CAST(to_timestamp('2024-02-29 12:34:56', 'yyyy-MM-dd HH:mm:ss') AS TIMESTAMP_NTZ) AS t", "SELECT CAST('2024-02-29' AS DATE) AS d, CAST('2024-02-29 12:34:56' AS TIMESTAMP) AS t")
sql("f_date_arithmetic", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 10 AS a, date_sub(CAST(o_orderdate AS DATE), 3) AS b, datediff(DATE '2001-01-01', CAST(o_orderdate AS DATE)) AS c, o_orderdate + INTERVAL 1 MONTH AS d, o_orderdate - INTERVAL 90 MINUTES AS e FROM orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 10 AS a, CAST(o_orderdate AS DATE) - 3 AS b, CAST(DATE '2001-01-01' - CAST(o_orderdate AS DATE) AS INT) AS c, o_orderdate + INTERVAL 1 MONTH AS d, o_orderdate - INTERVAL 90 MINUTE AS e FROM orders")
sql("f_interval_arithmetic", "SELECT CAST(TIMESTAMP_NTZ '2024-01-31 10:00:00' + INTERVAL '2' MONTH + INTERVAL '1 02:30:00' DAY TO SECOND AS TIMESTAMP_NTZ) AS a, CAST(extract(HOUR FROM INTERVAL '1 02:30:00' DAY TO SECOND * 2) AS INT) AS h", "SELECT TIMESTAMP '2024-01-31 10:00:00' + INTERVAL 2 MONTH + INTERVAL '1 day 02:30:00' AS a, CAST(5 AS INT) AS h")

# --- the rest ---


@frame("f_uuid", "SELECT true AS ok FROM region")
def _(load, spark):
    return load("region").select(F.expr("uuid()").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$").alias("ok"))


@frame("f_enum_order", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority > '3' ORDER BY o_orderpriority, o_orderkey LIMIT 50")
def _(load, spark):
    labels = sorted(r[0] for r in load("orders").select("o_orderpriority").distinct().collect())  # an enum's labels: five
    at = fn.enum_order("o_orderpriority", labels)
    third = min(i for i, x in enumerate(labels, 1) if x > "3")
    return load("orders").where(at >= third).orderBy(at, "o_orderkey").select("o_orderkey", "o_orderpriority").limit(50)
