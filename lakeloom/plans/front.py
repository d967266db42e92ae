"""Queries and statements that go through the SQL front end."""

from __future__ import annotations

from lakeloom.dialect import run as run_query
from lakeloom.engine import Engine
from lakeloom.plans.basic import scratch_path
from lakeloom.plans.registry import QUERIES, SQL, frame
from lakeloom.sources.tables import register


def dialect(name: str, text: str, oracle: str | None = None) -> None:
    """A query in the dialect itself."""

    def run(spark, folder):
        register(spark, folder, text)
        return run_query(spark, text)

    QUERIES[name] = run
    SQL[name] = text if oracle is None else oracle


dialect("x_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
dialect("x_casts_division", "SELECT o_orderkey, o_orderkey / 7 AS q, o_totalprice / 2 AS h, o_orderkey::text || '!' AS t, (o_orderkey % 3)::int::boolean AS b FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, o_totalprice / 2 AS h, o_orderkey::text || '!' AS t, (o_orderkey % 3)::int::boolean AS b FROM orders")
dialect("x_power_regex", "SELECT p_partkey, (p_size ^ 2)::double precision AS sq, p_brand ~ '[12]$' AS m, p_brand !~* '^BRAND#3' AS n FROM part", "SELECT p_partkey, CAST(p_size ^ 2 AS DOUBLE) AS sq, regexp_matches(p_brand, '[12]$') AS m, NOT regexp_matches(p_brand, '^BRAND#3', 'i') AS n FROM part")
dialect("x_fetch_nulls", "SELECT o_orderkey, x FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS x FROM orders) AS t ORDER BY x DESC, o_orderkey FETCH FIRST 300 ROWS ONLY", "SELECT o_orderkey, x FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS x FROM orders) AS t ORDER BY x DESC NULLS FIRST, o_orderkey LIMIT 300")
dialect("x_string_agg", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
dialect("x_any_all", "SELECT p_partkey FROM part WHERE p_size = ANY(ARRAY[1, 7, 9]) OR p_partkey <> ALL (SELECT l_partkey FROM lineitem WHERE l_quantity > 20)", "SELECT p_partkey FROM part WHERE p_size IN (1, 7, 9) OR p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 20)")
dialect("x_between_symmetric", "SELECT p_partkey FROM part WHERE p_size BETWEEN SYMMETRIC 20 AND 10", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
dialect("x_series_join", "SELECT g.n, count(o_orderkey) AS orders FROM generate_series(1, 12) AS g(n) LEFT JOIN orders ON extract(month FROM o_orderdate) = g.n GROUP BY g.n", "SELECT CAST(g.n AS INT) AS n, count(o_orderkey) AS orders FROM generate_series(1, 12) AS g(n) LEFT JOIN orders ON extract(month FROM o_orderdate) = g.n GROUP BY g.n")
dialect("x_extract", "SELECT o_orderkey, extract(dow FROM o_orderdate) AS d, date_part('isodow', o_orderdate) AS i, o_orderdate + INTERVAL '1 month 2 days' AS later FROM orders", "SELECT o_orderkey, CAST(extract(dow FROM o_orderdate) AS INT) AS d, CAST(extract(isodow FROM o_orderdate) AS INT) AS i, o_orderdate + INTERVAL '1 month 2 days' AS later FROM orders")
dialect("x_text_functions", "SELECT n_nationkey, concat(n_name, NULL, '.') AS c, left(n_name, -1) AS l, right(n_name, 2) AS r, substring(n_name FROM 2 FOR 2) AS s, strpos(n_name, 'A') AS p FROM nation", "SELECT n_nationkey, concat(n_name, NULL, '.') AS c, left(n_name, -1) AS l, right(n_name, 2) AS r, substring(n_name FROM 2 FOR 2) AS s, CAST(strpos(n_name, 'A') AS INT) AS p FROM nation")
dialect("x_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 10) SELECT n, f FROM t")
dialect("x_window_named", "SELECT o_orderkey, count(*) OVER w AS n, first_value(o_orderkey) OVER w AS f FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


@frame("x_statements", "SELECT * FROM (VALUES (1, 'ann', 31), (2, 'bob', 18), (4, 'dan', 7)) t(id, name, age)")
def _(load, spark):
    e = Engine(spark)
    e.sql("CREATE TABLE x_people (id SERIAL PRIMARY KEY, name TEXT NOT NULL, age INT DEFAULT 18); CREATE UNIQUE INDEX by_name ON x_people (name)")
    e.sql("INSERT INTO x_people (name, age) VALUES ('ann', 30); INSERT INTO x_people (name) VALUES ('bob'), ('cid')")
    e.sql("UPDATE x_people SET age = age + 1 WHERE name = 'ann'; DELETE FROM x_people WHERE name = 'cid'")
    e.sql("INSERT INTO x_people VALUES (4, 'dan', 7), (2, 'eve', 1) ON CONFLICT (id) DO NOTHING")
    return e.sql("SELECT id, name, age FROM x_people")


@frame("d11_unique_index", "SELECT 'refused' AS second_row")
def _(load, spark):
    from lakeloom.operators.dml import ConstraintError

    e = Engine(spark)
    e.sql("CREATE TABLE x_keyed (k INT); CREATE UNIQUE INDEX ON x_keyed (k); INSERT INTO x_keyed VALUES (1)")
    try:
        e.sql("INSERT INTO x_keyed VALUES (1)")
    except ConstraintError:
        return spark.sql("SELECT 'refused' AS second_row")
    return spark.sql("SELECT 'accepted' AS second_row")


@frame("d17_session", "SELECT '15.0' AS server_version")
def _(load, spark):
    e = Engine(spark)
    e.sql("SET search_path TO public; BEGIN; SAVEPOINT a; RELEASE a; COMMIT; RESET ALL; DISCARD ALL")
    return e.sql("SHOW server_version")


dialect("x_division_chain", "SELECT l_orderkey, l_linenumber, l_orderkey / 2 / 3 AS a, (l_orderkey + l_linenumber) / 4 * 2 AS b, l_quantity / 4 / 2 AS c, -l_linenumber / 2 AS d FROM lineitem", "SELECT l_orderkey, l_linenumber, l_orderkey // 2 // 3 AS a, CAST(trunc((l_orderkey + l_linenumber) / 4) * 2 AS BIGINT) AS b, l_quantity / 4 / 2 AS c, CAST(trunc(-l_linenumber / 2) AS BIGINT) AS d FROM lineitem")
dialect("x_recursive_deep", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 250) SELECT count(*) AS c, sum(n) AS s FROM t", "SELECT 250 AS c, CAST(250 * 251 / 2 AS BIGINT) AS s")
dialect("x_scalar_functions", "SELECT n_nationkey, sqrt(n_nationkey) AS r, sign(n_nationkey - 10) AS g, quote_ident(lower(n_name)) AS q, format('%s (%s)', n_name, n_nationkey) AS f, array_to_string(ARRAY[n_nationkey, n_regionkey], '/') AS a FROM nation", "SELECT n_nationkey, sqrt(n_nationkey) AS r, CAST(sign(n_nationkey - 10) AS INT) AS g, CASE WHEN regexp_full_match(lower(n_name), '[a-z_][a-z0-9_]*') THEN lower(n_name) ELSE '\"' || lower(n_name) || '\"' END AS q, n_name || ' (' || n_nationkey || ')' AS f, n_nationkey || '/' || n_regionkey AS a FROM nation")
dialect("x_to_char", "SELECT o_orderkey, to_char(o_orderdate, 'YYYY Mon DD') AS t FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y %b %d') AS t FROM orders")


@frame("x_live_view", "SELECT r_regionkey + 10 AS k, r_name AS n FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def _(load, spark):
    e = Engine(spark)
    e.register("x_view_table", load("nation").selectExpr("n_nationkey AS k", "n_name AS n"))
    load("region").createOrReplaceTempView("x_view_region")
    e.sql("CREATE VIEW x_view AS SELECT k, n FROM x_view_table; INSERT INTO x_view_table SELECT r_regionkey + 10, r_name FROM x_view_region")
    return e.sql("SELECT k, n FROM x_view")


@frame("x_upsert_returning", "SELECT n_nationkey AS k, 'new' AS n FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey + 100, n_name FROM nation")
def _(load, spark):
    e = Engine(spark)
    e.sql("CREATE TABLE x_returned (k INT PRIMARY KEY, n TEXT, r INT)")
    load("nation").createOrReplaceTempView("x_returned_source")
    e.sql("INSERT INTO x_returned SELECT n_nationkey, n_name, n_regionkey FROM x_returned_source")
    return e.sql("INSERT INTO x_returned SELECT n_nationkey, 'new', 0 FROM x_returned_source UNION ALL SELECT n_nationkey + 100, n_name, 0 FROM x_returned_source ON CONFLICT (k) DO UPDATE SET n = excluded.n WHERE x_returned.r = 1 RETURNING k, n")


@frame("x_foreign_key_actions", "SELECT CASE WHEN n_regionkey = 1 THEN NULL WHEN n_regionkey = 2 THEN 20 ELSE n_regionkey END AS a, CASE WHEN n_regionkey = 2 THEN 20 ELSE n_regionkey END AS b FROM nation WHERE n_regionkey <> 3")
def _(load, spark):
    """Keys that are set to null, follow, and go with their parents over two levels."""
    e = Engine(spark)
    load("nation").createOrReplaceTempView("x_fk_source")
    e.sql("CREATE TABLE x_regions (k INT PRIMARY KEY); INSERT INTO x_regions SELECT DISTINCT n_regionkey FROM x_fk_source")
    e.sql("CREATE TABLE x_middle (k INT PRIMARY KEY REFERENCES x_regions(k) ON UPDATE CASCADE ON DELETE CASCADE); INSERT INTO x_middle SELECT k FROM x_regions")
    e.sql("CREATE TABLE x_nations (a INT, b INT REFERENCES x_middle(k) ON DELETE CASCADE)")
    e.sql("INSERT INTO x_nations SELECT n_regionkey, n_regionkey FROM x_fk_source; DELETE FROM x_regions WHERE k = 3")
    e.sql("UPDATE x_nations SET a = NULL WHERE a = 1; CREATE TABLE x_moved (o INT, n INT); INSERT INTO x_moved VALUES (2, 20)")
    e.sql("ALTER TABLE x_nations ALTER COLUMN b TYPE INT; UPDATE x_nations SET a = m.n FROM x_moved m WHERE x_nations.a = m.o")
    return e.sql("SELECT a, CASE WHEN b = 2 THEN 20 ELSE b END AS b FROM x_nations")


dialect(
    "x_window_filter",
    "SELECT o_orderkey, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS s, count(*) FILTER (WHERE o_orderstatus = 'O') OVER (PARTITION BY o_custkey) AS n FROM orders",
    "SELECT o_orderkey, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS s, count(*) FILTER (WHERE o_orderstatus = 'O') OVER (PARTITION BY o_custkey) AS n FROM orders",
)


@frame("x_copy_statement", "SELECT CAST(n_nationkey AS VARCHAR) || ',' || CASE WHEN n_regionkey = 1 THEN '' ELSE n_name END AS line FROM nation")
def _(load, spark):
    """A table to a file, from there into another one, and that one as lines."""
    e = Engine(spark)
    load("nation").createOrReplaceTempView("x_copy_source")
    path = scratch_path(spark, "x_copy")
    e.sql("CREATE TABLE x_copied (k INT, n TEXT)")
    e.sql(f"COPY (SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN NULL ELSE n_name END AS n FROM x_copy_source) TO '{path}' WITH CSV HEADER")
    e.sql(f"COPY x_copied FROM '{path}' WITH (FORMAT CSV, HEADER)")
    return e.sql("COPY x_copied (k, n) TO STDOUT WITH CSV")
