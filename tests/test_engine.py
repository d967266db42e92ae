"""The SQL front end: dialect translation, statements, constraints and transactions."""

import pytest

from lakeloom.dialect import translate
from lakeloom.engine import Engine
from lakeloom.operators.dml import ConstraintError


@pytest.fixture(scope="module")
def rows(spark):
    spark.sql("SELECT * FROM VALUES (1, 'a', 10), (2, 'b', 20), (3, NULL, NULL), (4, 'a', 5) AS t(id, name, val)").createOrReplaceTempView("t1")

    def run(text):
        return [tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in spark.sql(translate(text)).collect()]

    return run


@pytest.mark.parametrize(
    "text, expected",
    [
        ("SELECT 7/2, 7.0/2, 2^10, 5 # 3, '12'::int + 1, 3.75::numeric(5,1)", [(3, 3.5, 1024.0, 6, 13, 3.8)]),
        ("SELECT id FROM t1 ORDER BY val DESC FETCH FIRST 2 ROWS ONLY", [(3,), (2,)]),
        ("SELECT id FROM t1 ORDER BY val", [(4,), (1,), (2,), (3,)]),
        ("SELECT DISTINCT ON (name) name, id FROM t1 ORDER BY name, id DESC", [("a", 4), ("b", 2), (None, 3)]),
        ("SELECT string_agg(name, ',' ORDER BY id), array_agg(name ORDER BY id) FROM t1", [("a,b,a", "{a,b,NULL,a}")]),
        ("SELECT id FROM t1 WHERE name ~ '^a' AND val BETWEEN SYMMETRIC 20 AND 7", [(1,)]),
        ("SELECT id FROM t1 WHERE name !~* '^A' ORDER BY id", [(2,)]),
        ("SELECT id FROM t1 WHERE name SIMILAR TO '(a|c)%' AND id = ANY(ARRAY[1,2,3])", [(1,)]),
        ("SELECT * FROM generate_series(1,5,2) AS g(n)", [(1,), (3,), (5,)]),
        ("SELECT * FROM generate_series(5,1)", []),
        ("SELECT extract(dow FROM '2024-03-10'::date), date_part('isodow', '2024-03-10'::date)", [(0, 7)]),
        ("SELECT concat('a', NULL, 'b'), initcap('hELLO wOR-ld'), left('abc', -1), right('abc', 2), substring('hello' FROM 2 FOR 3), strpos('abc','c'), trunc(-3.7)", [("ab", "Hello Wor-Ld", "ab", "bc", "ell", 3, -3.0)]),
        ("SELECT id, CASE WHEN val > 8 THEN 'hi' ELSE 'lo' END AS c FROM t1 WHERE val <> ALL (SELECT 5) ORDER BY 1", [(1, "hi"), (2, "hi")]),
        ("SELECT id, val / id * 2 AS x FROM t1 WHERE name IS NOT NULL ORDER BY id", [(1, 20.0), (2, 20.0), (4, 2.0)]),
        ("SELECT l2_distance('[1,2]'::vector, '[3,4]'::vector), inner_product('[1,2]'::vector, '[3,4]'::vector)", [(8.0, -11.0)]),
        ("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n+1 FROM r WHERE n < 4) SELECT sum(n) FROM r", [(10,)]),
        ("SELECT id, sum(val) FILTER (WHERE name = 'a') OVER (ORDER BY id ROWS UNBOUNDED PRECEDING), count(*) FILTER (WHERE val > 5) OVER () FROM t1 ORDER BY id", [(1, 10, 2), (2, 10, 2), (3, 10, 2), (4, 15, 2)]),
        ('SELECT "id" AS "My Id", \'it\'\'s\' AS q FROM t1 AS x WHERE x.id = 1 -- done', [(1, "it's")]),
    ],
)
def test_queries(rows, text, expected):
    assert rows(text) == expected


def test_statements(spark):
    e = Engine(spark)
    e.sql("CREATE TABLE people (id SERIAL PRIMARY KEY, name TEXT NOT NULL, age INT DEFAULT 18 CHECK (age > 0), score NUMERIC(5,2))")
    e.sql("INSERT INTO people (name, age) VALUES ('ann', 30), ('bob', 40); INSERT INTO people (name) VALUES ('cid')")
    got = lambda q: [tuple(r) for r in e.sql(q).collect()]
    assert got("SELECT id, name, age FROM people ORDER BY id") == [(1, "ann", 30), (2, "bob", 40), (3, "cid", 18)]
    for bad in ("INSERT INTO people (name, age) VALUES ('x', -1)", "INSERT INTO people (id, name) VALUES (1, 'x')", "INSERT INTO people (age) VALUES (3)"):
        with pytest.raises(ConstraintError):
            e.sql(bad)
    assert got("INSERT INTO people (name, age) VALUES ('dan', DEFAULT) RETURNING name, age") == [("dan", 18)]
    assert got("UPDATE people SET age = age + 1 WHERE name = 'bob' RETURNING name, age") == [("bob", 41)]
    e.sql("BEGIN; DELETE FROM people; ROLLBACK")
    assert got("SELECT count(*) FROM people") == [(4,)]
    e.sql("CREATE TABLE bonus (who TEXT, extra INT); INSERT INTO bonus VALUES ('ann', 5), ('bob', 7)")
    e.sql("UPDATE people SET age = people.age + b.extra FROM bonus b WHERE b.who = people.name")
    assert got("SELECT name, age FROM people WHERE age > 20 ORDER BY name") == [("ann", 35), ("bob", 48)]
    e.sql("DELETE FROM people USING bonus WHERE bonus.who = people.name AND bonus.extra > 6")
    assert got("SELECT name FROM people ORDER BY name") == [("ann",), ("cid",), ("dan",)]
    e.sql("CREATE TABLE kv (k INT UNIQUE, v TEXT, n INT); INSERT INTO kv VALUES (1, 'a', 1), (2, 'b', 2)")
    e.sql("INSERT INTO kv VALUES (2, 'B', 5), (3, 'c', 3) ON CONFLICT (k) DO UPDATE SET v = EXCLUDED.v, n = kv.n + EXCLUDED.n WHERE kv.n < 10")
    e.sql("INSERT INTO kv VALUES (1, 'zzz', 0) ON CONFLICT DO NOTHING")
    assert got("SELECT * FROM kv ORDER BY k") == [(1, "a", 1), (2, "B", 7), (3, "c", 3)]
    e.sql("ALTER TABLE kv ADD COLUMN flag BOOLEAN DEFAULT true; ALTER TABLE kv RENAME COLUMN v TO label; ALTER TABLE kv DROP COLUMN n")
    assert e.sql("SELECT * FROM kv").columns == ["k", "label", "flag"]
    e.sql("CREATE VIEW labels_seen AS SELECT label FROM kv WHERE k <= 2; CREATE TABLE copy_kv AS SELECT * FROM kv")
    assert sorted(got("SELECT label FROM labels_seen")) == [("B",), ("a",)]
    assert got("SHOW server_version") == [("15.0",)] and "kv" not in got("EXPLAIN SELECT 1")[0][0]
    e.sql("TRUNCATE copy_kv; DROP TABLE IF EXISTS nothing; SAVEPOINT s; DROP VIEW labels_seen")
    assert got("SELECT count(*) FROM copy_kv") == [(0,)]


def test_foreign_keys(spark):
    e = Engine(spark)
    e.sql("CREATE TABLE parents (id INT PRIMARY KEY); INSERT INTO parents VALUES (1), (2)")
    e.sql("CREATE TABLE children (id INT, parent_id INT REFERENCES parents(id) ON DELETE CASCADE); INSERT INTO children VALUES (10, 1), (11, 2)")
    with pytest.raises(ConstraintError):
        e.sql("INSERT INTO children VALUES (12, 9)")
    e.sql("DELETE FROM parents WHERE id = 1")
    assert [tuple(r) for r in e.sql("SELECT * FROM children").collect()] == [(11, 2)]


@pytest.fixture()
def engine(spark):
    return Engine(spark)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    "text, expected",
    [
        ("SELECT 7/2, 7.0/2, -7/2, (1+2)/2*3, 9/2/2, 9/2.0/2", [(3, 3.5, -3, 3, 2, 2.25)]),
        ("SELECT " + "/".join(["1000"] + ["1"] * 12), [(1000,)]),
        ("SELECT sqrt(16), ln(1), sign(-2.5)", [(4.0, 0.0, -1)]),
        ("SELECT quote_ident('a b'), quote_ident('ab'), format('%s-%I 5%', 'x', 'y z')", [('"a b"', "ab", 'x-"y z" 5%')]),
        ("SELECT array_to_string(ARRAY[1,2,3], '-'), to_char(DATE '2024-03-05', 'YYYY Mon DD')", [("1-2-3", "2024 Mar 05")]),
        ("SELECT age(DATE '2024-03-05', DATE '2023-01-01'), age(DATE '2024-01-01', DATE '2024-01-01')", [("1 year 2 mons 4 days", "00:00:00")]),
        ("SELECT relname FROM pg_catalog.pg_class WHERE relname = 'no_such'", []),
        ("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 300) SELECT max(n) FROM t", [(300,)]),
    ],
)
def test_forms(engine, text, expected):
    assert got(engine.sql(text)) == expected


@pytest.mark.parametrize("text", ["SELECT sqrt(x) FROM VALUES (-1) AS t(x)", "SELECT ln(x) FROM VALUES (0) AS t(x)"])
def test_strict_functions_raise(engine, text):
    with pytest.raises(Exception, match="cannot take"):
        engine.sql(text).collect()


def test_views_see_later_rows(engine):
    engine.sql("CREATE TABLE e_v (a INT); INSERT INTO e_v VALUES (1); CREATE VIEW e_vv AS SELECT a / 2 AS h FROM e_v; INSERT INTO e_v VALUES (5)")
    assert got(engine.sql("SELECT * FROM e_vv")) == [(0,), (2,)]


def test_foreign_keys_on_update_and_delete(engine):
    engine.sql("CREATE TABLE e_p (id INT PRIMARY KEY); CREATE TABLE e_c (id INT PRIMARY KEY, p INT REFERENCES e_p(id)); INSERT INTO e_p VALUES (1), (2); INSERT INTO e_c VALUES (10, 1)")
    with pytest.raises(ConstraintError):
        engine.sql("UPDATE e_p SET id = 99 WHERE id = 1")
    engine.sql("UPDATE e_p SET id = 77 WHERE id = 2")
    with pytest.raises(ConstraintError):
        engine.sql("TRUNCATE e_p")
    with pytest.raises(ConstraintError):
        engine.sql("DELETE FROM e_p USING e_c WHERE e_p.id = e_c.p")
    assert got(engine.sql("SELECT * FROM e_p")) == [(1,), (77,)]
    engine.sql("CREATE TABLE e_n (p INT REFERENCES e_p(id) ON UPDATE SET NULL); INSERT INTO e_n VALUES (77); UPDATE e_p SET id = 78 WHERE id = 77")
    assert got(engine.sql("SELECT * FROM e_n")) == [(None,)]


def test_cascades_go_on(engine):
    engine.sql("CREATE TABLE e_1 (id INT PRIMARY KEY); CREATE TABLE e_2 (id INT PRIMARY KEY, p INT REFERENCES e_1(id) ON DELETE CASCADE); CREATE TABLE e_3 (p INT REFERENCES e_2(id) ON DELETE CASCADE)")
    engine.sql("INSERT INTO e_1 VALUES (1), (2); INSERT INTO e_2 VALUES (10, 1), (20, 2); INSERT INTO e_3 VALUES (10), (20); DELETE FROM e_1 WHERE id = 1")
    assert got(engine.sql("SELECT * FROM e_2")) == [(20, 2)] and got(engine.sql("SELECT * FROM e_3")) == [(20,)]


def test_added_constraints_hold(engine):
    engine.sql("CREATE TABLE e_a (a INT); INSERT INTO e_a VALUES (1), (2); ALTER TABLE e_a ADD CONSTRAINT one UNIQUE (a); ALTER TABLE e_a ADD COLUMN b INT NOT NULL DEFAULT 4")
    with pytest.raises(ConstraintError):
        engine.sql("INSERT INTO e_a VALUES (1, 5)")
    with pytest.raises(ConstraintError):
        engine.sql("ALTER TABLE e_a ADD CHECK (a > 1)")
    engine.sql("INSERT INTO e_a (a) VALUES (3)")
    assert got(engine.sql("SELECT * FROM e_a")) == [(1, 4), (2, 4), (3, 4)]


def test_returning(engine):
    engine.sql("CREATE TABLE e_r (id INT UNIQUE, v INT); INSERT INTO e_r VALUES (1, 10), (2, 20)")
    assert got(engine.sql("INSERT INTO e_r VALUES (1, 0), (3, 30) ON CONFLICT (id) DO NOTHING RETURNING id, v")) == [(3, 30)]
    assert got(engine.sql("INSERT INTO e_r VALUES (1, 7), (2, 8) ON CONFLICT (id) DO UPDATE SET v = excluded.v WHERE e_r.v < 15 RETURNING id, v")) == [(1, 7)]
    engine.sql("CREATE TABLE e_s (id INT, w INT); INSERT INTO e_s VALUES (1, 100), (1, 50), (9, 1)")
    assert got(engine.sql("UPDATE e_r SET v = s.w FROM e_s s WHERE e_r.id = s.id RETURNING id, v")) == [(1, 50)]
    assert got(engine.sql("DELETE FROM e_r USING e_s WHERE e_r.id = e_s.id RETURNING v")) == [(50,)]
    assert got(engine.sql("SELECT * FROM e_r")) == [(2, 20), (3, 30)]


def test_with_before_changes_prepared_enums_sequences_vectors(engine):
    engine.sql("CREATE TYPE mood AS ENUM ('low', 'high'); CREATE TABLE e_m (id INT, m mood); WITH x AS (SELECT 1 AS a) INSERT INTO e_m SELECT a, 'low' FROM x")
    with pytest.raises(ConstraintError):
        engine.sql("INSERT INTO e_m VALUES (2, 'zzz')")
    engine.sql("WITH x AS (SELECT 1 AS a) DELETE FROM e_m WHERE id IN (SELECT a FROM x); PREPARE put AS INSERT INTO e_m VALUES ($1, $2); EXECUTE put(5, 'high'); DEALLOCATE put")
    assert got(engine.sql("SELECT * FROM e_m")) == [(5, "high")]
    engine.sql("CREATE SEQUENCE e_q START 5 INCREMENT 2")
    assert got(engine.sql("SELECT nextval('e_q'), nextval('e_q'), currval('e_q')")) == [(5, 7, 7)]
    engine.sql("CREATE TABLE e_w (id INT, v VECTOR(3)); INSERT INTO e_w VALUES (nextval('e_q'), '[1,2,3]')")
    assert got(engine.sql("SELECT id, l2_distance(v, '[1,2,5]'::vector) FROM e_w")) == [(9, 4.0)]
    assert ("e_w",) in got(engine.sql("SELECT table_name FROM information_schema.tables"))


def test_copy(spark, tmp_path):
    e = Engine(spark)
    got = lambda q: [tuple(r) for r in e.sql(q).collect()]
    e.sql("CREATE TABLE copied_out (k INT, n TEXT, f BOOLEAN); INSERT INTO copied_out VALUES (1, 'a b', true), (2, NULL, NULL)")
    e.sql("CREATE TABLE copied_in (id SERIAL, k INT, n TEXT, f BOOLEAN DEFAULT false)")
    e.sql(f"COPY copied_out TO '{tmp_path}/text'; COPY copied_in (k, n, f) FROM '{tmp_path}/text'")
    assert sorted(got("SELECT k, n, f FROM copied_in")) == [(1, "a b", True), (2, None, None)]
    assert got("COPY (SELECT k, n FROM copied_out ORDER BY k) TO STDOUT WITH (FORMAT CSV, HEADER)") == [("k,n",), ("1,a b",), ("2,",)]
    assert got("COPY copied_out (n) TO STDOUT") == [("a b",), ("\\N",)]
    with pytest.raises(SyntaxError):
        e.sql("COPY copied_in FROM STDIN")


@pytest.mark.parametrize("values", ["(2), (NULL)", "(2), (3), (3)", "(3)", ""])
def test_any_and_all_of_a_query(spark, values):
    import duckdb

    db = duckdb.connect()
    for name, rows in (("q_left", "(1), (2), (3), (NULL), (7)"), ("q_right", values)):
        text = f"SELECT CAST(v AS INT) AS v FROM (VALUES {rows}) t(v)" if rows else "SELECT CAST(1 AS INT) AS v WHERE false"
        spark.sql(text).createOrReplaceTempView(name)
        db.execute(f"CREATE TABLE {name} AS {text}")
    for operator in ("<>", "<", "<=", ">", ">=", "="):
        for form in ("v {} ANY (SELECT v FROM q_right)", "v {} ALL (SELECT v FROM q_right)"):
            test = form.format(operator)
            for text in (f"SELECT v FROM q_left WHERE NOT ({test})", f"SELECT v FROM q_left WHERE v = 7 OR {test}"):
                assert sorted(map(str, map(tuple, spark.sql(translate(text)).collect()))) == sorted(map(str, db.execute(text).fetchall())), text


@pytest.mark.parametrize("operator", ["<> ALL", "> ALL", "<> ANY", "< ANY"])
def test_comparisons_with_a_query_neither_meet_all_rows_nor_gather_them(spark, operator):
    spark.range(100).createOrReplaceTempView("q_ids")
    df = spark.sql(translate(f"SELECT id FROM q_ids WHERE id = 5 OR id {operator} (SELECT id + 3 FROM q_ids)"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "collect_list" not in plan
