"""Table modification, constraints, transactions and session statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.database import Constraints, Database, ForeignKey
from lakeloom.operators import dml
from lakeloom.plans.registry import frame


def _supplier(load):
    return load("supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@frame("d1_insert_values", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT * FROM (VALUES (10, 'TEN'), (11, NULL)) t")
def _(load, spark):
    return dml.insert(load("region").select("r_regionkey", "r_name"), spark.createDataFrame([(10, "TEN"), (11, None)], "r_regionkey int, r_name string"))


@frame("d1_insert_defaults", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 12, 'none'")
def _(load, spark):
    return dml.insert(load("region").select("r_regionkey", "r_name"), spark.createDataFrame([(12,)], "r_regionkey int"), {"r_name": "none"})


@frame("d2_insert_select", "SELECT s_suppkey AS k FROM supplier UNION ALL SELECT c_custkey + 100000 FROM customer WHERE c_acctbal > 9000")
def _(load, spark):
    return dml.insert(load("supplier").select(F.col("s_suppkey").alias("k")), load("customer").where("c_acctbal > 9000").select((F.col("c_custkey") + 100000).alias("k")))


_NEW = "SELECT s_suppkey + 50 AS s_suppkey, 'new' AS s_name, 0 AS s_nationkey, CAST(1 AS DOUBLE) AS s_acctbal FROM supplier"


def _new(load):
    return load("supplier").select((F.col("s_suppkey") + 50).alias("s_suppkey"), F.lit("new").alias("s_name"), F.lit(0).alias("s_nationkey"), F.lit(1.0).alias("s_acctbal"))


@frame("d3_conflict_nothing", f"SELECT * FROM supplier UNION ALL SELECT * FROM ({_NEW}) n WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier)")
def _(load, spark):
    return dml.upsert(_supplier(load), _new(load), ["s_suppkey"])


@frame("d3_conflict_update", f"SELECT coalesce(t.s_suppkey, n.s_suppkey) AS s_suppkey, CASE WHEN t.s_suppkey IS NULL THEN n.s_name ELSE t.s_name END AS s_name, coalesce(t.s_nationkey, n.s_nationkey) AS s_nationkey, CASE WHEN t.s_suppkey IS NULL THEN n.s_acctbal WHEN n.s_suppkey IS NOT NULL AND t.s_acctbal > 0 THEN t.s_acctbal + n.s_acctbal ELSE t.s_acctbal END AS s_acctbal FROM supplier t FULL JOIN ({_NEW}) n ON t.s_suppkey = n.s_suppkey")
def _(load, spark):
    return dml.upsert(_supplier(load), _new(load), ["s_suppkey"], {"s_acctbal": "t.s_acctbal + excluded.s_acctbal"}, "t.s_acctbal > 0")


@frame("d4_update", "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_nationkey < 10 THEN s_acctbal * 2 ELSE s_acctbal END AS s_acctbal FROM supplier")
def _(load, spark):
    return dml.update(_supplier(load), {"s_acctbal": "s_acctbal * 2"}, "s_nationkey < 10")


@frame("d4_update_from", "SELECT s_suppkey, CASE WHEN n_regionkey = 1 THEN n_name ELSE s_name END AS s_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def _(load, spark):
    out = dml.update_from(_supplier(load), load("nation"), [("s_nationkey", "n_nationkey")], {"s_name": "s.n_name"}, "s.n_regionkey = 1")
    return out.select("s_suppkey", "s_name")


@frame("d5_delete", "SELECT s_suppkey FROM supplier WHERE NOT coalesce(CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal END < 5000, false)")
def _(load, spark):
    return dml.delete(_supplier(load), "CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal END < 5000").select("s_suppkey")


@frame("d5_delete_using", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def _(load, spark):
    c, n = load("customer"), load("nation").where("n_regionkey = 2")
    return dml.delete_using(c, n, c["c_nationkey"] == n["n_nationkey"]).select("c_custkey")


@frame("d6_returning", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal < 0")
def _(load, spark):
    return dml.returning(_supplier(load), "s_acctbal < 0", ["s_suppkey", "s_name"])


@frame("d7_truncate", "SELECT s_suppkey FROM supplier WHERE false")
def _(load, spark):
    return dml.delete(_supplier(load)).select("s_suppkey")


@frame("d8_d9_create_constraints", "SELECT * FROM (VALUES (1, 'a', 7), (2, 'b', 7), (3, 'c', 9)) t(id, name, score)")
def _(load, spark):
    db = Database(spark)
    db.create_table("made", "id int, name string, score int", Constraints(not_null=("name",), primary_key=("id",), checks=("score > 0",), defaults={"score": 7}, serial=("id",)))
    db.insert("made", [("a",), ("b",)], ["name"])
    db.insert("made", [("c", 9)], ["name", "score"])
    for bad, columns in (([(None,)], ["name"]), ([("d", -1)], ["name", "score"]), ([(1, "x", 1)], None)):
        try:
            db.insert("made", bad, columns)
        except dml.ConstraintError:
            continue
        raise AssertionError("a constraint was not checked")
    return db.query("SELECT * FROM made")


@frame("d9_foreign_keys", "SELECT * FROM (VALUES (10, 1), (11, NULL), (12, 33)) t(id, parent_id)")
def _(load, spark):
    db = Database(spark)
    db.create_table("parents", "id int", Constraints(primary_key=("id",)))
    db.insert("parents", [(1,), (2,), (3,)])
    db.create_table("children", "id int, parent_id int", Constraints(foreign_keys=(ForeignKey("parent_id", "parents", "id", "SET NULL", "CASCADE"),)))
    db.insert("children", [(10, 1), (11, 2), (12, 3)])
    db.delete("parents", "id = 2")
    db.update("parents", {"id": "id * 11"}, "id = 3")
    return db.query("SELECT * FROM children")


@frame("d10_alter", "SELECT r_regionkey AS key, CAST('x' AS VARCHAR) AS extra FROM region")
def _(load, spark):
    db = Database(spark)
    db.create_table("altered", load("region").select("r_regionkey", "r_name"))
    db.alter("altered", dml.add_column, "extra", "string", "x")
    db.alter("altered", dml.drop_column, "r_name")
    db.alter("altered", dml.rename_column, "r_regionkey", "key")
    db.alter("altered", dml.change_type, "key", "int")
    db.rename_table("altered", "renamed")
    return db.query("SELECT * FROM renamed")


@frame("d12_d13_enum_sequence", "SELECT 5 AS a, 8 AS b, 20 AS c, 23 AS d")
def _(load, spark):
    db = Database(spark)
    db.create_enum("mood", ["sad", "ok", "happy"])
    db.create_sequence("s", 5, 3)
    a, b = db.nextval("s"), db.nextval("s")
    c, d = db.setval("s", 20), db.nextval("s")
    return spark.createDataFrame([(a, b, c, d)], "a int, b int, c int, d int")


@frame("d14_d15_views_drop", "SELECT n_name FROM nation WHERE n_regionkey = 3")
def _(load, spark):
    db = Database(spark)
    db.create_table("some_nations", load("nation"))
    db.create_view("asian", "SELECT n_name FROM some_nations WHERE n_regionkey = 3")
    db.create_table("unused", "a int")
    db.drop_table("unused")
    db.drop_table("unused", if_exists=True)
    return db.query("SELECT * FROM asian")


@frame("d16_transactions", "SELECT r_regionkey FROM region WHERE r_regionkey <> 0 UNION ALL SELECT 77")
def _(load, spark):
    db = Database(spark)
    db.create_table("t", load("region").select("r_regionkey"))
    db.begin()
    db.insert("t", [(77,)])
    db.begin()
    db.truncate("t")
    db.rollback()
    db.delete("t", "r_regionkey = 0")
    db.commit()
    db.begin()
    db.delete("t")
    db.rollback()
    return db.query("SELECT * FROM t")


@frame("d18_d20_show_prepared", "SELECT n_nationkey, n_name, '15.0' AS version FROM nation WHERE n_regionkey = 1 AND n_nationkey > 3")
def _(load, spark):
    db = Database(spark)
    db.create_table("prepared_nation", load("nation"))
    return db.query("SELECT n_nationkey, n_name FROM prepared_nation WHERE n_regionkey = :r AND n_nationkey > :k", r=1, k=3).withColumn("version", F.lit(db.show("server_version")))


@frame("d19_explain", "SELECT true AS scans")
def _(load, spark):
    db = Database(spark)
    db.create_table("explained", load("region"))
    return spark.createDataFrame([("FileScan" in db.explain("SELECT r_name FROM explained") or "Scan parquet" in db.explain("SELECT r_name FROM explained"),)], "scans boolean")
