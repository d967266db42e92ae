"""Row numbers of few large partitions against the plain window."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.operators import windows
from lakeloom.plans import registry
from lakeloom.plans import analytic  # noqa: F401


def test_spread_row_number(spark):
    df = spark.range(600).selectExpr("IF(id % 5 = 0, NULL, id % 3) AS p", "IF(id % 7 = 0, NULL, id % 11) AS day", "IF(id = 9, NULL, id) AS id")
    rest = [F.col("id").asc_nulls_last()]
    for descending in (True, False):
        order = F.col("day").desc_nulls_last() if descending else F.col("day").asc_nulls_last()
        expected = df.withColumn("n", F.row_number().over(Window.partitionBy("p").orderBy(order, *rest)))
        found = windows.spread_row_number(df, ["p"], "day", rest, descending)
        assert found.columns == expected.columns and found.count() == 600
        assert {tuple(r) for r in found.collect()} == {tuple(r) for r in expected.collect()}


def test_rows_of_a_flag_do_not_meet_in_one_task(spark):
    df = registry.QUERIES["w11_w12_multi_key"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" in plan and dict(df.dtypes)["n"] == "bigint"
    line = next(x for x in plan.splitlines() if "row_number() windowspecdefinition" in x)
    assert "row_number() windowspecdefinition(l_returnflag" in line and "l_shipdate" in line.split("windowspecdefinition(")[1].split("ASC")[0]
