"""Nearest neighbours of many queries against brute force."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.functions.vectors import DISTANCES
from lakeloom.operators import vector


def test_nearest_of_each_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "QUERY_BLOCK", 4)
    rows = [(i, [float(i * 37 % 101), float(i * 53 % 89)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = vector.nearest_of_each(df, df.where("vec_id % 20 = 0"), "embedding", "vec_id", "vec_id", 3)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Cross") > 1
    assert "WindowGroupLimit" in found._jdf.queryExecution().optimizedPlan().toString()
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    expected = {(q, min_id, place) for q, v in rows if q % 20 == 0 for place, (_, min_id) in enumerate(sorted((distance(v, x), i) for i, x in rows)[:3], 1)}
    assert {(r.query_id, r.vec_id, r.place) for r in found.collect()} == expected


def test_nearest_of_each_of_odd_rows(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vector, "ROW_BLOCK", 7)
    nan, inf = float("nan"), float("inf")
    odd = [None, [1.0, None], [1.0], [nan, 0.0], [inf, 1.0], [1e200, 1.0], [1e-200, 0.0], [0.0, 0.0], []]
    rows = [(i, [float(i * 37 % 11), float(i * 53 % 7)]) for i in range(40)] + [(40 + i, v) for i, v in enumerate(odd)] + [(None, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = df.where("vec_id % 6 = 0 OR vec_id > 40")
    for metric in ("l2", "ip", "cosine"):
        if metric == "cosine":  # as an expression it is 1 for a vector of zeros and one of another size
            df, queries = (x.where("embedding IS NULL OR size(embedding) = 2") for x in (df, queries))
        pairs = df.crossJoin(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q")))
        pairs = pairs.select("query_id", "vec_id", DISTANCES[metric](F.col("embedding"), F.col("_q")).alias("distance"))
        rank = F.sqrt("distance") if metric == "l2" else F.col("distance")
        w = Window.partitionBy("query_id").orderBy(rank.asc_nulls_last(), F.col("vec_id").asc_nulls_last())
        expected = {(r.query_id, r.place): r for r in pairs.withColumn("place", F.row_number().over(w)).where("place <= 5").collect()}
        found = vector.nearest_of_each(df, queries, "embedding", "vec_id", "vec_id", 5, metric).collect()
        assert len(found) == len(expected)
        for r in found:
            e = expected[r.query_id, r.place]
            assert r.vec_id == e.vec_id and (r.distance == e.distance or r.distance == pytest.approx(e.distance, abs=0, nan_ok=True)), (metric, r, e)


def test_nearest_of_each_forms_no_pairs(spark):
    df = spark.range(400).selectExpr("id AS vec_id", "array(double(id % 17), double(id % 23)) AS embedding")
    found = vector.nearest_of_each(df, df.where("vec_id % 20 = 0"), "embedding", "vec_id", "vec_id", 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "_query#" not in plan
    assert vector.nearest_of_each(df, df.where("false"), "embedding", "vec_id", "vec_id", 3).count() == 0
