"""DISTINCT ON, set operations, series, recursion and subquery comparisons."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order. Spark turns the row_number filter into a partial top-1 before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first_of_key", F.row_number().over(w)).where("_first_of_key = 1").drop("_first_of_key")


def semi_join(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on, "left_semi")


def anti_join(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on, "left_anti")


def series(spark: SparkSession, start, stop, step=1, name: str = "generate_series", rows_per_block: int = 1 << 20) -> DataFrame:
    """Numbers from ``start`` to ``stop``, both included. A step of 0 raises. It is a distributed range, not one task's array."""
    if step == 0:
        raise ValueError("step size cannot equal zero")
    n = (stop - start) // step + 1
    return spark.range(max(n, 0)).select((F.col("id") * step + start).alias(name))


def date_series(spark: SparkSession, start: str, stop: str, interval: str, name: str = "generate_series", kind: str = "timestamp_ntz") -> DataFrame:
    """Dates or timestamps from ``start`` to ``stop`` by an interval such as ``1 month``.

    Each is the one before plus the interval, so that after a short month the day stays low: January 31, February 29, March 29.
    """
    first, last, step = f"CAST('{start}' AS {kind})", f"CAST('{stop}' AS {kind})", f"INTERVAL {interval}"
    steps = f"sequence({first}, {last}, {step})"
    if any(unit in interval.lower() for unit in ("month", "mon ", "year", "quarter")):
        chain = f"aggregate(sequence(1, size({steps})), array({first}), (done, i) -> concat(done, array(element_at(done, -1) + {step})))"
        return spark.sql(f"SELECT {name} FROM (SELECT explode({chain}) AS {name}) WHERE {name} <= {last}")
    return spark.sql(f"SELECT explode({steps}) AS {name}")


def stable(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, and read from there."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        given = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not given and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that the driver and all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def recursive(seed: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, limit: int = 10_000) -> DataFrame:
    """WITH RECURSIVE: ``seed`` and what ``step`` makes of each round's new rows, until a round makes none.

    With ``distinct`` (UNION) rows met before are dropped, null-safe; without it (UNION ALL) all rows count. Rounds are checkpointed in
    the shared folder, so lineage does not grow; more than ``limit`` rounds raise.
    """
    new = stable(seed.distinct() if distinct else seed)
    parts, everything = [new], new
    for _ in range(limit):
        made = step(new)
        new = stable(made.select(*seed.columns).distinct().subtract(everything) if distinct else made.select(*seed.columns))
        if new.isEmpty():
            return everything
        parts.append(new)
        everything = everything.unionByName(new)
        if len(parts) % 16 == 0:
            everything = stable(everything)
    raise RuntimeError(f"recursion did not end within {limit} rounds")


def compare_any(df: DataFrame, column: str, op: str, values: DataFrame) -> DataFrame:
    """Rows for which ``column op ANY (values)`` is true: a semi-join for equality, else a comparison with the extreme value."""
    name = values.columns[0]
    if op == "=":
        return df.join(values.distinct(), df[column] == values[name], "left_semi")
    if op in ("<>", "!="):
        span = values.agg(F.min(name).alias("_lo"), F.max(name).alias("_hi"))
        return df.join(F.broadcast(span), (df[column] != span["_lo"]) | (df[column] != span["_hi"]), "left_semi")
    extreme = values.agg((F.max if op in ("<", "<=") else F.min)(name).alias("_x"))  # one row
    return df.join(F.broadcast(extreme), F.expr(f"`{column}` {op} _x"), "left_semi")


def compare_all(df: DataFrame, column: str, op: str, values: DataFrame) -> DataFrame:
    """Rows for which ``column op ALL (values)`` is true. No values: all rows; a null among them: none that depend on it."""
    name = values.columns[0]
    facts = values.agg(F.count("*").alias("_n"), F.count(name).alias("_k"), F.min(name).alias("_lo"), F.max(name).alias("_hi"))
    if op in ("<>", "!="):
        rest = df.join(F.broadcast(facts), (F.col("_n") == 0) | (F.col("_n") == F.col("_k")) & df[column].isNotNull(), "left_semi")
        return rest.join(values.distinct(), rest[column] == values[name], "left_anti")
    bound = {"<": f"`{column}` < _lo", "<=": f"`{column}` <= _lo", ">": f"`{column}` > _hi", ">=": f"`{column}` >= _hi", "=": f"`{column}` = _lo AND `{column}` = _hi"}[op]
    return df.join(F.broadcast(facts), F.expr(f"_n = 0 OR (_n = _k AND {bound})"), "left_semi")
