"""Window frames that Spark lacks: GROUPS, EXCLUDE and FILTER; row numbers in few large partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_group_number(df: DataFrame, partition: list[str], order: list[Column], name: str = "_group") -> DataFrame:
    """Adds the number of each row's peer group within its partition."""
    return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))


def groups_frame(df: DataFrame, partition: list[str], order: list[Column], start: int, stop: int, **aggregates: Column) -> DataFrame:
    """Aggregates over GROUPS BETWEEN start AND stop (negative: preceding), as a RANGE frame over peer group numbers."""
    w = Window.partitionBy(*partition).orderBy("_group").rangeBetween(start, stop)
    out = with_group_number(df, partition, order)
    for name, aggregate in aggregates.items():
        out = out.withColumn(name, aggregate.over(w))
    return out.drop("_group")


def spread_row_number(df: DataFrame, partition: list[str], first: str, rest: list[Column], descending: bool = False, name: str = "n") -> DataFrame:
    """Adds ROW_NUMBER() OVER (PARTITION BY partition ORDER BY first, rest), nulls of ``first`` last, for few and large partitions.

    The rows of one value of ``first`` are numbered by themselves, after as many as the values before it have; those are counted.
    So what must meet in one task are the rows of a value, not those of a partition.
    """
    keys = [*partition, first]
    order = F.col(first).desc_nulls_last() if descending else F.col(first).asc_nulls_last()
    before = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows")).withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    counts = counts.select(*[F.col(c).alias(f"_of_{c}") for c in keys], "_before")
    numbered = df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*rest)))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys])
    return numbered.join(counts, same).withColumn(name, F.col("_place") + F.col("_before")).select(*df.columns, name)


def sum_excluding_current(x: str, w) -> Column:
    """SUM over a frame with EXCLUDE CURRENT ROW, for frames that hold the current row; null where no other value is."""
    others = F.count(x).over(w) - F.when(F.col(x).isNotNull(), 1).otherwise(0)
    return F.when(others > 0, F.sum(x).over(w) - F.coalesce(F.col(x), F.lit(0)))


def count_excluding_current(x: str, w) -> Column:
    return F.count(x).over(w) - F.when(F.col(x).isNotNull(), 1).otherwise(0)


def sum_excluding_peers(x: str, partition: list[str], order: list[str], w, keep_current: bool = False) -> Column:
    """SUM over a whole-partition frame with EXCLUDE GROUP, or EXCLUDE TIES (which keeps the current row)."""
    peers = Window.partitionBy(*partition, *order)
    own = F.coalesce(F.col(x), F.lit(0)) if keep_current else F.lit(0)
    n = F.count(x).over(w) - F.count(x).over(peers) + (F.when(F.col(x).isNotNull(), 1).otherwise(0) if keep_current else F.lit(0))
    return F.when(n > 0, F.sum(x).over(w) - F.coalesce(F.sum(x).over(peers), F.lit(0)) + own)


def filtered(aggregate, x: Column, condition: Column, w) -> Column:
    """An aggregate OVER with FILTER (WHERE condition)."""
    return aggregate(F.when(condition, x)).over(w)
