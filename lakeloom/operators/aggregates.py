"""Aggregates with the dialect's null and order rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_agg(x: str, order: str | None = None) -> Column:
    """All values as an array, nulls kept, by ``order`` if given (nulls last)."""
    if order is None:
        return F.transform(F.collect_list(F.struct(F.col(x).alias("v"))), lambda s: s["v"])
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).isNull().alias("n"), F.col(order).alias("k"), F.col(x).alias("v"))))
    return F.transform(rows, lambda s: s["v"])


def array_text(values: Column) -> Column:
    """An array as ``{a,NULL,b}``; of no rows: null."""
    shown = F.transform(values, lambda v: F.coalesce(v.cast("string"), F.lit("NULL")))
    return F.when(F.size(values) > 0, F.concat(F.lit("{"), F.array_join(shown, ","), F.lit("}")))


def string_agg(x: str, separator: str, order: str | None = None) -> Column:
    """Non-null values joined, by ``order`` (then value) if given; null if there are none."""
    rows = F.collect_list(F.when(F.col(x).isNotNull(), F.struct(F.col(order or x).alias("k"), F.col(x).cast("string").alias("v"))))
    rows = F.array_sort(rows) if order else rows
    return F.when(F.size(rows) > 0, F.array_join(F.transform(rows, lambda s: s["v"]), separator))


def filtered(aggregate, x: Column, condition: Column) -> Column:
    """An aggregate with FILTER (WHERE condition)."""
    return aggregate(F.when(condition, x))
