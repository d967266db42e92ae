"""Table modification as functions from DataFrames to DataFrames: the old table goes in, the new one comes out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    """A constraint does not hold; ``code`` is its SQLSTATE."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.expr(x)


def insert(table: DataFrame, rows: DataFrame, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """The table and new rows; columns that the rows lack get their default, or null."""
    given = {c.lower(): c for c in rows.columns}

    def value(f) -> Column:
        if f.name.lower() not in given:
            return F.lit((defaults or {}).get(f.name)).cast(f.dataType)
        c = given[f.name.lower()]
        if f.dataType.simpleString().startswith("array") and rows.schema[c].dataType.simpleString() == "string":  # a vector's text
            return F.from_json(F.col(c), "array<double>").cast(f.dataType)
        return F.col(c).cast(f.dataType)

    made = [value(f).alias(f.name) for f in table.schema.fields]
    return table.unionByName(rows.select(*made))


def update(table: DataFrame, assignments: Mapping[str, object], where=None) -> DataFrame:
    """Columns set, all from the old values, in the rows for which ``where`` is true."""
    hit = F.lit(True) if where is None else F.coalesce(_column(where), F.lit(False))
    return table.select(*[F.when(hit, _column(assignments[f.name]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in assignments else F.col(f.name) for f in table.schema.fields])


def update_from(table: DataFrame, source: DataFrame, keys: list[tuple[str, str]], assignments: Mapping[str, str], where: str | None = None) -> DataFrame:
    """UPDATE .. FROM: rows whose keys match a source row take values computed from both (``s.`` names the source's columns).

    One source row is used for each key, the least; rows without a match stay as they are.
    """
    key = [s for _, s in keys]
    one = source.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*source.columns))).where("_nth = 1").drop("_nth")
    t, s = table.alias("t"), one.withColumn("_hit", F.lit(True)).alias("s")
    condition = F.lit(True)
    for a, b in keys:
        condition = condition & (F.col(f"t.{a}") == F.col(f"s.{b}"))
    hit = F.coalesce(F.col("s._hit"), F.lit(False)) & (F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True))
    return t.join(s, condition, "left").select(*[F.when(hit, F.expr(assignments[f.name]).cast(f.dataType)).otherwise(F.col(f"t.{f.name}")).alias(f.name) if f.name in assignments else F.col(f"t.{f.name}") for f in table.schema.fields])


def delete(table: DataFrame, where=None) -> DataFrame:
    """The rows for which ``where`` is not true (false or null)."""
    return table.limit(0) if where is None else table.where(~F.coalesce(_column(where), F.lit(False)))


def delete_using(table: DataFrame, source: DataFrame, on: Column) -> DataFrame:
    """DELETE .. USING: the rows that match no source row."""
    return table.join(source, on, "left_anti")


def returning(table: DataFrame, where, columns: list[str] | None = None) -> DataFrame:
    """The rows that a statement with this condition touches, before it."""
    return table.where(_column(where)).select(*(columns or ["*"]))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], assignments: Mapping[str, str] | None = None, where: str | None = None) -> DataFrame:
    """INSERT .. ON CONFLICT (keys): without ``assignments`` DO NOTHING, else DO UPDATE SET them (``t.`` old row, ``excluded.`` new row).

    One full outer join on the keys. Of new rows with equal keys DO NOTHING takes the least; DO UPDATE raises, as the statement would.
    Null keys never conflict.
    """
    names = table.columns
    nulls = F.lit(False)
    for k in keys:
        nulls = nulls | F.col(k).isNull()
    free = rows.where(nulls)
    keyed = rows.where(~nulls).withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*rows.columns)))
    if assignments is None:
        keyed = keyed.where("_nth = 1")
    else:
        keyed = keyed.withColumn("_nth", F.when(F.col("_nth") == 1, 1).otherwise(F.raise_error(F.lit("ON CONFLICT DO UPDATE command cannot affect row a second time")).cast("int")))
    t, e = table.withColumn("_old", F.lit(True)).alias("t"), keyed.alias("excluded")
    condition = F.lit(True)
    for k in keys:
        condition = condition & (F.col(f"t.{k}") == F.col(f"excluded.{k}"))
    old, new = F.col("t._old").isNotNull(), F.col("excluded._nth") == 1
    hit = new & (F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True))
    made = []
    for f in table.schema.fields:
        kept = F.col(f"t.{f.name}")
        if assignments and f.name in assignments:
            kept = F.when(hit, F.expr(assignments[f.name]).cast(f.dataType)).otherwise(kept)
        made.append(F.when(old, kept).otherwise(F.col(f"excluded.{f.name}").cast(f.dataType)).alias(f.name))
    return t.join(e, condition, "full").select(*made).unionByName(free.select(*names))


# --- constraints ---


def check_not_null(table: DataFrame, columns: list[str]) -> None:
    if columns and not table.where(" OR ".join(f"`{c}` IS NULL" for c in columns)).limit(1).isEmpty():
        raise ConstraintError("23502", f"null value in one of {columns}")


def check_unique(table: DataFrame, columns: list[str], primary: bool = False) -> None:
    """No two rows with equal, non-null keys; of a primary key no nulls either. Counts are pre-aggregated before their shuffle."""
    if primary:
        check_not_null(table, columns)
    keyed = table.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    if not keyed.groupBy(*columns).count().where("count > 1").limit(1).isEmpty():
        raise ConstraintError("23505", f"duplicate key value of {columns}")


def check_condition(table: DataFrame, condition: str) -> None:
    """A CHECK condition is false for no row; null passes."""
    if not table.where(f"NOT ({condition})").limit(1).isEmpty():
        raise ConstraintError("23514", f"a row violates {condition}")


def check_foreign_key(child: DataFrame, column: str, parent: DataFrame, key: str) -> None:
    lost = child.where(F.col(column).isNotNull()).select(F.col(column).alias("_fk")).join(parent.select(F.col(key).alias("_pk")), F.col("_fk") == F.col("_pk"), "left_anti")
    if not lost.limit(1).isEmpty():
        raise ConstraintError("23503", f"{column} has values that are no {key}")


def on_parent_delete(child: DataFrame, column: str, gone: DataFrame, key: str, action: str, default: object = None) -> DataFrame:
    """The child table after parents with ``gone``'s keys are deleted: RESTRICT, CASCADE, SET NULL or SET DEFAULT."""
    keys = gone.select(F.col(key).alias("_gone")).distinct()
    if action in ("RESTRICT", "NO ACTION"):
        if not child.join(keys, F.col(column) == F.col("_gone"), "left_semi").limit(1).isEmpty():
            raise ConstraintError("23503", f"rows are still referenced by {column}")
        return child
    if action == "CASCADE":
        return child.join(keys, F.col(column) == F.col("_gone"), "left_anti")
    value = F.lit(None if action == "SET NULL" else default).cast(child.schema[column].dataType)
    joined = child.join(keys, F.col(column) == F.col("_gone"), "left")
    return joined.select(*[F.when(F.col("_gone").isNotNull(), value).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in child.columns])


def on_parent_update(child: DataFrame, column: str, changed: DataFrame, old: str, new: str) -> DataFrame:
    """ON UPDATE CASCADE: children follow keys that changed from ``old`` to ``new``."""
    keys = changed.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
    return child.join(keys, F.col(column) == F.col("_old"), "left").select(*[F.when(F.col("_old").isNotNull(), F.col("_new")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in child.columns])


# --- schema changes ---


def add_column(table: DataFrame, name: str, kind: str, default: object = None) -> DataFrame:
    return table.withColumn(name, F.lit(default).cast(kind))


def drop_column(table: DataFrame, name: str) -> DataFrame:
    return table.drop(name)


def rename_column(table: DataFrame, old: str, new: str) -> DataFrame:
    return table.withColumnRenamed(old, new)


def change_type(table: DataFrame, name: str, kind: str) -> DataFrame:
    return table.withColumn(name, F.col(name).cast(kind))
