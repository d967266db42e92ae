"""A database of named, versioned tables over one Spark session.

Tables are immutable DataFrames, so a transaction is a stack of snapshots of names, and rolling back costs nothing. Constraints are
checked by queries before a new version takes a table's name.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping
from contextlib import suppress
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.operators import dml
from lakeloom.sources import catalog


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    key: str
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"
    default: object = None


@dataclass(frozen=True)
class Constraints:
    not_null: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    primary_key: tuple[str, ...] = ()
    checks: tuple[str, ...] = ()
    defaults: Mapping[str, object] = field(default_factory=dict)
    serial: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()


class Database:
    """Tables, views, sequences, enum types and transactions."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        self.constraints: dict[str, Constraints] = {}
        self.views: dict[str, str] = {}
        self.sequences: dict[str, list[int]] = {}  # next value, step
        self.enums: dict[str, list[str]] = {}
        self._snapshots: list[tuple[dict, dict, dict]] = []

    # --- definition ---

    def create_table(self, name: str, schema: str | T.StructType | DataFrame, constraints: Constraints = Constraints(), if_not_exists: bool = False) -> None:
        """An empty table of a schema, or one filled from a query (CREATE TABLE AS)."""
        if name in self.tables:
            if if_not_exists:
                return
            raise dml.ConstraintError("42P07", f"table {name} exists")
        self.constraints[name] = constraints
        self._set(name, schema if isinstance(schema, DataFrame) else self.spark.createDataFrame([], schema))

    def create_like(self, name: str, other: str) -> None:
        self.create_table(name, self.tables[other].schema, self.constraints[other])

    def drop_table(self, name: str, if_exists: bool = False) -> None:
        if name not in self.tables:
            if if_exists:
                return
            raise dml.ConstraintError("42P01", f"table {name} does not exist")
        del self.tables[name], self.constraints[name]
        self.spark.catalog.dropTempView(name)

    def create_view(self, name: str, text: str) -> None:
        """A view is its text, analyzed over the tables that have these names when it is read."""
        self.spark.sql(text).createOrReplaceTempView(name)
        self.views[name] = text

    def _refresh_views(self) -> None:
        """Views are analyzed again, in the order in which they were made, so that they see the present tables. One whose table is gone goes on as it was."""
        for name, text in self.views.items():
            with suppress(AnalysisException):
                self.spark.sql(text).createOrReplaceTempView(name)

    def drop_view(self, name: str) -> None:
        del self.views[name]
        self.spark.catalog.dropTempView(name)

    def create_enum(self, name: str, labels: list[str]) -> None:
        self.enums[name] = labels

    def create_sequence(self, name: str, start: int = 1, step: int = 1) -> None:
        self.sequences[name] = [start, step]

    def nextval(self, name: str) -> int:
        value, step = self.sequences[name]
        self.sequences[name][0] = value + step
        return value

    def currval(self, name: str) -> int:
        return self.sequences[name][0] - self.sequences[name][1]

    def setval(self, name: str, value: int) -> int:
        self.sequences[name][0] = value + self.sequences[name][1]
        return value

    def alter(self, name: str, change, *args) -> None:
        """A schema change of ``operators.dml`` applied to a table."""
        self._set(name, change(self.tables[name], *args))

    def rename_table(self, old: str, new: str) -> None:
        self.constraints[new] = self.constraints.pop(old)
        self._set(new, self.tables.pop(old))
        self.spark.catalog.dropTempView(old)

    def set_constraints(self, name: str, **changes) -> None:
        """SET and DROP of DEFAULT and NOT NULL; what is there must satisfy the new rules."""
        before = self.constraints[name]
        self.constraints[name] = replace(before, **changes)
        try:
            self._check(name, self.tables[name])
        except dml.ConstraintError:
            self.constraints[name] = before
            raise

    # --- rows ---

    def insert(self, name: str, rows: DataFrame | list[tuple], columns: list[str] | None = None) -> DataFrame:
        """Add rows and return them (RETURNING). Missing columns get sequence numbers, defaults or null."""
        table, rules = self.tables[name], self.constraints[name]
        if not isinstance(rows, DataFrame):
            fields = [table.schema[c] for c in columns] if columns else table.schema.fields
            rows = self.spark.createDataFrame(rows, T.StructType([T.StructField(f.name, f.dataType) for f in fields]))
        for column in rules.serial:
            if column not in rows.columns:
                key = f"{name}_{column}_seq"
                self.sequences.setdefault(key, [1, 1])
                start = self.sequences[key][0]
                rows, n = _numbered(rows, column, start)
                self.sequences[key][0] = start + n
        new = dml.insert(table.limit(0), rows, rules.defaults)
        self._replace(name, table.unionByName(new))
        return new

    def upsert(self, name: str, rows: DataFrame, keys: list[str], assignments: Mapping[str, str] | None = None, where: str | None = None) -> None:
        self._replace(name, dml.upsert(self.tables[name], rows, keys, assignments, where))

    def update(self, name: str, assignments: Mapping[str, object], where: str | None = None) -> DataFrame:
        """Change rows; returns those that the condition chose, as they were."""
        table = self.tables[name]
        self._replace(name, dml.update(table, assignments, where), {c: (assignments[c], where) for c in assignments})
        return table.where(where or "true")

    def delete(self, name: str, where: str | None = None) -> DataFrame:
        """Delete rows and return them; children follow their foreign keys' actions."""
        gone = self.tables[name].where(where or "true")
        self.delete_rows(name, gone, dml.delete(self.tables[name], where))
        return gone

    def delete_rows(self, name: str, gone: DataFrame, kept: DataFrame) -> None:
        """A table without the rows ``gone``. All tables that follow are made and checked before the first one is replaced."""
        made = {name: kept}
        todo = [(name, gone)]
        while todo:
            parent, lost = todo.pop()
            for child, rules in self.constraints.items():
                for fk in rules.foreign_keys:
                    if fk.parent != parent:
                        continue
                    now = made.get(child, self.tables[child])
                    made[child] = dml.on_parent_delete(now, fk.column, lost, fk.key, fk.on_delete, rules.defaults.get(fk.column, fk.default))
                    if fk.on_delete == "CASCADE":
                        keys = lost.select(F.col(fk.key).alias("_gone")).distinct()
                        more = now.join(keys, F.col(fk.column) == F.col("_gone"), "left_semi")
                        if not more.isEmpty():
                            todo.append((child, more))
        for table, df in made.items():
            self._set(table, df)

    def truncate(self, *names: str, cascade: bool = False) -> None:
        """Empty tables. Others that refer to them are emptied too with ``cascade``; else it is an error."""
        found = list(names)
        for name in found:
            for child, rules in self.constraints.items():
                if child not in found and any(fk.parent == name for fk in rules.foreign_keys):
                    if not cascade:
                        raise dml.ConstraintError("0A000", f"{child} refers to {name}")
                    found.append(child)
        for name in found:
            self._set(name, self.tables[name].limit(0))

    def query(self, text: str, **args) -> DataFrame:
        """Run SQL over the tables and views; ``:name`` parameters take ``args`` (a prepared statement)."""
        return self.spark.sql(text, args=args or None)

    def show(self, parameter: str) -> str | None:
        return catalog.PARAMETERS.get(parameter.lower())

    def explain(self, text: str, mode: str = "formatted") -> str:
        return self.spark.sql(f"EXPLAIN {mode.upper()} {text}").first()[0]

    # --- transactions ---

    def begin(self) -> None:
        """Start a transaction, or a nested one."""
        self._snapshots.append((dict(self.tables), dict(self.constraints), dict(self.views)))

    def commit(self) -> None:
        self._snapshots.pop()

    def rollback(self) -> None:
        before = self._snapshots.pop()
        for name in set(self.tables) - set(before[0]):
            self.spark.catalog.dropTempView(name)
        self.tables, self.constraints, self.views = before
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)
        self._refresh_views()

    # --- inner ---

    def _set(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df
        df.createOrReplaceTempView(name)
        self._refresh_views()

    def _replace(self, name: str, df: DataFrame, changed: Mapping | None = None) -> None:
        self._check(name, df)
        made: dict[str, DataFrame] = {}
        for child, rules in self.constraints.items():
            for fk in rules.foreign_keys:
                if fk.parent != name or not changed or fk.key not in changed:
                    continue
                value, where = changed[fk.key]
                keys = self.tables[name].where(where or "true").select(F.col(fk.key).alias("o"), dml._column(value).cast(self.tables[name].schema[fk.key].dataType).alias("n")).where("NOT (o <=> n)")
                now = made.get(child, self.tables[child])
                if fk.on_update == "CASCADE":
                    made[child] = dml.on_parent_update(now, fk.column, keys, "o", "n")
                else:  # only keys that no row has any more
                    lost = keys.join(df.select(F.col(fk.key).alias("still")), F.col("o") == F.col("still"), "left_anti")
                    made[child] = dml.on_parent_delete(now, fk.column, lost, "o", fk.on_update, rules.defaults.get(fk.column, fk.default))
        for child, new in made.items():
            self._set(child, new)
        self._set(name, df)

    def _check(self, name: str, df: DataFrame) -> None:
        rules = self.constraints[name]
        dml.check_not_null(df, list(rules.not_null))
        for key in rules.unique:
            dml.check_unique(df, list(key))
        if rules.primary_key:
            dml.check_unique(df, list(rules.primary_key), primary=True)
        for condition in rules.checks:
            dml.check_condition(df, condition)
        for fk in rules.foreign_keys:
            dml.check_foreign_key(df, fk.column, self.tables[fk.parent], fk.key)


def _numbered(rows: DataFrame, column: str, start: int) -> tuple[DataFrame, int]:
    """Rows with consecutive numbers from ``start``: each partition's offset is the number of rows before it, no single task orders them all."""
    tagged = rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row"))
    sizes = {r["_part"]: r["count"] for r in tagged.groupBy("_part").count().collect()}
    offsets = dict(zip(sorted(sizes), itertools.accumulate([start, *(sizes[p] for p in sorted(sizes))])))
    if not offsets:
        return rows.withColumn(column, F.lit(start)), 0
    table = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])
    numbered = tagged.withColumn(column, table[F.col("_part")] + (F.col("_row") - F.shiftleft(F.col("_part").cast("long"), 33)))
    return numbered.drop("_part", "_row"), sum(sizes.values())
