"""System catalog tables over what the session knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Type names of the SQL dialect for Spark's.
TYPE_NAMES = {"smallint": "smallint", "int": "integer", "bigint": "bigint", "double": "double precision", "float": "real", "string": "text", "boolean": "boolean", "date": "date", "timestamp": "timestamp with time zone", "timestamp_ntz": "timestamp without time zone"}
# Object ids of those types.
TYPE_OIDS = {"boolean": 16, "bigint": 20, "smallint": 21, "integer": 23, "text": 25, "real": 700, "double precision": 701, "date": 1082, "timestamp without time zone": 1114, "timestamp with time zone": 1184}
#: Values that SHOW reports.
PARAMETERS = {"server_version": "15.0", "server_encoding": "UTF8", "client_encoding": "UTF8", "timezone": "UTC", "datestyle": "ISO, MDY", "standard_conforming_strings": "on", "search_path": '"$user", public', "transaction_isolation": "read committed", "is_superuser": "on"}


def tables(spark: SparkSession) -> DataFrame:
    """information_schema.tables of temporary views and tables."""
    rows = [("public", t.name, "VIEW" if t.isTemporary or t.tableType == "VIEW" else "BASE TABLE") for t in spark.catalog.listTables() if not t.name.startswith("_")]
    return spark.createDataFrame(rows, "table_schema string, table_name string, table_type string")


def columns(spark: SparkSession) -> DataFrame:
    """information_schema.columns of the same."""
    rows = []
    for t in spark.catalog.listTables():
        if not t.name.startswith("_"):
            rows += [("public", t.name, f.name, i, "YES" if f.nullable else "NO", TYPE_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString())) for i, f in enumerate(spark.table(t.name).schema.fields, 1)]
    return spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string")


def pg_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The pg_ tables that tools ask for most: namespaces, types, classes, attributes, settings, databases and roles."""
    names = [t.name for t in spark.catalog.listTables() if not t.name.startswith("_")]
    oid = {n: 16384 + i for i, n in enumerate(sorted(names))}
    attributes = [(oid[n], f.name, TYPE_OIDS.get(TYPE_NAMES.get(f.dataType.simpleString(), ""), 0), i, not f.nullable) for n in names for i, f in enumerate(spark.table(n).schema.fields, 1)]
    made = {
        "pg_namespace": ([(11, "pg_catalog"), (2200, "public")], "oid int, nspname string"),
        "pg_type": ([(o, n) for n, o in TYPE_OIDS.items()], "oid int, typname string"),
        "pg_class": ([(oid[n], n, 2200, "v") for n in names], "oid int, relname string, relnamespace int, relkind string"),
        "pg_attribute": (attributes, "attrelid int, attname string, atttypid int, attnum int, attnotnull boolean"),
        "pg_settings": (list(PARAMETERS.items()), "name string, setting string"),
        "pg_database": ([(1, "lakeloom")], "oid int, datname string"),
        "pg_roles": ([(10, "lakeloom", True)], "oid int, rolname string, rolsuper boolean"),
    }
    return {n: spark.createDataFrame(rows, schema) for n, (rows, schema) in made.items()}
