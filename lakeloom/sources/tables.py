"""Parquet tables of a folder, as DataFrames and temporary views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Tables of the bundled test data.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table. Columns and filters are pushed into the scan by the optimizer."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, text: str | None = None) -> None:
    """Register the tables (only those that ``text`` names, if given) as temporary views."""
    words = set(re.findall(r"\w+", text.lower())) if text is not None else set(TABLES)
    for name in TABLES:
        if name in words:
            load(spark, folder, name).createOrReplaceTempView(name)


def foreign_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A read-only view of a Parquet file or folder."""
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(name)
    return df
