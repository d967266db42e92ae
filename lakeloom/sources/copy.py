"""COPY in and out: tab-separated text with \\N for null, and plain CSV, both without quoting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _options(csv: bool, header: bool) -> dict[str, str]:
    return {"sep": "," if csv else "\t", "nullValue": "" if csv else "\\N", "emptyValue": "", "quote": "\u0000", "escape": "\u0000", "header": str(header).lower()}


def copy_from(spark: SparkSession, path: str, schema: str | T.StructType, csv: bool = False, header: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Rows of a file in the table's schema. With ``columns`` the file has only these; the others are null. A bad value raises."""
    whole = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    part = T.StructType([whole[c] for c in columns]) if columns else whole
    read = spark.read.options(**_options(csv, header)).option("mode", "FAILFAST").schema(part).csv(path)
    return read.select(*[F.col(f.name) if f.name in part.names else F.lit(None).cast(f.dataType).alias(f.name) for f in whole.fields])


def copy_to(df: DataFrame, path: str, csv: bool = False, header: bool = False) -> None:
    """Write a table; one part file a task, so any size is written in parallel."""
    df.write.mode("overwrite").options(**_options(csv, header)).csv(path)


def lines(df: DataFrame, csv: bool = False, header: bool = False) -> DataFrame:
    """The lines that ``copy_to`` writes, a column ``line``; the header comes first."""
    given = _options(csv, header)
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(given["nullValue"])) for c in df.columns]
    body = df.select(F.concat_ws(given["sep"], *cells).alias("line"))
    return df.sparkSession.createDataFrame([(given["sep"].join(df.columns),)], "line string").union(body) if header else body
