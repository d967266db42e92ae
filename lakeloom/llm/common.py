"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession


#: Spark deletes the shuffle files of an action when it ends, if this setting is on.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a few numbers that one task takes.
TASK_ROWS = 100_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only where it is unset and the master is local (tests) make a folder of our own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    given = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not given and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that the driver and all executors share")
    context.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoint-"))


@contextmanager
def _shuffles_end_with_the_action(spark: SparkSession) -> Iterator[None]:
    """Within, shuffle files are deleted when the action that wrote them ends; what it made is in the shared folder by then."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there, so that a lost executor costs no rerun."""
    ensure_checkpoint_dir(df.sparkSession)
    with _shuffles_end_with_the_action(df.sparkSession):
        return df.checkpoint(eager=True)


def tasks_for(rows: int) -> int:
    """So many tasks for a counted number of rows of a few numbers."""
    return max(1, -(-rows // TASK_ROWS))


class Scratch:
    """Intermediate tables as Parquet in a folder of the shared one: smaller than checkpoints, and deleted by name, at the latest when the application ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self._path(self.folder)[0].deleteOnExit(self._path(self.folder)[1])

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it from there; a table of that name is replaced."""
        with _shuffles_end_with_the_action(self.spark):
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            files, path = self._path(f"{self.folder}/{name}")
            files.delete(path, True)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 8 << 20, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no piece holds more than ``max_bytes`` of ``column``, unless one row alone does."""
    values = batch.column(batch.schema.get_field_index(column))
    lengths = [0 if x is None else x for x in pa.compute.binary_length(values).to_pylist()]
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and (size + n > max_bytes or i - start >= max_rows):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield batch.slice(start)


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, with underscores added until no column has that name (Spark compares names without case)."""
    lowered = {x.lower() for x in taken}
    while wanted.lower() in lowered:
        wanted += "_"
    return wanted


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()
