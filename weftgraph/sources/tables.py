"""Parquet tables, intermediate tables in the shared checkpoint folder, and checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows that is ever broadcast by hand (ids and similar narrow rows: about 30 MB as a hash relation).
BROADCAST_ROWS = 100_000

_written: list[tuple[SparkSession, str]] = []


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset a temporary one, on a local master only: executors
    elsewhere would write to disks of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, removed when the scope or the process ends."""
    path = f"{shared_folder(spark)}/weftgraph-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@contextmanager
def scope() -> Iterator[None]:
    """What is staged inside is removed at the end, for services that run for long: read results before."""
    outer = list(_written)
    _written.clear()
    try:
        yield
    finally:
        _remove()
        _written[:] = outer


def stage(df: DataFrame, sort_within: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back: lineage ends here and the loss of an
    executor recomputes nothing. The files are removed when the process ends."""
    spark = df.sparkSession
    path = scratch_folder(spark)
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_rows(df: DataFrame) -> int:
    """Rows of a staged table, from the Parquet footers."""
    return df.select(F.lit(1)).count()


def small_side(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (narrow rows) marked for broadcast if it has at most ``limit`` rows, else as it is (a shuffled join)."""
    return F.broadcast(df) if (staged_rows(df) if rows is None else rows) <= limit else df


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may be gone; the folder belongs to the cluster then
            pass
