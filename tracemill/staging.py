"""Intermediate tables in the folder that all executors share: lineage is cut there and survives lost executors."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset and all is one machine, a folder in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    return found.rstrip("/")


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """While jobs run in here, an Arrow batch holds at most so many rows; afterwards the session is as it was."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracemill/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    _staged.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one, deleted when the process ends."""
    path = f"{shared_dir(spark)}/tracemill/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{name}"
    _staged.append((spark, path))
    return path


def drop_staged(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; others are deleted when the process ends."""
    for df in tables:
        path = getattr(df, "_staged_path", None)
        for entry in [x for x in _staged if x[1] == path]:
            _delete(*entry)
            _staged.remove(entry)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _drop_all() -> None:
    for entry in _staged:
        try:
            _delete(*entry)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            continue
