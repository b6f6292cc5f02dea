"""What the training-data operators share: the shared folder, staged tables, Arrow helpers, stable hashes."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Rows that Python holds as objects at once: texts can be long.
BATCH_ROWS = 1000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_staged: list[tuple[SparkSession, str, str | None]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; where that is unset and all is one machine, the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    return found.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """While jobs run in here, an Arrow batch holds at most so many rows; afterwards the session is as it was."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of at most so many rows."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def staged(df: DataFrame, name: str, codec: str = "zstd", rows: int = BATCH_ROWS, buckets: tuple[int, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    ``buckets``: number and column; the table is then joined on that column without being shuffled.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracemill/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{name}"
    writer, table = df.write.option("compression", codec), None
    with small_batches(spark, rows):
        if buckets is None:
            writer.parquet(path)
            out = spark.read.schema(df.schema).parquet(path)
        else:
            table = f"tracemill_{uuid.uuid4().hex}"
            writer.format("parquet").bucketBy(*buckets).option("path", path).saveAsTable(table)
            out = spark.table(table)
    _staged.append((spark, path, table))
    out._staged_path = path
    return out


def _delete(spark: SparkSession, path: str, table: str | None) -> None:
    jvm = spark._jvm
    if table:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_staged(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_staged_path", None)
        for entry in [x for x in _staged if x[1] == path]:
            _delete(*entry)
            _staged.remove(entry)


@atexit.register
def _drop_all() -> None:
    for entry in _staged:
        try:
            _delete(*entry)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            continue


def col(name: str) -> Column:
    """The column of exactly this name, dots and back-quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def plain(df: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    """The columns and further ones under the names c0, c1, ...: functions of Arrow batches take columns by name, which
    can't have dots or come twice."""
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate([*map(col, columns), *more])])


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column is called so in either case."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def free_prefix(taken: list[str], *names: str) -> str:
    """Underscores enough that none of the names after them is a column's."""
    used, prefix = {t.lower() for t in taken}, ""
    while any((prefix + n).lower() in used for n in names):
        prefix += "_"
    return prefix


def with_fields(df: DataFrame, columns: list[str], *more: tuple[str, DataType]) -> StructType:
    """The schema of some columns of ``df`` and further ones."""
    return StructType([df.schema[c] for c in columns] + [StructField(n, t) for n, t in more])


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(key).cast("string")) % n


def hash_share(key: Column, seed: int) -> Column:
    """A stable number in [0, 1) from a key, for bounded samples."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) / float(1 << 30)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def place_mask(place: Column) -> Column:
    """An aggregate: which of up to 31 places a group's rows are dealt out to, as bits."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1), place))


def masked_places(mask: Column, places: int) -> Column:
    """The places of a mask, a row for each: what is told about a group goes just where it has rows."""
    every = F.sequence(F.lit(0), F.lit(places - 1))
    return F.explode(F.filter(every, lambda i: mask.bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0))
