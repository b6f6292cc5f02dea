"""Writes: pure functions from old and new rows to the next state, and a store that publishes states atomically.

A table's state is folders of Parquet; a manifest names those of all tables. A transaction writes new folders and then one
new manifest, so that readers see all of it or nothing. A manifest's number can be taken once: a writer who comes second
takes the next, with the first one's changes in it.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows with new values where these are not null, and new rows."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    return o.join(n, on, "full").select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in old.columns])


def deleted(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys), keys, "left_anti")


def missing(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose keys aren't there yet, each once."""
    return new.dropDuplicates().join(old.select(*keys).distinct(), keys, "left_anti")


def with_id(df: DataFrame, name: str, parts: list[str]) -> DataFrame:
    """An id that only depends on the parts, so that concurrent creators make the same."""
    return df.withColumn(name, F.sha2(F.concat_ws("\u0000", *parts), 256))


def status_if_current(df: DataFrame, which: Column, current: list[str], status: str) -> DataFrame:
    return df.withColumn("status", F.when(which & F.col("status").isin(current), status).otherwise(F.col("status")))


def fail_running(df: DataFrame, end_time: Column) -> DataFrame:
    running = F.col("status") == "RUNNING"
    return df.withColumns({"end_time": F.when(running, end_time).otherwise(F.col("end_time")), "status": F.when(running, "FAILED").otherwise(F.col("status"))})


def merged_json(old: Column, new: Column) -> Column:
    """A shallow merge of JSON objects, the new one's keys winning, whatever their values are; what is no object counts as empty.

    Values keep their types; keys come in the order of their code points, which also tells equal results apart from others.
    """
    kind = "map<string,variant>"
    empty = F.create_map().cast(kind)
    opened = lambda c: F.coalesce(F.try_variant_get(F.try_parse_json(c), "$", kind), empty)
    before, after = opened(old), opened(new)
    merged = F.map_concat(F.map_filter(before, lambda k, v: ~F.map_contains_key(after, k)), after)
    keys = F.array_sort(F.map_keys(merged))
    return F.to_json(F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(merged, k))))


def status_updated(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of ``changes`` set where these aren't null; the status is always set. Unknown keys change
    nothing. changes: key, status and further columns, at most one row for each key."""
    new = changes.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__new_{c}") for c in changes.columns if c != key])
    met = rows.join(new, F.col(key) == F.col("__key"), "left")
    return met.select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in changes.columns and c != key else F.col(c) for c in rows.columns])


def inserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old and new rows; ``ValueError`` if a new key is there or comes twice. A null key is like no old one, and may come once."""
    taken = new.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key).union(new.select(key).join(old.select(key), key, "left_semi"))
    if not taken.isEmpty():
        raise ValueError(f"{key} is there already: {taken.first()[0]!r}")
    return old.unionByName(new)


def updated(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows, those of the new keys replaced as a whole; ``LookupError`` if a key isn't there, as a null key never is."""
    unknown = new.select(key).join(old.select(key), key, "left_anti")
    if not unknown.isEmpty():
        raise LookupError(f"no row with {key} = {unknown.first()[0]!r}")
    return old.join(new.select(key), key, "left_anti").unionByName(new).select(*old.columns)


def targeting_fault(span_ids: Column, mode: Column, status: Column) -> Column:
    """Without spans a computation must be SKIPPED; a SINGLE one has one span."""
    return F.when((F.size(span_ids) == 0) & (status != "SKIPPED"), "empty").when((mode == "SINGLE") & (F.size(span_ids) > 1), "not_single")


def content_hash(df: DataFrame, key: str) -> DataFrame:
    """Two order-free sums over each key's rows, with their number."""
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), *df.columns).cast("decimal(38,0)"))
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), h(1).alias("h1"), h(2).alias("h2"))


def persist_outcome(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """new, unchanged or conflict for each key: writing the same again does nothing, other content is refused."""
    n, o = content_hash(new, key), content_hash(old, key).select(F.col(key).alias("__key"), *[F.col(c).alias(f"old_{c}") for c in ("rows", "h1", "h2")])
    same = (F.col("rows") == F.col("old_rows")) & (F.col("h1") == F.col("old_h1")) & (F.col("h2") == F.col("old_h2"))
    return n.join(o, F.col(key) == F.col("__key"), "left").withColumn("outcome", F.when(F.col("__key").isNull(), "new").when(same, "unchanged").otherwise("conflict"))


#: The manifest's entry for streams.
MARKS = "_marks"


class Store:
    """Tables under a folder, published by manifests."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _newest(self) -> tuple[int, dict]:
        """The newest manifest's number and what it says; 0 and nothing without one."""
        path = self._fs_path(f"{self.folder}/_manifests")
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(path) if s.getPath().getName().endswith(".json")) if self._fs.exists(path) else []
        if not names:
            return 0, {}
        rows = self.spark.read.text(f"{self.folder}/_manifests/{names[-1]}", wholetext=True).collect()
        return int(names[-1].split(".")[0]), json.loads(rows[0]["value"])

    def manifest(self) -> dict[str, list[str]]:
        """Table names and their folders."""
        return {name: at for name, at in self._newest()[1].items() if name != MARKS}

    def marks(self) -> dict[str, int]:
        """How far each stream has been written."""
        return self._newest()[1].get(MARKS, {})

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/{at}" for at in self.manifest()[name]])

    def _write(self, name: str, df: DataFrame) -> str:
        at = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{at}")
        return at

    def _publish(self, version: int, states: dict[str, list[str]]) -> bool:
        """Make a manifest the newest; whether its number was still free. Renaming never replaces a file."""
        jvm = self.spark._jvm
        whole = self._fs_path(f"{self.folder}/_manifests/{version:08d}.json")
        part = self._fs_path(f"{self.folder}/_manifests/_{uuid.uuid4().hex}")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(states).encode()))
        out.close()
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(part), self._fs.makeQualified(whole), options)
        except Py4JJavaError as failure:
            if "FileAlreadyExistsException" not in str(failure.java_exception.getClass()):
                raise
            self._fs.delete(part, False)
            return False
        return True

    def commit(self, states: dict[str, DataFrame]) -> dict[str, list[str]]:
        """Write the tables' new states, then publish them together. If another writer has published meanwhile, his changes
        of other tables stay; ``RuntimeError`` if he has changed one of these."""
        base = self.manifest()
        made = {name: [self._write(name, df)] for name, df in states.items()}
        while True:
            version, now = self._newest()
            if changed := [name for name in made if now.get(name) != base.get(name)]:
                raise RuntimeError(f"another writer has changed {', '.join(changed)}")
            if self._publish(version + 1, now | made):
                return now | made

    def append(self, rows: dict[str, DataFrame], marks: dict[str, int] | None = None) -> dict[str, list[str]]:
        """Add rows to several tables in one transaction: a folder more for each, whatever the tables' sizes. What other
        writers publish meanwhile stays. Rows get the table's columns and types; ``ValueError`` if the columns differ. ``marks`` are published
        with them."""
        there, made = self.manifest(), {}
        for name, df in rows.items():
            if name in there:
                fields = self.table(name).schema.fields
                if sorted(f.name for f in fields) != sorted(df.columns):
                    raise ValueError(f"{name} has the columns {', '.join(f.name for f in fields)}")
                df = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields])
            made[name] = self._write(name, df)
        while True:
            version, now = self._newest()
            states = now | {name: [*now.get(name, []), at] for name, at in made.items()} | ({MARKS: now.get(MARKS, {}) | marks} if marks else {})
            if self._publish(version + 1, states):
                return states

    def compact(self, *names: str) -> dict[str, list[str]]:
        """Rewrite tables of many folders as one each."""
        return self.commit({name: self.table(name) for name in names})
