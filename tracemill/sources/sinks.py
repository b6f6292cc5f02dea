"""Sinks: archives of raw traces, embedding shards that resume, vector and term tables, step logs, analysis tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.stats import rounded
from tracemill.operators.retrieval import shard_numbers, term_table
from tracemill.operators.store import Store, upserted
from tracemill.staging import drop_staged, staged

SHARD = 2048
#: Tasks that shards are dealt out to at most.
MOST_TASKS = 2000


def there(spark: SparkSession, folder: str) -> bool:
    """Whether a folder holds what a finished job wrote."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(path) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(path))


def archive_traces(records: DataFrame, folder: str, key: str = "run_id") -> None:
    """Raw records as JSON lines, a folder for each run; what is there stays."""
    records.write.mode("append").partitionBy(key).json(folder)


def archived_traces(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(folder)


def _spec(spark: SparkSession, folder: str, spec: dict) -> None:
    """Record what vectors are made of, or hold it against what is recorded; ``ValueError`` if that is something else."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_spec.json")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    text = json.dumps(spec, ensure_ascii=False, sort_keys=True)
    if fs.exists(path):
        had = spark._jvm.org.apache.commons.io.IOUtils.toString(opened := fs.open(path), "UTF-8")
        opened.close()
        if had != text:
            raise ValueError(f"{folder} was embedded with another spec: {had}")
        return
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_spec.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, path):
        raise RuntimeError(f"another run has begun in {folder}")


def embed_shards(documents: DataFrame, folder: str, embed: Callable[[DataFrame], DataFrame], size: int = SHARD, spec: dict | None = None) -> int:
    """Embed the documents (document_id, text) of every shard that isn't on disk yet; the number of shards embedded.

    Shards are rows in order of document_id, ``size`` each. Shards on disk must hold the documents they would hold now,
    and be made by the same ``spec`` (model, width and the like, recorded by the first run), else ``ValueError``.

    A shard is the work of one task, of MOST_TASKS at most at a time, and its one file is renamed into place when that task
    commits (the committer's version 2), not when the job ends: a run that breaks leaves whole shards, and the next one
    embeds the others alone. ``embed`` must keep rows where they are (no shuffle), as functions of Arrow batches do.
    """
    spark = documents.sparkSession
    _spec(spark, folder, {"size": size, **(spec or {})})
    numbered = staged(shard_numbers(documents.select("document_id", "text"), "document_id", size), "numbered")
    digest = lambda df: df.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("document_id").cast("decimal(38,0)")).alias("h"))
    wanted = digest(numbered)
    if there(spark, folder):
        had = digest(spark.read.parquet(folder).select(F.col("shard").cast("long").alias("shard"), "document_id"))
        odd = had.select("shard", F.col("n").alias("m"), F.col("h").alias("g")).join(wanted, "shard", "left").where("n is null or n <> m or h <> g")
        if not odd.isEmpty():
            raise ValueError(f"shard {odd.first()['shard']} holds other documents")
        wanted = wanted.join(had.select("shard"), "shard", "left_anti")
    todo = staged(shard_numbers(wanted.select(F.col("shard").alias("lacking")), "lacking").select(F.col("lacking").alias("shard"), F.col("row").alias("task")), "todo")
    made = todo.count()
    if made:
        tasks = min(made, MOST_TASKS)
        rows = numbered.join(F.broadcast(todo) if made <= MOST_TASKS else todo, "shard").select("shard", "document_id", "text", F.pmod("task", F.lit(tasks)).cast("int").alias("task"))
        rows = rows.repartitionById(tasks, "task").sortWithinPartitions("shard", "document_id").select("shard", "document_id", "text")
        out = embed(rows).select("shard", "document_id", "embedding")
        out.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("shard").parquet(folder)
    drop_staged(numbered, todo)
    return made


def load_vectors(store: Store, vectors: DataFrame, documents: DataFrame) -> int:
    """Upsert document vectors (document_id, embedding) and the documents' terms in one transaction; the number of vectors.
    ``ValueError`` if a document has no vector or the other way round."""
    unmatched = vectors.select("document_id").join(documents.select("document_id"), "document_id", "full").groupBy("document_id").count().where("count > 1").count()
    missing = documents.select("document_id").join(vectors, "document_id", "left_anti").count() + vectors.select("document_id").join(documents, "document_id", "left_anti").count()
    if missing or unmatched:
        raise ValueError(f"{missing} documents or vectors are without the other, {unmatched} come twice")
    terms = term_table(documents.select("document_id", "text"), "document_id", "text")
    known = store.manifest()
    if "doc_vectors" in known and store.table("doc_vectors").join(vectors.select("document_id"), "document_id", "left_semi").isEmpty():
        store.append({"doc_vectors": vectors, "doc_terms": terms})  # all are new: nothing that is there is written again
        return store.table("doc_vectors").count()
    if "doc_vectors" in known:
        old = store.table("doc_terms").join(documents.select("document_id"), "document_id", "left_anti")
        vectors, terms = upserted(store.table("doc_vectors"), vectors, ["document_id"]), old.unionByName(terms)
    store.commit({"doc_vectors": vectors, "doc_terms": terms})
    return store.table("doc_vectors").count()


RECORD = "step string, status string, run_ids array<string>, details string, recorded_at timestamp"


def append_record(spark: SparkSession, folder: str, step: str, status: str, run_ids: tuple[str, ...] = (), details: dict | None = None) -> None:
    """One line of a log that is only ever added to."""
    row = (step, status, list(run_ids), json.dumps(details or {}, ensure_ascii=False), datetime.now(timezone.utc))
    spark.createDataFrame([row], RECORD).coalesce(1).write.mode("append").json(folder)


def append_records(df: DataFrame, folder: str) -> None:
    """Many lines at once: the rows' step, status, run_ids and details, recorded now; null run_ids are none, null details
    an empty object."""
    rows = df.select("step", "status", F.coalesce("run_ids", F.array().cast("array<string>")).alias("run_ids"), F.coalesce("details", F.lit("{}")).alias("details"), F.current_timestamp().alias("recorded_at"))
    rows.write.mode("append").json(folder)


def records(spark: SparkSession, folder: str) -> DataFrame:
    """A log's records in the order they were made, those of one time as they lie in the log's files; none if there is no log.

    All lines of one append have the same time: by time alone they would all be put in order by one task.
    """
    if not there(spark, folder):
        return spark.createDataFrame([], RECORD)
    rows = spark.read.schema(RECORD).json(folder)
    lies = rows.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__line"))
    return lies.orderBy("recorded_at", "__file", "__block", "__line").select(*rows.columns)


def write_rows(df: DataFrame, folder: str) -> None:
    """Analysis rows as JSON lines."""
    df.write.mode("overwrite").json(folder)


def markdown(df: DataFrame, texts: list[str], numbers: list[str]) -> list[str]:
    """Analysis rows as the lines of a table, numbers rounded and null ones as a dash; a report's rows fit the driver."""
    lines = ["| " + " | ".join([*texts, *numbers]) + " |", "|" + "---|" * len(texts) + "--:|" * len(numbers)]
    shown = [F.col(t).cast("string").alias(t) for t in texts] + [F.coalesce(rounded(F.col(n)).cast("string"), F.lit("–")).alias(n) for n in numbers]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[c for c in (*texts, *numbers)]), F.lit(" |"))
    return lines + [r["line"] for r in df.select(*shown).select(row.alias("line")).collect()]
