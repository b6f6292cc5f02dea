"""File sources: data sets, traces, logs, knowledge bases, pinned files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = "struct<operation:string,instruction:string,parameters:map<string,string>>"
SAMPLE = f"struct<input_prompt:string,ground_truth_output:string,snippet_ids:array<string>,document_ids:array<string>,plan:array<{STEP}>,claims:array<struct<id:string,text:string>>>"
RECORD = "struct<`context.span_id`:string,`context.trace_id`:string,parent_id:string,name:string,span_kind:string,status_code:string,status_message:string,start_time:string,end_time:string>"


def dataset_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Samples of data set files {"samples": [...]}, with their file and place; null and empty lists stay apart. With
    ``lines`` each line is a data set, not each file."""
    read = spark.read.schema(f"samples array<{SAMPLE}>").json(path, multiLine=not lines)
    return read.select(F.col("_metadata.file_path").alias("file"), F.posexplode("samples").alias("pos", "s")).select("file", "pos", "s.*")


def iso_time(text: Column) -> Column:
    """An ISO time with its zone, or Z; null if it can't be read."""
    return F.try_to_timestamp(F.trim(text))


def trace_files(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Raw span records of trace files {"trace_id": ..., "spans": [...]}: (trace_id, context_span_id, ..., attributes).

    Every key that begins with ``attributes.`` goes into the map, as JSON text unless it is a string. A file that can't
    be read, has a blank id or no spans gives one row with an error. ``trace`` is what the file says of the trace as a
    whole, ``stated_trace_id`` the trace that the record itself names. With ``lines`` each line is a trace, not each file.
    """
    read = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("file"), "value")
    top = read.select("file", F.from_json("value", "trace_id string, spans array<string>, schema_version int, start_time string, end_time string").alias("t"))
    stated = {"schema_version": F.col("t.schema_version"), "start_us": F.unix_micros(iso_time(F.col("t.start_time"))), "end_us": F.unix_micros(iso_time(F.col("t.end_time")))}
    top = top.withColumns(stated).withColumn("trace", F.struct(*stated))
    tid = F.trim("t.trace_id")
    error = F.when(F.col("t.spans").isNull(), "not a trace file").when(F.coalesce(tid, F.lit("")) == "", "no trace id").when(F.size("t.spans") == 0, "no spans")
    rows = top.select("file", tid.alias("trace_id"), error.alias("error"), "trace", F.explode_outer("t.spans").alias("raw"))
    keys = F.from_json("raw", "map<string,string>")
    get = lambda k: F.try_element_at(keys, F.lit(k))
    attributes = F.transform_keys(F.map_filter(keys, lambda k, v: k.startswith("attributes.")), lambda k, v: F.substring(k, len("attributes.") + 1, 1 << 20))
    time = lambda k: iso_time(get(k))
    return rows.select("file", "trace_id", "error", "trace", get("context.trace_id").alias("stated_trace_id"), get("context.span_id").alias("context_span_id"), get("parent_id").alias("parent_id"), get("name").alias("name"), get("span_kind").alias("span_kind"), get("status_code").alias("status_code"), get("status_message").alias("status_message"), time("start_time").alias("start_time"), time("end_time").alias("end_time"), attributes.alias("attributes"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; blank lines are skipped by the reader."""
    return spark.read.schema(schema).json(path)


def knowledge_base(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only the named columns are read."""
    return spark.read.parquet(path).select(*columns)


def verified_files(spark: SparkSession, path: str, pinned: DataFrame) -> DataFrame:
    """Whether files have their pinned size and SHA-256; pinned: name, size, sha256."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.length("content").cast("long").alias("found_size"), F.sha2("content", 256).alias("found"))
    return pinned.join(files, "name", "left").select("name", F.coalesce((F.col("size") == F.col("found_size")) & (F.col("sha256") == F.col("found")), F.lit(False)).alias("ok"))


def trace_of_request(spans: DataFrame, request_key: str, requests: DataFrame, excluded: list[str]) -> DataFrame:
    """The first trace whose root carries each request's id in an attribute; requests: request_id, from_time, to_time."""
    roots = spans.where(F.col("parent_id").isNull() & ~F.lower(F.trim("name")).isin([e.strip().lower() for e in excluded]))
    roots = roots.select("trace_id", "start_time", F.try_element_at("attributes", F.lit(request_key)).alias("request_id"))
    met = roots.join(requests, "request_id").where((F.col("start_time") >= F.col("from_time")) & (F.col("start_time") < F.col("to_time")))
    return met.groupBy("request_id").agg(F.min(F.struct("start_time", "trace_id"))["trace_id"].alias("trace_id"))
