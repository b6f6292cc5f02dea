"""Spans as a stream: normalised, each id once, windowed figures with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracemill.operators.normalize import ADAPTERS
from tracemill.operators.normalize import canonical  # noqa: F401  registers the default adapter

RECORDS = "context_span_id string, trace_id string, parent_id string, name string, span_kind string, status_code string, status_message string, start_time timestamp, end_time timestamp, attributes map<string,string>"


def span_stream(spark: SparkSession, folder: str, adapter: str = "phoenix", late: str = "1 hour", per_trigger: int = 1000) -> DataFrame:
    """Canonical spans from JSON files as they come; a repeated id within the watermark is dropped."""
    raw = spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", per_trigger).json(folder)
    return ADAPTERS[adapter](raw).withWatermark("start_time", late).dropDuplicatesWithinWatermark(["trace_id", "external_id"])


def error_rates(spans: DataFrame, window: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Spans and errors by window and type; windows close when the watermark has passed them."""
    w = F.window("start_time", window, slide) if slide else F.window("start_time", window)
    return spans.groupBy(w, "span_type").agg(F.count(F.lit(1)).alias("spans"), F.count_if(F.col("status") == "error").alias("errors")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "span_type", "spans", "errors")


def sessions(spans: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """Bursts of a trace's spans, parted by gaps."""
    return spans.groupBy(F.session_window("start_time", gap), "trace_id").agg(F.count(F.lit(1)).alias("spans")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "trace_id", "spans")


def append(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write what is there now as Parquet, exactly once by the checkpoint's log."""
    return df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(folder)
