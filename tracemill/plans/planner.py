"""Which metric applies to which spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.metrics import Metric


def targets(spark: SparkSession, metrics: list[Metric]) -> DataFrame:
    """(metric, target_span_type, mode): as many rows as there are registered metrics, so small enough to broadcast."""
    return spark.createDataFrame([(m.name, m.span_type, m.mode) for m in metrics], "metric string, target_span_type string, mode string")


def plan(traces: DataFrame, spans: DataFrame, wanted: DataFrame) -> DataFrame:
    """(trace_id, metric, target_span_type, mode, span_ids, skip_reason): a row for each span of a SINGLE metric, for
    each trace's group of a GROUP metric, and for each missing target.

    The group's order is (start, id). Span ids stay of the type they have. Spans of a SINGLE metric are joined one by one;
    only a GROUP metric's spans come together, reduced to (trace, type) groups before the metrics meet them.
    """
    wanted = F.broadcast(wanted)
    every = traces.select("trace_id").distinct().crossJoin(wanted)
    group = F.col("mode") == "GROUP"
    kinds = spans.select("trace_id", F.col("span_type").alias("target_span_type"), "start_us", "span_id")
    asked = wanted.where(group).select("target_span_type").distinct()
    ids = F.transform(F.array_sort(F.collect_list(F.struct("start_us", "span_id"))), lambda x: x["span_id"])
    groups = kinds.join(F.broadcast(asked), "target_span_type", "left_semi").groupBy("trace_id", "target_span_type").agg(ids.alias("span_ids"))
    key, head = ["trace_id", "target_span_type"], ["trace_id", "metric", "target_span_type", "mode"]
    one = every.where(~group).join(kinds, key, "left").select(*head, F.when(F.col("span_id").isNotNull(), F.array("span_id")).alias("span_ids"))
    out = one.union(every.where(group).join(groups, key, "left").select(*head, "span_ids"))
    reason = F.when(F.col("span_ids").isNull(), F.concat(F.lit('No spans found for target span type "'), F.col("target_span_type"), F.lit('".')))
    return out.withColumn("skip_reason", reason)
