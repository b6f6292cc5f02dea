"""Raw span records to canonical spans, and trace envelopes.

A record: context_span_id, parent_id, name, span_kind, status_code, status_message, start_time, end_time, trace_id and
attributes, a map of dotted keys to text. Adapters are functions DataFrame -> DataFrame, registered by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.text import first_truthy, sanitise

ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def adapter(name: str) -> Callable:
    """Register an adapter; a name can be taken once."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        if name in ADAPTERS:
            raise ValueError(f"adapter {name} is registered")
        ADAPTERS[name] = f
        return f

    return add


def attribute(key: str) -> Column:
    return F.try_element_at(F.col("attributes"), F.lit(key))


def span_kind() -> Column:
    """The attribute, else the record's kind, else unknown (empty text counts as missing); retriever is retrieval."""
    kind = F.lower(first_truthy(attribute("openinference.span.kind"), F.col("span_kind"), F.lit("unknown")))
    kind = F.when(kind == "retriever", "retrieval").otherwise(kind)
    return F.when(F.col("parent_id").isNull() & kind.isin("agent", "chain", "unknown"), "agent_root").otherwise(kind)


def span_status() -> Column:
    return F.when(F.col("status_code") == "OK", "success").when(F.col("status_code") == "ERROR", "error").otherwise("unset")


def metadata() -> Column:
    """All attributes with their full keys, and the status message if there is one."""
    named = F.transform_keys(F.coalesce(F.col("attributes"), F.create_map().cast("map<string,string>")), lambda k, v: F.concat(F.lit("attributes."), k))
    message = F.when(first_truthy(F.col("status_message")).isNotNull(), F.create_map(F.lit("phoenix.status_message"), F.col("status_message"))).otherwise(F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(named, lambda k, v: k != "phoenix.status_message"), message)


def usage() -> Column:
    """Of llm spans only; the currency is known where a cost is."""
    n = lambda k: attribute(f"llm.token_count.{k}").try_cast("long")
    cost = attribute("llm.cost.total").try_cast("double")
    said = F.struct(F.col("context_span_id").alias("call_id"), attribute("llm.provider").alias("provider"), attribute("llm.model_name").alias("model"), n("prompt").alias("input_tokens"), n("completion").alias("output_tokens"), n("total").alias("total_tokens"), n("prompt_details.cache_read").alias("cached_input_tokens"), cost.alias("cost"), F.when(cost.isNotNull(), "USD").alias("currency"))
    return F.when(span_kind() == "llm", said)


@adapter("phoenix")
def canonical(records: DataFrame) -> DataFrame:
    return records.select(F.col("context_span_id").alias("external_id"), "trace_id", F.col("parent_id").alias("parent_span_id"), span_kind().alias("span_type"), span_status().alias("status"), sanitise(first_truthy(F.col("name"), F.col("context_span_id"))).alias("name"), "start_time", "end_time", sanitise(attribute("input.value")).alias("input_data"), sanitise(attribute("output.value")).alias("output_data"), metadata().alias("metadata"), usage().alias("usage"))


def envelopes(spans: DataFrame, start: str = "start_time", end: str = "end_time", source: str = "phoenix") -> DataFrame:
    """A row for each trace: its bounds, source and adapter."""
    return spans.groupBy("trace_id").agg(F.min(start).alias("start_time"), F.max(end).alias("end_time"), F.count(F.lit(1)).alias("spans")).select("trace_id", "start_time", "end_time", "spans", F.lit(source).alias("source"), F.lit(f"{source}:1").alias("adapter"), F.lit(1).alias("schema_version"))


def rebased(calls: DataFrame, start: str = "start_us", agent: str = "agent_start_us", key: str = "trace_id") -> DataFrame:
    """Calls moved so that the first of each agent begins with the agent."""
    first = F.min(start).over(Window.partitionBy(key))
    return calls.withColumn("rebased_us", F.col(agent) + F.col(start) - first)


def flattened(payload: Column) -> Column:
    """A JSON object's nested objects as a map of dotted keys to JSON text; lists stay whole.

    Levels are opened by folding over a bounded number of passes; eight levels are opened.
    """
    opened = F.from_json(payload, "map<string,string>")
    for _ in range(8):
        opened = F.map_from_entries(F.flatten(F.transform(F.map_entries(opened), lambda e: F.when(F.coalesce(F.startswith(F.trim(e["value"]), F.lit("{")), F.lit(False)) & (F.size(F.from_json(e["value"], "map<string,string>")) > 0), F.transform(F.map_entries(F.from_json(e["value"], "map<string,string>")), lambda i: F.struct(F.concat_ws(".", e["key"], i["key"]).alias("key"), i["value"].alias("value")))).otherwise(F.array(F.struct(e["key"].alias("key"), e["value"].alias("value")))))))
    return opened
