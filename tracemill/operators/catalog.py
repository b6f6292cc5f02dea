"""Reads of a store of tables: by id, pages, existence, latest records, matches, integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import strip
from tracemill.operators.retrieval import shard_numbers


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    """The rows of one id; the filter reaches the scan."""
    return df.where(F.col(key) == F.lit(value))


def by_id_or_raise(df: DataFrame, key: str, value) -> DataFrame:
    found = by_id(df, key, value)
    if found.limit(1).isEmpty():
        raise LookupError(f"no row with {key} = {value!r}")
    return found


def page(df: DataFrame, newest_first: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page, newest first; the last key makes the order total, so Spark keeps only limit + offset rows of each task."""
    return df.orderBy(*[F.desc(c) for c in newest_first]).offset(offset).limit(limit)


def exists(asked: DataFrame, there: DataFrame, key: str) -> DataFrame:
    known = there.select(F.col(key).alias("__key")).distinct().withColumn("__there", F.lit(True))
    return asked.join(known, F.col(key) == F.col("__key"), "left").withColumn("found", F.coalesce("__there", F.lit(False))).drop("__key", "__there")


def by_ids(df: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows in the order of the ids given, with their positions; unknown ids give none."""
    asked = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(i) for i in ids])).alias("pos", "__id"))
    return df.join(F.broadcast(asked), F.col(key) == F.col("__id")).drop("__id").orderBy("pos")


def latest(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Each key's values at the greatest order; map-side combined, no sort of whole groups."""
    top = df.groupBy(*keys).agg(F.max(F.struct(*order, *values)).alias("__top"))
    return top.select(*keys, *[F.col(f"__top.{c}") for c in (*order, *values)])


def digest(content: Column) -> tuple[Column, Column]:
    raw = F.encode(content, "utf-8")
    return F.sha2(raw, 256).alias("sha256"), F.octet_length(raw).cast("long").alias("bytes")


def usage_spans(spans: DataFrame, traces: DataFrame) -> DataFrame:
    """Spans of the traces that can hold token counts; a trace asked for twice counts once."""
    return spans.where(F.col("input_tokens").isNotNull() | (F.col("span_type") == "llm")).join(traces, "trace_id", "left_semi")


def prompt_matches(traces: DataFrame, samples: DataFrame, key: str, text: str) -> DataFrame:
    """How many samples have each trace's request, white space at the ends aside; only 1 binds.

    Texts are compared by two hashes and their length, so that long texts aren't shuffled.
    """
    def said(df: DataFrame) -> DataFrame:
        s = strip(F.col(text))
        return df.select(key, F.sha2(s, 256).alias("h"), F.length(s).alias("n"))

    count = said(samples).groupBy("h", "n").agg(F.count(F.lit(1)).alias("matches"))
    return said(traces).join(count, ["h", "n"], "left").select(key, F.coalesce("matches", F.lit(0)).alias("matches"))


def snapshots(rows: DataFrame, run: str, key: str, created: str) -> DataFrame:
    """(run, keys): what was planned for each run, in order of (created, key)."""
    listed = F.array_sort(F.collect_list(F.struct(created, key)))
    return rows.groupBy(run).agg(F.transform(listed, lambda x: x[key]).alias("keys"))


def in_listed_order(runs: DataFrame, configuration: str, order: list[str], then: list[str]) -> DataFrame:
    """Runs of the listed configurations with their ``position`` in this order, then by further columns."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(configuration))
    rows = runs.where(F.col(configuration).isin(order)).withColumn("__at", rank)
    numbered = shard_numbers(rows.withColumn("__key", F.struct("__at", *then)), "__key")
    return numbered.withColumn("position", F.col("row") + 1).drop("__at", "__key", "row", "shard")


def expand_ids(asked: DataFrame, key: str, renamed: DataFrame, raw: str, new: str, unknown: int = -1) -> DataFrame:
    """Each raw id's new ids; an unknown one is kept with ``unknown``."""
    return asked.join(renamed, F.col(key) == F.col(raw), "left").select(key, F.coalesce(new, F.lit(unknown)).alias(new))


def difference(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows that are missing or extra, repeats counted."""
    return expected.exceptAll(stored).select(F.lit("missing").alias("side"), "*").union(stored.exceptAll(expected).select(F.lit("extra").alias("side"), "*"))


def integrity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of faults, a row for each rule."""
    repeated = docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    rules = {"duplicate_text": repeated, "empty_text": docs.where(F.regexp_like("text", F.lit(r"^\s*$"))), "unlabelled": docs.join(labels, "doc_id", "left_anti"), "unknown_label": labels.join(docs, "doc_id", "left_anti")}
    return reduce(DataFrame.union, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n") for rule, df in rules.items()])
