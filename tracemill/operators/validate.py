"""Rules that traces must keep, as a table of violations (trace_id, rule, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators.trees import cycles


def _said(df: DataFrame, rule: str, detail: str) -> DataFrame:
    return df.select("trace_id", F.lit(rule).alias("rule"), F.col(detail).cast("string").alias("detail"))


def span_violations(spans: DataFrame) -> DataFrame:
    """spans: trace_id, span_id, parent_id, start_us, end_us."""
    repeated = spans.groupBy("trace_id", "span_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    backwards = spans.where("end_us < start_us")
    ids = spans.select(F.col("trace_id").alias("t"), F.col("span_id").alias("s")).distinct()
    orphans = spans.where("parent_id is not null").join(ids, (F.col("trace_id") == F.col("t")) & (F.col("parent_id") == F.col("s")), "left_anti")
    rules = [_said(repeated, "duplicate_span_id", "span_id"), _said(backwards, "negative_duration", "span_id"), _said(orphans, "missing_parent", "parent_id"), _said(cycles(spans), "cycle", "span_id")]
    return reduce(DataFrame.union, rules)


def envelope_violations(traces: DataFrame, spans: DataFrame, version: int = 1) -> DataFrame:
    """traces: trace_id, schema_version, and if they are known start_us, end_us. The version must be the one known, there
    must be a span, and a trace can't end before it starts."""
    empty = traces.join(spans.select("trace_id"), "trace_id", "left_anti").withColumn("nothing", F.lit(None).cast("string"))
    return _said(traces.where(~F.coalesce(F.col("schema_version") == version, F.lit(False))), "schema_version", "schema_version").union(_said(empty, "no_spans", "nothing")).union(_said(traces.where("end_us < start_us"), "negative_trace_duration", "trace_id") if "end_us" in traces.columns else _said(empty.limit(0), "negative_trace_duration", "nothing"))


def missing_violations(spans: DataFrame) -> DataFrame:
    """A span must have an id and both times."""
    lacking = lambda c: spans.where(F.col(c).isNull())
    return reduce(DataFrame.union, [_said(lacking("span_id"), "missing_span_id", "parent_id"), _said(lacking("start_us"), "missing_start", "span_id"), _said(lacking("end_us"), "missing_end", "span_id")])


#: What the plan rules read of a span's plans and executed steps.
PLANS = "array<struct<plan_id:string,supersedes:string,steps:array<struct<id:string,depends_on:array<string>>>>>"
STEPS = "array<struct<id:string,span_ids:array<string>,plan_id:string,planned_step_id:string>>"


def trace_violations(spans: DataFrame, envelopes: DataFrame) -> DataFrame:
    """All rules of a trace, for canonical spans as an adapter gives them.

    spans: trace_id, external_id, parent_span_id, start_time, end_time, and where the adapter has them ``plans`` (``PLANS``) and
    ``executed_steps`` (structs with an id; without ``span_ids`` the id is the span's). envelopes: trace_id, schema_version,
    stated_trace_id of a record (null: none) with its span_id, start_us, end_us of the trace where they are stated.
    """
    one = spans.select("trace_id", F.col("external_id").alias("span_id"), F.col("parent_span_id").alias("parent_id"), F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"))
    # a trace's stated bounds, else those of its spans
    bounds = one.groupBy("trace_id").agg(F.min("start_us").alias("first_us"), F.max("end_us").alias("last_us"))
    heads = envelopes.groupBy("trace_id").agg(F.min(F.coalesce("schema_version", F.lit(1))).alias("low"), F.max(F.coalesce("schema_version", F.lit(1))).alias("high"), F.min("start_us").alias("s"), F.max("end_us").alias("e")).join(bounds, "trace_id", "left")
    heads = heads.select("trace_id", F.when(F.col("low") == 1, F.col("high")).otherwise(F.col("low")).alias("schema_version"), F.coalesce("s", "first_us").alias("start_us"), F.coalesce("e", "last_us").alias("end_us"))
    found = [missing_violations(one), span_violations(one.where("span_id is not null")), envelope_violations(heads, one), trace_id_violations(envelopes)]
    plans = spans.select("trace_id", F.explode(F.col("plans").cast(PLANS)).alias("p")).select("trace_id", "p.*") if "plans" in spans.columns else None
    if plans is not None:
        found.append(plan_violations(plans))
    kind = spans.schema["executed_steps"].dataType.simpleString() if "executed_steps" in spans.columns else ""
    if kind.startswith("array<struct"):
        fields = [f.name for f in spans.schema["executed_steps"].dataType.elementType.fields]
        text = lambda s, c: s[c].cast("string") if c in fields else F.lit(None).cast("string")
        shaped = F.transform("executed_steps", lambda s: F.struct(text(s, "id").alias("id"), (s["span_ids"] if "span_ids" in fields else F.array(s["id"])).alias("span_ids"), text(s, "plan_id").alias("plan_id"), text(s, "planned_step_id").alias("planned_step_id")))
        steps = spans.select("trace_id", F.explode(shaped.cast(STEPS)).alias("s"))
        found.append(step_violations(steps.select("trace_id", F.col("s.id").alias("step_id"), F.explode("s.span_ids").alias("span_id")), one))
        stated = steps.select("trace_id", F.col("s.id").alias("step_id"), "s.plan_id", "s.planned_step_id")
        none = stated.limit(0).select("trace_id", "plan_id", F.lit(None).cast("array<struct<id:string,depends_on:array<string>>>").alias("steps"))
        found.append(step_plan_violations(stated, plans if plans is not None else none))
    return reduce(DataFrame.union, found)


def trace_id_violations(spans: DataFrame) -> DataFrame:
    """spans: trace_id (of the file or table they are in), span_id, stated_trace_id; a null one is no statement."""
    return _said(spans.where("stated_trace_id <> trace_id"), "other_trace", "span_id")


def plan_violations(plans: DataFrame) -> DataFrame:
    """plans: trace_id, plan_id, supersedes, steps array<struct<id, depends_on>>."""
    repeated = plans.groupBy("trace_id", "plan_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ids = plans.select(F.col("trace_id").alias("t"), F.col("plan_id").alias("p")).distinct()
    unknown = plans.where("supersedes is not null").join(ids, (F.col("trace_id") == F.col("t")) & (F.col("supersedes") == F.col("p")), "left_anti")
    step_ids = F.transform("steps", lambda s: s["id"])
    doubled = plans.where(F.size(F.array_distinct(step_ids)) < F.size(step_ids))
    lacking = plans.where(F.exists("steps", lambda s: F.size(F.array_except(s["depends_on"], step_ids)) > 0))
    needs = lambda s: F.array_intersect(F.coalesce(s["depends_on"], F.array()), step_ids)  # noqa: E731  unknown ones are a rule of their own
    free = lambda done: F.transform(F.filter("steps", lambda s: F.size(F.array_except(needs(s), done)) == 0), lambda s: s["id"])
    ordered = F.aggregate("steps", F.filter(step_ids, lambda i: F.lit(False)), lambda done, _: F.array_union(done, free(done)))
    circular = plans.where(F.size(ordered) < F.size(F.array_distinct(step_ids)))
    superseding = cycles(plans.select("trace_id", F.col("plan_id").alias("span_id"), F.col("supersedes").alias("parent_id")))
    return reduce(DataFrame.union, [_said(repeated, "duplicate_plan", "plan_id"), _said(unknown, "missing_superseded_plan", "supersedes"), _said(superseding, "plan_cycle", "span_id"), _said(doubled, "duplicate_step", "plan_id"), _said(lacking, "unknown_dependency", "plan_id"), _said(circular, "dependency_cycle", "plan_id")])


def step_plan_violations(steps: DataFrame, plans: DataFrame) -> DataFrame:
    """steps: trace_id, step_id, plan_id, planned_step_id (one row for each executed step); plans as above.

    A planned step must be one of its plan; without a plan, or where the plan is unknown, there is none.
    """
    known = plans.groupBy(F.col("trace_id").alias("t"), F.col("plan_id").alias("p")).agg(F.flatten(F.collect_list(F.transform("steps", lambda s: s["id"]))).alias("there"))
    met = steps.join(known, (F.col("trace_id") == F.col("t")) & (F.col("plan_id") == F.col("p")), "left")
    unplanned = met.where("plan_id is not null and p is null")
    unknown = met.where("planned_step_id is not null").where(~F.coalesce(F.array_contains("there", F.col("planned_step_id")), F.lit(False)))
    return _said(unplanned, "unknown_plan", "step_id").union(_said(unknown, "unknown_planned_step", "step_id"))


def step_violations(steps: DataFrame, spans: DataFrame) -> DataFrame:
    """steps: trace_id, step_id, span_id (one row for each span named); spans as above."""
    ids = spans.select(F.col("trace_id").alias("t"), F.col("span_id").alias("s")).distinct()
    return _said(steps.join(ids, (F.col("trace_id") == F.col("t")) & (steps["span_id"] == F.col("s")), "left_anti"), "unknown_execution_span", "step_id")


def unavailable_with_items(retrievals: DataFrame) -> DataFrame:
    """Retrieval results that aren't available must have no items."""
    return retrievals.where((F.col("availability") != "available") & (F.size("items") > 0))
