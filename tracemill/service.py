"""Entry points: evaluate traces, import trace files, repeat a run, report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.text import strip
from tracemill.operators import report as reports
from tracemill.operators.adapters import adapted
from tracemill.operators.judged import with_rubric, with_verdicts
from tracemill.operators.metrics import Registry, built_in, compute
from tracemill.operators.validate import trace_violations
from tracemill.plans.planner import plan, targets
from tracemill.sources.files import trace_files
from tracemill.staging import drop_staged, staged


def import_traces(spark: SparkSession, path: str, adapter: str = "phoenix", model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(spans, faults) of trace files; spans of traces that break a rule are left out. ``model``: for the adapters that hold
    a trace's calls against one."""
    raw = staged(trace_files(spark, path), "records")
    unread = raw.where("error is not null").select("trace_id", F.lit("file").alias("rule"), F.col("error").alias("detail"))
    good = raw.where("error is null")
    spans, refused = adapted(adapter, model)(good)
    spans = staged(spans, "spans")  # every rule reads it
    envelopes = good.select("trace_id", "trace.schema_version", "stated_trace_id", F.col("context_span_id").alias("span_id"), "trace.start_us", "trace.end_us")
    broken = trace_violations(spans, envelopes.join(spans.select("trace_id").distinct(), "trace_id", "left_semi"))
    faults = staged(unread.union(broken) if refused is None else unread.union(refused).union(broken), "faults")
    kept = staged(spans.join(faults.select("trace_id").distinct(), "trace_id", "left_anti"), "kept")
    drop_staged(raw, spans)
    return kept, faults


def bind_samples(requests: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Traces and samples with equal stripped text, one to one, and the faults (trace_id, matches).

    requests: trace_id, request; samples: sample_id, input_prompt.
    """
    r = requests.select("trace_id", F.sha2(strip(F.col("request")), 256).alias("h"))
    s = samples.groupBy(F.sha2(strip(F.col("input_prompt")), 256).alias("h")).agg(F.min("sample_id").alias("sample_id"), F.count(F.lit(1)).alias("samples"))
    n = r.groupBy("h").agg(F.count(F.lit(1)).alias("traces"))
    met = r.join(s, "h", "left").join(n, "h", "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
    good = (F.col("samples") == 1) & (F.col("traces") == 1)
    return met.where(good).select("trace_id", "sample_id"), met.where(F.coalesce(~good, F.lit(True))).select("trace_id", "samples", "traces")


#: What metrics read of a trace; columns that rows don't have are null.
RESULT = "struct<kind:string,stage:string,availability:string,reason:string,ids:array<string>,contents:array<string>,ranked:boolean>"
ROW = {"request": "string", "answer": "string", "expected_output": "string", "expected_plan": "array<string>", "executed_steps": "array<string>", "retrieval": f"array<{RESULT}>", "relevant_document_ids": "array<string>", "relevant_snippet_ids": "array<string>", "claims": "array<string>", "gold_claims": "array<string>", "extracted_claims": "array<string>", "rendered": "string", "rendered_spans": "long", "rendered_chars": "long"}


def evaluate(rows: DataFrame, spans: DataFrame, registry: Registry | None = None, names: str | list[str] | None = None, source_run: DataFrame | None = None, judge: Callable | None = None, extractor: Callable | None = None, rubric: dict[str, str] | None = None) -> DataFrame:
    """Computations of the selected metrics. rows: a row for each trace with what the metrics read; spans: trace_id,
    span_type, start_us, span_id; ``source_run`` (trace_id) repeats only a former run's traces. Without names all metrics
    run that the judge and the extractor at hand allow; see ``judged.with_verdicts`` for these. ``rubric``: for metrics of a
    judge, what is asked besides."""
    clients = {name for name, c in (("judge", judge), ("claim_extractor", extractor)) if c is not None}
    chosen = (registry or built_in()).select(names, clients)
    chosen = with_rubric(chosen, rubric or {})
    if source_run is not None:
        rows = rows.join(source_run.select("trace_id").distinct(), "trace_id", "left_semi")
        spans = spans.join(source_run.select("trace_id").distinct(), "trace_id", "left_semi")
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in ROW.items() if c not in rows.columns})
    planned = plan(rows, spans, targets(rows.sparkSession, chosen)).join(rows, "trace_id").withColumn("n_spans", F.size("span_ids"))
    if any(m.request for m in chosen):
        planned = with_verdicts(planned, chosen, judge, extractor)
    return compute(planned, chosen)


def report(runs: DataFrame, run_samples: DataFrame, computations: DataFrame, run_id, wanted: list[str]) -> str:
    """One run's report as JSON text."""
    one = lambda df: df.where(F.col("run_id") == run_id)
    return reports.full_report(one(runs), one(run_samples), one(computations), wanted).first()["report"]
