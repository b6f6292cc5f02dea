"""Data sets, imported traces, evaluations and reports in one store.

Tables: samples (dataset, sample_id, pos and the sample's fields), truths (dataset, sample_id, key, value), spans (run_id and
canonical spans), runs (run_id, dataset, status, source_run, start_us), run_samples (run_id, sample_id, trace_id, status,
start_us, end_us), computations (run_id, sample_id, trace_id, metric, target_span_type, span_ids, status, score,
error_message, reasoning).
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill import service
from tracemill.operators import ablations, report, trees
from tracemill.operators.catalog import page
from tracemill.operators.metrics import built_in
from tracemill.operators.store import Store, status_if_current, status_updated
from tracemill.sources.files import dataset_json
from tracemill.staging import drop_staged, staged

SPAN = ["trace_id", "external_id", "parent_span_id", "span_type", "status", "name", "start_time", "end_time", "input_data", "output_data"]


def has(store: Store, table: str, column: str, value: str) -> bool:
    return table in store.manifest() and not store.table(table).where(F.col(column) == value).isEmpty()


def import_dataset(store: Store, path: str, name: str) -> int:
    """A data set file's samples and the ground truths they give; the number of samples. A name can be taken once."""
    if has(store, "samples", "dataset", name):
        raise ValueError(f"data set {name} is there already")
    samples = dataset_json(store.spark, path).select(F.lit(name).alias("dataset"), F.sha2(F.concat_ws("\u0000", F.lit(name), "pos"), 256).alias("sample_id"), "*").drop("file")
    truths = report.ground_truths(samples).select(F.lit(name).alias("dataset"), "*")
    store.append({"samples": samples, "truths": truths})
    return store.table("samples").where(F.col("dataset") == name).count()


def import_run(store: Store, path: str, dataset: str, run_id: str, adapter: str = "phoenix", model: str | None = None) -> DataFrame:
    """Trace files as the run ``run_id`` of a data set, each trace bound to the sample with its request; the faults
    (trace_id, rule, detail) of those that are refused or can't be bound. Spans, samples and the run appear in one
    transaction or not at all. ``model``: for the adapters that need one."""
    if has(store, "runs", "run_id", run_id):
        raise ValueError(f"run {run_id} is there already")
    spans, faults = kept, _ = service.import_traces(store.spark, path, adapter, model)
    root = F.col("parent_span_id").isNull()
    if "request" not in spans.columns:
        spans = spans.withColumns({"request": F.when(root, F.col("input_data")), "answer": F.when(root, F.col("output_data")), "retrieval": F.lit(None)})
    results = spans.schema["retrieval"].dataType.simpleString()
    shaped = F.lit(None).cast(f"array<{service.RESULT}>") if "items" not in results else F.transform("retrieval", lambda r: F.struct(r["kind"], r["stage"], r["availability"], r["reason"], F.transform(r["items"], lambda i: i["id"]).alias("ids"), F.transform(r["items"], lambda i: i["content"]).alias("contents"), F.lit(False).alias("ranked")))
    spans = spans.select(F.lit(run_id).alias("run_id"), *SPAN, "request", "answer", shaped.cast(f"array<{service.RESULT}>").alias("retrieval"))
    asked = spans.where("span_type = 'agent_root' and request is not null").groupBy("trace_id").agg(F.min("request").alias("request"))
    samples = store.table("samples").where(F.col("dataset") == dataset).select("sample_id", "input_prompt")
    bound, unbound = service.bind_samples(asked, samples)
    bound = staged(bound, "bound")
    faults = staged(faults.union(unbound.select("trace_id", F.lit("binding").alias("rule"), F.concat_ws(" ", F.col("samples").cast("string"), F.lit("samples")).alias("detail"))), "faults")
    times = spans.groupBy("trace_id").agg(F.unix_micros(F.min("start_time")).alias("start_us"), F.unix_micros(F.max("end_time")).alias("end_us"))
    run_samples = bound.join(times, "trace_id").select(F.lit(run_id).alias("run_id"), "sample_id", "trace_id", F.lit("COMPLETED").alias("status"), "start_us", "end_us")
    missing = samples.select("sample_id").join(bound, "sample_id", "left_anti").select(F.lit(run_id).alias("run_id"), "sample_id", F.lit(None).cast("string").alias("trace_id"), F.lit("FAILED").alias("status"), F.lit(None).cast("long").alias("start_us"), F.lit(None).cast("long").alias("end_us"))
    run_samples = staged(run_samples.union(missing), "run_samples")
    store.append({"spans": spans.join(bound.select("trace_id"), "trace_id", "left_semi").select(*spans.columns), "run_samples": run_samples, "runs": run_row(store, run_id, dataset, None, run_samples)})
    drop_staged(run_samples, bound, kept)
    return faults


def run_row(store: Store, run_id: str, dataset: str, source: str | None, run_samples: DataFrame) -> DataFrame:
    """A run's row with the status that its samples' outcomes give."""
    one = store.spark.createDataFrame([(run_id, dataset, source, int(time.time() * 1e6))], "run_id string, dataset string, source_run string, start_us long")
    return one.join(report.run_status(one, run_samples), "run_id").select("run_id", "dataset", "status", "source_run", "start_us")


def rows_of(store: Store, run_id: str, dataset: str) -> tuple[DataFrame, DataFrame]:
    """(rows, spans) of a run as ``service.evaluate`` reads them, with the samples' labels."""
    spans = store.table("spans").where(F.col("run_id") == run_id)
    head = spans.where("span_type = 'agent_root'").groupBy("trace_id").agg(*[F.min_by(c, F.struct("start_time", "external_id")).alias(c) for c in ("request", "answer")], F.flatten(F.collect_list("retrieval")).alias("retrieval"))
    steps = spans.where("span_type = 'tool'").groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_time", "external_id", "name"))), lambda s: s["name"]).alias("executed_steps"))
    labels = store.table("samples").where(F.col("dataset") == dataset).select("sample_id", F.col("ground_truth_output").alias("expected_output"), F.col("document_ids").alias("relevant_document_ids"), F.col("snippet_ids").alias("relevant_snippet_ids"), F.transform("plan", lambda s: s["operation"]).alias("expected_plan"), F.transform("claims", lambda c: c["text"]).alias("claims"))
    bound = store.table("run_samples").where((F.col("run_id") == run_id) & F.col("trace_id").isNotNull()).select("trace_id", "sample_id")
    rows = bound.join(head, "trace_id").join(steps, "trace_id", "left").join(labels, "sample_id", "left")
    return rows, spans.select("trace_id", "span_type", F.unix_micros("start_time").alias("start_us"), F.col("external_id").alias("span_id"))


def with_rendered(store: Store, run_id: str, rows: DataFrame) -> DataFrame:
    """Rows with each trace's first agent root and all below it as text."""
    spans = store.table("spans").where(F.col("run_id") == run_id).withColumnsRenamed({"external_id": "span_id", "parent_span_id": "parent_id"})
    tree = spans.select("trace_id", "span_id", "parent_id", F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"), "span_type")
    text = ablations.rendered(trees.walked(store.spark, tree, numbers=True), spans)
    first = text.groupBy("trace_id").agg(F.min_by(F.struct("rendered", "rendered_spans", "rendered_chars"), "span_id").alias("t"))
    return rows.join(first.select("trace_id", "t.*"), "trace_id", "left")


def evaluate_run(store: Store, run_id: str, names: str | list[str] | None = None, judge: Callable | None = None, extractor: Callable | None = None, source_run: str | None = None, rubric: dict[str, str] | None = None) -> str:
    """Score a run's traces and store the computations; the run's status. A metric that the run has been scored by before
    gets its new computations instead of the old ones. With ``source_run`` the traces of that run are scored again as the
    run ``run_id``, which appears with all its rows at once."""
    source = source_run or run_id
    runs = store.table("runs").where(F.col("run_id") == source).collect()
    if not runs:
        raise LookupError(f"no run {source}")
    if source_run is not None and has(store, "runs", "run_id", run_id):
        raise ValueError(f"run {run_id} is there already")
    dataset = runs[0]["dataset"]
    rows, spans = rows_of(store, source, dataset)
    if any(m.renders for m in built_in().select(names)):
        rows = with_rendered(store, source, rows)
    found = service.evaluate(rows.drop("sample_id"), spans, names=names, judge=judge, extractor=extractor, rubric=rubric)
    bound = store.table("run_samples").where(F.col("run_id") == source)
    made = found.join(bound.select("trace_id", "sample_id"), "trace_id").select(F.lit(run_id).alias("run_id"), "sample_id", "trace_id", "metric", "target_span_type", "span_ids", "status", "score", "error_message", F.lit(None).cast("string").alias("reasoning"))
    if source_run is not None:
        again = bound.withColumn("run_id", F.lit(run_id))
        row = staged(run_row(store, run_id, dataset, source_run, again), "run")
        store.append({"computations": made, "run_samples": again, "runs": row})
        return row.first()["status"]
    made = staged(made, "computations")
    if has(store, "computations", "run_id", run_id):
        again = (F.col("run_id") == run_id) & F.col("metric").isin([r[0] for r in made.select("metric").distinct().collect()])
        store.commit({"computations": store.table("computations").where(~again).unionByName(made)})
    else:
        store.append({"computations": made})
    drop_staged(made)
    return runs[0]["status"]


def report_run(store: Store, run_id: str, wanted: list[str] | None = None) -> str:
    """A run's report as JSON text."""
    return service.report(store.table("runs"), store.table("run_samples"), store.table("computations"), run_id, wanted or [])


def list_runs(store: Store, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of runs, newest first."""
    runs = store.table("runs")
    return page(runs if status is None else runs.where(F.col("status") == status), ["start_us", "run_id"], limit, offset)


def run_progress(store: Store, run_id: str) -> DataFrame:
    """(run_id, succeeded, failed, pending, unprocessed) of a run against its data set's samples."""
    runs = store.table("runs").where(F.col("run_id") == run_id)
    sizes = store.table("samples").groupBy("dataset").agg(F.count(F.lit(1)).alias("expected"))
    return report.status_snapshot(runs.join(sizes, "dataset"), store.table("run_samples"))


def set_status(store: Store, run_id: str, status: str, only_from: list[str] | None = None) -> str:
    """Set a run's status, where ``only_from`` is given only if it is one of these; the status it has then."""
    runs, mine = store.table("runs"), F.col("run_id") == run_id
    if only_from is None:
        changed = status_updated(runs, store.spark.createDataFrame([(run_id, status)], "run_id string, status string"), "run_id")
    else:
        changed = status_if_current(runs, mine, only_from, status)
    store.commit({"runs": changed})
    found = store.table("runs").where(mine).first()
    if found is None:
        raise LookupError(f"no run {run_id}")
    return found["status"]
