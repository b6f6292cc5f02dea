"""Reports over runs: score statistics, coverage, failures, latency, token usage; and the smaller steps before them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.stats import latency_stats, rounded, score_stats, share
from tracemill.functions.text import first_truthy, non_empty

SCORED = "status = 'COMPLETED' and score is not null"


def metric_scores(computations: DataFrame, keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    return score_stats(computations.where(SCORED), list(keys), "score")


def latency(run_samples: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Seconds of completed samples that have both times."""
    seconds = (F.col("end_us") - F.col("start_us")) / 1e6
    done = run_samples.where("status = 'COMPLETED' and start_us is not null and end_us is not null").withColumn("__s", seconds)
    return latency_stats(done, list(keys), "__s")


def status_counts(status: str = "status") -> list[Column]:
    return [F.count_if(F.col(status) == s.upper()).alias(s) for s in ("completed", "failed", "skipped")]


def reason() -> Column:
    return first_truthy(F.col("error_message"), F.col("reasoning"), F.lit("unknown"))


def reasons(computations: DataFrame, keys: list[str]) -> DataFrame:
    return computations.where("status in ('FAILED', 'SKIPPED')").groupBy(*keys, "status", reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def reason_map(computations: DataFrame, keys: list[str], status: str) -> DataFrame:
    """As one JSON object for each group, keys sorted."""
    rows = reasons(computations.where(F.col("status") == status), keys)
    return rows.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n"))))).alias("reasons"))


def coverage(computations: DataFrame, run_samples: DataFrame, wanted: list[str]) -> DataFrame:
    """Each wanted or observed metric's computations, and the share of run samples that it scored."""
    scored = F.when(F.expr(SCORED), F.struct("run_id", "sample_id"))
    seen = computations.groupBy("metric").agg(F.count(F.lit(1)).alias("computations"), F.count_distinct(scored).alias("covered"))
    spark = computations.sparkSession
    asked = spark.createDataFrame([(w,) for w in wanted], "metric string")
    total = run_samples.agg(F.count(F.lit(1)).alias("total"))
    rows = seen.join(asked, "metric", "full").crossJoin(F.broadcast(total))  # the total is one row
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select("metric", n("computations").alias("computations"), n("covered").alias("covered"), rounded(share(n("covered"), F.col("total"))).alias("coverage"))


def failures_by_phase(run_samples: DataFrame, phases: list[str]) -> DataFrame:
    """Failed samples by phase: all phases, unknown ones together under 'unknown'."""
    phase = F.when(F.col("failure_phase").isin(phases), F.col("failure_phase")).otherwise("unknown")
    seen = run_samples.where("status = 'FAILED'").groupBy(phase.alias("phase")).agg(F.count(F.lit(1)).alias("k"))
    fixed = run_samples.sparkSession.createDataFrame([(p,) for p in phases], "phase string")
    return fixed.join(seen, "phase", "left").select("phase", F.coalesce("k", F.lit(0)).alias("n"))


def metric_failures(computations: DataFrame) -> DataFrame:
    counts = computations.groupBy("metric").agg(*status_counts()).drop("completed")
    return counts.where("failed + skipped > 0")


def sample_metrics(computations: DataFrame) -> DataFrame:
    done = F.when(F.col("status") == "COMPLETED", F.col("score"))
    return computations.groupBy("run_id", "sample_id", "metric").agg(rounded(F.avg(done)).alias("value"), F.count(F.lit(1)).alias("computations"), F.count_if(F.col("status") == "COMPLETED").alias("completed"))


def agent_tokens(spans: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Sums over calls, of each the first span that has any count; null where no source has a count."""
    some = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in counts])
    first = F.min(F.when(some, F.struct("start_us", "span_id", *counts)))
    calls = spans.groupBy(*dict.fromkeys([*keys, "trace_id", "call_id"])).agg(first.alias("f"))
    return calls.groupBy(*keys).agg(*[F.sum(f"f.{c}").alias(c) for c in counts], F.count("f").alias("sources_with_data"), F.count(F.lit(1)).alias("sources_total"))


def judge_tokens(computations: DataFrame, keys: list[str]) -> DataFrame:
    n = lambda path: F.get_json_object("metadata", path).try_cast("long")
    usage = F.get_json_object("metadata", "$.judge_usage")
    there = usage.isNotNull() & ~usage.isin("{}", "null")
    return computations.groupBy(*keys).agg(F.sum(F.when(there, n("$.judge_usage.input_tokens"))).alias("input_tokens"), F.count_if(there).alias("sources_with_data"), F.count(F.lit(1)).alias("sources_total"), F.coalesce(F.sum(n("$.judge_calls")), F.lit(0)).alias("calls"), F.sum(F.when(there, n("$.judge_usage.cache_creation_input_tokens"))).alias("cache_creation_input_tokens"))


def merged_usage(calls: DataFrame, keys: list[str], usage: str) -> DataFrame:
    """Maps of counts summed by key; null for no entries at all."""
    rows = calls.select(*keys, F.explode(usage).alias("k", "v")).groupBy(*keys, "k").agg(F.sum("v").alias("v"))
    return rows.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("usage"))


def ground_truths(samples: DataFrame) -> DataFrame:
    """(sample_id, key, value): a row for each label that is there; an empty list of ids is a label, an empty plan isn't."""
    obj = lambda name, c: F.to_json(F.struct(c.alias(name)))
    said = non_empty(F.col("ground_truth_output"))
    entries = [
        F.when(F.col("document_ids").isNotNull(), F.struct(F.lit("relevant_document_ids").alias("key"), obj("relevant_ids", F.col("document_ids")).alias("value"))),
        F.when(F.col("snippet_ids").isNotNull(), F.struct(F.lit("relevant_snippet_ids").alias("key"), obj("relevant_ids", F.col("snippet_ids")).alias("value"))),
        F.when(said.isNotNull(), F.struct(F.lit("expected_output").alias("key"), obj("expected_output", said).alias("value"))),
        F.when(F.size("plan") > 0, F.struct(F.lit("expected_plan").alias("key"), obj("expected_plan", F.col("plan")).alias("value"))),
        F.when(F.size("claims") > 0, F.struct(F.lit("expected_claims").alias("key"), obj("claims", F.col("claims")).alias("value"))),
    ]
    return samples.select("sample_id", F.explode(F.array(*entries)).alias("e")).where("e is not null").select("sample_id", "e.key", "e.value")


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n") for name, df in tables.items()])


def sample_counts(run_samples: DataFrame) -> DataFrame:
    return run_samples.groupBy("run_id").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("status") == "COMPLETED").alias("ok"), F.count_if(F.col("status") == "FAILED").alias("bad"))


def run_status(runs: DataFrame, run_samples: DataFrame) -> DataFrame:
    """none or all failed: FAILED; all completed: COMPLETED; else PARTIALLY_COMPLETED."""
    said = F.when(F.col("seen").isNull() | (F.col("ok") == 0), "FAILED").when(F.col("ok") == F.col("seen"), "COMPLETED").otherwise("PARTIALLY_COMPLETED")
    return runs.select("run_id").join(sample_counts(run_samples), "run_id", "left").select("run_id", said.alias("status"))


def status_snapshot(runs: DataFrame, run_samples: DataFrame) -> DataFrame:
    """runs: run_id, status, expected. What is not yet seen is pending while the run is running, else unprocessed."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    left, running = F.greatest(F.lit(0).cast("long"), F.col("expected") - n("seen")), F.col("status") == "RUNNING"
    zero = F.lit(0).cast("long")
    return runs.join(sample_counts(run_samples), "run_id", "left").select("run_id", n("ok").alias("succeeded"), n("bad").alias("failed"), F.when(running, left).otherwise(zero).alias("pending"), F.when(~running, left).otherwise(zero).alias("unprocessed"))


def expected_samples(runs: DataFrame, planned: DataFrame) -> DataFrame:
    """The plan's size if there is a plan, even an empty one; else the data set's."""
    k = planned.groupBy("run_id").agg(F.count(F.lit(1)).alias("k"))
    size = F.coalesce(F.col("k"), F.lit(0))
    return runs.join(k, "run_id", "left").select("run_id", F.when((size > 0) | F.col("has_plan_snapshot"), size).otherwise(F.col("dataset_size")).alias("expected"))


def render_plan(steps: Column, fields: tuple[str, ...] = ("instruction",)) -> Column:
    """Steps as text, numbered from 1; fields that are missing or blank are left out."""
    def one(s: Column, i: Column) -> Column:
        head = F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": operation="), F.coalesce(non_empty(s["operation"]), F.lit("<unknown operation>")))
        rest = [F.when(non_empty(s[f]).isNotNull(), F.concat(F.lit(f"  {f}: "), non_empty(s[f]))) for f in fields]
        return F.array_join(F.filter(F.array(head, *rest), lambda x: x.isNotNull()), "\n")

    return F.when(F.size(steps) > 0, F.array_join(F.transform(steps, one), "\n")).otherwise("<empty>")


def import_request(spans: DataFrame, text: str) -> DataFrame:
    """The request of each trace's only root; null if it has none or several."""
    root = F.col("span_type") == "agent_root"
    return spans.groupBy("trace_id").agg(F.when(F.count_if(root) == 1, F.max(F.when(root, non_empty(F.col(text))))).alias("request"))


def search_retrieval(output: Column, failure: str = "Search failed") -> Column:
    """A search tool's output as a retrieval result: null for a failed search, unavailable if it can't be read."""
    schema = "struct<query:string,results:array<struct<id:string,title:string,text:string>>>"
    read = F.from_json(output, schema)
    items = F.transform(read["results"], lambda r: F.struct(r["id"].alias("id"), r["title"].alias("title"), r["text"].alias("content")))
    bad = read["results"].isNull()
    return F.when(output.isNull() | F.startswith(output, F.lit(failure)), None).otherwise(F.struct(F.lit("document").alias("kind"), F.lit("selected").alias("stage"), F.when(bad, "unavailable").otherwise("available").alias("availability"), F.when(bad, "the output is not the search results").alias("reason"), read["query"].alias("query"), items.alias("items")))


def unique_ids(df: DataFrame, raw: str, order: str) -> DataFrame:
    """The k-th row of a raw id, in order, gets __k from the second on."""
    k = F.row_number().over(Window.partitionBy(raw).orderBy(order))
    return df.withColumn("__k", k).withColumn("unique_id", F.when(F.col("__k") > 1, F.concat(F.col(raw), F.lit("__"), F.col("__k").cast("string"))).otherwise(F.col(raw))).drop("__k")


def judged_precision(verdicts: DataFrame) -> DataFrame:
    """verdicts: unit_id, item_pos, relevant. The mean of precision at relevant positions; 0 without any."""
    w = Window.partitionBy("unit_id").orderBy("item_pos")
    hits = F.sum(F.col("relevant").cast("int")).over(w)
    at = verdicts.select("unit_id", F.when(F.col("relevant"), hits / F.row_number().over(w)).alias("p"))
    return at.groupBy("unit_id").agg(F.coalesce(F.avg("p"), F.lit(0.0)).alias("score"))


def full_report(run: DataFrame, run_samples: DataFrame, computations: DataFrame, wanted: list[str]) -> DataFrame:
    """One JSON document for each run: status counts, latency, metrics with coverage, scores and reasons, samples."""
    per_metric = computations.groupBy("run_id", "metric").agg(*status_counts(), F.count_distinct(F.when(F.expr(SCORED), F.col("sample_id"))).alias("covered"))
    stats = metric_scores(computations, ("run_id", "metric"))
    why = reasons(computations, ["run_id", "metric"]).groupBy("run_id", "metric").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.concat_ws(": ", "status", "reason"), "n")))).alias("reasons"))
    rows = per_metric.join(stats, ["run_id", "metric"], "left").join(why, ["run_id", "metric"], "left")
    listed = rows.groupBy("run_id").agg(F.collect_list(F.struct("metric", "completed", "failed", "skipped", "covered", F.struct("n", "mean", "stddev", "min", "p25", "median", "p75", "max").alias("scores"), F.to_json("reasons").alias("reasons"))).alias("metrics"))
    times = latency(run_samples, ("run_id",))
    out = run.join(sample_counts(run_samples), "run_id", "left").join(times, "run_id", "left").join(listed, "run_id", "left")
    ordered = F.sort_array("metrics")
    return out.select("run_id", F.to_json(F.struct("run_id", "status", F.struct(F.coalesce("seen", F.lit(0)).alias("processed"), F.coalesce("ok", F.lit(0)).alias("succeeded"), F.coalesce("bad", F.lit(0)).alias("failed")).alias("samples"), F.struct("mean", "median", "p95", "min", "max").alias("latency_seconds"), F.array(*[F.lit(w) for w in wanted]).alias("selected_metrics"), ordered.alias("metrics"))).alias("report"))
