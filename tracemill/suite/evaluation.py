"""Normalising, planning, metrics, report (C, D6, E1-E19, F7-F9, M)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import scores, text
from tracemill.operators import judged, metrics, normalize, report, trees, validate
from tracemill.plans import planner
from tracemill.plans.lens import SQL, Lens
from tracemill.suite import query


def records(t: Lens) -> DataFrame:
    """Events as raw span records."""
    e = t.spans()
    kind = F.when(F.col("event_type") == "view", "RETRIEVER").when(F.col("event_type") == "purchase", "LLM").when(F.col("event_type") == "click", "").otherwise(F.lit(None))
    attributes = F.map_filter(F.create_map(F.lit("openinference.span.kind"), kind, F.lit("input.value"), F.col("props"), F.lit("llm.token_count.prompt"), F.get_json_object("props", "$.k"), F.lit("llm.cost.total"), F.when(F.col("value") > 50, F.lit("0.5"))), lambda k, v: v.isNotNull())
    return e.select(F.col("span_id").cast("string").alias("context_span_id"), F.col("trace_id").cast("string").alias("trace_id"), F.col("parent_id").cast("string").alias("parent_id"), F.when(F.col("span_id") % 3 == 0, "").otherwise(F.col("event_type")).alias("name"), F.when(F.col("event_type") == "click", "TOOL").alias("span_kind"), F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", F.lit(None)).otherwise("OK").alias("status_code"), F.when(F.col("event_type") == "error", "boom").alias("status_message"), F.timestamp_micros("start_us").alias("start_time"), F.timestamp_micros("end_us").alias("end_time"), attributes.alias("attributes"))


RAW = """rec AS (SELECT span_id, trace_id, parent_id, value, CASE WHEN span_id % 3 = 0 THEN CAST(span_id AS VARCHAR) ELSE event_type END AS name,
 CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'unset' ELSE 'success' END AS status,
 CASE event_type WHEN 'view' THEN 'retrieval' WHEN 'purchase' THEN 'llm' WHEN 'click' THEN 'tool' ELSE CASE WHEN parent_id IS NULL THEN 'agent_root' ELSE 'unknown' END END AS span_type, event_type, props FROM span)"""


@query("c01_normalize", f", {RAW} SELECT CAST(span_id AS VARCHAR) AS external_id, span_type, status, name, props AS input_data, coalesce(CAST(CASE WHEN span_type = 'llm' THEN json_extract_string(props, '$.k') END AS BIGINT), -1) AS input_tokens, CASE WHEN span_type = 'llm' AND value > 50 THEN 'USD' END AS currency FROM rec", "span")
def _(t: Lens) -> DataFrame:
    return normalize.canonical(records(t)).select("external_id", "span_type", "status", "name", "input_data", F.coalesce("usage.input_tokens", F.lit(-1)).alias("input_tokens"), "usage.currency")


@query("c02_kinds", f", {RAW} SELECT span_type, status, count(*) AS n FROM rec GROUP BY ALL", "span")
def _(t: Lens) -> DataFrame:
    return normalize.canonical(records(t)).groupBy("span_type", "status").agg(F.count(F.lit(1)).alias("n"))


@query("c05_metadata", "SELECT CAST(span_id AS VARCHAR) AS external_id, CASE event_type WHEN 'view' THEN 'RETRIEVER' WHEN 'purchase' THEN 'LLM' WHEN 'click' THEN '' END AS kind, CASE WHEN event_type = 'error' THEN 'boom' END AS message, CAST(2 + CASE WHEN event_type IN ('view', 'purchase', 'click') THEN 1 ELSE 0 END + CASE WHEN value > 50 THEN 1 ELSE 0 END + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS keys FROM span", "span")
def _(t: Lens) -> DataFrame:
    m = F.col("metadata")
    return normalize.canonical(records(t)).select("external_id", F.try_element_at(m, F.lit("attributes.openinference.span.kind")).alias("kind"), F.try_element_at(m, F.lit("phoenix.status_message")).alias("message"), F.size(m).cast("long").alias("keys"))


@query("c06_decode", "SELECT 'pages' AS source, count(*) AS n, count(*) FILTER (WHERE json_valid(html)) AS json FROM pages UNION ALL SELECT 'events', count(*), count(*) FILTER (WHERE json_valid(props)) FROM events")
def _(t: Lens) -> DataFrame:
    def one(name: str, column: str) -> DataFrame:
        return t.table(name).agg(F.count(F.lit(1)).alias("n"), F.count_if(text.is_json(F.col(column))).alias("json")).select(F.lit(name).alias("source"), "n", "json")

    return one("pages", "html").union(one("events", "props"))


@query("c09_envelopes", "SELECT trace_id, min(start_us) AS start_time, max(end_us) AS end_time, count(*) AS spans, 'phoenix' AS source, 'phoenix:1' AS adapter, 1 AS schema_version FROM span GROUP BY trace_id", "span")
def _(t: Lens) -> DataFrame:
    return normalize.envelopes(t.spans(), "start_us", "end_us")


def flattened(events: DataFrame) -> DataFrame:
    nested = F.to_json(F.struct(F.struct(F.from_json("props", "k int").alias("b")).alias("a"), F.lit("x").alias("c")))
    m = normalize.flattened(nested)
    back = F.concat(F.lit('{"k": '), F.try_element_at(m, F.lit("a.b.k")), F.lit("}"))
    return events.select("event_id", back.alias("a_b"), F.try_element_at(m, F.lit("c")).alias("c"))


@query("c10_flatten", "SELECT event_id, props AS a_b, 'x' AS c FROM events")
def _(t: Lens) -> DataFrame:
    return flattened(t.table("events"))


@query("c13_violations", """, e AS (SELECT *, CASE WHEN span_id % 11 IN (6, 7) AND 2 * rn <= count(*) OVER (PARTITION BY trace_id) THEN 0 ELSE span_id % 11 END AS c FROM span), t AS (SELECT trace_id, arg_min(span_id, rn) AS root FROM span GROUP BY trace_id)
SELECT trace_id, 'negative_duration' AS rule, CAST(span_id AS VARCHAR) AS detail FROM e WHERE end_us - 5000000 < start_us
UNION ALL SELECT trace_id, 'missing_parent', '-5' FROM e WHERE c = 5
UNION ALL SELECT trace_id, 'cycle', CAST(span_id AS VARCHAR) FROM e WHERE c = 6
UNION ALL SELECT trace_id, 'cycle', CAST(-1000 - span_id AS VARCHAR) FROM e WHERE c IN (6, 7)
UNION ALL SELECT trace_id, 'cycle', CAST(span_id AS VARCHAR) FROM e WHERE c = 7
UNION ALL SELECT trace_id, 'duplicate_span_id', CAST(-2000000000 - span_id AS VARCHAR) FROM e WHERE c = 8
UNION ALL SELECT -1 - trace_id, 'no_spans', NULL FROM t
UNION ALL SELECT trace_id, 'schema_version', '2' FROM t WHERE trace_id % 3 = 0
UNION ALL SELECT trace_id, 'negative_trace_duration', CAST(trace_id AS VARCHAR) FROM t WHERE trace_id % 5 = 0
UNION ALL SELECT trace_id, 'other_trace', CAST(root AS VARCHAR) FROM t WHERE trace_id % 4 = 0""", "span")
def _(t: Lens) -> DataFrame:
    """Each rule is broken by the spans of one class of ids: a parent that isn't there (5), a leaf above itself (6), two
    spans above each other, one of them a leaf (7), a span that comes twice (8); and by traces without spans, of another version, with
    a span that names another trace, and with an end before their start."""
    s, n = t.spans(), F.count(F.lit(1)).over(Window.partitionBy("trace_id"))
    s = s.withColumns({"end_us": F.col("end_us") - 5000000, "c": F.when((F.col("span_id") % 11).isin(6, 7) & (2 * F.col("rn") <= n), 0).otherwise(F.col("span_id") % 11)})
    columns = ["trace_id", "span_id", "parent_id", "start_us", "end_us"]
    extra = lambda c, span, parent: s.where(F.col("c").isin(c)).select("trace_id", span.alias("span_id"), parent.alias("parent_id"), F.lit(0).cast("long").alias("start_us"), F.lit(1).cast("long").alias("end_us"))
    other, nobody = -1000 - F.col("span_id"), F.lit(None).cast("long")
    twice = extra([8], -2000000000 - F.col("span_id"), nobody)
    spans = s.withColumn("parent_id", F.when(F.col("c") == 5, F.lit(-5)).when(F.col("c") == 6, F.col("span_id")).when(F.col("c") == 7, other)).select(*columns)
    spans = reduce(DataFrame.union, [spans, extra([6, 7], other, F.col("span_id")), twice, twice])
    heads = t.spans().groupBy("trace_id").agg(F.min_by("span_id", "rn").alias("root"))
    traces = heads.select("trace_id", F.when(F.col("trace_id") % 3 == 0, 2).otherwise(1).alias("schema_version"), F.lit(0).cast("long").alias("start_us"), F.when(F.col("trace_id") % 5 == 0, -1).otherwise(0).cast("long").alias("end_us")).union(heads.select(-1 - F.col("trace_id"), F.lit(1), F.lit(0).cast("long"), F.lit(None).cast("long")))
    stated = heads.select("trace_id", F.col("root").alias("span_id"), F.when(F.col("trace_id") % 4 == 0, -1).otherwise(F.col("trace_id")).alias("stated_trace_id"))
    return validate.span_violations(spans).union(validate.envelope_violations(traces, spans)).union(validate.trace_id_violations(stated))


@query("c13_plan_violations", """, p AS (SELECT *, span_id % 11 AS c FROM span)
SELECT trace_id, 'plan_cycle' AS rule, CAST(span_id AS VARCHAR) AS detail FROM p WHERE c = 0
UNION ALL SELECT trace_id, 'missing_superseded_plan', '-1' FROM p WHERE c = 1
UNION ALL SELECT trace_id, 'dependency_cycle', CAST(span_id AS VARCHAR) FROM p WHERE c = 2
UNION ALL SELECT trace_id, 'unknown_dependency', CAST(span_id AS VARCHAR) FROM p WHERE c = 3
UNION ALL SELECT trace_id, 'duplicate_step', CAST(span_id AS VARCHAR) FROM p WHERE c = 4
UNION ALL SELECT trace_id, 'unknown_plan', CAST(span_id AS VARCHAR) FROM p WHERE c = 5
UNION ALL SELECT trace_id, 'unknown_planned_step', CAST(span_id AS VARCHAR) FROM p WHERE c IN (6, 7)
UNION ALL SELECT trace_id, 'unknown_execution_span', CAST(span_id AS VARCHAR) FROM p WHERE c = 8
UNION ALL SELECT trace_id, 'duplicate_plan', CAST(span_id AS VARCHAR) FROM p WHERE c = 9""", "span")
def _(t: Lens) -> DataFrame:
    """A plan and an executed step for each span; each rule is broken by the spans of one class of ids."""
    s = t.spans().withColumn("c", F.col("span_id") % 11)
    step = lambda name, *needs: F.struct(F.lit(name).alias("id"), F.array(*map(F.lit, needs)).cast("array<string>").alias("depends_on"))
    fine = F.array(step("a"), step("b", "a"), step("c", "a", "b"))
    steps = F.when(F.col("c") == 2, F.array(step("a"), step("b", "a", "c"), step("c", "b"))).when(F.col("c") == 3, F.array(step("a", "z"))).when(F.col("c") == 4, F.array(step("a"), step("a"))).otherwise(fine)
    plans = s.select("trace_id", F.col("span_id").alias("plan_id"), F.when(F.col("c") == 0, F.col("span_id")).when(F.col("c") == 1, F.lit(-1)).alias("supersedes"), steps.alias("steps"), "c")
    plans = plans.union(plans.where("c = 9")).drop("c")
    done = s.select("trace_id", F.col("span_id").alias("step_id"), F.when(F.col("c") == 8, F.lit(-1)).otherwise(F.col("span_id")).alias("span_id"), F.when(F.col("c") == 5, F.lit(-1)).when(F.col("c") != 7, F.col("span_id")).alias("plan_id"), F.when(F.col("c") == 6, "z").when(F.col("c") != 5, "a").alias("planned_step_id"))
    return validate.plan_violations(plans).union(validate.step_violations(done, s)).union(validate.step_plan_violations(done, plans))


@query("c14_unavailable_items", "SELECT span_id FROM span WHERE status = 'error' AND rn % 2 = 0", "span")
def _(t: Lens) -> DataFrame:
    r = t.spans().select("span_id", F.when(F.col("status") == "error", "unavailable").otherwise("available").alias("availability"), F.when(F.col("rn") % 2 == 0, F.array("span_id")).otherwise(F.array().cast("array<bigint>")).alias("items"))
    return validate.unavailable_with_items(r).select("span_id")


def retrievals(t: Lens) -> DataFrame:
    """A retrieval set for each span, by its number: none, unavailable, unranked, without content, or good."""
    kind = F.col("rn") % 5
    one = F.struct(F.lit("document").alias("kind"), F.lit("selected").alias("stage"), F.when(kind == 1, "unavailable").otherwise("available").alias("availability"), F.when((kind == 1) & (F.col("rn") % 2 == 0), "timeout").alias("reason"), F.array(F.col("span_id").cast("string")).alias("ids"), F.array(F.when(kind != 3, F.lit("text"))).alias("contents"), (kind != 2).alias("ranked"))
    return t.spans().withColumn("retrieval", F.when(kind == 0, F.filter(F.array(one), lambda x: F.lit(False))).otherwise(F.array(one)))


@query("c18_skip_reason", """SELECT span_id, CASE rn % 5 WHEN 0 THEN 'Trace does not provide selected document context.' WHEN 1 THEN 'Document retrieval unavailable: ' || CASE WHEN rn % 2 = 0 THEN 'timeout' ELSE 'results were unavailable' END || '.'
 WHEN 2 THEN 'Document selected context is not ranked.' WHEN 3 THEN 'Retrieved document items do not contain the content required by this metric.' END AS reason FROM span""", "span")
def _(t: Lens) -> DataFrame:
    return retrievals(t).select("span_id", metrics.retrieval_skip(F.col("retrieval"), "document", ranked=True, content=True).alias("reason"))


@query("c19_relevant_ids", "SELECT span_id, CASE rn % 3 WHEN 0 THEN 'a,b' WHEN 1 THEN NULL ELSE '' END AS ids, CASE rn % 3 WHEN 1 THEN 'ground_truth_value.relevant_ids must be a list.' END AS fault FROM span", "span")
def _(t: Lens) -> DataFrame:
    value = F.when(F.col("rn") % 3 == 0, '{"relevant_ids": [" a ", "a", {"id": " b "}, "", null, 12, {}]}').when(F.col("rn") % 3 == 1, '{"relevant_ids": "invalid"}').otherwise('{"relevant_ids": []}')
    ids, fault = text.relevant_ids(value)
    return t.spans().select("span_id", F.array_join(ids, ",").alias("ids"), fault.alias("fault"))


@query("c20_display", "SELECT doc_id, md5(coalesce(nullif(regexp_replace(text, '^[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+|[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+$', '', 'g'), ''), '<empty>')) AS shown FROM documents")
def _(t: Lens) -> DataFrame:
    return t.table("documents").select("doc_id", F.md5(text.display(F.col("text"))).alias("shown"))


@query("c22_render_plan", "SELECT conv_id, array_to_string(list_transform(executed, lambda x, i: 'Step ' || i || ': operation=' || x), chr(10)) AS plan FROM conv", "conv")
def _(t: Lens) -> DataFrame:
    return t.conversations().select("conv_id", report.render_plan(F.transform("executed", lambda x: F.struct(x.alias("operation"), F.lit(None).cast("string").alias("instruction")))).alias("plan"))


@query("c24_prompt", "SELECT conv_id, concat_ws(chr(10) || chr(10), 'Q: ' || request, 'A: ' || answer, 'End') AS prompt FROM conv", "conv")
def _(t: Lens) -> DataFrame:
    return t.conversations().select("conv_id", text.paragraphs(F.concat(F.lit("Q: "), "request"), F.concat(F.lit("A: "), "answer"), F.lit("End")).alias("prompt"))


@query("c25_import_request", "SELECT trace_id, CASE WHEN count(*) FILTER (WHERE span_type = 'agent_root') = 1 THEN max(props) FILTER (WHERE span_type = 'agent_root') END AS request FROM short JOIN (SELECT span_id, props FROM span) q USING (span_id) GROUP BY trace_id", "span short")
def _(t: Lens) -> DataFrame:
    return report.import_request(t.short_traces(), "props").select("trace_id", "request")


@query("c26_search_output", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'unavailable' ELSE 'available' END AS availability, CAST(CASE event_id % 4 WHEN 2 THEN 1 WHEN 3 THEN 0 ELSE -1 END AS BIGINT) AS items FROM events")
def _(t: Lens) -> DataFrame:
    said = F.when(F.col("event_id") % 4 == 0, "Search failed: x").when(F.col("event_id") % 4 == 1, "not json").when(F.col("event_id") % 4 == 2, '{"query": "q", "results": [{"id": "1", "title": "t", "text": "x"}]}').otherwise('{"query": "q", "results": []}')
    r = report.search_retrieval(said)
    return t.table("events").select("event_id", r["availability"].alias("availability"), F.when(r["availability"] == "available", F.size(r["items"])).otherwise(-1).cast("long").alias("items"))


@query("c28_rebase", "SELECT span_id, 1000 + start_us - min(start_us) OVER (PARTITION BY trace_id) AS rebased_us FROM span", "span")
def _(t: Lens) -> DataFrame:
    return normalize.rebased(t.spans().withColumn("agent_start_us", F.lit(1000).cast("long"))).select("span_id", "rebased_us")


@query("c31_embedding_text", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' body' WHEN p_partkey % 3 = 1 THEN p_name || chr(10) || chr(10) || p_name || '-x' ELSE p_name END AS text FROM part")
def _(t: Lens) -> DataFrame:
    body = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" body"))).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit("-x"))).otherwise("")
    return t.table("part").select("p_partkey", text.embedding_text(F.col("p_name"), body).alias("text"))


@query("c32_truncate", "SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || chr(10) || '[truncated]' ELSE text END AS text FROM documents")
def _(t: Lens) -> DataFrame:
    return t.table("documents").select("doc_id", text.truncated(F.col("text"), 100).alias("text"))


@query("c33_unique_ids", "SELECT doc_id, source || CASE WHEN k > 1 THEN '__' || k ELSE '' END AS unique_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) q")
def _(t: Lens) -> DataFrame:
    return report.unique_ids(t.table("documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "unique_id")


@query("d06_plan", """, w AS (SELECT * FROM (VALUES ('llm_calls', 'llm', 'GROUP'), ('tool_calls', 'tool', 'SINGLE'), ('judge', 'judge', 'SINGLE')) v(metric, target_span_type, mode)),
tr AS (SELECT DISTINCT trace_id FROM short),
g AS (SELECT trace_id, span_type, string_agg(CAST(span_id AS VARCHAR), ',' ORDER BY start_us, span_id) AS ids FROM short GROUP BY ALL)
SELECT tr.trace_id, metric, target_span_type, CASE WHEN mode = 'GROUP' THEN g.ids ELSE CAST(s.span_id AS VARCHAR) END AS span_ids, CASE WHEN g.ids IS NULL THEN 'No spans found for target span type "' || target_span_type || '".' END AS skip_reason
FROM tr CROSS JOIN w LEFT JOIN g ON g.trace_id = tr.trace_id AND g.span_type = target_span_type LEFT JOIN short s ON mode = 'SINGLE' AND s.trace_id = tr.trace_id AND s.span_type = target_span_type""", "span short")
def _(t: Lens) -> DataFrame:
    wanted = t.spark.createDataFrame([("llm_calls", "llm", "GROUP"), ("tool_calls", "tool", "SINGLE"), ("judge", "judge", "SINGLE")], "metric string, target_span_type string, mode string")
    spans = t.short_traces()
    return planner.plan(spans, spans, wanted).select("trace_id", "metric", "target_span_type", F.array_join(F.transform("span_ids", lambda x: x.cast("string")), ",").alias("span_ids"), "skip_reason")


@query("d06_plan_hex", """, w AS (SELECT * FROM (VALUES ('llm_calls', 'llm', 'GROUP'), ('tool_calls', 'tool', 'SINGLE'), ('judge', 'judge', 'SINGLE')) v(metric, target_span_type, mode)),
tr AS (SELECT DISTINCT trace_id FROM short),
g AS (SELECT trace_id, span_type, string_agg(lpad(lower(to_hex(span_id)), 16, '0'), ',' ORDER BY start_us, span_id) AS ids FROM short GROUP BY ALL)
SELECT tr.trace_id, metric, target_span_type, CASE WHEN mode = 'GROUP' THEN g.ids ELSE lpad(lower(to_hex(s.span_id)), 16, '0') END AS span_ids, CASE WHEN g.ids IS NULL THEN 'No spans found for target span type "' || target_span_type || '".' END AS skip_reason
FROM tr CROSS JOIN w LEFT JOIN g ON g.trace_id = tr.trace_id AND g.span_type = target_span_type LEFT JOIN short s ON mode = 'SINGLE' AND s.trace_id = tr.trace_id AND s.span_type = target_span_type""", "span short")
def _(t: Lens) -> DataFrame:
    """The same over ids of 16 hex digits, as tracers give them."""
    wanted = t.spark.createDataFrame([("llm_calls", "llm", "GROUP"), ("tool_calls", "tool", "SINGLE"), ("judge", "judge", "SINGLE")], "metric string, target_span_type string, mode string")
    spans = t.short_traces().withColumn("span_id", F.lpad(F.lower(F.hex("span_id")), 16, "0"))
    return planner.plan(spans, spans, wanted).select("trace_id", "metric", "target_span_type", F.array_join("span_ids", ",").alias("span_ids"), "skip_reason")


@query("e01_score_stats", "SELECT metric, count(score) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS stddev, round(min(score), 6) AS min, round(quantile_cont(score, 0.25), 6) AS p25, round(median(score), 6) AS median, round(quantile_cont(score, 0.75), 6) AS p75, round(max(score), 6) AS max FROM comp WHERE status = 'COMPLETED' AND score IS NOT NULL GROUP BY metric", "comp")
def _(t: Lens) -> DataFrame:
    return report.metric_scores(t.computations())


@query("e03_latency", "SELECT round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(quantile_cont(d, 0.95), 6) AS p95, round(min(d), 6) AS min, round(max(d), 6) AS max FROM (SELECT (end_us - start_us) / 1000000.0 AS d FROM rs WHERE status = 'COMPLETED') q", "rs")
def _(t: Lens) -> DataFrame:
    return report.latency(t.run_samples())


@query("e04_status_counts", "SELECT run_id, CAST(count(*) FILTER (WHERE status = 'COMPLETED') AS BIGINT) AS completed, CAST(count(*) FILTER (WHERE status = 'FAILED') AS BIGINT) AS failed, CAST(count(*) FILTER (WHERE status = 'SKIPPED') AS BIGINT) AS skipped FROM comp GROUP BY run_id", "comp")
def _(t: Lens) -> DataFrame:
    return t.computations().groupBy("run_id").agg(*report.status_counts())


@query("e05_reasons", "SELECT metric, status, coalesce(nullif(error_message, ''), nullif(reasoning, ''), 'unknown') AS reason, count(*) AS n FROM comp WHERE status IN ('FAILED', 'SKIPPED') GROUP BY ALL", "comp")
def _(t: Lens) -> DataFrame:
    return report.reasons(t.computations(), ["metric"])


@query("e06_coverage", "SELECT m.metric, count(c.metric) AS computations, count(DISTINCT CASE WHEN c.status = 'COMPLETED' AND c.score IS NOT NULL THEN c.run_id * 10 + c.sample_id END) AS covered, round(count(DISTINCT CASE WHEN c.status = 'COMPLETED' AND c.score IS NOT NULL THEN c.run_id * 10 + c.sample_id END) / (SELECT count(*) FROM rs), 6) AS coverage FROM (SELECT DISTINCT metric FROM comp UNION SELECT 'ZZ') m LEFT JOIN comp c ON c.metric = m.metric GROUP BY m.metric", "comp rs")
def _(t: Lens) -> DataFrame:
    return report.coverage(t.computations(), t.run_samples(), ["ZZ"])


@query("e07_phases", "SELECT p.phase, count(r.run_id) AS n FROM (VALUES ('agent_call'), ('trace'), ('metrics'), ('unknown')) p(phase) LEFT JOIN (SELECT run_id, CASE flag WHEN 'A' THEN 'agent_call' WHEN 'N' THEN 'metrics' ELSE 'unknown' END AS phase FROM rs WHERE status = 'FAILED') r ON r.phase = p.phase GROUP BY p.phase", "rs")
def _(t: Lens) -> DataFrame:
    phase = F.when(F.col("flag") == "A", "agent_call").when(F.col("flag") == "N", "metrics").otherwise("sample_setup")
    return report.failures_by_phase(t.run_samples().withColumn("failure_phase", phase), ["agent_call", "trace", "metrics", "unknown"])


@query("e08_metric_failures", "SELECT metric, CAST(count(*) FILTER (WHERE status = 'FAILED') AS BIGINT) AS failed, CAST(count(*) FILTER (WHERE status = 'SKIPPED') AS BIGINT) AS skipped FROM comp GROUP BY metric HAVING count(*) FILTER (WHERE status IN ('FAILED', 'SKIPPED')) > 0", "comp")
def _(t: Lens) -> DataFrame:
    return report.metric_failures(t.computations())


@query("e09_sample_metric", "SELECT run_id, sample_id, metric, round(avg(score) FILTER (WHERE status = 'COMPLETED'), 6) AS value, count(*) AS computations, CAST(count(*) FILTER (WHERE status = 'COMPLETED') AS BIGINT) AS completed FROM comp GROUP BY ALL", "comp")
def _(t: Lens) -> DataFrame:
    return report.sample_metrics(t.computations())


@query("e10_agent_tokens", """, u AS (SELECT trace_id, rn // 2 AS call_id, start_us, span_id, CASE WHEN rn % 3 <> 0 THEN input_tokens END AS i, CASE WHEN rn % 4 = 0 THEN input_tokens * 2 END AS o FROM span WHERE span_type = 'llm'),
f AS (SELECT *, row_number() OVER (PARTITION BY trace_id, call_id ORDER BY start_us, span_id) AS k FROM u WHERE i IS NOT NULL OR o IS NOT NULL)
SELECT t.trace_id, coalesce(CAST(sum(i) AS BIGINT), -1) AS input_tokens, coalesce(CAST(sum(o) AS BIGINT), -1) AS output_tokens, count(f.trace_id) AS sources_with_data, any_value(t.n) AS sources_total FROM (SELECT trace_id, count(DISTINCT call_id) AS n FROM u GROUP BY trace_id) t LEFT JOIN f ON f.trace_id = t.trace_id AND k = 1 GROUP BY t.trace_id""", "span")
def _(t: Lens) -> DataFrame:
    u = t.spans().where("span_type = 'llm'").select("trace_id", F.floor(F.col("rn") / 2).alias("call_id"), "start_us", "span_id", F.when(F.col("rn") % 3 != 0, F.col("input_tokens")).alias("input_tokens"), F.when(F.col("rn") % 4 == 0, F.col("input_tokens") * 2).alias("output_tokens"))
    return report.agent_tokens(u, ["trace_id"], ["input_tokens", "output_tokens"]).withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("input_tokens", "output_tokens")})


@query("e11_judge_tokens", "SELECT metric, CAST(sum(tokens) FILTER (WHERE l_linenumber % 2 = 0) AS BIGINT) AS input_tokens, CAST(count(*) FILTER (WHERE l_linenumber % 2 = 0) AS BIGINT) AS sources_with_data, count(*) AS sources_total, CAST(coalesce(sum(l_linenumber) FILTER (WHERE l_linenumber % 3 = 0), 0) AS BIGINT) AS calls, CAST(NULL AS BIGINT) AS cache_creation_input_tokens FROM comp GROUP BY metric", "comp")
def _(t: Lens) -> DataFrame:
    c = t.computations()
    usage = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit('"judge_usage":{"input_tokens":'), "tokens", F.lit("}"))).otherwise('"judge_usage":{}')
    calls = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit(',"judge_calls":'), "l_linenumber")).otherwise("")
    return report.judge_tokens(c.withColumn("metadata", F.concat(F.lit("{"), usage, calls, F.lit("}"))), ["metric"])


@query("e12_truths", "SELECT p_partkey AS sample_id, unnest(list_filter([CASE WHEN p_size % 2 = 0 THEN 'relevant_document_ids' END, CASE WHEN p_size % 3 = 0 THEN 'expected_output' END, CASE WHEN p_size % 5 = 0 THEN 'expected_plan' END], lambda x: x IS NOT NULL)) AS key FROM part")
def _(t: Lens) -> DataFrame:
    p = t.table("part")
    samples = p.select(F.col("p_partkey").alias("sample_id"), F.when(F.col("p_size") % 2 == 0, F.array().cast("array<string>")).alias("document_ids"), F.lit(None).cast("array<string>").alias("snippet_ids"), F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise("  ").alias("ground_truth_output"), F.when(F.col("p_size") % 5 == 0, F.array("p_type")).otherwise(F.array().cast("array<string>")).alias("plan"), F.lit(None).cast("array<string>").alias("claims"))
    return report.ground_truths(samples).select("sample_id", "key")


@query("e13_sql_aggregate", "SELECT metric, round(avg(score), 6) AS avg, round(min(score), 6) AS min, round(max(score), 6) AS max, round(stddev_samp(score), 6) AS stddev, count(score) AS n FROM comp WHERE status = 'COMPLETED' AND score IS NOT NULL GROUP BY metric", "comp")
def _(t: Lens) -> DataFrame:
    return report.metric_scores(t.computations()).select("metric", F.col("mean").alias("avg"), "min", "max", "stddev", "n")


@query("e14_scores_descending", "SELECT score, l_partkey, l_suppkey FROM comp WHERE metric = 'AF' AND status = 'COMPLETED' AND score IS NOT NULL ORDER BY score DESC, us, l_partkey, l_suppkey", "comp")
def _(t: Lens) -> DataFrame:
    return t.computations().where("metric = 'AF' and status = 'COMPLETED' and score is not null").orderBy(F.desc("score"), "us", "l_partkey", "l_suppkey").select("score", "l_partkey", "l_suppkey")


@query("e15_counts", "SELECT 'run' AS entity, count(*) AS n FROM run UNION ALL SELECT 'sample', count(*) FROM rs UNION ALL SELECT 'computation', count(*) FROM comp UNION ALL SELECT 'span', count(*) FROM span", "run rs comp span")
def _(t: Lens) -> DataFrame:
    return report.counts({"run": t.runs(), "sample": t.run_samples(), "computation": t.computations(), "span": t.table("events")})


@query("e16_run_status", "SELECT r.run_id, CASE WHEN count(s.run_id) = 0 THEN 'FAILED' WHEN count(*) FILTER (WHERE s.status = 'COMPLETED') = count(s.run_id) THEN 'COMPLETED' WHEN count(*) FILTER (WHERE s.status = 'COMPLETED') > 0 THEN 'PARTIALLY_COMPLETED' ELSE 'FAILED' END AS status FROM run r LEFT JOIN rs s USING (run_id) GROUP BY r.run_id", "run rs")
def _(t: Lens) -> DataFrame:
    return report.run_status(t.runs(), t.run_samples())


@query("e17_status_snapshot", "SELECT r.run_id, CAST(count(*) FILTER (WHERE s.status = 'COMPLETED') AS BIGINT) AS succeeded, CAST(count(*) FILTER (WHERE s.status = 'FAILED') AS BIGINT) AS failed, CASE WHEN any_value(r.status) = 'RUNNING' THEN greatest(0, 5 - count(s.run_id)) ELSE 0 END AS pending, CASE WHEN any_value(r.status) <> 'RUNNING' THEN greatest(0, 5 - count(s.run_id)) ELSE 0 END AS unprocessed FROM run r LEFT JOIN rs s USING (run_id) GROUP BY r.run_id", "run rs")
def _(t: Lens) -> DataFrame:
    return report.status_snapshot(t.runs().withColumn("expected", F.lit(5).cast("long")), t.run_samples())


@query("e18_expected_samples", "SELECT r.run_id, CASE WHEN count(s.run_id) > 0 OR r.run_id % 2 = 0 THEN count(s.run_id) ELSE 5 END AS expected FROM run r LEFT JOIN rs s USING (run_id) GROUP BY r.run_id", "run rs")
def _(t: Lens) -> DataFrame:
    runs = t.runs().select("run_id", (F.col("run_id") % 2 == 0).alias("has_plan_snapshot"), F.lit(5).cast("long").alias("dataset_size"))
    return report.expected_samples(runs, t.run_samples())


@query("e19_usage_merge", "SELECT run_id, CAST(sum(tokens) AS BIGINT) AS input_tokens, coalesce(CAST(sum(l_linenumber) FILTER (WHERE l_linenumber > 3) AS BIGINT), -1) AS output_tokens FROM comp GROUP BY run_id", "comp")
def _(t: Lens) -> DataFrame:
    usage = F.map_filter(F.create_map(F.lit("input_tokens"), F.col("tokens"), F.lit("output_tokens"), F.when(F.col("l_linenumber") > 3, F.col("l_linenumber").cast("long"))), lambda k, v: v.isNotNull())
    merged = report.merged_usage(t.computations().withColumn("usage", usage), ["run_id"], "usage")
    return merged.select("run_id", F.try_element_at("usage", F.lit("input_tokens")).alias("input_tokens"), F.coalesce(F.try_element_at("usage", F.lit("output_tokens")), F.lit(-1)).alias("output_tokens"))


@query("f01_ranks", "SELECT span_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY start_us, span_id) AS BIGINT) AS rank FROM span WHERE span_type = 'retrieval'", "span")
def _(t: Lens) -> DataFrame:
    w = Window.partitionBy("trace_id").orderBy("start_us", "span_id")
    return t.spans().where("span_type = 'retrieval'").select("span_id", F.row_number().over(w).cast("long").alias("rank"))


WALK = """WITH RECURSIVE {span},
w AS (SELECT trace_id, span_id, 0 AS depth, CAST(NULL AS BIGINT) AS top, '00000001' AS path FROM span WHERE parent_id IS NULL
UNION ALL SELECT s.trace_id, s.span_id, w.depth + 1, coalesce(w.top, s.span_id), w.path || '.' || s.o FROM w JOIN (SELECT *, lpad(CAST(row_number() OVER (PARTITION BY trace_id, parent_id ORDER BY start_us, end_us, span_type, span_id) AS VARCHAR), 8, '0') AS o FROM span) s ON s.trace_id = w.trace_id AND s.parent_id = w.span_id)
""".replace("{span}", SQL["span"])


@query("f07_ancestors", WALK + "SELECT trace_id, span_id, CAST(depth AS BIGINT) AS depth, coalesce(top, -1) AS top FROM w")
def _(t: Lens) -> DataFrame:
    return trees.walked(t.spark, t.spans()).select("trace_id", "span_id", F.col("depth").cast("long").alias("depth"), F.coalesce("top", F.lit(-1)).alias("top"))


@query("f08_depth_first", WALK + "SELECT trace_id, span_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY path) AS BIGINT) AS number FROM w")
def _(t: Lens) -> DataFrame:
    return trees.walked(t.spark, t.spans(), numbers=True).select("trace_id", "span_id", "number")


@query("m01_llm_calls", "SELECT t.trace_id, CASE WHEN count(s.span_id) = 0 THEN 'SKIPPED' ELSE 'COMPLETED' END AS status, CAST(nullif(count(s.span_id), 0) AS DOUBLE) AS score FROM (SELECT DISTINCT trace_id FROM short) t LEFT JOIN short s ON s.trace_id = t.trace_id AND s.span_type = 'llm' GROUP BY t.trace_id", "span short")
def _(t: Lens) -> DataFrame:
    spans = t.short_traces()
    plan = planner.plan(spans, spans, planner.targets(t.spark, [metrics.built_in().get("llm_calls")]))
    return metrics.compute(plan.withColumn("n_spans", F.size("span_ids")), [metrics.built_in().get("llm_calls")]).select("trace_id", "status", "score")


@query("m02_response_length", "SELECT conv_id, CASE WHEN answer IS NULL THEN 'SKIPPED' ELSE 'COMPLETED' END AS status, CAST(length(answer) AS DOUBLE) AS score FROM conv", "conv")
def _(t: Lens) -> DataFrame:
    m = metrics.built_in().get("response_length")
    return t.conversations().select("conv_id", *metrics.result(m.skip(), m.fail(), m.score())).drop("error_message")


@query("m03_plan_efficiency", "SELECT conv_id, round(CASE WHEN conv_id % 7 = 0 THEN 0 ELSE least(1.0, len(list_filter(expected, lambda x: x = 'assistant')) / len(executed)) END, 6) AS score, CASE WHEN conv_id % 11 = 0 THEN 'SKIPPED' ELSE 'COMPLETED' END AS status FROM conv WHERE conv_id % 11 <> 0 UNION ALL SELECT conv_id, NULL, 'SKIPPED' FROM conv WHERE conv_id % 11 = 0", "conv")
def _(t: Lens) -> DataFrame:
    m = metrics.built_in().get("plan_efficiency")
    c = t.conversations().select("conv_id", F.filter("expected", lambda x: x == "assistant").alias("expected_plan"), F.when(F.col("conv_id") % 11 == 0, F.lit(None)).when(F.col("conv_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.col("executed")).alias("executed_steps"))
    return c.select("conv_id", *metrics.result(m.skip(), m.fail(), m.score())).select("conv_id", F.round("score", 6).alias("score"), "status")


def searched(t: Lens) -> DataFrame:
    """One row for each dense query: of the ten nearest, best first, whether each is of its label, and the number of
    candidates of the label; every fourth query found nothing, every third has nothing relevant."""
    from tracemill.operators import retrieval

    q, c = t.dense()
    top = retrieval.dense_top(q, c, 10, own=False)
    found = top.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", (F.col("label") == F.col("q_label")).alias("hit")))), lambda x: x["hit"]).alias("flags"))
    relevant = c.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("relevant"))  # but for the query itself
    rows = q.select(F.col("vec_id").alias("query_id"), "label").join(relevant, "label", "left").join(found, "query_id", "left")
    none = F.col("query_id") % 3 == 0
    flags = F.when(F.col("query_id") % 4 == 0, F.filter("flags", lambda x: F.lit(False))).otherwise(F.transform("flags", lambda x: x & ~none))
    rows = rows.select("query_id", flags.alias("flags"), F.when(none, 0).otherwise(F.coalesce("relevant", F.lit(0))).alias("relevant"))
    return rows.withColumns({"predicted": F.size("flags"), "matched": F.size(F.filter("flags", lambda x: x))})


HITS = """hits AS (SELECT q.query_id, CASE WHEN q.query_id % 3 = 0 THEN 0 ELSE (SELECT count(*) FROM cv WHERE cv.label = q.label AND cv.vec_id <> q.query_id) END AS relevant,
 CASE WHEN q.query_id % 4 = 0 THEN 0 ELSE 10 END AS predicted,
 CASE WHEN q.query_id % 3 = 0 OR q.query_id % 4 = 0 THEN 0 ELSE (SELECT count(*) FROM dense d WHERE d.query_id = q.query_id AND rk <= 10 AND d.label = q.label) END AS matched FROM qv q)"""


@query("m04_set_precision", f", {HITS} SELECT query_id, CASE WHEN predicted = 0 AND relevant > 0 THEN 'Nothing selected, so precision is undefined.' END AS skip_reason, round(CASE WHEN predicted = 0 AND relevant = 0 THEN 1.0 WHEN predicted > 0 THEN matched / predicted END, 6) AS score FROM hits", "cand")
def _(t: Lens) -> DataFrame:
    skip, score = metrics.precision_of_counts(F.col("matched"), F.col("predicted"), F.col("relevant"))
    return searched(t).select("query_id", skip.alias("skip_reason"), F.round(score, 6).alias("score"))


@query("m06_set_recall", f", {HITS} SELECT query_id, CASE WHEN relevant = 0 THEN 'No relevant IDs, so recall is undefined.' END AS skip_reason, round(CASE WHEN relevant > 0 THEN matched / relevant END, 6) AS score FROM hits", "cand")
def _(t: Lens) -> DataFrame:
    skip, score = metrics.recall_of_counts(F.col("matched"), F.col("relevant"))
    return searched(t).select("query_id", skip.alias("skip_reason"), F.round(score, 6).alias("score"))


@query("m08_ndcg", ", r AS (SELECT q.query_id, (SELECT count(*) FROM cv WHERE cv.label = q.label AND cv.vec_id <> q.query_id) AS relevant, (SELECT sum(1 / log2(rk + 1)) FROM dense d WHERE d.query_id = q.query_id AND rk <= 10 AND d.label = q.label) AS gain FROM qv q WHERE q.query_id % 3 <> 0 AND q.query_id % 4 <> 0) SELECT query_id, round(coalesce(gain, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) g(i) WHERE i <= least(relevant, 10)), 6) AS score FROM r", "cand")
def _(t: Lens) -> DataFrame:
    rows = searched(t).where("predicted > 0 and relevant > 0")
    return rows.select("query_id", F.round(scores.ndcg_of_flags(F.col("flags"), F.col("relevant")), 6).alias("score"))


@query("h02_confusion", f", {HITS} SELECT query_id, CAST(matched AS BIGINT) AS tp, CAST(predicted - matched AS BIGINT) AS fp, CAST(relevant - matched AS BIGINT) AS fn FROM hits", "cand")
def _(t: Lens) -> DataFrame:
    n = lambda c: c.cast("long")
    return searched(t).select("query_id", n(F.col("matched")).alias("tp"), n(F.col("predicted") - F.col("matched")).alias("fp"), n(F.col("relevant") - F.col("matched")).alias("fn"))


@query("f03_precision_at_k", ", r AS (SELECT query_id, rk, CASE WHEN label = q_label THEN 1 ELSE 0 END AS rel, sum(CASE WHEN label = q_label THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rk) AS hits FROM dense WHERE rk <= 10) SELECT query_id, CAST(rk AS BIGINT) AS rank, CAST(hits AS BIGINT) AS hits, round(hits / rk, 6) AS precision FROM r", "cand")
def _(t: Lens) -> DataFrame:
    from tracemill.operators import retrieval

    q, c = t.dense()
    w = Window.partitionBy("query_id").orderBy("rank")
    top = retrieval.dense_top(q, c, 10, own=False)
    hits = F.sum(F.when(F.col("label") == F.col("q_label"), 1).otherwise(0)).over(w)
    return top.select("query_id", F.col("rank").cast("long").alias("rank"), hits.alias("hits"), F.round(hits / F.col("rank"), 6).alias("precision"))


@query("m12_contextual_precision", ", r AS (SELECT query_id, rk, label = q_label AS rel, sum(CASE WHEN label = q_label THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rk) AS hits FROM dense WHERE rk <= 10) SELECT query_id, round(coalesce(avg(hits / rk) FILTER (WHERE rel), 0), 6) AS score FROM r GROUP BY query_id", "cand")
def _(t: Lens) -> DataFrame:
    from tracemill.operators import retrieval

    q, c = t.dense()
    verdicts = retrieval.dense_top(q, c, 10, own=False).select(F.col("query_id").alias("unit_id"), F.col("rank").alias("item_pos"), (F.col("label") == F.col("q_label")).alias("relevant"))
    return report.judged_precision(verdicts).select(F.col("unit_id").alias("query_id"), F.round("score", 6).alias("score"))


@query("m14_contextual_recall", """WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS claim FROM documents)
SELECT doc_id, count(*) AS claims, CAST(count(*) FILTER (WHERE doc_id % 5 <> 0 AND length(claim) % 3 > 0) AS BIGINT) AS attributed, round(count(*) FILTER (WHERE doc_id % 5 <> 0 AND length(claim) % 3 > 0) / count(*), 6) AS score FROM c GROUP BY doc_id""")
def _(t: Lens) -> DataFrame:
    """A document's lines are its claims; a judge said of each whether it is attributable. Every fifth has no context."""
    claims = t.table("documents").select(F.col("doc_id").alias("unit_id"), F.posexplode(F.split("text", "\n", -1)).alias("claim_id", "claim"))
    verdicts = claims.select("unit_id", "claim_id", (F.length("claim") % 3 > 0).alias("attributable"))
    items = t.table("documents").select(F.col("doc_id").alias("unit_id"), F.when(F.col("doc_id") % 5 == 0, 0).otherwise(3).alias("items"))
    found = judged.claim_recall(claims, verdicts, items)
    return found.select(F.col("unit_id").alias("doc_id"), "claims", F.col("attributed").cast("long").alias("attributed"), F.round("score", 6).alias("score"))


@query("m22_alignment", "SELECT conv_id, array_to_string(list_sort(list_filter(range(1, len(executed) + 1), lambda i: i % 3 = 0 AND i <> 3)), ',') AS missing, CASE WHEN len(executed) > 0 THEN '99' ELSE '' END AS \"unknown\", CASE WHEN len(executed) >= 1 THEN '1' ELSE '' END AS repeated FROM conv", "conv")
def _(t: Lens) -> DataFrame:
    ranks = F.sequence(F.lit(1), F.size("executed"))
    given = F.concat(F.filter(ranks, lambda i: (i % 3 != 0) | (i == 3)), F.array(F.lit(99), F.lit(1)))
    found = metrics.alignment(ranks, given)
    return t.conversations().select("conv_id", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(k) for k, c in found.items()])


LETTERS = "array_to_string(list_transform({}, lambda x: CASE x WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' WHEN 'system' THEN 's' ELSE 't' END), '')"


@query("m25_plan_matching", f"SELECT conv_id, round(1 - levenshtein({LETTERS.format('executed')}, {LETTERS.format('expected')}) / greatest(len(executed), len(expected)), 6) AS score FROM conv", "conv")
def _(t: Lens) -> DataFrame:
    return t.conversations().select("conv_id", F.round(scores.sequence_match(F.col("executed"), F.col("expected")), 6).alias("score"))


@query("m27_failure_class", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN CASE WHEN value >= 50 THEN 'truncated' ELSE 'misaligned' END WHEN event_id % 5 = 1 THEN CASE WHEN value >= 50 THEN 'truncated' ELSE 'invalid_output' END WHEN event_id % 5 = 2 THEN 'context_overflow' WHEN event_id % 5 = 3 THEN 'timeout' END AS failure FROM events")
def _(t: Lens) -> DataFrame:
    k = F.col("event_id") % 5
    return t.table("events").select("event_id", metrics.failure_class(F.col("value"), F.lit(50.0), k == 0, k == 1, k == 2, k == 3).alias("failure"))


@query("m28_echo", "SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}_]+'), ' ') AS key FROM part")
def _(t: Lens) -> DataFrame:
    return t.table("part").select("p_partkey", text.echo_key(F.concat(F.lit("3. "), "p_name")).alias("key"))

