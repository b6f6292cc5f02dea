"""Further reads, writes, judged metrics and tree operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import stats, text
from tracemill.operators import ablations, catalog, groups, judged, metrics, report, retrieval, store, trees
from tracemill.plans.lens import Lens
from tracemill.suite import query
from tracemill.suite.evaluation import WALK


@query("a07_trace_of_request", "SELECT props AS request_id, arg_min(trace_id, (start_us, trace_id)) AS trace_id FROM span WHERE parent_id IS NULL AND event_type NOT IN ('error') GROUP BY props", "span")
def _(t: Lens) -> DataFrame:
    from tracemill.sources.files import trace_of_request

    roots = t.spans().where("parent_id is null").select("trace_id", "parent_id", F.col("event_type").alias("name"), F.col("start_us").alias("start_time"), F.create_map(F.lit("request"), F.col("props")).alias("attributes"), "props")
    asked = roots.select(F.col("props").alias("request_id")).distinct().withColumns({"from_time": F.lit(0).cast("long"), "to_time": F.lit(1 << 62)})
    return trace_of_request(roots, "request", asked, [" Error "]).select("request_id", "trace_id")


@query("a11_alignment", "SELECT e.vec_id, d.doc_id IS NOT NULL AS aligned FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id * 3")
def _(t: Lens) -> DataFrame:
    asked = t.table("embeddings").select("vec_id", (F.col("vec_id") * 3).alias("doc_id"))
    return catalog.exists(asked, t.table("documents").select("doc_id"), "doc_id").select("vec_id", F.col("found").alias("aligned"))


@query("a19_truths_of_sample", "SELECT g.item_id, CAST(count(*) AS BIGINT) AS truths FROM gold g GROUP BY g.item_id", "gold")
def _(t: Lens) -> DataFrame:
    return t.gold().groupBy("item_id").agg(F.count(F.lit(1)).alias("truths"))


@query("a23_samples_of_run", "SELECT sample_id, status FROM rs WHERE run_id = 1", "rs")
def _(t: Lens) -> DataFrame:
    return t.run_samples().where("run_id = 1").select("sample_id", "status")


@query("a25_metrics_by_type", "SELECT l_returnflag || l_linestatus AS metric, l_shipmode AS span_type FROM (SELECT DISTINCT l_returnflag, l_linestatus, CASE WHEN l_linenumber % 2 = 0 THEN 'llm' ELSE 'tool' END AS l_shipmode FROM lineitem) q WHERE l_shipmode = 'llm'")
def _(t: Lens) -> DataFrame:
    c = t.computations().select("metric", F.when(F.col("l_linenumber") % 2 == 0, "llm").otherwise("tool").alias("span_type"))
    return c.where("span_type = 'llm'").distinct()


@query("b15_dataset_import", "SELECT conv_id AS sample_id, 'expected_output' AS key FROM conv WHERE answer IS NOT NULL AND regexp_replace(answer, '^\\s+|\\s+$', '', 'g') <> '' UNION ALL SELECT conv_id, 'expected_plan' FROM conv WHERE len(expected) > 0", "conv")
def _(t: Lens) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    samples = t.conversations().select(F.col("conv_id").alias("sample_id"), none.alias("document_ids"), none.alias("snippet_ids"), F.col("answer").alias("ground_truth_output"), F.col("expected").alias("plan"), none.alias("claims"))
    return report.ground_truths(samples).select("sample_id", "key")


@query("b16_registry_sync", "SELECT metric, 'add' AS change FROM (SELECT DISTINCT metric FROM comp) q WHERE metric LIKE 'A%' UNION ALL SELECT metric, 'remove' FROM (SELECT DISTINCT metric FROM comp) q WHERE metric LIKE 'R%'", "comp")
def _(t: Lens) -> DataFrame:
    names = t.computations().select("metric").distinct()
    wanted, there = names.where("metric not like 'R%'"), names.where("metric not like 'A%'")
    return store.missing(wanted, there, ["metric"]).withColumn("change", F.lit("add")).union(store.missing(there, wanted, ["metric"]).withColumn("change", F.lit("remove")))


def run_reports(runs: DataFrame, run_samples: DataFrame, computations: DataFrame) -> DataFrame:
    out = report.full_report(runs.select("run_id", "status"), run_samples, computations, ["AF"])
    read = out.select("run_id", F.from_json("report", "status string, samples struct<processed: long, succeeded: long>").alias("r"))
    return read.select("run_id", "r.status", "r.samples.processed", "r.samples.succeeded")


@query("b17_report", "SELECT r.run_id, r.status, count(s.run_id) AS processed, CAST(count(*) FILTER (WHERE s.status = 'COMPLETED') AS BIGINT) AS succeeded FROM run r LEFT JOIN rs s USING (run_id) GROUP BY ALL", "run rs")
def _(t: Lens) -> DataFrame:
    return run_reports(t.runs(), t.run_samples(), t.computations())


@query("c29_executed_steps", WALK + "SELECT trace_id, string_agg(CAST(span_id AS VARCHAR), ',' ORDER BY start_us, span_id) AS steps FROM w JOIN (SELECT span_id AS sid, start_us, span_type FROM span) s ON s.sid = w.span_id WHERE depth > 0 AND span_type = 'tool' GROUP BY trace_id")
def _(t: Lens) -> DataFrame:
    spans = t.spans()
    found = judged.executed_steps(trees.walked(t.spark, spans), spans)
    return found.select("trace_id", F.array_join(F.transform("steps", lambda s: s["span_id"].cast("string")), ",").alias("steps"))


@query("c30_retyped", WALK + "SELECT s.span_id, CASE WHEN s.span_type = 'llm' AND NOT coalesce(w.top % 2 = 0, false) THEN 'external_llm' WHEN s.span_type = 'llm' AND p.span_type = 'llm' THEN 'llm_internal' ELSE s.span_type END AS span_type FROM span s JOIN w ON w.span_id = s.span_id LEFT JOIN span p ON p.span_id = s.parent_id")
def _(t: Lens) -> DataFrame:
    spans = t.spans()
    return judged.retyped(trees.walked(t.spark, spans), spans, F.coalesce(F.col("top") % 2 == 0, F.lit(False))).drop("trace_id")


@query("d07_truth_keys", "SELECT m.metric, k.key, g.item_id FROM (VALUES ('recall', ['a', 'b']), ('plan', ['b', 'c'])) m(metric, ks), (SELECT unnest(['a', 'b', 'c']) AS key) k LEFT JOIN (SELECT item_id, CASE item_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS key FROM benchmark) g ON g.key = k.key WHERE list_contains(ks, k.key)")
def _(t: Lens) -> DataFrame:
    keys = t.spark.createDataFrame([("recall", ["a", "b"]), ("plan", ["b", "c"])], "metric string, ks array<string>").select("metric", F.explode("ks").alias("key"))
    truths = t.table("benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, "a").otherwise("b").alias("key"))
    return truths.join(F.broadcast(keys), "key", "right").select("metric", "key", "item_id")


@query("d10_untraced_samples", "SELECT o_orderkey AS sample_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(t: Lens) -> DataFrame:
    return store.missing(t.table("orders").select(F.col("o_orderkey").alias("sample_id")), t.table("lineitem").select(F.col("l_orderkey").alias("sample_id")), ["sample_id"])


@query("d11_usage_by_sample", "SELECT r.run_id, r.sample_id, CAST(coalesce(sum(s.input_tokens), -1) AS BIGINT) AS tokens FROM rs r LEFT JOIN span s ON s.trace_id = r.run_id AND s.span_type = 'llm' GROUP BY ALL", "span rs")
def _(t: Lens) -> DataFrame:
    per = t.spans().where("span_type = 'llm'").groupBy(F.col("trace_id").alias("run_id")).agg(F.sum("input_tokens").alias("k"))
    return t.run_samples().join(per, "run_id", "left").select("run_id", "sample_id", F.coalesce("k", F.lit(-1)).alias("tokens"))


@query("d12_judged_samples", "SELECT metric, count(*) AS n FROM comp c WHERE EXISTS (SELECT 1 FROM comp j WHERE j.run_id = c.run_id AND j.sample_id = c.sample_id AND j.metric = 'NO') GROUP BY metric", "comp")
def _(t: Lens) -> DataFrame:
    c = t.computations().select("run_id", "sample_id", "metric")
    return c.join(c.where("metric = 'NO'").select("run_id", "sample_id"), ["run_id", "sample_id"], "left_semi").groupBy("metric").agg(F.count(F.lit(1)).alias("n"))


@query("e02_percentiles", "SELECT o_orderpriority AS dataset_id, round(quantile_cont(o_totalprice, 0.1), 4) AS p10, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY 1")
def _(t: Lens) -> DataFrame:
    orders = t.table("orders").select(F.col("o_orderpriority").alias("dataset_id"), "o_totalprice")
    return stats.quantiles(orders, ["dataset_id"], "o_totalprice", {"p10": 0.1, "p90": 0.9}).select("dataset_id", F.round("p10", 4).alias("p10"), F.round("p90", 4).alias("p90"))


@query("f09_topological", WALK + "SELECT w.trace_id, w.span_id, CAST(row_number() OVER (PARTITION BY w.trace_id ORDER BY depth, start_us, w.span_id) AS BIGINT) AS number FROM w JOIN span s ON s.span_id = w.span_id")
def _(t: Lens) -> DataFrame:
    spans = t.spans()
    return judged.topological(trees.walked(t.spark, spans), spans)


@query("g05_target_order", "SELECT trace_id, string_agg(CAST(span_id AS VARCHAR), ',' ORDER BY start_us, span_id) AS targets FROM span WHERE span_type IN ('llm', 'tool') GROUP BY trace_id", "span")
def _(t: Lens) -> DataFrame:
    rows = t.spans().where("span_type in ('llm', 'tool')")
    return rows.groupBy("trace_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_us", "span_id"))), lambda x: x["span_id"].cast("string")), ",").alias("targets"))


@query("h05_usage_keys", "SELECT trace_id, count(DISTINCT coalesce(CASE WHEN rn % 2 = 0 THEN CAST(rn // 4 AS VARCHAR) END, 's' || span_id)) AS keys FROM span WHERE span_type = 'llm' GROUP BY trace_id", "span")
def _(t: Lens) -> DataFrame:
    key = F.coalesce(F.when(F.col("rn") % 2 == 0, F.floor(F.col("rn") / 4).cast("string")), F.concat(F.lit("s"), "span_id"))
    return t.spans().where("span_type = 'llm'").groupBy("trace_id").agg(F.count_distinct(key).alias("keys"))


@query("h06_sorted_ids", "SELECT label, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY CAST(vec_id AS VARCHAR)) AS ids FROM embeddings GROUP BY label")
def _(t: Lens) -> DataFrame:
    return t.table("embeddings").groupBy("label").agg(F.array_join(F.array_sort(F.collect_list(F.col("vec_id").cast("string"))), ",").alias("ids"))


@query("m10_answer_correctness", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'SKIPPED' WHEN quality + toxic > 1 THEN 'FAILED' ELSE 'COMPLETED' END AS status, CAST(CASE WHEN doc_id % 7 <> 0 AND quality + toxic <= 1 THEN quality + toxic END AS DOUBLE) AS score FROM labels")
def _(t: Lens) -> DataFrame:
    rows = t.table("labels").withColumns({"answer": F.when(F.col("doc_id") % 7 != 0, "x"), "verdict": (F.col("quality") + F.col("toxic")).cast("double")})
    fault, score = judged.bounded_score(F.col("verdict"), True)
    skip = F.when(F.col("answer").isNull(), "Trace does not provide an answer.")
    return rows.select("doc_id", *metrics.result(skip, fault, score)).drop("error_message")


@query("m11_plan_correctness", "SELECT event_id, CASE WHEN value <= 100 THEN 'COMPLETED' ELSE 'FAILED' END AS status, round(CASE WHEN value <= 100 THEN value / 100 END, 6) AS score FROM events")
def _(t: Lens) -> DataFrame:
    fault, score = judged.bounded_score(F.col("value") / 100, False)
    return t.table("events").select("event_id", *metrics.result(F.lit(None).cast("string"), fault, F.round(score, 6))).drop("error_message")


@query("m16_verifiable_claims", "SELECT conv_id, CAST(len(list_filter(executed, lambda x: x <> 'user')) AS BIGINT) AS claims FROM conv", "conv")
def _(t: Lens) -> DataFrame:
    claims = F.transform("executed", lambda x: F.struct(x.alias("text"), F.when(x == "user", "UnVerifiable").alias("kind")))
    return t.conversations().select("conv_id", F.size(judged.verifiable(claims)).cast("long").alias("claims"))


@query("m18_stored_claims", "SELECT run_id, count(*) AS claims, CAST(sum(CASE WHEN run_id % 5 <> 0 AND l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS attributed, round(sum(CASE WHEN run_id % 5 <> 0 AND l_discount > 0.05 THEN 1 ELSE 0 END) / count(*), 6) AS score FROM (SELECT l_orderkey AS run_id, l_partkey, l_suppkey, l_linenumber, max(l_discount) AS l_discount FROM lineitem GROUP BY ALL) q GROUP BY run_id")
def _(t: Lens) -> DataFrame:
    lines = t.table("lineitem").groupBy(F.col("l_orderkey").alias("unit_id"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber").alias("claim_id")).agg((F.max("l_discount") > 0.05).alias("attributable"))
    items = lines.select("unit_id").distinct().withColumn("items", F.when(F.col("unit_id") % 5 == 0, 0).otherwise(3))
    found = judged.claim_recall(lines.select("unit_id", "claim_id"), lines, items)
    return found.select(F.col("unit_id").alias("run_id"), "claims", "attributed", F.round("score", 6).alias("score"))


@query("m13_echo_mismatches", "SELECT query_id, CAST(count(*) FILTER (WHERE vec_id % 3 = 0) AS BIGINT) AS mismatches FROM dense WHERE rk <= 10 GROUP BY query_id", "cand")
def _(t: Lens) -> DataFrame:
    top = retrieval.dense_top(*t.dense(), 10, own=False).select(F.col("query_id").alias("unit_id"), F.col("rank").alias("item_pos"), F.col("vec_id").alias("retrieved_id"))
    said = top.withColumn("retrieved_id", F.when(F.col("retrieved_id") % 3 == 0, F.lit(-1)).otherwise(F.col("retrieved_id")))
    return judged.echo_mismatches(top, said).select(F.col("unit_id").alias("query_id"), "mismatches")


NUMBERED = WALK + ", n AS (SELECT w.*, row_number() OVER (PARTITION BY trace_id ORDER BY path) AS num FROM w), x AS (SELECT n.trace_id, n.path, n.num, p.num AS above, s.* EXCLUDE (trace_id) FROM n JOIN span s ON s.span_id = n.span_id LEFT JOIN n p ON p.span_id = s.parent_id), "


@query("m23_whole_trace", NUMBERED + """l AS (SELECT trace_id, path AS pos, '<span id="' || num || '"' || coalesce(' parent="' || above || '"', '') || ' type="' || span_type || '" name="' || event_type || '" status="' || status || '">' || chr(10) || CASE WHEN span_type = 'agent_root' THEN 'request:' || chr(10) || props ELSE 'input:' || chr(10) || props END AS line FROM x
UNION ALL SELECT trace_id, path || '.~', CASE WHEN span_type = 'agent_root' THEN 'answer:' || chr(10) || event_type || chr(10) ELSE '' END || '</span>' FROM x)
SELECT trace_id, CAST(count(*) // 2 AS BIGINT) AS spans, CAST(length(string_agg(line, chr(10) ORDER BY pos)) AS BIGINT) AS chars, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM l GROUP BY trace_id""")
def _(t: Lens) -> DataFrame:
    """Each trace's root with all below it as text; the root has a request and an answer, the others their input."""
    spans, root = t.spans(), F.col("span_type") == "agent_root"
    shown = spans.withColumns({"name": F.col("event_type"), "request": F.when(root, F.col("props")), "answer": F.when(root, F.col("event_type")), "input_data": F.col("props")})
    found = ablations.rendered(trees.walked(t.spark, spans, numbers=True), shown)
    return found.select("trace_id", F.col("rendered_spans").alias("spans"), F.col("rendered_chars").alias("chars"), F.md5(F.col("rendered").cast("binary")).alias("digest"))


def switches(batches: Iterator[pa.RecordBatch]) -> tuple[float | None, str | None]:
    """The share of a group's steps at which the event's type changes; a group of one span has no step."""
    before, steps, changes = None, -1, 0
    for batch in batches:
        for kind in batch.column(0).to_pylist():
            steps, changes, before = steps + 1, changes + (before is not None and kind != before), kind
    return (changes / steps, None) if steps > 0 else (None, "A group of one span has no step.")


@query("m29_group_code", """, o AS (SELECT trace_id, status, event_type <> lag(event_type) OVER w AS changed FROM (SELECT trace_id, CASE WHEN value < 50 THEN 'low' ELSE 'high' END AS status, event_type, start_us, span_id FROM span WHERE span_type <> 'agent_root') q WINDOW w AS (PARTITION BY trace_id, status ORDER BY start_us, span_id))
SELECT trace_id, status AS "group", count(*) AS n_spans, CASE WHEN count(*) > 1 THEN 'COMPLETED' ELSE 'FAILED' END AS status, round(CASE WHEN count(*) > 1 THEN count(*) FILTER (WHERE changed) / (count(*) - 1) END, 6) AS score FROM o GROUP BY trace_id, o.status
UNION ALL SELECT trace_id, NULL, 0, 'SKIPPED', NULL FROM span GROUP BY trace_id HAVING count(*) FILTER (WHERE span_type <> 'agent_root') = 0""", "span")
def _(t: Lens) -> DataFrame:
    """Two groups a trace, by the span's value; the score needs the spans in order."""
    spans = t.spans()
    metric = groups.GroupMetric("switches", ("retrieval", "tool", "llm", "chain"), ("event_type",), switches, group_spans=lambda: F.when(F.col("value") < 50, "low").otherwise("high"))
    found = groups.scored(spans, metric, spans)
    return found.select("trace_id", "group", "n_spans", "status", F.round("score", 6).alias("score"))


@query("m24_judged_once", "SELECT event_type, count(*) AS n, CAST(count(*) FILTER (WHERE hash LIKE '%a%') AS BIGINT) AS yes FROM (SELECT event_type, sha256(props) AS hash FROM events) q GROUP BY event_type")
def _(t: Lens) -> DataFrame:
    judge = lambda asked: asked.withColumn("relevant", F.col("request_hash").contains("a"))
    out = judged.judged_once(t.table("events").select("event_type", "props"), "props", judge)
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("relevant")).alias("yes"))


@query("r07_evidence", "SELECT q, i, CAST(row_number() OVER (PARTITION BY q ORDER BY us, i) AS BIGINT) AS position FROM (SELECT l_suppkey AS q, l_partkey % 100 AS i, min(epoch_us(l_shipdate)) AS us FROM lineitem GROUP BY ALL) z")
def _(t: Lens) -> DataFrame:
    rows = t.table("lineitem").select(F.col("l_suppkey").alias("q"), (F.col("l_partkey") % 100).alias("i"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("us"))
    return retrieval.first_evidence(rows, "q", ["i"], ["us", "i"]).withColumn("position", F.col("position").cast("long"))


@query("c12_sanitise", "SELECT doc_id, md5(text) AS digest FROM documents")
def _(t: Lens) -> DataFrame:
    dirty = F.concat(F.lit("\u0000"), F.col("text"), F.lit("\u0000"))
    return t.table("documents").select("doc_id", F.md5(text.sanitise(dirty).cast("binary")).alias("digest"))


@query("c35_json_type", "SELECT event_id, event_id % 3 = 0 AS is_object FROM events")
def _(t: Lens) -> DataFrame:
    k = F.col("event_id") % 3
    value = F.when(k == 0, '{"usage": {"a": 1}}').when(k == 1, '{"usage": [1]}').otherwise('{"usage": null}')
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(value), "$.usage", "variant"))
    return t.table("events").select("event_id", F.coalesce(kind.startswith("OBJECT"), F.lit(False)).alias("is_object"))


@query("f02_first_occurrence", "SELECT trace_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS BIGINT) AS first FROM (SELECT trace_id, row_number() OVER (PARTITION BY trace_id, event_type ORDER BY start_us, span_id) AS k FROM span) q GROUP BY trace_id", "span")
def _(t: Lens) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("trace_id", "event_type").orderBy("start_us", "span_id"))
    return t.spans().select("trace_id", k.alias("k")).groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") == 1).alias("first"))




@query("c11_iso_times", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts) - 7200000000 END AS us FROM events")
def _(t: Lens) -> DataFrame:
    """Times with Z, with an offset, of no day, and none."""
    from tracemill.sources.files import iso_time

    said, k = F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T")), F.col("event_id") % 4
    value = F.when(k == 0, F.concat(said, F.lit("Z"))).when(k == 1, F.concat(said, F.lit("+02:00"))).when(k == 2, F.lit("2026-02-31T00:00:00Z"))
    return t.table("events").select("event_id", F.unix_micros(iso_time(value)).alias("us"))


@query("c36_name_uuids", "SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM (SELECT p_partkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(p_name || '/' || p_partkey)) AS h FROM part) q")
def _(t: Lens) -> DataFrame:
    name = F.concat_ws("/", "p_name", F.col("p_partkey").cast("string"))
    return t.table("part").select("p_partkey", text.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", name).alias("id"))
