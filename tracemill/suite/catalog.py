"""Scans, joins, set operations and writes of the store (A, B, D, G, H)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators import catalog, store
from tracemill.plans.lens import Lens
from tracemill.suite import query


@query("a01_by_id", "SELECT * FROM run WHERE run_id = 1", "run")
def _(t: Lens) -> DataFrame:
    return catalog.by_id(t.runs(), "run_id", 1)


@query("a02_page", "SELECT run_id, start_us FROM run ORDER BY start_us DESC, run_id DESC LIMIT 20 OFFSET 40", "run")
def _(t: Lens) -> DataFrame:
    return catalog.page(t.runs(), ["start_us", "run_id"], 20, 40).select("run_id", "start_us")


@query("a03_exists", "SELECT s.s_suppkey AS agent_id, EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = s.s_suppkey * 20) AS found FROM supplier s")
def _(t: Lens) -> DataFrame:
    asked = t.table("supplier").select(F.col("s_suppkey").alias("agent_id"), (F.col("s_suppkey") * 20).alias("key"))
    return catalog.exists(asked, t.table("customer").select(F.col("c_custkey").alias("key")), "key").select("agent_id", "found")


@query("a08_pruned_scan", "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars FROM documents WHERE lang = 'en'")
def _(t: Lens) -> DataFrame:
    return t.table("documents").where("lang = 'en'").select("doc_id", F.length("text").cast("long").alias("chars"))


@query("a10_latest_record", "SELECT run_id, max_by(metric, (us, l_partkey, l_suppkey, l_linenumber)) AS metric, max(us) AS us FROM comp GROUP BY run_id", "comp")
def _(t: Lens) -> DataFrame:
    return catalog.latest(t.computations(), ["run_id"], ["us", "l_partkey", "l_suppkey", "l_linenumber"], ["metric"]).select("run_id", "metric", "us")


@query("a12_digest", "SELECT page_id, sha256(html) AS sha256, CAST(octet_length(encode(html)) AS BIGINT) AS bytes FROM pages")
def _(t: Lens) -> DataFrame:
    return t.table("pages").select("page_id", *catalog.digest(F.col("html")))


@query("a13_usage_spans", "SELECT span_id, trace_id FROM span WHERE trace_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) AND (input_tokens IS NOT NULL OR span_type = 'llm')", "span")
def _(t: Lens) -> DataFrame:
    mine = t.table("customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("trace_id"))
    return catalog.usage_spans(t.spans(), mine).select("span_id", "trace_id")


@query("a14_spans_of_trace", "SELECT span_id, CAST(row_number() OVER (ORDER BY start_us, span_id) AS BIGINT) AS n FROM span WHERE trace_id = 7", "span")
def _(t: Lens) -> DataFrame:
    one = t.spans().where("trace_id = 7")
    return one.select("span_id", F.row_number().over(Window.partitionBy("trace_id").orderBy("start_us", "span_id")).cast("long").alias("n"))


@query("a15_spans_by_type", "SELECT span_type, count(*) AS n, CAST(min(start_us) AS BIGINT) AS first_us FROM span GROUP BY span_type", "span")
def _(t: Lens) -> DataFrame:
    return t.spans().groupBy("span_type").agg(F.count(F.lit(1)).alias("n"), F.min("start_us").alias("first_us"))


@query("a16_roots", "SELECT trace_id, span_id FROM span WHERE parent_id IS NULL", "span")
def _(t: Lens) -> DataFrame:
    return t.spans().where("parent_id is null").select("trace_id", "span_id")


@query("a17_children", "SELECT p.span_id, count(c.span_id) AS children FROM span p LEFT JOIN span c ON c.parent_id = p.span_id GROUP BY p.span_id", "span")
def _(t: Lens) -> DataFrame:
    spans = t.spans()
    kids = spans.where("parent_id is not null").groupBy(F.col("parent_id").alias("p")).agg(F.count(F.lit(1)).alias("k"))
    return spans.select("span_id").join(kids, F.col("span_id") == F.col("p"), "left").select("span_id", F.coalesce("k", F.lit(0)).alias("children"))


@query("a18_by_ordered_ids", "SELECT o.pos, c_name AS name FROM (SELECT unnest([30, 10, 20, 999999999]) AS id, generate_subscripts([30, 10, 20, 999999999], 1) AS pos) o JOIN customer ON c_custkey = o.id")
def _(t: Lens) -> DataFrame:
    return catalog.by_ids(t.table("customer"), "c_custkey", [30, 10, 20, 999999999]).select((F.col("pos") + 1).cast("long").alias("pos"), F.col("c_name").alias("name"))


@query("a20_runs_by_status", "SELECT dataset_id, status, count(*) AS n, max(start_us) AS last_us FROM run GROUP BY ALL", "run")
def _(t: Lens) -> DataFrame:
    return t.runs().groupBy("dataset_id", "status").agg(F.count(F.lit(1)).alias("n"), F.max("start_us").alias("last_us"))


@query("a22_finished_runs", "SELECT run_id, status FROM run WHERE status <> 'RUNNING'", "run")
def _(t: Lens) -> DataFrame:
    return t.runs().where("status <> 'RUNNING'").select("run_id", "status")


@query("a24_distinct_agents", "SELECT DISTINCT c_mktsegment AS name FROM customer")
def _(t: Lens) -> DataFrame:
    return t.table("customer").select(F.col("c_mktsegment").alias("name")).distinct()


@query("b03_upsert", "SELECT coalesce(n.p_partkey, o.p_partkey) AS id, coalesce(n.p_name, o.p_name) AS description, coalesce(n.p_size, o.p_size) AS size FROM (SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 3 <> 0) o FULL JOIN (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) END AS p_name, p_size + 1 AS p_size FROM part WHERE p_partkey % 5 = 0) n ON o.p_partkey = n.p_partkey")
def _(t: Lens) -> DataFrame:
    part = t.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("description"), F.col("p_size").alias("size"))
    new = part.where("id % 5 = 0").select("id", F.when(F.col("id") % 2 == 0, F.upper("description")).alias("description"), (F.col("size") + 1).alias("size"))
    return store.upserted(part.where("id % 3 <> 0"), new, ["id"])


@query("b05_delete", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT ps FROM (SELECT p_partkey * 2 AS ps FROM part))")
def _(t: Lens) -> DataFrame:
    part = t.table("part").select("p_partkey")
    return store.deleted(part, part.select((F.col("p_partkey") * 2).alias("p_partkey")), ["p_partkey"])


@query("b06_get_or_create", "SELECT DISTINCT sha256(c_mktsegment || chr(0) || CAST(c_nationkey AS VARCHAR)) AS agent_id, c_mktsegment AS name, CAST(c_nationkey AS VARCHAR) AS version_tag FROM customer WHERE c_nationkey > 3")
def _(t: Lens) -> DataFrame:
    c = t.table("customer").select(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").cast("string").alias("version_tag"))
    old = store.with_id(c.where("version_tag = '3'"), "agent_id", ["name", "version_tag"])
    new = store.with_id(c.where("cast(version_tag as int) >= 3"), "agent_id", ["name", "version_tag"])
    return store.missing(new, old, ["agent_id"])


@query("b07_insert_ignore", "SELECT DISTINCT run_id, metric FROM comp WHERE run_id NOT IN (SELECT run_id FROM run WHERE status = 'RUNNING')", "comp,run".replace(",", " "))
def _(t: Lens) -> DataFrame:
    there = t.runs().where("status = 'RUNNING'").select("run_id")
    return store.missing(t.computations().select("run_id", "metric"), there, ["run_id"])


@query("b08_status_if_current", "SELECT run_id, CASE WHEN status IN ('RUNNING', 'PARTIALLY_COMPLETED') AND agent_id % 2 = 0 THEN 'FAILED' ELSE status END AS status FROM run", "run")
def _(t: Lens) -> DataFrame:
    return store.status_if_current(t.runs(), F.col("agent_id") % 2 == 0, ["RUNNING", "PARTIALLY_COMPLETED"], "FAILED").select("run_id", "status")


@query("b10_merge_metadata", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"a":' || k || ',"n":null,"o":{"x":[1,2.5,"y"]},"t":true}'
 WHEN 1 THEN '{"a":"' || k || '","b":[],"n":null,"o":{"z":' || k || '},"t":true}' WHEN 2 THEN '{"a":"' || k || '","b":[],"o":{"z":' || k || '}}' ELSE '{}' END AS metadata
 FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) q""")
def _(t: Lens) -> DataFrame:
    """Numbers, lists, objects, nulls and text keep their types; whole JSON texts are compared."""
    k, c = F.get_json_object("props", "$.k"), F.col("event_id") % 4
    old = F.when(c < 2, F.concat(F.lit('{"t": true, "o": {"x": [1, 2.5, "y"]}, "n": null, "a": '), k, F.lit("}")))
    new = F.when(c.isin(1, 2), F.concat(F.lit('{"o": {"z": '), k, F.lit('}, "b": [], "a": "'), k, F.lit('"}')))
    return t.table("events").select("event_id", store.merged_json(old, new).alias("metadata"))


@query("b11_fail_running", "SELECT run_id, CASE WHEN status = 'RUNNING' THEN 'FAILED' ELSE status END AS status, CASE WHEN status = 'RUNNING' THEN 1 ELSE 0 END AS end_time FROM run", "run")
def _(t: Lens) -> DataFrame:
    return store.fail_running(t.runs().withColumn("end_time", F.lit(0)), F.lit(1)).select("run_id", "status", "end_time")


@query("b12_targeting_faults", "SELECT metric, CAST(count(*) FILTER (WHERE l_linenumber = 1 AND status <> 'SKIPPED') AS BIGINT) AS empty_not_skipped, CAST(count(*) FILTER (WHERE l_linenumber > 2) AS BIGINT) AS not_single FROM comp GROUP BY metric", "comp")
def _(t: Lens) -> DataFrame:
    spans = F.when(F.col("l_linenumber") == 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.col("l_linenumber") - 1, F.lit(1))))
    fault = store.targeting_fault(spans, F.lit("SINGLE"), F.col("status"))
    return t.computations().withColumn("fault", fault).groupBy("metric").agg(F.count_if(F.col("fault") == "empty").alias("empty_not_skipped"), F.count_if(F.col("fault") == "not_single").alias("not_single"))


@query("b13_idempotent_traces", "SELECT trace_id, CASE WHEN trace_id % 3 = 0 THEN 'conflict' WHEN trace_id % 3 = 1 THEN 'unchanged' ELSE 'new' END AS outcome FROM (SELECT DISTINCT trace_id FROM span) q", "span")
def _(t: Lens) -> DataFrame:
    spans = t.spans().select("trace_id", "span_id", "parent_id", "start_us")
    old = spans.where("trace_id % 3 <> 2").withColumn("start_us", F.when(F.col("trace_id") % 3 == 0, F.col("start_us") + 1).otherwise(F.col("start_us")))
    return store.persist_outcome(spans, old, "trace_id").select("trace_id", "outcome")


@query("d01_run_computations", "SELECT r.dataset_id, c.metric, count(*) AS n FROM comp c JOIN run r USING (run_id) WHERE r.status = 'COMPLETED' GROUP BY ALL", "comp run")
def _(t: Lens) -> DataFrame:
    runs = t.runs().where("status = 'COMPLETED'").select("run_id", "dataset_id")
    return t.computations().select("run_id", "metric").join(runs, "run_id").groupBy("dataset_id", "metric").agg(F.count(F.lit(1)).alias("n"))


@query("d02_membership", "SELECT trace_id, string_agg(CAST(span_id AS VARCHAR), ',' ORDER BY start_us, span_id) AS span_ids FROM span WHERE span_type = 'llm' GROUP BY trace_id", "span")
def _(t: Lens) -> DataFrame:
    return t.spans().where("span_type = 'llm'").groupBy("trace_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_us", "span_id"))), lambda x: x["span_id"].cast("string")), ",").alias("span_ids"))


@query("d03_dataset_counts", "SELECT r.dataset_id, r.status, count(s.sample_id) AS samples, count(DISTINCT r.run_id) AS runs FROM run r LEFT JOIN rs s USING (run_id) GROUP BY ALL", "run rs")
def _(t: Lens) -> DataFrame:
    per = t.run_samples().groupBy("run_id").agg(F.count(F.lit(1)).alias("k"))
    return t.runs().join(per, "run_id", "left").groupBy("dataset_id", "status").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("samples"), F.count(F.lit(1)).alias("runs"))


@query("d04_semi_usage", "SELECT span_id FROM span s WHERE EXISTS (SELECT 1 FROM rs WHERE rs.run_id = s.trace_id) AND span_type = 'llm'", "span rs")
def _(t: Lens) -> DataFrame:
    spans = t.spans().where("span_type = 'llm'")
    return spans.join(t.run_samples().select(F.col("run_id").alias("trace_id")), "trace_id", "left_semi").select("span_id")


@query("d05_computations_of_spans", "SELECT run_id, sample_id, metric, count(*) AS n FROM comp c WHERE EXISTS (SELECT 1 FROM comp d WHERE d.run_id = c.run_id AND d.sample_id = c.sample_id AND d.l_suppkey <= 10) GROUP BY ALL", "comp")
def _(t: Lens) -> DataFrame:
    c = t.computations().select("run_id", "sample_id", "metric", "l_suppkey")
    return c.join(c.where("l_suppkey <= 10").select("run_id", "sample_id"), ["run_id", "sample_id"], "left_semi").groupBy("run_id", "sample_id", "metric").agg(F.count(F.lit(1)).alias("n"))


@query("d08_import_match", "SELECT a.doc_id, count(b.doc_id) AS matches FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS p FROM documents WHERE doc_id % 2 = 0) a LEFT JOIN (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS p FROM documents WHERE doc_id % 2 = 1) b USING (p) GROUP BY a.doc_id")
def _(t: Lens) -> DataFrame:
    docs = t.table("documents").select("doc_id", "text")
    return catalog.prompt_matches(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "doc_id", "text")


@query("d09_missing_traces", "SELECT run_id, 'FAILED' AS status FROM run WHERE run_id NOT IN (SELECT run_id FROM rs)", "run rs")
def _(t: Lens) -> DataFrame:
    return store.missing(t.runs().select("run_id"), t.run_samples().select("run_id"), ["run_id"]).withColumn("status", F.lit("FAILED"))


@query("d15_missing_parents", "SELECT s.span_id, s.parent_id FROM span s WHERE s.parent_id IS NOT NULL AND s.parent_id NOT IN (SELECT span_id FROM span WHERE span_type <> 'tool')", "span")
def _(t: Lens) -> DataFrame:
    spans = t.spans()
    there = spans.where("span_type <> 'tool'").select(F.col("span_id").alias("parent_id"))
    return spans.where("parent_id is not null").join(there, "parent_id", "left_anti").select("span_id", "parent_id")


@query("d17_expand_renamed", "SELECT b.item_id, coalesce(d.doc_id, -1) AS doc_id FROM benchmark b LEFT JOIN documents d ON d.doc_id // 10 = b.item_id")
def _(t: Lens) -> DataFrame:
    docs = t.table("documents").select("doc_id", F.floor(F.col("doc_id") / 10).alias("raw"))
    return catalog.expand_ids(t.table("benchmark").select("item_id"), "item_id", docs, "raw", "doc_id")


@query("d18_missing_gold", "SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM gold)", "gold")
def _(t: Lens) -> DataFrame:
    return store.missing(t.table("benchmark").select("item_id"), t.gold().select("item_id"), ["item_id"])


@query("d19_dataset_difference", "SELECT 'missing' AS side, n_nationkey AS id FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT 'extra', n_nationkey + 100 FROM nation WHERE n_nationkey % 4 = 0")
def _(t: Lens) -> DataFrame:
    n = t.table("nation").select(F.col("n_nationkey").alias("id"))
    stored = n.select(F.when(F.col("id") % 4 == 0, F.col("id") + 100).otherwise(F.col("id")).alias("id"))
    return catalog.difference(n, stored)


@query("d20_supported", "SELECT c.conv_id, list_has_any(c.executed, ['assistant']) AS supported FROM conv c", "conv")
def _(t: Lens) -> DataFrame:
    return t.conversations().select("conv_id", F.arrays_overlap("executed", F.array(F.lit("assistant"))).alias("supported"))


@query("g01_page", "SELECT run_id, status FROM run WHERE status = 'COMPLETED' ORDER BY start_us DESC, run_id DESC LIMIT 50 OFFSET 100", "run")
def _(t: Lens) -> DataFrame:
    return catalog.page(t.runs().where("status = 'COMPLETED'"), ["start_us", "run_id"], 50, 100).select("run_id", "status")


@query("h01_union_memberships", "SELECT kind, count(*) AS n FROM (SELECT 'SINGLE' AS kind FROM span WHERE span_type = 'llm' UNION ALL SELECT 'GROUP' FROM span WHERE span_type = 'tool') q GROUP BY kind", "span")
def _(t: Lens) -> DataFrame:
    spans = t.spans()
    both = spans.where("span_type = 'llm'").select(F.lit("SINGLE").alias("kind")).union(spans.where("span_type = 'tool'").select(F.lit("GROUP").alias("kind")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("h03_all_metrics", "SELECT metric FROM comp UNION SELECT 'XX'", "comp")
def _(t: Lens) -> DataFrame:
    return t.computations().select("metric").union(t.spark.range(1).select(F.lit("XX").alias("metric"))).distinct()


@query("h04_stale_targets", "SELECT DISTINCT span_type FROM span WHERE span_type NOT IN ('llm', 'tool')", "span")
def _(t: Lens) -> DataFrame:
    wanted = t.spark.createDataFrame([("llm",), ("tool",)], "span_type string")
    return t.spans().select("span_type").distinct().exceptAll(wanted)


@query("h07_integrity", "SELECT 'duplicate_text' AS rule, CAST(count(*) AS BIGINT) AS n FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1) q UNION ALL SELECT 'empty_text', count(*) FROM documents WHERE regexp_matches(text, '^\\s*$') UNION ALL SELECT 'unlabelled', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'unknown_label', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def _(t: Lens) -> DataFrame:
    return catalog.integrity(t.table("documents").select("doc_id", "text"), t.table("labels").select("doc_id"))


@query("h08_unresolved", "SELECT run_id, sample_id FROM rs WHERE (run_id, sample_id) NOT IN (SELECT (run_id, sample_id) FROM comp WHERE status = 'COMPLETED')", "rs comp")
def _(t: Lens) -> DataFrame:
    done = t.computations().where("status = 'COMPLETED'").select("run_id", "sample_id")
    return store.missing(t.run_samples().select("run_id", "sample_id"), done, ["run_id", "sample_id"])
