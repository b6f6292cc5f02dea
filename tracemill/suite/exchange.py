"""Files, services, stores and adapters (A4-A6, A9, A26, B1-B4, B9, B14, B18-B22, C7, C11, C16, C17, C21, C27, C34, G6): what the
tables give is written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators import adapters, catalog, metrics, normalize, store
from tracemill.plans.lens import Lens
from tracemill.sources import files, sinks, traces
from tracemill.staging import folder
from tracemill.suite import query
from tracemill.suite.evaluation import RAW, records


@query("a04_dataset_json", "SELECT conv_id, md5(request) AS input_prompt, md5(answer) AS output, CASE WHEN conv_id % 3 = 0 THEN 0 WHEN conv_id % 3 = 1 THEN len(executed) END AS documents, len(expected) AS steps FROM conv", "conv")
def _(t: Lens) -> DataFrame:
    """Data set files with null, empty and full labels; a sample's first claim carries the conversation's number."""
    c, k = t.conversations(), F.col("conv_id")
    documents = F.when(k % 3 == 0, F.filter("executed", lambda x: F.lit(False))).when(k % 3 == 1, F.col("executed"))
    plan = F.transform("expected", lambda x: F.struct(x.alias("operation")))
    sample = F.struct(F.md5("request").alias("input_prompt"), F.md5("answer").alias("ground_truth_output"), documents.alias("document_ids"), plan.alias("plan"), F.array(F.struct(k.cast("string").alias("id"), F.lit("x").alias("text"))).alias("claims"))
    path = folder(t.spark, "datasets")
    c.select(F.to_json(F.struct(F.array(sample).alias("samples"))).alias("value")).write.text(path)
    read = files.dataset_json(t.spark, path, lines=True)
    return read.select(F.col("claims")[0]["id"].cast("long").alias("conv_id"), "input_prompt", F.col("ground_truth_output").alias("output"), F.when(F.col("document_ids").isNotNull(), F.size("document_ids")).cast("long").alias("documents"), F.size("plan").cast("long").alias("steps"))


def trace_lines(t: Lens) -> DataFrame:
    """Each trace's raw records as one line; every seventh trace has none."""
    r = records(t).withColumns({"at": F.col("context_span_id").cast("long")})
    span = F.struct(F.col("context_span_id").alias("context.span_id"), "parent_id", "name", "span_kind", "status_code", F.col("attributes")["input.value"].alias("attributes.input.value"))
    lines = r.groupBy("trace_id").agg(F.collect_list(span).alias("s"))
    spans = F.when(F.col("trace_id").cast("long") % 7 == 0, F.filter("s", lambda x: F.lit(False))).otherwise(F.col("s"))
    return lines.select(F.to_json(F.struct(F.concat(F.lit(" "), "trace_id").alias("trace_id"), spans.alias("spans"))).alias("value"))


@query("a05_trace_files", "SELECT CAST(trace_id AS VARCHAR) AS trace_id, CAST(span_id AS VARCHAR) AS span_id, props AS input, CAST(NULL AS VARCHAR) AS error FROM span WHERE trace_id % 7 <> 0 UNION ALL SELECT DISTINCT CAST(trace_id AS VARCHAR), NULL, NULL, 'no spans' FROM span WHERE trace_id % 7 = 0", "span")
def _(t: Lens) -> DataFrame:
    path = folder(t.spark, "traces")
    trace_lines(t).write.text(path)
    read = files.trace_files(t.spark, path, lines=True)
    return read.select("trace_id", F.col("context_span_id").alias("span_id"), F.try_element_at("attributes", F.lit("input.value")).alias("input"), "error")


def service_of(pages: int) -> object:
    """A service that has ``trace_id % pages`` spans of each trace, given out page by page."""

    def client(trace_id: str, first: int, after: str | None) -> dict | None:
        n, at = int(trace_id) % pages, int(after or 0)
        if not n:
            return None
        edges = [{"node": {"context": {"spanId": f"{trace_id}-{i}", "traceId": trace_id}, "parentId": f"{trace_id}-0" if i else None, "startTime": "2026-01-01T00:00:00Z" if i % 2 else "never", "attributes": {"llm": {"token_count": {"prompt": i}}}}} for i in range(at, min(n, at + first))]
        return {"spans": {"edges": edges, "pageInfo": {"hasNextPage": at + first < n, "endCursor": str(at + first)}}}

    return client


@query("a06_paged_service", "SELECT CAST(c_custkey AS VARCHAR) AS trace_id, count(*) AS spans, CAST(sum(i) AS BIGINT) AS tokens, CAST(count(*) FILTER (WHERE i % 2 = 1) AS BIGINT) AS timed, CAST(count(*) FILTER (WHERE i = 0) AS BIGINT) AS roots FROM (SELECT c_custkey, unnest(range(c_custkey % 120)) AS i FROM customer) q GROUP BY c_custkey")
def _(t: Lens) -> DataFrame:
    """Pages of 50, times that can't be read, nested attributes (C11)."""
    found = traces.from_service(t.table("customer").select(F.col("c_custkey").alias("trace_id")), service_of(120), 50)
    n = lambda c: F.count_if(c)
    return found.groupBy("trace_id").agg(F.count(F.lit(1)).alias("spans"), F.sum(F.get_json_object("record", "$['attributes.llm.token_count.prompt']").cast("long")).alias("tokens"), n(F.to_timestamp(F.get_json_object("record", "$.start_time")).isNotNull()).alias("timed"), n(F.col("parent_id").isNull()).alias("roots"))


@query("a09_json_lines", "SELECT p_partkey, p_name FROM part")
def _(t: Lens) -> DataFrame:
    """Blank lines between the records."""
    path = folder(t.spark, "lines")
    t.table("part").select(F.concat(F.to_json(F.struct("p_partkey", "p_name")), F.lit("\n\n")).alias("value")).write.text(path)
    return files.jsonl(t.spark, path, "p_partkey long, p_name string")


@query("a26_plan_snapshot", "SELECT run_id, string_agg(metric, ',' ORDER BY us, metric) AS metrics FROM (SELECT run_id, metric, min(us) AS us FROM comp GROUP BY ALL) q GROUP BY run_id", "comp")
def _(t: Lens) -> DataFrame:
    rows = t.computations().groupBy("run_id", "metric").agg(F.min("us").alias("created_at"))
    return catalog.snapshots(rows, "run_id", "metric", "created_at").select("run_id", F.array_join("keys", ",").alias("metrics"))


@query("b01_insert_update_delete", "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'new' ELSE p_name END AS name FROM part WHERE p_partkey % 3 <> 1 UNION ALL SELECT -1 - p_partkey, p_name FROM part WHERE (-1 - p_partkey) % 3 <> 1")
def _(t: Lens) -> DataFrame:
    part = t.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    there = store.inserted(part, part.select((-1 - F.col("id")).alias("id"), "name"), "id")
    there = store.updated(there, part.where("id % 5 = 0").withColumn("name", F.lit("new")), "id")
    return store.deleted(there, part.where("id % 3 = 1"), ["id"])


@query("b02_bulk_insert", "SELECT 'run' AS entity, count(*) AS n, CAST(2 AS BIGINT) AS versions FROM run UNION ALL SELECT 'sample', count(*), 2 FROM rs", "run rs")
def _(t: Lens) -> DataFrame:
    """Two tables in two transactions; each is seen as a whole."""
    s = store.Store(t.spark, folder(t.spark, "store"))
    odd = F.col("run_id") % 2 == 1
    s.append({"run": t.runs().where(odd), "sample": t.run_samples().where(odd)})
    s.append({"run": t.runs().where(~odd), "sample": t.run_samples().where(~odd)})
    version = max(map(len, s.manifest().values()))  # a folder for each append
    one = lambda name: s.table(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n", F.lit(version).cast("long").alias("versions"))
    return one("run").union(one("sample"))


@query("b04_upsert_span_types", "SELECT span_type, CASE WHEN span_type IN ('llm', 'tool') THEN 'known' ELSE span_type END AS description FROM (SELECT DISTINCT span_type FROM span) q", "span")
def _(t: Lens) -> DataFrame:
    """Descriptions of known types stay where the new one has none."""
    seen = t.spans().select("span_type").distinct()
    old = seen.where("span_type in ('llm', 'tool')").withColumn("description", F.lit("known"))
    new = seen.withColumn("description", F.when(~F.col("span_type").isin("llm", "tool"), F.col("span_type")))
    return store.upserted(old, new, ["span_type"])


@query("b09_status_update", "SELECT run_id, sample_id, CASE WHEN run_id % 2 = 0 THEN 'FAILED' ELSE status END AS status, CASE WHEN run_id % 6 = 0 THEN 0 ELSE end_us END AS end_us FROM rs", "rs")
def _(t: Lens) -> DataFrame:
    rows = t.run_samples().select(F.concat_ws("-", "run_id", "sample_id").alias("id"), "run_id", "sample_id", "status", "end_us")
    changes = rows.where("run_id % 2 = 0").select("id", F.lit("FAILED").alias("status"), F.when(F.col("run_id") % 3 == 0, F.lit(0).cast("long")).alias("end_us"))
    return store.status_updated(rows, changes, "id").drop("id")


@query("b18_trace_archive", "SELECT c_mktsegment AS run_id, 2 * count(*) AS n, CAST(sum(2 * c_custkey) AS BIGINT) AS total FROM customer GROUP BY 1")
def _(t: Lens) -> DataFrame:
    """Archived twice: an archive only grows."""
    path = folder(t.spark, "archive")
    raw = t.table("customer").select(F.col("c_mktsegment").alias("run_id"), "c_custkey", "c_name")
    for _ in range(2):
        sinks.archive_traces(raw, path)
    return sinks.archived_traces(t.spark, path, "c_custkey long, c_name string, run_id string").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("total"))


@query("b19_embedding_shards", "SELECT shard, count(*) AS n, CAST(sum(length(p_name)) AS BIGINT) AS total FROM (SELECT *, (row_number() OVER (ORDER BY p_partkey) - 1) // 256 AS shard FROM part) q GROUP BY shard")
def _(t: Lens) -> DataFrame:
    """Written once, and again without a shard to do."""
    path, docs = folder(t.spark, "shards"), t.table("part").select(F.col("p_partkey").alias("document_id"), F.col("p_name").alias("text"))
    embed = lambda df: df.withColumn("embedding", F.array(F.length("text").cast("float")))
    sinks.embed_shards(docs, path, embed, 256)
    if sinks.embed_shards(docs, path, embed, 256):
        raise ValueError("a shard was embedded twice")
    return t.spark.read.parquet(path).groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("embedding")[0].cast("long")).alias("total"))


@query("b20_vector_tables", "SELECT e.vec_id AS document_id, CAST(len(e.embedding) AS BIGINT) AS width, md5(d.text) AS text FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id")
def _(t: Lens) -> DataFrame:
    """Vectors of all documents that have one, loaded with the documents' terms; then those of even ids anew."""
    s = store.Store(t.spark, folder(t.spark, "vectors"))
    docs = t.table("documents").join(t.table("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").select(F.col("doc_id").alias("document_id"), "text", "embedding")
    for part in (docs, docs.where("document_id % 2 = 0")):
        sinks.load_vectors(s, part.select("document_id", "embedding"), part.select("document_id", "text"))
    return s.table("doc_vectors").join(docs.select("document_id", "text"), "document_id").select("document_id", F.size("embedding").cast("long").alias("width"), F.md5("text").alias("text"))


LOG_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderpriority AS step, CASE o_orderstatus WHEN 'F' THEN 'ended' ELSE 'started' END AS status,
  CASE WHEN o_orderstatus = 'F' THEN '{"n":' || o_custkey || '}' ELSE '{}' END AS details
FROM orders
"""


@query("b21_step_log", LOG_SQL)
def _(t: Lens) -> DataFrame:
    """Orders as runs: what is started first, then, as lines added to the same log, what has ended, with details."""
    path, orders, done = folder(t.spark, "log"), t.table("orders"), F.col("o_orderstatus") == "F"
    named = [F.col("o_orderpriority").alias("step"), F.array(F.col("o_orderkey").cast("string")).alias("run_ids")]
    sinks.append_records(orders.where(~done).select(*named, F.lit("started").alias("status"), F.lit(None).cast("string").alias("details")), path)
    sinks.append_records(orders.where(done).select(*named, F.lit("ended").alias("status"), F.to_json(F.struct(F.col("o_custkey").alias("n"))).alias("details")), path)
    return sinks.records(t.spark, path).select(F.col("run_ids")[0].alias("run_id"), "step", "status", "details")


@query("b22_markdown", "SELECT '| ' || dataset_id || ' | ' || CAST(n AS DOUBLE) || ' | ' || coalesce(CAST(CASE WHEN n % 2 = 0 THEN 0.5 END AS VARCHAR), '–') || ' |' AS line FROM (SELECT o_orderpriority AS dataset_id, count(*) AS n FROM orders GROUP BY 1) q UNION ALL SELECT '| dataset_id | n | half |' UNION ALL SELECT '|---|--:|--:|'")
def _(t: Lens) -> DataFrame:
    rows = t.runs().groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n")).withColumn("half", F.when(F.col("n") % 2 == 0, 0.5))
    path = folder(t.spark, "rows")
    sinks.write_rows(rows, path)
    back = t.spark.read.schema("dataset_id string, n long, half double").json(path)
    return t.spark.createDataFrame([(x,) for x in sinks.markdown(back, ["dataset_id"], ["n", "half"])], "line string")


@query("c07_usage", f", {RAW} SELECT CAST(span_id AS VARCHAR) AS call_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS input_tokens, CASE WHEN value > 50 THEN CAST(0.5 AS DOUBLE) END AS cost, CASE WHEN value > 50 THEN 'USD' END AS currency FROM rec WHERE span_type = 'llm'", "span")
def _(t: Lens) -> DataFrame:
    return normalize.canonical(records(t)).where("usage is not null").select("usage.call_id", "usage.input_tokens", "usage.cost", "usage.currency")


def results(t: Lens) -> DataFrame:
    """Four results for each span: of two kinds and stages, available or not."""
    one = lambda kind, stage, there, *ids: F.struct(F.lit(kind).alias("kind"), F.lit(stage).alias("stage"), F.when(there, "available").otherwise("unavailable").alias("availability"), F.lit(None).cast("string").alias("reason"), F.array(*ids).alias("ids"), F.transform(F.array(*ids), lambda i: F.concat(F.lit("text "), i)).alias("contents"), F.lit(True).alias("ranked"))
    rn, text = F.col("rn"), lambda c: c.cast("string")
    sets = F.array(one("document", "selected", rn % 2 == 0, text(rn), F.lit("x")), one("document", "selected", rn % 3 == 0, F.lit("x"), text(rn + 1)), one("document", "retrieved", F.lit(True), F.lit("r")), one("snippet", "selected", F.lit(True), F.lit("s")))
    return t.spans().select("span_id", "rn", sets.alias("retrieval"))


@query("c16_selection", "SELECT span_id, CAST(2 AS BIGINT) AS sets, CAST((rn % 2 = 0)::INT + (rn % 3 = 0)::INT AS BIGINT) AS available FROM span", "span")
def _(t: Lens) -> DataFrame:
    found = metrics.selected(F.col("retrieval"), "document", "selected")
    return results(t).select("span_id", F.size(found).cast("long").alias("sets"), F.size(F.filter(found, lambda r: r["availability"] == "available")).cast("long").alias("available"))


@query("c17_items_and_ids", "SELECT span_id, concat_ws(',', CASE WHEN rn % 2 = 0 THEN rn || ',x' END, CASE WHEN rn % 3 = 0 THEN CASE WHEN rn % 2 = 0 THEN CAST(rn + 1 AS VARCHAR) ELSE 'x,' || (rn + 1) END END) AS ids, concat_ws(',', CASE WHEN rn % 2 = 0 THEN 'text ' || rn || ',text x' END, CASE WHEN rn % 3 = 0 THEN 'text x,text ' || (rn + 1) END) AS items FROM span", "span")
def _(t: Lens) -> DataFrame:
    """Ids are a set, items keep what comes twice."""
    from tracemill.operators.judged import contents

    return results(t).select("span_id", F.array_join(metrics.retrieved_ids(F.col("retrieval"), "document"), ",").alias("ids"), F.array_join(contents("document", "selected"), ",").alias("items"))


ROOT = adapters.ROOTS["smolagents"]


def agent_records(t: Lens, root: str, *more: tuple[str, Column]) -> DataFrame:
    """Spans as an agent's records: the root is named and asks, tools are searches that find two documents or fail."""
    s, k = t.spans(), F.col("span_id")
    is_root = F.col("parent_id").isNull()
    found = F.concat(F.lit('{"query": "q", "results": [{"id": "'), (k % 10).cast("string"), F.lit('", "title": "t", "text": "x"}]}'))
    output = F.when(is_root, F.lit(" done ")).when(F.col("span_type") == "tool", F.when(k % 3 == 0, F.lit("Search failed: x")).otherwise(found))
    entries = [F.lit("input.value"), F.when(is_root, F.concat(F.lit("question "), "trace_id")), F.lit("output.value"), output, F.lit("tool.name"), F.when(F.col("span_type") == "tool", F.lit(adapters.SEARCH_TOOL))]
    for name, value in more:
        entries += [F.lit(name), value]
    kind = F.when(is_root, "AGENT").when(F.col("span_type") == "tool", "TOOL").when(F.col("span_type") == "llm", "LLM").otherwise("CHAIN")
    return s.select(k.cast("string").alias("context_span_id"), F.col("trace_id").cast("string").alias("trace_id"), F.col("parent_id").cast("string").alias("parent_id"), F.when(is_root, F.when(F.col("trace_id") % 5 == 0, "other").otherwise(root)).otherwise(F.col("event_type")).alias("name"), kind.alias("span_kind"), F.lit("OK").alias("status_code"), F.lit(None).cast("string").alias("status_message"), F.timestamp_micros("start_us").alias("start_time"), F.timestamp_micros("end_us").alias("end_time"), F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull()).alias("attributes"))


@query("c27_code_agent", "SELECT CAST(trace_id AS VARCHAR) AS trace_id, 'question ' || trace_id AS request, 'done' AS answer, count(*) FILTER (WHERE span_type = 'tool' AND span_id % 3 <> 0) AS searches, count(*) FILTER (WHERE span_type = 'tool' AND span_id % 3 = 0) AS tools, count(DISTINCT CASE WHEN span_type = 'tool' AND span_id % 3 <> 0 THEN span_id % 10 END) AS evidence FROM span WHERE trace_id % 5 <> 0 GROUP BY trace_id", "span")
def _(t: Lens) -> DataFrame:
    made = adapters.code_agent(agent_records(t, ROOT)).spans
    root = F.col("span_type") == "agent_root"
    items = F.size(F.col("retrieval")[0]["items"])
    return made.groupBy("trace_id").agg(F.max(F.when(root, F.col("request"))).alias("request"), F.max("answer").alias("answer"), F.count_if(F.col("span_type") == "retrieval").alias("searches"), F.count_if(F.col("span_type") == "tool").alias("tools"), F.max(F.when(root, items)).cast("long").alias("evidence"))


@query("c27_refusals", "SELECT DISTINCT CAST(trace_id AS VARCHAR) AS trace_id, 'root' AS rule FROM span WHERE trace_id % 5 = 0 UNION ALL SELECT CAST(trace_id AS VARCHAR), 'other_model' FROM span WHERE span_type = 'llm' AND span_id % 4 = 0", "span")
def _(t: Lens) -> DataFrame:
    model = F.when(F.col("span_type") == "llm", F.when(F.col("span_id") % 4 == 0, "m-small").when(F.col("span_id") % 4 == 1, "m-2026-01-01").otherwise("m"))
    return adapters.research_agent(agent_records(t, adapters.ROOTS["odr"], ("llm.model_name", model)), "m").faults.select("trace_id", "rule")


@query("c27_simulation", """, k AS (SELECT trace_id, span_id, parent_id, rn, CASE WHEN rn = 2 THEN 'agent' WHEN parent_id IS NULL THEN 'root' WHEN span_type = 'retrieval' THEN 'chain' ELSE span_type END AS kind, start_us FROM span),
 w AS (SELECT k.*, CASE WHEN rn = 1 THEN NULL ELSE rn // CAST(pow(2, floor(log2(rn)) - 1) AS BIGINT) END AS top FROM k)
SELECT CAST(w.span_id AS VARCHAR) AS span_id, CASE WHEN w.rn = 1 THEN 'simulation' WHEN w.rn = 2 THEN 'agent_root' WHEN w.kind = 'llm' AND p.kind = 'llm' THEN 'llm_internal' WHEN w.kind = 'llm' AND w.top = 3 THEN 'external_llm' ELSE w.kind END AS span_type,
 CASE WHEN w.rn = 2 THEN (SELECT count(*) FROM w x WHERE x.trace_id = w.trace_id AND x.kind = 'tool' AND x.top = 2) END AS steps FROM w LEFT JOIN k p ON p.span_id = w.parent_id WHERE w.trace_id % 5 <> 0 AND w.trace_id IN (SELECT trace_id FROM span WHERE rn = 2)""", "span")
def _(t: Lens) -> DataFrame:
    """The second span of a trace, a child of the root, is the agent."""
    rn = t.spans().select(F.col("span_id").cast("string").alias("context_span_id"), "rn")
    made = agent_records(t, adapters.ROOTS["tau2"]).join(rn, "context_span_id")
    made = made.withColumn("span_kind", F.when(F.col("rn") == 2, "AGENT").when(F.col("rn") == 1, "CHAIN").otherwise(F.col("span_kind"))).drop("rn")
    spans = adapters.simulation(made).spans
    return spans.select(F.col("external_id").alias("span_id"), "span_type", F.when(F.col("executed_steps").isNotNull(), F.size("executed_steps")).cast("long").alias("steps"))


@query("c27_workflow", "SELECT CAST(span_id AS VARCHAR) || '-' || e AS span_id, CAST(span_id AS VARCHAR) AS parent_id, CASE e WHEN 'a' THEN 'llm' WHEN 'b' THEN 'retrieval' ELSE 'chain' END AS span_type, start_us + CASE e WHEN 'a' THEN 0 WHEN 'b' THEN 1500000 ELSE 2250000 END AS start_us, CASE WHEN e = 'a' THEN span_id % 7 END AS input_tokens FROM (SELECT *, unnest(['a', 'b', 'c']) AS e FROM span WHERE span_type = 'chain' AND parent_id IS NOT NULL) q", "span")
def _(t: Lens) -> DataFrame:
    """Chain spans are agent nodes whose logs hold a model call, a search and a thought, on a clock of their own."""
    node = (F.col("span_type") == "chain") & F.col("parent_id").isNotNull()
    root = F.col("parent_id").isNull()
    log = F.concat(F.lit('{"json": [{"id": "'), "span_id", F.lit('-a", "label": "call", "status": "success", "data": {"usage": {"prompt_tokens": '), F.col("span_id") % 7, F.lit('}}, "metadata": {"provider": "p", "started_at": 7.25, "finished_at": 8}}, {"id": "'), "span_id", F.lit('-b", "label": "search", "data": {"tool_name": "search_knowledge_base", "output": "tool response: {\\"query\\": \\"q\\", \\"results\\": []}"}, "metadata": {"started_at": 8.75, "finished_at": 9}}, {"id": "'), "span_id", F.lit('-c", "label": "thought", "data": {}, "metadata": {"started_at": 9.5, "finished_at": 9.75}}, {"id": "z", "label": "late"}]}'))
    s = t.spans()
    entries = {"dify_trace_id": F.when(root, F.lit("1")), "input.value": F.when(root, F.lit('{"sys.query": "why"}')), "output.value": F.when(root, F.lit('{"answer": "so"}')).when(node, log), "metadata.node_type": F.when(node, F.lit("agent"))}
    raw = s.select(F.col("span_id").cast("string").alias("context_span_id"), F.col("trace_id").cast("string").alias("trace_id"), F.col("parent_id").cast("string").alias("parent_id"), F.col("event_type").alias("name"), F.lit("CHAIN").alias("span_kind"), F.lit("OK").alias("status_code"), F.lit(None).cast("string").alias("status_message"), F.timestamp_micros("start_us").alias("start_time"), F.timestamp_micros("end_us").alias("end_time"), F.map_filter(F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull()).alias("attributes"))
    spans = adapters.workflow(raw).spans.where(F.contains("external_id", F.lit("-")))
    return spans.select(F.col("external_id").alias("span_id"), F.col("parent_span_id").alias("parent_id"), "span_type", F.unix_micros("start_time").alias("start_us"), "usage.input_tokens")


SELECTION_SQL = """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'llm_calls,set_recall_document' WHEN 1 THEN 'llm_calls,plan_matching' ELSE 'llm_calls' END AS metrics,
  lower(p_type) AS unknown
FROM part
"""


@query("c34_selection", SELECTION_SQL)
def _(t: Lens) -> DataFrame:
    """Lists of a request for each part: case, white space, repeats and empty names, and one name that is no metric."""
    k, built_in = F.col("p_partkey"), metrics.built_in()
    second = F.when(k % 3 == 0, "Set_Recall_Document").when(k % 3 == 1, "plan_matching").otherwise(" ")
    keys = built_in.keys_of(F.concat_ws(",", F.lit(" LLM_calls"), second, F.lit("llm_calls "), F.upper("p_type"), F.lit("")))
    asked = t.table("part").select("p_partkey", keys.alias("keys")).withColumn("found", built_in.known(F.col("keys")))
    return asked.select("p_partkey", F.array_join("found", ",").alias("metrics"), F.array_join(F.array_except("keys", "found"), ",").alias("unknown"))


@query("c21_answers_and_steps", "SELECT conv_id, md5(answer) AS answer, array_to_string(executed, ',') AS steps FROM conv WHERE answer IS NOT NULL AND regexp_matches(answer, '[^\\s]')", "conv")
def _(t: Lens) -> DataFrame:
    found = metrics.answered(t.conversations().withColumnRenamed("executed", "executed_steps"))
    return found.select("conv_id", F.md5("answer").alias("answer"), F.array_join("executed_steps", ",").alias("steps"))


@query("g06_configuration_order", "SELECT run_id, CAST(row_number() OVER (ORDER BY CASE dataset_id WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 2 END, status, run_id) AS BIGINT) AS position FROM run WHERE dataset_id IN ('5-LOW', '1-URGENT', '3-MEDIUM')", "run")
def _(t: Lens) -> DataFrame:
    """Runs in the order in which configurations are listed, then of arm and id; others are left out."""
    return catalog.in_listed_order(t.runs(), "dataset_id", ["5-LOW", "1-URGENT", "3-MEDIUM"], ["status", "run_id"]).select("run_id", "position")
