"""Canonical tables made from the given ones, and the same as SQL.

spans, run samples, computations and the like stand in for an agent store: events are spans, orders runs, lines their
samples and computations, embeddings and benchmark texts retrieval.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Short items that are sent to all executors together, about.
BLOCK = 10_000


class Lens:
    """The tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spans(self) -> DataFrame:
        """Events of a user are a trace; each span's parent is the span of half its number."""
        number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
        e = self.table("events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("start_us"), "event_type", "value", "props", number.cast("long").alias("rn"))
        e = e.withColumn("end_us", F.col("start_us") + F.floor(F.col("value") * 1000000).cast("long"))
        kind = F.when(F.col("rn") == 1, "agent_root").when(F.col("event_type") == "view", "retrieval").when(F.col("event_type") == "click", "tool").when(F.col("event_type") == "purchase", "llm").otherwise("chain")
        parents = e.select(F.col("user_id").alias("p_user"), F.col("rn").alias("p_rn"), F.col("event_id").alias("p_id"))
        out = e.join(parents, (e["user_id"] == F.col("p_user")) & (F.floor(e["rn"] / 2) == F.col("p_rn")), "left")
        return out.select(F.col("event_id").alias("span_id"), F.col("user_id").alias("trace_id"), F.col("p_id").alias("parent_id"), "rn", kind.alias("span_type"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"), "start_us", "end_us", "event_type", "value", "props", F.when(kind == "llm", F.get_json_object("props", "$.k").cast("long")).alias("input_tokens"))

    def short_traces(self) -> DataFrame:
        """Spans of a user's day as a trace of their own."""
        return self.spans().withColumn("trace_id", F.concat_ws("-", "trace_id", F.floor(F.col("start_us") / 86400000000).cast("string")))

    def runs(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "PARTIALLY_COMPLETED").otherwise("RUNNING")
        return self.table("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("agent_id"), F.col("o_orderpriority").alias("dataset_id"), status.alias("status"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("start_us"))

    def run_samples(self) -> DataFrame:
        lines = self.table("lineitem").select(F.col("l_orderkey").alias("run_id"), F.pmod("l_partkey", F.lit(5)).alias("sample_id"), (F.col("l_linestatus") == "F").alias("ok"), F.col("l_returnflag").alias("flag"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("us"))
        return lines.groupBy("run_id", "sample_id").agg(F.when(F.bool_or("ok"), "COMPLETED").otherwise("FAILED").alias("status"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.min("flag").alias("flag"))

    def computations(self) -> DataFrame:
        """Lines as metric computations: score from the discount, status from discount and tax, reasons from the flag."""
        status = F.when(F.col("l_discount") == 0, "SKIPPED").when(F.col("l_tax") > 0.07, "FAILED").otherwise("COMPLETED")
        return self.table("lineitem").select(F.col("l_orderkey").alias("run_id"), F.pmod("l_partkey", F.lit(5)).alias("sample_id"), F.concat("l_returnflag", "l_linestatus").alias("metric"), F.when(F.col("l_discount") > 0, F.col("l_discount") * 10).alias("score"), status.alias("status"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("error_message"), F.when(F.col("l_linestatus") == "O", F.lit(None)).otherwise("reason").alias("reasoning"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("us"), "l_linenumber", "l_suppkey", "l_partkey", F.col("l_quantity").cast("long").alias("tokens"))

    def gold(self) -> DataFrame:
        """(item_id, doc_id): documents that contain a benchmark item's text.

        An item's second to fourth pieces between spaces must stand in the document as they are; they are looked up
        among all runs of three pieces, an equi-join, and what is left is tested exactly. Items of fewer than five pieces
        are a stated query set: they go through the documents in blocks of ``BLOCK``.
        """
        split = lambda c: F.split(c, " ", -1)
        items = self.table("benchmark").select("item_id", F.col("text").alias("item"))
        docs = self.table("documents").select("doc_id", "text")
        heads = items.withColumn("w", split(F.col("item"))).where(F.size("w") >= 5).select("item_id", "item", F.array_join(F.slice("w", 2, 3), " ").alias("head"))
        w = split(F.col("text"))
        runs = docs.withColumn("w", w).where(F.size("w") >= 3).select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " "))).alias("head"))
        hits = runs.join(heads, "head").select("doc_id", "item_id", "item").distinct()
        long = docs.join(hits, "doc_id").where(F.contains("text", "item")).select("item_id", "doc_id")
        few = items.where(F.size(split(F.col("item"))) < 5)
        blocks = -(-few.count() // BLOCK)
        for i in range(blocks):
            some = F.broadcast(few.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i))
            long = long.union(docs.join(some, F.contains("text", "item")).select("item_id", "doc_id"))
        return long

    def dense(self, every: int = 25) -> tuple[DataFrame, DataFrame]:
        """(queries, candidates) of dense retrieval: the rows whose id is divisible by ``every``, and all rows."""
        e = self.table("embeddings").select("vec_id", "embedding", "label")
        return e.where(F.col("vec_id") % every == 0), e

    def conversations(self) -> DataFrame:
        """One row for each conversation: request, answer, roles in order."""
        c = self.table("conversations")
        turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
        out = c.groupBy("conv_id").agg(turns.alias("t"))
        users = F.filter("t", lambda x: x["role"] == "user")
        answers = F.filter("t", lambda x: x["role"] == "assistant")
        return out.select("conv_id", F.try_element_at(users, F.lit(1))["text"].alias("request"), F.try_element_at(answers, F.lit(-1))["text"].alias("answer"), F.transform("t", lambda x: x["role"]).alias("executed"), F.transform("t", lambda x: F.when(x["turn"] % 2 == 0, "user").otherwise("assistant")).alias("expected"))


#: The same tables as SQL.
SQL = {
    "span": """ev AS (SELECT event_id, user_id, epoch_us(ts) AS start_us, event_type, value, props, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS rn FROM events),
span AS (SELECT a.event_id AS span_id, a.user_id AS trace_id, p.event_id AS parent_id, a.rn, CASE WHEN a.rn = 1 THEN 'agent_root' WHEN a.event_type = 'view' THEN 'retrieval' WHEN a.event_type = 'click' THEN 'tool' WHEN a.event_type = 'purchase' THEN 'llm' ELSE 'chain' END AS span_type,
 CASE WHEN a.event_type = 'error' THEN 'error' ELSE 'success' END AS status, a.start_us, a.start_us + CAST(floor(a.value * 1000000) AS BIGINT) AS end_us, a.event_type, a.value, a.props,
 CASE WHEN a.rn > 1 AND a.event_type = 'purchase' THEN CAST(json_extract_string(a.props, '$.k') AS BIGINT) END AS input_tokens
 FROM ev a LEFT JOIN ev p ON p.user_id = a.user_id AND p.rn = a.rn // 2)""",
    "short": "short AS (SELECT span_id, trace_id || '-' || CAST(CAST(floor(start_us / 86400000000) AS BIGINT) AS VARCHAR) AS trace_id, parent_id, span_type, status, start_us, end_us, input_tokens FROM span)",
    "run": "run AS (SELECT o_orderkey AS run_id, o_custkey AS agent_id, o_orderpriority AS dataset_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'PARTIALLY_COMPLETED' ELSE 'RUNNING' END AS status, epoch_us(o_orderdate) AS start_us FROM orders)",
    "rs": "rs AS (SELECT l_orderkey AS run_id, l_partkey % 5 AS sample_id, CASE WHEN bool_or(l_linestatus = 'F') THEN 'COMPLETED' ELSE 'FAILED' END AS status, min(epoch_us(l_shipdate)) AS start_us, max(epoch_us(l_shipdate)) AS end_us, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2)",
    "comp": "comp AS (SELECT l_orderkey AS run_id, l_partkey % 5 AS sample_id, l_returnflag || l_linestatus AS metric, CASE WHEN l_discount > 0 THEN l_discount * 10 END AS score, CASE WHEN l_discount = 0 THEN 'SKIPPED' WHEN l_tax > 0.07 THEN 'FAILED' ELSE 'COMPLETED' END AS status, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS error_message, CASE WHEN l_linestatus = 'O' THEN NULL ELSE 'reason' END AS reasoning, epoch_us(l_shipdate) AS us, l_linenumber, l_suppkey, l_partkey, CAST(l_quantity AS BIGINT) AS tokens FROM lineitem)",
    "gold": "gold AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))",
    "conv": "conv AS (SELECT conv_id, first(text ORDER BY turn) FILTER (WHERE role = 'user') AS request, last(text ORDER BY turn) FILTER (WHERE role = 'assistant') AS answer, list(role ORDER BY turn) AS executed, list(CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END ORDER BY turn) AS expected FROM conversations GROUP BY conv_id)",
    "cand": "qv AS (SELECT vec_id AS query_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 25 = 0), cv AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), cand AS (SELECT q.query_id, q.label AS q_label, c.vec_id, c.label, round(list_cosine_similarity(q.v, c.v), 6) AS score FROM qv q JOIN cv c ON c.vec_id <> q.query_id), dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM cand)",
}


def with_tables(names: str, sql: str) -> str:
    """SQL with the lens's tables in front."""
    parts = [SQL[n] for n in names.split()]
    return "WITH " + ",\n".join(parts) + ("\n" + sql if not sql.lstrip().upper().startswith(",") else sql)
