"""Work that must not be done twice, or by one task."""

from pyspark.sql import functions as F

from tracemill.functions import stats
from tracemill.operators import adapters, analysis, retrieval, trees
from tracemill.sources import sinks, traces


def counted(spark, df):
    """``df``, and how many of its rows have been made so far."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema), made


def test_keys_with_few_values_are_not_cut_into_ranges(spark, monkeypatch):
    """20 rows, but two of each key."""
    names, staged = [], stats.staged
    monkeypatch.setattr(stats, "FEW", 3)
    monkeypatch.setattr(stats, "staged", lambda df, name: names.append(name) or staged(df, name))
    rows = spark.createDataFrame([(k, v, v + 1) for k in range(10) for v in range(2)] + [(None, 5, 7)], "k long, v long, c long")
    found = stats.less_than(rows, ["k"], "v", "c")
    assert sorted((r["k"] or -1, r["v"], r["less"]) for r in found.where("k is null or k = 3").collect()) == [(-1, 5, 0), (3, 0, 0), (3, 1, 1)]
    assert names == ["counts"]


def test_quantiles_in_one_window_and_in_ranges(spark, monkeypatch):
    rows = spark.createDataFrame([(k, float(v)) for k in (1, 2, None) for v in range(k or 5)] + [(9, None)], "k long, v double")
    want = [(None, 2.0, 3.0), (1, 0.0, 0.0), (2, 0.5, 0.75)]
    for few in (1, 1 << 18):
        monkeypatch.setattr(stats, "FEW", few)
        found = stats.quantiles(rows, ["k"], "v", {"m": 0.5, "q": 0.75}).collect()
        assert sorted((tuple(r) for r in found), key=str) == sorted(want, key=str)


def test_records_of_one_append_are_ordered_by_many_tasks(spark, tmp_path):
    """all lines of an append have one time."""
    rows = spark.range(4000).repartitionByRange(4, "id").sortWithinPartitions("id")
    sinks.append_records(rows.select(F.lit("s").alias("step"), F.lit("ended").alias("status"), F.array(F.col("id").cast("string")).alias("run_ids"), F.lit(None).cast("string").alias("details")), f"{tmp_path}/log")
    sinks.append_record(spark, f"{tmp_path}/log", "s", "ended", ("last",))
    found = sinks.records(spark, f"{tmp_path}/log")
    assert [r["run_ids"][0] for r in found.collect()] == [*map(str, range(4000)), "last"]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(sizes) < 3000


def test_degraded_results_are_made_once(spark):
    """F14"""
    results, made = counted(spark, spark.createDataFrame([(q, r, 10 * q + r) for q in range(3) for r in range(4)], "q long, rank long, i long"))
    assert retrieval.degraded(results, spark.range(1000, 1100).toDF("i"), "q", "i", 0.5, 7).count() == 12
    assert made.value == 12


def test_bm25_shuffles_no_pairs(spark):
    """a document's terms lie together when pairs are summed."""
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta gamma"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "beta alpha"), (8, "gamma")], "item_id long, text string")
    found = retrieval.bm25(docs, asked)
    assert sorted((r["item_id"], r["doc_id"]) for r in found.collect()) == [(7, 1), (7, 2), (8, 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(item_id" not in plan


def test_simulation_records_are_made_once(spark):
    """F15"""
    span = lambda i, up, name, kind: (str(i), "t", up, name, kind, "OK", None, {"input.value": "why"} if up is None else {})
    rows = [span(1, None, adapters.ROOTS["tau2"], "CHAIN"), span(2, "1", "agent", "AGENT"), span(3, "2", "lookup", "TOOL"), span(4, "1", "judge", "LLM")]
    records = spark.createDataFrame(rows, "context_span_id string, trace_id string, parent_id string, name string, span_kind string, status_code string, status_message string, attributes map<string,string>")
    at = F.timestamp_micros(F.col("context_span_id").cast("long"))
    records, made = counted(spark, records.withColumns({"start_time": at, "end_time": at}))
    found = {r["external_id"]: (r["span_type"], r["executed_steps"]) for r in adapters.simulation(records).spans.collect()}
    assert {i: t for i, (t, _) in found.items()} == {"1": "simulation", "2": "agent_root", "3": "tool", "4": "external_llm"}
    assert [s["id"] for s in found["2"][1]] == ["3"]
    assert made.value == 4


def test_spans_of_trees_are_made_once(spark):
    """F16, F17"""
    rows = [(1, i, i // 2 or None, i, i, "x") for i in range(1, 8)]
    spans, made = counted(spark, spark.createDataFrame(rows, "trace_id long, span_id long, parent_id long, start_us long, end_us long, span_type string"))
    found = {r["span_id"]: r["number"] for r in trees.walked(spark, spans, numbers=True).collect()}
    assert found == {1: 1, 2: 2, 4: 3, 5: 4, 3: 5, 6: 6, 7: 7}
    assert made.value == 7


def test_latest_attempts_without_a_join(spark):
    """rows without a key have a last attempt as well."""
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3), (None, 1, 4), ("b", None, 5), ("b", 1, 6)], "k string, n long, v long")
    found = analysis.latest_attempts(rows, ["k"], "n")
    assert found.columns == rows.columns and sorted(r["v"] for r in found.collect()) == [2, 3, 4, 6]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_traces_of_a_service_are_read_by_many_tasks(spark, monkeypatch):
    """few bytes of ids don't end up in one task."""
    monkeypatch.setattr(traces, "TRACES", 10)
    client = lambda trace_id, first, after: {"spans": {"edges": [{"node": {"context": {"spanId": "1", "traceId": trace_id}}}], "pageInfo": {}}}
    found = traces.from_service(spark.range(60).union(spark.range(5)).select(F.col("id").alias("trace_id")), client).select("trace_id", F.spark_partition_id().alias("p")).collect()
    assert sorted(int(r["trace_id"]) for r in found) == list(range(60))
    assert len({r["p"] for r in found}) > 3
