import json

from pyspark.sql import functions as F

from tracemill import service
from tracemill.sources import files
from tracemill.sources.traces import TraceSource
from tracemill.streaming import ingest

SPANS = [{"context.span_id": "1", "parent_id": None, "name": "root", "span_kind": "AGENT", "status_code": "OK", "start_time": "2026-01-01T00:00:00Z", "end_time": "2026-01-01T00:00:09Z", "attributes.input.value": "hi"}, {"context.span_id": "2", "parent_id": "1", "name": "l", "span_kind": "LLM", "status_code": "OK", "start_time": "2026-01-01T00:00:01Z", "end_time": "2026-01-01T00:00:02Z", "attributes.llm.token_count.prompt": 5}]


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.json").write_text(json.dumps({"trace_id": " a ", "spans": SPANS}))
    (tmp_path / "t/b.json").write_text(json.dumps({"trace_id": "b", "spans": []}))
    (tmp_path / "t/c.json").write_text("not json")
    spans, faults = service.import_traces(spark, str(tmp_path / "t"))
    got = {r["external_id"]: r for r in spans.collect()}
    assert got["1"]["span_type"] == "agent_root" and got["1"]["input_data"] == "hi" and got["2"]["usage"]["input_tokens"] == 5
    assert sorted(r["detail"] for r in faults.collect()) == ["no spans", "not a trace file"]
    (tmp_path / "d.json").write_text(json.dumps({"samples": [{"input_prompt": "p", "document_ids": []}, {"input_prompt": "q"}]}))
    rows = files.dataset_json(spark, str(tmp_path / "d.json")).orderBy("pos").collect()
    assert rows[0]["document_ids"] == [] and rows[1]["document_ids"] is None


def test_trace_source(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"trace_id": "a", "spans": SPANS}))
    spark.dataSource.register(TraceSource)
    got = spark.read.format("traces").option("ids", "a").load(str(tmp_path))
    assert [r["span_id"] for r in got.orderBy("span_id").collect()] == ["1", "2"]


def test_binding(spark):
    requests = spark.createDataFrame([("a", " p "), ("b", "q"), ("c", "r"), ("d", "r")], "trace_id string, request string")
    samples = spark.createDataFrame([(1, "p"), (2, "q"), (3, "q "), (4, "r")], "sample_id int, input_prompt string")
    good, bad = service.bind_samples(requests, samples)
    assert [tuple(r) for r in good.collect()] == [("a", 1)]
    assert sorted(r["trace_id"] for r in bad.collect()) == ["b", "c", "d"]


def test_stream(spark, tmp_path):
    rows = [dict(context_span_id=str(i % 3), trace_id="t", parent_id=None, name="n", span_kind="TOOL", status_code="ERROR" if i == 0 else "OK", status_message=None, start_time="2026-01-01T00:00:00Z", end_time="2026-01-01T00:00:01Z", attributes={}) for i in range(4)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    q = ingest.append(ingest.span_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 3
    rates = ingest.error_rates(out).first()
    assert (rates["spans"], rates["span_type"]) == (3, "tool")
    assert ingest.sessions(out).agg(F.sum("spans").alias("n")).first()["n"] == 3
