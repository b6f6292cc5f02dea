"""Spans that come late, in batches that come twice, and a trace that changes."""

import json
import time

import pytest

from tracemill.operators.store import Store
from tracemill.streaming import ingest, whole


def record(trace, span, parent=None, name="x"):
    return json.dumps({"context_span_id": span, "trace_id": trace, "parent_id": parent, "name": name, "span_kind": "LLM", "status_code": "OK", "start_time": "2026-01-01T00:00:00Z", "end_time": "2026-01-01T00:00:01Z"})


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def test_late_parents(rocks, tmp_path):
    (tmp_path / "in").mkdir()
    store = Store(rocks, str(tmp_path / "store"))

    def run(name, *records, patience=600):
        (tmp_path / f"in/{name}.json").write_text("\n".join(records))
        raw = rocks.readStream.schema(ingest.RECORDS).json(str(tmp_path / "in"))
        whole.into_store(ingest.ADAPTERS["phoenix"](raw), store, "s", str(tmp_path / "ck"), patience, None).awaitTermination(60)
        return sorted((r["trace_id"], r["span_id"], r["complete"]) for r in store.table("stream_spans").collect()) if "stream_spans" in store.manifest() else []

    assert run("1", record("a", "2", "1"), record("b", "9", "8")) == []  # parents lack
    assert run("2", record("a", "1"), record("c", "1")) == [("a", "1", True), ("a", "2", True), ("c", "1", True)]
    again = run("3", record("a", "3", "2"), record("c", "1"))  # a late child of spans that left, and an equal span
    assert again == [("a", "1", True), ("a", "2", True), ("a", "3", True), ("c", "1", True)]
    assert store.table("refused").count() == 0
    assert run("4", record("c", "1", name="other")) == again and [r["trace_id"] for r in store.table("refused").collect()] == ["c"]


def test_unfinished_traces_leave(rocks, tmp_path):
    (tmp_path / "in").mkdir()
    store = Store(rocks, str(tmp_path / "store"))

    def run(name, *records):
        (tmp_path / f"in/{name}.json").write_text("\n".join(records))
        raw = rocks.readStream.schema(ingest.RECORDS).json(str(tmp_path / "in"))
        whole.into_store(ingest.ADAPTERS["phoenix"](raw), store, "s", str(tmp_path / "ck"), 1, None).awaitTermination(60)

    run("1", record("b", "9", "8"))
    time.sleep(1.5)
    run("2", record("d", "1"))
    assert sorted((r["trace_id"], r["complete"]) for r in store.table("stream_spans").collect()) == [("b", False), ("d", True)]


def test_a_batch_comes_twice(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    batch = spark.createDataFrame([("a", "1", "{}", True)], whole.OUT)
    assert whole.store_batch(store, batch, 0, "s") and not whole.store_batch(store, batch, 0, "s")
    assert whole.store_batch(store, batch, 1, "s") and store.table("stream_spans").count() == 1
    assert whole.store_batch(Store(spark, store.folder), batch.selectExpr("trace_id", "'2' AS span_id", "span", "complete"), 0, "other")
    assert store.marks() == {"s": 1, "other": 0} and store.table("stream_spans").count() == 2
