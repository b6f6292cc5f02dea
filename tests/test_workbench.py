"""Sinks, the paged service, and a store from data set to report."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_sources import SPANS
from tracemill import __main__ as cli
from tracemill import service, workbench
from tracemill.operators import validate
from tracemill.operators.store import Store, inserted, status_updated, updated
from tracemill.sources import sinks, traces


def test_store_rows(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id int, status string, note string")
    assert inserted(old, old.limit(0), "id").count() == 2
    with pytest.raises(ValueError):
        inserted(old, old.limit(1), "id")
    new = spark.createDataFrame([(2, "c", "y")], old.schema)
    assert {tuple(r) for r in updated(old, new, "id").collect()} == {(1, "a", "x"), (2, "c", "y")}
    with pytest.raises(LookupError):
        updated(old, spark.createDataFrame([(9, "c", "y")], old.schema), "id")
    changes = spark.createDataFrame([(1, "done", None), (7, "lost", "z")], old.schema)
    assert {tuple(r) for r in status_updated(old, changes, "id").collect()} == {(1, "done", "x"), (2, "b", None)}


def test_shards(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i:03}", f"text {i}") for i in range(25)], "document_id string, text string")
    asked = []

    def embed(df):
        asked.append(df.count())
        return df.selectExpr("shard", "document_id", "array(float(length(text))) AS embedding")

    folder = str(tmp_path / "shards")
    assert sinks.embed_shards(docs, folder, embed, 10) == 3 and asked == [25]
    assert sinks.embed_shards(docs, folder, embed, 10) == 0
    import shutil

    shutil.rmtree(f"{folder}/shard=1")
    assert sinks.embed_shards(docs, folder, embed, 10) == 1 and asked == [25, 10]
    found = spark.read.parquet(folder)
    assert found.count() == 25 and {r["shard"]: r["n"] for r in found.groupBy("shard").agg({"*": "count"}).toDF("shard", "n").collect()} == {0: 10, 1: 10, 2: 5}
    with pytest.raises(ValueError, match="other documents"):
        sinks.embed_shards(docs.where("document_id <> 'd003'"), folder, embed, 10)


def test_vectors_logs_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    docs = spark.createDataFrame([("a", "red fox"), ("b", "blue fox")], "document_id string, text string")
    vectors = docs.selectExpr("document_id", "array(1.0) AS embedding")
    assert sinks.load_vectors(store, vectors, docs) == 2
    assert sinks.load_vectors(store, vectors.limit(1), docs.limit(1)) == 2 and store.table("doc_terms").count() == 4
    with pytest.raises(ValueError):
        sinks.load_vectors(store, vectors, docs.limit(1))
    log = str(tmp_path / "log")
    assert sinks.records(spark, log).count() == 0
    sinks.append_record(spark, log, "load", "started", ("r1",), {"n": 1})
    sinks.append_record(spark, log, "load", "ended")
    assert [(r["step"], r["status"], r["run_ids"], r["details"]) for r in sinks.records(spark, log).collect()] == [("load", "started", ["r1"], '{"n": 1}'), ("load", "ended", [], "{}")]
    rows = spark.createDataFrame([("x", 0.12345678), ("y", None)], "name string, v double")
    assert sinks.markdown(rows, ["name"], ["v"]) == ["| name | v |", "|---|--:|", "| x | 0.123457 |", "| y | – |"]
    raw = spark.createDataFrame([("r1", "{}"), ("r2", "[]")], "run_id string, record string")
    for _ in range(2):
        sinks.archive_traces(raw, str(tmp_path / "raw"))
    assert sinks.archived_traces(spark, str(tmp_path / "raw"), "record string, run_id string").where("run_id = 'r1'").count() == 2


def node(i, parent=None, **more):
    return {"context": {"spanId": i, "traceId": "t"}, "parentId": parent, "name": i, "startTime": "2026-01-01T00:00:00Z", "endTime": "soon", "attributes": json.dumps({"a": {"b": 1, "c": {}}, "x.y": [2]})} | more


def test_paged_service(spark):
    nodes = [node(str(i), None if i == 0 else "0") for i in range(5)]

    def client(trace_id, first, after):
        if trace_id == "none":
            return None
        at = int(after or 0)
        return {"spans": {"edges": [{"node": n} for n in nodes[at : at + first]], "pageInfo": {"hasNextPage": at + first < len(nodes), "endCursor": str(at + first)}}}

    assert [n["name"] for n in traces.pages_of(client, "t", 2)] == list("01234") and traces.pages_of(client, "none") == []
    for cursor in (None, "7"):
        with pytest.raises(traces.BadResponse):
            traces.pages_of(lambda *_, cursor=cursor: {"spans": {"pageInfo": {"hasNextPage": True, "endCursor": cursor}}}, "t")
    flat = traces.flat_record(nodes[1])
    assert (flat["attributes.a.b"], flat["attributes.a.c"], flat["attributes.x.y"], flat["start_time"], flat["end_time"]) == (1, {}, [2], "2026-01-01T00:00:00+00:00", None)
    with pytest.raises(traces.BadResponse):
        traces.flat_record(node("1", attributes="{"))
    found = traces.from_service(spark.createDataFrame([("t",), ("none",), ("t",)], "trace_id string"), client, 2).collect()
    assert sorted(r["span_id"] for r in found) == list("01234") and json.loads(found[0]["record"])["context.trace_id"] == "t"


def always(requests):
    """A judge that finds everything right unless it is asked to be strict."""
    from pyspark.sql import functions as F

    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("rankings", "array<array<boolean>>"), ("attributable", "array<boolean>"), ("failure", "string"), ("input_tokens", "long"), ("output_tokens", "long"))]
    return requests.select("request_hash", F.when(F.contains("text", F.lit("strict")), 0.0).otherwise(1.0).alias("score"), *none)


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "t").mkdir()
    for t, prompt in (("a", "hi"), ("b", "nobody asked")):
        spans = [dict(SPANS[0], **{"attributes.input.value": prompt, "attributes.output.value": "answer"}), SPANS[1]]
        (tmp_path / f"t/{t}.json").write_text(json.dumps({"trace_id": t, "spans": spans}))
    (tmp_path / "d.json").write_text(json.dumps({"samples": [{"input_prompt": " hi", "ground_truth_output": "x"}, {"input_prompt": "other"}]}))
    store, run = str(tmp_path / "store"), lambda *a: cli.main([*a])
    assert run("dataset", store, str(tmp_path / "d.json"), "d") == 0 and run("dataset", store, str(tmp_path / "d.json"), "d") == 1
    assert run("import", store, str(tmp_path / "t"), "d", "r1") == 0
    assert "b: binding: 0 samples" in capsys.readouterr().err
    assert run("run", store, "r1", "--metrics", "llm_calls, response_length") == 0 and run("repeat", store, "r1", "r2", "--metrics", "llm_calls") == 0
    assert run("repeat", store, "r1", "r2") == 1 and run("run", store, "nowhere") == 1 and run("run", store, "r1", "--metrics", "answer_correctness_judge") == 1
    s = Store(spark, store)
    got = {(r["run_id"], r["metric"]): (r["status"], r["score"]) for r in s.table("computations").collect()}
    assert got == {("r1", "llm_calls"): ("COMPLETED", 1.0), ("r1", "response_length"): ("COMPLETED", 6.0), ("r2", "llm_calls"): ("COMPLETED", 1.0)}
    assert {(r["run_id"], r["status"], r["source_run"]) for r in s.table("runs").collect()} == {("r1", "PARTIALLY_COMPLETED", None), ("r2", "PARTIALLY_COMPLETED", "r1")}
    judged = ("--metrics", "answer_correctness_judge", "--judge", "tests.test_workbench:always")
    assert run("repeat", store, "r1", "r3", *judged) == 0
    (tmp_path / "rubric.json").write_text('{"Answer_correctness_judge": "be strict"}')
    assert run("repeat", store, "r1", "r4", *judged, "--rubric", str(tmp_path / "rubric.json")) == 0
    assert run("repeat", store, "r1", "r5", "--metrics", "llm_calls", "--rubric", str(tmp_path / "rubric.json")) == 1
    assert {r["run_id"]: r["score"] for r in s.table("computations").where("metric = 'answer_correctness_judge'").collect()} == {"r3": 1.0, "r4": 0.0}
    capsys.readouterr()
    assert run("runs", store, "--status", "PARTIALLY_COMPLETED") == 0 and "r4" in capsys.readouterr().out
    assert run("status", store, "r2", "--set", "CANCELLED") == 0 and run("status", store, "nowhere", "--set", "x") == 1
    assert workbench.run_progress(s, "r1").first()["succeeded"] == 1 and workbench.set_status(s, "r2", "FAILED", ["RUNNING"]) == "CANCELLED"
    assert run("report", store, "r1", "--out", str(tmp_path / "report.json")) == 0
    assert json.loads((tmp_path / "report.json").read_text())["samples"] == {"processed": 2, "succeeded": 1, "failed": 1}
    assert "answer_correctness_judge" not in json.dumps(json.loads(workbench.report_run(s, "r1")))


def trace(i, spans, **more):
    return json.dumps({"trace_id": i, "spans": spans, **more})


def span(i, parent=None, start=0, end=9, **more):
    return {"context.span_id": i, "parent_id": parent, "name": "x", "span_kind": "LLM" if parent else "AGENT", "start_time": f"2026-01-01T00:00:0{start}Z", "end_time": f"2026-01-01T00:00:0{end}Z", **more}


def test_every_rule_refuses_a_trace(spark, tmp_path):
    cases = {
        "duplicate_span_id": trace("duplicate_span_id", [span("a"), span("b", "a"), span("b", "a")]),
        "other_trace": trace("other_trace", [span("a"), span("b", "a", **{"context.trace_id": "zzz"})]),
        "negative_duration": trace("negative_duration", [span("a"), span("b", "a", 5, 4)]),
        "missing_parent": trace("missing_parent", [span("a"), span("b", "c")]),
        "cycle": trace("cycle", [span("a"), span("b", "c"), span("c", "b")]),
        "negative_trace_duration": trace("negative_trace_duration", [span("a")], start_time="2026-01-02T00:00:00Z", end_time="2026-01-01T00:00:00Z"),
        "schema_version": trace("schema_version", [span("a")], schema_version=2),
        "missing_span_id": trace("missing_span_id", [span(None)]),
        "missing_end": trace("missing_end", [span("a", end_time="soon")]),
        "missing_start": trace("missing_start", [span("a", start_time=None)]),
        "file": trace("file", []),
    }
    (tmp_path / "t").mkdir()
    for name, text in cases.items():
        (tmp_path / f"t/{name}.json").write_text(text)
    (tmp_path / "t/good.json").write_text(trace("good", [span("a", **{"context.trace_id": "good"}), span("b", "a")], schema_version=1, start_time="2026-01-01T00:00:00Z", end_time="2026-01-01T00:00:09Z"))
    spans, faults = service.import_traces(spark, str(tmp_path / "t"))
    found = {(r["trace_id"], r["rule"]) for r in faults.collect()}
    assert {(n, n) for n in cases} <= found and not any(t == "good" for t, _ in found)
    assert {r["trace_id"] for r in spans.select("trace_id").collect()} == {"good"}


def test_plan_rules_of_traces(spark):
    step = "struct<id:string,span_ids:array<string>,plan_id:string,planned_step_id:string>"
    schema = f"trace_id string, external_id string, parent_span_id string, start_time timestamp, end_time timestamp, plans array<struct<plan_id:string,supersedes:string,steps:array<struct<id:string,depends_on:array<string>>>>>, executed_steps array<{step}>"
    from datetime import datetime

    at, fine = datetime(2026, 1, 1), ("p", None, [("s", [])])
    cases = {
        "good": ([fine, ("q", "p", [("t", []), ("u", ["t"])])], [("1", ["a"], "q", "u"), ("2", ["a"], None, None)]),
        "duplicate_plan": ([fine, fine], []),
        "plan_cycle": ([("p", "q", []), ("q", "p", [])], []),
        "missing_superseded_plan": ([("p", "x", [])], []),
        "unknown_execution_span": ([fine], [("1", ["a", "z"], None, None)]),
        "unknown_plan": ([fine], [("1", ["a"], "x", None)]),
        "unknown_planned_step": ([fine], [("1", ["a"], "p", "x")]),
        "dependency_cycle": ([("p", None, [("s", ["t"]), ("t", ["s"])])], []),
    }
    spans = spark.createDataFrame([(n, "a", None, at, at, p, s) for n, (p, s) in cases.items()] + [("none", "a", None, at, at, None, [("1", ["a"], None, "s")])], schema)
    envelopes = spans.selectExpr("trace_id", "1 AS schema_version", "CAST(NULL AS string) AS stated_trace_id", "external_id AS span_id", "CAST(NULL AS long) AS start_us", "CAST(NULL AS long) AS end_us")
    found = {(r["trace_id"], r["rule"]) for r in validate.trace_violations(spans, envelopes).collect()}
    assert found == {(n, n) for n in cases if n != "good"} | {("none", "unknown_planned_step")}


def test_ids_of_any_form(spark, tmp_path):
    """Hex ids and ids with leading zeros from files to a report; scoring again replaces, a broken import leaves nothing."""
    (tmp_path / "t").mkdir()
    root = dict(span("00f067aa0ba902b7"), **{"attributes.input.value": "hi", "attributes.output.value": "yes"})
    (tmp_path / "t/a.json").write_text(trace("4bf92f3577b34da6", [root, span("0012", "00f067aa0ba902b7"), span("e1", "0012")]))
    (tmp_path / "d.json").write_text(json.dumps({"samples": [{"input_prompt": "hi"}]}))
    store = Store(spark, str(tmp_path / "s"))
    workbench.import_dataset(store, str(tmp_path / "d.json"), "d")
    assert workbench.import_run(store, str(tmp_path / "t"), "d", "r").count() == 0
    for _ in range(2):
        assert workbench.evaluate_run(store, "r", "llm_calls,response_length") == "COMPLETED"
    workbench.evaluate_run(store, "r", "llm_calls")
    got = {r["metric"]: (r["span_ids"], r["score"]) for r in store.table("computations").collect()}
    assert got == {"llm_calls": (["0012", "e1"], 2.0), "response_length": (["00f067aa0ba902b7"], 3.0)} and store.table("computations").count() == 2
    assert json.loads(workbench.report_run(store, "r"))["samples"]["succeeded"] == 1
    before = store.manifest()
    with pytest.raises(ValueError, match="adapter"):
        workbench.import_run(store, str(tmp_path / "t"), "d", "r2", "research_agent")
    with pytest.raises(ValueError, match="no adapter"):
        workbench.import_run(store, str(tmp_path / "t"), "d", "r2", "nobody")
    assert store.manifest() == before
    faults = workbench.import_run(store, str(tmp_path / "t"), "d", "r2", "research_agent", "gpt-x").collect()
    assert {"root", "other_model"} == {r["rule"] for r in faults} and workbench.run_progress(store, "r2").first()["failed"] == 1


def test_appends_add_folders(spark, tmp_path, monkeypatch):
    """An append writes its own rows alone; two writers both end in the manifest; a replaced table is told apart."""
    store, other = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    rows = lambda *ids: spark.createDataFrame([(i, str(i)) for i in ids], "id long, s string")
    store.append({"a": rows(1), "b": rows(1)})
    first = store.manifest()["a"]
    store.append({"a": rows(2).select("s", F.col("id").cast("int").alias("id"))})
    assert store.manifest()["a"][:1] == first and len(store.manifest()["a"]) == 2 and {tuple(r) for r in store.table("a").collect()} == {(1, "1"), (2, "2")}
    publish, done = Store._publish, []

    def late(self, version, states):
        if self is store and not done:
            done.append(1)
            other.append({"a": rows(3)})  # takes the number first
        return publish(self, version, states)

    monkeypatch.setattr(Store, "_publish", late)
    store.append({"a": rows(4)})
    assert sorted(r["id"] for r in store.table("a").collect()) == [1, 2, 3, 4]
    done.clear()
    store.commit({"b": rows(7)})  # the other's rows of a stay
    assert sorted(r["id"] for r in store.table("a").collect()) == [1, 2, 3, 3, 4] and [r["id"] for r in store.table("b").collect()] == [7]
    done.clear()
    with pytest.raises(RuntimeError, match="another writer has changed a"):
        store.commit({"a": rows(9)})
    with pytest.raises(ValueError, match="columns"):
        store.append({"a": rows(1).drop("s")})
    before = store.table("a").count()
    store.compact("a")
    assert len(store.manifest()["a"]) == 1 and store.table("a").count() == before


def test_a_broken_import_leaves_nothing(spark, tmp_path, monkeypatch):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.json").write_text(trace("t1", [dict(span("a1"), **{"attributes.input.value": "hi"})]))
    (tmp_path / "d.json").write_text(json.dumps({"samples": [{"input_prompt": "hi"}]}))
    store = Store(spark, str(tmp_path / "s"))
    workbench.import_dataset(store, str(tmp_path / "d.json"), "d")
    before = store.manifest()

    def broken(*_):
        raise OSError("no space left")

    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", broken)
        with pytest.raises(OSError):
            workbench.import_run(store, str(tmp_path / "t"), "d", "r")
    assert store.manifest() == before
    workbench.import_run(store, str(tmp_path / "t"), "d", "r")
    assert store.table("spans").count() == 1 and store.table("runs").count() == 1
