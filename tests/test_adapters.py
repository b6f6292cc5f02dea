"""What adapters make of small traces."""

import json
from datetime import datetime, timedelta

import pytest

from tracemill.operators import adapters
from tracemill.streaming.ingest import RECORDS

T0 = datetime(2026, 1, 1)


def record(i, parent, name, kind=None, start=0, end=1, trace="t", status="OK", **attributes):
    return (i, trace, parent, name, kind, status, None, T0 + timedelta(seconds=start), T0 + timedelta(seconds=end), {k.replace("__", "."): v for k, v in attributes.items()})


def frame(spark, rows):
    return spark.createDataFrame(rows, RECORDS)


def by_id(adapted):
    return {r["external_id"]: r for r in adapted.spans.collect()}, sorted((r["trace_id"], r["rule"]) for r in adapted.faults.collect())


def search(*ids):
    return json.dumps({"query": "q", "results": [{"id": i, "title": "t", "text": f"text {i}"} for i in ids]})


def tool(i, start, output, **more):
    return record(i, "r", "search", "TOOL", start, start + 1, tool__name=adapters.SEARCH_TOOL, output__value=output, **more)


def test_code_agent(spark):
    rows = [record("r", None, "smolagents.request", "AGENT", 0, 9, input__value="42", output__value=" 7 "), tool("b", 3, search("2", "1")), tool("a", 1, search("1")), tool("c", 4, "Search failed: x"), record("l", "r", "call", "LLM", 5, 6)]
    rows += [record("r2", None, "other", trace="u", input__value="q"), record("r3", None, "smolagents.request", trace="v", input__value="  ")]
    spans, faults = by_id(adapters.code_agent(frame(spark, rows)))
    assert faults == [("u", "root"), ("v", "no_question")] and {s["trace_id"] for s in spans.values()} == {"t"}
    assert (spans["r"]["request"], spans["r"]["answer"]) == ("42", "7")
    assert [spans[i]["span_type"] for i in "abcl"] == ["retrieval", "retrieval", "tool", "llm"]
    evidence = spans["r"]["retrieval"][0]
    assert (evidence["stage"], evidence["availability"]) == ("retrieved", "available")
    assert [i["id"] for i in evidence["items"]] == ["1", "2"]
    assert spans["a"]["request"] == "42" and spans["c"]["retrieval"] is None
    broken, _ = by_id(adapters.code_agent(frame(spark, [*rows[:2], tool("x", 2, "no json")])))
    assert broken["r"]["retrieval"][0]["availability"] == "unavailable" and broken["r"]["retrieval"][0]["reason"] == "unreadable search outputs: x"


@pytest.mark.parametrize("model, refused", [("gpt-4.1", False), ("gpt-4.1-2026-01-02", False), ("gpt-4.1-mini", True), ("gptx4.1", True)])
def test_models(spark, model, refused):
    rows = [record("r", None, "odr.request", "CHAIN", input__value="q"), record("l", "r", "call", "LLM", llm__model_name=model)]
    spans, faults = by_id(adapters.research_agent(frame(spark, rows), "gpt-4.1"))
    assert (faults, len(spans)) == (([("t", "other_model")], 0) if refused else ([], 2))


def test_workflow(spark):
    def entry(i, start, end, **data):
        return {"id": i, "label": "step " + i, "status": "success", "data": data, "metadata": {"started_at": start, "finished_at": end} | ({"provider": "p", "total_tokens": 9} if "usage" in data else {})}

    log = [entry("e1", 100.5, 101.0, usage={"prompt_tokens": 4, "completion_tokens": 5}), entry("e2", 102.0, 103.25, tool_name=adapters.SEARCH_TOOL, tool_call_args="a", output="tool response: " + search("k")), {"id": "e3", "label": "late", "data": {}, "metadata": {}}, {"id": "e4", "label": " "}]
    rows = [record("r", None, "flow", "CHAIN", 0, 9, dify_trace_id="x", input__value=json.dumps({"sys.query": "why"}), output__value=json.dumps({"answer": "so"})), record("n", "r", "node", "CHAIN", 2, 8, metadata__node_type="agent", output__value=json.dumps({"json": log, "text": "z"}))]
    spans, faults = by_id(adapters.workflow(frame(spark, rows)))
    assert faults == [] and set(spans) == {"r", "n", "e1", "e2"}
    assert (spans["r"]["request"], spans["r"]["answer"]) == ("why", "so")
    assert (spans["e1"]["span_type"], spans["e1"]["parent_span_id"], spans["e1"]["usage"]["input_tokens"], spans["e1"]["usage"]["total_tokens"]) == ("llm", "n", 4, 9)
    assert (spans["e1"]["start_time"], spans["e2"]["start_time"], spans["e2"]["end_time"]) == tuple(T0 + timedelta(seconds=s) for s in (2, 3.5, 4.75))
    assert spans["e2"]["span_type"] == "retrieval" and [i["id"] for i in spans["r"]["retrieval"][0]["items"]] == ["k"]
    assert json.loads(spans["n"]["output_data"]) == {"text": "z"} and "late" in spans["n"]["metadata"]["dify.agent_log.untimed"]


def test_simulation(spark):
    rows = [record("r", None, "tau2.simulation", "CHAIN", 0, 20, input__value="scenario"), record("a", "r", "agent", "AGENT", 1, 9, output__value="done"), record("u", "r", "user_turn", "CHAIN", 1, 2), record("g", "r", "evaluate_simulation", "CHAIN", 10, 11), record("o", "r", "else", "CHAIN", 10, 11)]
    rows += [record(f"l{p}", p, "call", "LLM", 3, 4, llm__token_count__prompt="5", llm__cost__total="0") for p in "augo"] + [record("retry", "la", "call", "LLM", 3, 4, llm__token_count__prompt="5")]
    rows += [record("t2", "a", "t", "TOOL", 6, 7, status="ERROR", tool__name="book", input__value="{}"), record("t1", "la", "look", "TOOL", 5, 6, output__value="raw", tool__id="9"), record("t3", "u", "t", "TOOL", 2, 3)]
    spans, faults = by_id(adapters.simulation(frame(spark, rows)))
    assert faults == []
    assert {i: spans[i]["span_type"] for i in ("r", "a", "la", "lu", "lg", "lo", "retry")} == {"r": "simulation", "a": "agent_root", "la": "llm", "lu": "customer_llm", "lg": "grader_llm", "lo": "external_llm", "retry": "llm_internal"}
    assert spans["la"]["usage"]["cost"] is None and spans["la"]["usage"]["input_tokens"] == 5 and spans["lu"]["usage"] is None
    assert [(s["operation"], s["status"], s["output"], s["tool_call_id"]) for s in spans["a"]["executed_steps"]] == [("look", "completed", "raw", "9"), ("book", "error", None, None)]
    assert (spans["a"]["request"], spans["a"]["answer"]) == ("scenario", "done")
    _, faults = by_id(adapters.simulation(frame(spark, rows[:1])))
    assert faults == [("t", "agents")]
