"""Metrics of users' code over groups of spans, and the metrics that are chosen by name alone."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tests.test_workbench import span, trace
from tracemill import workbench
from tracemill.operators import ablations, groups, metrics, trees
from tracemill.operators.store import Store
from tracemill.staging import arrow_rows


def alternating(batches):
    """1 if the group's numbers go up by one from 0 on, in order; it stops reading at the first that doesn't."""
    n = 0
    for b in batches:
        for x in b.column(0).to_pylist():
            if x == -1:
                raise ValueError("minus one")
            if x != n:
                return 0.0, None
            n += 1
    return 1.0, None


def test_groups_of_any_size(spark):
    """Groups within and over batches, read to the end or not, null keys, errors of one group, traces without spans."""
    rng, rows, want = random.Random(4), [], {}
    for t in range(6):
        for g in ["a", "b", None]:
            n = rng.choice([1, 2, 90])
            numbers = list(range(n))
            if (t + (g == "b")) % 3 == 1 and n > 1:
                numbers[n // 2] = -1 if t % 2 else 7777
            want[t, g or ""] = (n, "FAILED" if -1 in numbers else "COMPLETED", None if -1 in numbers else float(7777 not in numbers))
            rows += [(t, g, "tool", 100 + i, i, x) for i, x in enumerate(numbers)]
    rows += [(9, "a", "llm", 0, 0, 0)]
    rng.shuffle(rows)
    spans = spark.createDataFrame(rows, "trace_id long, k string, span_type string, start_us long, span_id long, x long")
    metric = groups.GroupMetric("up", ("tool",), ("x",), alternating, group_spans=lambda: F.col("k"))
    with arrow_rows(spark, 7):
        got = {(r["trace_id"], r["group"]): (r["n_spans"], r["status"], r["score"]) for r in groups.scored(spans, metric, spans).collect()}
    skipped = got.pop((9, None))
    assert skipped == (0, "SKIPPED", None)
    assert {k: v[1:] for k, v in got.items()} == {k: v[1:] for k, v in want.items()}
    assert all(got[k][0] == want[k][0] for k in want)


def test_optional_metrics_are_chosen_by_name():
    r = metrics.built_in()
    names = {m.name for m in r.select(None)}
    more = {"contextual_precision_document_judge_sc", "contextual_recall_gold_claims_sc_question", "deepeval_contextual_precision", "deepeval_contextual_recall_gold_claims", "deepeval_answer_correctness", "answer_correctness_judge_wt", "plan_correctness_judge_wt"}
    assert not names & more and {m.name for m in r.select(sorted(more))} == more
    with pytest.raises(ValueError, match="judge"):
        r.select("deepeval_answer_correctness", set())


def test_rank_faults(spark):
    schema = "sizes array<int>, verdict struct<ranks:array<array<int>>,output_tokens:long>"
    cases = [([2], ([[2, 1]], 1), None), ([2, 0], ([[1, 2], []], 1), None), ([3], ([[1, 1, 5]], 1), "misaligned: the judge's ranks don't match the items: missing 2, 3; unknown 5; repeated 1."), ([3], ([[1]], 6000), "truncated: the judge's ranks don't match the items: missing 2, 3."), ([1], (None, None), "misaligned: the judge's ranks don't match the items: missing 1.")]
    df = spark.createDataFrame([c[:2] for c in cases], schema)
    assert [r[0] for r in df.select(ablations.ranks_fault(F.col("sizes"), 2000, 32000)).collect()] == [c[2] for c in cases]


def test_rendered_traces(spark):
    rows = [("t", "r", None, "simulation", "sim", 0, None, None, None, None), ("t", "a", "r", "agent_root", 'an "agent"', 1, "ask", "say", None, None), ("t", "b", "a", "tool", "x", 2, None, None, "in", "out"), ("t", "c", "b", "llm", "y", 3, None, None, None, "o2"), ("t", "d", "a", "tool", "z", 4, None, None, None, None), ("t", "e", "r", "llm", "w", 5, None, None, "no", "no")]
    spans = spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string, span_type string, name string, start_us long, request string, answer string, input_data string, output_data string").withColumns({"end_us": F.col("start_us"), "status": F.lit("success")})
    got = ablations.rendered(trees.walked(spark, spans, numbers=True), spans).collect()
    text = '<span id="1" type="agent_root" name="an \\"agent\\"" status="success">\nrequest:\nask\n<span id="2" parent="1" type="tool" name="x" status="success">\ninput:\nin\n<span id="3" parent="2" type="llm" name="y" status="success">\noutput:\no2\n</span>\noutput:\nout\n</span>\n<span id="4" parent="1" type="tool" name="z" status="success">\n</span>\nanswer:\nsay\n</span>'
    assert [(r["span_id"], r["rendered"], r["rendered_spans"], r["rendered_chars"]) for r in got] == [("a", text, 4, len(text))]


def reading(requests):
    """A judge that finds answers right whose whole trace it was given."""
    return requests.select("request_hash", F.when(F.contains("text", F.lit('<span id="2" parent="1" type="llm"')), 1.0).otherwise(0.0).alias("score"))


def test_whole_trace_metrics_of_a_store(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.json").write_text(trace("t1", [dict(span("a1"), **{"attributes.input.value": "hi", "attributes.output.value": "yes"}), span("b2", "a1")]))
    (tmp_path / "d.json").write_text(json.dumps({"samples": [{"input_prompt": "hi", "ground_truth_output": "yes"}]}))
    store = Store(spark, str(tmp_path / "s"))
    workbench.import_dataset(store, str(tmp_path / "d.json"), "d")
    workbench.import_run(store, str(tmp_path / "t"), "d", "r")
    workbench.evaluate_run(store, "r", "answer_correctness_judge_wt,deepeval_answer_correctness", judge=reading)
    assert {r["metric"]: (r["status"], r["score"]) for r in store.table("computations").collect()} == {"answer_correctness_judge_wt": ("COMPLETED", 1.0), "deepeval_answer_correctness": ("COMPLETED", 0.0)}
