"""Values known beforehand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.functions import scores, stats, text
from tracemill.operators import analysis, metrics, normalize, report, retrieval, store, validate
from tracemill.plans import planner


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def ids(*xs):
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")


def test_ndcg(spark):
    assert one(spark, scores.ndcg(ids("wrong", "right", "right"), ids("right"))) == pytest.approx(1 / math.log2(3))
    top = ["a", "a", *map(str, range(8)), "right"]
    assert one(spark, scores.ndcg(ids(*top), ids("right"))) == 0
    assert one(spark, scores.ndcg(ids(*top), ids("a"))) == 1
    assert one(spark, metrics.mean_ndcg(F.array(ids("x", "right"), ids("right")), ids("right"))) == pytest.approx((1 / math.log2(3) + 1) / 2)
    assert one(spark, scores.ndcg(ids("a"), ids())) is None


def test_sets(spark):
    p, r = metrics.set_precision(ids("a", "b"), ids("b", "c", "d")), metrics.set_recall(ids("a", "b"), ids("b", "c", "d"))
    assert one(spark, p[1]) == 0.5 and one(spark, r[1]) == pytest.approx(1 / 3)
    assert one(spark, metrics.set_precision(ids(), ids())[1]) == 1.0
    assert one(spark, metrics.set_precision(ids(), ids("d1"))[0]) == "Nothing selected, so precision is undefined."
    assert one(spark, metrics.set_recall(ids(), ids())[0]) == "No relevant IDs, so recall is undefined."
    assert one(spark, metrics.set_recall(ids(), ids("d1"))[1]) == 0.0


def test_plans(spark):
    assert one(spark, scores.sequence_match(ids("a", "b"), ids("a", "c"))) == 0.5
    assert one(spark, scores.sequence_match(ids("a", "b", "c"), ids("c"))) == pytest.approx(1 - 2 / 3)
    assert one(spark, scores.sequence_match(ids(), ids())) == 1
    assert one(spark, metrics.plan_efficiency(F.lit(2), F.lit(0))) == 0
    assert one(spark, metrics.plan_efficiency(F.lit(2), F.lit(4))) == 0.5
    assert one(spark, metrics.plan_efficiency(F.lit(5), F.lit(4))) == 1


def test_relevant_ids(spark):
    found, fault = text.relevant_ids(F.lit('{"relevant_ids": [" a ", "a", {"id": " b "}, "", null, 12, {}]}'))
    assert sorted(one(spark, found)) == ["a", "b"] and one(spark, fault) is None
    assert one(spark, text.relevant_ids(F.lit('{"relevant_ids": "invalid"}'))[1]) == "ground_truth_value.relevant_ids must be a list."
    assert one(spark, text.relevant_ids(F.lit("[1]"))[1]) == "ground_truth_value must be an object."


def test_uuid5(spark):
    import uuid

    for name in ("", "a", "é 中", "x" * 500):
        assert one(spark, text.uuid5(str(uuid.NAMESPACE_URL), F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_text(spark):
    assert one(spark, text.display(F.lit(" \t\n"))) == "<empty>"
    assert one(spark, text.strip(F.lit("  x \n"))) == "x"
    assert one(spark, text.decode_payload(F.lit("42"))) == "42"
    assert one(spark, text.decode_payload(F.lit("plain"))) == '"plain"'
    assert one(spark, text.echo_key(F.lit("2. The Claim, is_x!"))) == "the claim is_x"
    assert one(spark, F.size(text.bm25_tokens(F.lit("The quick brown fox, over two hills_now")))) == 5
    assert one(spark, text.embedding_text(F.lit("support"), F.lit("support-alex says"))) == "support\n\nsupport-alex says"
    assert one(spark, text.embedding_text(F.lit("Title"), F.lit("Title here"))) == "Title here"


def test_statistics(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, False), (False, True), (True, True), (False, False), (True, True), (True, False)], "a boolean, b boolean")
    assert rows.agg(stats.kappa(F.col("a"), F.col("b")).alias("k")).first()["k"] == pytest.approx((5 / 8 - 0.5) / 0.5)
    same = spark.createDataFrame([(True, True)] * 3, "a boolean, b boolean")
    assert same.agg(stats.kappa(F.col("a"), F.col("b")).alias("k")).first()["k"] is None
    points = spark.createDataFrame([(0, 1.0, True), (0, 0.5, True), (0, 0.5, False), (0, 0.7, False)], "g int, s double, p boolean")
    assert stats.auroc(points, ["g"], "s", "p").first()["auroc"] == pytest.approx((2 + 0.5) / 4)
    flat = spark.createDataFrame([(0, 1.0, 2.0), (0, 1.0, 3.0)], "g int, x double, y double")
    assert analysis.spearman(flat, ["g"], "x", "y").first()["rho"] is None
    up = spark.createDataFrame([(0, 1.0, 2.0), (0, 2.0, 3.0), (0, 3.0, 9.0)], "g int, x double, y double")
    assert analysis.spearman(up, ["g"], "x", "y").first()["rho"] == 1.0
    assert one(spark, F.round(F.lit(257 / 400), 3)) == 0.643
    c = spark.createDataFrame([("m", "COMPLETED", 0.8), ("m", "COMPLETED", 0.6), ("m", "FAILED", None)], "metric string, status string, score double")
    r = report.metric_scores(c).first()
    assert (r["n"], r["mean"], r["stddev"], r["median"]) == (2, 0.7, 0.141421, 0.7)


def test_fusion(spark):
    a = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "c", 3)], "q int, i string, rank int")
    b = spark.createDataFrame([(0, "c", 1), (0, "a", 2), (0, "d", 3)], "q int, i string, rank int")
    got = [r["i"] for r in retrieval.fused([a, b], "q", "i").orderBy("position").collect()]
    assert got == ["a", "c", "b", "d"]


def test_normalise(spark):
    rows = [("1", None, "", "CHAIN", "OK", None, {}), ("2", "1", "n", "x", "ERROR", "boom", {"openinference.span.kind": "RETRIEVER"}), ("3", "1", None, "llm", None, "", {"llm.token_count.prompt": "7", "llm.cost.total": "0.5"})]
    df = spark.createDataFrame(rows, "context_span_id string, parent_id string, name string, span_kind string, status_code string, status_message string, attributes map<string,string>").withColumns({"trace_id": F.lit("t"), "start_time": F.lit(None).cast("timestamp"), "end_time": F.lit(None).cast("timestamp")})
    got = {r["external_id"]: r for r in normalize.canonical(df).collect()}
    assert [got[k]["span_type"] for k in "123"] == ["agent_root", "retrieval", "llm"]
    assert [got[k]["status"] for k in "123"] == ["success", "error", "unset"]
    assert got["1"]["name"] == "1" and got["2"]["metadata"]["phoenix.status_message"] == "boom"
    assert got["3"]["usage"]["input_tokens"] == 7 and got["3"]["usage"]["currency"] == "USD" and got["2"]["usage"] is None


def test_violations(spark):
    s = spark.createDataFrame([(1, 1, None, 0, 5), (1, 1, None, 0, 5), (1, 2, 9, 3, 1), (2, 1, 2, 0, 1), (2, 2, 1, 0, 1)], "trace_id long, span_id long, parent_id long, start_us long, end_us long")
    got = {(r["trace_id"], r["rule"]) for r in validate.span_violations(s).collect()}
    assert got == {(1, "duplicate_span_id"), (1, "negative_duration"), (1, "missing_parent"), (2, "cycle")}
    assert validate.span_violations(s.limit(0)).count() == 0


def test_planner(spark):
    reg = metrics.built_in()
    assert [m.name for m in reg.select(" LLM_calls, plan_efficiency,llm_calls")] == ["llm_calls", "plan_efficiency"]
    with pytest.raises(ValueError, match="unknown"):
        reg.select("nothing")
    with pytest.raises(ValueError, match="registered"):
        reg.register(reg.get("llm_calls"))
    spans = spark.createDataFrame([("a", "llm", 2, 1), ("a", "llm", 1, 2), ("b", "tool", 1, 3)], "trace_id string, span_type string, start_us long, span_id long")
    got = {r["trace_id"]: r for r in planner.plan(spans, spans, planner.targets(spark, [reg.get("llm_calls")])).collect()}
    assert got["a"]["span_ids"] == [2, 1] and got["a"]["skip_reason"] is None
    assert got["b"]["skip_reason"] == 'No spans found for target span type "llm".'


def test_store(spark, tmp_path):
    st = store.Store(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    st.commit({"t": df})
    st.append({"t": spark.createDataFrame([(3, "c")], "id int, v string"), "u": df})
    assert st.table("t").count() == 3 and st.table("u").count() == 2
    new = spark.createDataFrame([(1, None), (4, "d")], "id int, v string")
    assert {tuple(r) for r in store.upserted(df, new, ["id"]).collect()} == {(1, "a"), (2, None), (4, "d")}
    merged = df.select(store.merged_json(F.lit('{"a": 1, "b": 2}'), F.lit('{"b": 3}')).alias("x")).first()["x"]
    assert merged == '{"a":1,"b":3}'


def test_plan_rules(spark):
    kind = "trace_id string, plan_id string, supersedes string, steps array<struct<id:string,depends_on:array<string>>>"
    chain = [(str(i), [str(i + 1)] if i < 9 else []) for i in range(10)]
    plans = spark.createDataFrame(
        [
            ("good", "p", None, chain), ("good", "q", "p", [("a", None), ("b", ["a"])]), ("good", "r", None, []),
            ("circle", "p", None, [("a", []), ("b", ["a", "d"]), ("c", ["b"]), ("d", ["c"])]), ("self", "p", None, [("a", ["a"])]),
            ("lacks", "p", None, [("a", ["z"]), ("b", ["a"])]), ("turns", "p", "q", []), ("turns", "q", "p", []), ("turns", "r", None, []),
        ],
        kind,
    )
    assert {tuple(r) for r in validate.plan_violations(plans).collect()} == {("circle", "dependency_cycle", "p"), ("self", "dependency_cycle", "p"), ("lacks", "unknown_dependency", "p"), ("turns", "plan_cycle", "p"), ("turns", "plan_cycle", "q")}
    steps = spark.createDataFrame([("good", "1", "p", "3"), ("good", "2", None, None), ("good", "3", "p", None), ("good", "4", "x", None), ("good", "5", "q", "z"), ("good", "6", None, "a")], "trace_id string, step_id string, plan_id string, planned_step_id string")
    assert {tuple(r)[1:] for r in validate.step_plan_violations(steps, plans).collect()} == {("unknown_plan", "4"), ("unknown_planned_step", "5"), ("unknown_planned_step", "6")}


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_quantiles(spark, monkeypatch, few):
    """By one window and by ranges; null keys, null and repeated values, groups of one and of nulls only."""
    monkeypatch.setattr(stats, "FEW", few)
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)])) for _ in range(600)] + [("one", 7), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = {r["k"]: (r["a"], r["b"], r["c"]) for r in stats.quantiles(df, ["k"], "v", {"a": 0.0, "b": 0.3, "c": 0.95}).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for k, found in got.items():
        assert found == pytest.approx(tuple(np.quantile([v for g, v in rows if g == k and v is not None], [0, 0.3, 0.95])))
    assert [tuple(r) for r in stats.quantiles(df, [], "v", {"m": 0.5}).collect()] == [(pytest.approx(np.median([v for _, v in rows if v is not None])),)]
    assert [tuple(r) for r in stats.quantiles(df.where("false"), [], "v", {"m": 0.5}).collect()] == [(None,)]
    full = {r["k"]: r.asDict() for r in stats.score_stats(df, ["k"], "v").collect()}
    assert full["none"]["median"] is None and full["none"]["n"] == 0 and full[None]["p25"] is not None and full["one"]["stddev"] is None
    ranks = {r["k"]: (r["p50"], r["p95"], r["over"], r["n"]) for r in analysis.nearest_rank(df.where("v is not null"), ["k"], "v", [50, 95], 30).collect()}
    for k, found in ranks.items():
        v = sorted(x for g, x in rows if g == k and x is not None)
        assert found == (v[-(-len(v) * 50 // 100) - 1], v[-(-len(v) * 95 // 100) - 1], sum(x > 30 for x in v), len(v))


@pytest.mark.parametrize("own", [False, True])
def test_dense_search(spark, monkeypatch, own):
    """Blocks of a few vectors against all pairs: copies, ties, two widths, vectors without a direction."""
    for name, value in {"QUERY_BLOCK": 3, "BLOCK": 7, "HELD": 2}.items():
        monkeypatch.setattr(retrieval, name, value)
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=4 if i % 5 else 6).round(1).tolist() for i in range(90)]
    vectors = {i: v for i, v in enumerate(vectors + vectors[:40] + [[0.0] * 4, None, [float("nan")] * 4, [None, 1.0, 1.0, 1.0], []])}
    df = spark.createDataFrame([(i, v, f"l{i % 3}") for i, v in vectors.items()], "vec_id long, embedding array<double>, label string").repartition(5)
    got = retrieval.dense_top(df.where("vec_id % 4 = 0"), df, 6, own).collect()
    fine = {i: np.array(v) for i, v in vectors.items() if v and None not in v and np.isfinite(v).all() and any(v)}
    want = set()
    for q in [i for i in fine if i % 4 == 0]:
        scored = sorted((-round(float(fine[q] @ v / np.sqrt((fine[q] @ fine[q]) * (v @ v))), 6), i) for i, v in fine.items() if len(v) == len(fine[q]) and (own or i != q))
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:6], 1)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want
    assert all(r["label"] == f"l{r['vec_id'] % 3}" and r["q_label"] == f"l{r['query_id'] % 3}" for r in got)
    assert retrieval.dense_top(df.where("false"), df, 6).collect() == []


def test_names_and_clients_by_row(spark):
    """Columns of lists and of clients give what the registry gives for one; null lists and clients give null."""
    built_in = metrics.built_in()
    df = spark.createDataFrame([(" LLM_calls,, llm_calls,nope", ["judge"]), ("", []), (None, None), ("plan_matching", ["claim_extractor", "judge"])], "names string, clients array<string>")
    got = df.select(built_in.keys_of(F.col("names")).alias("keys"), built_in.allowed(F.col("clients")).alias("allowed"), "clients").withColumn("known", built_in.known(F.col("keys"))).collect()
    assert [r["keys"] for r in got] == [["llm_calls", "nope"], [], None, ["plan_matching"]]
    assert [r["known"] for r in got] == [["llm_calls"], [], None, ["plan_matching"]]
    assert [r["allowed"] for r in got] == [None if r["clients"] is None else built_in.available(set(r["clients"])) for r in got]
