"""Trees by pointer doubling against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import trees

SPAN = "trace_id long, span_id long, parent_id long, start_us long, end_us long, span_type string"


def by_hand(rows):
    """(depth, root, top) of the spans that a root reaches, and their depth-first numbers."""
    found, numbers = {}, {}
    for trace in {r[0] for r in rows}:
        children = {}
        for r in sorted((r for r in rows if r[0] == trace), key=lambda r: (r[3], r[4], r[5], r[1])):
            children.setdefault(r[2], []).append(r[1])
        todo = [(s, 0, s, None) for s in reversed(children.get(None, []))]
        while todo:
            s, depth, root, top = todo.pop()
            found[trace, s], numbers[trace, s] = (depth, root, top), sum(t == trace for t, _ in found)
            todo += [(c, depth + 1, root, top if top is not None else c) for c in reversed(children.get(s, []))]
    return found, numbers


def forest(rng, traces, size):
    rows = []
    for t in range(traces):
        ids = rng.sample(range(1000), size)
        for i, s in enumerate(ids):
            parent = None if i == 0 or rng.random() < 0.1 else 5000 if rng.random() < 0.05 else rng.choice(ids[max(0, i - 3) : i])
            rows.append((t, s, parent, rng.randrange(5), rng.randrange(5), rng.choice("ab")))
    return rows


def test_forests(spark):
    rows = forest(random.Random(1), 6, 40)
    want, numbers = by_hand(rows)
    got = trees.walked(spark, spark.createDataFrame(rows, SPAN), numbers=True).collect()
    assert {(r["trace_id"], r["span_id"]): (r["depth"], r["root"], r["top"]) for r in got} == want
    numbers = {k: n + 1 for k, n in numbers.items()}
    assert {(r["trace_id"], r["span_id"]): r["number"] for r in got} == numbers
    up = {(r[0], r[1]): r[2] for r in rows}
    for r in got:  # a subtree has a range of numbers of its own
        inside = {(t, s) for t, s in numbers if t == r["trace_id"] and r["number"] <= numbers[t, s] < r["number"] + r["size"]}
        below = {(r["trace_id"], r["span_id"])}
        while more := {x for x in numbers if x not in below and (x[0], up[x]) in below}:
            below |= more
        assert inside == below


@pytest.mark.parametrize("comb", [False, True])
def test_chain_and_comb_of_many_spans(spark, comb):
    """100,000 spans below each other, or every other one a leaf beside the chain: numbers and sizes by rule."""
    n = 100_000
    i = F.col("id")
    up = F.when(i % 2 == 1, i - 1).otherwise(i - 2) if comb else i - 1
    df = spark.range(n).select(F.lit(1).alias("trace_id"), i.alias("span_id"), F.when(i > 0, up).alias("parent_id"), i.alias("start_us"), i.alias("end_us"), F.lit("x").alias("span_type"))
    got = trees.walked(spark, df, numbers=True)
    # a leaf i of the comb stands before the chain's next span i + 1, as it starts earlier
    size = F.when(F.col("span_id") % 2 == 1, 1).otherwise(n - F.col("span_id")) if comb else n - F.col("span_id")
    depth = F.ceil(F.col("span_id") / 2) if comb else F.col("span_id")
    assert got.where((F.col("number") == F.col("span_id") + 1) & (F.col("size") == size) & (F.col("depth") == depth)).count() == n


def test_long_chains(spark):
    rows = [(1, i, i - 1 if i else None, 0, 0, "x") for i in range(10_000)]
    rows += [(2, i, (i + 1) % 300, 0, 0, "x") for i in range(300)] + [(2, 300 + i, 299 + i, 0, 0, "x") for i in range(50)] + [(2, 900, None, 0, 0, "x"), (2, 901, 900, 0, 0, "x")]
    df = spark.createDataFrame(rows, SPAN)
    assert sorted((r["trace_id"], r["span_id"]) for r in trees.cycles(df).collect()) == [(2, i) for i in range(350)]
    got = {r["span_id"]: (r["depth"], r["root"], r["top"]) for r in trees.walked(spark, df.where("trace_id = 1")).collect()}
    assert got == {i: (i, 0, None if i == 0 else 1) for i in range(10_000)}


@pytest.mark.parametrize("rows", [[], [(1, 1, None, 0, 0, "x")], [(1, 1, 1, 0, 0, "x")], [(1, 2, 1, 0, 0, "x")], [(1, 1, None, 0, 0, "x"), (1, 1, None, 0, 0, "x")]])
def test_small(spark, rows):
    df = spark.createDataFrame(rows, SPAN)
    assert {(r["trace_id"], r["span_id"]) for r in trees.walked(spark, df).collect()} == set(by_hand(rows)[0])
    assert trees.cycles(df).count() == sum(r[1] == r[2] for r in rows)
