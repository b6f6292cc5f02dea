"""Queries of dense search hold every id divisible by 25 against all other rows: plain versions, and their SQL."""

import duckdb
import numpy as np
import pytest

from tracemill.queries import oracle_sql, queries

IDS = range(180)
LABELS = [f"l{i * i % 5}" for i in IDS]
ASKED = [0, 25, 50, 75, 100, 125, 150, 175]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """(folder, each asked id's others, nearest first, as (id, score))"""
    folder = str(tmp_path_factory.mktemp("dense"))
    v = np.random.default_rng(5).normal(size=(len(IDS), 6))
    spark.createDataFrame([(i, v[i].tolist(), LABELS[i]) for i in IDS], "vec_id long, embedding array<double>, label string").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    score = lambda q, i: round(float(v[q] @ v[i] / np.sqrt((v[q] @ v[q]) * (v[i] @ v[i]))), 6)
    return folder, {q: [(i, -s) for s, i in sorted((-score(q, i), i) for i in IDS if i != q)] for q in ASKED}


def found(spark, folder, name):
    """Rows of the query and of its SQL, which must be equal."""
    ours = queries()[name](spark, folder)
    sql = oracle_sql()[name].replace("FROM embeddings", f"FROM '{folder}/embeddings.parquet/*.parquet'")
    theirs = duckdb.sql(f"SELECT {', '.join(f'"{c}"' for c in ours.columns)} FROM ({sql})").fetchall()
    rows = [tuple(r) for r in ours.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, theirs))
    return rows


def test_cosine_asks_every_25th(spark, small):
    folder, near = small
    assert set(found(spark, folder, "r03_cosine")) == {(q, i, s) for q in ASKED for i, s in near[q][:5]}


def test_top_50_asks_every_25th(spark, small):
    folder, near = small
    assert set(found(spark, folder, "g02_dense_top50")) == {(q, i, r) for q in ASKED for r, (i, _) in enumerate(near[q][:50], 1)}


def flags(near, q):
    return [LABELS[i] == LABELS[q] for i, _ in near[q][:10]]


def test_flagship_asks_every_25th(spark, small):
    folder, near = small
    recalls = [sum(flags(near, q)) / (LABELS.count(LABELS[q]) - 1) for q in ASKED]
    [row] = found(spark, folder, "flagship")
    assert row[:5] == (len(ASKED), len(ASKED), 0, len(ASKED), pytest.approx(np.mean(recalls), abs=1e-6)) and max(recalls) in [pytest.approx(x, abs=1e-6) for x in row[5:]]


def counts(near):
    """(id, matched, predicted, relevant): every fourth found nothing, every third has nothing relevant."""
    for q in ASKED:
        none, empty = q % 3 == 0, q % 4 == 0
        yield q, 0 if none or empty else sum(flags(near, q)), 0 if empty else 10, 0 if none else LABELS.count(LABELS[q]) - 1


def test_set_precision_asks_every_25th(spark, small):
    folder, near = small
    want = {(q, "Nothing selected, so precision is undefined." if relevant and not predicted else None, m / predicted if predicted else None if relevant else 1.0) for q, m, predicted, relevant in counts(near)}
    assert set(found(spark, folder, "m04_set_precision")) == want


def test_set_recall_asks_every_25th(spark, small):
    folder, near = small
    want = {(q, None if relevant else "No relevant IDs, so recall is undefined.", round(m / relevant, 6) if relevant else None) for q, m, _, relevant in counts(near)}
    assert set(found(spark, folder, "m06_set_recall")) == want


def test_ndcg_asks_every_25th(spark, small):
    folder, near = small
    gain = lambda hits: sum(x / np.log2(r + 1) for r, x in enumerate(hits, 1))
    want = {q: pytest.approx(gain(flags(near, q)) / gain([1] * min(relevant, 10)), abs=1e-6) for q, _, predicted, relevant in counts(near) if predicted and relevant}
    assert dict(found(spark, folder, "m08_ndcg")) == want


def test_confusion_asks_every_25th(spark, small):
    folder, near = small
    assert set(found(spark, folder, "h02_confusion")) == {(q, m, predicted - m, relevant - m) for q, m, predicted, relevant in counts(near)}


def test_precision_at_k_asks_every_25th(spark, small):
    folder, near = small
    want = {(q, r, sum(flags(near, q)[:r]), round(sum(flags(near, q)[:r]) / r, 6)) for q in ASKED for r in range(1, 11)}
    assert set(found(spark, folder, "f03_precision_at_k")) == want


def test_contextual_precision_asks_every_25th(spark, small):
    folder, near = small
    at = {q: [sum(flags(near, q)[:r]) / r for r in range(1, 11) if flags(near, q)[r - 1]] for q in ASKED}
    assert dict(found(spark, folder, "m12_contextual_precision")) == {q: pytest.approx(np.mean(x) if x else 0, abs=1e-6) for q, x in at.items()}


def test_echo_mismatches_ask_every_25th(spark, small):
    folder, near = small
    assert set(found(spark, folder, "m13_echo_mismatches")) == {(q, sum(i % 3 == 0 for i, _ in near[q][:10])) for q in ASKED}
