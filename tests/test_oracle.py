"""Every query against its DuckDB SQL."""

import hashlib
import os

import duckdb
import pytest

from tests.conftest import DATA
from tracemill.queries import oracle_sql, queries

TABLES = [f[: -len(".parquet")] for f in os.listdir(DATA) if f.endswith(".parquet")] if os.path.isdir(DATA) else []


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return bool(x)
    if hasattr(x, "item"):
        x = x.item()
    return float(x) if isinstance(x, int | float) else x


def rows(frame):
    cols = sorted(frame.columns)
    f = frame[cols].astype(object)
    return cols, sorted(repr([plain(x) for x in r]) for r in f.where(frame[cols].notna(), None).values.tolist())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not TABLES, reason="no tables")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, duck, name):
    ours, theirs = rows(queries()[name](spark, DATA).toPandas()), rows(duck.execute(oracle_sql()[name]).fetchdf())
    assert ours == theirs


def test_degraded(spark):
    found = queries()["r06_degraded"](spark, DATA).toPandas()
    assert not found.duplicated(["q", "i"]).any()
    assert 0.25 < found["swapped"].mean() < 0.55


@pytest.mark.skipif(not TABLES, reason="no tables")
@pytest.mark.parametrize("name, key, ids", [("c10_flatten", "event_id", "SELECT event_id FROM events"), ("b17_report", "run_id", "SELECT o_orderkey FROM orders"), ("a19_truths_of_sample", "item_id", "SELECT DISTINCT item_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")])
def test_whole_tables(spark, duck, name, key, ids):
    found = queries()[name](spark, DATA).select(key).collect()
    assert sorted(r[0] for r in found) == sorted(r[0] for r in duck.execute(ids).fetchall())


def test_display_of_whole_texts(spark, tmp_path):
    texts = ["", " ", "\n\t", "  two words ", "\u00a0\u3000x y\u2028", "\x0b\x1c\x85z\n\n", "a", "\n b\n\nc \n", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["shown"] for r in queries()["c20_display"](spark, str(tmp_path)).collect()}
    want = {i: hashlib.md5(((t or "").strip() or "<empty>").encode()).hexdigest() for i, t in enumerate(texts)}
    theirs = duckdb.sql(oracle_sql()["c20_display"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert found == want == dict(theirs)
