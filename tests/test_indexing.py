"""Request batches and embedding shards that survive a broken run."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill.operators import batches
from tracemill.sources import sinks


def greedy(tokens, most_tokens, most_texts):
    out, batch, size, used = [], -1, 0, 0
    for t in tokens:
        if batch < 0 or size == most_texts or used + t > most_tokens:
            batch, size, used = batch + 1, 0, 0
        size, used = size + 1, used + t
        out.append(batch)
    return out


@pytest.mark.parametrize("n, part", [(0, 5), (1, 5), (5, 5), (6, 5), (137, 5), (96, 96), (300, 97)])
def test_batches(spark, n, part):
    rng = random.Random(n)
    tokens = [rng.choice([1, 1, 2, 7, 40]) for _ in range(n)]
    df = spark.createDataFrame(list(enumerate(tokens)), "id long, cost long")
    texts = min(part, 5)
    got = batches.request_batches(df, "id", F.col("cost"), 20, texts, part).orderBy("id").collect()
    assert [r["row"] for r in got] == list(range(n))
    assert [r["batch"] for r in got] == greedy(tokens, 20, texts)


def test_estimated_tokens(spark):
    rows = spark.createDataFrame([("",), (None,), ("abc",), ("abcd",), ("é" * 8,)], "t string").select(batches.estimated_tokens(F.col("t"))).collect()
    assert [r[0] for r in rows] == [1, 1, 1, 2, 3]


def failing(shard, at):
    """An embedder that fails in one shard, after the others have had time to end; it counts what it was asked for."""

    def run(parts):
        import time

        for b in parts:
            if shard in b.column(0).to_pylist():
                time.sleep(6)
                raise RuntimeError("the service is down")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[float(len(t))] for t in b.column(2).to_pylist()], pa.list_(pa.float32()))], ["shard", "document_id", "embedding"])

    def embed(df):
        at.append(sorted(r[0] for r in df.select("shard").distinct().collect()))
        return df.mapInArrow(run, "shard long, document_id string, embedding array<float>")

    return embed


def test_shards_of_a_broken_run_stay(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i:03}", "x" * i) for i in range(37)], "document_id string, text string")
    folder, spec, asked = str(tmp_path / "shards"), {"model": "m", "width": 1}, []
    with pytest.raises(Exception, match="the service is down"):
        sinks.embed_shards(docs, folder, failing(2, asked), 10, spec)
    there = {r["shard"]: r["count"] for r in spark.read.parquet(folder).groupBy("shard").count().collect()}
    assert there == {0: 10, 1: 10, 3: 7}
    with pytest.raises(ValueError, match="another spec"):
        sinks.embed_shards(docs, folder, failing(-1, asked), 10, {"model": "n", "width": 1})
    with pytest.raises(ValueError, match="another spec"):
        sinks.embed_shards(docs, folder, failing(-1, asked), 5, spec)
    assert sinks.embed_shards(docs, folder, failing(-1, asked), 10, spec) == 1 and asked == [[0, 1, 2, 3], [2]]
    found = {r["document_id"]: r["embedding"][0] for r in spark.read.parquet(folder).collect()}
    assert found == {f"d{i:03}": float(i) for i in range(37)} and spark.read.parquet(folder).count() == 37
