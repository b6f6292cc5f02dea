"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each present or not: its words, pairs of neighbours and pairs with one word between, hashed into
2^18 places. FTRL-proximal keeps for each place the sum of gradients and of their squares; the latter set the place's
own learning rate, the L1 term leaves places at exactly zero, so that the weights sent to the executors are few.

Learning takes a bounded sample: about ``SAMPLE`` labelled rows chosen by a hash of the id, whole texts, and of these so
many that they have about ``MAX_PLACES`` features in all; one task learns.

Edge cases: null and empty texts get the score of the bias alone; labels that are null are not learned from; without
labels all scores are 0.5; repeated rows each get a row, repeated labels are each learned from; other columns may have
any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from .common import col, crc_mod, drop_staged, hash_share, mix64, plain, sliced, small_batches, staged, with_fields

BITS = 18
#: Labelled rows learned from, about; passes over them; the rate, its offset, the L1 and L2 terms, a toxic row's weight.
SAMPLE, PASSES, ALPHA, BETA, L1, L2, POSITIVE = 16000, 8, 4.0, 1.0, 16.0, 1.0, 3.0
THRESHOLD = 0.7
#: Features that the learning task holds, about: 4 bytes each.
MAX_PLACES = 60_000_000
#: Words whose hashes a worker remembers.
MAX_WORDS = 150_000
WORDS = regex.compile(r"[\p{L}\p{N}']+")


class Features:
    def __init__(self) -> None:
        self.words: dict[str, int] = {}

    def hashes(self, text: str) -> np.ndarray:
        words = WORDS.findall(text.lower())
        known = self.words
        found = list(map(known.get, words))
        if None in found:
            if len(known) > MAX_WORDS:
                known.clear()
            for i, h in enumerate(found):
                if h is None:
                    w = words[i]
                    found[i] = known[w] = xxhash.xxh3_64_intdigest(w)
        return np.array(found, np.uint64)

    def places(self, text: str) -> np.ndarray:
        """The places of all features, with repeats."""
        h = self.hashes(text) if text else np.zeros(0, np.uint64)
        grams = [h, h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:], h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]]
        return (mix64(np.concatenate(grams)) >> np.uint64(64 - BITS)).astype(np.int32)


def learn(rows: list[tuple[int, np.ndarray]], passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over (label, places) rows; the places with weights, and these; the bias is at place 2^BITS."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= L1, 0.0, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(passes):
        for label, places in rows:
            zs, ns = z[places], n[places]
            w = weights(zs, ns)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * (POSITIVE if label else 1.0)
            rate = (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA
            z[places] = zs + g - rate * w
            n[places] = ns + g * g
    w = weights(z, n)
    at = np.flatnonzero(w)
    return at, w[at]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from labelled rows (labels: doc_id, toxic; null ids and labels left out)."""
    labels = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    total = labels.count()
    weights = np.zeros((1 << BITS) + 1)
    if not total:
        return weights
    chosen = labels.where(hash_share(F.col("doc_id"), 8) < min(1.0, sample / total))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for batch in sliced(batches):
            got = [np.append(np.unique(make.places(t or "")), 1 << BITS).astype(np.int32).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.binary())], ["share", "toxic", "places"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for label, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.append((label, np.frombuffer(places, np.int32)))
        order = sorted(range(len(rows)), key=lambda i: xxhash.xxh3_64_intdigest(rows[i][1].tobytes()))
        at, w = learn([rows[i] for i in order])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(w)], ["place", "weight"])

    # the sample is bounded, so its labels can be broadcast and one task can learn from it
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(hash_share(F.col("doc_id"), 9).alias("share"), "toxic", "text")
    made = staged(joined.mapInArrow(features, "share double, toxic int, places binary"), "features")
    places = made.agg(F.sum(F.length("places")).alias("n")).first()["n"] or 0
    held = made.where(F.col("share") < min(1.0, 4 * MAX_PLACES / max(1, places)))
    with small_batches(docs.sparkSession):
        found = held.select("toxic", "places").repartition(1).mapInArrow(fit, "place long, weight double").collect()
    drop_staged(made)
    for row in found:
        weights[row["place"]] = row["weight"]
    return weights


def score(df: DataFrame, weights: np.ndarray, keep: list[str] | None = None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``keep`` columns, then score and predicted for each row, their names after ``prefix``; one pass, no shuffle."""
    keep = ["doc_id"] if keep is None else keep
    at = np.flatnonzero(weights)
    shared = df.sparkSession.sparkContext.broadcast((at, weights[at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, w = Features(), np.zeros((1 << BITS) + 1)
        places, values = shared.value
        w[places] = values
        used, bias = w != 0, w[1 << BITS]
        for batch in sliced(batches):
            sums = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                p = make.places(text or "")
                sums.append(bias + w[np.unique(p[used[p]])].sum())
            s = 1 / (1 + np.exp(-np.clip(np.array(sums), -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], schema.names)

    schema = with_fields(df, keep, (f"{prefix}score", DoubleType()), (f"{prefix}predicted", IntegerType()))
    return plain(df, keep, col(text_col)).mapInArrow(run, schema)


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents, learned only from rows whose crc32(doc_id) mod 3 is not 1."""
    weights = train(docs, labels.where(crc_mod("doc_id", 3) != 1))
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return score(docs, weights).select("doc_id", held.alias("held_out"), "score", "predicted")
