"""Nearest neighbours by cosine: a vantage-point tree in each shard, pruned by the triangle inequality.

Distances are between unit vectors, so that the nearest by distance are the nearest by cosine. At a node with vantage
point v and radius r, the inside is skipped if d(q, v) - r, and the outside if r - d(q, v), exceeds ``factor`` times the
distance of the k-th nearest so far. Factor one gives exact results; smaller ones prune more.

A task gets the rows of a shard, builds their tree, and then streams the queries past it in blocks; the k best of all
shards are chosen by a window. Trees are neither stored nor sent. Scores are dot(a, b) / sqrt(dot(a, a) * dot(b, b)), in double precision, dimension after dimension, so equal vectors have equal
scores; ties go to the smaller id.

Edge cases: null vectors, empty ones, those of only zeros, with null or non-finite components, or of another length than
most have no part; rows with a null id neither; rows that share an id are each found, but never for a query of that id.
Ids are whole numbers; other columns are left out and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col

#: Rows in a shard, about, and in a block of queries; blocks searched for together; shards at least; rows in a leaf.
SHARD, BLOCK, TOGETHER, LEAST_SHARDS, LEAF = 32768, 256, 32, 12, 128
#: Tasks that search, at most.
MOST_TASKS = 8192


def slack(width: int) -> float:
    """What rounding can add to a gap and take from a reach. A product of unit vectors is off by up to (2 * width + 8) half
    units in the last place; its distance, a square root, by the root of twice that near zero; three distances are compared."""
    return 3 * float(np.sqrt(2 * (2 * width + 8) * 2.0**-53))


class Tree:
    """A vantage-point tree: parts are split at the median distance by rank, so equal points do no harm."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.squares = squares(self.vectors)
        self.unit = self.vectors / np.sqrt(self.squares)[:, None]
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray) -> int:
        at = len(self.nodes)
        if len(rows) <= LEAF:
            self.nodes.append((rows,))
            return at
        self.nodes.append(())
        sample = self.unit[rows[:: max(1, len(rows) // 16)][:16]]
        spread = np.sqrt(np.maximum(0, 2 - 2 * self.unit[rows[:: max(1, len(rows) // 64)][:64]] @ sample.T)).std(axis=0)
        v = rows[:: max(1, len(rows) // 16)][int(spread.argmax())]
        d = np.sqrt(np.maximum(0, 2 - 2 * (self.unit[rows] @ self.unit[v])))
        half = len(rows) // 2
        by = np.argpartition(d, half)
        inside, outside = rows[by[:half]], rows[by[half:]]
        low, high = float(d[by[:half]].max()), float(d[by[half:]].min())
        self.nodes[at] = (int(v), low, high, self._build(inside), self._build(outside))
        return at

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best for each query, best first; -1 where there are fewer."""
        self.q, self.q_ids, self.q_squares = queries, ids, squares(queries)
        self.q_unit = queries / np.sqrt(self.q_squares)[:, None]
        self.best_ids = np.full((len(ids), k), -1, np.int64)
        self.best = np.full((len(ids), k), -np.inf)
        self.k, self.factor, self.slack = k, factor, slack(queries.shape[1])
        self.rounding = 8 * (2 * queries.shape[1] + 8) * 2.0**-53
        if len(ids) and len(self.ids):
            self._visit(self.root, np.arange(len(ids)))
        return self.best_ids, self.best

    def _reach(self, rows: np.ndarray) -> np.ndarray:
        """The distance of the k-th best so far."""
        kth = self.best[rows, -1]
        return np.where(np.isfinite(kth), np.sqrt(np.maximum(0, 2 - 2 * np.maximum(kth, -1))), np.inf)

    def _visit(self, node: int, rows: np.ndarray) -> None:
        part = self.nodes[node]
        if len(part) == 1:
            self._leaf(part[0], rows)
            return
        v, low, high, inside, outside = part
        d = np.sqrt(np.maximum(0, 2 - 2 * (self.q_unit[rows] @ self.unit[v])))
        near = d <= (low + high) / 2
        for first in (True, False):  # each query's own side first, then the other with what is known by then
            for child, own in ((inside, near), (outside, ~near)):
                mine = own if first else ~own
                gap = d - low if child == inside else high - d
                go = mine & (gap <= self.factor * self._reach(rows) + self.slack)
                if go.any():
                    self._visit(child, rows[go])

    def _leaf(self, points: np.ndarray, rows: np.ndarray) -> None:
        """Products of unit vectors tell, but for rounding, which points can be among a query's k best of the leaf and of
        those before; only these are scored exactly."""
        k = self.k
        for first in range(0, len(rows), 1024):
            r = rows[first : first + 1024]
            about = self.q_unit[r] @ self.unit[points].T
            about[self.q_ids[r][:, None] == self.ids[points][None, :]] = -np.inf
            least = self.best[r, -1]
            if len(points) > k and not np.isfinite(least).all():
                least = np.maximum(least, np.partition(about, len(points) - k, axis=1)[:, len(points) - k])
            at, of = np.nonzero(about >= np.maximum(least - self.rounding, -2.0)[:, None])
            if not len(at):
                continue
            score = pair_cosines(self.q[r], self.q_squares[r], self.vectors[points], self.squares[points], at, of)
            better = score >= self.best[r[at], -1]
            at, of, score = at[better], of[better], score[better]
            row = np.concatenate([np.repeat(np.arange(len(r)), k), at])
            scores, ids = np.concatenate([self.best[r].ravel(), score]), np.concatenate([self.best_ids[r].ravel(), self.ids[points][of]])
            by = np.lexsort((ids, -scores, row))
            starts = np.searchsorted(row[by], np.arange(len(r)))
            top = by[starts[:, None] + np.arange(k)[None, :]]
            self.best[r] = scores[top]
            self.best_ids[r] = np.where(np.isfinite(scores[top]), ids[top], -1)


def squares(x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * x[:, j]
    return total


def cosines(q: np.ndarray, q_squares: np.ndarray, x: np.ndarray, x_squares: np.ndarray) -> np.ndarray:
    total = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        total += q[:, j][:, None] * x[:, j][None, :]
    return np.clip(total / np.sqrt(q_squares[:, None] * x_squares[None, :]), -1.0, 1.0)


def pair_cosines(q: np.ndarray, q_squares: np.ndarray, x: np.ndarray, x_squares: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """``cosines`` of the pairs (at, of) alone, the same sums in the same order."""
    total = np.zeros(len(at))
    for first in range(0, len(at), 8192):  # a running sum adds one after another
        some = slice(first, first + 8192)
        total[some] = np.cumsum(q[at[some]] * x[of[some]], axis=1)[:, -1]
    return np.clip(total / np.sqrt(q_squares[at] * x_squares[of]), -1.0, 1.0)


def usable(vector: Column) -> Column:
    """Vectors with only finite components, not all of them zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(df: DataFrame, is_query: Column, k: int = 5, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each query row among all other rows."""
    rows = df.select(col(id_col).cast("long").alias("vec_id"), col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asking"))
    most = sizes.orderBy(F.desc("n"), "width").first()
    width, total, asking = most or (1, 0, 0)
    shards, blocks = max(LEAST_SHARDS, -(-total // SHARD)), max(1, -(-asking // BLOCK))
    rows = rows.where(F.size("v") == width)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, vectors, tree = None, [], [], None
        for batch in batches:
            at, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(at)]
            for first, last in zip(cuts, cuts[1:], strict=False):
                if at[first] != shard:
                    shard, ids, vectors, tree = at[first], [], [], None
                for start in range(first, last, TOGETHER if kind[first] else last):
                    part = batch.slice(start, min(TOGETHER, last - start) if kind[first] else last - first)
                    some, v = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                    if not kind[first]:
                        ids.append(some)
                        vectors.append(v)
                        continue
                    if tree is None:
                        tree = Tree(np.concatenate(ids), np.concatenate(vectors)) if ids else Tree(np.zeros(0, np.int64), np.zeros((0, width)))
                    found, score = tree.search(some, v, k, factor)
                    ok = found >= 0
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, k).reshape(-1, k)[ok]), pa.array(found[ok]), pa.array(score[ok])], ["query_id", "vec_id", "score"])

    kept = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), F.array("vec_id").alias("ids"), "v")
    asked = rows.where("asks").groupBy(F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("vec_id", "v")).alias("q"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), F.col("q.vec_id").alias("ids"), F.flatten("q.v").alias("v"))
    # a shard's rows first, then the queries
    met = kept.union(asked).repartition(min(4 * shards, MOST_TASKS), "shard").sortWithinPartitions("shard", "kind")
    found = met.mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_query(embeddings: DataFrame) -> DataFrame:
    """The five nearest of every row whose id is divisible by 50, exactly (factor one)."""
    return nearest(embeddings, F.col("vec_id") % 50 == 0, 5, 1.0)


#: DuckDB SQL for ``nearest_query``'s rows.
NEAREST_SQL = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_cosine_similarity(q.v, c.v) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
