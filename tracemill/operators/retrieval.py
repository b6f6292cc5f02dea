"""Exact hybrid retrieval: cosine, BM25, reciprocal-rank fusion."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.scores import dot
from tracemill.functions.stemming import with_stems
from tracemill.functions.text import bm25_tokens
from tracemill.staging import arrow_rows, drop_staged, staged

K1, B, RRF = 1.2, 0.75, 60
#: Rows of a block of queries, of candidates; blocks of queries that a task holds the best of at once; further ones kept.
QUERY_BLOCK, BLOCK, HELD, SPARE = 512, 4096, 64, 8
#: Queries' terms are sent to all executors if there are at most so many; documents' terms that a task scores, about.
TERMS, SCORED = 1_000_000, 50_000


def top_k(scored: DataFrame, k: int, key: str = "query_id", item: str = "vec_id") -> DataFrame:
    """The k best of each query, ties to the smaller id; Spark limits each task's rows before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), item)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def matrices(df: DataFrame, rows: int) -> DataFrame:
    """(width, ids, unit): vectors (id, v) of one width in blocks of up to ``rows``, at length one, as float64.

    Vectors that are null, zero, or hold null or non-finite components take no part.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def block(width: int) -> pa.RecordBatch:
            ids, vectors = held.pop(width)
            return pa.RecordBatch.from_arrays([pa.array([width]), pa.array([ids], pa.list_(pa.int64())), pa.array([np.stack(vectors).tobytes()], pa.binary())], ["width", "ids", "unit"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not v.is_valid or v.values.null_count or not len(v.values):
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                norm = np.sqrt((x * x).sum())
                if not np.isfinite(norm) or norm == 0:
                    continue
                ids, vectors = held.setdefault(len(x), ([], []))
                ids.append(i)
                vectors.append(x / norm)
                if len(ids) == rows:
                    yield block(len(x))
        for width in list(held):
            yield block(width)

    return df.where("id IS NOT NULL").select(F.col("id").cast("long"), "v").mapInArrow(pack, "width long, ids array<long>, unit binary")


class Best:
    """The ``k`` best candidates of each query of a block: by score to six digits, ties to the smaller id."""

    def __init__(self, queries: list[int], k: int) -> None:
        self.queries, self.k = queries, k
        self.ids, self.scores = [np.zeros(0, np.int64) for _ in queries], [np.zeros(0, np.int64) for _ in queries]

    def meet(self, ids: np.ndarray, scores: np.ndarray, own: bool) -> None:
        """Scores (queries x ids) of more candidates."""
        rounded = np.rint(scores * 1e6).astype(np.int64)
        for i, query in enumerate(self.queries):
            s = rounded[i]
            if len(s) > self.k + 1:  # one may be the query's own
                at = np.flatnonzero(s >= np.partition(s, len(s) - self.k - 1)[len(s) - self.k - 1])
            else:
                at = np.arange(len(s))
            if not own:
                at = at[ids[at] != query]
            found, value = np.concatenate((self.ids[i], ids[at])), np.concatenate((self.scores[i], s[at]))
            order = np.lexsort((found, -value))[: self.k]
            self.ids[i], self.scores[i] = found[order], value[order]

    def rows(self) -> pa.RecordBatch:
        n = [len(x) for x in self.ids]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(self.queries, np.int64), n)), pa.array(np.concatenate(self.ids)), pa.array(np.concatenate(self.scores))], ["query_id", "vec_id", "about"])


def dense_top(queries: DataFrame, candidates: DataFrame, k: int = 50, own: bool = True) -> DataFrame:
    """(query_id, q_label, vec_id, label, score, rank): each query's ``k`` largest cosines, to six digits, ties to the smaller
    id. queries, candidates: vec_id (whole numbers, unique), embedding, label. Without ``own`` a query's own id is left out.

    Exact search needs each query with each candidate: blocks of queries meet blocks of candidates as products of
    matrices, each task holds the best ``k`` of the block of queries at hand (with ``SPARE`` more, since sums come in
    another order), and only those are scored by the plain formula. Nothing is broadcast, and the plan is the same for
    any number of queries. Vectors meet those of their own width; ones without a direction take no part.
    """
    spark = queries.sparkSession
    shaped = lambda df: df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked, there = (staged(matrices(shaped(df), rows), "blocks") for df, rows in ((queries, QUERY_BLOCK), (candidates, BLOCK)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                width, ids, unit, other_width, other_ids, other = (batch.column(c)[i] for c in range(6))
                if width != other_width:
                    continue
                key = (width.as_py(), ids[0].as_py())
                if key not in held:
                    if len(held) == HELD:  # a block of queries comes again with each row of candidates, or not at all
                        yield from (b.rows() for b in held.values())
                        held.clear()
                    held[key] = Best(ids.as_py(), k + SPARE)
                a, b = (np.frombuffer(x.as_buffer(), np.float64).reshape(-1, key[0]) for x in (unit, other))
                held[key].meet(other_ids.values.to_numpy(), a @ b.T, own)
        yield from (b.rows() for b in held.values())

    pairs = asked.crossJoin(there.select(*[F.col(c).alias(f"c_{c}") for c in there.columns]).hint("shuffle_replicate_nl"))
    with arrow_rows(spark, 16):
        near = staged(pairs.mapInArrow(meet, "query_id long, vec_id long, about long"), "near")
    drop_staged(asked, there)
    few = Window.partitionBy("query_id").orderBy(F.desc("about"), "vec_id")
    near = near.withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + SPARE).select("query_id", "vec_id")
    length = lambda c: dot(F.col(c), F.col(c))
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"), F.col("label").alias("q_label"))
    c = candidates.select("vec_id", "label", F.col("embedding").alias("cv"))
    score = F.round(F.try_divide(dot(F.col("qv"), F.col("cv")), F.sqrt(length("qv") * length("cv"))), 6)
    scored = near.join(q, "query_id").join(c, "vec_id").select("query_id", "q_label", "vec_id", "label", score.alias("score"))
    return top_k(scored, k)


def token_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, len, t): each document's tokens."""
    return docs.select(key, bm25_tokens(F.col(text)).alias("t")).select(key, F.size("t").cast("long").alias("len"), "t")


def term_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, len, term, tf)"""
    return frequencies(token_table(docs, key, text).select(key, "len", F.explode("t").alias("term")), key)


def frequencies(terms: DataFrame, key: str) -> DataFrame:
    return terms.groupBy(key, "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def average_length(lengths: DataFrame) -> DataFrame:
    """(n, avg_len): rows, and the mean of ``len`` to one digit, at least 1."""
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.lit(1.0), F.coalesce(F.bround(F.avg("len"), 1), F.lit(1.0))).alias("avg_len"))


def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", query_key: str = "item_id", text: str = "text", stemmed: bool = False) -> DataFrame:
    """(query_key, key, score): documents that share a term with the query.

    Documents are tokenised once; the terms are narrowed to the queries' before they are counted, by a join on terms; the
    two corpus figures are one row. With ``stemmed`` terms are English stems: each distinct term is stemmed once, and only
    the terms whose stem is asked for meet the documents' tokens. While the queries have at most ``TERMS`` terms, these go to
    where each document's terms lie together, so that a pair's sum is made in place and no pair of a query and a document
    is shuffled.
    """
    asked = queries.select(query_key, F.explode(F.array_distinct(bm25_tokens(F.col(text)))).alias("term"))
    tokens = staged(token_table(docs, key, text), "tokens")
    facts = F.broadcast(average_length(tokens))
    own = tokens.select(key, "len", F.explode("t").alias("term"))
    if stemmed:
        asked = asked.join(with_stems(asked.select("term").distinct()), "term").select(query_key, F.col("stem").alias("term")).distinct()
        named = staged(with_stems(own.select("term").distinct()).join(asked.select(F.col("term").alias("stem")).distinct(), "stem", "left_semi"), "asked")
    else:
        named = staged(asked.select("term").distinct().withColumn("stem", F.col("term")), "asked")
    asked = staged(asked, "queries")
    few = asked.count() <= TERMS
    named = F.broadcast(named) if few or named.count() <= TERMS else named
    wanted = own.join(named, "term").select(key, "len", F.col("stem").alias("term"))
    terms = staged(frequencies(wanted, key), "terms")
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len"))) * idf
    if few:
        terms = terms.repartition(-(-terms.count() // SCORED) or 1, key)
        asked, df = F.broadcast(asked), F.broadcast(df)
    weights = terms.join(df, "term").crossJoin(facts).select("term", key, part.alias("w"))
    return weights.join(asked, "term").groupBy(query_key, key).agg(F.round(F.sum("w"), 6).alias("score"))


def fused(rankings: list[DataFrame], key: str, item: str, k: int = RRF) -> DataFrame:
    """(key, item, score, position): reciprocal-rank fusion of rankings (key, item, rank).

    Ties: the better best rank, then the better ranks in the rankings' order (absent last), then the smaller id.
    """
    rows = reduce(DataFrame.union, [r.select(key, item, "rank", F.lit(i).alias("source")) for i, r in enumerate(rankings)])
    ranks = [F.min(F.when(F.col("source") == i, F.col("rank"))).alias(f"r{i}") for i in range(len(rankings))]
    terms = [F.coalesce(1.0 / (k + F.col(f"r{i}")), F.lit(0.0)) for i in range(len(rankings))]
    one = rows.groupBy(key, item).agg(*ranks).withColumn("score", F.round(reduce(lambda a, b: a + b, terms), 12))
    best = F.least(*[F.coalesce(F.col(f"r{i}"), F.lit(1 << 30)) for i in range(len(rankings))])
    order = Window.partitionBy(key).orderBy(F.desc("score"), best, *[F.asc_nulls_last(f"r{i}") for i in range(len(rankings))], item)
    return one.withColumn("position", F.row_number().over(order)).select(key, item, "score", "position")


def hybrid(dense: DataFrame, sparse: DataFrame, key: str, item: str, top: int = 50, k: int = 10) -> DataFrame:
    """The k best by fusion of the ``top`` best of each ranking (key, item, rank)."""
    return fused([dense.where(F.col("rank") <= top), sparse.where(F.col("rank") <= top)], key, item).where(F.col("position") <= k)


def drawn(seed: int, *parts) -> Column:
    """48 bits of the SHA-256 of the seed and the parts, which any engine can repeat."""
    said = F.concat_ws(":", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(said, 256), 1, 12), 16, 10).cast("long")


def next_prime(n: int) -> int:
    """The least prime from ``n`` on, at least 3."""
    n = max(3, n)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def degraded(results: DataFrame, pool: DataFrame, key: str, item: str, share: float, seed: int) -> DataFrame:
    """Results with ``share`` of each query's items, the fraction by chance, swapped for distinct items outside them.

    pool: (item), all of which can be drawn: a query walks through the numbered pool in steps of its own, from a place of
    its own, modulo a prime, so that no place comes twice; as many steps as it has results, swaps and numbers past the
    pool are sure to meet enough others. No list of all pairs. ``ValueError`` if the pool has less than twice the results.
    """
    results = staged(results, "results")  # what finds them runs once, not for each use below
    pool = shard_numbers(pool.select(item).distinct(), item).select(F.col(item).alias("__new"), F.col("row").alias("__row"))
    sizes = results.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total, most = pool.count(), sizes.agg(F.max("__n")).first()[0] or 0
    if total < 2 * most:
        raise ValueError(f"swaps need at least {2 * most} items, the pool has {total}")
    prime = next_prime(total)
    sizes = sizes.withColumn("__swaps", F.floor(F.col("__n") * share + drawn(seed, key, F.lit("count")) / float(1 << 48)).cast("long"))
    order = Window.partitionBy(key).orderBy(drawn(seed, key, item), item)
    marked = results.withColumn("__o", F.row_number().over(order)).join(sizes.select(key, "__swaps"), key)
    steps = F.sequence(F.lit(0).cast("long"), F.col("__n") + F.col("__swaps") + (prime - total) - 1)
    walk = sizes.where("__swaps > 0").select(key, drawn(seed, key, F.lit("start")).alias("__start"), (1 + F.pmod(drawn(seed, key, F.lit("step")), F.lit(prime - 1))).alias("__step"), F.explode(steps).alias("__j"))
    offered = walk.withColumn("__row", F.pmod(F.pmod("__start", F.lit(prime)) + F.col("__j") * F.col("__step"), F.lit(prime))).join(pool, "__row")
    offered = offered.join(results.select(key, F.col(item).alias("__new")), [key, "__new"], "left_anti")
    new = offered.select(F.col(key).alias("__k"), F.row_number().over(Window.partitionBy(key).orderBy("__j")).alias("__p"), "__new")
    out = marked.join(new, (F.col(key) == F.col("__k")) & (F.col("__o") == F.col("__p")) & (F.col("__o") <= F.col("__swaps")), "left")
    return out.select(key, "rank", F.coalesce("__new", item).alias(item), F.col("__new").isNotNull().alias("swapped"))


def first_evidence(items: DataFrame, root: str, keys: list[str], order: list[str]) -> DataFrame:
    """Each (root, keys) once, at its first place in the order, numbered from 1."""
    first = items.groupBy(root, *keys).agg(F.min(F.struct(*order)).alias("__at"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy(root).orderBy("__at", *keys))).drop("__at")


def shard_numbers(df: DataFrame, key: str, size: int = 2048) -> DataFrame:
    """Rows numbered by key and cut into shards of ``size``.

    Ranges of keys are counted first and each range is numbered by itself, so that no task orders all rows.
    """
    parts = staged(df.repartitionByRange(key).withColumn("__p", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("c"))
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    n = F.row_number().over(Window.partitionBy("__p").orderBy(key)) + F.col("before") - 1
    return parts.join(F.broadcast(before), "__p").withColumn("row", n.cast("long")).withColumn("shard", F.floor(F.col("row") / size)).drop("__p", "before")
