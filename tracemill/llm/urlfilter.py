"""URL filter: listed rules first, then the ratio of two character language models.

Rules have a host and a path; a rule fits its host and all subdomains if the URL's path starts with the rule's, and the
longest fitting rule decides. URLs that a rule decides are the examples, each different one once: those it allows and those it
blocks each give a variable-order Markov model of characters, smoothed towards shorter contexts by Witten-Bell. The other URLs
are judged by the difference of their log-likelihoods per character, against a threshold that best parts the examples kept out
of learning. All examples count, one of ``KEPT`` for the threshold and the others for the models.

A character and its up to ``ORDER`` preceding ones are a run, of which the models' difference is a function: its weight. The models
are tables of runs. URLs are dealt into chunks of bounded length; a chunk is told the weights of its own different runs, so that
a run that nearly all URLs have is told once a chunk. The threshold comes from sums over ranges of ratios.

Edge cases: null URLs, and URLs without ``://``, have empty host and path, so that no rule fits them; a null URL is judged as
the empty text, another by its whole text; without examples of both kinds all URLs that no rule decides are allowed; repeated
rows each get a row.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import col, drop_staged, hash_share, sliced, staged, with_fields

#: (verdict, host, path), fixed by the query's contract.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Longest context; one example of so many is kept for the threshold; runs that ``Ratio`` remembers.
ORDER, KEPT, MAX_KNOWN = 4, 5, 100_000
#: Characters of a chunk, to which each URL adds so many more; runs that a task counts before it passes them on.
CHUNK, A_URL, MOST_RUNS = 1 << 18, 16, 1 << 17
#: Ranges of ratios, and about so many ratios drawn to place their borders: these share out the work, no result depends on them.
RANGES, SAMPLE = 256, 8000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, h + p).otherwise(rule)
        verdict = F.when(fits, said).otherwise(verdict)
    return rule, verdict


class Markov:
    """A character model: each context's counts, mixed with the shorter context's by how many kinds followed.

    This class, ``Ratio`` and ``calibrate`` are the method for texts at hand; ``judged`` does the same over tables.
    """

    def __init__(self, order: int = ORDER):
        self.order, self.counts = order, {}

    def learn(self, text: str) -> None:
        for i, c in enumerate(text):
            for k in range(min(i, self.order) + 1):
                self.counts.setdefault(text[i - k : i], Counter())[c] += 1

    def finish(self) -> Markov:
        self.totals = {c: (sum(n.values()), len(n)) for c, n in self.counts.items()}
        return self

    def share(self, context: str, c: str) -> float:
        p = 1 / 65536
        for k in range(len(context) + 1):
            total = self.totals.get(context[len(context) - k :])
            if total is None:
                break
            n, kinds = total
            p = (self.counts[context[len(context) - k :]].get(c, 0) + kinds * p) / (n + kinds)
        return p


class Ratio:
    """Mean log-likelihood of a character as accepted, less that as rejected."""

    def __init__(self, accepted: Markov, rejected: Markov, threshold: float = 0.0):
        self.accepted, self.rejected, self.threshold = accepted, rejected, threshold
        self.known: dict[str, float] = {}

    def of(self, text: str) -> float:
        total, known = 0.0, self.known
        for i, c in enumerate(text):
            key = text[max(0, i - ORDER) : i + 1]
            d = known.get(key) if i >= ORDER else None
            if d is None:
                context = key[:-1]
                d = math.log(self.accepted.share(context, c)) - math.log(self.rejected.share(context, c))
                if i >= ORDER:
                    if len(known) > MAX_KNOWN:
                        known.clear()
                    known[key] = d
            total += d
        return total / len(text) if text else 0.0


def calibrate(ratio: Ratio, accepted: list[str], rejected: list[str]) -> float:
    """The threshold with the best mean of the two kinds' hit rates; the middle of the gap there."""
    scored = sorted([(ratio.of(u), 1) for u in accepted] + [(ratio.of(u), 0) for u in rejected])
    if not accepted or not rejected:
        return 0.0
    best, at, below = -1.0, 0.0, [0, 0]
    for i in range(len(scored) + 1):
        rate = (below[0] / len(rejected) + (len(accepted) - below[1]) / len(accepted)) / 2
        if (i == 0 or i == len(scored) or scored[i][0] > scored[i - 1][0]) and rate > best:
            low = scored[i - 1][0] if i else scored[0][0] - 1
            high = scored[i][0] if i < len(scored) else scored[-1][0] + 1
            best, at = rate, (low + high) / 2
        if i < len(scored):
            below[scored[i][1]] += 1
    return at


def runs_of(url: str) -> list[str]:
    """Each character of a URL with its up to ``ORDER`` preceding ones."""
    return [url[:i] for i in range(1, min(ORDER, len(url)) + 1)] + [url[i : i + ORDER + 1] for i in range(len(url) - ORDER)]


def chunked(base: DataFrame) -> DataFrame:
    """The rows with a chunk's number each; it holds only where it was written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, length = TaskContext.get().partitionId() << 32, 0
        for batch in sliced(batches):
            chunks = []
            for url in batch.column("url").to_pylist():
                if length >= CHUNK:
                    chunk, length = chunk + 1, 0
                length += len(url or "") + A_URL
                chunks.append(chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunks, pa.int64())], [*batch.schema.names, "chunk"])

    return base.mapInArrow(run, with_fields(base, base.columns, ("chunk", LongType())))


def runs_in_chunks(rows: DataFrame) -> DataFrame:
    """The different runs of each chunk's URLs; one may come again where a chunk's rows were read in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([chunk] * len(met), pa.int64()), pa.array(list(met), pa.string())], ["chunk", "run"])

        chunk, met = None, set()
        for batch in sliced(batches):
            for c, url in zip(batch.column("chunk").to_pylist(), batch.column("url").to_pylist(), strict=True):
                if met and (c != chunk or len(met) > MOST_RUNS):
                    yield told()
                    met = set()
                chunk = c
                met.update(runs_of(url or ""))
        if met:
            yield told()

    return rows.select("chunk", "url").mapInArrow(run, "chunk long, run string")


def runs_counted(examples: DataFrame) -> DataFrame:
    """How often runs come in the examples of either kind, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            met = list(counts["allow"] | counts["block"])
            return pa.RecordBatch.from_arrays([pa.array(met, pa.string()), *(pa.array([counts[kind][r] for r in met], pa.int64()) for kind in ("allow", "block"))], ["run", "allow", "block"])

        counts = {"allow": Counter(), "block": Counter()}
        for batch in sliced(batches):
            for said, url in zip(batch.column("said").to_pylist(), batch.column("url").to_pylist(), strict=True):
                counts[said].update(runs_of(url))
                if len(counts[said]) > MOST_RUNS:
                    yield told()
                    counts = {"allow": Counter(), "block": Counter()}
        if counts["allow"] or counts["block"]:
            yield told()

    return examples.select("said", "url").mapInArrow(run, "run string, allow long, block long")


def weights(counted: DataFrame, asked: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The weight of each run asked for and of its ends, and the staged tables that it is read from.

    A run's share follows from that of its end, the run without its first character: lengths are joined one after the other.
    """
    kinds, length = ("allow", "block"), F.length("run")
    found = counted.unionByName(asked.select("run", *(F.lit(0).cast("long").alias(kind) for kind in kinds)))
    sums = [F.sum(kind).alias(kind) for kind in kinds]
    ends = F.explode(F.transform(F.sequence(F.lit(1), length), lambda k: F.substr(F.col("run"), k)))
    every = found.groupBy("run").agg(*sums).select(ends.alias("run"), *kinds).groupBy("run").agg(*sums)
    context = Window.partitionBy(F.substr(F.col("run"), F.lit(1), length - 1))
    totals = {f"{kind}_n": F.sum(kind).over(context) for kind in kinds} | {f"{kind}_kinds": F.count_if(F.col(kind) > 0).over(context) for kind in kinds}
    tables = [staged(every.withColumns(totals), "runs")]

    def share(kind: str) -> Column:
        n, followed, p = (F.col(f"{kind}_{name}") for name in ("n", "kinds", "end"))
        return F.when(n > 0, (F.col(kind) + followed * p) / (n + followed)).otherwise(p)

    shares = []
    for size in range(1, ORDER + 2):
        rows = tables[0].where(length == size)
        if size == 1:
            rows = rows.withColumns({f"{kind}_end": F.lit(1 / 65536) for kind in kinds})
        else:
            rows = rows.join(shares[-1].select(F.col("run").alias("end"), *(F.col(kind).alias(f"{kind}_end") for kind in kinds)), F.substr(F.col("run"), F.lit(2)) == F.col("end"))
        shares.append(rows.select("run", *(share(kind).alias(kind) for kind in kinds)))
        if size <= ORDER:  # the next length and the result read it
            shares[-1] = staged(shares[-1], "shares")
            tables.append(shares[-1])
    return reduce(DataFrame.union, shares).select("run", (F.log("allow") - F.log("block")).alias("weight")), tables


def scored(rows: DataFrame, told: DataFrame) -> DataFrame:
    """The rows with their ratios: each chunk's URLs meet the weights of its runs."""

    def score(urls: pa.Table, weighed: pa.Table) -> pa.Table:
        known = dict(zip(weighed.column("run").to_pylist(), weighed.column("weight").to_pylist(), strict=True))
        ratios = []
        for url in urls.column("url").to_pylist():
            total = 0.0
            for r in runs_of(url or ""):
                total += known[r]
            ratios.append(total / len(url) if url else 0.0)
        return urls.append_column("ratio", pa.array(ratios, pa.float64()))

    return rows.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(score, StructType([*rows.schema, StructField("ratio", DoubleType())]))


def threshold(held: DataFrame) -> float:
    """``calibrate`` over a table: how many accepted (allow) and rejected (block) examples have each different ratio.

    Hit rates are compared as whole numbers, so that equal ones are equal; of those the smallest threshold counts.
    """
    whole = held.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"), F.count(F.lit(1)).alias("n")).first()
    if not whole["allow"] or not whole["block"]:
        return 0.0
    drawn = sorted(r["ratio"] for r in held.where(hash_share(F.col("ratio"), 10) < SAMPLE / whole["n"]).select("ratio").collect())
    borders = F.array(*map(F.lit, drawn[:: max(1, math.ceil(len(drawn) / RANGES))])).cast("array<double>")
    dealt = held.withColumn("place", F.size(F.filter(borders, lambda b: b <= F.col("ratio"))))
    sums = dealt.groupBy("place").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"), F.min("ratio").alias("least")).orderBy("place").collect()
    starts, allow, block = [], 0, 0
    for r, following in zip(sums, [*sums[1:], None], strict=True):
        starts.append((r["place"], allow, block, following and following["least"]))
        allow, block = allow + r["allow"], block + r["block"]
    starts = held.sparkSession.createDataFrame(starts, "place int, allow_before long, block_before long, following double")
    upto = Window.partitionBy("place").orderBy("ratio")
    below = {kind: F.col(f"{kind}_before") + F.sum(kind).over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for kind in ("allow", "block")}
    gain = below["block"] * F.lit(whole["allow"]) - below["allow"] * F.lit(whole["block"])
    cuts = dealt.join(starts, "place").select(gain.alias("gain"), (-F.col("ratio")).alias("low"), F.coalesce(F.lead("ratio").over(upto), "following", F.col("ratio") + 1).alias("high"))
    best = cuts.agg(F.max(F.struct("gain", "low", "high")).alias("best")).first()["best"]
    if best["gain"] <= 0:
        return sums[0]["least"] - 0.5
    at = (best["high"] - best["low"]) / 2
    return at if at > -best["low"] else best["high"]


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Host, path, rule and verdict for each row, with the ratio."""
    host, path = host_path(F.col("url"))
    base = pages.select(col(id_col).alias("page_id"), col(url_col).alias("url"))
    base = base.withColumns({"host": host, "path": path})
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = staged(chunked(base.withColumns({"rule": rule, "said": verdict})), "urls")
    kept = F.pmod(F.xxhash64("url"), F.lit(KEPT)) == 0
    examples = rows.where(F.col("said").isNotNull() & ~kept).select("said", "url")
    if examples.select("said").distinct().count() < 2:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("said", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("ratio"))
    asked = staged(runs_in_chunks(rows), "asked")
    known, tables = weights(runs_counted(examples.distinct()), asked)
    out = staged(scored(rows, asked.join(known, "run")), "ratios")
    drop_staged(rows, asked, *tables)
    held = staged(out.where(F.col("said").isNotNull() & kept).select("said", "url", "ratio").distinct().groupBy("ratio").agg(*(F.count_if(F.col("said") == kind).alias(kind) for kind in ("allow", "block"))), "held")
    at = threshold(held)
    drop_staged(held)
    method = F.when(F.col("ratio") >= at, "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "ratio")
