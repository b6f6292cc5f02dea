"""Analyses over many runs: macro averages, agreement, ranking quality, retests, run chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.stats import beside, guarded_corr, kappa, less_than, rounded, with_average_rank
from tracemill.staging import staged


def macro_score(units: DataFrame, outer: list[str], inner: list[str], value: str) -> DataFrame:
    """The mean over questions of the mean over their units."""
    each = units.groupBy(*outer, *inner).agg(F.avg(value).alias("m"))
    return each.groupBy(*outer).agg(rounded(F.avg("m")).alias("score"), F.count(F.lit(1)).alias("questions"))


def agreement(decisions: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    return decisions.groupBy(*keys).agg(rounded(kappa(F.col(a), F.col(b))).alias("kappa"), rounded(F.avg((F.col(a) == F.col(b)).cast("double"))).alias("agreement"), F.count(F.lit(1)).alias("n"))


def decision_summary(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of gold and other items, their shares accepted, and the unjudged; decisions: question, accepted, gold, judged."""
    judged, gold = F.col("judged"), F.col("gold")
    rate = lambda c: rounded(F.avg(F.when(judged & c, F.col("accepted").cast("double"))))
    return decisions.groupBy(*keys).agg(F.count_distinct("question").alias("questions"), F.count_if(judged & gold).alias("gold"), F.count_if(judged & ~gold).alias("other"), rate(gold).alias("gold_accepted"), rate(~gold).alias("other_accepted"), F.count_if(~judged).alias("unjudged"))


def first_decisions(items: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    top = items.groupBy(*keys).agg(F.min(F.struct(*order, *values)).alias("__f"))
    return top.select(*keys, *[F.col(f"__f.{v}") for v in values])


def latest_attempts(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """All rows of each pair's last attempt: a later one replaces all rows of earlier ones.

    Each task sends on only the rows of the last attempts that it has; ranks hold no group in memory.
    """
    last = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(sequence))
    return rows.withColumn("__place", F.rank().over(last)).where("__place = 1").drop("__place")


def chains(runs: DataFrame, keys: list[str], run: str = "run_id", start: str = "start_us", source: str = "source") -> DataFrame:
    """Runs of each configuration in order of (start, id), and whether they have one source."""
    return runs.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(start, run))), lambda x: x[run]).alias("runs"), (F.count_distinct(source) <= 1).alias("one_source"))


def retest_pairs(values: DataFrame, item: list[str], repetition: str, value: str) -> DataFrame:
    """Items that occur in both of two repetitions: (a, b, item, x, y)."""
    keep = [*item, F.col(repetition).alias("a"), F.col(value).alias("x")]
    other = values.select(*[F.col(i).alias(f"__{i}") for i in item], F.col(repetition).alias("b"), F.col(value).alias("y"))
    on = [F.col(i) == F.col(f"__{i}") for i in item] + [F.col("a") < F.col("b")]
    return values.select(*keep).join(other, on).drop(*[f"__{i}" for i in item])


def spearman(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation with mean ranks of ties; null where a side is constant."""
    pairs = staged(pairs.select(*keys, x, y), "pairs")  # read by both ranks and by the result
    ranked = with_average_rank(with_average_rank(pairs, keys, x, "rx"), keys, y, "ry")
    return ranked.groupBy(*keys).agg(rounded(guarded_corr("rx", "ry")).alias("rho"), F.count(F.lit(1)).alias("n"))


def mean_if_all(values: DataFrame, value: str, n: int = 3) -> DataFrame:
    """The mean of n values, only if all are there."""
    return values.agg(F.when(F.count(value) == n, rounded(F.avg(value))).alias("mean"), F.count(value).alias("values"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, percents: list[int], limit: float) -> DataFrame:
    """The values at rank ceil(p n / 100), and how many exceed the limit; by counts of equal values."""
    ranked = less_than(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c")), keys, value, "c")
    whole = ranked.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.when(F.col(value) > limit, F.col("c")).otherwise(0)).alias("over"))
    run = beside(ranked, whole, keys)
    at = [F.min(F.when(F.col("less") + F.col("c") >= F.ceil(F.col("n") * p / 100), F.col(value))).alias(f"p{p}") for p in percents]
    return run.groupBy(*keys).agg(*at, F.max("over").alias("over"), F.max("n").alias("n"))


def failed_units(computations: DataFrame) -> DataFrame:
    """Failed computations by metric and failure class, 'unclassified' where there is none."""
    return computations.where("status = 'FAILED'").groupBy("metric", F.coalesce("failure", F.lit("unclassified")).alias("failure")).agg(F.count(F.lit(1)).alias("n"))


def pooled(df: DataFrame, sets: list[list[str]], columns: list[str], aggregates: list) -> DataFrame:
    """One pass for several groupings."""
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(*aggregates)


def plan_summary(trajectories: DataFrame, keys: list[str]) -> DataFrame:
    """trajectories: rewarded, follows_reference, pc, matching; means over rewarded ones that deviate."""
    off = F.col("rewarded") & ~F.col("follows_reference")
    return trajectories.groupBy(*keys).agg(F.count_if(F.col("rewarded")).alias("rewarded"), F.count_if(off).alias("deviating"), rounded(F.avg(F.when(off, F.col("pc")))).alias("mean_pc"), rounded(F.avg(F.when(off, F.col("matching")))).alias("mean_matching"))
