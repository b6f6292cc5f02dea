"""Aggregate columns: score and latency statistics, agreement, ranking quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.staging import staged

DIGITS = 6


def rounded(c: Column) -> Column:
    return F.round(c.cast("double"), DIGITS)


#: The names of the quartiles and their shares.
QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}
#: So many rows of counts of one key at most are put in order by a window; where a key has more, all are cut into ranges.
FEW = 1 << 18


def beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two tables with one row for each key next to each other; null keys meet too."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # a row each
    named = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(c) for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return left.join(named, on, "left").drop(*[f"__k{i}" for i in range(len(keys))])


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Each key's quantiles by linear interpolation at (n - 1) p, from counts of equal values and the numbers of smaller ones.

    No group's values come together in one buffer or task. Null values don't count; without ``keys`` there is one row,
    with nulls if there is no value; with keys, those that have a value.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    met = less_than(counts, keys, "__v", "__c", "__n")
    said = {}
    for name, p in shares.items():
        place = (F.col("__n") - 1) * F.lit(p)
        for side, at in (("l", F.floor(place)), ("h", F.ceil(place))):
            said[f"__{side}_{name}"] = F.max(F.when((F.col("less") <= at) & (at < F.col("less") + F.col("__c")), F.col("__v").cast("double")))
    found = met.groupBy(*keys).agg(F.max("__n").alias("__n"), *[c.alias(n) for n, c in said.items()])
    part = lambda p: (F.col("__n") - 1) * F.lit(p) - F.floor((F.col("__n") - 1) * F.lit(p))
    return found.select(*keys, *[(F.col(f"__l_{n}") + (F.col(f"__h_{n}") - F.col(f"__l_{n}")) * part(p)).alias(n) for n, p in shares.items()])


def score_moments(score: Column) -> list[Column]:
    """count, mean, sample stddev (null for one), min, max; null without rows."""
    return [F.count(score).alias("n"), rounded(F.avg(score)).alias("mean"), rounded(F.stddev_samp(score)).alias("stddev"), rounded(F.min(score)).alias("min"), rounded(F.max(score)).alias("max")]


def with_quantiles(made: DataFrame, df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """A table of groups with the quantiles of ``value`` in ``df``, rounded."""
    found = quantiles(df, keys, value, shares)
    return beside(made, found.select(*keys, *[rounded(F.col(n)).alias(n) for n in shares]), keys)


def score_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each key's moments and quartiles."""
    return with_quantiles(df.groupBy(*keys).agg(*score_moments(F.col(value))), df, keys, value, QUARTILES)


def latency_stats(df: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    made = df.groupBy(*keys).agg(rounded(F.avg(seconds)).alias("mean"), rounded(F.min(seconds)).alias("min"), rounded(F.max(seconds)).alias("max"))
    return with_quantiles(made, df, keys, seconds, {"median": 0.5, "p95": 0.95})


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def kappa(a: Column, b: Column) -> Column:
    """Cohen's kappa of two boolean raters; null if there is nothing to rate or chance agreement is certain."""
    pa, pb = F.avg(a.cast("double")), F.avg(b.cast("double"))
    agreed, chance = F.avg((a == b).cast("double")), pa * pb + (1 - pa) * (1 - pb)
    return F.when(chance < 1 - 1e-12, (agreed - chance) / (1 - chance))


def less_than(counts: DataFrame, keys: list[str], value: str, total: str, whole: str | None = None) -> DataFrame:
    """``counts`` (keys, value, total, ...) with ``less``: the sum of ``total`` over the key's smaller values, and as ``whole``,
    if it is named, that over all of the key's.

    Where no key has more than ``FEW`` rows, a window orders each key's by itself. Else all are cut into ranges of
    (keys, value), each range is summed up by itself, and the sums of the ranges before are added, so that no task orders
    all of a key. (keys, value) must be unique.
    """
    counts = staged(counts, "counts")  # its largest key decides, and cutting into ranges reads it twice
    if (counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).agg(F.max("__n")).first()[0] or 0) <= FEW:
        w = Window.partitionBy(*keys).orderBy(value)
        sums = {"less": F.coalesce(F.sum(total).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}
        if whole:
            sums[whole] = F.sum(total).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return counts.withColumns(sums)
    parts = staged(counts.repartitionByRange(*keys, value).withColumn("__p", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(*keys, "__p").agg(F.sum(total).alias("__s")).withColumn("__b", F.coalesce(F.sum("__s").over(before), F.lit(0)))
    sums = sums.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate([*keys, "__p"])], "__b")
    here = Window.partitionBy("__p", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    on = [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate([*keys, "__p"])]
    out = parts.withColumn("__l", F.coalesce(F.sum(total).over(here), F.lit(0))).join(sums, on)
    out = out.select(*counts.columns, (F.col("__l") + F.col("__b")).alias("less"))
    return beside(out, counts.groupBy(*keys).agg(F.sum(total).alias(whole)), keys) if whole else out


def with_average_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the rank of each value among its key's, ties at their mean, by counts of equal values."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    ranked = less_than(counts, keys, value, "__c").select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, value])], (F.col("less") + (F.col("__c") + 1) / 2).alias(name))
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*keys, value])]
    return df.join(ranked, on, "left").drop(*[f"__k{i}" for i in range(len(keys) + 1)])


def auroc(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """Area under the ROC curve by rank sums, ties one half; null unless both classes occur.

    Ranks come from counts of equal scores and running sums over ranges of distinct scores, so that neither one class nor
    one frequent score nor all scores are sorted in one task.
    """
    counts = df.groupBy(*keys, score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    ranked = less_than(counts, keys, score, "n")
    wins = F.sum(F.col("p") * (F.col("less") + F.col("n") / 2))
    return ranked.groupBy(*keys).agg(F.try_divide(wins, (F.sum("p") * F.sum("n")).cast("double")).alias("auroc"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))


def guarded_corr(x: str, y: str) -> Column:
    """Correlation, null where either side is constant."""
    flat = (F.coalesce(F.stddev_pop(x), F.lit(0.0)) == 0) | (F.coalesce(F.stddev_pop(y), F.lit(0.0)) == 0)
    centred = F.covar_pop(x, y)
    return F.when(~flat, F.try_divide(centred, F.stddev_pop(x) * F.stddev_pop(y)))
