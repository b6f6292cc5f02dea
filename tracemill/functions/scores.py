"""Column functions on id arrays and vectors: set scores, rankings, edit distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Product of two arrays in double precision, one component after another."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def ndcg(ranked: Column, relevant: Column, k: int = 10) -> Column:
    """Binary gain at the first occurrence of each relevant id within the top k; repeats keep their rank, gain nothing."""
    top = F.slice(ranked, 1, k)
    gains = F.transform(top, lambda x, i: F.when(F.array_contains(relevant, x) & (F.array_position(top, x) == i + 1), 1 / F.log2(i.cast("double") + 2)).otherwise(0.0))
    ideal = F.transform(F.sequence(F.lit(1), F.least(F.size(relevant), F.lit(k))), lambda r: 1 / F.log2(r.cast("double") + 1))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(relevant) > 0, total(gains) / total(ideal))


def precision_at_relevant(flags: Column) -> Column:
    """Mean over relevant ranks of the share of relevant items down to there; 0 if none is."""
    state = F.struct(F.lit(0).alias("rank"), F.lit(0).alias("hits"), F.lit(0.0).alias("total"))

    def step(s: Column, flag: Column) -> Column:
        hits = s["hits"] + F.when(flag, 1).otherwise(0)
        return F.struct((s["rank"] + 1).alias("rank"), hits.alias("hits"), (s["total"] + F.when(flag, hits / (s["rank"] + 1)).otherwise(0.0)).alias("total"))

    return F.aggregate(flags, state, step, lambda s: F.when(s["hits"] > 0, s["total"] / s["hits"]).otherwise(0.0))


def sequence_match(executed: Column, expected: Column) -> Column:
    """1 - edit distance / the longer length, of two arrays of strings; 1 if both are empty.

    Each distinct string becomes one private-use character, so that the built-in distance of texts applies.
    """
    kinds = F.array_distinct(F.concat(executed, expected))
    text = lambda xs: F.array_join(F.transform(xs, lambda x: _letter(F.array_position(kinds, x))), "")
    longest = F.greatest(F.size(executed), F.size(expected))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(text(executed), text(expected)) / longest)


def _letter(position: Column) -> Column:
    """The private-use character of a position: U+E000 and on, written by its UTF-16 code."""
    return F.decode(F.unhex(F.lpad(F.hex(position + 0xE000), 4, "0")), "UTF-16BE")


def ndcg_of_flags(flags: Column, relevant: Column, k: int = 10) -> Column:
    """nDCG from whether each ranked item is a first, relevant one, and from the number of relevant items; null without any."""
    gain = lambda c: F.aggregate(c, F.lit(0.0), lambda total, x: total + x)
    at = lambda i: 1 / F.log2(i + F.lit(1.0))
    got = gain(F.transform(F.slice(flags, 1, k), lambda f, i: F.when(f, at(i + 1)).otherwise(0.0)))
    best = gain(F.transform(F.sequence(F.lit(1), F.least(F.greatest(relevant, F.lit(1)), F.lit(k)).cast("int")), at))
    return F.when(relevant > 0, got / best)
