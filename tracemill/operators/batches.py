"""Request batches: a greedy cut of a sequence, made in parallel.

A batch begins with a text and takes the next ones while it has at most so many texts and so many tokens; where it ends
depends on where it began, so the cut is sequential. But from any place the next begin is at most ``texts`` places on.
The sequence is split into parts, each of which also sees the first ``texts`` places of the next. A part finds for every
place in it the next begin, by binary search in its running sums, and by pointer jumping the place in the next part at
which a cut that enters at each of its first ``texts`` places leaves it. The parts' entries are followed from the first
part in about log2(parts) rounds of doubled jumps; then each part marks its begins. No task reads more than a part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.retrieval import shard_numbers
from tracemill.staging import drop_staged, staged

#: Most texts of a request; characters of a token, about; rows of a part.
TEXTS, TOKEN_CHARS, PART = 96, 4, 1 << 16


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / TOKEN_CHARS).cast("long") + 1


def next_begins(tokens: np.ndarray, most_tokens: int, most_texts: int) -> np.ndarray:
    """For a batch that begins at each place, where the next one does; one that is too long alone ends after itself."""
    sums = np.concatenate(([0], np.cumsum(tokens)))
    at = np.arange(len(tokens))
    fits = np.searchsorted(sums, sums[:-1] + most_tokens, "right") - 1  # the last place up to which the sum fits
    return np.minimum(np.maximum(fits, at + 1), at + most_texts)


def exits(begins: np.ndarray, part: int) -> np.ndarray:
    """Where a cut that has a begin at each place first has one from ``part`` on."""
    jump = np.arange(int(begins.max(initial=part)) + 1)
    jump[: min(part, len(begins))] = begins[:part]
    while (jump[jump] != jump).any():
        jump = jump[jump]
    return jump


def request_batches(df: DataFrame, key: str, tokens: Column, most_tokens: int, most_texts: int = TEXTS, part: int = PART) -> DataFrame:
    """``key``, row, tokens and batch, numbered from 0 in order of ``key``; keys must be unique."""
    if part < most_texts:
        raise ValueError("a part can't be shorter than a batch")
    numbered = staged(shard_numbers(df.select(key, tokens.alias("tokens")), key, part).select(key, "tokens", "row", F.col("shard").alias("part")), "numbered")
    rows = numbered.select("part", F.pmod("row", F.lit(part)).alias("at"), "tokens")
    ahead = rows.where((F.col("at") < most_texts) & (F.col("part") > 0)).select(F.col("part") - 1, F.col("at") + part, "tokens")
    seen = rows.union(ahead)

    def cuts(table: pa.Table) -> tuple[int, np.ndarray]:
        order = np.argsort(table.column("at").to_numpy())
        begins = next_begins(table.column("tokens").to_numpy()[order], most_tokens, most_texts)
        return table.column("part")[0].as_py(), begins

    def through(table: pa.Table) -> pa.Table:
        p, begins = cuts(table)
        left = exits(begins, part)[: min(most_texts, len(begins), part)]
        return pa.table({"part": pa.array(np.full(len(left), p)), "entry": pa.array(np.arange(len(left))), "to_part": pa.array(np.full(len(left), p + 1)), "to_entry": pa.array(left - part)})

    jumps = staged(seen.groupBy("part").applyInArrow(through, "part long, entry long, to_part long, to_entry long"), "jumps")
    parts = numbered.agg(F.max("part")).first()[0]
    reached = staged(df.sparkSession.range(1).select(F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("entry")), "reached")
    steps = 1
    while parts is not None and steps <= parts:
        there, had = jumps.join(reached, ["part", "entry"]).select(F.col("to_part").alias("part"), F.col("to_entry").alias("entry")), reached
        reached = staged(had.union(there), "reached")
        far = jumps.select(F.col("part").alias("to_part"), F.col("entry").alias("to_entry"), F.col("to_part").alias("p"), F.col("to_entry").alias("e"))
        before, jumps = jumps, staged(jumps.join(far, ["to_part", "to_entry"]).select("part", "entry", F.col("p").alias("to_part"), F.col("e").alias("to_entry")), "jumps")
        drop_staged(had, before)
        steps *= 2

    def marked(table: pa.Table) -> pa.Table:
        p, begins = cuts(table)
        at, found = table.column("entry")[0].as_py(), []
        while at < min(part, len(begins)):
            found.append(at)
            at = int(begins[at])
        return pa.table({"part": pa.array(np.full(len(found), p)), "at": pa.array(np.array(found, np.int64))})

    begun = seen.join(reached, "part").groupBy("part").applyInArrow(marked, "part long, at long")
    begun = staged(begun, "begun")
    counts = numbered.select("part").distinct().join(begun, "part", "left").groupBy("part").agg(F.count("at").alias("n"))  # a part may have no begin
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    flags = begun.select("part", (F.col("part") * part + F.col("at")).alias("row"), F.lit(1).alias("begin"))
    inside = Window.partitionBy("part").orderBy("row")
    placed = numbered.join(flags, ["part", "row"], "left").withColumn("within", F.sum(F.coalesce("begin", F.lit(0))).over(inside))
    # rows before a part's first begin belong to the last batch of the part before
    out = placed.join(before, "part").select(key, "row", "tokens", (F.col("within") + F.col("before") - 1).cast("long").alias("batch"))
    drop_staged(jumps, reached)
    return out
