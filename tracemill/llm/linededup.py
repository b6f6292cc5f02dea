"""Line dedup over overlapping windows of three lines.

Lines are what line feeds part. Each window of three consecutive lines is hashed to 128 bits; of a window that occurs
more than once, the occurrence of the smallest (doc_id, position) stays and all three lines of each later one are
covered; covered lines are removed once, however many windows cover them.

Edge cases: texts of fewer than three lines have no window and stay; null texts stay null; rows with equal doc_id and
equal text are one document (one result for each row); a null doc_id sorts first; other columns are carried along, and
the two columns added give way to those that have their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import col, free_names, masked_places, place_mask, plain, sliced, staged, with_fields

#: Lines in a window; places that a window's occurrences are dealt out to when they are joined.
WINDOW, DEALT = 3, 16


MARK = F.xxhash64


def windows(df: DataFrame) -> DataFrame:
    """(doc_id, mark, pos, a, b): mark tells documents of one id apart, a and b are the window's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows, positions, first, second = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                lines = text.encode().split(b"\n")
                digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines]), np.uint64).reshape(-1, 2)
                n = len(lines) - WINDOW + 1
                mixed = [np.zeros(n, np.uint64) for _ in range(2)]
                for k in range(WINDOW):
                    for half, odd in enumerate((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)):
                        m = (mixed[half] ^ digests[k : n + k, half]) * np.uint64(odd)
                        mixed[half] = m ^ (m >> np.uint64(29))
                rows.append(np.full(n, i))
                positions.append(np.arange(n, dtype=np.int32))
                first.append(mixed[0])
                second.append(mixed[1])
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(np.concatenate(positions)), pa.array(np.concatenate(first).view(np.int64)), pa.array(np.concatenate(second).view(np.int64))], ["doc_id", "mark", "pos", "a", "b"])

    key = dict(df.dtypes)["doc_id"]
    long_enough = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) >= WINDOW - 1
    rows = df.select("doc_id", "text", MARK("text").alias("mark")).where(long_enough)
    return rows.mapInArrow(run, f"doc_id {key}, mark long, pos int, a long, b long")


def covered(df: DataFrame) -> DataFrame:
    """(doc_id, mark, starts): where later occurrences of repeated windows begin."""
    found = staged(windows(df), "windows")
    at = F.struct("doc_id", "mark", "pos")
    # a window may be a large part of all rows: its occurrences are dealt out to DEALT places, its first to those that have any
    place = F.pmod(F.col("mark") + F.col("pos"), F.lit(DEALT)).cast("int")
    repeated = found.groupBy("a", "b").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"), place_mask(place).alias("mask")).where(F.col("n") > 1)
    dealt = repeated.select("a", "b", "first", masked_places(F.col("mask"), DEALT).alias("place"))
    placed = found.withColumn("place", place)
    later = placed.join(dealt, ["a", "b", "place"]).where(~at.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("starts"))


def dedup_lines(df: DataFrame, lines: str = "__lines", removed: str = "__removed") -> DataFrame:
    """All columns of ``df`` with the text's later lines removed, and two more: the numbers of its lines and of those
    removed. These come last; where ``df`` has columns called like them, they have underscores more before their names."""
    names, texts = list(df.columns), df.columns.index("text")
    lines, removed = free_names(names, lines, removed)
    key, mark, at = free_names(names, "key", "mark", "starts")
    starts = covered(df.select("doc_id", "text")).select(F.col("doc_id").alias(key), F.col("mark").alias(mark), F.col("starts").alias(at))
    schema = with_fields(df, names, (lines, IntegerType()), (removed, IntegerType()))

    def without(text: str, at: list[int]) -> tuple[str, int]:
        lines = text.split("\n")
        cover = np.zeros(len(lines) + 1, np.int32)
        cover[at] = 1
        ends = np.zeros(len(lines) + 1, np.int32)
        np.add.at(ends, np.minimum(np.array(at) + WINDOW, len(lines)), 1)
        stay = np.cumsum(cover - ends)[:-1] == 0
        return "\n".join([x for x, ok in zip(lines, stay.tolist(), strict=True) if ok]), len(lines) - int(stay.sum())

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns, starts = list(batch.columns[:-1]), batch.column(batch.num_columns - 1)
            had = pc.add(pc.count_substring(columns[texts], "\n"), 1).fill_null(0).cast(pa.int32())
            hit = starts.is_valid()
            gone = np.zeros(batch.num_rows, np.int32)
            at = np.flatnonzero(hit.to_numpy(zero_copy_only=False))
            if len(at):
                pick = pa.array(at)
                made = [without(t, s) for t, s in zip(columns[texts].take(pick).to_pylist(), starts.take(pick).to_pylist(), strict=True)]
                columns[texts] = pc.replace_with_mask(columns[texts], hit, pa.array([m[0] for m in made], columns[texts].type))
                gone[at] = [m[1] for m in made]
            yield pa.RecordBatch.from_arrays([*columns, had, pa.array(gone)], schema.names)

    joined = df.join(starts, F.col("doc_id").eqNullSafe(F.col(key)) & (MARK("text") == F.col(mark)), "left")
    return plain(joined, names, F.col(at)).mapInArrow(remove, schema)


def line_query(docs: DataFrame) -> DataFrame:
    """Per document: lines, lines removed, and the digest of what stays."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("__lines").cast("long").alias("n_lines"), F.col("__removed").cast("long").alias("n_removed"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


#: DuckDB SQL for ``line_query``'s rows, where doc_id is unique.
LINE_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
w AS (SELECT doc_id, pos, line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS win FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS k FROM w WHERE win IS NOT NULL),
c AS (SELECT DISTINCT doc_id, pos + o.i AS pos FROM r, (SELECT unnest([0, 1, 2]) AS i) o WHERE k > 1),
s AS (SELECT l.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(c.pos) AS BIGINT) AS n_removed,
  coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL), '') AS text
  FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(s.n_lines, 0) AS n_lines, coalesce(s.n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN md5(s.text) END AS text_md5
FROM d LEFT JOIN s USING (doc_id)
"""
