"""Metrics of users' code over groups of a trace's spans.

A group metric names the spans it wants, the key that parts a trace's spans into groups, and a function from a group's
spans to (score, error). The function gets an iterator of Arrow batches, in order of (start, id), and may keep what it
wants of them: spans are sorted on their way to the task and streamed, so that a group needn't fit in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GroupMetric:
    """``code`` gets batches of ``columns``; ``group_spans`` is a group's key, one group a trace by default."""

    name: str
    span_types: tuple[str, ...]
    columns: tuple[str, ...]
    code: Callable[[Iterator[pa.RecordBatch]], tuple[float | None, str | None]]
    group_spans: Callable[[], Column] = field(default=lambda: F.lit("all"))
    matches: Callable[[], Column] = field(default=lambda: F.lit(True))
    description: str = ""


def members(spans: DataFrame, metric: GroupMetric) -> DataFrame:
    """The metric's spans (trace_id, group, start_us, span_id, and its columns); a null key is a group of its own."""
    mine = spans.where(F.col("span_type").isin(*metric.span_types) & metric.matches())
    return mine.select("trace_id", F.coalesce(metric.group_spans().cast("string"), F.lit("")).alias("group"), "start_us", "span_id", *[F.col(c).alias(f"c_{i}") for i, c in enumerate(metric.columns)])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """(key, batches) of each run of rows with one (trace_id, group); a run's batches must be used up before the next."""
    pieces: list[tuple[tuple, pa.RecordBatch]] = []

    def cut(batch: pa.RecordBatch) -> list[tuple[tuple, pa.RecordBatch]]:
        codes = [c.dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in batch.columns[:2]]
        edge = np.ones(batch.num_rows, bool)
        edge[1:] = np.logical_or(*[c[1:] != c[:-1] for c in codes])
        first = np.flatnonzero(edge).tolist()
        return [((batch.column(0)[a].as_py(), batch.column(1)[a].as_py()), batch.slice(a, b - a)) for a, b in zip(first, [*first[1:], batch.num_rows], strict=True)]

    def peek() -> tuple[tuple, pa.RecordBatch] | None:
        while not pieces:
            batch = next(batches, None)
            if batch is None:
                return None
            pieces.extend(cut(batch))
        return pieces[0]

    def one(key: tuple) -> Iterator[pa.RecordBatch]:
        while (head := peek()) is not None and head[0] == key:
            yield pieces.pop(0)[1]

    while (head := peek()) is not None:
        run = one(head[0])
        yield head[0], run
        for _ in run:  # what the code left unread
            pass


def scored(spans: DataFrame, metric: GroupMetric, traces: DataFrame | None = None) -> DataFrame:
    """(trace_id, metric, group, n_spans, status, score, error_message) of each group; SKIPPED rows for the ``traces``
    (trace_id) without any span that the metric wants. An error that the code raises fails its group alone."""
    rows = members(spans, metric)
    kind = dict(rows.dtypes)["trace_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (trace, group), part in _runs(batches):
            seen = 0

            def told(part: Iterator[pa.RecordBatch] = part) -> Iterator[pa.RecordBatch]:
                nonlocal seen
                for b in part:
                    seen += b.num_rows
                    yield pa.RecordBatch.from_arrays(b.columns[4:], list(metric.columns))

            given = told()
            try:
                score, error = metric.code(given)
            except Exception as failure:  # noqa: BLE001  whatever a user's code raises is its group's failure
                score, error = None, f"{type(failure).__name__}: {failure}"
            for _ in given:
                pass
            status = "FAILED" if error is not None else "COMPLETED"
            yield pa.RecordBatch.from_arrays([pa.array([trace], schema.field("trace_id").type), pa.array([group]), pa.array([seen]), pa.array([status]), pa.array([None if error is not None else score], pa.float64()), pa.array([error], pa.string())], ["trace_id", "group", "n_spans", "status", "score", "error_message"])

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(rows.select("trace_id").schema)
    ordered = rows.repartition("trace_id", "group").sortWithinPartitions("trace_id", "group", "start_us", "span_id")
    found = ordered.mapInArrow(run, f"trace_id {kind}, group string, n_spans long, status string, score double, error_message string")
    out = found.select("trace_id", F.lit(metric.name).alias("metric"), "group", "n_spans", "status", "score", "error_message")
    if traces is None:
        return out
    without = traces.select("trace_id").distinct().join(rows.select("trace_id").distinct(), "trace_id", "left_anti")
    reason = f"No spans found for target span types {', '.join(metric.span_types)}."
    return out.union(without.select("trace_id", F.lit(metric.name), F.lit(None).cast("string"), F.lit(0).cast("long"), F.lit("SKIPPED"), F.lit(None).cast("double"), F.lit(reason)))
