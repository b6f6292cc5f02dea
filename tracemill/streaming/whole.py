"""Whole traces from a stream of spans, and their way into a store, once each.

Spans come in any order and in any batch. A trace's spans are held in keyed state until each one's parent is there and one of
them is a root; then they leave together. A trace that stays unfinished leaves when its timer ends, marked as incomplete, so
that the rules of a trace can refuse it. Spans that come after their trace has left are held anew and leave at their own
timer, or at once if their parents were among those that left.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tracemill.operators.store import Store
from tracemill.staging import drop_staged, staged

OUT = "trace_id string, span_id string, span string, complete boolean"


class Waiting(StatefulProcessor):
    """Spans (trace_id, span_id, parent_id, span as JSON) until their trace is whole or ``patience`` seconds have passed."""

    def __init__(self, patience: float) -> None:
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "span_id string", "parent_id string, span string")
        self.left = handle.getMapState("left", "span_id string", "is_root boolean")

    def _out(self, key: Any, complete: bool) -> Iterator[pd.DataFrame]:
        ids, texts = [], []
        for (span_id,), (parent_id, span) in list(self.held.iterator()):
            ids.append(span_id)
            texts.append(span)
            self.left.updateValue((span_id,), (parent_id is None,))
        self.held.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at if isinstance(at, int) else at[0])
        if ids:
            yield pd.DataFrame({"trace_id": [key[0]] * len(ids), "span_id": ids, "span": texts, "complete": [complete] * len(ids)})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for part in rows:
            for span_id, parent_id, span in zip(part["span_id"], part["parent_id"], part["span"], strict=True):
                self.held.updateValue((span_id,), (parent_id if isinstance(parent_id, str) else None, span))
        there, parents, rooted = set(), set(), False
        for (span_id,), (parent_id, _) in self.held.iterator():
            there.add(span_id)
            parents |= {parent_id} - {None}
            rooted |= parent_id is None
        for (span_id,), (is_root,) in self.left.iterator():
            there.add(span_id)
            rooted |= is_root
        if rooted and parents <= there:
            yield from self._out(key, True)
        elif there and not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.patience * 1000))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._out(key, False)

    def close(self) -> None:
        pass


def whole_traces(spans: DataFrame, patience: float = 600) -> DataFrame:
    """(trace_id, span_id, span, complete) of a stream of canonical spans; span is the row as JSON. The session's state store
    must be RocksDB's, whose state lies in the checkpoint and needn't fit in memory."""
    rows = spans.select("trace_id", F.col("external_id").alias("span_id"), F.col("parent_span_id").alias("parent_id"), F.to_json(F.struct("*")).alias("span"))
    return rows.groupBy("trace_id").transformWithStateInPandas(Waiting(patience), OUT, "Append", "ProcessingTime")


def store_batch(store: Store, batch: DataFrame, number: int, stream: str, table: str = "stream_spans") -> bool:
    """A micro-batch's traces into the store: new ones are added, equal ones ignored, changed ones told in ``refused``. The
    batch's number is published with its rows, so that a batch that comes again after a restart does nothing. Whether it did something."""
    if store.marks().get(stream, -1) >= number:
        return False
    batch = staged(batch.select("trace_id", "span_id", "span", "complete").dropDuplicates(["trace_id", "span_id", "span"]), "batch")
    old = store.table(table).join(batch.select("trace_id").distinct(), "trace_id", "left_semi") if table in store.manifest() else batch.limit(0)
    # spans that are there with the same content are no change, and a trace may grow by spans that it lacked
    lacking = batch.join(old.select("trace_id", "span_id", "span"), ["trace_id", "span_id", "span"], "left_anti")
    clash = staged(lacking.join(old.select("trace_id", "span_id"), ["trace_id", "span_id"], "left_semi").select("trace_id").distinct(), "clash")
    new = lacking.join(clash, "trace_id", "left_anti")
    refused = clash.select("trace_id", F.lit(stream).alias("stream"), F.lit(number).cast("long").alias("batch"))
    store.append({table: new, "refused": refused}, {stream: number})
    drop_staged(batch, clash)
    return True


def into_store(spans: DataFrame, store: Store, stream: str, checkpoint: str, patience: float = 600, every: str | None = "30 seconds") -> StreamingQuery:
    """Whole traces into a store, each batch once: as they come, looking every so often, or without ``every`` one batch of what
    is there now. Timers end with the next batch after their time."""

    def write(batch: DataFrame, number: int) -> None:
        store_batch(store, batch, number, stream)

    writer = whole_traces(spans, patience).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(once=True)).start()
