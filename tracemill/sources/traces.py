"""A trace service as a Spark data source: one partition for each trace id.

The service is a callable that gives a page of a trace's span nodes (``from_service``); the data source reads JSON files of
a folder. Reads are retried with growing pauses, and repeated until every parent is there; a trace that still lacks one
after the last try is passed on, and breaks the rule of missing parents.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracemill.staging import staged

SCHEMA = "trace_id string, span_id string, parent_id string, record string"
#: Traces that a task asks for, about: ids are short and answers long, so that the ids' bytes don't tell how many tasks are needed.
TRACES = 1000


def with_retries(call: Callable[[], list[dict]], tries: int = 4, pause: float = 0.2, limit: float = 5.0) -> list[dict]:
    """The call's result; OSErrors and incomplete traces are tried again, pauses doubling up to ``limit``."""
    for n in range(tries):
        try:
            records = call()
            ids = {r.get("context.span_id") for r in records}
            if all(r.get("parent_id") is None or r["parent_id"] in ids for r in records) or n + 1 == tries:
                return records
        except OSError:
            if n + 1 == tries:
                raise
        time.sleep(min(limit, pause * 2**n))
    return []


class TracePartition(InputPartition):
    def __init__(self, trace_id: str):
        self.trace_id = trace_id


class TraceReader(DataSourceReader):
    def __init__(self, folder: str, ids: list[str]):
        self.folder, self.ids = folder, ids

    def partitions(self) -> list[TracePartition]:
        return [TracePartition(i) for i in self.ids]

    def read(self, partition: TracePartition) -> Iterator[tuple]:
        def call() -> list[dict]:
            with open(os.path.join(self.folder, f"{partition.trace_id}.json"), encoding="utf-8") as f:
                return json.load(f)["spans"]

        for r in with_retries(call):
            yield partition.trace_id, r.get("context.span_id"), r.get("parent_id"), json.dumps(r, sort_keys=True)


class TraceSource(DataSource):
    """spark.read.format("traces").option("ids", "a,b").load(folder), a folder mounted on every executor; traces in stores that
    only Spark reads are for ``files.trace_files``."""

    @classmethod
    def name(cls) -> str:
        return "traces"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TraceReader:
        return TraceReader(self.options["path"], [i for i in self.options.get("ids", "").split(",") if i])


class BadResponse(ValueError):
    """What a trace service answered can't be used."""


def pages_of(client: Callable[[str, int, str | None], dict], trace_id: str, size: int = 50) -> list[dict]:
    """All span nodes of a trace: pages of ``size`` follow the cursor. client(trace_id, first, after) answers
    {"spans": {"edges": [{"node": ...}], "pageInfo": {"hasNextPage", "endCursor"}}}, or null for an unknown trace."""
    nodes, cursor = [], None
    while True:
        answer = client(trace_id, size, cursor)
        if answer is None:
            return []
        spans = answer.get("spans") or {}
        nodes += [e["node"] for e in spans.get("edges") or [] if e.get("node") is not None]
        info = spans.get("pageInfo") or {}
        if not info.get("hasNextPage"):
            return nodes
        if info.get("endCursor") in (None, cursor):
            raise BadResponse(f"trace {trace_id} has a further page without a new cursor")
        cursor = info["endCursor"]


def flat_record(node: dict) -> dict:
    """A span node as a flat record; nested attributes get dotted keys, times that can't be read are null."""
    context = node.get("context") or {}
    out = {"name": node.get("name"), "span_kind": node.get("spanKind"), "status_code": node.get("statusCode"), "status_message": node.get("statusMessage"), "parent_id": node.get("parentId"), "start_time": iso_time(node.get("startTime")), "end_time": iso_time(node.get("endTime")), "context.span_id": context.get("spanId"), "context.trace_id": context.get("traceId")}
    raw = node.get("attributes")
    if raw:
        try:
            found = json.loads(raw) if isinstance(raw, str) else raw
        except ValueError as error:
            raise BadResponse("span attributes aren't JSON") from error
        todo = [("attributes", found)] if isinstance(found, dict) else []
        while todo:
            key, value = todo.pop()
            if isinstance(value, dict) and (value or key == "attributes"):
                todo += [(f"{key}.{k}", v) for k, v in value.items()]
            else:
                out[key] = value
    return out


def iso_time(text: object) -> str | None:
    """An ISO time with its zone, Z as +00:00; null if it can't be read."""
    try:
        return datetime.fromisoformat(str(text).strip().removesuffix("Z") + ("+00:00" if str(text).strip().endswith("Z") else "")).isoformat() if text else None
    except ValueError:
        return None


def from_service(asked: DataFrame, client: Callable[[str, int, str | None], dict], size: int = 50) -> DataFrame:
    """Records (``SCHEMA``) of the traces asked for (trace_id) from a paged service; the executors call ``client``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for trace_id in batch.column(0).to_pylist():
                found = with_retries(lambda trace_id=trace_id: [flat_record(n) for n in pages_of(client, trace_id, size)])
                rows = [(trace_id, r["context.span_id"], r["parent_id"], json.dumps(r, sort_keys=True)) for r in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [()] * 4)], ["trace_id", "span_id", "parent_id", "record"])

    ids = staged(asked.select(asked["trace_id"].cast("string").alias("trace_id")).distinct(), "asked")
    tasks = -(-ids.count() // TRACES) or 1
    return ids.repartition(tasks, "trace_id").mapInArrow(run, SCHEMA)
