"""python -m tracemill COMMAND: list | sql | query | analyze over folders of tables; dataset | import | run | repeat | report |
runs | status over a store."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable

#: Exit status of a run without a completed sample.
FAILED = 4
#: Faults of an import that are printed.
TOLD = 1000


def named(path: str | None) -> Callable | None:
    """The function that module:name says."""
    if path is None:
        return None
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracemill")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, *options: str, **more: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        for o in options:
            c.add_argument(o)
        for o, h in more.items():
            c.add_argument(f"--{o}", help=h)
        return c

    add("list", "names of all queries")
    add("query", "run a query over a folder of Parquet tables", "name", "folder", out="write Parquet here instead of showing 20 rows")
    add("sql", "the DuckDB SQL of a query", "name")
    add("dataset", "import a data set file into a store", "store", "path", "name")
    add("import", "import trace files as a run of a data set", "store", "path", "dataset", "run_id", adapter="the traces' adapter, phoenix by default", model="the model that research_agent and deep_agent were given")
    clients = {"judge": "module:function that gives verdicts", "extractor": "module:function that gives claims", "rubric": "JSON file: metric names and what their judge is asked besides"}
    add("run", "score an imported run", "store", "run_id", metrics="names with commas between; all that the judge and extractor allow by default", **clients)
    add("repeat", "score a run's traces again as a new run", "store", "source_run", "run_id", metrics="as for run", **clients)
    add("runs", "a page of 50 runs, newest first", "store", status="only of this status", offset="after so many")
    add("status", "a run's samples by outcome", "store", "run_id", set="give it this status first")
    add("report", "a run's report as JSON", "store", "run_id", out="write it to this file")
    add("analyze", "a query's rows as JSON lines and a Markdown table", "name", "folder", "out")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    from tracemill.queries import oracle_sql, queries

    if a.command == "list":
        print("\n".join(queries()))
        return 0
    if a.command == "sql":
        print(oracle_sql()[a.name])
        return 0
    from tracemill.session import session

    spark = session()
    if a.command in ("query", "analyze"):
        df = queries()[a.name](spark, a.folder)
        if a.command == "analyze":
            from tracemill.sources.sinks import markdown, write_rows

            write_rows(df, a.out)
            numbers = [c for c, kind in df.dtypes if kind in ("double", "float", "bigint", "int") or kind.startswith("decimal")]
            print("\n".join(markdown(df, [c for c in df.columns if c not in numbers], numbers)))
        elif a.out:
            df.write.parquet(a.out)
        else:
            df.show(20, truncate=False)
        return 0
    from tracemill import workbench
    from tracemill.operators.store import Store

    store = Store(spark, a.store)
    try:
        if a.command == "dataset":
            print(f"{workbench.import_dataset(store, a.path, a.name)} samples")
        elif a.command == "import":
            for r in workbench.import_run(store, a.path, a.dataset, a.run_id, a.adapter or "phoenix", a.model).limit(TOLD + 1).collect()[:TOLD]:
                print(f"{r['trace_id']}: {r['rule']}: {r['detail']}", file=sys.stderr)
        elif a.command == "report":
            text = workbench.report_run(store, a.run_id)
            if a.out:
                with open(a.out, "w", encoding="utf-8") as f:
                    f.write(text)
            else:
                print(text)
        elif a.command == "runs":
            workbench.list_runs(store, a.status, offset=int(a.offset or 0)).show(50, truncate=False)
        elif a.command == "status":
            if a.set:
                workbench.set_status(store, a.run_id, a.set)
            workbench.run_progress(store, a.run_id).show(truncate=False)
        else:
            rubric = None
            if a.rubric:
                with open(a.rubric, encoding="utf-8") as f:
                    rubric = json.load(f)
            status = workbench.evaluate_run(store, a.run_id, a.metrics, named(a.judge), named(a.extractor), getattr(a, "source_run", None), rubric)
            print(status)
            return FAILED if status == "FAILED" else 0
    except (ValueError, LookupError) as error:
        print(f"{a.command}: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
