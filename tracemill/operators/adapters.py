"""Adapters of particular agents: what their traces must look like, who answers, and which tool calls are searches.

Each gives canonical spans with request, answer, retrieval (array of results) and executed_steps, and the faults
(trace_id, rule, detail) of the traces that it refuses.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.text import non_empty
from tracemill.operators import report, trees
from tracemill.operators.normalize import ADAPTERS, adapter, attribute, canonical
from tracemill.staging import staged

#: Names that the agents' instrumentation writes.
SEARCH_TOOL, SEARCH_SPAN = "search_knowledge_base", "retrieval"
ROOTS = {"smolagents": "smolagents.request", "odr": "odr.request", "deepagents": "deepagents.request", "tau2": "tau2.simulation"}
DIFY_REQUEST, DIFY_PREFIX = "dify_trace_id", "tool response: "
OUTSIDE = {"user_turn": "customer_llm", "evaluate_simulation": "grader_llm"}


class Adapted(NamedTuple):
    spans: DataFrame
    faults: DataFrame


ADAPTED: dict[str, Callable[[DataFrame], Adapted]] = {}


def agent(name: str) -> Callable:
    """Register an adapter with faults; the spans alone are an adapter like any other."""

    def add(f: Callable[[DataFrame], Adapted]) -> Callable[[DataFrame], Adapted]:
        ADAPTED[name] = f
        adapter(name)(lambda records: f(records).spans)
        return f

    return add


def fault(rows: DataFrame, rule: str, detail: Column) -> DataFrame:
    return rows.select("trace_id", F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def refuse(spans: DataFrame, *faults: DataFrame) -> Adapted:
    """Spans of the traces without a fault."""
    found = reduce(DataFrame.union, faults)
    return Adapted(spans.join(found.select("trace_id").distinct(), "trace_id", "left_anti"), found)


def heads(records: DataFrame, root: Column, question: Column, answer: Column) -> tuple[DataFrame, list[DataFrame]]:
    """(trace_id, root_id, question, reply) of each trace, and the faults of those without one fitting root or a question."""
    top = F.col("parent_id").isNull()
    one = lambda c: F.max(F.when(top, c))
    rows = records.groupBy("trace_id").agg(F.count_if(top).alias("roots"), one(root.cast("int")).alias("fits"), one(F.col("context_span_id")).alias("root_id"), one(question).alias("question"), one(answer).alias("reply"))
    odd = rows.where((F.col("roots") != 1) | ~F.coalesce(F.col("fits") == 1, F.lit(False)))
    mute = rows.join(odd.select("trace_id"), "trace_id", "left_anti").where(non_empty(F.col("question")).isNull())
    return rows.select("trace_id", "root_id", "question", "reply"), [fault(odd, "root", F.col("roots")), fault(mute, "no_question", F.col("root_id"))]


def with_searches(spans: DataFrame, head: DataFrame, output: Column, is_search: Column) -> DataFrame:
    """Spans with the root's request and answer; searches that were answered become retrieval spans for the question."""
    met = spans.join(head, "trace_id", "left")
    is_root = F.col("external_id") == F.col("root_id")
    found = F.when(is_search & ~is_root, report.search_retrieval(output))
    met = met.withColumn("__r", found)
    searched = F.col("__r").isNotNull()
    return met.withColumns({"span_type": F.when(searched, SEARCH_SPAN).otherwise(F.col("span_type")), "request": F.when(is_root | searched, F.col("question")), "answer": F.when(is_root, non_empty(F.col("reply"))), "retrieval": F.when(searched, F.array("__r"))}).drop("__r", "question", "reply")


def with_evidence(spans: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """The root's retrieval at stage ``retrieved``: each (id, content) of the trace's searches once, in order of (start,
    id); unavailable if a search or one of ``unreadable`` (trace_id, external_id) couldn't be read."""
    searches = spans.where("retrieval is not null").select("trace_id", "start_time", "external_id", F.explode("retrieval").alias("r"))
    bad = searches.where("r.availability <> 'available'").select("trace_id", "external_id")
    bad = (bad if unreadable is None else unreadable.union(bad)).groupBy("trace_id").agg(F.array_join(F.array_sort(F.collect_set("external_id")), ", ").alias("__bad"))
    rows = searches.select("trace_id", "start_time", "external_id", F.posexplode(F.col("r.items")).alias("at", "i"))
    first = rows.groupBy("trace_id", "i.id", "i.content").agg(F.min(F.struct("start_time", "external_id", "at", "i")).alias("f"))
    items = first.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["i"]).alias("__items"))
    kind = dict(spans.dtypes)["retrieval"].removeprefix("array<").removesuffix(">")
    reason = F.when(F.col("__bad").isNotNull(), F.concat(F.lit("unreadable search outputs: "), "__bad"))
    there = F.when(F.col("__bad").isNull(), F.coalesce("__items", F.array().cast(dict(items.dtypes)["__items"]))).otherwise(F.array().cast(dict(items.dtypes)["__items"]))
    said = {"kind": F.lit("document"), "stage": F.lit("retrieved"), "availability": F.when(F.col("__bad").isNull(), "available").otherwise("unavailable"), "reason": reason, "items": there, "ranked": F.lit(False)}
    names = [f.name for f in spans.schema["retrieval"].dataType.elementType.fields]
    evidence = F.array(F.struct(*[said.get(n, F.lit(None)).alias(n) for n in names]).cast(kind))
    met = spans.join(items, "trace_id", "left").join(bad, "trace_id", "left")
    return met.withColumn("retrieval", F.when(F.col("external_id") == F.col("root_id"), evidence).otherwise(F.col("retrieval"))).drop("__items", "__bad", "root_id")


STEP = "struct<id:string,operation:string,status:string,input:string,output:string,start_time:timestamp,end_time:timestamp,tool_call_id:string>"


def no_steps(spans: DataFrame) -> DataFrame:
    return spans.withColumn("executed_steps", F.lit(None).cast(f"array<{STEP}>"))


def answering(records: DataFrame, root: str) -> tuple[DataFrame, list[DataFrame]]:
    """A root of a name whose raw input is the question, and tool calls by the attribute ``tool.name``."""
    head, faults = heads(records, F.col("name") == root, attribute("input.value"), attribute("output.value"))
    tools = F.try_element_at("metadata", F.lit("attributes.tool.name")) == SEARCH_TOOL
    spans = with_searches(canonical(records), head, F.col("output_data"), F.coalesce(tools, F.lit(False)))
    return no_steps(with_evidence(spans)), faults


@agent("smolagents")
def code_agent(records: DataFrame) -> Adapted:
    """Searches that returned the tool's JSON become retrieval spans; a failed one stays a tool span."""
    spans, faults = answering(records, ROOTS["smolagents"])
    return refuse(spans, *faults)


def langchain(records: DataFrame, model: str, root: str) -> Adapted:
    """As ``code_agent``, and every model call must be to ``model`` or a dated version of it."""
    spans, faults = answering(records, root)
    dated = F.concat(F.lit("^\\Q"), F.lit(model), F.lit("\\E(-\\d{4}-\\d{2}-\\d{2})?$"))
    other = spans.where(F.col("usage").isNotNull() & ~F.coalesce(F.regexp(F.coalesce("usage.model", F.lit("")), dated), F.lit(False)))
    return refuse(spans, *faults, fault(other, "other_model", F.col("usage.model")))


def research_agent(records: DataFrame, model: str) -> Adapted:
    return langchain(records, model, ROOTS["odr"])


def deep_agent(records: DataFrame, model: str) -> Adapted:
    return langchain(records, model, ROOTS["deepagents"])


#: Adapters that need the name of the model which the agent was given.
MODELLED: dict[str, Callable[[DataFrame, str], Adapted]] = {"research_agent": research_agent, "deep_agent": deep_agent}


def adapted(name: str, model: str | None = None) -> Callable[[DataFrame], tuple[DataFrame, DataFrame | None]]:
    """The adapter of a name, as a function from records to spans and the faults it finds by itself. ``ValueError`` if there
    is none, if it needs a model and none is given, or the other way round."""
    if name not in ADAPTERS and name not in MODELLED:
        raise ValueError(f"no adapter {name}; there are {', '.join(sorted({*ADAPTERS, *MODELLED}))}")
    if (name in MODELLED) != (model is not None):
        raise ValueError(f"adapter {name} {'needs' if name in MODELLED else 'takes no'} model")
    if name in MODELLED:
        return lambda records: MODELLED[name](records, model)
    return ADAPTED[name] if name in ADAPTED else lambda records: (ADAPTERS[name](records), None)


LOG = "struct<json:array<struct<id:string,label:string,parent_id:string,status:string,error:string,data:string,metadata:string>>>"


@agent("dify")
def workflow(records: DataFrame) -> Adapted:
    """The workflow's root answers; an agent node's log becomes spans below the node, its clock moved so that the first
    entry begins with the node. Entries without times stay in the node's metadata."""
    asked, replied = F.get_json_object(attribute("input.value"), "$['sys.query']"), F.get_json_object(attribute("output.value"), "$.answer")
    head, faults = heads(records, attribute(DIFY_REQUEST).isNotNull(), asked, replied)
    base = with_searches(canonical(records), head, F.lit(None).cast("string"), F.lit(False))
    is_agent = (F.try_element_at("metadata", F.lit("attributes.metadata.node_type")) == "agent") & (F.col("external_id") != F.col("root_id"))
    listed = F.when(F.coalesce(is_agent, F.lit(False)), F.from_json("output_data", LOG))
    nodes = base.withColumn("log", listed["json"])
    timed = lambda e: F.get_json_object(e["metadata"], "$.started_at").isNotNull() & F.get_json_object(e["metadata"], "$.finished_at").isNotNull()
    named = F.filter("log", lambda e: non_empty(e["label"]).isNotNull())
    seconds = lambda e, k: F.get_json_object(e["metadata"], f"$.{k}").cast("double")
    nodes = nodes.withColumns({"entries": F.filter(named, timed), "untimed": F.filter(named, lambda e: ~timed(e))})
    nodes = nodes.withColumn("origin", F.coalesce(F.array_min(F.transform("entries", lambda e: seconds(e, "started_at"))), F.lit(0.0)))
    is_search = lambda e: F.coalesce(F.get_json_object(e["data"], "$.tool_name") == SEARCH_TOOL, F.lit(False))
    unreadable = nodes.where(F.coalesce(is_agent, F.lit(False)) & (F.col("log").isNull() | F.coalesce(F.exists("untimed", is_search), F.lit(False)))).select("trace_id", "external_id")
    e = F.col("e")
    data, clock = (lambda k: F.get_json_object(e["data"], f"$.{k}")), (lambda k: F.get_json_object(e["metadata"], f"$.{k}"))
    tool = data("tool_name").isNotNull()
    start = F.unix_micros("start_time") + F.round((seconds(e, "started_at") - F.col("origin")) * 1_000_000).cast("long")
    length = F.round((seconds(e, "finished_at") - seconds(e, "started_at")) * 1_000_000).cast("long")
    output = F.when(F.startswith(data("output"), F.lit(DIFY_PREFIX)), F.substr(data("output"), F.lit(len(DIFY_PREFIX) + 1))).otherwise(data("output"))
    retrieval = F.when(is_search(e), report.search_retrieval(output))
    usage = F.when(~tool & data("usage").isNotNull(), F.struct(e["id"].alias("call_id"), clock("provider").alias("provider"), F.lit(None).cast("string").alias("model"), data("usage.prompt_tokens").try_cast("long").alias("input_tokens"), data("usage.completion_tokens").try_cast("long").alias("output_tokens"), clock("total_tokens").try_cast("long").alias("total_tokens"), F.lit(None).cast("long").alias("cached_input_tokens"), F.lit(None).cast("double").alias("cost"), F.lit(None).cast("string").alias("currency")))
    inner = nodes.select("*", F.explode("entries").alias("e")).withColumn("found", retrieval)
    searched = F.col("found").isNotNull()
    inner = inner.join(head.select("trace_id", "question"), "trace_id")
    meta = F.map_filter(F.create_map(F.lit("dify.agent_log.metadata"), e["metadata"], F.lit("dify.agent_log.error"), e["error"]), lambda k, v: v.isNotNull())
    made = {"external_id": e["id"], "parent_span_id": F.coalesce(non_empty(e["parent_id"]), "external_id"), "span_type": F.when(searched, SEARCH_SPAN).when(tool, "tool").when(clock("provider").isNotNull(), "llm").otherwise("chain"), "status": F.when(e["status"].isin("success", "error"), e["status"]).otherwise("unset"), "name": e["label"], "start_time": F.timestamp_micros(start), "end_time": F.timestamp_micros(start + length), "input_data": F.when(tool, data("tool_call_args")), "output_data": F.when(tool, data("output")).otherwise(e["data"]), "metadata": meta, "usage": usage, "request": F.when(searched, F.col("question")), "answer": F.lit(None).cast("string"), "retrieval": F.when(searched, F.array("found"))}
    inner = inner.select(*[made.get(c, F.col(c)).alias(c) for c in base.columns])
    kept = F.when(F.coalesce(is_agent, F.lit(False)), F.map_concat(F.map_filter("metadata", lambda k, v: k != "dify.agent_log.untimed"), F.create_map(F.lit("dify.agent_log.untimed"), F.to_json(F.coalesce("untimed", F.array().cast(dict(nodes.dtypes)["untimed"])))))).otherwise(F.col("metadata"))
    stripped = F.when(F.col("log").isNotNull(), F.to_json(F.map_filter(F.from_json("output_data", "map<string,string>"), lambda k, v: k != "json"))).otherwise(F.col("output_data"))
    outer = nodes.withColumns({"metadata": kept, "output_data": stripped}).select(*base.columns)
    return refuse(no_steps(with_evidence(outer.union(inner), unreadable)), *faults)


@agent("tau2")
def simulation(records: DataFrame) -> Adapted:
    """The agent's span below the simulation's root is the agent root. Model calls outside it have types of their own and
    no usage, as those nested in another call; its tool calls are the executed steps, in order of (start, id)."""
    records = staged(records, "records")  # what makes them runs once, not for each of the reads below
    head, faults = heads(records, F.col("name") == ROOTS["tau2"], attribute("input.value"), F.lit(None).cast("string"))
    spans = canonical(records).join(head, "trace_id", "left")
    is_agent = (F.col("span_type") == "agent") & (F.col("parent_span_id") == F.col("root_id"))
    agents = spans.groupBy("trace_id").agg(F.count_if(is_agent).alias("agents"), F.max(F.when(is_agent, F.col("external_id"))).alias("agent_id"))
    faults.append(fault(agents.where("agents <> 1"), "agents", F.col("agents")))
    spans = staged(spans.join(agents.where("agents = 1").select("trace_id", "agent_id"), "trace_id"), "spans")
    tree = spans.select("trace_id", F.col("external_id").alias("span_id"), F.col("parent_span_id").alias("parent_id"), F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"), "span_type")
    tops = trees.walked(records.sparkSession, tree).select("trace_id", F.col("span_id").alias("external_id"), "top")
    above = spans.select("trace_id", F.col("external_id").alias("top"), F.col("name").alias("top_name"))
    parents = spans.select("trace_id", F.col("external_id").alias("parent_span_id"), (F.col("span_type") == "llm").alias("nested"))
    placed = spans.join(tops, ["trace_id", "external_id"], "left")
    met = placed.join(above, ["trace_id", "top"], "left").join(parents, ["trace_id", "parent_span_id"], "left")
    raw = records.select("trace_id", F.col("context_span_id").alias("external_id"), non_empty(attribute("tool.name")).alias("tool"), attribute("tool.id").alias("tool_call_id"), attribute("output.value").alias("raw_output"))
    inside = F.coalesce(F.col("top") == F.col("agent_id"), F.lit(False))
    step = F.struct("start_time", "external_id", F.struct(F.col("external_id").alias("id"), F.coalesce("tool", "name").alias("operation"), F.when(F.col("status") == "error", "error").otherwise("completed").alias("status"), F.col("input_data").alias("input"), F.col("raw_output").alias("output"), "start_time", "end_time", "tool_call_id").alias("step"))
    steps = placed.where((F.col("span_type") == "tool") & inside).join(raw, ["trace_id", "external_id"]).groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(step)), lambda s: s["step"]).alias("steps"))
    met = met.join(steps, "trace_id", "left")
    llm, mine, root = F.col("span_type") == "llm", F.col("external_id") == F.col("agent_id"), F.col("external_id") == F.col("root_id")
    outside = F.when(llm & F.coalesce("nested", F.lit(False)), "llm_internal").when(llm & ~inside, F.coalesce(*[F.when(F.col("top_name") == k, v) for k, v in OUTSIDE.items()], F.lit("external_llm")))
    priced = F.when(F.col("usage.cost") == 0, F.col("usage").withField("cost", F.lit(None).cast("double")).withField("currency", F.lit(None).cast("string"))).otherwise(F.col("usage"))
    kind = dict(met.dtypes)["span_type"]
    out = met.withColumns({"usage": F.when(outside.isNull(), priced), "request": F.when(mine, F.col("question")), "answer": F.when(mine, non_empty(F.col("output_data"))), "retrieval": F.lit(None).cast("array<string>"), "executed_steps": F.when(mine, F.coalesce("steps", F.array().cast(f"array<{STEP}>"))), "span_type": F.when(root, "simulation").when(mine, "agent_root").otherwise(F.coalesce(outside, "span_type")).cast(kind)})
    return refuse(out.select(*canonical(records).columns, "request", "answer", "retrieval", "executed_steps"), *faults)
