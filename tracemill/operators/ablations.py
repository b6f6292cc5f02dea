"""Further metrics of a judge, chosen by name alone: all items in one call, the whole trace instead of the answer, and verdicts
matched by position.

- single call: a ranking's items, or all claims, are one request; the ranks that the judge names must be 1 to n, each once,
  else the unit fails as misaligned, or as truncated if the answer used up its budget;
- whole trace: the judge reads the target span with all that is below it, as text, instead of the answer or the steps;
- by position: verdicts come without ranks, and their number alone is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import non_empty
from tracemill.operators import judged
from tracemill.operators.metrics import Metric, Registry, alignment, failure_class

#: Output tokens of a call for one item, and the most of any call.
ITEM_TOKENS, MOST_TOKENS = 2000, 32_000


def ranks_fault(sizes: Column, item_tokens: int, most_tokens: int) -> Column:
    """What is wrong with the first ranking whose ranks aren't 1 to n; null if nothing is."""
    none = F.array().cast("array<int>")
    given = F.coalesce(F.col("verdict.ranks"), F.array().cast("array<array<int>>"))
    tokens = F.col("verdict.output_tokens")

    def fault(n: Column, i: Column) -> Column:
        ranks = F.coalesce(F.try_element_at(given, i + 1), none)
        expected = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(none)
        found = alignment(expected, ranks)
        said = F.concat_ws("; ", *[F.when(F.size(c) > 0, F.concat(F.lit(f"{k} "), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "))) for k, c in found.items()])
        kind = failure_class(tokens, F.least(n * item_tokens, F.lit(most_tokens)), F.lit(True), F.lit(False), F.lit(False), F.lit(False))
        return F.when(F.array_sort(ranks) != expected, F.concat(kind, F.lit(": the judge's ranks don't match the items: "), said, F.lit(".")))

    return F.try_element_at(F.filter(F.transform(sizes, fault), lambda x: x.isNotNull()), F.lit(1))


def by_rank() -> Column:
    """Each ranking's verdicts in order of the ranks that they name."""
    ranks = lambda i: F.element_at("verdict.ranks", i + 1)
    return F.transform("verdict.rankings", lambda flags, i: F.transform(F.array_sort(ranks(i)), lambda r: F.try_element_at(flags, F.array_position(ranks(i), r).cast("int"))))


def numbered(texts: Column) -> Column:
    return F.array_join(F.transform(texts, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n")


def register(r: Registry, item_tokens: int = ITEM_TOKENS, most_tokens: int = MOST_TOKENS) -> None:
    judged.precision(r, "contextual_precision_document_judge_sc", "document", wrong=lambda sizes: ranks_fault(sizes, item_tokens, most_tokens), flags=by_rank, optional=True)
    judged.recall(r, "contextual_recall_gold_claims_sc_question", "document", "retrieved", "gold_claims", ("judge",), shape=numbered, optional=True)
    judged.precision(r, "deepeval_contextual_precision", "document", optional=True)
    lines = F.when(F.exists("gold_claims", lambda c: c.contains("\n")), "A claim can't span several lines.")
    judged.recall(r, "deepeval_contextual_recall_gold_claims", "document", "retrieved", "gold_claims", ("judge",), fault=lines, optional=True)
    mute = lambda: F.when(non_empty(F.col("answer")).isNull(), "Trace does not provide an answer.")
    still = lambda: F.when(F.col("executed_steps").isNull(), "Trace does not provide executed steps.")
    lost = lambda: F.when(F.col("rendered").isNull(), "The trace could not be rendered.")
    expected = lambda: F.array_join("expected_plan", "\n")
    judged.scored(r, "deepeval_answer_correctness", lambda: judged.asked(F.col("request"), F.col("expected_output"), F.col("answer")), mute, False, "expected_output", optional=True)
    judged.scored(r, "answer_correctness_judge_wt", lambda: judged.asked(F.col("request"), F.col("expected_output"), F.col("rendered")), mute, True, "expected_output", fault=lost, renders=True, optional=True)
    judged.scored(r, "plan_correctness_judge_wt", lambda: judged.asked(F.col("request"), expected(), F.col("rendered")), still, False, "expected_plan", fault=lost, renders=True, optional=True)


def quoted(c: Column) -> Column:
    """A text as JSON."""
    said = F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v")))
    return F.substr(said, F.lit(6), F.length(said) - 6)


def section(label: str, text: Column) -> Column:
    return F.when(text.isNotNull(), F.concat(F.lit(f"{label}:\n"), text))


def rendered(walked: DataFrame, spans: DataFrame, target: str = "agent_root") -> DataFrame:
    """(trace_id, span_id, rendered, rendered_spans, rendered_chars) of each span of the type ``target``: it and all below it.

    walked: ``trees.walked`` with numbers; spans: trace_id, span_id, parent_id, span_type, name, status, and of request, answer,
    executed_steps (array<string>), retrieval (``service.RESULT``s), input_data and output_data those that there are. Spans
    stand depth first with numbers of their own; a request comes before the children, results, steps and the answer after;
    a span without any of these shows its input and output. The target's own results, a copy of its searches', are left
    out. Where a text stands follows from the span's number and its subtree's size, so that lines are sorted once.
    """
    there = lambda c, kind="string": F.col(c) if c in spans.columns else F.lit(None).cast(kind)
    request, answer, results, steps = there("request"), there("answer"), there("retrieval", "array<struct<kind:string,stage:string,availability:string,reason:string,contents:array<string>,ranked:boolean>>"), there("executed_steps", "array<string>")
    results = F.coalesce(results, F.filter(results, lambda x: F.lit(False)))
    label = lambda x: F.concat(F.lit("retrieved "), x["kind"], F.lit("s ("), x["stage"], F.when(x["ranked"], "").otherwise(", unranked"), F.lit(")"))
    said = lambda x: F.when(x["availability"] != "available", F.concat(label(x), F.lit(": "), x["availability"], F.coalesce(F.concat(F.lit(" ("), non_empty(x["reason"]), F.lit(")")), F.lit("")))).when(F.size(x["contents"]) == 0, F.concat(label(x), F.lit(": none"))).otherwise(F.concat(label(x), F.lit(":\n"), F.array_join(x["contents"], "\n")))
    typed = request.isNotNull() | answer.isNotNull() | steps.isNotNull() | F.coalesce(F.size(results) > 0, F.lit(False))
    raw = lambda name: F.when(~typed, section(name.removesuffix("_data"), there(name)))
    shown = spans.select("trace_id", "span_id", "parent_id", "span_type", "name", "status", F.concat_ws("\n", section("request", request), raw("input_data")).alias("before"), F.array_join(F.transform(results, said), "\n").alias("found"), F.concat_ws("\n", section("executed steps", F.array_join(steps, "\n")), section("answer", answer), raw("output_data")).alias("after"))
    placed = shown.join(walked.select("trace_id", "span_id", "depth", "number", "size"), ["trace_id", "span_id"])
    above = placed.select("trace_id", F.col("span_id").alias("parent_id"), F.col("number").alias("above"))
    targets = placed.where(F.col("span_type") == target).select("trace_id", F.col("span_id").alias("target"), F.col("number").alias("first"), F.col("size").alias("many"))
    met = placed.join(above, ["trace_id", "parent_id"], "left").join(targets, "trace_id").where((F.col("number") >= F.col("first")) & (F.col("number") < F.col("first") + F.col("many")))
    own = F.col("span_id") == F.col("target")
    ordinal = lambda c: (F.col(c) - F.col("first") + 1).cast("string")
    head = F.concat(F.lit('<span id="'), ordinal("number"), F.lit('"'), F.when(own | F.col("above").isNull(), "").otherwise(F.concat(F.lit(' parent="'), ordinal("above"), F.lit('"'))), F.lit(" type="), quoted(F.col("span_type")), F.lit(" name="), quoted(F.col("name")), F.lit(' status="'), F.col("status"), F.lit('">'))
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    begin = F.struct(F.col("number").alias("at"), F.lit(0).alias("side"), F.lit(0).alias("inner"), F.concat_ws("\n", head, filled("before")).alias("text"))
    end = F.struct((F.col("number") + F.col("size") - 1).alias("at"), F.lit(1).alias("side"), (-F.col("depth")).alias("inner"), F.concat_ws("\n", F.when(~own, filled("found")), filled("after"), F.lit("</span>")).alias("text"))
    lines = met.select("trace_id", "target", F.explode(F.array(begin, end)).alias("line"))
    out = lines.groupBy("trace_id", F.col("target").alias("span_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["text"]), "\n").alias("rendered"), F.count_if(F.col("line.side") == 0).alias("rendered_spans"))
    return out.withColumn("rendered_chars", F.length("rendered").cast("long"))
