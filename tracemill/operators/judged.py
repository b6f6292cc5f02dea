"""Metrics whose verdicts come from outside: a verdict table in, scores, skips, failures and usage out.

A provider is a function from requests to verdicts (request, verdict columns); equal requests are judged once. A judge
gives ``VERDICT`` columns, of which a metric reads its own; a claim extractor gives ``claims``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.scores import precision_at_relevant
from tracemill.functions.text import non_empty
from tracemill.operators.metrics import Metric, Registry, retrieval_skip, selected

#: score: of the answer or plan; rankings: of each ranking's items, whether they are relevant; attributable: of each claim;
#: ranks: of each verdict on
#: an item the rank it names, where a metric asks for it; failure: the class of what went wrong. A judge may leave columns out.
VERDICT = "score double, rankings array<array<boolean>>, ranks array<array<int>>, attributable array<boolean>, failure string, input_tokens long, output_tokens long"
#: What claims are made of, by metric; stored ones are columns of the rows.
STORED = {"contextual_recall_{}_stored_claims": ("claims", "selected", ("document", "snippet")), "contextual_recall_gold_claims": ("gold_claims", "retrieved", ("document",)), "contextual_recall_extracted_claims": ("extracted_claims", "retrieved", ("document",))}


def judged_once(requests: DataFrame, text: str, provider: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Requests with their verdicts; the provider sees every distinct request once, keyed by its SHA-256."""
    keyed = requests.withColumn("request_hash", F.sha2(F.col(text), 256))
    verdicts = provider(keyed.select("request_hash", text).dropDuplicates(["request_hash"])).drop(text)
    return keyed.join(verdicts, "request_hash", "left")


def bounded_score(score: Column, binary: bool) -> tuple[Column, Column]:
    """(fault, score): 0 or 1 if binary, else from 0 to 1."""
    ok = score.isin(0.0, 1.0) if binary else score.between(0.0, 1.0)
    return F.when(~F.coalesce(ok, F.lit(False)), "The judge's score is out of range."), F.when(ok, score)


def verifiable(claims: Column) -> Column:
    """Claims without those marked unverifiable, whatever the case; claims: array<struct<text, kind>>."""
    return F.filter(claims, lambda c: F.coalesce(F.lower(c["kind"]), F.lit("")) != "unverifiable")


def claim_recall(claims: DataFrame, verdicts: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(unit_id, claims, attributed, score). claims: unit_id, claim_id; verdicts: unit_id, claim_id, attributable;
    retrieved: unit_id, items. Units without items score 0 unjudged; units without claims have no row."""
    met = claims.join(verdicts, ["unit_id", "claim_id"], "left").join(retrieved, "unit_id", "left")
    some = F.coalesce(F.col("items"), F.lit(0)) > 0
    hit = F.when(some & F.col("attributable"), 1).otherwise(0)
    out = met.groupBy("unit_id").agg(F.count(F.lit(1)).alias("claims"), F.sum(hit).alias("attributed"))
    return out.withColumn("score", F.col("attributed") / F.col("claims"))


def echo_mismatches(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(unit_id, mismatches): verdicts that name another id than the item at their place."""
    met = items.join(verdicts.select("unit_id", "item_pos", F.col("retrieved_id").alias("echoed")), ["unit_id", "item_pos"], "left")
    return met.groupBy("unit_id").agg(F.count_if(F.col("echoed").isNotNull() & (F.col("echoed") != F.col("retrieved_id"))).alias("mismatches"))


def executed_steps(walked: DataFrame, spans: DataFrame) -> DataFrame:
    """(trace_id, steps): tool spans below the root in order of (start, id)."""
    tools = walked.where("depth > 0").select("trace_id", "span_id").join(spans.where("span_type = 'tool'").select("trace_id", "span_id", "start_us", "status", "event_type"), ["trace_id", "span_id"])
    return tools.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("start_us", "span_id", "event_type", "status"))).alias("steps"))


def retyped(walked: DataFrame, spans: DataFrame, agent: Column) -> DataFrame:
    """(trace_id, span_id, span_type): model calls outside the agent's subtree are external, those right below another call internal."""
    met = spans.join(walked.select("trace_id", "span_id", "top"), ["trace_id", "span_id"], "left")
    parents = spans.where("span_type = 'llm'").select(F.col("trace_id").alias("__t"), F.col("span_id").alias("__p"))
    met = met.join(parents, (F.col("trace_id") == F.col("__t")) & (F.col("parent_id") == F.col("__p")), "left")
    llm = F.col("span_type") == "llm"
    return met.select("trace_id", "span_id", F.when(llm & ~agent, "external_llm").when(llm & F.col("__p").isNotNull(), "llm_internal").otherwise(F.col("span_type")).alias("span_type"))


def topological(walked: DataFrame, spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, number): parents before children, then by start and id."""
    w = Window.partitionBy("trace_id").orderBy("depth", "start_us", "span_id")
    return walked.select("trace_id", "span_id", "depth").join(spans.select("trace_id", "span_id", "start_us"), ["trace_id", "span_id"]).select("trace_id", "span_id", F.row_number().over(w).cast("long").alias("number"))


def asked(*parts: Column) -> Column:
    """A request's text: its parts as paragraphs, nulls left out."""
    return F.concat_ws("\n\n", *parts)


def contents(kind: str, stage: str) -> Column:
    """The texts of all available results, in order."""
    there = F.filter(selected(F.col("retrieval"), kind, stage), lambda r: r["availability"] == "available")
    return F.flatten(F.transform(there, lambda r: r["contents"]))


def rendered_item(title: Column, text: Column, rank: Column | None = None, score: Column | None = None) -> Column:
    """A retrieved item as a judge reads it: rank and score lines only where they are given, blank ones left out."""
    lines = [F.concat(F.lit("Rank: "), rank.cast("string")) if rank is not None else None, F.concat(F.lit("Score: "), score.cast("string")) if score is not None else None, F.concat(F.lit("Title: "), non_empty(title)), F.concat(F.lit("Text: "), non_empty(text))]
    return F.concat_ws("\n", *[x for x in lines if x is not None])


def failed(fault: Column) -> Callable[[], Column]:
    """The judge's failure, or a fault of its verdict; without a verdict there is none to find."""
    failure = F.concat(F.lit("The judge failed: "), F.col("verdict.failure"), F.lit("."))
    return lambda: F.when(F.col("verdict").isNull(), "The judge gave no verdict.").otherwise(F.coalesce(failure, fault))


def register(r: Registry) -> None:
    """The metrics of a judge: answer and plan correctness, contextual precision and recall of documents and snippets."""
    scored(r, "answer_correctness_judge", lambda: asked(F.col("request"), F.col("expected_output"), F.col("answer")), lambda: F.when(non_empty(F.col("answer")).isNull(), "Trace does not provide an answer."), True, "expected_output")
    scored(r, "plan_correctness_judge", lambda: asked(F.col("request"), F.array_join("expected_plan", "\n"), F.array_join("executed_steps", "\n")), lambda: F.when(F.col("executed_steps").isNull(), "Trace does not provide executed steps."), False, "expected_plan")
    for kind in ("document", "snippet"):
        precision(r, f"contextual_precision_{kind}_judge", kind)
        recall(r, f"contextual_recall_{kind}_judge", kind, "selected", None, ("judge",))
        recall(r, f"contextual_recall_{kind}_claim_extractor", kind, "selected", "extracted", ("judge", "claim_extractor"))
    for name, (claims, stage, kinds) in STORED.items():
        for kind in kinds:
            recall(r, name.format(kind), kind, stage, claims, ("judge",))


def scored(r: Registry, name: str, text: Callable[[], Column], skip: Callable[[], Column], binary: bool, key: str, fault: Callable[[], Column] | None = None, **more: bool) -> None:
    """A metric whose score is the judge's own; ``fault``: what fails a unit before it is asked about."""
    early = fault or (lambda: F.lit(None).cast("string"))
    fail = lambda: F.coalesce(early(), failed(bounded_score(F.col("verdict.score"), binary)[0])())
    r.register(Metric(name, "agent_root", lambda: F.col("verdict.score"), skip=skip, fail=fail, ground_truth_keys=(key,), needs=("judge",), request=lambda: asked(F.lit(name), text()), unasked=lambda: early().isNotNull(), **more))


def precision(r: Registry, name: str, kind: str, wrong: Callable[[Column], Column] | None = None, flags: Callable[[], Column] | None = None, optional: bool = False) -> None:
    """Precision at the relevant ranks, the mean over rankings. ``flags``: the verdicts in order of rank, as given by default;
    ``wrong``: a verdict's fault from the rankings' sizes, by default that numbers differ."""
    rankings = lambda: F.transform(F.filter(selected(F.col("retrieval"), kind, "selected"), lambda x: x["availability"] == "available"), lambda x: x["contents"])
    sizes = lambda: F.transform(rankings(), lambda x: F.size(x))
    given = flags or (lambda: F.col("verdict.rankings"))
    mean = lambda: F.try_divide(F.aggregate(F.transform(given(), precision_at_relevant), F.lit(0.0), lambda s, v: s + v), F.size(given()).cast("double"))
    counts = lambda n: F.when(~F.coalesce(F.transform("verdict.rankings", lambda x: F.size(x)) == n, F.lit(False)), "The judge's verdicts don't match the items.")
    fail = lambda: failed(F.coalesce((wrong or counts)(sizes()), counts(sizes())))()
    r.register(Metric(name, "agent_root", lambda: F.coalesce(mean(), F.lit(0.0)), skip=lambda: retrieval_skip(F.col("retrieval"), kind, ranked=True, content=True), fail=fail, ground_truth_keys=("expected_output",), needs=("judge",), request=lambda: asked(F.lit(name), F.col("request"), F.array_join(F.flatten(rankings()), "\n")), optional=optional))


def recall(r: Registry, name: str, kind: str, stage: str, claims: str | None, needs: tuple[str, ...], shape: Callable[[Column], Column] | None = None, fault: Column | None = None, optional: bool = False) -> None:
    """Attributable claims by claims. The judge itself takes the expected output apart where ``claims`` is null; an
    extractor does where it is "extracted", unverifiable ones left out; else it is a column of texts, of which one at least
    must be there. Without any content the score is 0 and nobody is asked. ``shape``: the claims as text, a line each by
    default; ``fault``: what fails a unit before it is asked about."""
    texts = None if claims is None else F.transform(verifiable(F.col("claims_found")), lambda c: c["text"]) if claims == "extracted" else F.col(claims)
    empty = F.size(contents(kind, stage)) == 0
    known = F.size(F.coalesce(F.col("verdict.attributable"), F.array().cast("array<boolean>"))) if texts is None else F.coalesce(F.size(texts), F.lit(0))
    hits = F.size(F.filter("verdict.attributable", lambda x: x))
    score = F.when(empty | (known == 0), 0.0).otherwise(hits / known)
    skip = retrieval_skip(F.col("retrieval"), kind, stage, content=True)
    mismatch = F.lit(None).cast("string") if texts is None else F.when(F.size("verdict.attributable") != known, "The judge's verdicts don't match the claims.")
    none = F.lit(None).cast("string") if texts is None or claims == "extracted" else F.when(F.coalesce(F.size(texts), F.lit(0)) == 0, "Ground truth has no claims.")
    none = none if fault is None else F.coalesce(none, fault)
    unasked = empty if texts is None else empty | (known == 0)
    unasked = unasked if fault is None else unasked | fault.isNotNull()
    fail = F.coalesce(none, F.when(~unasked, failed(mismatch)()))
    parts = [F.col("expected_output")] if texts is None else [(shape or (lambda t: F.array_join(t, "\n")))(texts)]
    r.register(Metric(name, "agent_root", lambda: score, skip=lambda: skip, fail=lambda: fail, ground_truth_keys=(claims or "expected_output",), needs=needs, request=lambda: asked(F.lit(name), F.col("request"), *parts, F.array_join(contents(kind, stage), "\n")), unasked=lambda: unasked, extract=(lambda: F.col("expected_output")) if claims == "extracted" else None, optional=optional))


def with_rubric(metrics: list[Metric], rubric: dict[str, str]) -> list[Metric]:
    """Metrics whose requests end with their rubric's text; ``ValueError`` for one that no chosen metric of a judge has."""
    judged = {Registry.key(m.name) for m in metrics if m.request}
    if unknown := sorted(set(map(Registry.key, rubric)) - judged):
        raise ValueError(f"no judge is asked for: {', '.join(unknown)}")
    texts = {Registry.key(k): v for k, v in rubric.items()}
    more = lambda m: replace(m, request=lambda: asked(m.request(), F.lit(texts[Registry.key(m.name)])))
    return [more(m) if Registry.key(m.name) in texts else m for m in metrics]


def with_verdicts(plan: DataFrame, metrics: list[Metric], judge: Callable[[DataFrame], DataFrame], extractor: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Planned rows with ``claims_found`` and ``verdict``. Skipped rows aren't asked about; equal requests are judged once.

    judge: (request_hash, text) to (request_hash, ``VERDICT``); extractor: (request_hash, text) to (request_hash, claims
    array<struct<text, kind>>).
    """
    by_name = lambda part: F.coalesce(*[F.when(F.col("metric") == m.name, part(m)) for m in metrics], F.lit(None))
    skip = F.coalesce(F.col("skip_reason"), by_name(lambda m: m.skip()))
    extracting = [m for m in metrics if m.extract]
    if extracting:
        texts = F.coalesce(*[F.when((F.col("metric") == m.name) & skip.isNull(), m.extract()) for m in extracting])
        found = provided(plan, texts, extractor)
        plan = found.withColumnRenamed("claims_", "claims_found")
    request = F.coalesce(*[F.when((F.col("metric") == m.name) & skip.isNull() & ~m.unasked(), m.request()) for m in metrics if m.request])
    out = provided(plan, request, judge)
    names = [c.split()[0] for c in VERDICT.split(", ")]
    verdict = F.when(F.col("__answered"), F.struct(*[F.col(f"{n}_").alias(n) for n in names]))
    return out.withColumns({"verdict": verdict, "input_tokens": F.col("input_tokens_"), "output_tokens": F.col("output_tokens_")}).drop(*[f"{n}_" for n in names], "__answered")


def provided(rows: DataFrame, text: Column, provider: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows with the provider's columns, each with an underscore after its name, for the distinct texts; null texts aren't
    asked about. Where the provider answers ``VERDICT`` columns, ``__answered`` says whether it did."""
    keyed = rows.withColumns({"__text": text}).withColumn("__hash", F.sha2("__text", 256))
    requests = keyed.where("__hash is not null").select(F.col("__hash").alias("request_hash"), F.col("__text").alias("text")).dropDuplicates(["request_hash"])
    said = provider(requests).drop("text")
    if "claims" not in said.columns:
        said = said.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in VERDICT.split(", ") if c.split()[0] not in said.columns})
    said = said.select(F.col("request_hash").alias("__hash"), *[F.col(c).alias(f"{c}_") for c in said.columns if c != "request_hash"], *([F.lit(True).alias("__answered")] if "rankings" in said.columns else []))
    return keyed.join(said, "__hash", "left").drop("__hash", "__text")
