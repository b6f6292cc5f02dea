"""Metrics: what they target, when they are skipped, how they score.

A metric is a set of columns over a span row that carries its retrieval sets, plan, answer and ground truths. Its result
is (status, score, error): the first skip reason that holds gives SKIPPED, a fault of the inputs FAILED, else COMPLETED.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.scores import ndcg, precision_at_relevant, sequence_match
from tracemill.functions.text import non_empty, strip


@dataclass(frozen=True)
class Metric:
    """``skip``, ``fail`` and ``score`` are columns; ``matches`` narrows the spans of the target type."""

    name: str
    span_type: str
    score: Callable[[], Column]
    skip: Callable[[], Column] = field(default=lambda: F.lit(None).cast("string"))
    fail: Callable[[], Column] = field(default=lambda: F.lit(None).cast("string"))
    matches: Callable[[], Column] = field(default=lambda: F.lit(True))
    ground_truth_keys: tuple[str, ...] = ()
    mode: str = "SINGLE"
    needs: tuple[str, ...] = ()
    description: str = ""
    #: The text a judge is asked, and where that is needless; the score then reads the column ``verdict``.
    request: Callable[[], Column] | None = None
    unasked: Callable[[], Column] = field(default=lambda: F.lit(False))
    #: The text that a claim extractor is asked; the request then reads the column ``claims``.
    extract: Callable[[], Column] | None = None
    #: Chosen only by name; reads the whole trace as text.
    optional: bool = False
    renders: bool = False


class Registry:
    """Metrics by normalised name; a name can be taken once."""

    def __init__(self) -> None:
        self.metrics: dict[str, Metric] = {}

    @staticmethod
    def key(name: str) -> str:
        return name.strip().lower()

    def register(self, metric: Metric) -> Metric:
        if self.key(metric.name) in self.metrics:
            raise ValueError(f"metric {metric.name} is registered")
        self.metrics[self.key(metric.name)] = metric
        return metric

    def get(self, name: str) -> Metric:
        return self.metrics[self.key(name)]

    def select(self, names: str | list[str] | None, clients: set[str] | None = None) -> list[Metric]:
        """Named metrics, in the order first named; all that the clients at hand allow if none is named."""
        if names is None:
            return [m for m in self.metrics.values() if not m.optional and (clients is None or set(m.needs) <= clients)]
        listed = names.split(",") if isinstance(names, str) else names
        keys = list(dict.fromkeys(self.key(n) for n in listed if n.strip()))
        unknown = [k for k in keys if k not in self.metrics]
        if unknown:
            raise ValueError(f"unknown metrics: {', '.join(unknown)}")
        found = [self.metrics[k] for k in keys]
        if clients is not None and (lacking := sorted(self.required_clients(names) - clients)):
            raise ValueError(f"the metrics need: {', '.join(lacking)}")
        return found

    def available(self, clients: set[str]) -> list[str]:
        """Names of the metrics that the clients at hand allow."""
        return [m.name for m in self.select(None, clients)]

    def keys_of(self, names: Column) -> Column:
        """The normalised names in lists with commas, each once, in the order first named; known or not."""
        return F.array_distinct(F.filter(F.transform(F.split(names, ","), lambda n: F.lower(strip(n))), lambda n: n != ""))

    def known(self, keys: Column) -> Column:
        """Those of an array of keys that are metrics."""
        return F.filter(keys, lambda k: k.isin(list(self.metrics)))

    def allowed(self, clients: Column) -> Column:
        """Names of the metrics that each row's clients allow, as ``available`` for one set; null if there is no array."""
        each = [F.when(F.size(F.array_except(F.array(*map(F.lit, sorted(m.needs))), clients)) == 0, m.name) if m.needs else F.when(clients.isNotNull(), m.name) for m in self.select(None)]
        return F.when(clients.isNotNull(), F.array_compact(F.array(*each)))

    def required_clients(self, names: str | list[str] | None) -> set[str]:
        """What the named metrics need, of judge and claim_extractor."""
        return set().union(*[m.needs for m in self.select(names)])


def answered(rows: DataFrame) -> DataFrame:
    """Rows with an answer that isn't blank and with executed steps."""
    return rows.where(non_empty(F.col("answer")).isNotNull() & F.col("executed_steps").isNotNull())


def selected(results: Column, kind: str, stage: str) -> Column:
    return F.filter(results, lambda r: (r["kind"] == kind) & (r["stage"] == stage))


def retrieved_ids(results: Column, kind: str, stage: str = "selected") -> Column:
    """The set of ids of all available results."""
    there = F.filter(selected(results, kind, stage), lambda r: r["availability"] == "available")
    return F.array_distinct(F.flatten(F.transform(there, lambda r: r["ids"])))


def retrieval_skip(results: Column, kind: str, stage: str = "selected", ranked: bool = False, content: bool = False) -> Column:
    """The first reason that holds, or null."""
    found = selected(results, kind, stage)
    name = kind.capitalize()
    said = F.filter(found, lambda r: F.coalesce(r["reason"], F.lit("")) != "")
    why = F.coalesce(F.try_element_at(F.transform(said, lambda r: r["reason"]), F.lit(1)), F.lit("results were unavailable"))
    out = F.when(F.size(found) == 0, f"Trace does not provide {stage} {kind} context.")
    out = out.when(F.exists(found, lambda r: r["availability"] != "available"), F.concat(F.lit(f"{name} retrieval unavailable: "), why, F.lit(".")))
    if ranked:
        out = out.when(F.exists(found, lambda r: ~r["ranked"]), f"{name} {stage} context is not ranked.")
    if content:
        out = out.when(F.exists(found, lambda r: F.exists(r["contents"], lambda c: c.isNull())), f"Retrieved {kind} items do not contain the content required by this metric.")
    return out


def set_parts(predicted: Column, relevant: Column) -> tuple[Column, Column, Column]:
    """True positives, false positives, false negatives, sorted."""
    both = F.array_intersect(predicted, relevant)
    return F.array_sort(both), F.array_sort(F.array_except(predicted, relevant)), F.array_sort(F.array_except(relevant, predicted))


def precision_of_counts(matched: Column, predicted: Column, relevant: Column) -> tuple[Column, Column]:
    """(skip reason, score) from the numbers of ids: both empty is 1; nothing predicted of something relevant is undefined."""
    skip = F.when((predicted == 0) & (relevant > 0), "Nothing selected, so precision is undefined.")
    return skip, F.when((predicted == 0) & (relevant == 0), 1.0).when(predicted > 0, matched / predicted)


def set_precision(predicted: Column, relevant: Column) -> tuple[Column, Column]:
    return precision_of_counts(F.size(F.array_intersect(predicted, relevant)), F.size(F.array_distinct(predicted)), F.size(relevant))


def recall_of_counts(matched: Column, relevant: Column) -> tuple[Column, Column]:
    """(skip reason, score) from the numbers of matched and of relevant ids."""
    return F.when(relevant == 0, "No relevant IDs, so recall is undefined."), F.when(relevant > 0, matched / relevant)


def set_recall(predicted: Column, relevant: Column) -> tuple[Column, Column]:
    return recall_of_counts(F.size(F.array_intersect(predicted, relevant)), F.size(F.array_distinct(relevant)))


def mean_ndcg(rankings: Column, relevant: Column, k: int = 10) -> Column:
    """The mean of the rankings' nDCG."""
    each = F.transform(rankings, lambda r: ndcg(r, relevant, k))
    return F.try_divide(F.aggregate(each, F.lit(0.0), lambda s, v: s + v), F.size(each).cast("double"))


def plan_efficiency(expected: Column, actual: Column) -> Column:
    """Expected steps by executed ones, at most 1; no executed step scores 0; both are sizes."""
    return F.when(actual == 0, 0.0).otherwise(F.least(F.lit(1.0), expected / actual))


def result(skip: Column, fail: Column, score: Column) -> list[Column]:
    status = F.when(skip.isNotNull(), "SKIPPED").when(fail.isNotNull(), "FAILED").otherwise("COMPLETED")
    return [status.alias("status"), F.when(skip.isNull() & fail.isNull(), score).alias("score"), F.coalesce(skip, fail).alias("error_message")]


def contextual_precision(flags: Column) -> Column:
    return precision_at_relevant(flags)


def contextual_recall(attributed: Column, claims: Column) -> Column:
    """Attributable claims by claims; 0 without claims."""
    return F.when(claims == 0, 0.0).otherwise(attributed / claims)


def failure_class(output_tokens: Column, limit: Column, wrong_count: Column, invalid: Column, overflow: Column, timeout: Column) -> Column:
    """How a judge's answer failed; null if it didn't."""
    at_limit = F.coalesce(output_tokens >= limit, F.lit(False))
    return F.when(wrong_count & at_limit, "truncated").when(wrong_count, "misaligned").when(invalid & at_limit, "truncated").when(invalid, "invalid_output").when(overflow, "context_overflow").when(timeout, "timeout")


def alignment(expected: Column, given: Column) -> dict[str, Column]:
    """Ranks that are missing, unknown or repeated among the judged ones."""
    return {"missing": F.array_sort(F.array_except(expected, given)), "unknown": F.array_sort(F.array_except(given, expected)), "repeated": F.array_sort(F.array_distinct(F.filter(given, lambda r: F.size(F.filter(given, lambda q: q == r)) > 1)))}


def built_in() -> Registry:
    """All metrics, over rows with answer, retrieval, relevant_document_ids and the like; those of a judge are added by
    ``judged.register``, those that are only chosen by name by ``ablations.register``."""
    from tracemill.operators import ablations, judged

    r = without_judge()
    judged.register(r)
    ablations.register(r)
    return r


def without_judge() -> Registry:
    """The metrics that need no judge."""
    r = Registry()
    r.register(Metric("llm_calls", "llm", lambda: F.col("n_spans").cast("double"), mode="GROUP", description="Number of model calls."))
    r.register(Metric("response_length", "agent_root", lambda: F.length("answer").cast("double"), skip=lambda: F.when(F.col("answer").isNull(), "Trace does not provide an answer.")))
    r.register(Metric("plan_efficiency", "agent_root", lambda: plan_efficiency(F.size("expected_plan"), F.size("executed_steps")), skip=lambda: F.when(F.col("executed_steps").isNull(), "Trace does not provide executed steps."), ground_truth_keys=("expected_plan",)))
    r.register(Metric("plan_matching", "agent_root", lambda: sequence_match(F.col("executed_steps"), F.col("expected_plan")), ground_truth_keys=("expected_plan",)))
    for kind in ("document", "snippet"):
        for stage, suffix in (("selected", ""), ("retrieved", "_retrieved")):
            ids = lambda kind=kind, stage=stage: retrieved_ids(F.col("retrieval"), kind, stage)
            gold = lambda kind=kind: F.col(f"relevant_{kind}_ids")
            for name, rule in (("precision", set_precision), ("recall", set_recall)):
                if suffix and kind == "snippet":
                    continue
                r.register(Metric(f"set_{name}{suffix}_{kind}", "agent_root", lambda ids=ids, gold=gold, rule=rule: rule(ids(), gold())[1], skip=lambda ids=ids, gold=gold, rule=rule, kind=kind, stage=stage: F.coalesce(retrieval_skip(F.col("retrieval"), kind, stage), rule(ids(), gold())[0]), ground_truth_keys=(f"relevant_{kind}_ids",)))
        rankings = lambda kind=kind: F.transform(F.filter(selected(F.col("retrieval"), kind, "selected"), lambda x: x["availability"] == "available"), lambda x: x["ids"])
        r.register(Metric(f"ndcg_at_10_{kind}", "agent_root", lambda rankings=rankings, kind=kind: mean_ndcg(rankings(), F.col(f"relevant_{kind}_ids")), skip=lambda kind=kind: F.coalesce(retrieval_skip(F.col("retrieval"), kind, ranked=True), F.when(F.size(f"relevant_{kind}_ids") == 0, "No relevant IDs, so nDCG is undefined.")), ground_truth_keys=(f"relevant_{kind}_ids",)))
    return r


def compute(plan: DataFrame, metrics: list[Metric]) -> DataFrame:
    """Score every planned (metric, target) row; plan rows carry the span's columns, ``metric`` and ``skip_reason``.

    One select for all metrics: a row's metric picks its branch, so that the plan is read once.
    """
    skip = fail = F.lit(None).cast("string")
    score = F.lit(None).cast("double")
    for m in metrics:
        mine = F.col("metric") == m.name
        skip, fail, score = F.when(mine, m.skip()).otherwise(skip), F.when(mine, m.fail()).otherwise(fail), F.when(mine, m.score()).otherwise(score)
    usage = [c for c in ("input_tokens", "output_tokens") if c in plan.columns]
    whole = F.col("metric").isin([m.name for m in metrics if m.renders])  # how long the text was, of failed units too
    usage += [F.when(whole, F.col(c)).alias(c) for c in ("rendered_spans", "rendered_chars") if any(m.renders for m in metrics)]
    return plan.select("trace_id", "metric", "target_span_type", "span_ids", *result(F.coalesce(F.col("skip_reason"), skip), fail, score), *usage)
