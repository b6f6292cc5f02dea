"""Metrics of judges through the registry and ``evaluate``.

Conversations are the traces: the turns' roles are what was retrieved and the claims. The judge reads its verdicts off the
request's SHA-256, so that SQL can say the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill import service
from tracemill.operators import judged, metrics
from tracemill.plans.lens import Lens
from tracemill.suite import query


def traces(t: Lens) -> DataFrame:
    """A row for each conversation. Snippets are the turns' roles with their numbers; every seventh has none available,
    every fifth an empty result. Documents are the same at both stages."""
    c, k = t.conversations(), F.col("conv_id")
    ids = F.transform("executed", lambda x, i: F.concat(F.lit("t"), i.cast("string")))
    items = lambda values: F.when(k % 5 == 0, F.filter(values, lambda x: F.lit(False))).otherwise(values)
    one = lambda kind, stage: F.struct(F.lit(kind).alias("kind"), F.lit(stage).alias("stage"), F.when(k % 7 == 0, "unavailable").otherwise("available").alias("availability"), F.lit("timeout").alias("reason"), items(ids).alias("ids"), items(F.col("executed")).alias("contents"), F.lit(True).alias("ranked"))
    claims = F.transform("expected", lambda x, i: F.concat(x, F.lit(" "), i.cast("string")))
    relevant = F.when(k % 3 == 0, F.filter(ids, lambda x: F.lit(False))).otherwise(F.filter(ids, lambda x, i: i % 2 == 0))
    return c.select(k.alias("trace_id"), F.md5("request").alias("request"), F.md5("answer").alias("answer"), F.md5("answer").alias("expected_output"), F.col("executed").alias("executed_steps"), F.col("expected").alias("expected_plan"), F.array(one("snippet", "selected"), one("document", "selected"), one("document", "retrieved")).alias("retrieval"), relevant.alias("relevant_snippet_ids"), relevant.alias("relevant_document_ids"), claims.alias("claims"), F.when(k % 11 > 0, claims).alias("gold_claims"), F.slice(claims, 1, 2).alias("extracted_claims"))


TRACES = """, tr AS (SELECT conv_id AS k, md5(request) AS request, md5(answer) AS answer, executed, expected, CASE WHEN conv_id % 5 = 0 THEN [] ELSE executed END AS items,
 list_transform(expected, lambda x, i: x || ' ' || (i - 1)) AS claims FROM conv)"""


def low(i: Column) -> Column:
    """Whether the hash's i-th digit is below 8."""
    return F.substring("request_hash", i, F.lit(1)) < "8"


def judge(requests: DataFrame) -> DataFrame:
    """A score from the first digit; of 32 items and 32 claims each as its digit says, cut to the paragraph's lines; the ranks named go down, and one in eight lacks the first."""
    parts = F.split("text", "\n\n", -1)
    name = F.element_at(parts, 1)
    lines = lambda p: F.when(F.element_at(parts, p) == "", 0).otherwise(F.size(F.split(F.element_at(parts, p), "\n", -1)))
    flags = lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.lit(64)), lambda i: i <= n), low)
    backwards = lambda n: F.when(n > 0, F.reverse(F.sequence(F.lit(1), n))).otherwise(F.array().cast("array<int>"))
    ranks = lambda n: F.when(F.substring("request_hash", 63, 1) < "2", F.slice(backwards(n), 1, F.greatest(n - 1, F.lit(0)))).otherwise(backwards(n))
    score = F.conv(F.substring("request_hash", 1, 1), 16, 10).cast("double") / 15
    binary = F.when(name == "answer_correctness_judge", F.when(score > 0.9, 2.0).otherwise(F.round(score))).otherwise(score)
    failure = F.when(F.substring("request_hash", 64, 1) == "0", "timeout")
    return requests.select("request_hash", binary.alias("score"), F.array(flags(lines(3))).alias("rankings"), F.array(ranks(lines(3))).alias("ranks"), flags(F.when(name.endswith("_judge"), 3).otherwise(lines(3))).alias("attributable"), failure.alias("failure"), F.length("text").cast("long").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"))


def extractor(requests: DataFrame) -> DataFrame:
    """Three claims, the second of them unverifiable."""
    claim = lambda i, kind: F.struct(F.substring("text", i, 4).alias("text"), F.lit(kind).alias("kind"))
    return requests.select("request_hash", F.array(claim(1, "fact"), claim(5, "Unverifiable"), claim(9, "fact")).alias("claims"))


def scored(t: Lens, *names: str) -> DataFrame:
    """(trace_id, metric, status, score) through ``evaluate``; a trace's only span is its root."""
    rows = traces(t)
    spans = rows.select("trace_id", F.lit("agent_root").alias("span_type"), F.lit(0).cast("long").alias("start_us"), F.col("trace_id").alias("span_id"))
    found = service.evaluate(rows, spans, names=list(names), judge=judge, extractor=extractor)
    return found.select("trace_id", "metric", "status", F.round("score", 6).alias("score"))


def request_sql(name: str, *parts: str) -> str:
    return "sha256(concat_ws(chr(10) || chr(10), " + ", ".join([f"'{name}'", "request", *parts]) + "))"


ITEMS = "array_to_string(items, chr(10))"
LOW = "len(list_filter(range(1, {n} + 1), lambda i: substr(h, i, 1) < '8'))"


def verdict_sql(name: str, request: str, skip: str, unasked: str, fault: str, score: str) -> str:
    """One metric's rows: skipped, not asked and so 0, failed, or scored. Names: h is the request's hash."""
    return f"""SELECT k AS trace_id, '{name}' AS metric, CASE WHEN {skip} THEN 'SKIPPED' WHEN {fault} OR (NOT ({unasked}) AND substr(h, 64, 1) = '0') THEN 'FAILED' ELSE 'COMPLETED' END AS status,
 CASE WHEN NOT ({skip}) AND NOT ({fault}) AND NOT (NOT ({unasked}) AND substr(h, 64, 1) = '0') THEN round(CASE WHEN {unasked} THEN 0 ELSE {score} END, 6) END AS score FROM (SELECT *, {request} AS h FROM tr) q"""


GONE = "k % 7 = 0"
DIGIT = "CAST(strpos('0123456789abcdef', substr(h, 1, 1)) - 1 AS DOUBLE) / 15"


def recall_sql(name: str, claims: str, least: str = "false") -> str:
    n = f"len({claims})"
    return verdict_sql(name, request_sql(name, f"array_to_string({claims}, chr(10))", ITEMS), GONE, f"len(items) = 0 OR {n} = 0", least, f"CASE WHEN {n} = 0 THEN 0 ELSE {LOW.format(n=n)} / {n} END")


def judged_recall_sql(name: str) -> str:
    return verdict_sql(name, request_sql(name, "answer", ITEMS), GONE, "len(items) = 0", "false", LOW.format(n=3) + " / 3")


def precision_sql(name: str) -> str:
    hits = "list_filter(range(1, len(items) + 1), lambda i: substr(h, i, 1) < '8')"
    each = f"list_transform({hits}, lambda i, j: j / i)"
    return verdict_sql(name, request_sql(name, ITEMS), GONE, "false", "false", f"CASE WHEN len({hits}) = 0 THEN 0 ELSE list_avg({each}) END")


def both(sql, *names: str) -> str:
    return TRACES + " " + " UNION ALL ".join(sql(n) for n in names)


SETS = """, g AS (SELECT k, items, CASE WHEN k % 3 = 0 THEN 0 ELSE (len(executed) + 1) // 2 END AS relevant, CASE WHEN k % 3 = 0 THEN 0 ELSE (len(items) + 1) // 2 END AS hits FROM tr)"""


@query("m05_snippet_precision", TRACES + SETS + """ SELECT k AS trace_id, 'set_precision_snippet' AS metric, CASE WHEN k % 7 = 0 OR len(items) = 0 AND relevant > 0 THEN 'SKIPPED' ELSE 'COMPLETED' END AS status,
 round(CASE WHEN k % 7 = 0 THEN NULL WHEN len(items) = 0 THEN CASE WHEN relevant = 0 THEN 1.0 END ELSE hits / len(items) END, 6) AS score FROM g""", "conv")
def _(t: Lens) -> DataFrame:
    return scored(t, "set_precision_snippet")


@query("m07_snippet_recall", TRACES + SETS + """ SELECT k AS trace_id, 'set_recall_snippet' AS metric, CASE WHEN k % 7 = 0 OR relevant = 0 THEN 'SKIPPED' ELSE 'COMPLETED' END AS status,
 round(CASE WHEN k % 7 > 0 AND relevant > 0 THEN hits / relevant END, 6) AS score FROM g""", "conv")
def _(t: Lens) -> DataFrame:
    return scored(t, "set_recall_snippet")


@query("m09_snippet_ndcg", TRACES + SETS + """ SELECT k AS trace_id, 'ndcg_at_10_snippet' AS metric, CASE WHEN k % 7 = 0 OR relevant = 0 THEN 'SKIPPED' ELSE 'COMPLETED' END AS status,
 round(CASE WHEN k % 7 > 0 AND relevant > 0 THEN coalesce(list_sum(list_transform(list_filter(range(1, least(len(items), 10) + 1), lambda i: i % 2 = 1), lambda i: 1 / log2(i + 1))), 0) / list_sum(list_transform(range(1, least(relevant, 10) + 1), lambda i: 1 / log2(i + 1))) END, 6) AS score FROM g""", "conv")
def _(t: Lens) -> DataFrame:
    return scored(t, "ndcg_at_10_snippet")


@query("m10_judged_answers", TRACES + " " + verdict_sql("answer_correctness_judge", request_sql("answer_correctness_judge", "answer", "answer"), "answer IS NULL", "false", f"answer IS NOT NULL AND {DIGIT} > 0.9", f"round({DIGIT})"), "conv")
def _(t: Lens) -> DataFrame:
    return scored(t, "answer_correctness_judge")


@query("m11_judged_plans", TRACES + " " + verdict_sql("plan_correctness_judge", request_sql("plan_correctness_judge", "array_to_string(expected, chr(10))", "array_to_string(executed, chr(10))"), "false", "false", "false", DIGIT), "conv")
def _(t: Lens) -> DataFrame:
    return scored(t, "plan_correctness_judge")


@query("m12_judged_precision", both(precision_sql, "contextual_precision_document_judge", "contextual_precision_snippet_judge"), "conv")
def _(t: Lens) -> DataFrame:
    return scored(t, "contextual_precision_document_judge", "contextual_precision_snippet_judge")


@query("m15_judged_recall", both(judged_recall_sql, "contextual_recall_document_judge", "contextual_recall_snippet_judge"), "conv")
def _(t: Lens) -> DataFrame:
    return scored(t, "contextual_recall_document_judge", "contextual_recall_snippet_judge")


@query("m17_extracted_claims", both(lambda n: recall_sql(n, "CASE WHEN answer IS NULL THEN [] ELSE [substr(answer, 1, 4), substr(answer, 9, 4)] END"), "contextual_recall_document_claim_extractor", "contextual_recall_snippet_claim_extractor"), "conv")
def _(t: Lens) -> DataFrame:
    return scored(t, "contextual_recall_document_claim_extractor", "contextual_recall_snippet_claim_extractor")


@query("m19_stored_claims", both(lambda n: recall_sql(n, "claims"), "contextual_recall_document_stored_claims", "contextual_recall_snippet_stored_claims"), "conv")
def _(t: Lens) -> DataFrame:
    return scored(t, "contextual_recall_document_stored_claims", "contextual_recall_snippet_stored_claims")


@query("m21_gold_claims", TRACES + " " + recall_sql("contextual_recall_gold_claims", "CASE WHEN k % 11 > 0 THEN claims ELSE [] END", "k % 11 = 0") + " UNION ALL " + recall_sql("contextual_recall_extracted_claims", "claims[1:2]"), "conv")
def _(t: Lens) -> DataFrame:
    return scored(t, "contextual_recall_gold_claims", "contextual_recall_extracted_claims")


BACK = "list_filter(range(1, len(items) + 1), lambda i: substr(h, len(items) + 1 - i, 1) < '8')"
NUMBERED = "array_to_string(list_transform({c}, lambda c, i: i || '. ' || c), chr(10))"
GOLD = "CASE WHEN k % 11 > 0 THEN claims ELSE [] END"


@query("m22_single_call", TRACES + " " + verdict_sql("contextual_precision_document_judge_sc", request_sql("contextual_precision_document_judge_sc", ITEMS), GONE, "false", "len(items) > 0 AND substr(h, 63, 1) < '2'", f"CASE WHEN len({BACK}) = 0 THEN 0 ELSE list_avg(list_transform({BACK}, lambda i, j: j / i)) END")
       + " UNION ALL " + verdict_sql("contextual_recall_gold_claims_sc_question", request_sql("contextual_recall_gold_claims_sc_question", NUMBERED.format(c=f"({GOLD})"), ITEMS), GONE, f"len(items) = 0 OR len({GOLD}) = 0", "k % 11 = 0", f"CASE WHEN len({GOLD}) = 0 THEN 0 ELSE {LOW.format(n=f'len({GOLD})')} / len({GOLD}) END"), "conv")
def _(t: Lens) -> DataFrame:
    """All items of a ranking, and all claims, in one request; ranks that don't fit fail their unit."""
    return scored(t, "contextual_precision_document_judge_sc", "contextual_recall_gold_claims_sc_question")


@query("m24_by_position", TRACES + " " + precision_sql("deepeval_contextual_precision") + " UNION ALL " + recall_sql("deepeval_contextual_recall_gold_claims", GOLD, "k % 11 = 0") + " UNION ALL " + verdict_sql("deepeval_answer_correctness", request_sql("deepeval_answer_correctness", "answer", "answer"), "answer IS NULL", "false", "false", DIGIT), "conv")
def _(t: Lens) -> DataFrame:
    """Verdicts matched by their place alone."""
    return scored(t, "deepeval_contextual_precision", "deepeval_contextual_recall_gold_claims", "deepeval_answer_correctness")


JUDGED = [*(n.format(k) for n in ("contextual_precision_{}_judge", "contextual_recall_{}_judge", "contextual_recall_{}_stored_claims") for k in ("document", "snippet")), "answer_correctness_judge", "plan_correctness_judge", "contextual_recall_gold_claims", "contextual_recall_extracted_claims"]
EXTRACTED = [f"contextual_recall_{k}_claim_extractor" for k in ("document", "snippet")]
ALONE = ["llm_calls", "response_length", "plan_efficiency", "plan_matching", *(f"{m}_{k}" for m in ("set_precision", "set_recall", "ndcg_at_10") for k in ("document", "snippet")), "set_precision_retrieved_document", "set_recall_retrieved_document"]


def listed(clients: str, names: list[str]) -> str:
    return f"SELECT '{clients}' AS clients, unnest({names!r}) AS metric"


AVAILABLE_SQL = f"""
WITH m AS ({" UNION ALL ".join([listed("", ALONE), listed("judge", ALONE + JUDGED), listed("claim_extractor", ALONE), listed("claim_extractor,judge", ALONE + JUDGED + EXTRACTED)])}),
g AS (SELECT clients, string_agg(metric, ',' ORDER BY metric) AS metrics FROM m GROUP BY clients)
SELECT c_custkey, clients, metrics
FROM customer JOIN g ON clients = CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'judge' WHEN 2 THEN 'claim_extractor' ELSE 'claim_extractor,judge' END
"""


@query("m26_available", AVAILABLE_SQL)
def _(t: Lens) -> DataFrame:
    """Which metrics each customer's clients allow."""
    k, name = F.col("c_custkey") % 4, F.lit
    clients = F.array_compact(F.array(F.when(k >= 2, name("claim_extractor")), F.when(k % 2 == 1, name("judge"))))
    rows = t.table("customer").select("c_custkey", clients.alias("clients"))
    return rows.select("c_custkey", F.array_join("clients", ",").alias("clients"), F.array_join(F.array_sort(metrics.built_in().allowed(F.col("clients"))), ",").alias("metrics"))


@query("c23_rendered_items", "SELECT p_partkey, concat_ws(chr(10), CASE WHEN p_partkey % 2 = 0 THEN 'Rank: ' || p_size END, CASE WHEN p_partkey % 3 > 0 THEN 'Title: ' || p_name END, 'Text: ' || p_type) AS item FROM part")
def _(t: Lens) -> DataFrame:
    part, title = t.table("part"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).otherwise(" ")
    with_rank, without = judged.rendered_item(title, F.col("p_type"), F.col("p_size")), judged.rendered_item(title, F.col("p_type"))
    return part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, with_rank).otherwise(without).alias("item"))
