"""Analyses and retrieval (E20-E33, F4-F6, F10-F12, D14, D16, R)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import stats, text
from tracemill.operators import analysis, batches, metrics, report, retrieval
from tracemill.plans.lens import Lens
from tracemill.suite import query

STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
TOKENS = f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: w NOT IN ({STOP}))"


@query("e20_macro", "SELECT dataset_id, round(avg(m), 6) AS score, count(*) AS questions FROM (SELECT dataset_id, run_id, avg(score) AS m FROM comp JOIN run USING (run_id) WHERE comp.status = 'COMPLETED' AND score IS NOT NULL GROUP BY ALL) q GROUP BY dataset_id", "comp run")
def _(t: Lens) -> DataFrame:
    rows = t.computations().where(report.SCORED).select("run_id", "score").join(t.runs().select("run_id", "dataset_id"), "run_id")
    return analysis.macro_score(rows, ["dataset_id"], ["run_id"], "score")


@query("e33_micro", "SELECT dataset_id, round(avg(score), 6) AS score, count(*) AS units FROM comp JOIN run USING (run_id) WHERE comp.status = 'COMPLETED' AND score IS NOT NULL GROUP BY ALL", "comp run")
def _(t: Lens) -> DataFrame:
    rows = t.computations().where(report.SCORED).select("run_id", "score").join(t.runs().select("run_id", "dataset_id"), "run_id")
    return rows.groupBy("dataset_id").agg(F.round(F.avg("score"), 6).alias("score"), F.count(F.lit(1)).alias("units"))


def decisions(t: Lens) -> DataFrame:
    labels = t.table("labels").select("doc_id", (F.col("quality") == 1).alias("accepted"), (F.col("toxic") == 0).alias("gold"))
    return labels.join(t.table("documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


DEC = "dec AS (SELECT l.doc_id, quality = 1 AS accepted, toxic = 0 AS gold, lang, source, n_chars FROM labels l JOIN documents d USING (doc_id))"


@query("e21_kappa", f"WITH {DEC}, p AS (SELECT lang, avg(CAST(accepted = gold AS INT)) AS po, avg(CAST(accepted AS INT)) AS a, avg(CAST(gold AS INT)) AS b, count(*) AS n FROM dec GROUP BY lang) SELECT lang, CASE WHEN a * b + (1 - a) * (1 - b) < 1 - 1e-12 THEN round((po - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 6) END AS kappa, round(po, 6) AS agreement, n FROM p")
def _(t: Lens) -> DataFrame:
    return analysis.agreement(decisions(t), ["lang"], "accepted", "gold")


@query("e22_decisions", f"WITH {DEC} SELECT lang, count(DISTINCT source) AS questions, CAST(count(*) FILTER (WHERE doc_id % 5 <> 0 AND gold) AS BIGINT) AS gold, CAST(count(*) FILTER (WHERE doc_id % 5 <> 0 AND NOT gold) AS BIGINT) AS other, round(avg(CAST(accepted AS INT)) FILTER (WHERE doc_id % 5 <> 0 AND gold), 6) AS gold_accepted, round(avg(CAST(accepted AS INT)) FILTER (WHERE doc_id % 5 <> 0 AND NOT gold), 6) AS other_accepted, CAST(count(*) FILTER (WHERE doc_id % 5 = 0) AS BIGINT) AS unjudged FROM dec GROUP BY lang")
def _(t: Lens) -> DataFrame:
    return analysis.decision_summary(decisions(t).withColumns({"question": F.col("source"), "judged": F.col("doc_id") % 5 != 0}), ["lang"])


@query("d13_decision_join", f"WITH {DEC} SELECT lang, accepted, gold, count(*) AS n FROM dec GROUP BY ALL")
def _(t: Lens) -> DataFrame:
    return decisions(t).groupBy("lang", "accepted", "gold").agg(F.count(F.lit(1)).alias("n"))


@query("d16_auroc", f"WITH {DEC} SELECT round(sum(CASE WHEN p.n_chars > n.n_chars THEN 1.0 WHEN p.n_chars = n.n_chars THEN 0.5 ELSE 0 END) / count(*), 6) AS auroc FROM dec p JOIN dec n ON p.accepted AND NOT n.accepted")
def _(t: Lens) -> DataFrame:
    one = stats.auroc(decisions(t).withColumn("all", F.lit(1)), ["all"], "n_chars", "accepted")
    return one.select(F.round("auroc", 6).alias("auroc"))


@query("e23_auroc_by_lang", f"WITH {DEC}, p AS (SELECT lang, accepted, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS r FROM dec), s AS (SELECT lang, sum(r) FILTER (WHERE accepted) AS sr, count(*) FILTER (WHERE accepted) AS p, count(*) FILTER (WHERE NOT accepted) AS n FROM p GROUP BY lang) SELECT lang, CASE WHEN p > 0 AND n > 0 THEN round((sr - p * (p + 1) / 2) / (p * n), 6) END AS auroc, p AS positives, n AS negatives FROM s")
def _(t: Lens) -> DataFrame:
    return stats.auroc(decisions(t), ["lang"], "n_chars", "accepted").withColumn("auroc", F.round("auroc", 6))


RETEST = "v AS (SELECT l_linenumber % 3 + 1 AS rep, l_orderkey AS run_id, l_partkey % 5 AS item, round(avg(l_discount), 6) AS value FROM lineitem GROUP BY ALL), pr AS (SELECT a.rep AS a, b.rep AS b, a.run_id, a.value AS x, b.value AS y FROM v a JOIN v b ON a.run_id = b.run_id AND a.item = b.item AND a.rep < b.rep)"


def repeated(t: Lens) -> DataFrame:
    lines = t.table("lineitem").select((F.col("l_linenumber") % 3 + 1).alias("rep"), F.col("l_orderkey").alias("run_id"), (F.col("l_partkey") % 5).alias("item"), "l_discount")
    return lines.groupBy("rep", "run_id", "item").agg(F.round(F.avg("l_discount"), 6).alias("value"))


@query("d14_retest_pairs", f"WITH {RETEST} SELECT a, b, count(*) AS n, round(avg(abs(x - y)), 6) AS gap FROM pr GROUP BY ALL")
def _(t: Lens) -> DataFrame:
    pairs = analysis.retest_pairs(repeated(t), ["run_id", "item"], "rep", "value")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("x") - F.col("y"))), 6).alias("gap"))


@query("e25_spearman", f"WITH {RETEST}, r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2 AS ry FROM pr) SELECT a, b, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r GROUP BY ALL")
def _(t: Lens) -> DataFrame:
    return analysis.spearman(analysis.retest_pairs(repeated(t), ["run_id", "item"], "rep", "value"), ["a", "b"], "x", "y")


@query("e26_retest_mean", f"WITH {RETEST}, k AS (SELECT a, b, avg(CAST((x > 0.05) = (y > 0.05) AS INT)) AS po, avg(CAST(x > 0.05 AS INT)) AS p, avg(CAST(y > 0.05 AS INT)) AS q FROM pr GROUP BY ALL), kk AS (SELECT round((po - (p * q + (1 - p) * (1 - q))) / (1 - (p * q + (1 - p) * (1 - q))), 6) AS kappa FROM k) SELECT CASE WHEN count(kappa) = 3 THEN round(avg(kappa), 6) END AS mean, count(kappa) AS \"values\" FROM kk")
def _(t: Lens) -> DataFrame:
    pairs = analysis.retest_pairs(repeated(t), ["run_id", "item"], "rep", "value").withColumns({"u": F.col("x") > 0.05, "w": F.col("y") > 0.05})
    return analysis.mean_if_all(analysis.agreement(pairs, ["a", "b"], "u", "w"), "kappa", 3)


@query("e24_plan_summary", "SELECT l_returnflag AS config, CAST(count(*) FILTER (WHERE l_discount > 0.05) AS BIGINT) AS rewarded, CAST(count(*) FILTER (WHERE l_discount > 0.05 AND l_linenumber <> 1) AS BIGINT) AS deviating, round(avg(l_tax) FILTER (WHERE l_discount > 0.05 AND l_linenumber <> 1), 6) AS mean_pc, round(avg(l_quantity) FILTER (WHERE l_discount > 0.05 AND l_linenumber <> 1), 6) AS mean_matching FROM lineitem GROUP BY 1")
def _(t: Lens) -> DataFrame:
    rows = t.table("lineitem").select(F.col("l_returnflag").alias("config"), (F.col("l_discount") > 0.05).alias("rewarded"), (F.col("l_linenumber") == 1).alias("follows_reference"), F.col("l_tax").alias("pc"), F.col("l_quantity").alias("matching"))
    return analysis.plan_summary(rows, ["config"])


@query("e27_nearest_rank", "SELECT lang, quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.95) AS p95, CAST(count(*) FILTER (WHERE n > 2000) AS BIGINT) AS over, count(*) AS n FROM (SELECT lang, CAST(length(text) AS BIGINT) AS n FROM documents) q GROUP BY lang")
def _(t: Lens) -> DataFrame:
    docs = t.table("documents").select("lang", F.length("text").cast("long").alias("chars"))
    return analysis.nearest_rank(docs, ["lang"], "chars", [50, 95], 2000)


@query("e28_benchmark_stats", "SELECT CAST(count(DISTINCT b.item_id) AS BIGINT) AS items, CAST(count(DISTINCT g.item_id) AS BIGINT) AS with_gold, CAST(count(DISTINCT g.doc_id) AS BIGINT) AS gold_docs, CAST(count(g.doc_id) AS BIGINT) AS links FROM benchmark b LEFT JOIN gold g USING (item_id)", "gold")
def _(t: Lens) -> DataFrame:
    return t.table("benchmark").select("item_id").join(t.gold().withColumnRenamed("item_id", "g"), F.col("item_id") == F.col("g"), "left").agg(F.count_distinct("item_id").alias("items"), F.count_distinct("g").alias("with_gold"), F.count_distinct("doc_id").alias("gold_docs"), F.count("doc_id").alias("links"))


@query("e29_longest_gold", "SELECT item_id, CAST(max(length(text)) AS BIGINT) AS chars FROM gold JOIN documents USING (doc_id) GROUP BY item_id", "gold")
def _(t: Lens) -> DataFrame:
    docs = t.table("documents").select("doc_id", F.length("text").cast("long").alias("n"))
    return t.gold().join(docs, "doc_id").groupBy("item_id").agg(F.max("n").alias("chars"))


@query("e30_bm25_average", f"SELECT count(*) AS n, greatest(1.0, round_even(avg(len({TOKENS})), 1)) AS avg_len FROM documents")
def _(t: Lens) -> DataFrame:
    return retrieval.average_length(retrieval.token_table(t.table("documents")))


@query("e31_failed_units", "SELECT metric, CASE l_linenumber % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'misaligned' ELSE 'unclassified' END AS failure, count(*) AS n FROM comp WHERE status = 'FAILED' GROUP BY ALL", "comp")
def _(t: Lens) -> DataFrame:
    k = F.col("l_linenumber") % 3
    return analysis.failed_units(t.computations().withColumn("failure", F.when(k == 0, "timeout").when(k == 1, "misaligned")))


@query("e32_pooled", f"WITH {DEC} SELECT lang, source, count(*) AS n, round(avg(CAST(accepted AS INT)), 6) AS accepted FROM dec GROUP BY GROUPING SETS ((lang, source), (lang))")
def _(t: Lens) -> DataFrame:
    return analysis.pooled(decisions(t), [["lang", "source"], ["lang"]], ["lang", "source"], [F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("accepted").cast("int")), 6).alias("accepted")])


@query("f04_first_decision", "SELECT run_id, sample_id, arg_min(metric, (us, l_partkey, l_suppkey, l_linenumber)) AS metric FROM comp GROUP BY ALL", "comp")
def _(t: Lens) -> DataFrame:
    return analysis.first_decisions(t.computations(), ["run_id", "sample_id"], ["us", "l_partkey", "l_suppkey", "l_linenumber"], ["metric"])


@query("f05_latest_attempt", "SELECT run_id, metric, l_linenumber, count(*) AS n FROM (SELECT *, dense_rank() OVER (PARTITION BY run_id, metric ORDER BY l_linenumber DESC) AS k FROM comp WHERE status = 'COMPLETED') q WHERE k = 1 GROUP BY ALL", "comp")
def _(t: Lens) -> DataFrame:
    done = t.computations().where("status = 'COMPLETED'")
    return analysis.latest_attempts(done, ["run_id", "metric"], "l_linenumber").groupBy("run_id", "metric", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("f06_chains", "SELECT agent_id, string_agg(CAST(run_id AS VARCHAR), ',' ORDER BY start_us, run_id) AS runs, count(DISTINCT dataset_id) <= 1 AS one_source FROM run GROUP BY agent_id", "run")
def _(t: Lens) -> DataFrame:
    found = analysis.chains(t.runs(), ["agent_id"], source="dataset_id")
    return found.select("agent_id", F.array_join(F.transform("runs", lambda x: x.cast("string")), ",").alias("runs"), "one_source")


@query("f10_average_ranks", "SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000)) + (count(*) OVER (PARTITION BY s_nationkey, floor(s_acctbal / 1000)) - 1) / 2 AS rank FROM supplier")
def _(t: Lens) -> DataFrame:
    s = t.table("supplier").withColumn("v", F.floor(F.col("s_acctbal") / 1000))
    return stats.with_average_rank(s.select("s_suppkey", "s_nationkey", "v"), ["s_nationkey"], "v", "rank").select("s_suppkey", "rank")


@query("f11_evidence", "SELECT trace_id, event_type, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY first_us, span_id) AS BIGINT) AS position FROM (SELECT trace_id, event_type, min(start_us) AS first_us, arg_min(span_id, (start_us, span_id)) AS span_id FROM span GROUP BY ALL) q", "span")
def _(t: Lens) -> DataFrame:
    return retrieval.first_evidence(t.spans(), "trace_id", ["event_type"], ["start_us", "span_id"]).withColumn("position", F.col("position").cast("long"))


@query("f12_shards", 'SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS "row", (row_number() OVER (ORDER BY doc_id) - 1) // 256 AS shard FROM documents')
def _(t: Lens) -> DataFrame:
    return retrieval.shard_numbers(t.table("documents").select("doc_id"), "doc_id", 256)


@query("f12_request_batches", """WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, length(coalesce(text, '')) // 4 + 1 AS tokens FROM documents),
s AS (SELECT *, sum(tokens) OVER (ORDER BY i) AS upto FROM d),
x AS (SELECT a.i, least(a.i + 96, coalesce(min(b.i), (SELECT count(*) FROM d))) AS nxt FROM s a LEFT JOIN s b ON b.i > a.i AND b.i <= a.i + 96 AND b.upto - a.upto + a.tokens > 5000 GROUP BY a.i),
r AS (SELECT CAST(0 AS BIGINT) AS i UNION ALL SELECT x.nxt FROM r JOIN x USING (i)),
n AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS batch FROM r WHERE i < (SELECT count(*) FROM d))
SELECT doc_id, d.i AS "row", CAST(tokens AS BIGINT) AS tokens, CAST(max(n.batch) AS BIGINT) AS batch FROM d JOIN n ON n.i <= d.i GROUP BY ALL""")
def _(t: Lens) -> DataFrame:
    """All documents in requests of at most 96 texts and 5,000 tokens."""
    return batches.request_batches(t.table("documents"), "doc_id", batches.estimated_tokens(F.col("text")), 5000)


@query("r01_tokens", f"SELECT doc_id, CAST(len({TOKENS}) AS BIGINT) AS length FROM documents")
def _(t: Lens) -> DataFrame:
    return t.table("documents").select("doc_id", F.size(text.bm25_tokens(F.col("text"))).cast("long").alias("length"))


BM25 = f"""d AS (SELECT doc_id, {TOKENS} AS t FROM documents), q AS (SELECT item_id, unnest(list_distinct({TOKENS})) AS term FROM benchmark),
f AS (SELECT count(*) AS n, greatest(1.0, round_even(avg(len(t)), 1)) AS a FROM d),
tt AS (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d), tf AS (SELECT doc_id, len, term, count(*) AS tf FROM tt GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT item_id, doc_id, round(sum(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a)) * ln(1 + (n - df + 0.5) / (df + 0.5))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), f GROUP BY item_id, doc_id),
bmr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rk FROM bm)"""


def sparse_top(t: Lens, k: int = 50, stemmed: bool = False) -> DataFrame:
    return retrieval.top_k(retrieval.bm25(t.table("documents"), t.table("benchmark"), stemmed=stemmed), k, "item_id", "doc_id")


@query("r02_bm25", f"WITH {BM25} SELECT item_id, CAST(rk AS BIGINT) AS rank, doc_id, round(score, 4) AS score FROM bmr WHERE rk <= 10")
def _(t: Lens) -> DataFrame:
    return sparse_top(t, 10).select("item_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 4).alias("score"))


@query("r02_stemmed_bm25")
def _(t: Lens) -> DataFrame:
    """SQL has no stems: a test holds it against a plain version."""
    return sparse_top(t, 10, stemmed=True).select("item_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 4).alias("score"))


@query("r03_cosine", "SELECT query_id, vec_id, score FROM dense WHERE rk <= 5", "cand")
def _(t: Lens) -> DataFrame:
    return retrieval.dense_top(*t.dense(), 5, own=False).select("query_id", "vec_id", "score")


@query("g02_dense_top50", "SELECT query_id, vec_id, CAST(rk AS BIGINT) AS rank FROM dense WHERE rk <= 50", "cand")
def _(t: Lens) -> DataFrame:
    return retrieval.dense_top(*t.dense(), 50, own=False).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


#: Dense and sparse rankings of the documents for each benchmark item: an item's vector is that of its number, as a document's is.
BOTH = f"""{BM25}, dv AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), dq AS (SELECT item_id, v FROM benchmark JOIN dv ON vec_id = item_id), dd AS (SELECT doc_id, v FROM documents JOIN dv ON vec_id = doc_id),
x AS (SELECT item_id AS q, doc_id AS i, row_number() OVER (PARTITION BY item_id ORDER BY round(list_cosine_similarity(dq.v, dd.v), 6) DESC, doc_id) AS rk FROM dq CROSS JOIN dd),
y AS (SELECT item_id AS q, doc_id AS i, rk FROM bmr),
rr AS (SELECT coalesce(a.q, b.q) AS q, coalesce(a.i, b.i) AS i, a.rk AS r0, b.rk AS r1 FROM (SELECT * FROM x WHERE rk <= 50) a FULL JOIN (SELECT * FROM y WHERE rk <= 50) b ON a.q = b.q AND a.i = b.i),
fu AS (SELECT q, i, row_number() OVER (PARTITION BY q ORDER BY round(coalesce(1.0 / (60 + r0), 0) + coalesce(1.0 / (60 + r1), 0), 12) DESC, least(coalesce(r0, 1073741824), coalesce(r1, 1073741824)), r0 NULLS LAST, r1 NULLS LAST, i) AS position FROM rr)"""


def rankings(t: Lens) -> list[DataFrame]:
    """The 50 best documents of each benchmark item by cosine and by BM25: (q, i, rank)."""
    vectors = t.table("embeddings").select("vec_id", "embedding", "label")
    asked = t.table("benchmark").select(F.col("item_id").alias("vec_id")).join(vectors, "vec_id")
    there = t.table("documents").select(F.col("doc_id").alias("vec_id")).join(vectors, "vec_id")
    dense = retrieval.dense_top(asked, there, 50)
    return [dense.select(F.col("query_id").alias("q"), F.col("vec_id").alias("i"), "rank"), sparse_top(t).select(F.col("item_id").alias("q"), F.col("doc_id").alias("i"), "rank")]


@query("r04_rrf", f"WITH {BOTH} SELECT q, i, CAST(position AS BIGINT) AS position FROM fu")
def _(t: Lens) -> DataFrame:
    return retrieval.fused(rankings(t), "q", "i").select("q", "i", F.col("position").cast("long").alias("position"))


@query("r05_hybrid", f"WITH {BOTH} SELECT q, i, md5(text) AS payload, CAST(position AS BIGINT) AS position FROM fu JOIN documents ON doc_id = i WHERE position <= 10")
def _(t: Lens) -> DataFrame:
    best = retrieval.hybrid(*rankings(t), "q", "i")
    return best.join(t.table("documents").select(F.col("doc_id").alias("i"), F.md5("text").alias("payload")), "i").select("q", "i", "payload", F.col("position").cast("long").alias("position"))


DRAWN = "CAST('0x' || left(sha256(concat_ws(':', '7', {})), 12) AS BIGINT)"


@query("r06_degraded", f"""WITH {BOTH}, best AS (SELECT q, i, position AS rank FROM fu WHERE position <= 10),
pool AS (SELECT p_partkey AS i, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part), m AS (SELECT count(*) AS m FROM pool),
pr AS (SELECT m, min(c) AS p FROM m, LATERAL (SELECT unnest(range(m, m + 1000)) AS c) x WHERE len(list_filter(range(2, CAST(floor(sqrt(c)) AS BIGINT) + 1), lambda d: c % d = 0)) = 0 GROUP BY m),
sz AS (SELECT q, count(*) AS n, CAST(floor(count(*) * CAST(0.4 AS DOUBLE) + {DRAWN.format("q, 'count'")} / CAST(281474976710656 AS DOUBLE)) AS BIGINT) AS swaps FROM best GROUP BY q),
mk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY {DRAWN.format("q, i")}, i) AS o FROM best JOIN sz USING (q)),
wk AS (SELECT q, j, ({DRAWN.format("q, 'start'")} % p + j * (1 + {DRAWN.format("q, 'step'")} % (p - 1))) % p AS place FROM (SELECT q, n, swaps, p, unnest(range(n + swaps + p - m)) AS j FROM sz, pr) z),
nw AS (SELECT q, pool.i AS new, row_number() OVER (PARTITION BY q ORDER BY j) AS k FROM wk JOIN pool USING (place) WHERE (q, pool.i) NOT IN (SELECT (q, i) FROM best))
SELECT mk.q, mk.rank, coalesce(CASE WHEN o <= swaps THEN new END, mk.i) AS i, o <= swaps AND new IS NOT NULL AS swapped FROM mk LEFT JOIN nw ON nw.q = mk.q AND nw.k = mk.o""")
def _(t: Lens) -> DataFrame:
    best = retrieval.hybrid(*rankings(t), "q", "i").withColumn("rank", F.col("position").cast("long"))
    return retrieval.degraded(best, t.table("part").select(F.col("p_partkey").alias("i")), "q", "i", 0.4, 7)


@query("m20_retrieved_recall", f"WITH gold AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), {BM25} SELECT b.item_id, round(avg(CASE WHEN r.rk IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS recall FROM gold b LEFT JOIN bmr r ON r.item_id = b.item_id AND r.doc_id = b.doc_id AND rk <= 10 GROUP BY b.item_id")
def _(t: Lens) -> DataFrame:
    found = sparse_top(t, 10).select("item_id", "doc_id", F.lit(1).alias("found"))
    counts = t.gold().join(found, ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.count("found").alias("matched"), F.count(F.lit(1)).alias("relevant"))
    return counts.select("item_id", F.round(metrics.recall_of_counts(F.col("matched"), F.col("relevant"))[1], 6).alias("recall"))


def flagship(t: Lens) -> DataFrame:
    """Recall of dense retrieval by label: top 10 by cosine, recall by counts with its skip rule, one report row."""
    q, c = t.dense()
    top = retrieval.dense_top(q, c, 10, own=False)
    hits = top.groupBy("query_id").agg(F.count_if(F.col("label") == F.col("q_label")).alias("hits"))
    relevant = c.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("relevant"))  # but for the query itself
    rows = q.select(F.col("vec_id").alias("query_id"), "label").join(relevant, "label", "left").join(hits, "query_id", "left")
    skip, score = metrics.recall_of_counts(F.coalesce("hits", F.lit(0)), F.coalesce("relevant", F.lit(0)))
    done = rows.select(*metrics.result(skip, F.lit(None).cast("string"), score))
    scored = F.when(F.col("status") == "COMPLETED", F.col("score"))
    made = done.agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if(F.col("status") == "SKIPPED").alias("skipped"), *stats.score_moments(scored), F.round(F.coalesce(F.try_divide(F.count(scored).cast("double"), F.count(F.lit(1)).cast("double")), F.lit(0.0)), 6).alias("coverage"))
    return stats.with_quantiles(made, done.select(scored.alias("score")), [], "score", stats.QUARTILES)


@query("flagship", ", s AS (SELECT q.query_id, (SELECT count(*) FROM cv WHERE cv.label = q.label AND cv.vec_id <> q.query_id) AS rel, (SELECT count(*) FROM dense d WHERE d.query_id = q.query_id AND rk <= 10 AND d.label = q.label) AS hit FROM qv q), v AS (SELECT CASE WHEN rel > 0 THEN hit / rel END AS score FROM s) SELECT count(*) AS samples, count(score) AS completed, count(*) - count(score) AS skipped, count(score) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS stddev, round(min(score), 6) AS min, round(quantile_cont(score, 0.25), 6) AS p25, round(median(score), 6) AS median, round(quantile_cont(score, 0.75), 6) AS p75, round(max(score), 6) AS max, round(count(score) / count(*), 6) AS coverage FROM v", "cand")
def _(t: Lens) -> DataFrame:
    return flagship(t)


