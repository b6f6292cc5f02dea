"""English stems, and BM25 over them, against known stems and a plain version."""

import math
from collections import Counter

from pyspark.sql import functions as F

from tests.conftest import DATA
from tracemill.functions import stemming, text
from tracemill.queries import queries

KNOWN = """consign consign consigned consign consigning consign consignment consign consist consist consistency consist consistently consist
consolation consol consolatory consolatori console consol consolidate consolid consolidating consolid consolingly consol consonant conson
conspicuously conspicu conspiracy conspiraci conspirators conspir constable constabl constancy constanc knackeries knackeri knavish knavish
kneaded knead kneeling kneel knees knee knife knife knightly knight knitted knit knitting knit knives knive knocker knocker knots knot
skies sky dying die news news inning inning proceed proceed generously generous general general communication communic arsenal arsenal
hopping hop hoping hope agreed agre feed feed plastered plaster bled bled sing sing motoring motor luxuriating luxuri ties tie cries cri gas gas
gaps gap kiwis kiwi happy happi say say by by enjoy enjoy national nation rational ration vietnamization vietnam operator oper feudalism feudal
hopefulness hope callousness callous electricity electr electrical electr goodness good revival reviv adoption adopt effective effect rate rate
roll roll controll control youth youth boy boy boyish boyish sayings say us us a a""".split()


def test_known_stems():
    assert {w: stemming.stem(w) for w in KNOWN[::2]} == dict(zip(KNOWN[::2], KNOWN[1::2], strict=True))


def test_stemmed_search(spark):
    got = {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in queries()["r02_stemmed_bm25"](spark, DATA).collect()}
    tokens = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", text.bm25_tokens(F.col("text")).alias("t")).collect()
    asked = spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", text.bm25_tokens(F.col("text")).alias("t")).collect()
    docs = {r["doc_id"]: Counter(map(stemming.stem, r["t"] or [])) for r in tokens}
    sizes = {r["doc_id"]: len(r["t"] or []) for r in tokens}
    average = max(1.0, round(sum(sizes.values()) / len(sizes), 1))
    df = Counter(s for c in docs.values() for s in c)
    want = {}
    for r in asked:
        scores = {}
        for s in {stemming.stem(t) for t in r["t"]}:
            idf = math.log(1 + (len(docs) - df[s] + 0.5) / (df[s] + 0.5))
            for d, c in docs.items():
                if c[s]:
                    scores[d] = scores.get(d, 0) + c[s] * 2.2 / (c[s] + 1.2 * (0.25 + 0.75 * sizes[d] / average)) * idf
        best = sorted((-round(v, 6), d) for d, v in scores.items())[:10]
        want |= {(r["item_id"], k): (d, round(-v, 4)) for k, (v, d) in enumerate(best, 1)}
    assert set(got) == set(want)
    assert sum(got[k][0] != want[k][0] for k in want) == 0 and all(abs(got[k][1] - want[k][1]) <= 1.5e-4 for k in want)
