"""The operators against plain versions of their methods, over whole tables, and their edge cases."""

import hashlib
import io
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.conftest import DATA
from tracemill.llm import arc, bpe, langid, linededup, media, neardup, packing, queries, toxicity, urlfilter

CLASH = ["text_", "__text", "score", "predicted", "lang_pred", "__score", "mark", "starts", "key", "c0", "a.b", "keys", "node", "n"]


def documents(spark, texts, ids=None, kind="long"):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame(list(zip(ids, texts, strict=True)), f"doc_id {kind}, text string")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH})


def table(name):
    return duckdb.sql(f"SELECT * FROM '{DATA}/{name}.parquet'").fetchdf()


# --- 1: encoding and decoding


def test_encoding_of_the_whole_table(spark):
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r["doc_id"]: r for r in queries.op1_byte_bpe(spark, DATA).collect()}
    for i, text in table("documents")[["doc_id", "text"]].itertuples(index=False):
        ids = theirs.encode_ordinary(text or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_encoding_repeats_and_names(spark):
    df = clashing(documents(spark, ["a b", "a b", None], ["x", "x", None], "string"))
    got = bpe.encode_decode(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=str) == sorted([("x", 2), ("x", 2), (None, 0)], key=str)


# --- 2: PPM with exclusion, in plain Python


def ppm_share(counts, contexts, history, symbol):
    """The share of a symbol after a history: counts[context][symbol]; only ``contexts`` are kept."""
    share, excluded, weight = None, set(), 1.0
    kept = [history[len(history) - k :] for k in (3, 2, 1, 0) if history[len(history) - k :] in contexts]

    def below(level):
        """Shares of all symbols in the shorter contexts from ``level`` on."""
        if level == len(kept):
            return [1 / 256] * 256
        seen = counts.get(kept[level], {})
        shorter = below(level + 1)
        total, distinct = sum(seen.values()), len(seen)
        if not total:
            return shorter
        rest = sum(shorter[s] for s in range(256) if s not in seen)
        escape = distinct / (total + distinct) if rest > 0 else 0
        return [(1 - escape) * seen[s] / total if s in seen else escape * shorter[s] / rest for s in range(256)]

    return below(0)[symbol]


def test_code_lengths_by_hand(spark):
    rng = random.Random(4)
    texts = {"aa": [" ".join(rng.choice(["tata", "tito", "nana"]) for _ in range(30)) for _ in range(6)], "bb": [" ".join(rng.choice(["tüta", "xito", "non"]) for _ in range(30)) for _ in range(6)]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in texts.items() for t in ts)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    contexts = {int(value).to_bytes(order, "big") for order, values in enumerate(model.contexts) for value in values}
    counts = {lang: defaultdict(Counter) for lang in texts}
    for lang, ts in texts.items():
        for t in ts:
            raw = langid.PAD + t.encode()
            for i in range(3, len(raw)):
                for k in range(4):
                    counts[lang][raw[i - k : i]][raw[i]] += 1
    # every context is kept, those used once too
    assert contexts == {c for lang in texts for c in counts[lang]}
    asked = ["tata tüto nuna", "xyz"]
    got = langid.Scorer(model).code_lengths([t.encode() for t in asked])
    for n, t in enumerate(asked):
        raw = langid.PAD + t.encode()
        for m, lang in enumerate(model.langs):
            want = sum(-math.log2(max(ppm_share(counts[lang], contexts, raw[i - 3 : i], raw[i]), 1e-12)) for i in range(3, len(raw)))
            assert got[n, m] == pytest.approx(want, rel=1e-4)


def test_no_context_is_left_out(spark):
    """All strings of the sample are in the model, of a language of short texts as of one of long texts, and a language is
    known though its texts are empty."""
    rng = random.Random(8)
    texts = ["".join(chr(rng.randrange(0x61, 0x5000)) for _ in range(4000)), "zyx qwv", ""]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(zip(texts, ("en", "xx", "zz"), strict=True))]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    padded = [langid.PAD + t.encode() for t in texts]
    for order in range(4):
        want = {int.from_bytes(t[i - order : i + 1], "big") for t in padded for i in range(3, len(t))}
        assert want == set(model.grams[order].tolist()) - (set(range(256)) - want if order == 0 else set())
    assert model.langs == ["en", "xx", "zz"] and len(model.contexts[3]) > 4096
    assert np.allclose(langid.Scorer(model).code_lengths([b"zyx"])[0, 2], 24)
    assert [r["lang_pred"] for r in langid.predict(documents(spark, ["zyx", texts[0][:50]]), model).orderBy("doc_id").collect()] == ["xx", "en"]


def test_predictions_keep_any_columns(spark):
    df = clashing(documents(spark, ["the cat", "the cat", None]).withColumn("lang", F.lit("en")))
    model = langid.train(df)
    out = langid.predict(df, model, keep=df.columns, prefix="said_")
    assert out.columns == [*df.columns, "said_lang_pred", "said_score", "said_bits_per_byte"]
    assert sorted(r["said_lang_pred"] for r in out.collect()) == ["en", "en", "und"]
    assert langid.predict(df.limit(0), model).count() == 0


# --- 3


def test_archives_of_the_whole_table(spark):
    got = {r["page_id"]: r for r in queries.op3_arc_to_warc(spark, DATA).collect()}
    first = {}
    pages = table("pages").sort_values("page_id")
    for i, html in pages[["page_id", "html"]].itertuples(index=False):
        raw = (html or "").encode()
        digest = hashlib.sha256(raw).hexdigest()
        before = first.setdefault(digest, i) if len(raw) >= 100 else i
        want = (len(raw), digest, "response", None) if before == i else (len(raw), digest, "revisit", before)
        assert tuple(got[i][c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to")) == want
    assert len(got) == len(pages)


def test_archives_of_equal_payloads(spark):
    """One payload on most rows: all but the least id refer to it, wherever they are dealt to."""
    pages = spark.createDataFrame([(i, "u", "p" * 150 if i % 4 else f"{i:0150}") for i in range(400)], "page_id long, url string, html string").repartition(7)
    got = {r["page_id"]: r["refers_to"] for r in arc.archive_query(pages).collect()}
    assert got == {i: 1 if i % 4 and i > 1 else None for i in range(400)}


# --- 4, 5


def test_lines_at_odds(spark):
    texts = ["", "\n\n", "\n\n\n\n", "a\nb\nc\na\nb\nc\na\nb", "x" * 100_000 + "\nb\nc", None, "a\nb\nc"]
    df = clashing(documents(spark, texts))
    got = {r["doc_id"]: r for r in linededup.dedup_lines(df).collect()}
    # lines of the first text's later windows: positions 3 to 7; the last text is a window of the fourth
    assert (got[3]["text"], got[6]["text"], got[1]["text"], got[2]["text"], got[5]["text"]) == ("a\nb\nc", "", "\n\n", "", None)
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_near_duplicates_keep_any_columns(spark):
    texts = ["a b c d e f g h", "A B c d e f g h", "", None, "q r"]
    df = clashing(documents(spark, texts))
    out = neardup.without_near_duplicates(df)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [0, 2, 3, 4]
    assert neardup.without_near_duplicates(df.limit(0)).count() == 0


def test_chain_of_near_copies(spark):
    """Copies of which only neighbours are alike: one component, whatever the distance of its ends."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[4 * k : 4 * k + 120]) for k in range(60)]
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in neardup.near_duplicates(documents(spark, texts)).collect()}
    assert got == {i: (0, i == 0) for i in range(60)}


# --- 6: features in plain Python


def areas(grey, height, width):
    """Means over the areas by overlap of each pixel."""
    h, w = len(grey), len(grey[0])
    out = np.zeros((height, width))
    for i in range(height):
        for j in range(width):
            total = 0.0
            for y in range(int(i * h / height), min(h, math.ceil((i + 1) * h / height))):
                for x in range(int(j * w / width), min(w, math.ceil((j + 1) * w / width))):
                    total += grey[y][x] * (min(y + 1, (i + 1) * h / height) - max(y, i * h / height)) * (min(x + 1, (j + 1) * w / width) - max(x, j * w / width))
            out[i, j] = total / (h / height * w / width)
    return out


def test_features_by_hand(spark):
    texts = ["", "short", "ab" * 900, "é" * 1500, None, "short"]
    got = {r["doc_id"]: r for r in media.media_query(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        blocks = len(payload) // 576
        samples = np.frombuffer(payload, np.uint8)
        grey = samples.reshape(-1, 24).astype(float) if blocks % 3 == 0 else samples.reshape(-1, 16, 3).mean(axis=2)
        small = np.round(areas(grey.tolist(), 8, 9), 6)
        bits = "".join(str(int(a < b)) for row in small for a, b in zip(row, row[1:], strict=False))
        tile = np.rint(areas(grey.tolist(), 16, 16)).astype(np.uint8)
        held = io.BytesIO()
        np.save(held, tile)
        assert got[i]["feature"] == f"{int(bits, 2):016x}-{zlib.crc32(held.getvalue()):08x}"
    assert got[1]["feature"] == got[5]["feature"] and got[0]["media_sha256"] == got[4]["media_sha256"]


def test_stored_tiles_are_npy(spark):
    stored = media.media_table(clashing(documents(spark, ["some text " * 100, None])))
    for r in media.media_features(stored, ["doc_id"]).collect():
        tile = np.load(io.BytesIO(r["tile_npy"]))
        assert tile.shape == (16, 16) and tile.dtype == np.uint8


def test_deep_images():
    pixels = np.array([[1, 300], [65535, 0]], ">u2")
    assert media.decode(b"P5 2 2 65535\n" + pixels.tobytes()).tolist() == [[1, 300], [65535, 0]]
    assert media.decode(b"P3\n1 1\n300\n1 2 299\n").tolist() == [[[1, 2, 299]]]
    import struct

    rows = bytes([1, 2, 3, 9, 4, 5, 6, 9])  # two pixels of blue, green, red, unused
    bmp = struct.pack("<2sIHHI", b"BM", 62, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, -1, 1, 32, 0, 8, 0, 0, 0, 0) + rows
    assert media.decode(bmp).tolist() == [[[3, 2, 1], [6, 5, 4]]]


# --- 8: FTRL-proximal in plain Python


def test_ftrl_by_hand():
    rng = random.Random(3)
    rows = [(int(rng.random() < 0.3), sorted(rng.sample(range(50), 8)) + [1 << toxicity.BITS]) for _ in range(200)]
    z, n, weight = Counter(), Counter(), {}

    def at(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return (math.copysign(toxicity.L1, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.PASSES):
        for label, places in rows:
            w = [at(i) for i in places]
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w)))))
            g = (p - label) * (toxicity.POSITIVE if label else 1.0)
            for i, wi in zip(places, w, strict=True):
                rate = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - rate * wi
                n[i] += g * g
    weight = {i: at(i) for i in z if at(i)}
    places, got = toxicity.learn([(label, np.array(p, np.int32)) for label, p in rows])
    assert weight and dict(zip(places.tolist(), got.tolist(), strict=True)) == pytest.approx(weight)


def test_features_are_words_pairs_and_skips():
    make = toxicity.Features()
    places = lambda t: set(make.places(t).tolist())
    assert len(places("a b c")) == 6 and places("a") < places("a b") < places("a b c") and not places("")
    assert places("a b c") - places("a b") - places("b c") != set()


def test_toxicity_of_any_ids(spark, monkeypatch):
    texts = [f"word{i} fine day" if i % 3 else f"word{i} vile thing" for i in range(300)]
    ids = [f"d{i}" for i in range(300)]
    docs = clashing(documents(spark, [*texts, None, texts[0]], [*ids, None, "d0"], "string"))
    labels = spark.createDataFrame([(i, int(n % 3 == 0)) for n, i in enumerate(ids)], "doc_id string, toxic int")
    found = toxicity.toxicity_query(docs, labels).collect()
    assert len(found) == 302 and {r["held_out"] for r in found if r["doc_id"] is None} == {False}
    assert {r["doc_id"] for r in found if r["predicted"]} == {i for n, i in enumerate(ids) if n % 3 == 0}
    assert toxicity.toxicity_query(docs.limit(0), labels).count() == 0
    monkeypatch.setattr(toxicity, "MAX_PLACES", 400)
    assert np.count_nonzero(toxicity.train(docs, labels)) < 100
    weights = toxicity.train(docs, labels)
    out = toxicity.score(docs, weights, keep=docs.columns, prefix="said_")
    assert out.columns == [*docs.columns, "said_score", "said_predicted"] and out.count() == 302


def test_held_out_columns(spark):
    con = duckdb.connect()
    con.create_function("crc", lambda s: zlib.crc32(s.encode()), ["VARCHAR"], "BIGINT")
    for name, n, rest in (("op2_language_id", 5, 0), ("op8_toxicity", 3, 1)):
        got = {(r["doc_id"], r["held_out"]) for r in queries.queries()[name](spark, DATA).collect()}
        assert got == set(con.execute(f"SELECT doc_id, crc(CAST(doc_id AS VARCHAR)) % {n} = {rest} FROM '{DATA}/documents.parquet'").fetchall())


# --- 9


def test_packing_any_rows(spark):
    df = clashing(documents(spark, ["a b c", "a b c", None, ""], ["x", "x", None, "y"], "string"))
    out = packing.packed(df, *queries.tokenizer_file("byte_bpe_50k.json")).toPandas()
    assert sorted(out["doc_tokens"]) == [1, 1, 4, 4] and out["doc_id"].isna().sum() == 1
    assert out["sequence_id"].nunique() == 1 and sorted(out["offset"]) == list(np.cumsum([0, *out.sort_values("offset")["length"][:-1]]))


# --- 10

URL_SQL = """WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) v(said, h, q)),
f AS (SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(said, length(h || q)) AS said FROM p, r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, said FROM p LEFT JOIN f USING (page_id)"""


def test_hosts_paths_and_rules_of_the_whole_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    want = {r[0]: r[1:] for r in con.execute(URL_SQL).fetchall()}
    got = queries.op10_url_filter(spark, DATA).collect()
    assert len(got) == len(want)
    for r in got:
        host, path, rule, said = want[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ((said,) if said else ("allow", "block"))


def test_verdicts_by_hand(spark):
    """Models, threshold and verdicts again in plain Python, from the rows alone; repeated rows and null ids as well."""
    rng = random.Random(8)
    host = lambda tail: "".join(rng.choice("abcxyz") for _ in range(5)) + tail
    urls = [f"http://{host('.net')}/de/good{i % 7}" for i in range(80)] + [f"http://{host('.com')}/en/bad{i % 7}" for i in range(80)] + [f"http://{host('.info')}/{rng.choice(['good', 'bad'])}{i}" for i in range(40)] + ["", None]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, urls[160]), (160, urls[160])]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = urlfilter.judged(df).collect()
    parts = {r["url"]: r["part"] for r in df.select("url", F.pmod(F.xxhash64("url"), F.lit(urlfilter.KEPT)).alias("part")).collect()}
    known = {kind: sorted({u for u in urls if u and tail in u}) for kind, tail in (("allow", ".net/de/"), ("block", ".com/en/"))}

    def counts(texts):
        found = defaultdict(Counter)
        for t in texts:
            for i, c in enumerate(t):
                for k in range(min(i, urlfilter.ORDER) + 1):
                    found[t[i - k : i]][c] += 1
        return found

    def log_share(found, text):
        total = 0.0
        for i, c in enumerate(text):
            p = 1 / 65536
            for k in range(min(i, urlfilter.ORDER) + 1):
                seen = found.get(text[i - k : i])
                if not seen:
                    break
                p = (seen[c] + len(seen) * p) / (sum(seen.values()) + len(seen))
            total += math.log(p)
        return total

    models = {kind: counts([u for u in us if parts[u]]) for kind, us in known.items()}
    ratio = lambda u: (log_share(models["allow"], u) - log_share(models["block"], u)) / len(u) if u else 0.0
    held = sorted([(ratio(u), 1) for u in known["allow"] if not parts[u]] + [(ratio(u), 0) for u in known["block"] if not parts[u]])
    good, bad = sum(y for _, y in held), sum(1 - y for _, y in held)
    cuts = [held[0][0] - 1, *[(a + b) / 2 for (a, _), (b, _) in zip(held, held[1:], strict=False) if b > a], held[-1][0] + 1]
    threshold = max(cuts, key=lambda c: (round((sum(y and s >= c for s, y in held) / good + sum((not y) and s < c for s, y in held) / bad) / 2, 12), -c))
    for r in got:
        url = dict(rows).get(r["page_id"], urls[160]) or ""
        assert r["ratio"] == pytest.approx(ratio(url), abs=1e-9)
        if r["rule"] is None:
            assert r["verdict"] == ("allow" if r["ratio"] >= threshold else "block")
    assert {r["verdict"] for r in got if r["rule"] is None} == {"allow", "block"}


# --- the pipeline's stages


def test_stages_on_empty_and_odd_tables(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = docs.limit(30).union(docs.limit(3)).withColumns({c: F.lit("x") for c in ("__score", "score", "lines", "removed", "mark", "__predicted", "lang_pred")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
        out = stage(spark, odd, DATA)
        if name != "packing":
            assert out.columns == odd.columns, name
        assert 0 < out.count(), name


def test_session_settings_stay(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    for name in ("op2_language_id", "op3_arc_to_warc", "op5_minhash_near_dedup", "op7_nearest_neighbours", "op8_toxicity"):
        queries.queries()[name](spark, DATA).count()
        assert {k: spark.conf.get(k) for k in before} == before, name


def test_pipeline_by_hand(spark):
    """The whole pipeline against its stages in plain Python; models are those that the stages learn."""
    import corpus_pipeline
    from tests.llm.test_operators import dedup_by_hand, near_by_hand

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.orderBy("doc_id").collect()}
    scorer = langid.Scorer(langid.train(docs))
    bits = dict(zip(rows, scorer.code_lengths([(t or "").encode() for t in rows.values()]), strict=True))
    rows = {i: t for i, t in rows.items() if t and langid.LETTER.search(t) and 1 / np.exp2(np.maximum(bits[i].min() - bits[i], -1000)).sum() >= corpus_pipeline.LEAST_SHARE}
    weights = toxicity.train(docs.where(F.col("doc_id").isin(list(rows))), spark.read.parquet(f"{DATA}/labels.parquet"))
    make = toxicity.Features()
    logit = lambda t: weights[1 << toxicity.BITS] + sum(weights[p] for p in set(make.places(t).tolist()))
    rows = {i: t for i, t in rows.items() if 1 / (1 + math.exp(-max(-35, min(35, logit(t))))) < toxicity.THRESHOLD}
    before = list(rows.values())
    left = dedup_by_hand(before)
    gone = [not a and b.count("\n") >= 2 and a != b for a, b in zip(left, before, strict=True)]
    rows = {i: t for i, t, g in zip(rows, left, gone, strict=True) if not g}
    ids = list(rows)
    rows = {ids[n]: rows[ids[n]] for n, _, _, kept in near_by_hand(list(rows.values())) if kept}
    codec = packing.json_codec(*queries.tokenizer_file("byte_bpe_50k.json"))
    want = {i: len(codec.encode(t)) + 1 for i, t in rows.items()}
    out = corpus_pipeline.run(spark, DATA).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r["doc_id"]: r["n"] for r in out} == want == {r["doc_id"]: r["all"] for r in out}
