"""The training-data operators against other libraries, brute force and exact round trips."""

import hashlib
import random
import zlib
from types import SimpleNamespace

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.test_oracle import rows
from tracemill.llm import ann, arc, bpe, langid, linededup, media, neardup, packing, queries, toxicity, urlfilter

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en", start=0):
    return spark.createDataFrame([(start + i, t, lang, "s", None if t is None else len(t)) for i, t in enumerate(texts)], SCHEMA)


ODD = [None, "", " ", "\n\n\n", "a", "é", "x" * 70000, "中文 字", "\U0001f600 ok", "a  b\n c", "Word word word word word"]

# --- 1


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdeéß \n\t'0123中語АБ.,!"), st.characters(codec="utf-8")), max_size=60))
def test_bpe_is_tiktoken(codec, reference, text):
    ids = codec.encode(text)
    assert ids.tolist() == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_bpe_long_pieces(codec, reference):
    rng = random.Random(5)
    for n in (1023, 1025, 5000):
        text = "".join(rng.choice("abcdefgh") for _ in range(n))
        assert codec.machine.encode(text.encode()) == reference.encode_ordinary(text)


def test_bpe_query(spark, codec):
    got = {r["doc_id"]: r for r in bpe.encode_decode(documents(spark, ODD), RANKS, P.PATTERN).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        assert got[i]["decoded_sha256"] == hashlib.sha256(raw).hexdigest()
        assert got[i]["ids_sha256"] == hashlib.sha256(codec.said(codec.encode(t or "")).encode()).hexdigest()
    assert bpe.encode_decode(documents(spark, []), RANKS, P.PATTERN).count() == 0


def test_decode_bytes_that_are_not_utf8(codec):
    raw = b"\xff\xe4\xb8a\xc3"
    ids = np.array([codec.merges.ranks[bytes((b,))] for b in raw], np.uint32)
    assert codec.decode(ids) == raw


# --- 2


def test_code_lengths_are_a_distribution(spark):
    texts = ["the cat sat on the mat and the dog"] * 3 + ["le chat est sur le tapis et le chien"] * 3
    df = spark.createDataFrame([(i, t, "en" if i < 3 else "fr") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.train(df)
    scorer = langid.Scorer(model)
    for order, contexts in enumerate(model.contexts):
        for c in [*contexts.tolist(), 7]:
            after = scorer.bits_of((np.uint32(c << 8) + np.arange(256)).astype(np.uint32))
            assert order < 3 or np.allclose(np.exp2(-after.astype(float)).sum(axis=0), 1, atol=1e-3)
    whole = scorer.code_lengths([t.encode() for t in texts])
    raw = [langid.PAD + t.encode() for t in texts]
    by_hand = [sum(scorer.bits_of(np.array([int.from_bytes(t[i - 3 : i + 1], "big")], np.uint32))[0] for i in range(3, len(t))) for t in raw]
    assert np.allclose(whole, by_hand, rtol=1e-5)
    scorer.most = 5
    assert np.allclose(scorer.code_lengths([t.encode() for t in texts]), by_hand, rtol=1e-5)
    got = langid.predict(df.union(spark.createDataFrame([(9, None, None), (10, "12 34", None), (11, "", "en")], df.schema)), model).collect()
    said = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [said[i] for i in range(6)] == ["en"] * 3 + ["fr"] * 3 and said[9] == said[10] == said[11] == "und"


def test_language_accuracy(spark):
    out = queries.op2_language_id(spark, DATA).toPandas()
    lang = duckdb.sql(f"SELECT doc_id, lang FROM '{DATA}/documents.parquet'").fetchdf()
    held = out.merge(lang, on="doc_id").query("held_out")
    assert len(held) and (held["lang"] == held["lang_pred"]).mean() > 0.95
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out["doc_id"]]).all()


def test_language_without_labels(spark):
    got = langid.language_query(documents(spark, ["abc", None], lang=None)).collect()
    assert {r["lang_pred"] for r in got} == {"und"}


# --- 3


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(spark, tmp_path, version):
    pages = spark.createDataFrame([(3, "http://a b/ c", "x" * 200), (1, None, "x" * 200), (2, "u\nv", None), (5, "u", "é" * 60), (None, "n", "x" * 200), (7, "w", "x" * 99), (8, "w", "x" * 99), (3, "http://a b/ c", "x" * 200)], "page_id long, url string, html string")
    arcs = arc.arc_table(pages, version=version)
    got = sorted(map(tuple, arc.warc_records(arc.convert(arcs)).drop("record_id").collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    x = sha("x" * 200)
    assert got == sorted([(3, 200, x, "revisit", 1), (3, 200, x, "revisit", 1), (1, 200, x, "response", None), (2, 0, sha(""), "response", None), (5, 120, sha("é" * 60), "response", None), (None, 200, x, "response", None), (7, 99, sha("x" * 99), "response", None), (8, 99, sha("x" * 99), "response", None)], key=str)
    arc.write_files(arc.convert(arcs), str(tmp_path / "w"))
    assert arc.warc_records(arc.read_files(spark, str(tmp_path / "w"))).count() == 8
    assert arc.archive_query(pages.limit(0)).count() == 0


def test_arc_ids_and_plan(spark):
    """Ids of any kind and characters; payloads aren't shuffled once segments are in buckets."""
    odd = ["a b", "x\r\ny", "é:%41", "", "5"]
    pages = spark.createDataFrame([(i, "u", "p" * 300, 1, "z") for i in odd], "page_id string, url string, html string, part int, name string")
    got = {r["page_id"]: r["refers_to"] for r in arc.archive_query(pages).collect()}
    assert got == {i: None if i == min(odd) else min(odd) for i in odd}
    arcs = arc.staged(arc.arc_table(pages), "arc", "none", 500, (8, "part"))
    plan = arc.convert(arcs, "string")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not [x for x in plan.split("\n") if "Exchange" in x and "data#" in x]
    versions = [arc.parse_arc(r["data"]) and next(arc.members(r["data"])).split(b"\n")[1][:1] for r in arc.arc_table(pages.repartition(1), version=None).collect()]
    assert versions == [b"1"]


def test_arc_versions_alternate(spark):
    pages = spark.createDataFrame([(i, "u", str(i) * (1 << 20)) for i in range(8)], "page_id long, url string, html string").coalesce(1)
    arcs = arc.arc_table(pages)
    assert [next(arc.members(r["data"])).split(b"\n")[1][:1] for r in arcs.orderBy("seq").collect()][:2] == [b"1", b"2"]
    assert {r["page_id"] for r in arc.archive_query(pages).collect()} == set(range(8))


def test_arc_declared_lengths():
    data = arc.arc_version_block("f") + arc.arc_record("http://x/", b"one\ntwo\n") + arc.arc_record("y z", b"")
    assert [(r["url"], r["content"]) for r in arc.parse_arc(data)] == [("http://x/", b"one\ntwo\n"), ("y z", b"")]
    with pytest.raises(ValueError):
        list(arc.parse_arc(data.replace(b"text/html 8", b"text/html 999")))


def test_archive_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    assert rows(queries.op3_arc_to_warc(spark, DATA).toPandas()) == rows(con.execute(arc.ARCHIVE_SQL).fetchdf())


def test_records_say_where_they_come_from(spark):
    """Repeated rows have ids of their own; a revisit names the first record, its URI and date; IP address and media type
    stay; what has no HTTP head is a resource."""
    html = "x" * 200
    pages = spark.createDataFrame([(2, "http://b/", html), (1, "http://a/", html), (1, "http://a/", html), (3, "http://c/", "")], "page_id long, url string, html string").coalesce(1)
    warcs = arc.convert(arc.arc_table(pages))
    found = [h for r in warcs.collect() for h, _ in arc.parse_warc(r["data"]) if h["warc-type"] != "warcinfo"]
    ids = [h["warc-record-id"] for h in found]
    assert len(ids) == len(set(ids)) == 4
    again = [h for h in found if h["warc-type"] == "revisit"]
    first = [h for h in found if h["warc-target-uri"] == "http://a/"]
    assert [h["warc-refers-to"] for h in again] == [first[0]["warc-record-id"]]
    assert (again[0]["warc-refers-to-target-uri"], again[0]["warc-refers-to-date"]) == ("http://a/", first[0]["warc-date"])
    data = arc.arc_version_block("f") + arc.arc_record("http://x/", b"one", ip="192.0.2.7", kind="image/gif") + arc.arc_record("http://y/", b"HTTP/1.1 200 OK\r\n\r\nbody")
    warcs = arc.convert(spark.createDataFrame([("f", bytearray(data))], "name string, data binary"))
    one, two = (x for r in warcs.collect() for x in arc.parse_warc(r["data"]) if x[0]["warc-type"] != "warcinfo")
    assert (one[0]["warc-type"], one[0]["content-type"], one[0]["warc-ip-address"], one[1]) == ("resource", "image/gif", "192.0.2.7", b"one")
    assert (two[0]["warc-type"], "warc-ip-address" in two[0]) == ("response", False)
    got = {r["record_type"]: r["payload_bytes"] for r in arc.warc_records(warcs).collect()}
    assert got == {"resource": 3, "response": 4}


# --- 4


def dedup_by_hand(texts):
    seen, gone = {}, {}
    for i, t in enumerate(texts):
        lines = [] if t is None else t.split("\n")
        gone[i] = set()
        for p in range(len(lines) - 2):
            key = tuple(lines[p : p + 3])
            if key in seen:
                gone[i].update(range(p, p + 3))
            else:
                seen[key] = (i, p)
    return [None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) for i, t in enumerate(texts)]


def test_line_dedup(spark):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None, "", "a\nb", "q\nr\ns\nq\nr\ns"]
    df = documents(spark, texts).withColumns({n: F.lit("x") for n in ("pos", "starts", "__starts", "__lines", "__key", "mark", "a", "odd.name")})
    out = linededup.dedup_lines(df)
    assert out.columns == [*df.columns, "___lines", "__removed"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert [got[i]["text"] for i in range(len(texts))] == dedup_by_hand(texts)
    assert all(got[i]["___lines"] == (0 if t is None else t.count("\n") + 1) for i, t in enumerate(texts))
    assert {r["__lines"] for r in got.values()} == {"x"}
    twice = linededup.line_query(documents(spark, ["a\nb\nc"]).union(documents(spark, ["a\nb\nc"]))).collect()
    assert [r["n_removed"] for r in twice] == [0, 0]
    assert linededup.line_query(documents(spark, [])).count() == 0


# --- 5


def near_by_hand(texts):
    sets = []
    for t in texts:
        w = bytes(t or "", "utf-8").lower().split()
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [(i, len(sets[i]), root[i], root[i] == i) for i in range(len(texts))]


def test_near_duplicates(spark):
    rng = random.Random(3)
    bases = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 90))] for _ in range(12)]
    texts = [None, "", "  ", "one two", "ONE two", "one three"]
    for b in bases:
        for _ in range(8):
            c = list(b)
            for _ in range(rng.randint(0, 3)):
                c[rng.randrange(len(c))] = "Zz"
            texts.append(" ".join(c))
    got = sorted(tuple(r) for r in neardup.near_duplicates(documents(spark, texts)).collect())
    assert got == near_by_hand(texts)
    again = documents(spark, ["a b c d e f"]).union(documents(spark, ["a b c d e f"])).union(spark.createDataFrame([(None, "a b c d e f", None, None, None)], SCHEMA))
    assert sorted(map(str, (tuple(r) for r in neardup.near_duplicates(again).collect()))) == sorted(["(0, 2, 0, True)", "(0, 2, 0, True)", "(None, 2, None, True)"])
    assert neardup.near_duplicates(documents(spark, [])).count() == 0


def test_one_id_with_several_texts(spark):
    """Each row goes or stays by its own text; rows that repeat id and text stay together; string ids are ids too."""
    rows = [(3, "a b c d e f g"), (5, "q r s t u v w x"), (5, "a b c d e f g"), (5, "q r s t u v w x"), (6, "q r s t u v w x"), (None, "a b c d e f g"), (7, None)]
    for kind, of in (("long", lambda x: x), ("string", lambda x: None if x is None else f"id {x}")):
        df = spark.createDataFrame([(of(i), t, "x", "y") for i, t in rows], f"doc_id {kind}, text string, mark string, component_id string")
        left = neardup.without_near_duplicates(df)
        assert left.columns == df.columns
        assert sorted((tuple(r)[:2] for r in left.collect()), key=str) == sorted([(of(3), rows[0][1]), (of(5), rows[1][1]), (of(5), rows[1][1]), (None, "a b c d e f g"), (of(7), None)], key=str)
        said = sorted(((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(df).collect()), key=str)
        assert said == sorted([(of(3), of(3)), (of(5), of(5)), (of(5), of(3)), (of(5), of(5)), (of(6), of(5)), (None, None), (of(7), of(7))], key=str)


def test_parities_bound_what_is_not_shared():
    rng = np.random.default_rng(6)
    for size in (1, 30, 400, 5000):
        a = np.unique(neardup.mix64(rng.integers(0, 1 << 60, size).astype(np.uint64)))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], neardup.mix64(rng.integers(0, 1 << 60, size // 5).astype(np.uint64))]))
        apart = sum(int(x).bit_count() for x in neardup.parities(a).view(np.uint64) ^ neardup.parities(b).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b)) and (size < 400 or apart > 0.5 * min(len(np.setxor1d(a, b)), 500))


def test_many_rounds(spark):
    """A bucket whose members are all alike in a band but not similar: every round must still find each link."""
    sets = {i: list(range(i * 100, i * 100 + 60)) for i in range(30)} | {i: list(range((i - 30) * 100, (i - 30) * 100 + 58)) for i in range(30, 60)}
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in s)) for i, s in sets.items()], "doc_id long, text string")
    classes = docs.select(F.col("doc_id").alias("node"), "doc_id", neardup.MARK("text").alias("mark"), F.array(F.lit(7).cast("long")).alias("keys"))
    got = {r["node"]: r["root"] for r in neardup.linked(docs, classes).collect()}
    assert got == {i + 30: i for i in range(30)}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {n: r for n, r in root.items() if n != r}


# --- 6


def test_images(spark):
    rng = np.random.default_rng(1)
    for shape in ((5, 7), (5, 7, 3), (24, 24), (3, 16, 3)):
        a = rng.integers(0, 256, shape, np.uint8)
        assert (media.decode(media.netpbm(a)) == a).all() and (media.decode(media.bmp(a)) == a).all()
    assert media.decode(b"P2 # c\n2 1\n255\n7 9\n").tolist() == [[7, 9]]
    assert media.decode(b"P1\n2 1\n10\n").tolist() == [[0, 255]]
    assert media.decode(b"P4\n3 1\n" + bytes([0b01000000])).tolist() == [[255, 0, 255]]
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")
    a = rng.integers(0, 256, (12, 18)).astype(float)
    assert np.allclose(media.area_resize(a, 4, 6), a.reshape(4, 3, 6, 3).mean(axis=(1, 3)))
    assert np.isclose(media.area_resize(a, 5, 7).mean(), a.mean())
    got = {r["doc_id"]: r for r in media.media_query(documents(spark, ODD)).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["media_sha256"] == hashlib.sha256(media.encode_payload(payload)).hexdigest()
    assert media.media_query(documents(spark, [])).count() == 0


# --- 7


def test_nearest(spark):
    rng = np.random.default_rng(2)
    v = [list(map(float, x)) for x in rng.normal(size=(300, 8))]
    v[10] = v[20] = v[30] = v[100]
    data = [(i, x) for i, x in enumerate(v)] + [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [1.0, None] + [0.0] * 6), (404, [1.0]), (405, []), (None, v[0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in ann.nearest_query(df).orderBy("query_id", "rank").collect()]
    a = np.array(v, np.float32).astype(float)
    want = []
    for q in range(0, 300, 50):
        s = ann.cosines(a[q : q + 1], ann.squares(a[q : q + 1]), a, ann.squares(a))[0]
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:5]
        want += [(q, k + 1, i, float(s[i])) for k, i in enumerate(best)]
    assert got == want
    assert ann.nearest_query(df.limit(0)).count() == 0
    assert ann.nearest_query(spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")).count() == 1


@pytest.mark.parametrize("width", [8, 16, 64])
def test_many_equal_vectors_in_a_table(spark, width):
    """Identical and scaled copies of one vector, a third of all rows, in the whole query against brute force."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(3000, width)).astype(np.float32)
    equal = rng.permutation(3000)[:1000]
    v[equal] = v[equal[0]] * rng.choice([0.5, 1, 2, 4], 1000)[:, None].astype(np.float32)
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    a = v.astype(float)
    got = [tuple(r) for r in ann.nearest_query(df).orderBy("query_id", "rank").collect()]
    want = []
    for q in range(0, 3000, 50):
        s = ann.cosines(a[q : q + 1], ann.squares(a[q : q + 1]), a, ann.squares(a))[0]
        s[q] = -np.inf
        want += [(q, k + 1, int(i), float(s[i])) for k, i in enumerate(np.lexsort((np.arange(3000), -s))[:5])]
    assert got == want


@pytest.mark.parametrize("width", [8, 16, 64])
def test_many_equal_vectors(width):
    for seed in range(8):
        rng = np.random.default_rng(seed)
        v = rng.normal(size=(4500, width)).astype(np.float32).astype(float)
        equal = rng.permutation(4500)[:1500]
        v[equal] = v[equal[0]]
        asked = equal[:90]
        got, _ = ann.Tree(np.arange(4500), v).search(asked, v[asked], 5)
        s = ann.cosines(v[asked], ann.squares(v[asked]), v, ann.squares(v))
        s[np.arange(90), asked] = -np.inf
        assert got.tolist() == [np.lexsort((np.arange(4500), -x))[:5].tolist() for x in s]


def test_relaxed_search_recalls():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(2000, 6))
    tree = ann.Tree(np.arange(2000), v)
    exact, _ = tree.search(np.arange(50), v[:50], 5, 1.0)
    loose, _ = tree.search(np.arange(50), v[:50], 5, 0.8)
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(exact.tolist(), loose.tolist(), strict=True)]) > 0.9


# --- 8


def test_toxicity(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    texts, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        texts.append(" ".join(rng.choices(words, k=30) + (["vile", "nasty"] if bad else [])))
        marks.append(int(bad))
    docs = documents(spark, [*texts, None, ""])
    labels = spark.createDataFrame([*enumerate(marks), (400, None), (None, 1)], "doc_id long, toxic int").withColumn("quality", F.lit(1))
    got = {r["doc_id"]: r for r in toxicity.toxicity_query(docs, labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i in held)
    assert np.mean([got[i]["predicted"] == marks[i] for i in held]) > 0.95
    assert got[400]["score"] == got[401]["score"] and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    none = toxicity.toxicity_query(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


# --- 9


def test_packing_ids(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    theirs = Tokenizer.from_file(path)
    theirs.encode_special_tokens = True
    texts = [t or "" for t in ODD] + [r[0] for r in duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet' LIMIT 60").fetchall()]
    want = [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
    assert packing.ranks_suffice(path)
    for by_ranks in (False, True):
        ours = packing.json_codec(path, P.PATTERN, by_ranks)
        assert [x.tolist() for x in ours.encode_many(texts)] == want


def test_packing_long_white_space():
    ours = packing.json_codec(P.path("byte_bpe_50k.json"), P.PATTERN, True)
    text = " " * 2_000_000 + "a" + "\n" * 150_000
    assert ours.encode(text).tolist() == packing.json_codec(P.path("byte_bpe_50k.json"), P.PATTERN).encode(text).tolist()


def test_ranks_that_do_not_suffice(tmp_path):
    """The pair (a, bc) isn't listed, so "abc" stays two tokens; by ranks it would be one."""
    import json

    letters = {c: i for i, c in enumerate("abc")}
    file = tmp_path / "f.json"
    for vocab, merges, suffice in (({"bc": 3, "ab": 4, "abc": 5}, ["b c", "a b", "ab c"], False), ({"bc": 3, "ab": 4, "abc": 5}, ["b c", "a b", "a bc"], True)):
        file.write_text(json.dumps({"model": {"vocab": letters | vocab, "merges": merges}}))
        assert packing.ranks_suffice.__wrapped__(str(file)) == suffice


def test_packing_added_tokens(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    end = "<|endoftext|>"
    parts = ["", " ", "  ", "\n", "a", " b", "c ", "é  ", "don't", "<|endoftext", "|>", "中文"]
    rng = random.Random(7)
    texts = [f"a {end} b", end, end * 2, *("".join(rng.choice([*parts, end]) for _ in range(rng.randrange(9))) for _ in range(300)), *[t or "" for t in ODD]]
    theirs = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for by_ranks in (False, True):
        ours = packing.json_codec(path, P.PATTERN, by_ranks)
        assert [x.tolist() for x in ours.encode_many(texts)] == theirs
    out = {r["doc_id"]: r for r in packing.packed(documents(spark, texts[:3]), path, P.PATTERN).where("start = 0").collect()}
    assert [out[i]["doc_tokens"] for i in range(3)] == [len(ids) + 1 for ids in theirs[:3]]


def test_packing(spark):
    texts = [*ODD, *[r[0] for r in duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet'").fetchall()], *["same words here"] * 500]
    path = P.path("byte_bpe_50k.json")
    out = packing.packed(documents(spark, texts), path, P.PATTERN).toPandas()
    ours = packing.json_codec(path, P.PATTERN)
    for i, ids in enumerate(ours.encode_many([t or "" for t in texts])):
        ids = np.append(ids, 0).astype("<u4")
        mine = out[out["doc_id"] == i].sort_values("start")
        assert mine["length"].sum() == len(ids) and (mine["doc_tokens"] == len(ids)).all()
        assert (mine["start"] == mine["length"].cumsum().shift(fill_value=0)).all()
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine["start"], mine["length"], strict=True)] == mine["ids_crc32"].tolist()
    filled = out.sort_values(["sequence_id", "offset"])
    by = filled.groupby("sequence_id")
    assert (filled["offset"] == by["length"].cumsum() - filled["length"]).all()
    sizes = by["length"].sum()
    assert sizes.max() <= 1024 and (sizes < 1024).sum() <= 1
    assert packing.packed(documents(spark, []), path, P.PATTERN).count() == 0


def test_solver():
    counts = np.zeros(1024, np.int64)
    counts[[300, 724, 200, 400, 424]] = [50, 50, 20, 20, 20]
    plan = packing.Plan(counts)
    assert plan.sequences == 70 and (plan.taken == counts).all()


# --- 10


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://Blog.EXAMPLE.com/en/7?x", "http://a.com/en/8#f", "http://notcom/en/1", "x://com/en/", "http://net/de/8", "http://www.example.net/de/80", "http://o.org/es/", "http://o.org", "http://o.org?es=/es/", "a://b://com/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in urlfilter.judged(df).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(len(urls))] == [("", "", None), ("", "", None), ("", "", None), ("blog.example.com", "/en/7", "example.com/en/7"), ("a.com", "/en/8", "com/en/"), ("notcom", "/en/1", None), ("com", "/en/", "com/en/"), ("net", "/de/8", "net/de/"), ("www.example.net", "/de/80", "example.net/de/8"), ("o.org", "/es/", "org/es/"), ("o.org", "", None), ("o.org", "", None), ("b:", "//com/en/", None)]
    assert [got[i]["verdict"] for i in (3, 4, 6, 7, 8, 9)] == ["allow", "block", "block", "allow", "block", "block"]
    assert urlfilter.judged(df.limit(0)).count() == 0


def test_repeated_urls_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "SAMPLE", 60)
    urls = [f"http://{i}.example.com/en/7" for i in range(50)] + [f"http://{i}.com/en/{i}" for i in range(50)] + ["http://7.example.org/en", "http://7.net/d"]
    once = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    often = once.crossJoin(spark.range(200).select(F.lit(0).alias("copy"))).drop("copy")
    want = {r["page_id"]: (r["verdict"], r["ratio"]) for r in urlfilter.judged(once).collect()}
    assert any(ratio for _, ratio in want.values())
    assert {(r["page_id"], r["verdict"], r["ratio"]) for r in urlfilter.judged(often).distinct().collect()} == {(i, *x) for i, x in want.items()}


def test_every_example_counts(spark, monkeypatch):
    """more examples than ``SAMPLE``, over many chunks and ranges, against the method on one machine."""
    for name, value in {"SAMPLE": 20, "CHUNK": 300, "MOST_RUNS": 60, "RANGES": 4}.items():
        monkeypatch.setattr(urlfilter, name, value, raising=False)
    rng = random.Random(11)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    allowed = {f"http://{word('abcdxé')}.net/de/{word('abc')}" for _ in range(150)}
    blocked = {f"http://{word('cdefx\U0001f600')}.com/en/{word('bcd')}" for _ in range(150)}
    others = ["", "x", "http", "中文"] + [f"http://{word('abcdef')}.info/{word('abcd')}" for _ in range(100)]
    urls = sorted(allowed) + sorted(blocked) * 3 + others
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    got = {r["page_id"]: r for r in urlfilter.judged(df).collect()}
    part = {r["url"]: r["part"] for r in df.select("url", F.pmod(F.xxhash64("url"), F.lit(urlfilter.KEPT)).alias("part")).collect()}
    models = [urlfilter.Markov() for _ in range(2)]
    for model, texts in zip(models, (allowed, blocked), strict=True):
        for t in texts:
            if part[t]:
                model.learn(t)
        model.finish()
    plain = urlfilter.Ratio(*models)
    at = urlfilter.calibrate(plain, *[[t for t in texts if not part[t]] for texts in (allowed, blocked)])
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert got[i]["ratio"] == pytest.approx(plain.of(u), abs=1e-9)
        assert got[i]["verdict"] == ("allow" if u in allowed or u not in blocked and plain.of(u) >= at else "block")
    assert {got[i]["verdict"] for i, u in enumerate(urls) if u in others} == {"allow", "block"}


def test_threshold_of_ranges(spark, monkeypatch):
    """Sums over ranges give the threshold of one sorted list, also at its ends and with equal ratios."""
    rng = random.Random(3)
    lists = [([rng.randrange(9, 30) / 8 for _ in range(16)], [rng.randrange(22) / 8 for _ in range(16)]) for _ in range(2)]
    for accepted, rejected in [*lists, ([0.0, 1.0], [2.0, 3.0]), ([1.0], [0.0]), ([1.0], [])]:
        rows = spark.createDataFrame([(v, 1, 0) for v in accepted] + [(v, 0, 1) for v in rejected], "ratio double, allow long, block long")
        held = rows.groupBy("ratio").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        want = urlfilter.calibrate(SimpleNamespace(of=float), accepted, rejected)
        for ranges in (1, 5):
            monkeypatch.setattr(urlfilter, "RANGES", ranges)
            assert urlfilter.threshold(held) == want


def test_markov_shares_sum_to_one():
    m = urlfilter.Markov()
    for t in ("abcab", "abd"):
        m.learn(t)
    m.finish()
    known = sum(m.share("ab", c) for c in "abcd")
    assert 0.9 < known < 1
    texts = ["http://good/" + c for c in "abcde"], ["http://evil/" + c for c in "abcde"]
    models = [urlfilter.Markov() for _ in range(2)]
    for model, ts in zip(models, texts, strict=True):
        for t in ts:
            model.learn(t)
        model.finish()
    r = urlfilter.Ratio(*models)
    by_hand = sum(np.log(models[0].share("http://good/"[max(0, i - 4) : i], c)) - np.log(models[1].share("http://good/"[max(0, i - 4) : i], c)) for i, c in enumerate("http://good/")) / 12
    assert r.of("http://good/") == pytest.approx(by_hand)
    assert urlfilter.calibrate(r, ["http://good/x"], ["http://evil/x"]) == pytest.approx((r.of("http://good/x") + r.of("http://evil/x")) / 2)


# --- the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = documents(spark, [None, "12345", "", "ok words of the text here that are english"], start=10**6)
    kept = corpus_pipeline.language_stage(spark, docs.union(odd.select(*docs.columns)), DATA)
    assert kept.columns == docs.columns and kept.where("doc_id in (1000000, 1000001, 1000002)").count() == 0
    assert kept.count() >= docs.count()
    clean = corpus_pipeline.toxicity_stage(spark, docs, DATA)
    assert clean.columns == docs.columns and 0.8 * docs.count() < clean.count() <= docs.count()
    lines = corpus_pipeline.line_stage(spark, docs, DATA)
    assert lines.columns == docs.columns
    near = corpus_pipeline.near_stage(spark, docs, DATA)
    want = {r["doc_id"] for r in neardup.near_duplicates(docs).where("kept").collect()}
    assert {r["doc_id"] for r in near.collect()} == want
    out = corpus_pipeline.run(spark, DATA)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
