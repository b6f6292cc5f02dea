"""Phrase collocation mining: words to ids, id n-grams to fixed-width keys, sorted by radix and counted by runs.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words; everything is per language.
A task cuts its texts into chunks of one language with a dictionary of their own. Words that occur LEAST times in the
language get a dense id; each chunk is told the ids of its own words alone, so that no dictionary is broadcast. All other
words break pieces, as no phrase that holds them can occur LEAST times. Each chunk's pairs and triples of ids are packed
into binary keys (a pair is a triple whose last id is 0), sorted by radix, run-length counted and cut at the borders of key
ranges. These are quantiles of about SAMPLE keys, whatever the input's size; a pair of words that is more than a range is
cut by its third word, and where RANGES of them are too large, each is dealt on by a hash of the key. The sample balances
tasks and changes no result. A task merges the sorted counts of one place. Scores are exact: decimals of 38 digits, divided as integers.

Edge cases: a null text is empty; a null language is ``und``, as is that of a row whose language says ``und``; texts
without words count nothing; repeated rows count each; an empty table has no phrases; other columns are not read. A very
long text is cut between pieces. A phrase may occur up to 10^15 - 1 times.
"""

from __future__ import annotations

import string
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, mix64, staged

#: Least occurrences of a candidate, share in percent at which a longer candidate covers it, phrases told of a language.
LEAST, COVERED, TOP = 10, 50, 2000
#: Bytes of text in a chunk; keys sampled for ranges; most ranges; keys that a place holds about; places of a ranking.
CHUNK_BYTES, SAMPLE, RANGES, RANGE_KEYS, PLACES = 8 << 20, 1 << 20, 4096, 1 << 19, 16

_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
#: What a byte is: 0 part of a word, 1 white space, 2 the end of a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


def words_of(buffer: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of lower-cased texts, one after another, and the number of the piece of each."""
    kind = _KIND[np.frombuffer(buffer, np.uint8)]
    inside = kind == 0
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    values = np.frombuffer(buffer, np.uint8)[inside]
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values)])
    return words, np.cumsum(kind == 2)[starts] if len(starts) else np.zeros(0, np.int64)


def parts(text: bytes, most: int = CHUNK_BYTES) -> Iterator[bytes]:
    """A long text cut between pieces; a piece that is longer than ``most`` stays whole."""
    if len(text) <= most:
        yield text
        return
    ends = np.flatnonzero(_KIND[np.frombuffer(text, np.uint8)] == 2)
    first = 0
    while len(text) - first > most:
        k = int(np.searchsorted(ends, first + most)) - 1
        if k < 0 or ends[k] < first:
            k += 1
        if k >= len(ends):
            break
        yield text[first : ends[k] + 1]
        first = int(ends[k]) + 1
    yield text[first:]


def chunked(docs: DataFrame) -> DataFrame:
    """(chunk, lang, n, codes, words, counts): n words, codes are their places in words, -1 between pieces."""

    def row(lang: str, texts: list[bytes]) -> tuple:
        words, piece = words_of(b"\n".join(texts))
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        counts = np.bincount(codes, minlength=len(coded.dictionary)) if len(codes) else np.zeros(0, np.int64)
        codes = np.insert(codes, np.flatnonzero(np.diff(piece)) + 1, -1)
        return uuid.uuid4().hex, lang, len(words), codes.astype("<i4").tobytes(), coded.dictionary, counts

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        chunk, lang, n, codes, words, counts = zip(*rows, strict=True)
        ends = np.cumsum([0, *map(len, words)])
        flat = pa.concat_arrays([w.cast(pa.string()) for w in words])
        return pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(lang), pa.array(n, pa.int64()), pa.array(codes, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(counts).astype(np.int64)))], ["chunk", "lang", "n", "codes", "words", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for part in parts(text.as_buffer().to_pybytes().translate(_LOWER)):
                    held.setdefault(lang, []).append(part)
                    size[lang] = size.get(lang, 0) + len(part)
                    if size[lang] >= CHUNK_BYTES:
                        yield batch_of([row(lang, held.pop(lang))])
                        size.pop(lang)
        for lang in list(held):
            yield batch_of([row(lang, held.pop(lang))])

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).where(F.length("text") > 0)
    return texts.mapInArrow(run, "chunk string, lang string, n long, codes binary, words array<string>, counts array<long>")


def dictionary(chunks: DataFrame, least: int = LEAST) -> tuple[DataFrame, int]:
    """(lang, word, f, id) of the words that occur ``least`` times in their language, and how many there are; ids are 1, 2, ..."""
    one = chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    frequent = one.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    table = staged(frequent.withColumn("m", F.monotonically_increasing_id()), "words")
    part = F.shiftright("m", 33).cast("int")
    before, offsets = 1, {}
    for p, n in sorted((r[0], r[1]) for r in table.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets[p] = before
        before += n
    if not offsets:
        return table.select("lang", "word", "f", F.col("m").alias("id")), 0
    lookup = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])
    return table.select("lang", "word", "f", (lookup[part] + F.col("m").bitwiseAND((1 << 33) - 1)).alias("id")), before - 1


def encoded(chunks: DataFrame, words: DataFrame, every: int) -> DataFrame:
    """(ids, sample): a chunk's text as ids, 0 where pieces break, and one of ``every`` pairs of neighbouring ids, beginning
    at a place that the chunk's name gives. A chunk gets the ids of its own words by a join on the word."""
    own = chunks.select("chunk", "lang", F.posexplode("words").alias("place", "word"))
    told = own.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("chunk").agg(F.collect_list("place").alias("places"), F.collect_list("id").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes = np.frombuffer(batch.column(0)[i].as_buffer(), "<i4")
                ids = np.zeros(int(codes.max(initial=-1)) + 2, np.int64)  # the last place is that of -1
                ids[batch.column(1)[i].values.to_numpy(zero_copy_only=False)] = batch.column(2)[i].values.to_numpy(zero_copy_only=False)
                text = ids[codes]
                x, y = text[:-1], text[1:]
                sample = ((x << 32) | y)[(x > 0) & (y > 0)][zlib.crc32(batch.column(3)[i].as_buffer()) % every :: every]
                yield pa.RecordBatch.from_arrays([pa.array([text.astype("<i8").tobytes()], pa.binary()), pa.array([sample.tolist()], pa.list_(pa.int64()))], ["ids", "sample"])

    return chunks.select("chunk", "codes").join(told, "chunk").select("codes", "places", "ids", "chunk").mapInArrow(run, "ids binary, sample array<long>")


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of fixed-width big-endian keys (a matrix of bytes), digit by digit of 16 bits from the last; digits that
    are equal in all keys are passed over."""
    digits = np.ascontiguousarray(keys).view(">u2")
    order = np.arange(len(keys))
    for d in range(digits.shape[1] - 1, -1, -1):
        digit = digits[:, d].astype(np.uint16)
        if len(digit) and (digit != digit[0]).any():
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys once each and the sums of their counts."""
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
    return keys[first], np.add.reduceat(counts, first)


def packed_keys(text: np.ndarray) -> np.ndarray:
    """Keys of all pairs and triples of neighbouring ids, three big-endian words of 32 bits each; a pair ends in 0."""
    if len(text) < 2:
        return np.zeros((0, 12), np.uint8)
    x, y = text[:-1], text[1:]
    pair = (x > 0) & (y > 0)
    triple = pair[:-1] & pair[1:]
    n, m = int(pair.sum()), int(triple.sum())
    keys = np.zeros((n + m, 3), ">u4")
    keys[:n, 0], keys[:n, 1] = x[pair], y[pair]
    keys[n:, 0], keys[n:, 1], keys[n:, 2] = text[:-2][triple], text[1:-1][triple], text[2:][triple]
    return keys.view(np.uint8)


def ranges_of(keys: np.ndarray, cuts: np.ndarray, n_ids: int) -> np.ndarray:
    """The range of each sorted key. A pair of ids that several cuts name is cut further by the third id."""
    ids = keys.view(">u4").astype(np.int64)
    pair = (ids[:, 0] << 32) | ids[:, 1]
    low, high = np.searchsorted(cuts, pair, "left"), np.searchsorted(cuts, pair, "right")
    return low + ids[:, 2] * (high - low + 1) // (n_ids + 1)


def places_of(keys: np.ndarray, cuts: np.ndarray, n_ids: int, spread: int) -> np.ndarray:
    """The place of each sorted key: its range, dealt on to ``spread`` by a hash."""
    ranged = ranges_of(keys, cuts, n_ids)
    if spread == 1:
        return ranged
    ids = keys.view(">u4").astype(np.uint64)
    mixed = mix64(mix64((ids[:, 0] << np.uint64(32)) | ids[:, 1]) ^ ids[:, 2])
    return ranged * spread + (mixed % np.uint64(spread)).astype(np.int64)


def counted(texts: DataFrame, cuts: list[int], n_ids: int, spread: int = 1, least: int = LEAST) -> DataFrame:
    """(x, y, z, a): pairs (z is 0) and triples of ids that occur ``least`` times. A place's counts are summed up whenever
    they have doubled, so that a task holds about twice a place's different keys."""
    at = np.array(cuts, np.int64)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids in batch.column(0):
                keys = packed_keys(np.frombuffer(ids.as_buffer(), "<i8"))
                keys = keys[radix_order(keys)]
                keys, counts = run_lengths(keys, np.ones(len(keys), np.int64))
                if not len(keys):
                    continue
                place = places_of(keys, at, n_ids, spread)
                if spread > 1:  # no longer in order of the place
                    order = np.argsort(place, kind="stable")
                    place, keys, counts = place[order], keys[order], counts[order]
                first = np.flatnonzero(np.diff(place, prepend=-1))
                ends = [*first[1:].tolist(), len(keys)]
                yield pa.RecordBatch.from_arrays([pa.array(place[first]), pa.array([keys[a:b].T.tobytes() for a, b in zip(first.tolist(), ends, strict=True)], pa.binary()), pa.array([counts[a:b].astype("<u4").tobytes() for a, b in zip(first.tolist(), ends, strict=True)], pa.binary())], ["place", "keys", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, most = [], 0, RANGE_KEYS

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            order = radix_order(keys)
            return run_lengths(keys[order], counts[order])

        for batch in batches:
            for k, c in zip(batch.column("keys"), batch.column("counts"), strict=True):
                held.append((np.frombuffer(k.as_buffer(), np.uint8).reshape(12, -1).T, np.frombuffer(c.as_buffer(), "<u4").astype(np.int64)))
                size += len(held[-1][1])
                if size > 2 * most:
                    held = [summed()]
                    size = len(held[0][1])
                    most = max(RANGE_KEYS, size)
        keys, counts = summed()
        often = counts >= least
        ids = np.ascontiguousarray(keys[often]).view(">u4").astype(np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([*[pa.array(ids[:, i]) for i in range(3)], pa.array(counts[often])], ["x", "y", "z", "a"])

    dealt = texts.select("ids").mapInArrow(local, "place long, keys binary, counts binary")
    return dealt.groupBy("place").applyInArrow(merge, "x long, y long, z long, a long")


def strength(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), exact: products have up to 36 digits."""
    a, left, right = (c.cast("decimal(15,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * a * a, left * right)


def mined(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    chunks = staged(chunked(docs), "chunks")
    words, n_ids = dictionary(chunks, least)
    if n_ids >= 1 << 32:
        raise ValueError("keys of 32-bit ids hold fewer than 4,294,967,296 frequent words")
    total = chunks.agg(F.sum("n")).first()[0] or 0
    texts = staged(encoded(chunks, words, max(1, total // SAMPLE)), "ids")
    needed = 2 * total // RANGE_KEYS + 1
    ranges = min(needed, RANGES)
    cuts = texts.select(F.explode("sample").alias("pair")).agg(F.percentile_approx("pair", [i / ranges for i in range(1, ranges)], F.lit(max(10_000, 20 * ranges)))).first()[0] if ranges > 1 else []
    grams = staged(counted(texts, cuts or [], n_ids, -(-needed // ranges), least), "grams")
    drop_staged(texts)

    first, second = (words.select(F.col("id").alias(k), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}")) for k in "xy")
    pairs = grams.where("z = 0").select("x", "y", "a").join(first, "x").join(second, "y")
    pairs = staged(pairs.join(words.select(F.col("id").alias("x"), "lang"), "x"), "pairs")
    head = pairs.select("lang", "x", "y", "wx", "wy", "fx", F.col("a").alias("fxy"))
    tail = pairs.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("wy").alias("wz"), F.col("fy").alias("fz"), F.col("a").alias("fyz"))
    triples = grams.where("z > 0").join(head, ["x", "y"]).join(tail, ["y", "z"])
    triples = staged(triples.withColumns({"s1": strength(F.col("a"), F.col("fx"), F.col("fyz")), "s2": strength(F.col("a"), F.col("fxy"), F.col("fz"))}), "triples")
    over = triples.select("x", "y", "a").unionAll(triples.select("y", "z", "a")).groupBy("x", "y").agg(F.max("a").alias("most"))
    free = pairs.join(over, ["x", "y"], "left").where(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a")))
    early = F.col("s1") <= F.col("s2")
    found = free.select("lang", F.concat_ws(" ", "wx", "wy").alias("phrase"), "a", F.col("fx").alias("l"), F.col("fy").alias("r"), strength(F.col("a"), F.col("fx"), F.col("fy")).alias("score")).unionAll(
        triples.select("lang", F.concat_ws(" ", "wx", "wy", "wz"), "a", F.when(early, F.col("fx")).otherwise(F.col("fxy")), F.when(early, F.col("fyz")).otherwise(F.col("fz")), F.least("s1", "s2"))
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = found.withColumn("place", F.pmod(F.xxhash64("phrase"), F.lit(PLACES)))
    for keys in (["lang", "place"], ["lang"]):  # a language may have a third of all phrases: each place's first ones, then theirs
        dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    n = chunks.groupBy("lang").agg(F.sum("n").alias("n"))
    return dealt.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL for ``mined``'s rows.
MINED_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT d, lang, unnest(ps) AS piece, generate_subscripts(ps, 1) AS p FROM (SELECT d, lang, string_split_regex(t, '[.,;:!?\x0A-\x0D]') AS ps FROM d)),
w AS (SELECT d, lang, p, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT d, lang, p, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p)),
g AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY d, p ORDER BY i)),
f1 AS (SELECT lang, w1, count(*) AS a FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS a FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS a FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
t AS (SELECT f3.*, x.a AS l1, yz.a AS r1, xy.a AS l2, z.a AS r2,
  CAST(1000000 AS HUGEINT) * f3.a * f3.a // (CAST(x.a AS HUGEINT) * yz.a) AS s1, CAST(1000000 AS HUGEINT) * f3.a * f3.a // (CAST(xy.a AS HUGEINT) * z.a) AS s2
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 yz ON yz.lang = f3.lang AND yz.w1 = f3.w2 AND yz.w2 = f3.w3
  JOIN f2 xy ON xy.lang = f3.lang AND xy.w1 = f3.w1 AND xy.w2 = f3.w2 JOIN f1 z ON z.lang = f3.lang AND z.w1 = f3.w3),
b AS (SELECT f2.*, x.a AS l, y.a AS r, CAST(1000000 AS HUGEINT) * f2.a * f2.a // (CAST(x.a AS HUGEINT) * y.a) AS s
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2 WHERE f2.a >= 10),
o AS (SELECT lang, w1, w2, max(a) AS most FROM (SELECT lang, w1, w2, a FROM f3 UNION ALL SELECT lang, w2, w3, a FROM f3) GROUP BY ALL),
c AS (SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, b.a, b.l, b.r, b.s AS score FROM b LEFT JOIN o ON o.lang = b.lang AND o.w1 = b.w1 AND o.w2 = b.w2 WHERE o.most IS NULL OR 100 * o.most < 50 * b.a
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c)
SELECT k.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM k JOIN (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f1 GROUP BY lang) m ON m.lang = k.lang WHERE rank <= 2000
"""
