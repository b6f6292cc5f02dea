"""Target-distribution importance resampling of documents towards a target's texts.

Texts are lower-cased (A-Z) and cut into words; runs of one to three words fall into BUCKETS buckets by crc32. Counts of the
corpus and of the target give each bucket a gain; a document's weight is the sum of its features' gains, an array lookup
for a whole batch at once. The crc32 of a run is put together from those of its words (crc32 is linear), so no run is made
as a string. A score is the weight and Gumbel noise from the id's hash: the highest scores are a draw without replacement
in proportion to the weights.

A task writes its eligible documents as sorted runs. Ranges of scores, quantiles of all, are counted; only those that hold
the draw's ranks get rows. A range's task reads the blocks of all runs by their first row and merges them by a tournament
tree: it holds those blocks alone that the place reached can come from, begins at the range's first rank and stops at the
exact count. Documents that are too short or in lower ranges pass by with a null rank.

Edge cases: a null text has no words, weight 0; a null id is hashed as the empty string, null after the draw, and comes
first among ties; repeated rows count and are drawn each; an empty table gives no rows, an empty target gains from T = 0.
Very long texts are read in parts. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, small_batches, staged

#: Buckets of features, least words of a document that can be drawn, percent drawn, seed of the noise.
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 5, 42
#: Bytes of text that are worked on at once; rows of a sorted run, of a block; rows of a range of scores, about.
PART_BYTES, RUN_ROWS, BLOCK_ROWS, RANGE_ROWS = 4 << 20, 1 << 18, 1024, 1 << 18
#: Words of up to so many bytes have their crc32 made together.
SHORT = 64

_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: What no word has.
_GAP = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")


def _shifted(register: np.ndarray) -> np.ndarray:
    """A crc's register (without the inversions) after one more zero byte."""
    return (register >> np.uint32(8)) ^ _TABLE[register & np.uint32(255)]


def _table() -> np.ndarray:
    """The crc32 table: the register after a byte, from the reflected polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t.astype(np.uint32)


_TABLE = _table()


def _powers(most: int) -> np.ndarray:
    """[length, byte's place, byte]: the register's part of one byte after so many zero bytes."""
    out = np.zeros((most + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, most + 1):
        out[n] = _shifted(out[n - 1])
    return out


_AFTER = _powers(SHORT + 1)


def after(register: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Registers after numbers of zero bytes: crc(A + B) is after(crc(A), len(B)) ^ crc(B)."""
    out = register.copy()
    left = zeros.copy()
    while True:
        step = np.minimum(left, SHORT + 1)
        byte = [(out >> np.uint32(8 * k)) & np.uint32(255) for k in range(4)]
        out = _AFTER[step, 0, byte[0]] ^ _AFTER[step, 1, byte[1]] ^ _AFTER[step, 2, byte[2]] ^ _AFTER[step, 3, byte[3]]
        left -= step
        if not left.any():
            return out
        if left.max() > 64 * (SHORT + 1):  # a very long word: by squares of the step instead
            far = left > SHORT + 1
            out[far] = [_far(int(r), int(n)) for r, n in zip(out[far], left[far], strict=True)]
            left[far] = 0


def _far(register: int, zeros: int) -> int:
    """The same for one register and any number of zero bytes, by doubling the step's matrix."""
    columns = [int(_shifted(np.array([1 << i], np.uint32))[0]) for i in range(32)]

    def times(m: list[int], v: int) -> int:
        out = 0
        for i in range(32):
            if v >> i & 1:
                out ^= m[i]
        return out

    while zeros:
        if zeros & 1:
            register = times(columns, register)
        columns = [times(columns, c) for c in columns]
        zeros >>= 1
    return register


def crcs(buffer: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of each word of a buffer."""
    bytes_ = np.frombuffer(buffer, np.uint8)
    order = np.argsort(-lengths, kind="stable")
    at, size = starts[order], lengths[order]
    out = np.full(len(order), 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(-size, -SHORT, "left"))  # longer ones come first
    for j in range(min(int(size.max(initial=0)), SHORT)):
        n = int(np.searchsorted(-size, -j, "left"))  # words of more than j bytes
        part = out[long:n]
        out[long:n] = (part >> np.uint32(8)) ^ _TABLE[(part ^ bytes_[at[long:n] + j]) & np.uint32(255)]
    out ^= np.uint32(0xFFFFFFFF)
    out[:long] = [zlib.crc32(buffer[a : a + n]) for a, n in zip(at[:long].tolist(), size[:long].tolist(), strict=True)]
    back = np.empty(len(order), np.uint32)
    back[order] = out
    return back


_SPACE = np.uint32(zlib.crc32(b" "))


def _cut(text: bytes) -> Iterator[bytes]:
    """A text in parts of about PART_BYTES that end with a word."""
    first = 0
    while len(text) - first > PART_BYTES:
        gap = _GAP.search(text, first + PART_BYTES)
        end = gap.start() if gap else len(text)
        yield text[first:end]
        first = end
    yield text[first:]


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(of, buckets, words) of parts of the texts: ``of[i]`` is the place in ``texts`` of the feature of ``buckets[i]``,
    ``words[k]`` the number of words that the part adds to text ``k``. A feature belongs to the part of its last word."""
    group: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        if len(text) > PART_BYTES:
            carried = b""
            for part in _cut(text):
                whole = carried + b" " + part
                yield _part(len(texts), [k], [whole], len(carried.split()))
                carried = _last_two(whole)
            continue
        group.append(k)
        size += len(text)
        if size >= PART_BYTES:
            yield _part(len(texts), group, [texts[g] for g in group])
            group, size = [], 0
    if group:
        yield _part(len(texts), group, [texts[g] for g in group])


def _last_two(text: bytes) -> bytes:
    """The last two words, with a blank between."""
    edges = np.flatnonzero(np.diff(_WORD[np.frombuffer(text, np.uint8)].astype(np.int8), prepend=0, append=0))
    return b" ".join(text[a:b] for a, b in zip(edges[::2][-2:].tolist(), edges[1::2][-2:].tolist(), strict=True))


def _part(n_texts: int, places: list[int], texts: list[bytes], carried: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buffer = b"\n".join(texts).translate(_LOWER)
    inside = _WORD[np.frombuffer(buffer, np.uint8)]
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    of = np.searchsorted(text_ends, starts, "right")
    one = crcs(buffer, starts, lengths)
    follows = after(np.full(len(one), _SPACE), lengths) ^ one  # of " word"
    second = of[1:] == of[:-1]
    third = second[1:] & second[:-1]
    two = after(one[:-1], lengths[1:] + 1) ^ follows[1:]
    three = after(two[:-1], lengths[2:] + 1) ^ follows[2:]
    where = np.array(places)
    last, made = [of, of[1:][second], of[2:][third]], [one, two[second], three[third]]
    if carried:  # features of carried words alone were counted with the part before
        last = [x[max(0, carried - k) :] for k, x in enumerate(last)]
        made = [x[max(0, carried - k) :] for k, x in enumerate(made)]
    words = np.zeros(n_texts, np.int64)
    np.add.at(words, where[last[0]], 1)
    return where[np.concatenate(last)], np.concatenate(made) % np.uint32(BUCKETS), words


def bucket_counts(df: DataFrame) -> dict[int, int]:
    """Features of all texts in each bucket; a task sends BUCKETS rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, buckets, _ in features([x.as_buffer().to_pybytes() for x in batch.column(0)]):
                total += np.bincount(buckets, minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    texts = df.select(F.col("text").cast("binary").alias("text")).where(F.length("text") > 0)
    with small_batches(df.sparkSession):
        rows = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    return {r[0]: r[1] for r in rows}


def gains(corpus: dict[int, int], target: dict[int, int]) -> np.ndarray:
    """A bucket's gain: thousandths of the log of its share in the target over that in the corpus, both smoothed."""
    s_all, t_all = sum(corpus.values()) + BUCKETS, sum(target.values()) + BUCKETS
    return np.array([math.floor(1000 * math.log((float(target.get(b, 0) + 1) * s_all) / (float(corpus.get(b, 0) + 1) * t_all))) for b in range(BUCKETS)], np.int64)


def noise(doc_id: object, seed: int = SEED) -> int:
    """floor of thousandths of Gumbel noise from the id's hash."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(run, doc_id, n_features, weight, score), sorted within a run; documents of fewer than LEAST_WORDS words have no run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        ids: list[object] = []

        def flush() -> Iterator[pa.RecordBatch]:
            n, weight, score = (np.concatenate(x) for x in zip(*held, strict=True))
            key = np.array([-(1 << 63) if i is None else i for i in ids], np.int64)
            order = np.lexsort((key, -score))
            yield from told(pa.array(ids, pa.int64()).take(pa.array(order)), n[order], weight[order], score[order], uuid.uuid4().hex)

        def told(who: pa.Array, n: np.ndarray, weight: np.ndarray, score: np.ndarray, name: str | None) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(who), pa.string()), who, pa.array(n), pa.array(weight), pa.array(score)], ["run", "doc_id", "n_features", "weight", "score"])

        for batch in (b for whole in batches for b in sliced([whole])):
            who = batch.column(0).to_pylist()
            n, weight, words = (np.zeros(len(who), np.int64) for _ in range(3))
            for of, buckets, more in features([b"" if not x.is_valid else x.as_buffer().to_pybytes() for x in batch.column(1)]):
                n += np.bincount(of, minlength=len(who))
                weight += np.bincount(of, weights=gain[buckets], minlength=len(who)).astype(np.int64)
                words += more
            score = weight + np.array([noise(i) for i in who], np.int64)
            fit = words >= LEAST_WORDS
            yield from told(pa.array(who, pa.int64()).filter(pa.array(~fit)), n[~fit], weight[~fit], score[~fit], None)
            held.append([n[fit], weight[fit], score[fit]])
            ids += [i for i, ok in zip(who, fit.tolist(), strict=True) if ok]
            if len(ids) >= RUN_ROWS:
                yield from flush()
                held, ids = [], []
        if ids:
            yield from flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "run string, doc_id long, n_features long, weight long, score long")


class Tournament:
    """A tree of matches between sorted runs that come and go: node 1 has the run of the first row, a leaf its own run."""

    def __init__(self) -> None:
        self.size, self.runs, self.heads, self.free, self.won = 1, [None], [None], [0], [0, 0]

    def _play(self, i: int) -> None:
        """The matches on the way from a leaf to the root, anew."""
        node, won, heads = (self.size + i) // 2, self.won, self.heads
        while node:
            left, right = won[2 * node], won[2 * node + 1]
            a, b = heads[left], heads[right]
            won[node] = right if a is None or (b is not None and b[:2] < a[:2]) else left
            node //= 2

    def add(self, run: Iterator[tuple]) -> None:
        """One more sorted run, in a place that is free; without one the tree doubles."""
        head = next(run, None)
        if head is None:
            return
        if not self.free:
            n = self.size
            self.free = list(range(n, 2 * n))
            self.runs += [None] * n
            self.heads += [None] * n
            self.size = 2 * n
            self.won = [0] * self.size + list(range(self.size))
            for i in range(0, self.size, 2):
                self._play(i)
        i = self.free.pop()
        self.runs[i], self.heads[i] = run, head
        self._play(i)

    def head(self) -> tuple | None:
        return self.heads[self.won[1]]

    def take(self) -> tuple:
        """The first row of all, out of its run."""
        i = self.won[1]
        out = self.heads[i]
        self.heads[i] = next(self.runs[i], None)
        if self.heads[i] is None:
            self.free.append(i)
        self._play(i)
        return out


def drawn(runs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank of all rows of ``scored``: the highest scores have ranks."""
    eligible = runs.where(F.col("run").isNotNull())
    total = eligible.count()
    draw = percent * total // 100
    told = ["doc_id", "n_features", "weight", "score"]
    if not draw:
        return runs.select(*told, F.lit(None).cast("long").alias("rank"))
    ranges = total // RANGE_ROWS + 1
    cuts = eligible.agg(F.percentile_approx("score", [i / ranges for i in range(1, ranges)], F.lit(max(10_000, 20 * ranges)))).first()[0] if ranges > 1 else []
    cuts = np.unique(np.array(cuts or [], np.int64))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows of a run as blocks of one range: 0 is that of the highest scores."""
        for batch in batches:
            run = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            score = batch.column(4).to_numpy()
            place = len(cuts) - np.searchsorted(cuts, score, "right")
            at = np.arange(len(run))
            edge = (np.diff(run, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 0)
            begun = np.maximum.accumulate(np.where(edge, at, 0))
            first = np.flatnonzero(edge | ((at - begun) % BLOCK_ROWS == 0))
            ends = pa.array([*first.tolist(), len(run)], pa.int32())
            ids = batch.column(1)
            columns = [pa.ListArray.from_arrays(ends, c) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(place[first]), pa.array(score[first]), ids.take(pa.array(first)), *columns], ["place", "first", "first_id", *told])

    blocks = eligible.mapInArrow(cut_up, "place long, first long, first_id long, doc_id array<long>, n_features array<long>, weight array<long>, score array<long>")
    counts = dict(blocks.select("place", F.size("doc_id").alias("n")).groupBy("place").agg(F.sum("n")).collect())
    before, first_rank = 0, {}
    for p in sorted(counts):
        first_rank[p] = before
        before += counts[p]
    last = max(p for p in first_rank if first_rank[p] < draw)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, now, rank = Tournament(), None, 0

        def block(b: pa.RecordBatch, i: int) -> Iterator[tuple]:
            ids, *numbers = (b.column(3 + k)[i].as_py() for k in range(4))
            for doc, n, weight, score in zip(ids, *numbers, strict=True):
                yield -score, -(1 << 63) if doc is None else doc, doc, n, weight, score

        def out(limit: tuple | None) -> Iterator[tuple]:
            nonlocal rank
            while (head := tree.head()) is not None and (limit is None or head[:2] <= limit):
                rank += 1
                row = tree.take()
                yield *row[2:], rank if rank <= draw else None

        def told_rows(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], [*told, "rank"])

        rows: list[tuple] = []
        for b in batches:
            for i, (place, first, who) in enumerate(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)):
                limit = None if place != now else (-first, -(1 << 63) if who is None else who)
                for row in out(limit):
                    rows.append(row)
                    if len(rows) >= 4 * BLOCK_ROWS:
                        yield told_rows(rows)
                        rows = []
                if place != now:
                    tree, now, rank = Tournament(), place, first_rank[place]
                tree.add(block(b, i))
        for row in out(None):
            rows.append(row)
            if len(rows) >= 4 * BLOCK_ROWS:
                yield told_rows(rows)
                rows = []
        if rows:
            yield told_rows(rows)

    sorted_blocks = blocks.where(F.col("place") <= last).repartition("place").sortWithinPartitions("place", F.desc("first"), F.asc_nulls_first("first_id"))
    ranked = sorted_blocks.mapInArrow(merge, "doc_id long, n_features long, weight long, score long, rank long")
    below = F.col("score") < F.lit(int(cuts[len(cuts) - 1 - last])) if last < len(cuts) else F.lit(False)
    rest = runs.where(F.col("run").isNull() | below).select(*told, F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest)


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every document: doc_id, n_features, weight, score, rank (1, 2, ... of those drawn, else null)."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    return drawn(staged(scored(docs, gain), "scored"), percent)


#: DuckDB SQL for ``resampled``'s rows: crc32 byte by byte over lists, with a table made by its rule.
RESAMPLED_SQL = r"""
WITH tab AS (SELECT list(list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
x AS (SELECT true AS corpus, row_number() OVER () AS d, doc_id, text FROM documents UNION ALL SELECT false, row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT corpus, d, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT corpus, d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM x)),
v AS (SELECT w, list_transform(range(strlen(w)), lambda k: CAST(strpos('0123456789ABCDEF', substr(h, 2 * k + 1, 1)) * 16 + strpos('0123456789ABCDEF', substr(h, 2 * k + 2, 1)) - 17 AS BIGINT)) AS b FROM (SELECT DISTINCT w, hex(w) AS h FROM w)),
g AS (SELECT corpus, d, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY corpus, d ORDER BY i)),
f AS (SELECT corpus, d, a, NULL AS b, NULL AS c FROM g UNION ALL SELECT corpus, d, a, b, NULL FROM g WHERE b IS NOT NULL UNION ALL SELECT corpus, d, a, b, c FROM g WHERE c IS NOT NULL),
u AS (SELECT DISTINCT a, b, c FROM f),
k AS (SELECT u.*, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_concat(x.b, CASE WHEN u.b IS NULL THEN [] WHEN u.c IS NULL THEN list_concat([32], y.b) ELSE list_concat(list_concat([32], y.b), list_concat([32], z.b)) END)), lambda p, q: xor(p >> 8, t[(xor(p, q) & 255) + 1])), CAST(4294967295 AS BIGINT)) % 10000 AS bucket
  FROM u JOIN v x ON x.w = u.a LEFT JOIN v y ON y.w = u.b LEFT JOIN v z ON z.w = u.c, tab),
n AS (SELECT f.corpus, f.d, bucket FROM f JOIN k ON k.a = f.a AND k.b IS NOT DISTINCT FROM f.b AND k.c IS NOT DISTINCT FROM f.c),
s AS (SELECT bucket, count(*) FILTER (WHERE corpus) AS s, count(*) FILTER (WHERE NOT corpus) AS t FROM n GROUP BY bucket),
m AS (SELECT coalesce(sum(s), 0) + 10000 AS sa, coalesce(sum(t), 0) + 10000 AS ta FROM s),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * sa AS DOUBLE) / CAST((s + 1) * ta AS DOUBLE))) AS BIGINT) AS gain FROM s, m),
l AS (SELECT d, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM n JOIN gain USING (bucket) WHERE corpus GROUP BY d),
e AS (SELECT d, count(*) AS words FROM w WHERE corpus GROUP BY d),
r AS (SELECT x.doc_id, x.d, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score, coalesce(words, 0) >= 20 AS fit
  FROM x LEFT JOIN l USING (d) LEFT JOIN e USING (d) WHERE x.corpus),
o AS (SELECT *, CASE WHEN fit THEN row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) END AS place FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 5 * count(*) // 100 FROM r WHERE fit) THEN place END AS rank FROM o
"""
