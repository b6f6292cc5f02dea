"""Packing token sequences into windows by non-negative least squares.

Each document's ids are cut into full windows and a remainder. For the remainders' lengths, the combinations of two and
three lengths that fill a window exactly are enumerated, and repeat counts that match the histogram of lengths are
solved for by non-negative least squares. Rounded counts take remainders whole, while there are any; what is left is
first matched greedily by the same combinations and then laid end to end and cut at window borders, so that only the
very last window can be padded.

Only the histogram (at most ``WINDOW`` x ``DEALT`` counts) reaches the driver. A remainder's number among those of its
length decides its place by arithmetic; numbers are given within (length, one of DEALT places) and shifted by the counts
before, so that one frequent length doesn't meet in one task.

Sequence ids: full windows have 2^62 + partition * 2^38 + a running number; the others count from 0.

Edge cases: null and empty texts are the end id alone; repeated rows are packed each; strings of the file's added tokens
are found in texts before anything else and have these tokens' ids; a null id is carried along.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Merges
from .common import sliced, staged

WINDOW, DEALT, END = 1024, 64, 0
#: Steps of the solver.
STEPS = 400


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, others follow 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def added_tokens(file: dict) -> dict[str, int]:
    """Strings and ids of the file's added tokens. Only such as match anywhere and as they stand are known."""
    tokens = file.get("added_tokens") or []
    if any(t.get(flag) for t in tokens for flag in ("single_word", "lstrip", "rstrip")) or file.get("normalizer"):
        raise ValueError("added tokens that match by their surroundings, and normalizers, are not supported")
    return {t["content"]: t["id"] for t in tokens if t["content"]}


def byte_ranks(vocab: dict[str, int]) -> dict[bytes, int]:
    """The ids of the vocabulary's tokens by their bytes."""
    letters = byte_letters()
    return {bytes(letters[c] for c in t): i for t, i in vocab.items() if all(c in letters for c in t)}


@functools.cache
def ranks_suffice(path: str) -> bool:
    """Whether merging by ranks alone gives the file's ids.

    The file merges listed pairs only; by ranks, any two tokens merge whose bytes make one. Both are the same if plain BPE
    below each token's rank leaves just the listed pair of it: two tokens that meet with a complete border would be left
    by the token's bytes alone as well.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, pairs, before = model["vocab"], {}, -1
    for m in model["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        if vocab[a + b] <= before:
            return False
        before = pairs[vocab[a], vocab[b]] = vocab[a + b]
    if model.get("ignore_merges") or len(set(pairs.values())) < len(pairs):
        return False
    merges, listed = Merges(byte_ranks(vocab), pairs), {m: p for p, m in pairs.items()}
    return all(merges.split.get(i, 0) == listed.get(i) for t, i in merges.ranks.items())


class LibraryCodec:
    """Texts to the ids that the tokenizers library gives by the file. Added tokens are cut out first, leftmost and
    longest, and the parts between them are encoded each by itself; by tiktoken where ranks suffice, which takes a
    quarter of the time, but for texts with very long runs of white space, which its matcher doesn't bear."""

    #: White space characters in a row from which on a text goes to the tokenizers library.
    RUN = 100_000

    def __init__(self, path: str, pattern: str, by_ranks: bool):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.added = {t: np.array([i], np.uint32) for t, i in added_tokens(file).items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        self.long_run = re.compile(r"\s{%d}" % self.RUN).search
        self.whole = Tokenizer.from_file(path)
        self.ranked = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=byte_ranks(file["model"]["vocab"]), special_tokens={}) if by_ranks else None

    def encode(self, text: str) -> np.ndarray:
        if self.ranked is None or len(text) >= self.RUN and self.long_run(text):
            return np.array(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        if any(a in text for a in self.added):
            return np.concatenate([self.added[p] if i % 2 else self._ranked(p) for i, p in enumerate(self.cut(text))])
        return self._ranked(text)

    def _ranked(self, text: str) -> np.ndarray:
        return self.ranked.encode_to_numpy(text, disallowed_special=())

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        return [self.encode(t) for t in texts]


_codecs: dict[tuple[str, str, bool], LibraryCodec] = {}


def json_codec(path: str, pattern: str, by_ranks: bool = False) -> LibraryCodec:
    """The codec of a byte-level BPE file of the tokenizers library, made once in each Python worker."""
    if (path, pattern, by_ranks) not in _codecs:
        _codecs[path, pattern, by_ranks] = LibraryCodec(path, pattern, by_ranks)
    return _codecs[path, pattern, by_ranks]


# --- the plan, on the driver


def combinations(window: int) -> np.ndarray:
    """Ascending pairs (with a leading 0) and triples of lengths that fill the window."""
    half = np.arange(1, window // 2 + 1)
    found = [np.stack([np.zeros_like(half), half, window - half], axis=1)]
    for a in range(1, window // 3 + 1):
        b = np.arange(a, (window - a) // 2 + 1)
        found.append(np.stack([np.full_like(b, a), b, window - a - b], axis=1))
    return np.concatenate(found)


def solve(counts: np.ndarray, combos: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |Ax - counts|^2, A's columns being the combinations' lengths; projected
    gradient steps with momentum. Length 0 stands for nothing and weighs nothing."""
    size = len(counts)
    x = y = np.zeros(len(combos))
    t = 1.0
    use = combos > 0
    bound = 3.0 * np.bincount(combos[use], minlength=size).max() if len(combos) else 1.0
    for _ in range(steps):
        made = sum(np.bincount(combos[:, j], weights=y, minlength=size) for j in range(3))
        gap = made - counts
        gap[0] = 0
        new = np.maximum(0, y - gap[combos].sum(axis=1) / bound)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


class Plan:
    """Which remainders fill which windows. counts: of each length below the window."""

    def __init__(self, counts: np.ndarray, window: int = WINDOW):
        self.window = window
        left = counts.astype(np.int64).copy()
        left[0] = 0
        #: By length: the first number, one past the last, how many in each window, the first sequence, offset.
        self.runs: dict[int, list[tuple[int, int, int, int, int]]] = {}
        taken = np.zeros(window, np.int64)
        combos = combinations(window)
        combos = combos[((combos == 0) | (left[combos] > 0)).all(axis=1)]
        x = solve(left, combos) if len(combos) else np.zeros(0)
        order = np.lexsort((np.arange(len(x)), -x))
        self.sequences = 0
        for rounded in (True, False):  # the solver's counts first; then whatever still fits
            for c in order.tolist():
                lengths = [n for n in combos[c].tolist() if n]
                uses = {n: lengths.count(n) for n in lengths}
                n = min(int(left[k]) // m for k, m in uses.items())
                if rounded:
                    n = min(n, int(np.rint(x[c])))
                if n <= 0:
                    continue
                offset = 0
                for k, m in uses.items():
                    self.runs.setdefault(k, []).append((int(taken[k]), int(taken[k]) + n * m, m, self.sequences, offset))
                    taken[k] += n * m
                    left[k] -= n * m
                    offset += k * m
                self.sequences += n
        self.taken = taken
        sizes = np.arange(window) * left
        self.base = np.concatenate([[0], np.cumsum(sizes)[:-1]])  # where each length's rest begins in the line
        self.starts = {k: np.array([r[0] for r in runs]) for k, runs in self.runs.items()}

    def place(self, length: int, number: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the pieces of a remainder, by its number among those of its length."""
        if number < self.taken[length]:
            first, _, m, sequence, offset = self.runs[length][int(np.searchsorted(self.starts[length], number, "right")) - 1]
            return [(0, length, sequence + (number - first) // m, offset + (number - first) % m * length)]
        at = int(self.base[length]) + (number - int(self.taken[length])) * length
        room = self.window - at % self.window
        head = min(length, room)
        out = [(0, head, self.sequences + at // self.window, at % self.window)]
        if head < length:
            out.append((head, length - head, self.sequences + at // self.window + 1, 0))
        return out


# --- the tables


def tokenised(docs: DataFrame, path: str, pattern: str, window: int = WINDOW) -> DataFrame:
    """(uid, doc_id, doc_tokens, first, crcs, rest, rest_crc, rest_ids): full windows' first sequence id and digests, and
    the remainder."""
    by_ranks = ranks_suffice(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c, part = json_codec(path, pattern, by_ranks), TaskContext.get().partitionId()
        rows, full = part << 38, (1 << 62) + (part << 38)
        end = np.array([END], "<u4")
        for batch in sliced(batches):
            out = []
            for ids in c.encode_many([t or "" for t in batch.column(1).to_pylist()]):
                raw = np.concatenate([ids, end]).astype("<u4").tobytes()
                n, step = len(raw) // 4, window * 4
                cut = n // window * step
                out.append((rows, n, full, [zlib.crc32(raw[i : i + step]) for i in range(0, cut, step)], n % window, zlib.crc32(raw[cut:]), raw[cut:]))
                rows += 1
                full += n // window
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), batch.column(0), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.int64()), pa.array(cols[6], pa.binary())], ["uid", "doc_id", "doc_tokens", "first", "crcs", "rest", "rest_crc", "rest_ids"])

    key = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"uid long, doc_id {key}, doc_tokens long, first long, crcs array<long>, rest int, rest_crc long, rest_ids binary")


def packed(docs: DataFrame, path: str, pattern: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    made = staged(tokenised(docs, path, pattern, window), "tokens")
    rests = made.where("rest > 0").withColumn("place", F.pmod(F.xxhash64("uid"), F.lit(DEALT)).cast("int"))
    table = np.zeros((window, DEALT), np.int64)
    for r in rests.groupBy("rest", "place").agg(F.count(F.lit(1)).alias("n")).collect():
        table[r["rest"], r["place"]] = r["n"]
    before = np.cumsum(table, axis=1) - table
    shared = docs.sparkSession.sparkContext.broadcast((Plan(table.sum(axis=1), window), before))
    numbered = rests.withColumn("number", F.row_number().over(Window.partitionBy("rest", "place").orderBy("uid"))).select("doc_id", "doc_tokens", "rest", "rest_crc", "rest_ids", "place", "number")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, shift = shared.value
        for batch in sliced(batches):
            rows, at = [], []
            for i, (tokens, rest, crc, ids, place, number) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(1, 7)), strict=True)):
                pieces = plan.place(rest, int(shift[rest, place]) + number - 1)
                for start, length, sequence, offset in pieces:
                    own = crc if len(pieces) == 1 else zlib.crc32(ids[start * 4 : (start + length) * 4])
                    rows.append((tokens - rest + start, length, own, tokens, sequence, offset))
                    at.append(i)
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    key = dict(docs.dtypes)["doc_id"]
    laid = numbered.mapInArrow(lay, f"doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    whole = made.select("doc_id", "doc_tokens", "first", F.posexplode("crcs").alias("i", "crc"))
    whole = whole.select("doc_id", (F.col("i").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", (F.col("first") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.union(laid)
