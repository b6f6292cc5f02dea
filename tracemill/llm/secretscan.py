"""Secret scans: three fixed patterns, and a battery of randomness tests on long runs of letters and digits.

Patterns (``assign``, ``access``, ``hex``) give the base spans: leftmost matches that don't overlap, of one kind each; then
those that are too short go. The battery looks at every run of LEAST_RUN or more of ``A-Za-z0-9+/_=-`` and infers its
encoding, the smallest alphabet that holds it (hex, base32, letters, letters and digits, base64, base64url; all-digit runs
are numbers and left alone). A run is a find if
- uniform and independent symbols explain it: chi-squared over the alphabet, runs above and below its middle, and lag-one
  serial correlation are not rejected at RANDOM_P, by Bonferroni over the three; and
- the corpus's own text does not: the number of equal pairs of symbols (chi-squared's only variable part) is lower than that
  of text, whose mean and variance for the run's length follow from the symbols' shares in all texts. Benjamini-Hochberg
  holds the false discovery rate at FALSE_SHARE in each class of lengths apart, over all runs of the corpus; probabilities
  are counted in steps of 1/16 standard deviation and rounded up.
Finds that overlap a base span are part of it and not told again; base spans stay. Spans are in code points, end exclusive.

Edge cases: a null text is empty; texts without spans have empty lists and the digest of the empty string; repeated rows
have equal results and count each; an empty table has no rows; other columns are not read. Texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, staged

#: The base patterns and the least characters of a match (of group 2 for ``assign``).
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ["assign", "access", "hex", "random"]

#: Least length of a run that is tested; lower ends of the classes of lengths; rejection of randomness; false discoveries.
LEAST_RUN, LENGTHS, RANDOM_P, FALSE_SHARE = 16, (16, 24, 32, 48), 0.001, 0.01
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Alphabets in the order in which they are tried.
ALPHABETS = {
    "hex": string.digits + "abcdef",
    "HEX": string.digits + "ABCDEF",
    "lower": string.ascii_lowercase,
    "upper": string.ascii_uppercase,
    "base32": string.ascii_uppercase + "234567",
    "lower36": string.digits + string.ascii_lowercase,
    "upper36": string.digits + string.ascii_uppercase,
    "base62": string.ascii_uppercase + string.ascii_lowercase + string.digits,
    "base64": string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/",
    "base64url": string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_",
}
_VALUE = {}
for _name, _symbols in ALPHABETS.items():
    _VALUE[_name] = np.full(256, -1, np.int16)
    _VALUE[_name][list(_symbols.encode())] = np.arange(len(_symbols))
#: Steps of a standard deviation that probabilities are counted in, and how many of them.
STEP, STEPS = 16, 640


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the three patterns, by start and kind."""
    out = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9a-f]{24,}", text)]  # what [0-9a-f]+ matches, of 24 and more
    return sorted(out, key=lambda x: (x[1], x[0]))


def encoding_of(run: str) -> tuple[str, np.ndarray] | None:
    """A run's encoding and its symbols' values, without padding; None if it is a number or of no encoding."""
    body = run.rstrip("=")
    if len(body) < LEAST_RUN or body.isdigit():
        return None
    codes = np.frombuffer(body.encode(), np.uint8)
    for name, values in _VALUE.items():
        got = values[codes]
        if (got >= 0).all():
            return name, got
    return None


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def random_p(values: np.ndarray, m: int) -> float:
    """The least of three probabilities under uniform independent symbols, times three."""
    n = len(values)
    counts = np.bincount(values, minlength=m).astype(float)
    chi = float((counts**2).sum() * m / n - n)
    df, var = m - 1.0, 2.0 * (m - 1) * (n - 1) / n  # exact mean and variance at any length; cube-root normal of that gamma
    shape = 2 * df * df / var
    z = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * shape))) / math.sqrt(2 / (9 * shape))
    found = [math.erfc(z / math.sqrt(2)) / 2]
    high = values * 2 >= m
    n1 = int(high.sum())
    n0 = n - n1
    if n0 and n1:
        mean = 1 + 2 * n0 * n1 / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        found.append(_two_sided((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(spread)) if spread > 0 else 1.0)
    else:
        found.append(2.0 ** (1 - n))
    d = values - values.mean()
    found.append(_two_sided(float((d[1:] * d[:-1]).sum() / (d * d).sum()) * math.sqrt(n)) if d.any() else 0.0)
    return min(1.0, 3 * min(found))


def equal_pairs(values: np.ndarray) -> int:
    counts = np.bincount(values).astype(np.int64)
    return int((counts * (counts - 1) // 2).sum())


def length_class(n: int) -> int:
    return int(np.searchsorted(LENGTHS, n, "right")) - 1


def found_in(df: DataFrame) -> DataFrame:
    """(doc_id, base, runs, bytes): base spans, tested runs, and in one row of each batch how often each byte occurs."""
    span = "struct<kind:int,start:int,end:int>"
    run_type = "struct<start:int,end:int,code:int,n:int,class:int,pairs:long,random:boolean>"
    key = dict(df.dtypes)["doc_id"]
    names = list(ALPHABETS)

    def tested(text: str) -> list[dict]:
        out = []
        for m in RUN.finditer(text):
            got = encoding_of(m.group())
            if got is not None:
                name, values = got
                out.append({"start": m.start(), "end": m.end(), "code": names.index(name), "n": len(values), "class": length_class(len(values)), "pairs": equal_pairs(values), "random": random_p(values, len(ALPHABETS[name])) > RANDOM_P})
        return out

    spans = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    runs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("code", pa.int32()), ("n", pa.int32()), ("class", pa.int32()), ("pairs", pa.int64()), ("random", pa.bool_())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in sliced([whole])):
            if not batch.num_rows:
                continue
            texts = batch.column(1)
            based = pc.match_substring_regex(texts, r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]|[0-9a-f]{24}")
            ran = pc.match_substring_regex(texts, r"[A-Za-z0-9+/_=-]{16}")
            base: list[list] = [[] for _ in range(batch.num_rows)]
            long: list[list] = [[] for _ in range(batch.num_rows)]
            for i in np.flatnonzero(pc.or_(based, ran).to_numpy(zero_copy_only=False)).tolist():
                text = texts[i].as_py()
                if based[i].as_py():
                    base[i] = [{"kind": k, "start": a, "end": b} for k, a, b in base_spans(text)]
                if ran[i].as_py():
                    long[i] = tested(text)
            total = np.zeros(256, np.int64)
            for text in texts:
                total += np.bincount(np.frombuffer(text.as_buffer(), np.uint8), minlength=256)
            told = [total.tobytes()] + [None] * (batch.num_rows - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, spans), pa.array(long, runs), pa.array(told, pa.binary())], ["doc_id", "base", "runs", "bytes"])

    return df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(scan, f"doc_id {key}, base array<{span}>, runs array<{run_type}>, bytes binary")


def byte_counts(found: DataFrame) -> np.ndarray:
    """How often each byte occurs in all texts: 256 sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["byte", "n"])

    out = np.zeros(256, np.int64)
    for byte, n in found.where("bytes IS NOT NULL").select("bytes").mapInArrow(add, "byte long, n long").groupBy("byte").agg(F.sum("n")).collect():
        out[byte] = n
    return out


def text_model(counts: np.ndarray) -> list[tuple[float, float]]:
    """Of each alphabet the sums of squares and cubes of its symbols' shares in the corpus, each symbol counted once more."""
    out = []
    for symbols in ALPHABETS.values():
        q = counts[list(symbols.encode())] + 1.0
        q /= q.sum()
        out.append((float((q**2).sum()), float((q**3).sum())))
    return out


def step_of(code: Column, n: Column, pairs: Column, model: list[tuple[float, float]]) -> Column:
    """Steps of a standard deviation by which a run has fewer equal pairs than text of its length has."""
    two, three = (F.element_at(F.array(*[F.lit(m[k]) for m in model]), code + 1) for k in (0, 1))
    n = n.cast("double")
    of_pairs = n * (n - 1) / 2
    spread = of_pairs * (two - two * two) + n * (n - 1) * (n - 2) * (three - two * two)
    steps = F.floor(STEP * (of_pairs * two - pairs) / F.sqrt(spread))
    return F.greatest(F.lit(0), F.least(F.lit(STEPS), steps)).cast("int")


def thresholds(counts: dict[tuple[int, int], int], share: float = FALSE_SHARE) -> list[int]:
    """Benjamini-Hochberg in each class of lengths: the least step whose runs are finds, beyond all steps if none is."""
    out = []
    for c in range(len(LENGTHS)):
        per_step = [counts.get((c, s), 0) for s in range(STEPS + 1)]
        total, at_least, best = sum(per_step), 0, STEPS + 1
        for s in range(STEPS, -1, -1):
            at_least += per_step[s]
            if at_least and math.erfc(s / STEP / math.sqrt(2)) / 2 * total <= share * at_least:
                best = s
        out.append(best)
    return out


def spans_of(df: DataFrame, share: float = FALSE_SHARE) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, kind, end), kind as a place in KINDS, sorted; ``spans`` has the finds too."""
    found = staged(found_in(df), "runs")
    model = text_model(byte_counts(found))
    one = found.select(F.explode("runs").alias("r"))
    step = step_of(F.col("r.code"), F.col("r.n"), F.col("r.pairs"), model)
    counts = {(r[0], r[1]): r[2] for r in one.groupBy(F.col("r.class").alias("class"), step.alias("step")).count().collect()}
    least = F.array(*[F.lit(x) for x in thresholds(counts, share)])
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    def kept(r: Column) -> Column:
        sure = r["random"] & (step_of(r["code"], r["n"], r["pairs"], model) >= F.element_at(least, r["class"] + 1))
        return sure & ~F.exists("base", lambda s: (s["start"] < r["end"]) & (r["start"] < s["end"]))

    more = F.transform(F.filter("runs", kept), lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))
    return found.select("doc_id", F.array_sort(base).alias("base"), F.array_sort(F.concat(base, more)).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(df: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [number(k) for k in range(3)]
    return spans_of(df).select("doc_id", *counts, F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
