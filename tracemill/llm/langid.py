"""Language ID by prediction by partial matching (PPM) over bytes.

Each language has a tree of contexts of up to three bytes. A symbol's code length is -log2 of its probability in the
deepest context that the language has: seen symbols share ``total / (total + distinct)`` by count, the escape's share
goes to the shorter context's distribution over the symbols not seen here (exclusion), down to equal shares of 256 bytes.
After training the statistics are frozen, so the code lengths of all symbols seen after a context, and each context's
escape, exclusion included, are known beforehand; a byte is looked up in the deepest context that has seen it, and the
escapes on the way are added. The language with the shortest code wins.

The trees are learned from a bounded sample: about ``SAMPLE`` rows of each language, chosen by a hash of the id over the
whole table, whole texts. The sample is the only bound: every context and every count of it is kept, as sorted arrays
with a row for each four-byte string that the sample has, so that the model is smaller than the sample's text times the
number of languages. Counting is distributed.

Edge cases: null texts and texts without a letter are ``und`` with score 0; ties go to the first language by name;
without labelled rows every text is ``und``; a language of which there are only empty texts has 8 bits for each byte;
repeated rows each get a row; a null id is not held out and is not learned from; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .common import col, crc_mod, hash_share, plain, sliced, small_batches, with_fields

#: Rows of each language that are learned from, about; bytes of a context, at most.
SAMPLE, DEPTH = 800, 3
#: What an escape has from a context that has seen all that the shorter one expects; rests up to this are none.
NONE_LEFT = 1e-12
PAD = b"\n\n\n"
LETTER = regex.compile(r"\p{L}")


def gram_counts(df: DataFrame) -> DataFrame:
    """Counts of four-byte strings by language: (lang, gram, n); ``df`` has lang and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(PAD + text.encode())
            for lang, texts in by_lang.items():
                found = []
                for t in texts:
                    a = np.frombuffer(t, np.uint8).astype(np.int64)
                    found.append(a[:-3] << 24 | a[1:-2] << 16 | a[2:-1] << 8 | a[3:])
                grams, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return df.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))


class Model:
    """Frozen statistics. For contexts of 0 to DEPTH bytes: ``grams``, sorted, are the contexts with a symbol behind them,
    the last byte nearest; ``bits[gram, language]`` the symbol's code length there; ``contexts``, sorted, the contexts
    alone, and ``escapes[context, language]`` what is added to a shorter context's code length for any other symbol."""

    def __init__(self, counts: pa.Table, langs: list[str]):
        """counts: lang, gram, n."""
        self.langs = sorted(langs)
        gram, n = counts["gram"].to_numpy().astype(np.uint32), counts["n"].to_numpy().astype(float)
        lang = pc.index_in(counts["lang"].combine_chunks(), pa.array(self.langs, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
        self.grams: list[np.ndarray] = []
        self.bits: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        share = np.full((256, len(self.langs)), 1 / 256)
        for order in range(DEPTH + 1):
            key = gram & np.uint32((1 << 8 * order + 8) - 1)
            grams, at = np.unique(key, return_inverse=True) if order else (np.arange(256, dtype=np.uint32), key.astype(np.int64))
            count = np.zeros((len(grams), len(self.langs)))
            np.add.at(count, (at, lang), n)
            # all that ends here ends in the shorter context too
            shorter = share[np.searchsorted(self.grams[-1], grams & np.uint32((1 << 8 * order) - 1))] if order else share
            starts = _runs(grams >> np.uint32(8))
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(grams))))
            total, distinct = np.add.reduceat(count, starts, axis=0), np.add.reduceat((count > 0).astype(float), starts, axis=0)
            left = 1 - np.add.reduceat(np.where(count > 0, shorter, 0), starts, axis=0)
            escape = np.where(left > NONE_LEFT, distinct / np.maximum(total + distinct, 1), 0)
            other = np.where(total > 0, np.where(left > NONE_LEFT, escape / np.maximum(left, NONE_LEFT), NONE_LEFT), 1)
            share = np.where(count > 0, (1 - escape[of]) * count / np.maximum(total[of], 1), other[of] * shorter)
            self.grams.append(grams)
            self.bits.append(-np.log2(share).astype(np.float32))
            self.contexts.append(grams[starts] >> np.uint32(8))
            self.escapes.append(-np.log2(other).astype(np.float32))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places among sorted keys, and whether the key there is the wanted one."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        #: Bytes whose code lengths are held at once.
        self.most = max(1 << 12, (1 << 20) // max(1, len(model.langs)))

    def bits_of(self, grams: np.ndarray) -> np.ndarray:
        """Code lengths, in each language, of the last byte of each four-byte string."""
        model = self.model
        out = np.zeros((len(grams), len(model.langs)), np.float32)
        rest = np.arange(len(grams))
        for order in range(DEPTH, -1, -1):
            key = grams[rest] & np.uint32((1 << 8 * order + 8) - 1)
            at, hit = _find(model.grams[order], key)
            out[rest[hit]] += model.bits[order][at[hit]]
            rest, key = rest[~hit], key[~hit]
            if not len(rest):
                break
            at, hit = _find(model.contexts[order], key >> np.uint32(8))
            out[rest[hit]] += model.escapes[order][at[hit]]
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(texts), len(self.model.langs)))
        group: list[int] = []
        held = 0
        for i, t in enumerate(texts):
            group.append(i)
            held += len(t)
            if held > 1 << 20 or i + 1 == len(texts):
                self._add(texts, group, out)
                group, held = [], 0
        return out

    def _add(self, texts: list[bytes], group: list[int], out: np.ndarray) -> None:
        raw = np.frombuffer(b"".join(PAD + texts[i] for i in group), np.uint8).astype(np.uint32)
        grams = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
        ends = np.cumsum([len(texts[i]) + len(PAD) for i in group])
        starts = ends - [len(texts[i]) + len(PAD) for i in group]
        for first in range(0, len(grams), self.most):
            bits = self.bits_of(grams[first : first + self.most])
            for k in range(int(np.searchsorted(ends, first, "right")), int(np.searchsorted(starts, first + self.most))):
                a, b = max(starts[k] - first, 0), min(ends[k] - len(PAD) - first, len(bits))
                if a < b:
                    out[group[k]] += bits[a:b].sum(axis=0, dtype=np.float64)


def train(df: DataFrame, use: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn a model from labelled rows: about ``sample`` rows of each language among those ``use`` holds for."""
    rows = df.select(col(id_col).alias("id"), col(text_col).alias("text"), col(lang_col).alias("lang"), (F.lit(True) if use is None else use).alias("use")).where(F.col("use") & F.col("lang").isNotNull() & F.col("id").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, sample / n)).otherwise(share)
    chosen = rows.where((hash_share(F.col("id"), 11) < share) & F.col("text").isNotNull())
    with small_batches(df.sparkSession):
        return Model(gram_counts(chosen).toArrow(), list(sizes))


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``keep`` columns, then lang_pred, score and bits_per_byte for each row; one pass, no shuffle.

    ``prefix`` goes before the three names where ``keep`` has such names too.

    score: the share of the best language if all are equally likely beforehand, 2^-length each.
    """
    keep = [id_col] if keep is None else keep
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        langs = scorer.model.langs
        for batch in sliced(batches):
            texts = [t if t and langs and LETTER.search(t) else None for t in batch.column(batch.num_columns - 1).to_pylist()]
            raw = [t.encode() if t else b"" for t in texts]
            lengths = scorer.code_lengths(raw) if langs else np.zeros((len(raw), 1))
            best = lengths.argmin(axis=1)
            score = 1 / np.exp2(np.maximum(lengths.min(axis=1, keepdims=True) - lengths, -1000)).sum(axis=1)
            per_byte = [float(m) / len(r) if r else None for m, r in zip(lengths.min(axis=1), raw, strict=True)]
            said = [langs[b] if t else "und" for b, t in zip(best.tolist(), texts, strict=True)]
            sure = [float(s) if t else 0.0 for s, t in zip(score, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(said, pa.string()), pa.array(sure, pa.float64()), pa.array(per_byte, pa.float64())], schema.names)

    schema = with_fields(df, keep, (f"{prefix}lang_pred", StringType()), (f"{prefix}score", DoubleType()), (f"{prefix}bits_per_byte", DoubleType()))
    return plain(df, keep, col(text_col)).mapInArrow(run, schema)


def language_query(docs: DataFrame) -> DataFrame:
    """Held-out predictions: what is held out by crc32(doc_id) mod 5 = 0 is never learned from."""
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = train(docs, ~held)
    out = predict(docs, model, keep=["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "bits_per_byte")
