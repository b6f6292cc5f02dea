"""Documents to packed training sequences: language ID, toxicity, line dedup, near dedup, packing.

Each stage is a function of (spark, docs, sf_dir); all but the last return the columns of documents. ``run`` writes each
stage's result in the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import langid, linededup, neardup, packing, toxicity
from tracemill.llm.common import col, drop_staged, free_names, free_prefix, staged
from tracemill.llm.queries import tokenizer_file

#: A document stays if the share of its best language is at least this; texts without letters have none.
LEAST_SHARE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: those without letters, null and empty ones too, and those where no language has
    half the share. Without any labelled row all go, as nothing tells a language. Repeated rows go or stay alike; further
    columns stay, whatever they are called; an empty table stays empty."""
    model = langid.train(docs)
    prefix = free_prefix(docs.columns, "lang_pred", "score", "bits_per_byte")
    out = langid.predict(docs, model, keep=docs.columns, prefix=prefix)
    return out.where((col(f"{prefix}lang_pred") != "und") & (col(f"{prefix}score") >= LEAST_SHARE)).select(*map(col, docs.columns))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; learned from the labels of those that are here. Null and empty texts have
    the score of the bias; without labels all stay. Repeated rows go or stay alike; further columns stay."""
    weights = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    prefix = free_prefix(docs.columns, "score", "predicted")
    out = toxicity.score(docs, weights, keep=docs.columns, prefix=prefix)
    return out.where(col(f"{prefix}predicted") == 0).select(*map(col, docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go, with n_chars made anew; documents of which nothing stays go.
    Null and short texts stay as they are; rows that repeat an id and text have the same lines removed; further columns
    stay."""
    lines, removed = free_names(docs.columns, "lines", "removed")
    out = linededup.dedup_lines(docs, lines, removed).where((col(removed) == 0) | (col(removed) < col(lines)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*map(col, docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest id. Each row is judged by its own text;
    rows that repeat both are the same document and stay together, as do documents without words and rows without an id."""
    return neardup.without_near_duplicates(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1,024 tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. Null and empty texts are their end token; repeated rows are packed each; further columns go."""
    return packing.packed(docs, *tokenizer_file("byte_bpe_50k.json"))


STAGES = [("language", language_stage), ("toxicity", toxicity_stage), ("lines", line_stage), ("near_duplicates", near_stage), ("packing", packing_stage)]

#: SQL can't express the language and toxicity models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after another; the last one's rows. Each stage's table is deleted when the
    next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_staged(before)
    return STAGES[-1][1](spark, docs, sf_dir)
