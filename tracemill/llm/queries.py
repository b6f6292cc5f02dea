"""The training-data queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, arc, bpe, collocations, langid, linededup, media, neardup, packing, resampling, secretscan, toxicity, urlfilter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> tuple[str, str]:
    """A vocabulary file's place and the pattern that cuts texts before merging."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), *tokenizer_file("byte_bpe_multi_50k.tiktoken"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_query(table(spark, sf_dir, "documents"))


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc.archive_query(table(spark, sf_dir, "pages")).drop("record_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_query(table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_query(table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_query(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), *tokenizer_file("byte_bpe_50k.json"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(table(spark, sf_dir, "documents"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scanned(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_byte_bpe, op2_language_id, op3_arc_to_warc, op4_line_dedup, op5_minhash_near_dedup, op6_media_columns, op7_nearest_neighbours, op8_toxicity, op9_packing, op10_url_filter, op11_phrase_collocations, op12_secret_scan, op13_importance_resampling)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": linededup.LINE_SQL, "op5_minhash_near_dedup": neardup.NEARDUP_SQL, "op7_nearest_neighbours": ann.NEAREST_SQL, "op3_arc_to_warc": arc.ARCHIVE_SQL, "op11_phrase_collocations": collocations.MINED_SQL, "op13_importance_resampling": resampling.RESAMPLED_SQL}
