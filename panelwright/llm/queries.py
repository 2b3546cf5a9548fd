"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import brownlm, decontaminate, duckbpe, jaccard, jpegmedia, linededup, merkle, pack, periodic, quality, suffixdedup, tokencount, toxicity
from panelwright.llm.oracles import ORACLE_SQL
from panelwright.llm.shared import table, written

__all__ = ["ORACLE_SQL", "QUERIES"]


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brownlm.scores(table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are stored in the shared folder and read back."""
    return jpegmedia.digests(written(jpegmedia.encoded(table(spark, sf_dir, "documents")), "media"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document by sentence, those over a sentence's boundary given to the larger share."""
    found = tokencount.field_tokens(table(spark, sf_dir, "documents"), kind="sentence", rule="largest")
    return found.select(
        "doc_id",
        "n_tokens",
        "n_crossing",
        F.size("fields").cast("long").alias("n_fields"),
        F.array_max(F.transform("fields", lambda f: f.tokens)).alias("most_tokens"),
        F.array_join(F.transform("fields", lambda f: f.tokens), ",").alias("field_tokens"),
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.packed(table(spark, sf_dir, "documents"), capacity=4096)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.without_repeats(table(spark, sf_dir, "documents"), length=100)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.repeated_units(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.col("n_units").cast("long").alias("n_units"),
        F.size("removed").cast("long").alias("n_removed"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r.end - r.start).alias("chars_removed"),
        F.array_join(F.transform("removed", lambda r: F.concat_ws("-", r.start, r.end)), ",").alias("removed_spans"),
        F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"),
    )


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), k=5, percent=75)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duckbpe.digests(duckbpe.coded(table(spark, sf_dir, "documents")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.repetitions(periodic.planted(table(spark, sf_dir, "documents")), min_length=24, min_periods=3))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(merkle.manifest(table(spark, sf_dir, "documents"), fanout=8))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_media_columns": op2_media_columns,
    "op3_token_counts": op3_token_counts,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
}
