"""Bounded samples of labelled rows, and the split of ids into learning and held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, divisor: int, held_out: int, limit: int) -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` learning rows that have the label, chosen by a hash of the id.

    Labels are chosen first; only the chosen ones, whose number is bounded, are broadcast to the documents.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.where(remainder(F.col("doc_id"), divisor) != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def document_sample(documents: DataFrame, limit: int) -> DataFrame:
    """(doc_id, text) of at most ``limit`` ids, chosen by a hash of the id."""
    chosen = documents.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(limit)
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
