"""Bounded samples of labelled documents, and the folds that are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id gives -1 and so is in every learning fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds, F.lit(-1)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, bounds: dict[int, int]) -> DataFrame:
    """(doc_id, text, label) of at most `bounds[label]` documents of each label, outside the held-out fold.

    The documents are those whose hashed ids are smallest, so the sample does not
    depend on partitions. Only ids are gathered to choose them; the list that is
    then broadcast has at most the sum of the bounds. Of several labels for one id
    the largest counts, of several texts the first in order, so repeated rows make
    the sample no larger.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).where(remainder("doc_id", folds) != held)
    ids = []
    for value, n in bounds.items():
        ids += known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select(F.col("doc_id").cast("long"), "label").collect()
    chosen = spark.createDataFrame(ids, "doc_id long, label int")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
