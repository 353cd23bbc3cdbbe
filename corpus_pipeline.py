"""A corpus pipeline: toxic, poor and near-duplicate documents go, personal data is masked, the rest is packed.

Every stage takes (spark, docs, sf_dir), uses only the columns of `documents`
(others are dropped) and works on all rows that the stage before kept. Rows with
null text pass as empty ones where a stage has no reason to reject them; rows
with null ids are kept. Texts of any length go through every stage whole. Empty
tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm import jaccard, packing, pii, quality, toxicity
from skein.session import settled, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half."""
    docs = docs.select(COLUMNS)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("score < 0.5").select(COLUMNS)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is at least one half."""
    docs = docs.select(COLUMNS)
    forest = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, forest).where("score >= 0.5").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component the document with the smallest id; of rows with one id, the first by text."""
    docs = docs.select(COLUMNS)
    first = jaccard.join(docs).where("doc_id = component_id").select("doc_id").distinct()
    once = F.row_number().over(W.partitionBy("doc_id").orderBy("text"))
    kept = docs.join(first, "doc_id", "left_semi").withColumn("__nth", once).where("__nth = 1")
    return kept.select(COLUMNS).union(docs.where("doc_id is null"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind of each piece of personal data in its place; n_chars follows the text."""
    found = pii.detect(docs.select(COLUMNS), keep=("doc_id", "lang", "source", "n_chars"), redacted=True)
    size = F.when(F.size("spans") > 0, F.length("redacted")).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", size.cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_copies", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: SQL can express none of the learnt or searching stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
