"""Streaming counterparts of batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normal_phrase


def phrase_counts(spark: SparkSession, folder: str, schema: str, text: str = "text") -> DataFrame:
    """How often each normal phrase has occurred in the files of a folder so far (output mode complete or update)."""
    docs = spark.readStream.schema(schema).parquet(folder)
    phrases = docs.select(F.explode(F.split(text, r"\n+|\. ")).alias("p"))
    return phrases.select(normal_phrase(F.col("p")).alias("phrase")).where("phrase <> ''").groupBy("phrase").agg(F.count("*").alias("n"))


def windowed(events: DataFrame, time: str, late: str, size: str, *keys: str) -> DataFrame:
    """Counts per key in windows of event time, with a bound on lateness."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), *keys).agg(F.count("*").alias("n")).select("w.start", "w.end", *keys, "n")
