"""Ordered decision lists, roll-ups and rule tables, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels in ascending order; a level beside the scale is not raised by others. Fixed values.
LEVELS = ["none", "low", "indeterminate", "intermediate", "high", "known_malignancy"]
BESIDE = "not_mentioned"
CLASS_OF = {"none": "no_finding", "low": "low_risk", "indeterminate": "uncertain", "intermediate": "suspicious", "high": "suspicious", "known_malignancy": "known"}


def decide(rules: list[tuple[Column, str | None, str, bool]]) -> Column:
    """struct(level, source, can_raise) of the first rule (condition, level, source, can_raise) that holds."""
    out = None
    for when, level, source, can_raise in rules:
        made = F.struct(F.lit(level).cast("string").alias("level"), F.lit(source).alias("source"), F.lit(can_raise).alias("can_raise"))
        out = F.when(when, made) if out is None else out.when(when, made)
    return out


def rank_of(level: Column) -> Column:
    """The place of a level on the scale."""
    return F.array_position(F.array(*map(F.lit, LEVELS)), level) - 1


def roll_up(findings: DataFrame, key: str, order: str) -> DataFrame:
    """(key, level, source, n, class): the highest level that may raise, the first in order among equals.

    With findings of which none may raise, the report is beside the scale.
    """
    rank = rank_of(F.col("level"))
    raising = F.col("can_raise") & rank.isNotNull()
    best = F.max(F.when(raising, F.struct(rank.alias("r"), (-F.col(order)).alias("o"), "level", "source")))
    out = findings.groupBy(key).agg(best.alias("best"), F.count("*").alias("n"))
    level = F.coalesce("best.level", F.lit(BESIDE))
    classes = F.create_map(*(F.lit(x) for kv in CLASS_OF.items() for x in kv))
    return out.select(key, level.alias("level"), F.col("best.source").alias("source"), "n", F.coalesce(classes[level], F.lit("insufficient")).alias("class"))


def low_confidence(df: DataFrame, prior: Column, default_rule: Column) -> DataFrame:
    """Adds the filter codes that apply, joined by |, and whether any does."""
    codes = F.concat_ws("|", F.when(prior, "F1"), F.when(default_rule, "F2"))
    return df.withColumn("filter_codes", codes).withColumn("low_confidence", codes != "")


def label_rules(df: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """(key, label, flag) by rules (label, concepts, required, excluded): a row fires if its concept is listed, its context meets the required ones and none of the excluded."""
    x = df.join(F.broadcast(rules), F.array_contains("concepts", F.col("concept")))
    fits = ((F.size("required") == 0) | F.arrays_overlap("context", "required")) & ~F.coalesce(F.arrays_overlap("context", "excluded"), F.lit(False))
    return x.groupBy(key, "label").agg(F.max(fits.cast("int")).alias("flag"))
