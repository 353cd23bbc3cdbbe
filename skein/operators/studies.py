"""Comparing systems and judges: agreement, curves by class and stratum, alarms at equal budgets, reconciliation.

Ratios over nothing are null unless it is said otherwise. Labels are 0 or 1; rows
with a null label or score are left out where a curve is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chance_f1, f1
from . import ranks
from .exact import two_sided_normal

#: Least rows and positives of a stratum that has a say in a weighted curve; fixed values.
STRATUM_ROWS, STRATUM_POSITIVES = 50, 3


def agreement_shares(tp: Column, fp: Column, fn: Column, tn: Column) -> tuple[Column, Column]:
    """Positive and negative per cent agreement; over no cases, 0."""
    return 100 * tp / F.greatest(F.lit(1), tp + fn), 100 * tn / F.greatest(F.lit(1), tn + fp)


def macro_scores(cells: DataFrame) -> DataFrame:
    """(n_seen, macro_seen, macro_all, macro_either) of classes (tp, fp, fn).

    macro_seen is over classes with gold or predicted rows, macro_all counts the
    others as 0, macro_either leaves out classes without gold rows unless predicted.
    """
    score = f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return cells.agg(F.count(score).alias("n_seen"), F.avg(score).alias("macro_seen"), F.avg(F.coalesce(score, F.lit(0.0))).alias("macro_all"), F.avg(F.when((F.col("tp") + F.col("fn") > 0) | (F.col("fp") > 0), F.coalesce(score, F.lit(0.0)))).alias("macro_either"))


def concept_scores(gold: DataFrame, found: DataFrame, docs: DataFrame, doc: str, concept: str) -> DataFrame:
    """(tp, fp, fn, micro_f1, mean_f1, n_empty): pairs (doc, concept) of both sides over all documents; a document empty on both counts apart."""
    a, b = gold.select(doc, concept).distinct().withColumn("__a", F.lit(1)), found.select(doc, concept).distinct().withColumn("__b", F.lit(1))
    x = a.join(b, [doc, concept], "full")
    per = x.groupBy(doc).agg(F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("tp"), F.count_if(F.col("__a").isNull()).alias("fp"), F.count_if(F.col("__b").isNull()).alias("fn"))
    every = docs.select(doc).distinct().join(per, doc, "left").na.fill(0, ["tp", "fp", "fn"])
    score = f1(F.col("tp"), F.col("fp"), F.col("fn"))
    sums = [F.sum(c) for c in ("tp", "fp", "fn")]
    return every.agg(*(s.alias(c) for s, c in zip(sums, ("tp", "fp", "fn"))), f1(*sums).alias("micro_f1"), F.avg(score).alias("mean_f1"), F.count_if(score.isNull()).alias("n_empty"))


def class_aucs(df: DataFrame, model: str, seed: str, label_class: str, score: str, label: str) -> DataFrame:
    """(model, macro_auc, micro_auc): means over seeds, of the mean over the classes that have both labels, and of all classes pooled."""
    one = ranks.auc(df, score, label, (model, seed, label_class)).groupBy(model, seed).agg(F.avg("auc").alias("a")).groupBy(model).agg(F.avg("a").alias("macro_auc"))
    pooled = ranks.auc(df, score, label, (model, seed)).groupBy(model).agg(F.avg("auc").alias("micro_auc"))
    return one.join(pooled, model)


def stratum_auc(df: DataFrame, stratum: str, score: str, label: str, rows: int = STRATUM_ROWS, positives: int = STRATUM_POSITIVES) -> DataFrame:
    """(n_strata, auc): the AUCs within strata that are large enough, weighted by their rows."""
    n = F.col("n_pos") + F.col("n_neg")
    per = ranks.auc(df, score, label, (stratum,)).where((n >= rows) & (F.col("n_pos") >= positives) & F.col("auc").isNotNull())
    return per.agg(F.count("*").alias("n_strata"), F.try_divide(F.sum(F.col("auc") * n), F.sum(n).cast("double")).alias("auc"))


def horizon_auc(df: DataFrame, event: str, mask: str, score: str) -> DataFrame:
    """(horizon, n_pos, n_neg, auc) for arrays with an event and a validity flag for each year; horizon 0 is the combined one.

    Combined, cases have an event after the first year, controls none in all years
    and a valid last one; events of the first year belong to neither.
    """
    years = df.select(score, F.posexplode(F.arrays_zip(F.col(event).alias("e"), F.col(mask).alias("m"))).alias("i", "x")).where("x.m = 1").select(score, (F.col("i") + 1).alias("horizon"), F.col("x.e").alias("y"))
    any_ = lambda a: F.aggregate(a, F.lit(0), lambda x, y: F.greatest(x, y.cast("int")))
    case, control = any_(F.slice(event, 2, 100)) == 1, (any_(F.col(event)) == 0) & (F.element_at(mask, -1) == 1)
    both = df.where((F.get(event, F.lit(0)) == 0) & (case | control)).select(score, F.lit(0).alias("horizon"), case.cast("int").alias("y"))
    return ranks.auc(years.unionByName(both), score, "y", ("horizon",))


def rescue(hits: Column, budget: Column, positives: Column, all_: Column) -> tuple[Column, Column]:
    """What a random choice of that budget would hit, and how many times more was hit."""
    expected = F.try_divide(budget * positives, all_.cast("double"))
    return expected, F.try_divide(hits, expected)


def missed_overlap(missed: DataFrame, case: str, model: str) -> DataFrame:
    """(a, b, n_a, n_b, n_both, jaccard) of pairs of models over the cases each missed; a case has few models, which are gathered as a set."""
    sets = missed.select(case, model).distinct().groupBy(case).agg(F.sort_array(F.collect_set(model)).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    both = sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n_both"))
    n = missed.select(case, model).distinct().groupBy(model).agg(F.count("*").alias("n"))
    names = n.select(F.col(model).alias("a"), F.col("n").alias("n_a")).join(n.select(F.col(model).alias("b"), F.col("n").alias("n_b")), F.col("a") < F.col("b"))  # one row a pair of models
    out = names.join(both, ["a", "b"], "left").withColumn("n_both", F.coalesce("n_both", F.lit(0)))
    return out.withColumn("jaccard", F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both")))


def alarms(df: DataFrame, model: str, score: str, case: str, budget: int) -> DataFrame:
    """Adds `alarm`: whether the case is among its model's `budget` highest scores, ties by case."""
    r = ranks.running(df, score, {"__k": F.lit(1)}, [model], [case], descending=True)
    return r.withColumn("alarm", F.col("__k") < budget).drop("__k")


def false_alarm_enrichment(df: DataFrame, model: str, label: str, later: str) -> DataFrame:
    """(model, n_fp, n_tn, fp_share, tn_share, enrichment): later positives among a model's false alarms against its own true negatives."""
    y, late = F.col(label) == 0, F.col(later).cast("int")
    fp, tn = y & F.col("alarm"), y & ~F.col("alarm")
    x = df.groupBy(model).agg(F.count_if(fp).alias("n_fp"), F.count_if(tn).alias("n_tn"), F.avg(F.when(fp, late)).alias("fp_share"), F.avg(F.when(tn, late)).alias("tn_share"))
    return x.withColumn("enrichment", F.try_divide(F.col("fp_share"), F.col("tn_share")))


def marginal(df: DataFrame, case: str, model: str, label: str, first: str, second: str) -> DataFrame:
    """One row: what two models catch at their alarms, and what the second adds among the first's misses and quiet negatives."""
    on = lambda m: F.coalesce(F.bool_or(F.when(F.col(model) == m, F.col("alarm"))), F.lit(False))
    per = df.groupBy(case).agg(F.max(label).alias("y"), on(first).alias("a"), on(second).alias("b"))
    y, a, b = F.col("y") == 1, F.col("a"), F.col("b")
    return per.agg(F.count_if(y & a).alias("caught_first"), F.count_if(y & b).alias("caught_second"), F.count_if(y & ~a).alias("missed_first"), F.count_if(y & ~a & b).alias("rescued"), F.count_if(~y & ~a).alias("quiet_first"), F.count_if(~y & ~a & b).alias("new_alarms"), F.count_if(y & (a | b)).alias("caught_either"))


def capture_matrix(df: DataFrame, case: str, model: str, label: str, models: Sequence[str], score: str) -> DataFrame:
    """(case, one flag a model, n_models, top): positive cases with the models that catch them."""
    per = df.where(F.col(label) == 1).groupBy(case).agg(*(F.coalesce(F.max(F.when(F.col(model) == m, F.col("alarm").cast("int"))), F.lit(0)).alias(m) for m in models), F.max(score).alias("top"))
    return per.withColumn("n_models", sum((F.col(m) for m in models), F.lit(0)))


def worst_gap(spark, correct: Sequence[int], only_a: int, only_b: int, missed: Sequence[int], precision_a: float, precision_b: float) -> DataFrame:
    """(gap, correct, a, b, missed): over a grid of counts the greatest difference of two systems' F1 that unlabelled data allow.

    Either system's own findings may all be right or all be wrong. Ties go to the
    smallest counts.
    """
    grid = spark.createDataFrame([(list(correct), list(missed))], "c array<int>, m array<int>").select(F.explode("c").alias("correct"), "m").select("correct", F.explode("m").alias("missed"))
    grid = grid.select("*", F.explode(F.array_distinct(F.array(F.lit(0), F.lit(only_a)))).alias("a")).select("*", F.explode(F.array_distinct(F.array(F.lit(0), F.lit(only_b)))).alias("b"))
    gold = F.col("correct") + F.col("a") + F.col("b") + F.col("missed")
    score = lambda tp, p: F.try_divide(2 * tp, F.try_divide(tp, F.lit(p)) + gold)
    gap = F.round(F.abs(F.coalesce(score(F.col("correct") + F.col("a"), precision_a), F.lit(0.0)) - F.coalesce(score(F.col("correct") + F.col("b"), precision_b), F.lit(0.0))), 12)
    best = F.max(F.struct(gap.alias("gap"), *((-F.col(c)).alias(f"n_{c}") for c in ("correct", "a", "b", "missed"))))
    return grid.where(gold > 0).agg(best.alias("x")).select("x.gap", *((-F.col(f"x.n_{c}")).alias(c) for c in ("correct", "a", "b", "missed")))


def reconciled(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Both annotators' values beside each other for every key, with `agreement` exact or disagreement; a key on one side only is a disagreement."""
    x = a.select(*keys, *(F.col(c).alias(f"a_{c}") for c in values)).join(b.select(*keys, *(F.col(c).alias(f"b_{c}") for c in values)), list(keys), "full")
    same = F.lit(True)
    for c in values:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    return x.withColumn("agreement", F.when(same, "exact").otherwise("disagreement"))


def distractor_audit(df: DataFrame, answers: Sequence[str], no: str = "H") -> DataFrame:
    """(n, rejected, rate): distractors that at least one answer rejects; no distractors have no rate."""
    hit = F.lit(False)
    for c in answers:
        hit = hit | F.coalesce(F.upper(F.trim(c)) == no, F.lit(False))
    return df.where("is_distractor").agg(F.count("*").alias("n"), F.count_if(hit).alias("rejected"), F.try_divide(100.0 * F.count_if(hit), F.count("*").cast("double")).alias("rate"))


def verdict(value: Column, threshold: Column) -> Column:
    """Whether a metric reaches its threshold; what is null or not a number wasn't measured."""
    return F.when(value.isNull() | F.isnan(value), "not_measured").when(value >= threshold, "passed").otherwise("failed")


def strata_against_chance(df: DataFrame, stratum: str, gold: str, pred: str) -> DataFrame:
    """(stratum, n, f1, chance, lift): each stratum and ALL, with the F1 that independent labels of the same counts would reach."""
    y, p = F.col(gold) == 1, F.col(pred) == 1
    x = df.rollup(stratum).agg(F.grouping(stratum).alias("__g"), F.count("*").alias("n"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    by_chance = chance_f1(tp + fn, tp + fp, F.col("n"))
    out = x.select(F.when(F.col("__g") == 1, "ALL").otherwise(F.col(stratum)).alias(stratum), "n", f1(tp, fp, fn).alias("f1"), by_chance.alias("chance"))
    return out.withColumn("lift", F.col("f1") - F.col("chance"))


def auc_score(auc: Column, n_pos: Column, n_neg: Column, least: int = 3) -> Column:
    """The normal score of an AUC against one half (Mann and Whitney); null with fewer than `least` rows of a label."""
    n1, n0 = n_pos.cast("double"), n_neg.cast("double")
    z = F.abs(auc * n1 * n0 - n1 * n0 / 2) / F.sqrt(n1 * n0 * (n1 + n0 + 1) / 12)
    return F.when((n_pos >= least) & (n_neg >= least), z)


def normal_p(z: Column) -> Column:
    """The two-sided p value of a normal score, also of a difference over its bootstrap standard error; null stays null. SQL has no error function, so a worker computes it."""

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v != v else two_sided_normal(v)).astype("float64")

    return tail(z.cast("double"))
