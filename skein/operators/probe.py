"""Logistic probes on vectors: out-of-fold scores, and a threshold fixed before the held-out part is read.

The vectors are standardised by the mean and the population deviation of the
training rows, classes weigh alike, and the loss is w.w/2 + c * sum(weight *
loss). Spark ML fits it: its objective is a mean, so the penalty is 1 / (c * n),
and as its scaler divides by the sample deviation, (n - 1) / n of that.
What the driver holds is one coefficient a dimension.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def grouped_fold(group: Column, folds: int = 5, seed: int = 0) -> Column:
    """The fold of a group, by a seeded hash: rows of one group are never in two folds. Strata are even only on average."""
    return F.pmod(F.xxhash64(F.lit(seed), group), F.lit(folds)).cast("int")


def balanced_folds(df: DataFrame, group: str, stratum: Column, folds: int = 5, seed: int = 0, into: str = "fold") -> DataFrame:
    """Adds the fold of each row's group: groups of one stratum (an aggregate over the group) are dealt in turn in the order of a hash, so every stratum is even up to one group."""
    g = df.groupBy(group).agg(stratum.alias("__stratum"))
    order = F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string")).cast("binary"))
    dealt = g.withColumn(into, ((F.row_number().over(W.partitionBy("__stratum").orderBy(order, group)) - 1) % folds).cast("int"))
    return df.join(dealt.select(group, into), group, "left")


class Probe:
    """A fitted probe; `score` adds the probability of class 1."""

    def __init__(self, scaler, model, vector: str):
        self.scaler, self.model, self.vector = scaler, model, vector

    def score(self, df: DataFrame, into: str = "score") -> DataFrame:
        x = df.withColumn("__x", array_to_vector(self.vector))
        out = self.model.transform(self.scaler.transform(x))
        return out.withColumn(into, vector_to_array("__p")[1]).select(*df.columns, into)


def fit(train: DataFrame, vector: str, target: str, c: float = 1.0, most_steps: int = 200) -> Probe | None:
    """The probe of the rows that have a vector and a target of 0 or 1; None if one class is missing."""
    rows = train.where(F.col(vector).isNotNull() & F.col(target).isin(0, 1)).select(F.col(vector), F.col(target).cast("double").alias("__y"))
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("__y"), F.lit(0.0))).first()
    if not 0 < ones < n:
        return None
    x = rows.select("__y", array_to_vector(vector).alias("__x"), F.when(F.col("__y") == 1, n / (2 * ones)).otherwise(n / (2 * (n - ones))).alias("__w"))
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="__x", outputCol="__z").fit(x)
    model = LogisticRegression(
        featuresCol="__z", labelCol="__y", weightCol="__w", probabilityCol="__p", rawPredictionCol="__r", predictionCol="__c",
        regParam=(n - 1) / n / (c * n), elasticNetParam=0.0, standardization=False, maxIter=most_steps, tol=1e-7,
    ).fit(scaler.transform(x))
    return Probe(scaler, model, vector)


def out_of_fold(df: DataFrame, vector: str, target: str, fold: str, folds: int = 5, c: float = 1.0, into: str = "score") -> DataFrame:
    """Adds to each row the score of a probe that was fitted on the other folds (0 to folds - 1).

    The score is null where the other folds lack a class, where the row has no
    vector, and where its fold is null or no such number.
    """
    out = df.where(F.col(fold).isNull() | ~F.col(fold).between(0, folds - 1)).withColumn(into, F.lit(None).cast("double"))
    for k in range(folds):
        mine = df.where(F.col(fold) == k)
        probe = fit(df.where((F.col(fold) != k) & F.col(fold).between(0, folds - 1)), vector, target, c)
        none = mine.withColumn(into, F.lit(None).cast("double"))
        out = out.unionByName(none if probe is None else probe.score(mine.where(F.col(vector).isNotNull()), into).unionByName(none.where(F.col(vector).isNull())))
    return out


def threshold_at_load(scores: DataFrame, load: float, score: str = "score") -> float | None:
    """The threshold at which the share `load` of the rows alarms: the interpolated quantile 1 - load."""
    return scores.agg(F.percentile(F.col(score), 1 - load)).first()[0]


def held_out(df: DataFrame, threshold: float | None, target: str, score: str = "score") -> DataFrame:
    """One row: tp, fn and fp of the alarms at a threshold that was fixed elsewhere. No threshold raises no alarm."""
    alarm = F.coalesce(F.col(score) >= F.lit(threshold), F.lit(False))
    one = F.col(target) == 1
    return df.agg(F.count_if(alarm & one).alias("tp"), F.count_if(~alarm & one).alias("fn"), F.count_if(alarm & ~one).alias("fp"))
