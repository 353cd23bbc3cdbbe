"""Ranks, quantiles, step-wise corrections and curves over an order, without sorting all rows in one task.

`running` is what the rest stands on: values are dealt to ranges of about equal
size (the bounds come from an approximate percentile, one small row), each range
is summed and sorted by itself, and the sums of the ranges before it are added.
Null values come first. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import width

#: Ranges that an order is cut into, at most.
MOST_RANGES = 256


def running(df: DataFrame, value: str, sums: dict[str, Column], by: Sequence[str] = (), ties: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Adds for each of the sums its total over the rows before, in the order of a numeric value, then of the ties, within the groups.

    Rows with one value share a range; with ties given their order is settled within it.
    """
    n = max(1, min(MOST_RANGES, width(df.sparkSession)))
    probs = F.array(*(F.lit(i / n) for i in range(1, n))) if n > 1 else F.array(F.lit(0.5))
    bounds = df.agg(F.array_distinct(F.percentile_approx(F.col(value).cast("double"), probs, F.lit(10_000))).alias("__bounds"))
    of = F.size(F.filter(F.coalesce("__bounds", F.array().cast("array<double>")), lambda b: b < F.col(value).cast("double")))
    # the bounds are one row
    x = df.withColumns({f"__s_{k}": c for k, c in sums.items()}).join(F.broadcast(bounds)).withColumn("__range", F.when(F.col(value).isNull(), -1).otherwise(of)).drop("__bounds")
    if descending:
        x = x.withColumn("__range", -F.col("__range"))
    order = W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    whole = x.groupBy(*by, "__range").agg(*(F.sum(f"__s_{k}").alias(f"__t_{k}") for k in sums))
    offsets = whole.select(*(F.col(c).alias(f"__by_{c}") for c in by), F.col("__range").alias("__at"), *(F.coalesce(F.sum(f"__t_{k}").over(order), F.lit(0)).alias(f"__o_{k}") for k in sums))
    on = F.col("__range") == F.col("__at")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    inside = W.partitionBy(*by, "__range").orderBy(F.desc(value) if descending else F.col(value), *ties)
    before = inside.rowsBetween(W.unboundedPreceding, -1) if ties else inside.rangeBetween(W.unboundedPreceding, 0)
    local = lambda k: F.coalesce(F.sum(f"__s_{k}").over(before), F.lit(0)) if ties else F.sum(f"__s_{k}").over(before) - F.sum(f"__s_{k}").over(W.partitionBy(*by, "__range", value))
    # one row a range and group
    out = x.withColumns({f"__l_{k}": local(k) for k in sums}).join(F.broadcast(offsets) if not by else offsets, on)
    return out.select(*df.columns, *((F.col(f"__l_{k}") + F.col(f"__o_{k}")).alias(k) for k in sums))


def _counted(df: DataFrame, value: str, by: Sequence[str], **more: Column) -> DataFrame:
    """(by, value, __n, more): one row for each distinct value, with the number of rows and further sums."""
    return df.groupBy(*by, value).agg(F.count("*").alias("__n"), *(F.sum(c).alias(k) for k, c in more.items()))


def average_rank(df: DataFrame, value: str, by: tuple[str, ...] = (), into: str = "rank") -> DataFrame:
    """Adds the ascending rank in which ties share their mean. Values are counted first, so a frequent value is one row."""
    c = running(_counted(df, value, by), value, {"__before": F.col("__n")}, by, ["__n"])
    ranked = c.select(*(F.col(k).alias(f"__k_{k}") for k in (*by, value)), (F.col("__before") + (F.col("__n") + 1) / 2).alias(into))
    on = F.lit(True)
    for k in (*by, value):
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return df.join(ranked, on, "left").select(*df.columns, into)


def quantiles(df: DataFrame, value: str, at: dict[str, float], by: tuple[str, ...] = (), floor: bool = False) -> DataFrame:
    """One row a group with exact quantiles of the values that aren't null: interpolated, or with floor the value at place floor(q * n)."""
    known = df.where(F.col(value).isNotNull())
    c = running(_counted(known, value, by), value, {"__before": F.col("__n")}, by, ["__n"])
    n = known.groupBy(*by).agg(F.count("*").alias("__all"))
    x = c.join(n, list(by)) if by else c.join(F.broadcast(n))  # one row without groups

    def pick(place: Column) -> Column:
        return F.max(F.when((F.col("__before") <= place) & (place < F.col("__before") + F.col("__n")), F.col(value).cast("double")))

    def place(q: float) -> Column:
        return F.floor(F.lit(str(q)).cast("decimal(9,8)") * F.col("__all")) if floor else F.lit(q) * (F.col("__all") - 1)

    got = x.groupBy(*by).agg(F.max("__all").alias("__all"), *(e for k, q in at.items() for e in (pick(F.floor(place(q))).alias(f"__lo_{k}"), pick(F.ceil(place(q))).alias(f"__hi_{k}"))))
    between = lambda k, q: F.col(f"__lo_{k}") + (F.col(f"__hi_{k}") - F.col(f"__lo_{k}")) * (place(q) - F.floor(place(q)))
    return got.select(*by, *((F.col(f"__lo_{k}") if floor else between(k, q)).alias(k) for k, q in at.items()))


def auc(df: DataFrame, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The area under the ROC curve by rank sums (ties count half), per group; null with one class only."""
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    c = running(_counted(known, score, by, pos=F.col(label).cast("long")), score, {"__before": F.col("__n")}, by, ["__n"])
    ranked = c.withColumn("rank", F.col("__before") + (F.col("__n") + 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum(F.col("rank") * F.col("pos")).alias("s"), F.sum("pos").alias("n_pos"), F.sum("__n").alias("n"))
    neg = F.col("n") - F.col("n_pos")
    return sums.select(*by, "n_pos", neg.alias("n_neg"), F.try_divide(F.col("s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2, (F.col("n_pos") * neg).cast("double")).alias("auc"))


def average_precision(df: DataFrame, score: str, label: str, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The mean precision at each positive, scores descending, ties by key."""
    x = df.select(*by, score, label, key)
    hits = running(x, score, {"__k": F.lit(1), "__tp": F.col(label).cast("long")}, by, [key], descending=True)
    return hits.where(F.col(label) == 1).groupBy(*by).agg(F.avg((F.col("__tp") + 1) / (F.col("__k") + 1)).alias("ap"))


def operating_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, tpr, fpr): the rates when every row with at least that score alarms; one row for each distinct score."""
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    y = F.col(label).cast("long")
    c = running(_counted(known, score, (), __y=y, __z=1 - y), score, {"__tp": F.col("__y"), "__fp": F.col("__z")}, (), ["__n"], descending=True)
    n = known.agg(F.sum(y).cast("double").alias("__p"), F.sum(1 - y).cast("double").alias("__q"))
    # n is one row
    return c.join(F.broadcast(n)).select(score, F.try_divide(F.col("__tp") + F.col("__y"), F.col("__p")).alias("tpr"), F.try_divide(F.col("__fp") + F.col("__z"), F.col("__q")).alias("fpr"))


def row_index(df: DataFrame, value: str, ties: Sequence[str], into: str = "row_index") -> DataFrame:
    """Adds the place of each row, from 0, in the order of the value and the ties, which together must be unique."""
    return running(df, value, {into: F.lit(1)}, (), ties)


def benjamini_hochberg(p: Column, w_by: tuple[str, ...] = ()) -> Column:
    """The step-up adjusted p value of each row."""
    part = W.partitionBy(*w_by)
    n, k = F.count(p).over(part), F.row_number().over(part.orderBy(p))
    return F.least(F.lit(1.0), F.min(p * n / k).over(part.orderBy(p.desc()).rowsBetween(W.unboundedPreceding, 0)))


def holm(df: DataFrame, p: str, by: tuple[str, ...] = (), into: str = "holm") -> DataFrame:
    """Adds Holm's step-down adjusted p value."""
    part = W.partitionBy(*by)
    m, i = F.count(p).over(part), F.row_number().over(part.orderBy(p)) - 1
    step = df.withColumn("__step", F.least(F.lit(1.0), (m - i) * F.col(p)))
    return step.withColumn(into, F.max("__step").over(part.orderBy(p, "__step").rowsBetween(W.unboundedPreceding, 0))).drop("__step")
