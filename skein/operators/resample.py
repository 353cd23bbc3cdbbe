"""Bootstrap by weights: no resampled row is ever made.

In iteration b a cluster counts as often as a Poisson(1) draw says, taken from a
hash of (seed, b, cluster); weights are shared by all systems compared, so
differences are paired. Statistics are weighted sums, computed for all
iterations in one aggregation whose partial sums are made before the shuffle.
Permutations deal the positive clusters anew in each iteration, by the order of
the same hash. A null cluster counts as one cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Cumulated Poisson(1) chances, in order; fixed values.
POISSON_1 = [0.367879441171442, 0.735758882342885, 0.919698602928606, 0.981011843123846, 0.996340153172656, 0.999405815182418, 0.999916758850712, 0.999989750803325, 0.999998874797402]


#: Share of iterations without a defined statistic beyond which an interval isn't trusted; fixed value.
MOST_UNDEFINED = 0.05


def chance(seed: int, iteration: Column, cluster: Column) -> Column:
    """A number from 0 up to 1 for the cluster in the iteration."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), iteration.cast("string"), F.coalesce(cluster.cast("string"), F.lit("")).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / (1 << 32)


def weight(seed: int, iteration: Column, cluster: Column) -> Column:
    """How often the cluster counts in the iteration."""
    u = chance(seed, iteration, cluster)
    return sum((F.when(u >= p, 1).otherwise(0) for p in POISSON_1), F.lit(0))


def weighted(df: DataFrame, cluster: str, sums: dict[str, Column], iterations: int, seed: int = 7) -> DataFrame:
    """One row an iteration with the weighted sums. Rows are first summed by cluster, then clusters are repeated, not rows."""
    per = df.groupBy(cluster).agg(*(F.sum(c.cast("double")).alias(k) for k, c in sums.items()))
    many = per.select("*", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("iteration"))
    w = weight(seed, F.col("iteration"), F.col(cluster))
    return many.withColumn("__w", w).groupBy("iteration").agg(*(F.sum(F.col("__w") * F.col(k)).alias(k) for k in sums))


def interval(draws: DataFrame, value: str, level: float = 0.95, strict: bool = False) -> DataFrame:
    """(mean, low, high, se, p, defined, undefined, trusted) over the iterations in which the value is defined.

    The interval is the linear percentile one, p the two-sided share beyond 0, se
    the standard deviation of the draws. With too many undefined iterations
    nothing is trusted: low, high and p are null, or with strict the query fails.
    """
    lo, hi = (1 - level) / 2, (1 + level) / 2
    below, above = F.avg((F.col(value) <= 0).cast("double")), F.avg((F.col(value) >= 0).cast("double"))
    x = draws.agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(lo)).alias("low"), F.percentile(value, F.lit(hi)).alias("high"), F.stddev_samp(value).alias("se"), F.least(F.lit(1.0), 2 * F.least(below, above)).alias("p"), F.count(value).alias("defined"), (F.count("*") - F.count(value)).alias("undefined"))
    trusted = F.coalesce(F.col("undefined") <= MOST_UNDEFINED * (F.col("defined") + F.col("undefined")), F.lit(False)) & (F.col("defined") > 0)
    x = x.withColumn("trusted", trusted)
    refused = F.raise_error(F.lit("too many undefined iterations for an interval")).cast("double") if strict else F.lit(None).cast("double")
    return x.withColumns({c: F.when(F.col("trusted"), F.col(c)).otherwise(refused) for c in ("low", "high", "p")})


def group_difference(df: DataFrame, cluster: str, group: Column, positive: Column, iterations: int, seed: int = 7) -> DataFrame:
    """One row an iteration: the difference, in per cent, of the shares of positive clusters inside and outside the group."""
    per = df.groupBy(cluster).agg(F.max(group.cast("int")).alias("__g"), F.max(positive.cast("int")).alias("__y"))
    g, y = F.col("__g"), F.col("__y")
    draws = weighted(per, cluster, {"na": g, "pa": g * y, "nb": 1 - g, "pb": (1 - g) * y}, iterations, seed)
    return draws.withColumn("diff", 100 * (F.try_divide(F.col("pa"), F.col("na")) - F.try_divide(F.col("pb"), F.col("nb"))))


def permuted_auc(df: DataFrame, cluster: str, score: str, label: str, iterations: int, seed: int = 7) -> DataFrame:
    """(iteration, auc): iteration 0 has the labels as they are (a cluster's greatest one), the others deal them to the clusters anew.

    Ranks of the scores never change, so a cluster is one row with its rank sum;
    an iteration is a sort of the clusters.
    """
    from .ranks import average_rank

    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(cluster, score, label)
    per = average_rank(known, score, into="__rank").groupBy(cluster).agg(F.sum("__rank").alias("r"), F.count("*").alias("n"), F.max(F.col(label).cast("int")).alias("y"))
    total = per.agg(F.sum("y").alias("positive"), F.sum("n").alias("all"))
    many = per.select("*", F.explode(F.sequence(F.lit(0), F.lit(iterations))).alias("iteration"))
    order = W.partitionBy("iteration").orderBy(F.when(F.col("iteration") == 0, -F.col("y").cast("double")).otherwise(chance(seed, F.col("iteration"), F.col(cluster))), cluster)
    # total is one row
    dealt = many.withColumn("k", F.row_number().over(order)).join(F.broadcast(total)).where("k <= positive")
    sums = dealt.groupBy("iteration").agg(F.sum("r").alias("r"), F.sum("n").cast("double").alias("n"), F.max("all").alias("all"))
    return sums.select("iteration", F.try_divide(F.col("r") - F.col("n") * (F.col("n") + 1) / 2, F.col("n") * (F.col("all") - F.col("n"))).alias("auc"))


def permutation_p(draws: DataFrame, value: str = "auc") -> DataFrame:
    """(observed, n, median, p): the observed value (iteration 0) against the others; p = min(1, 2 * the smaller of (1 + k) / (1 + n)) is never 0."""
    seen = draws.where("iteration = 0").select(F.col(value).alias("observed"))
    null = draws.where("iteration > 0").join(F.broadcast(seen))  # one row
    tail = lambda c: (1 + F.count_if(c)) / (1 + F.count("*"))
    return null.agg(F.max("observed").alias("observed"), F.count("*").alias("n"), F.median(value).alias("median"), F.least(F.lit(1.0), 2 * F.least(tail(F.col(value) <= F.col("observed")), tail(F.col(value) >= F.col("observed")))).alias("p"))


def half_width(support: DataFrame, sums: list[str], statistic, n: int, repeats: int, iterations: int, seed: int = 7) -> DataFrame:
    """(n, half_width): the median over simulated studies of n cases of the half width of a bootstrap interval.

    Cases are drawn from the support rows (place, sums) by a hash; `statistic` maps
    the names of the sums to a column. The support is small by nature: one row a
    kind of case.
    """
    m = support.agg(F.count("*").alias("m"))
    cases = support.sparkSession.range(repeats * n).select(F.floor(F.col("id") / n).cast("int").alias("repeat"), (F.col("id") % n).alias("case"))
    drawn = cases.join(F.broadcast(m)).withColumn("place", F.floor(chance(seed, F.col("repeat"), F.col("case")) * F.col("m")).cast("int")).join(F.broadcast(support), "place")
    many = drawn.select("*", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("iteration"))
    w = weight(seed + 1, F.concat_ws(".", "repeat", "iteration"), F.col("case"))
    draws = many.groupBy("repeat", "iteration").agg(*(F.sum(w * F.col(c)).alias(c) for c in sums)).withColumn("x", statistic(sums))
    per = draws.groupBy("repeat").agg(((F.percentile("x", F.lit(0.975)) - F.percentile("x", F.lit(0.025))) / 2).alias("h"))
    return per.agg(F.lit(n).alias("n"), F.median("h").alias("half_width"))
