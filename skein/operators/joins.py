"""Joins with stated tie and duplicate rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unique_on(df: DataFrame, keys: list[str], name: str = "right side") -> DataFrame:
    """The same frame, whose keys are checked to be unique."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{name}: {keys} isn't unique, for example {twice[0]}")
    return df


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join whose right side must have one row a key."""
    return left.join(unique_on(right, keys), keys, how)


def lookup(left: DataFrame, right: DataFrame, key: str, value: str, order: str, default=None) -> DataFrame:
    """Adds the value that the last row (by order) of the right side has for the key, or the default."""
    last = right.groupBy(key).agg(F.max_by(value, order).alias(value))
    out = left.join(last, key, "left")
    return out if default is None else out.withColumn(value, F.coalesce(value, F.lit(default)))


def occurrence(df: DataFrame, keys: list[str], order: list[str], into: str = "nth") -> DataFrame:
    """Adds the number of the row among those with its keys, from 0."""
    return df.withColumn(into, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def occurrence_join(a: DataFrame, b: DataFrame, keys: list[str], order: list[str], how: str = "inner") -> DataFrame:
    """Joins the n-th occurrence of a key on one side with the n-th on the other."""
    return occurrence(a, keys, order).join(occurrence(b, keys, order).drop(*order), [*keys, "nth"], how)


def nearest(source: DataFrame, target: DataFrame, within: list[str], right_on_tie: bool, limit: int | None = None) -> DataFrame:
    """For each source span (id, s, e) the nearest target span (t_id, t_s, t_e) of the same group.

    Distance is the gap between spans, 0 if they meet or overlap. At equal
    distance the side decides if right_on_tie; two nearest on one side, or on both
    sides without that rule, are ambiguous: t_id is null and tie true. Spans with a
    null place match nothing; a null group is a group.

    Spans aren't paired: all places of a group are put in one order, along which
    windows carry the next target, the farthest end so far and how many there were.
    """
    a = source.where(F.col("s").isNotNull() & F.col("e").isNotNull()).select(*within, "id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))
    b = target.where(F.col("t_s").isNotNull() & F.col("t_e").isNotNull()).select(*within, "t_id", F.col("t_s").cast("long").alias("t_s"), F.col("t_e").cast("long").alias("t_e"))
    alike = lambda c: F.count("*").over(W.partitionBy(*within, c))
    b = b.repartition(*within).select("*", alike("t_s").alias("n_s"), alike("t_e").alias("n_e"))
    # at one place: where a source begins, then the targets' beginnings, where a source ends, and the targets' ends
    of_a = F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(0).alias("rank")), F.struct(F.col("e").alias("at"), F.lit(2).alias("rank"))))
    of_b = F.explode(F.array(F.struct(F.col("t_s").alias("at"), F.lit(1).alias("rank")), F.struct(F.col("t_e").alias("at"), F.lit(3).alias("rank"))))
    every = a.select("*", of_a.alias("p")).unionByName(b.select("*", of_b.alias("p")), allowMissingColumns=True).select("*", "p.at", "p.rank").drop("p")
    begins, ends = F.col("rank") == 1, F.col("rank") == 3
    order = W.partitionBy(*within).orderBy("at", "rank").rowsBetween(W.unboundedPreceding, -1)
    # what follows is what came before in the other direction
    back = W.partitionBy(*within).orderBy(F.desc("at"), F.desc("rank")).rowsBetween(W.unboundedPreceding, -1)
    count = lambda c: F.coalesce(F.sum(c.cast("long")).over(order), F.lit(0))
    x = every.select(
        *within, "id", "s", "e", "rank", count(begins).alias("cs"), count(ends).alias("ce"),
        F.last(F.when(begins, F.struct("t_s", "n_s", "t_id")), True).over(back).alias("next"), F.max(F.when(begins, F.struct("t_e", "n_e", "t_id"))).over(order).alias("last"),
    ).where("rank in (0, 2)")
    at = lambda rank, c: F.max(F.when(F.col("rank") == rank, F.col(c)))
    here = F.max(F.when(F.col("rank") == 0, F.struct("cs", "ce", "next", "last")))
    j = x.groupBy(*within, "id", "s", "e").agg(here.alias("x"), at(2, "cs").alias("cs_e"), F.count_if(F.col("rank") == 0).alias("times")).select(*within, "id", "s", "e", "x.*", "cs_e", "times")
    right = F.greatest(F.lit(0), F.col("next.t_s") - F.col("e"))
    left = F.greatest(F.lit(0), F.col("s") - F.col("last.t_e"))
    n_right = F.when(right > 0, F.col("next.n_s")).otherwise(F.col("cs_e") - F.col("cs")) * F.col("times")
    n_left = F.when(left > 0, F.col("last.n_e")).otherwise(F.col("cs") - F.col("ce")) * F.col("times")
    sides = F.array_compact(F.array(
        F.when(F.col("next").isNotNull(), F.struct(right.alias("gap"), F.lit(0).alias("side"), n_right.alias("n"), F.col("next.t_id").alias("t_id"))),
        F.when(F.col("last").isNotNull(), F.struct(left.alias("gap"), F.lit(1 if right_on_tie else 0).alias("side"), n_left.alias("n"), F.col("last.t_id").alias("t_id"))),
    ))
    # several spans of one id compete; of each nearest place the number of targets is known, and their id if it is one
    found = j.select(*within, "id", F.explode(sides).alias("x")).select(*within, "id", "x.*")
    if limit is not None:
        found = found.where(F.col("gap") <= limit)
    per = found.groupBy(*within, "id", "gap", "side").agg(F.sum("n").alias("n"), F.min("t_id").alias("t_id"))
    best = per.groupBy(*within, "id").agg(F.min(F.struct("gap", "side", "n", "t_id")).alias("x"))
    return best.select(*within, "id", F.when(F.col("x.n") == 1, F.col("x.t_id")).alias("t_id"), F.col("x.gap").alias("gap"), (F.col("x.n") > 1).alias("tie"))


def first_nearest(source: DataFrame, target: DataFrame, within: list[str]) -> DataFrame:
    """For each source place (id, at) the nearest target place (t_id, t_at) of its group; of equally near ones the first by t_id.

    A target's place is compared with the next source places only: windows carry
    the nearest target before and after each source, so nothing is paired.
    """
    a = source.select(*within, F.col("id"), F.col("at"), F.lit(1).alias("side"), F.lit(None).cast(target.schema["t_id"].dataType).alias("t_id"))
    b = target.select(*within, F.lit(None).cast(source.schema["id"].dataType).alias("id"), F.col("t_at").alias("at"), F.lit(0).alias("side"), F.col("t_id"))
    # of targets at one place the first by id stands for all
    b = b.groupBy(*within, "at").agg(F.min("t_id").alias("t_id")).select(*within, F.lit(None).cast(source.schema["id"].dataType).alias("id"), "at", F.lit(0).alias("side"), "t_id")
    order = W.partitionBy(*within).orderBy("at", "side")
    here = F.when(F.col("side") == 0, F.struct("t_id", F.col("at").alias("t_at")))
    x = a.unionByName(b).withColumn("__t", here)
    # what follows is what came before in the other direction
    back = W.partitionBy(*within).orderBy(F.desc("at"), F.desc("side"))
    so_far = lambda w: F.last("__t", True).over(w.rowsBetween(W.unboundedPreceding, 0))
    x = x.withColumn("__l", so_far(order)).withColumn("__r", so_far(back))
    near = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["t_at"] - F.col("at")).alias("gap"), F.col(c)["t_id"].alias("t_id")))
    best = x.where("side = 1").withColumn("__b", F.least(near("__l"), near("__r"))).where("__b is not null")
    return best.select(*within, "id", F.col("__b.t_id").alias("t_id"), F.col("__b.gap").alias("gap"))


def positional(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Joins the n-th row of one side with the n-th of the other, in the orders given (numeric and unique); what one side has more stays, with nulls."""
    from .ranks import row_index

    return row_index(left, left_order, [], "place").join(row_index(right, right_order, [], "place"), "place", "full")


def set_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(only_a, only_b): distinct keys that one side lacks; two zeros mean equal sets."""
    x = a.select(*keys, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(b.select(*keys, F.lit(0).alias("__a"), F.lit(1).alias("__b")))
    per = x.groupBy(*keys).agg(F.max("__a").alias("a"), F.max("__b").alias("b"))
    return per.agg(F.count_if(F.col("b") == 0).alias("only_a"), F.count_if(F.col("a") == 0).alias("only_b"))


def require_equal_sets(a: DataFrame, b: DataFrame, keys: list[str], name: str) -> None:
    """Fails unless both sides have the same keys."""
    x = set_difference(a, b, keys).first()
    if x.only_a or x.only_b:
        raise ValueError(f"{name}: {x.only_a} keys on the left only, {x.only_b} on the right only")


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order; rows with a null key are one key. Partial minima go before the shuffle, so a frequent key is no hot spot."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("__x")).select(*(c if c in keys else F.col("__x")[c].alias(c) for c in df.columns))


def renamed(df: DataFrame, contract: dict[str, str]) -> DataFrame:
    """The columns that a contract names, under its names and in its order; a missing one is an error."""
    lost = [c for c in contract if c not in df.columns]
    if lost:
        raise ValueError(f"the contract's columns are missing: {lost}")
    return df.select(*(F.col(a).alias(b) for a, b in contract.items()))
