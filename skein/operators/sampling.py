"""Deterministic samples and splits: order by a seeded sha1, never by a random generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def draw(seed: str, key: str) -> Column:
    """The place of a key in the draw: the sha1 of seed and key."""
    return F.sha1(F.concat(F.lit(seed + "|"), F.col(key).cast("string")).cast("binary"))


def simple(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows without replacement; the same ones for any partitioning."""
    return df.orderBy(draw(seed, key), key).limit(n)


def per_stratum(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows of each stratum."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(stratum).orderBy(draw(seed, key), key))).where(F.col("__r") <= n).drop("__r")


def split(df: DataFrame, stratum: str, key: str, seed: str, train: float = 0.7, dev: float = 0.15) -> DataFrame:
    """Adds `split`: shares of each stratum, rounded half to even; the rest is held out."""
    w = W.partitionBy(stratum)
    n, r = F.count("*").over(w), F.row_number().over(w.orderBy(draw(seed, key), key))
    a, b = F.bround(n * train), F.bround(n * dev)
    return df.withColumn("split", F.when(r <= a, "train").when(r <= a + b, "dev").otherwise("held_out"))


def first_stratum(df: DataFrame, flags: dict[str, Column], key: str, quota: dict[str, int], seed: str) -> DataFrame:
    """Quota samples of overlapping strata in the order given, each row counted in the first stratum it belongs to."""
    stratum = F.coalesce(*(F.when(c, F.lit(k)) for k, c in flags.items()))
    limit = F.create_map(*(x for k, n in quota.items() for x in (F.lit(k), F.lit(n))))
    ranked = df.withColumn("stratum", stratum).where("stratum is not null")
    return ranked.withColumn("__r", F.row_number().over(W.partitionBy("stratum").orderBy(draw(seed, key), key))).where(F.col("__r") <= limit[F.col("stratum")]).drop("__r")


#: Splits that an analysis may read before the locked ones are opened; fixed values.
OPEN_SPLITS = ("train", "dev")
#: Rows that greedy choice may collect; more are an error.
PILOT_ROWS = 1_000_000


def require_open(split: str) -> str:
    """The split's name; a locked one is an error."""
    if split not in OPEN_SPLITS:
        raise PermissionError(f"the split {split!r} is locked; open are {OPEN_SPLITS}")
    return split


def shuffled(df: DataFrame, key: str, seed: str) -> DataFrame:
    """All rows in drawn order."""
    return df.orderBy(draw(seed, key), key)


def shards(df: DataFrame, order: str, n: int) -> DataFrame:
    """Adds `shard`: the row's place in the order (numeric, unique) modulo n."""
    from .ranks import row_index

    return row_index(df, order, [], "__i").withColumn("shard", (F.col("__i") % n).cast("int")).drop("__i")


def equal_share(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows: an equal share of each stratum, topped up from all rows left, in drawn order. No more than n + strata rows a stratum are ranked twice."""
    w = W.partitionBy(stratum).orderBy(draw(seed, key), key)
    share = df.agg(F.floor(F.lit(n) / F.count_distinct(stratum)).alias("__share"))
    # the share is one row
    x = df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).join(F.broadcast(share))
    return x.orderBy(F.when(F.col("__k") > F.col("__share"), 1).otherwise(0), draw(seed, key), key).limit(n).drop("__k", "__share")


def lock(df: DataFrame, patient: str, valid: str, share: float, seed: str) -> DataFrame:
    """(patient, valid): all patients with a valid row, and that share of the others, rounded half to even, in drawn order."""
    from .ranks import running

    g = df.groupBy(patient).agg(F.bool_or(valid).alias(valid))
    others = g.where(~F.col(valid)).withColumn("__h", F.conv(F.substring(draw(seed, patient), 1, 12), 16, 10).cast("double")).withColumn("__d", draw(seed, patient))
    n = others.agg(F.bround(F.count("*") * share).alias("__n"))
    taken = running(others, "__h", {"__k": F.lit(1)}, (), ["__d", patient]).join(F.broadcast(n)).where(F.col("__k") < F.col("__n"))  # n is one row
    return g.where(valid).select(patient, valid).unionByName(taken.select(patient, valid))


def one_each(df: DataFrame, patient: str, series: str, stratum: Column, n: int, arrangements: int, seed: str) -> DataFrame:
    """(patient, series, stratum, arrangement): n patients of each stratum (an aggregate), one drawn series each, the arrangements dealt in turn."""
    first = F.min(F.struct(draw(seed, series).alias("h"), F.col(series).alias("s")))
    g = df.groupBy(patient).agg(stratum.alias("stratum"), first.alias("x")).select(patient, F.col("x.s").alias(series), "stratum")
    k = F.row_number().over(W.partitionBy("stratum").orderBy(draw(seed, patient), patient))
    return g.withColumn("__k", k).where(F.col("__k") <= n).withColumn("arrangement", ((F.col("__k") - 1) % arrangements).cast("int")).drop("__k")


def pilot(df: DataFrame, document: str, span: str, label: str, quotas: dict[str, int], per_document: int, seed: int) -> DataFrame:
    """(document, span, label): quota spans of each label, rarest label first, always from the least loaded document, at most `per_document` of one.

    Every choice depends on those before, so the candidates' keys are collected;
    of a label only as many drawn spans a document as it may give, and of those no
    more than all quotas together and the document limit can ever need. More than
    PILOT_ROWS are an error, as is a quota that can't be met.
    """
    x = df.where(F.col(label).isin(list(quotas))).select(document, span, label, draw(str(seed), span).alias("__d"))
    x = x.withColumn("__d", F.sha1(F.concat_ws("|", F.lit(str(seed)), label, F.col(document).cast("string"), F.col(span).cast("string")).cast("binary")))
    sizes = {r[0]: r[1] for r in x.groupBy(label).count().collect()}  # one row a label
    near = F.row_number().over(W.partitionBy(label, document).orderBy("__d"))
    rows = x.withColumn("__k", near).where(F.col("__k") <= per_document).drop("__k").limit(PILOT_ROWS + 1).collect()
    if len(rows) > PILOT_ROWS:
        raise ValueError(f"more than {PILOT_ROWS} candidates for a pilot")
    load: dict = {}
    out = []
    for name in sorted(quotas, key=lambda k: (sizes.get(k, 0), k)):
        waiting = sorted((r["__d"], r[0], r[1]) for r in rows if r[2] == name)
        for _ in range(quotas[name]):
            best = min(((load.get(c[1], 0), c) for c in waiting if load.get(c[1], 0) < per_document), default=None)
            if best is None:
                raise ValueError(f"the quota of {name!r} can't be met")
            waiting.remove(best[1])
            load[best[1][1]] = best[0] + 1
            out.append((best[1][1], best[1][2], name))
    return df.sparkSession.createDataFrame(out, df.select(document, span, label).schema)
