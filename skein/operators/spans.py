"""One-to-one matching of gold and system spans, and what it scores.

Both sides have the key columns, `id` (which orders each side), `s` and `e` (end
exclusive). The result has the keys, `id` of the gold span and `t_id` of its
system span: a missed gold span has a null `t_id`, an extra system span a null
`id`. A null in a key, `s` or `e` matches nothing. Other columns are ignored;
empty sides give the spans of the other one, unmatched.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import f1, ratio
from ..session import ship, width
from .joins import occurrence


def match_equal(gold: DataFrame, system: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs spans of the same place: the n-th gold span there with the n-th system span."""
    place = [*keys, "s", "e"]
    a = occurrence(gold.select(*place, "id"), place, ["id"])
    b = occurrence(system.select(*place, F.col("id").alias("t_id")), place, ["t_id"])
    return a.join(b, [*place, "nth"], "full").select(*keys, "id", "t_id")


def match_overlapping(gold: DataFrame, system: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gives each gold span, in order, the first free system span of its keys that overlaps it.

    Greedy choice is sequential, but only among spans that a chain of overlaps
    connects; each such island is matched by itself, so a large key is split. To
    find its islands the spans of one key are sorted in one task, which can spill.
    """
    sides = [df.select(*keys, F.col("id").cast("long").alias("id"), F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), F.lit(n).alias("side")) for df, n in ((gold, 0), (system, 1))]
    every = sides[0].unionByName(sides[1])
    whole = F.lit(True)
    for c in (*keys, "s", "e"):
        whole = whole & F.col(c).isNotNull()
    order = W.partitionBy(*keys).orderBy("s", "e", "side", "id")
    reach = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = every.where(whole).withColumn("reach", reach).withColumn("island", F.sum(F.when(F.col("s") < F.col("reach"), 0).otherwise(1)).over(order)).drop("reach")
    kinds = dict(every.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "id bigint", "t_id bigint"])
    wide = len(keys)

    def greedy(batches):
        types, rows, now, gold_side, free = None, [], None, [], []

        def done():
            for i, s, e in gold_side:
                at = next((n for n, (_, s2, e2) in enumerate(free) if s < e2 and s2 < e), None)
                rows.append((*now[:wide], i, None if at is None else free.pop(at)[0]))
            rows.extend((*now[:wide], None, i) for i, _, _ in free)

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], [*keys, "id", "t_id"])

        for batch in batches:
            types = [*(f.type for f in list(batch.schema)[:wide]), pa.int64(), pa.int64()]
            for *key, side, i, s, e in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    if now is not None:
                        done()
                    now, gold_side, free = key, [], []
                (free if side else gold_side).append((i, s, e))
            if rows:
                yield sent()
                rows.clear()
        if now is not None:
            done()
            yield sent()

    ship(gold.sparkSession)
    by_island = marked.select(*keys, "island", "side", "id", "s", "e").repartition(width(gold.sparkSession), *keys, "island")
    pairs = by_island.sortWithinPartitions(*keys, "island", "side", "id", "s", "e").mapInArrow(greedy, schema)
    alone = every.where(~whole)
    return pairs.unionByName(alone.select(*keys, F.when(F.col("side") == 0, F.col("id")).alias("id"), F.when(F.col("side") == 1, F.col("id")).alias("t_id")))


def span_scores(pairs: DataFrame, *by: str | Column) -> DataFrame:
    """tp, fn and fp of matched spans with precision, recall and F1, null where undefined."""
    got = pairs.groupBy(*by).agg(F.count_if(F.col("id").isNotNull() & F.col("t_id").isNotNull()).alias("tp"), F.count_if(F.col("t_id").isNull()).alias("fn"), F.count_if(F.col("id").isNull()).alias("fp"))
    tp, fn, fp = (F.col(c) for c in ("tp", "fn", "fp"))
    return got.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": f1(tp, fp, fn)})
