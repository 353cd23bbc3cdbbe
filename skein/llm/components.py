"""Connected components by local contraction, then large-star and small-star steps.

Edges are first dealt to partitions of a bounded size, in each of which a union-
find replaces them by stars; where one such partition holds all edges, that is
the result. Stars of several partitions are joined by alternating steps after
Kiveris et al., Connected Components in MapReduce and Beyond (2014). Each step is an aggregation and a join, so a node with very many neighbours is pre-
aggregated and its join can be split; the edges of each round are written to the
shared folder, so lineage stays short and nothing but counts reaches the driver.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled, ship

#: Edges that one task contracts, about.
CONTRACTED = 500_000


def _nearest(e: DataFrame) -> DataFrame:
    return e.groupBy("u").agg(F.min("v").alias("m"))


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """(u, v): per partition each node tied to the smallest node that its partition's edges connect it with."""

    def run(batches):
        root: dict[int, int] = {}

        def find(x):
            top = x
            while (up := root.setdefault(top, top)) != top:
                top = up
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(u), find(v)
                if a != b:
                    root[max(a, b)] = min(a, b)
        pairs = [(x, find(x)) for x in list(root) if find(x) != x]
        for k in range(0, len(pairs), 50_000):
            u, v = zip(*pairs[k : k + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return edges.repartition(parts).mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); the component is its smallest node.

    Loops and repeated edges don't matter; edges with a null end are ignored.
    """
    ship(edges.sparkSession)
    e = settled(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")), "edges")
    parts = -(-e.count() // CONTRACTED) or 1
    e = settled(_contracted(e, parts), "edges")
    before = None
    while parts > 1:
        count, digest = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (count, digest) == before:
            break
        before = count, digest
        # large star: every greater neighbour of u is tied to the smallest of u and its neighbours
        both = e.union(e.select("v", "u").toDF("u", "v"))
        large = both.join(_nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # small star: u and its smaller neighbours are tied to the smallest of them
        tied = large.join(_nearest(large), "u")
        small = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(tied.select("u", F.col("m").alias("v"))).distinct()
        e = settled(small, "edges")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
