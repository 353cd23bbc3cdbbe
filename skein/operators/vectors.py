"""Measures of a column of vectors, and comparison of stated query vectors with all.

Query vectors are written to the shared folder and read by blocks in each task,
which multiplies them with its own vectors; nothing is broadcast and no pairs are
made. Scores are rounded to 9 decimals, ties go by id. Null vectors, and ids that
are null, are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder, ship
from ..shared import parquet_batches

#: Query vectors that are compared at once, and the cosine from which two vectors count as near copies.
QUERY_ROWS, NEAR_COPY = 1024, 0.9999


def participation(df: DataFrame, vector: str) -> DataFrame:
    """(n, participation): how many directions the vectors spread over evenly.

    With the singular values s of the centred vectors it is sum(s^2)^2 / sum(s^4),
    that is trace(C)^2 / |C|^2 of their covariance C, so nothing is decomposed.
    Tasks send one sum of products each, which are added by entry; the last
    step reads the square of the dimension. Null vectors are left out; no
    vectors, or equal ones, have no participation (null).
    """
    ship(df.sparkSession)

    def run(batches):
        products = None  # of the vectors with a 1 put before them, so the first row has the count and the sums
        for batch in batches:
            x = batch.column(0).drop_null()
            if len(x):
                m = np.asarray(x.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(x), -1)
                m = np.hstack([np.ones((len(m), 1)), m])
                products = m.T @ m + (0 if products is None else products)
        if products is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(products)), pa.int32()), pa.array(products.tolist(), pa.list_(pa.float64()))], ["i", "products"])

    parts = df.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "i int, products array<double>")
    sums = parts.select("i", F.posexplode("products").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    first = sums.where("j = 0").select("i", F.col("v").alias("a"))
    n = sums.where("i = 0 and j = 0").select(F.col("v").alias("n"))
    cells = sums.where("i > 0 and j > 0").join(first, "i").join(first.select(F.col("i").alias("j"), F.col("a").alias("b")), "j")
    # n is one row, so this join has a row for each cell
    c = cells.join(F.broadcast(n), F.lit(True)).select("i", "j", "n", (F.col("v") - F.col("a") * F.col("b") / F.col("n")).alias("c"))
    return c.agg(F.max("n").cast("long").alias("n"), (F.pow(F.sum(F.when(F.col("i") == F.col("j"), F.col("c"))), F.lit(2)) / F.nullif(F.sum(F.col("c") * F.col("c")), F.lit(0.0))).alias("participation"))


def _unit(column: pa.Array) -> np.ndarray:
    m = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _compared(rows: DataFrame, folder: str, start, step, out, schema: str) -> DataFrame:
    """Runs over all blocks of queries for each batch of rows (id, v, more) and yields what was gathered, once for each task and block."""

    def run(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            v, ids, more = _unit(batch.column(1)), batch.column(0).to_numpy(), [c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]
            for k, q in enumerate(parquet_batches(folder, QUERY_ROWS)):
                if q.num_rows:
                    if k not in held:
                        held[k] = q, _unit(q.column(1)), start(q.num_rows)
                    step(held[k][0], np.round(held[k][1] @ v.T, 9), ids, more, held[k][2])
        for q, _, state in held.values():
            yield out(q, state)

    return rows.mapInArrow(run, schema)


def pair_ranks(a: DataFrame, b: DataFrame, key: str, vector_a: str, vector_b: str, asked: Column) -> DataFrame:
    """(key, rank): for the rows of a that are asked for, the place of their own b among all b by cosine."""
    spark = a.sparkSession
    ship(spark)
    rows = b.where(F.col(key).isNotNull() & F.col(vector_b).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector_b).cast("array<double>").alias("w"))
    queries = a.where(asked & F.col(vector_a).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector_a).cast("array<double>").alias("v")).join(rows, "id")
    folder = shared_folder(spark, "vector-queries")
    queries.select("id", "v", "w").write.parquet(folder)

    def step(q, s, ids, more, count):
        own = np.round((_unit(q.column(1)) * _unit(q.column(2))).sum(1), 9)[:, None]
        count += ((s > own) | ((s == own) & (ids[None, :] < q.column(0).to_numpy()[:, None]))).sum(1)

    def out(q, count):
        return pa.RecordBatch.from_arrays([q.column(0), pa.array(count)], ["id", "n"])

    ahead = _compared(rows, folder, lambda n: np.zeros(n, np.int64), step, out, "id bigint, n bigint")
    return ahead.groupBy("id").agg((F.sum("n") + 1).alias("rank")).select(F.col("id").alias(key), "rank")


def retrieval_summary(ranks: DataFrame, rank: str = "rank", at: tuple[int, ...] = (1, 5, 10, 50)) -> DataFrame:
    """(n, R@k in per cent, MedR) of ranks."""
    return ranks.agg(F.count("*").alias("n"), *(F.avg(F.when(F.col(rank) <= k, 100.0).otherwise(0.0)).alias(f"r{k}") for k in at), F.median(rank).alias("med_r"))


def first_hit_ranks(df: DataFrame, key: str, vector: str, label: str, asked: Column) -> DataFrame:
    """(key, rank): for the rows asked for, the place of the nearest other row of their label among all others; none without one."""
    spark = df.sparkSession
    ship(spark)
    known = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    rows = known.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("long").alias("label"))
    folder = shared_folder(spark, "vector-queries")
    known.where(asked).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("long").alias("label")).write.parquet(folder)
    none = np.iinfo(np.int64).max

    def best_step(q, s, ids, more, state):
        hit = (more[0][None, :] == q.column(2).to_numpy()[:, None]) & (ids[None, :] != q.column(0).to_numpy()[:, None])
        s = np.where(hit, s, -np.inf)
        top = s.max(1)
        first = np.where(s == top[:, None], ids[None, :], none).min(1)
        better = (top > state[0]) | ((top == state[0]) & (first < state[1]))
        state[0][better], state[1][better] = top[better], first[better]

    def best_out(q, state):
        found = np.isfinite(state[0])
        return pa.RecordBatch.from_arrays([q.column(0).filter(pa.array(found)), pa.array(state[0][found]), pa.array(state[1][found])], ["id", "s", "t"])

    best = _compared(rows, folder, lambda n: [np.full(n, -np.inf), np.full(n, none)], best_step, best_out, "id bigint, s double, t bigint")
    best = best.groupBy("id").agg(F.max(F.struct("s", (-F.col("t")).alias("t"))).alias("x")).select("id", F.col("x.s").alias("s"), (-F.col("x.t")).alias("t"))
    second = shared_folder(spark, "vector-queries")
    spark.read.parquet(folder).select("id", "v").join(best, "id").select("id", "v", "s", "t").write.parquet(second)

    def step(q, s, ids, more, count):
        own, place = q.column(2).to_numpy()[:, None], q.column(3).to_numpy()[:, None]
        count += (((s > own) | ((s == own) & (ids[None, :] <= place))) & (ids[None, :] != q.column(0).to_numpy()[:, None])).sum(1)

    def out(q, count):
        return pa.RecordBatch.from_arrays([q.column(0), pa.array(count)], ["id", "n"])

    ahead = _compared(rows, second, lambda n: np.zeros(n, np.int64), step, out, "id bigint, n bigint")
    return ahead.groupBy("id").agg(F.sum("n").alias("rank")).select(F.col("id").alias(key), "rank")


def near_copies(df: DataFrame, key: str, vector: str, asked: Column, least: float = NEAR_COPY) -> DataFrame:
    """(asked, with_copy): how many of the rows asked for have another row at that cosine or more."""
    spark = df.sparkSession
    ship(spark)
    known = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    rows = known.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    folder = shared_folder(spark, "vector-queries")
    known.where(asked).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).write.parquet(folder)

    def step(q, s, ids, more, found):
        found |= ((s >= least) & (ids[None, :] != q.column(0).to_numpy()[:, None])).any(1)

    def out(q, found):
        return pa.RecordBatch.from_arrays([q.column(0), pa.array(found.astype(np.int64))], ["id", "n"])

    seen = _compared(rows, folder, lambda n: np.zeros(n, bool), step, out, "id bigint, n bigint")
    per = seen.groupBy("id").agg(F.max("n").alias("n"))
    return per.agg(F.count("*").alias("asked"), F.coalesce(F.sum("n"), F.lit(0)).alias("with_copy"))
