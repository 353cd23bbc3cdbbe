import random

import numpy as np
from pyspark.sql import functions as F

from skein.operators import probe, spans, vectors
from skein.text.lexicon import Concept, Lexicon, union_matcher
from skein.text.mentions import concept_sets

SPAN = "g long, concept string, id long, s long, e long"


def greedy(gold, system, strict):
    out = []
    for k in {r[:2] for r in gold + system}:
        left = sorted(r for r in system if r[:2] == k)
        for a in sorted(r for r in gold if r[:2] == k):
            whole = None not in a
            fits = [b for b in left if whole and None not in b and (a[3:] == b[3:] if strict else a[3] < b[4] and b[3] < a[4])]
            if fits:
                left.remove(fits[0])
            out.append((*k, a[2], fits[0][2] if fits else None))
        out += [(*k, None, b[2]) for b in left]
    return sorted(out, key=str)


def some_spans(rng, n):
    out = []
    for i in range(n):
        s = rng.randrange(60)
        out.append((rng.choice([1, 1, 1, 2]), rng.choice(["a", "b", None]), i, s, rng.choice([None, *[s + k for k in range(9)]])))
    return out


def test_matching_equals_the_plain_loop(spark):
    rng = random.Random(3)
    gold, system = some_spans(rng, 90), some_spans(rng, 80)
    a, b = spark.createDataFrame(gold, SPAN), spark.createDataFrame(system, SPAN).withColumn("island", F.lit(1))
    keys = ["g", "concept"]
    for f, strict in ((spans.match_equal, True), (spans.match_overlapping, False)):
        got = f(a, b, keys)
        assert got.columns == [*keys, "id", "t_id"]
        assert sorted(map(tuple, got.collect()), key=str) == greedy(gold, system, strict)
        assert f(a, b.limit(0), keys).where("t_id is null").count() == len(gold)
        assert f(a.limit(0), b.limit(0), keys).count() == 0


def test_first_free_span_is_taken(spark):
    a = spark.createDataFrame([(1, "a", 1, 0, 10), (1, "a", 2, 0, 3)], SPAN)
    b = spark.createDataFrame([(1, "a", 7, 1, 2), (1, "a", 8, 8, 9)], SPAN)
    pairs = spans.match_overlapping(a, b, ["g", "concept"])
    assert {(r.id, r.t_id) for r in pairs.collect()} == {(1, 7), (2, None), (None, 8)}
    assert spans.span_scores(pairs).first()[:3] == (1, 1, 1)


def plain_probe(x, y, z, c=1.0):
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd == 0, 1, sd)
    a, b = np.c_[(x - mean) / sd, np.ones(len(x))], np.c_[(z - mean) / sd, np.ones(len(z))]
    w = c * np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    ridge = np.diag([*[1.0] * x.shape[1], 0.0])
    t = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ t))
        t -= np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (w * (p - y)) + ridge @ t)
    return 1 / (1 + np.exp(-b @ t))


def test_probe_equals_newton_steps(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 4)) * [1, 5, 0.2, 0] + 3
    y = (x[:, 0] + rng.normal(size=120) > 3.6).astype(int)
    fold = rng.integers(0, 3, 120)
    rows = [(i, x[i].tolist(), int(y[i]), int(fold[i])) for i in range(120)] + [(200, None, 1, 0), (201, x[0].tolist(), 1, None), (202, x[0].tolist(), 0, 9)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int, fold int")
    got = {r.id: r.score for r in probe.out_of_fold(df, "v", "y", "fold", 3).collect()}
    assert len(got) == 123 and got[200] is got[201] is got[202] is None
    for k in range(3):
        want = plain_probe(x[fold != k], y[fold != k], x[fold == k])
        assert np.allclose([got[i] for i in np.flatnonzero(fold == k)], want, atol=1e-4)
    assert probe.fit(df.where("y = 1"), "v", "y") is None
    assert {r.score for r in probe.out_of_fold(df.where("y = 1"), "v", "y", "fold", 3).collect()} == {None}


def test_threshold_at_equal_load_and_held_out(spark):
    df = spark.createDataFrame([(i / 10, i % 2) for i in range(11)], "score double, y int")
    at = probe.threshold_at_load(df, 0.25)
    assert abs(at - np.quantile(np.arange(11) / 10, 0.75)) < 1e-12
    assert tuple(probe.held_out(df, at, "y").first()) == (1, 4, 2)
    assert tuple(probe.held_out(df, None, "y").first()) == (0, 5, 0)


def test_groups_stay_in_one_fold(spark):
    x = spark.range(500).select((F.col("id") % 50).alias("g")).withColumn("fold", probe.grouped_fold(F.col("g")))
    assert x.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert {r.fold for r in x.select("fold").distinct().collect()} == set(range(5))


def test_participation_equals_singular_values(spark):
    m = np.random.default_rng(5).normal(size=(70, 6)) * [1, 2, 3, 0.1, 1, 5] + 4
    df = spark.createDataFrame([(x,) for x in m.tolist()] + [(None,)], "v array<double>").repartition(3)
    s = np.linalg.svd(m - m.mean(0), compute_uv=False)
    got = vectors.participation(df, "v").first()
    assert got.n == 70 and abs(got.participation - (s**2).sum() ** 2 / (s**4).sum()) < 1e-9
    assert vectors.participation(df.limit(0), "v").first().participation is None


def test_surfaces_without_right_boundary(spark):
    concepts = [Concept("nodule", "observation", ("nod[uü]l",)), Concept("ectasia", "observation", ("ektazi",)), Concept("note", "observation", (r"\(bkz",))]
    got = spark.createDataFrame([("Nodulde atelektazi",), ("noduler ektazi nodül",), (None,), ("",), ("bu (bkz. tablo)",)], "t string").select(concept_sets(Lexicon(concepts))("t").alias("c")).collect()
    assert [r.c for r in got] == [["nodule"], ["ectasia", "nodule"], [], [], ["note"]]
    assert not union_matcher(concepts[:1])[0].search("noduler")
