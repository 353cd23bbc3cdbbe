import zlib

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import quality, toxicity
from skein.session import table


def auc(y, p):
    order = np.argsort(p, kind="stable")
    _, back, n = np.unique(p[order], return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[back]
    pos = y[order] == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize("query, label, folds, held, least", [(toxicity.op8_toxicity, "toxic", 5, 0, 0.95), (quality.op7_quality, "quality", 3, 1, 0.99)])
def test_held_out_accuracy(spark, query, label, folds, held, least):
    sf = "/root/testdata/sf0.1"
    rows = query(spark, sf).collect()
    labels = {r.doc_id: r[label] for r in table(spark, sf, "labels").collect()}
    assert len(rows) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    test = [(labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    y, p = map(np.array, zip(*test))
    assert auc(y, p) > least and ((p >= 0.5) == y).mean() > 0.96


EDGES = [(None, "some text"), (1, None), (2, ""), (3, "x" * 200_000), (4, "You idiot.\nFine day!"), (4, "You idiot.\nFine day!")]


def test_edge_rows(spark):
    df = spark.createDataFrame([(*r, "l", 1) for r in EDGES], "doc_id long, text string, label string, sentences int")
    model = toxicity.Model({b"=idiot": 9.0}, -5.0)
    got = toxicity.locate(df, model).collect()
    assert [len(r.sentences) for r in got] == [0, 0, 0, 0, 1, 1]
    assert all(EDGES[4][1][s.start : s.end] == "You idiot" for s in got[5].sentences)
    assert [r.score for r in got][1:3] == [0, 0]
    forest = quality.fit(np.zeros((0, len(quality.STATISTICS))), np.zeros(0))
    assert [r.score for r in quality.score(df, forest).collect()] == [0.5] * 6
    assert toxicity.score(df.limit(0), model).count() == quality.score(df.limit(0), forest).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(df, none).weights == {} and quality.train(df, none).depth == 0
    some = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(df, toxicity.train(df, some)).count() == quality.score(df, quality.train(df, some)).count() == 6


def test_noisy_or_equals_the_plain_product():
    text = np.array([0, 0, 2])
    p = np.array([0.5, 0.2, 0.9])
    assert np.allclose(toxicity.noisy_or(p, text, 3), [1 - 0.5 * 0.8, 0, 0.9])


def test_flattened_trees_equal_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < 0)).astype(float)
    f = quality.fit(x, y, 20)
    for row in x[:50]:
        total = f.base
        for at in f.roots:
            while f.left[at] != at:
                at = f.left[at] if row[f.feature[at]] <= f.threshold[at] else f.right[at]
            total += f.value[at]
        assert abs(total - f.margin(row[None])[0]) < 1e-9
    assert ((f.score(x) >= 0.5) == y).mean() > 0.95


def test_statistics_of_a_small_text():
    x = dict(zip(quality.STATISTICS, quality.statistics(pa.array(["AB ab\nab ab!\n\n", ""], pa.large_string()))[0]))
    assert x["share_upper"] == 2 / 14 and x["words_distinct"] == 3 / 4 and x["word_most"] == 2 / 4 and x["lines_distinct"] == 1 and x["words_shouted"] == 1 / 4


def held_out_recall(spark, sf):
    """Per language, the toxic documents found and all of them, each document scored by a model that didn't learn from it."""
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    found, clean = {}, []
    for fold in range(toxicity.FOLDS):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(toxicity, "HELD", fold)
            model = toxicity.train(docs, labels)
        assert model.weights
        for r in toxicity.score(docs, model).select("doc_id", "lang", "score").collect():
            if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % toxicity.FOLDS == fold:
                if truth[r.doc_id]:
                    found.setdefault("en" if r.lang == "en" else "other", []).append(r.score >= 0.5)
                else:
                    clean.append(r.score >= 0.5)
    return {k: (sum(v), len(v)) for k, v in found.items()}, sum(clean) / len(clean)


def test_toxicity_with_few_labels(spark):
    found, wrong = held_out_recall(spark, "/root/testdata/sf0.01")
    print(found, wrong)
    assert found["en"][0] >= 30 and found["other"][0] >= 6 and wrong < 0.02
    found, wrong = held_out_recall(spark, "/root/testdata/sf0.001")
    print(found, wrong)
    assert found["en"][0] >= 2 and wrong < 0.05
