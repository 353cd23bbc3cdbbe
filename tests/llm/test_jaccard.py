import random
import re

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import components as components_module
from skein.llm import jaccard
from skein.llm.components import components


def plain_sets(docs):
    out = {}
    for d, t in docs:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        out[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute(docs, percent=80):
    sets = plain_sets(docs)
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (len(sets[d]), find(d)) for d in ids}


def family(rng, n, words, edits, vocabulary=400):
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(words)]
    out = []
    for _ in range(n):
        x = list(base)
        for _ in range(rng.randint(0, edits)):
            x[rng.randrange(len(x))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(x))
    return out


def corpus(seed=5):
    rng = random.Random(seed)
    texts = [None, "", "  \t\n", "a", "A", "a b", "a b c d e", "A B C D E f", "x " * 500, "x " * 900, "É é É é É"]
    for n, words, edits in ((40, 60, 3), (25, 120, 8), (30, 30, 2), (15, 300, 20), (60, 12, 1), (10, 7, 1)):
        texts += family(rng, n, words, edits)
    passage = " ".join(f"p{i}" for i in range(50))
    texts += [f"{passage} " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += rng.choices(texts, k=40)
    rng.shuffle(texts)
    return list(enumerate(texts))


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_join_equals_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(jaccard.join(df)) == brute(docs)
    assert got(jaccard.join(df, percent=60)) == brute(docs, 60)


def test_small_parts_and_flushes_give_the_same(spark, monkeypatch):
    docs = corpus(6)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 700)
    monkeypatch.setattr(jaccard, "FLUSH", 500)
    assert got(jaccard.join(df)) == brute(docs)


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(jaccard.op5_jaccard(spark, sf)) == brute(docs)


def test_divide_skip_equals_counting():
    rng = random.Random(2)
    lists, sets = jaccard.Lists(), []
    for i in range(200):
        sets.append(set(rng.choices(range(60), [1 / (k + 1) for k in range(60)], k=15)))
        lists.add(i, sorted(sets[-1]))
    for t in range(1, 9):
        q = rng.sample(range(60), 14)
        assert lists.search(q, t) == [(i, len(s & set(q))) for i, s in enumerate(sets) if len(s & set(q)) >= t]


def test_edge_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (9, None)], "doc_id long, text string").selectExpr("*", "1 as n", "2 as fp", "3 as component_id")
    assert sorted(map(tuple, jaccard.join(df).collect()), key=str) == sorted([(None, 2, None), (4, 2, 2), (4, 2, 2), (2, 2, 2), (9, 0, 9)], key=str)
    assert jaccard.join(df.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [1, 30, 500_000])
def test_components_of_a_chain(spark, monkeypatch, bound):
    monkeypatch.setattr(components_module, "CONTRACTED", bound)
    df = spark.range(60).selectExpr("id as a", "id + 1 as b").union(spark.range(100, 103).selectExpr("id as a", "id as b")).union(spark.range(5).selectExpr("200 as a", "201 + id as b"))
    found = {r.node: r.component for r in components(df).collect()}
    assert found == {i: 0 for i in range(61)} | {i: 200 for i in range(200, 206)}


def test_shingles_of_short_texts_differ():
    sets = jaccard.shingle_sets(pa.array(["a b", "a b", "b a", "ab", ""], pa.large_string()))
    assert sets[0] == sets[1] and len({int(x[0]) for x in sets[:4]}) == 3 and len(sets[4]) == 0
    assert np.all(np.diff(jaccard.shingle_sets(pa.array(["q w e r t y " * 9], pa.large_string()))[0].astype(float)) > 0)


def brute_links(docs, percent=80):
    sets = plain_sets(docs)
    return {a: sum(a != b and bool(x and y) and 100 * len(x & y) >= percent * len(x | y) for b, y in sets.items()) for a, x in sets.items()}


@pytest.mark.parametrize("bound", [700, 2_000_000])
def test_link_counts_equal_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", bound)
    docs = corpus(7)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = jaccard.join(df, count_links=True).collect()
    assert {r.doc_id: r.n_links for r in rows} == brute_links(docs) and max(r.n_links for r in rows) > 20
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(docs)


def test_query_counts_links(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: r.n_links for r in jaccard.op5_jaccard(spark, sf).collect()} == brute_links(docs)


def test_link_counts_of_repeated_and_nameless_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (9, None)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_links) for r in jaccard.join(df, count_links=True).collect()), key=str) == sorted([(None, None), (4, 1), (4, 1), (2, 1), (9, 0)], key=str)
