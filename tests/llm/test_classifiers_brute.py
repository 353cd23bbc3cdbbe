"""Both classifier queries against versions in plain Python: statistics, trees, sentences and noisy-or."""

import math
import re
from collections import Counter

import pytest

from skein.llm import quality, toxicity
from skein.llm.labelled import sample
from skein.session import table

BLANK = "[\x20\x09-\x0d]+"


def plain_statistics(text):
    data = (text or "").encode()
    size = len(data)
    upper = set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    letter = upper | set(b"abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
    digit, stop, point, blank = set(b"0123456789"), set(b".!?"), set(b".,;:'\"()-!?"), {0x20, *range(0x09, 0x0E)}
    mark = set(range(256)) - letter - digit - point - blank
    classes = [upper, letter, set(range(0x80, 0x100)), digit, stop, point, mark, blank, {0x0A}, {0x7C}, {0x21}]
    share = lambda a, b: a / b if b else 0.0
    words = [w for w in re.split(BLANK.encode(), data) if w]
    n, sizes = len(words), list(map(len, words))
    mean = share(sum(sizes), n)
    counts, pairs = Counter(words), Counter(zip(words, words[1:]))
    lines = [x for x in data.split(b"\n") if x]
    again, seen, many = 0, set(), Counter(lines)
    for x in lines:
        again += len(x) if x in seen and many[x] > 1 else 0
        seen.add(x)
    shouted = lambda w: sum(c in letter for c in w) > 1 and all(c in upper for c in w if c in letter)
    return [
        *(share(sum(c in s for c in data), size) for s in classes), math.log1p(size), math.log1p(n), mean, math.sqrt(max(0, share(sum(x * x for x in sizes), n) - mean * mean)), math.log1p(max(sizes, default=0)),
        share(sum(not any(c in letter for c in w) for w in words), n), share(sum(any(c in mark for c in w) for w in words), n), share(sum(map(shouted, words)), n),
        share(len(counts), n), share(max(counts.values(), default=0), n), math.log(max(n, 1)) - share(sum(c * math.log(c) for c in counts.values()), n), share(len(pairs), max(n - 1, 0)), share(max(pairs.values(), default=0), max(n - 1, 0)),
        share(sum(map(len, lines)), len(lines)), share(len(many), len(lines)), share(again, size), share(max(many.values(), default=0), len(lines)),
    ]


def test_quality_query_is_the_forest_over_plain_statistics(spark, sf):
    docs = table(spark, sf, "documents")
    forest = quality.train(docs, table(spark, sf, "labels"))
    got = {r.doc_id: r.score for r in quality.op7_quality(spark, sf).collect()}
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(got) == len(texts) and len({round(x, 6) for x in got.values()}) > 20
    for doc, text in texts:
        x = plain_statistics(text)
        total = forest.base
        for at in forest.roots:
            while forest.left[at] != at:
                gap = x[forest.feature[at]] - forest.threshold[at]
                # at a threshold the last bits of the two sums decide
                at = forest.left[at] if gap <= 1e-12 else forest.right[at]
            total += forest.value[at]
        assert got[doc] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9), doc


def test_toxicity_query_is_noisy_or_over_plain_sentences(spark, sf):
    docs = table(spark, sf, "documents")
    model = toxicity.train(docs, table(spark, sf, "labels"))
    got = {r.doc_id: r for r in toxicity.op8_toxicity(spark, sf).collect()}
    assert model.weights
    for r in docs.collect():
        left, offending = 1.0, 0
        for sentence in re.split(r"[.!?\n]", (r.text or "").lower()):
            words = re.findall(r"[0-9a-z\x80-῿₀-\U0010ffff]+", sentence)
            if words:
                z = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in toxicity.features(w.encode()))
                p = 1 / (1 + math.exp(-max(-40, min(40, z))))
                left *= 1 - min(p, 1 - 1e-9)
                offending += p >= 0.5
        assert got[r.doc_id].score == pytest.approx(1 - left, abs=1e-9) and got[r.doc_id].n_offending == offending


def test_sample_is_bounded_with_repeated_rows(spark):
    docs = spark.createDataFrame([(i % 5, f"t{i}") for i in range(400)] + [(9, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(10)] * 3, "doc_id long, y int")
    rows = sample(docs, labels, "y", 3, -2, {1: 4}).collect()
    assert len({r.doc_id for r in rows}) == len(rows) <= 4
    assert all(r.text == min(f"t{i}" for i in range(400) if i % 5 == r.doc_id) for r in rows if r.doc_id < 5)
