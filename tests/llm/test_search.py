import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from skein.llm import search


def brute(docs, queries, k=10):
    bags = [(d, Counter(re.findall(r"[^\W_]+", t.lower()))) for d, t in docs if d is not None for t in [t or ""]]
    n = len(bags)
    mean = sum(sum(b.values()) for _, b in bags) / n
    df = Counter(w for _, b in bags for w in b)
    out = []
    for q, t in queries:
        words = set(re.findall(r"[^\W_]+", (t or "").lower()))
        scored = []
        for d, b in bags:
            size = sum(b.values())
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w in words if w in b)
            if s:
                scored.append((-round(s, 6), d))
        out += [(q, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def close(got, want):
    # the last decimal of a score depends on the order of the sum
    assert [x[:3] for x in got] == [x[:3] for x in want] or all(abs(a[3] - b[3]) < 3e-6 and a[:2] == b[:2] for a, b in zip(got, want, strict=True))
    assert all(abs(a[3] - b[3]) < 3e-6 for a, b in zip(got, want, strict=True))


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, search.op6_search(spark, sf).collect()))
    close(got, brute(docs, [x for x in docs if x[0] % 50 == 0]))


def test_many_shards_and_pruning(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(300)], k=rng.randint(1, 60)))) for i in range(1500)]
    docs += [(1500 + i, docs[i][1]) for i in range(40)] + [(1600, None), (1601, ""), (None, "w1 w2"), (1620, " ".join(rng.choices(words, k=30_000)))]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int").repartition(5)
    monkeypatch.setattr(search, "SHARD_BYTES", 9000)
    monkeypatch.setattr(search, "SEED_SHARE", 8)
    monkeypatch.setattr(search, "BLOCK_BITS", 4)
    monkeypatch.setattr(search, "TILE_ROWS", 3)
    monkeypatch.setattr(search, "SHARD_DOCS", 100)
    monkeypatch.setattr(search, "TABLE_CELLS", 2000)
    monkeypatch.setattr(search, "QUERY_ROWS", 16)
    queries = [x for x in docs if x[0] is not None and x[0] % 20 == 0] + [(5000, "nothing here"), (5001, None)]
    q = spark.createDataFrame(queries, "query_id long, text string")
    close(sorted(map(tuple, search.top_k(df, q, 7).collect())), brute(docs, queries, 7))
    assert search.top_k(df.limit(0), q).count() == 0 and search.top_k(df, q.limit(0)).count() == 0


def test_blocks_that_no_query_of_a_tile_needs():
    rng = random.Random(8)
    docs = [" ".join(rng.choices([f"{kind}{i}" for i in range(30)], k=12)) for kind in "ab" for _ in range(200)]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(search, "BLOCK_BITS", 3)
        m.setattr(search, "TABLE_SHARE", 100)
        shard = search.Shard.of(np.arange(400), pa.array(docs, pa.large_string()), 12.0)
        assert len(shard.table) > 20
        place = {w.decode(): i for i, w in enumerate(shard.terms.to_pylist())}
        asked = [(np.array([place[w] for w in sorted(set(docs[i].split()))]), np.ones(len(set(docs[i].split()))), least) for i in (0, 250, 3, 399) for least in (0.0, 4.0, 9.0)]
        every = shard.search([(t, w, 0.0) for t, w, _ in asked], 400)
        assert [x[:5] for x in every] == [[y for y in x][:5] for x in shard.search([(t, w, 0.0) for t, w, _ in asked], 5)]
        for whole, (t, w, least), got in zip(every, asked, shard.search(asked, 5)):
            assert got == [x for x in whole if x[0] >= least - search.SLACK][:5]
            counts = {i: sum(1 for v in t.tolist() if shard.terms[v].as_py().decode() in docs[i].split()) for _, i in got}
            assert all(counts.values())
            assert shard.search([(t, w, least)], 5) == [got]  # alone, blocks of the other kind are needed by none


def test_blocks_and_numbers_without_gaps(tmp_path):
    rng = random.Random(3)
    docs = [" ".join(rng.choices([f"{kind}{i}" for i in range(40)], k=rng.randint(1, 30))) for kind in "abc" for _ in range(150)]
    shard = search.Shard.of(np.arange(450), pa.array(docs, pa.large_string()), 12.0)
    assert shard.edges[0] == 0 and shard.edges[-1] == 450 and (np.diff(shard.edges) > 0).all()
    assert search._edges(np.array([5000, 0, 3])).tolist() == [0, 1000, 2000, 3000, 4000, 5000, 5003]
    # the queries' terms lie in several files, numbered from each file's start
    asked = [*sorted({w for d in docs for w in d.split()}), "nowhere"]
    for part, names in enumerate((asked[:50], asked[50:])):
        cols = {"term": pa.array([w.encode() for w in names]), "weight": pa.array([float(part * 50 + i) for i in range(len(names))]), "at": pa.array([(part << 33) + i for i in range(len(names))])}
        pq.write_table(pa.table(cols), f"{tmp_path}/part-{part}.parquet", row_group_size=7)
    vocabulary = search.Vocabulary(f"file://{tmp_path}", [0, 50, len(asked)])
    assert vocabulary.weights.tolist() == list(range(len(asked)))
    assert [shard.terms[i].as_py().decode() for i in vocabulary.places(shard)[:-1].tolist()] == asked[:-1]
    assert vocabulary.places(shard)[-1] == -1


def test_copies_give_thresholds(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(rng.choices(words, k=rng.randint(3, 20))) for _ in range(60)]
    docs = [(i, texts[i % 60]) for i in range(60 * 4)] + [(300, texts[1] + " " + " ".join(words)), (301, texts[0].upper()), (None, texts[5]), (310, None), (7, texts[9])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    # one id with two texts, two ids with the same terms, one that is found nowhere
    queries = [(i, texts[i]) for i in range(8)] + [(20, " ".join(reversed(texts[2].split()))), (21, texts[3] + " nowhere"), (22, texts[4]), (22, texts[6])]
    q = spark.createDataFrame(queries, "query_id long, text string")
    assert {r.query_id for r in search.copied(df, q, 4).collect()} == {*range(8)}
    assert {r.query_id for r in search.copied(df, q, 5).collect()} == set()
    files, ranked = [], search._ranked
    monkeypatch.setattr(search, "_ranked", lambda docs, folder, *rest: files.append(folder) or ranked(docs, folder, *rest))
    got = sorted(map(tuple, search.top_k(df, q, 4).collect()))
    close(got, brute(docs, [*queries[:10], (22, texts[4] + " " + texts[6])], 4))
    for at in files:  # thresholds stand before the first round, too; query 20 goes with 2
        least = {r.query_id: r.least for r in spark.read.parquet(at).collect()}
        own = {a: s for a, _, d, s in got if a == d}
        assert 20 not in least and all(0 < own[i] - least[i] < 1e-4 or least[i] >= own[i] for i in range(8) if i in own)
