import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from skein.llm import packing


def plain_best_fit(lengths, window):
    rooms, out = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fit = [(r, w) for w, r in enumerate(rooms) if r >= lengths[i]]
        if fit:
            w = min(fit)[1]
        else:
            rooms.append(window)
            w = len(rooms) - 1
        rooms[w] -= lengths[i]
        out[i] = rooms[w]
    return len(rooms), sorted(rooms)


def test_tree_finds_the_tightest_window():
    rng = np.random.default_rng(1)
    for window, n in ((1, 5), (7, 40), (64, 300), (2048, 300)):
        lengths = rng.integers(1, window + 1, n)
        at, offset, k = packing.best_fit_decreasing(lengths, window)
        used = np.bincount(at, lengths, minlength=k)
        assert (k, sorted(window - used)) == plain_best_fit(lengths.tolist(), window)


def check_rows(rows, docs, window=2048):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: tok.encode(t or "", add_special_tokens=False).ids + [1] for d, t in docs.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
    for d, x in ids.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(x)
    for x in by_seq.values():
        at = 0
        for r in sorted(x, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return sum(map(len, ids.values())) / (window * len(by_seq))


def test_query_covers_every_id_once(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check_rows(packing.op9_packing(spark, sf).collect(), docs) > 0.98


def test_little_padding_for_any_partitioning(spark, sf):
    docs = spark.read.parquet(f"{sf.rsplit('/', 1)[0]}/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for n in (1, 64, 211):
        assert check_rows(packing.pack(docs.repartition(n), public_tokenizers.path("word_bpe_49k.json")).collect(), texts) > 0.99


def test_edge_rows(spark):
    long = "the cat sat " * 3000
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, long, 0), (4, "it's <|endoftext|> ok", 0)], "doc_id long, text string, offset int")
    check_rows(packing.pack(df, public_tokenizers.path("word_bpe_49k.json")).collect(), {1: None, 2: "", 3: long, 4: "it's <|endoftext|> ok"})
    assert packing.pack(df.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0
    null = spark.createDataFrame([(None, "a b"), (5, "a b"), (5, "a b")], "doc_id long, text string")
    assert [r.doc_id for r in packing.pack(null, public_tokenizers.path("word_bpe_49k.json"), group=1).collect()].count(5) == 2
