import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from skein.llm import idfile
from skein.session import settled, shared_folder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_elias_fano_round_trip_and_space():
    rng = np.random.default_rng(3)
    for n, most in ((0, 1), (1, 0), (1, 10**12), (700, 3), (5000, 10**6), (3000, 2**40)):
        x = np.sort(rng.integers(0, most + 1, n))
        code = idfile.EliasFano.of(x)
        again, size = idfile.EliasFano.from_bytes(code.to_bytes() + b"more")
        assert size == len(code.to_bytes()) and (again.select(0, n) == x).all()
        assert [int(again.select(k)[0]) for k in range(0, n, 7)] == x[::7].tolist()
        for _ in range(50):
            a, b = sorted(rng.integers(0, n + 1, 2))
            assert (again.select(a, b) == x[a:b]).all()
    assert len(code.to_bytes()) * 8 / n < 2 + 31 + 2


def expected(docs):
    tok, out, at = Tokenizer.from_file(VOCABULARY), [], 0
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_equals_plain_encoding(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, idfile.op4_token_ids(spark, sf).collect())) == expected(docs)


def test_repeated_negative_and_extreme_ids(spark):
    docs = [(5, f"w{i}") for i in range(50)] + [(-(1 << 63), "a"), (-3, "b c"), ((1 << 63) - 1, "d"), (None, "e"), (None, None), (0, "f " * 50_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, idfile.read(settled(idfile.write(df, VOCABULARY, shared_folder(spark, "t"), shard_ids=7), "t")).collect()), key=lambda r: r[1])
    at = 0
    for r in got:
        assert r[1] == at
        at += r[2]
    assert [r[0] for r in got] == [d for d, _ in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0))]
    assert sorted((str(d), n, c) for d, _, n, c in got) == sorted((str(d), n, c) for d, _, n, c in expected([(d, t) for d, t in docs if d is not None or t] + [(None, None)]))


def test_edge_rows_and_single_documents(spark):
    docs = [(7, "b c"), (None, None), (3, ""), (9, "it's " * 4000), (12, "x y z")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, uri int")
    manifest = settled(idfile.write(df, VOCABULARY, shared_folder(spark, "t"), shard_ids=10), "t")
    assert sorted(map(tuple, idfile.read(manifest).collect()), key=lambda r: r[1]) == expected(docs)
    for r in manifest.collect():
        shard = idfile.Shard(r.uri)
        assert sum(len(shard.ids(k)) for k in range(shard.n_docs)) == r.n_ids
        assert b"".join(shard.keys(k, k + 1).to_string().encode() for k in range(shard.n_docs)).count(b"null") == shard.nulls
    empty = settled(idfile.write(df.limit(0), VOCABULARY, shared_folder(spark, "t")), "t")
    assert idfile.read(empty).count() == 0
