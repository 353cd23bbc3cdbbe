import hashlib
import tarfile
import zlib

from skein.llm import media
from skein.session import settled, shared_folder


def test_png_round_trip():
    for n in (1, 5, 40):
        x = bytes(range(192)) * n
        assert media.from_png(media.to_png(x)) == x
    assert media.payload(b"") == b" " * 192 and len(media.payload(b"x" * 192)) == 192 and len(media.payload(b"x" * 193)) == 384


def plain_feature(p):
    n, mean = len(p), sum(p) // len(p)
    var = (sum(x * x for x in p) * n - sum(p) ** 2) // (n * n)
    size = n // 64
    bits = "".join("1" if sum(p[i * size : (i + 1) * size if i < 63 else n]) * n >= sum(p) * size else "0" for i in range(64))
    return f"h={n // 192};mean={mean};var={var};ahash={int(bits, 2):016x}"


def test_query_equals_plain_digests(spark, sf):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = media.op3_media(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        p = media.payload(docs[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (len(docs[r.doc_id]), len(p))
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-16:])
        stored = media.to_png(p)
        assert (r.media_sha256, r.media_bytes) == (hashlib.sha256(stored).hexdigest(), len(stored))
        assert (r.width, r.height, r.depth, r.colour) == (64, len(p) // 192, 8, 2)
        assert r.feature == plain_feature(p)


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "long text " * 200_000)], "doc_id long, text string")
    (r,) = media.decoded(media.headers(settled(media.store(df, shared_folder(spark, "t")), "t"))).collect()
    assert r.n_bytes == 2_000_000 and r.height * 192 == r.payload_bytes and r.payload_sha256 == hashlib.sha256(media.payload(b"long text " * 200_000)).hexdigest()


def test_shards_headers_and_edge_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "ab" * 5000, 0), (3, "ab" * 5000, 0), (3, "é😀", 0)], "doc_id long, text string, offset int").coalesce(1)
    folder = shared_folder(spark, "t")
    index = settled(media.store(df, folder, shard_bytes=600), "t")
    rows = media.headers(index).collect()
    assert sorted(r.height for r in rows) == [1, 1, 1, 53, 53] and {r.width for r in rows} == {64}
    assert len({(r.shard, r.offset) for r in rows if r.height == 53}) == 1
    for uri in {r.shard for r in rows}:
        with tarfile.open(uri.removeprefix("file://")) as t:
            for m in t.getmembers():
                assert any(r.digest + ".png" == m.name and r.length == m.size and r.offset == m.offset_data for r in rows)
    assert media.decoded(media.headers(index)).count() == 5
    assert media.decoded(media.headers(settled(media.store(df.limit(0), folder), "t"))).count() == 0
