import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from skein.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  two  spaces ", "a\tb\nc d", "日本語 ½ 😀 é́", "<s> </s> <0x0A> <unk>", "▁ mark ▁▁x", "x" * 3000, "in\x00side", "The quick brown fox's 12,345.67!!", "\n\n\n", "a" + " " * 40 + "b", "ﬁ Å ① ㎒"]


def test_parity_and_decoding_on_hard_texts():
    m, judge = pieces.load(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert m.by_word
    ids, off = m.encode(pa.array(TEXTS, pa.large_string()))
    for i, t in enumerate(TEXTS):
        got = ids[off[i] : off[i + 1]]
        assert got.tolist() == judge.encode(t), t
        if "▁" not in t:
            assert m.decode(got) == t
        assert m.tok.encode(t, add_special_tokens=False).ids == judge.encode(t), t
        assert m.tok.decode(got.tolist(), skip_special_tokens=False) == m.decode(got)


def test_query_equals_the_library(spark, sf):
    judge = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pieces.op2_pieces(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = judge.encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and r.parity and r.round_trip


def unigram(normaliser=b"\x18\x01\x20\x00\x28\x01", trainer=b"", more=()):
    """A small unigram model with byte fallback."""

    def message(*parts):
        return b"".join(parts)

    def number(n):
        out = b""
        while n > 0x7F:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])

    def part(k, body):
        return number(k << 3 | 2) + number(len(body)) + body

    def piece(text, score, kind):
        return part(1, message(part(1, text.encode()), b"\x15" + np.float32(score).tobytes(), b"\x18" + number(kind)))

    vocabulary = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((f"<0x{i:02X}>", 0, 6) for i in range(256)), ("▁", -2, 1), ("a", -3, 1), ("b", -3.5, 1), ("▁a", -2.5, 1), ("ab", -4, 1), ("▁ab", -4.2, 1), ("ba", -4.5, 1), *more]
    raw = b"".join(piece(*v) for v in vocabulary) + part(2, b"\x18\x01" + number(35 << 3) + b"\x01" + trainer) + part(3, normaliser)
    return raw


def test_unigram_model_is_rebuilt():
    raw = unigram()
    judge = sentencepiece.SentencePieceProcessor(model_proto=io.BytesIO(raw).getvalue())
    spec = pieces.read_model(raw)
    assert spec.model_type == pieces.UNIGRAM and spec.byte_fallback and not spec.remove_extra
    tok = pieces.build(spec)
    for t in ("ab ba", "abba  a", "é a", "aab bab"):
        assert tok.encode(t, add_special_tokens=False).ids == judge.encode(t), t


def test_extra_blanks_go_as_sentencepiece_has_them(tmp_path, spark):
    raw = unigram(b"\x18\x01\x20\x01\x28\x01")
    judge = sentencepiece.SentencePieceProcessor(model_proto=raw)
    tok = pieces.build(pieces.read_model(raw))
    texts = ["\ta", "a\n", "  a   b ", "\n a", " \t ab \n ", "a\n\n  b", ""]
    for t in texts:
        assert tok.encode(t, add_special_tokens=False).ids == judge.encode(t), t
    (tmp_path / "m.model").write_bytes(raw)
    rows = pieces.encoded(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), str(tmp_path / "m.model")).collect()
    assert all(r.parity and r.n_tokens == len(judge.encode(texts[r.doc_id])) for r in rows)


def test_ids_without_parity_are_never_returned(monkeypatch):
    m = pieces.PieceModel(MODEL)
    texts = pa.array(["some words", "", "other words"], pa.large_string())

    class Judge:
        encode = staticmethod(lambda texts, num_threads: [[7] * len(t.split()) for t in texts])

    m.judge = Judge()
    rows, parity = m.checked(texts)
    assert m.doubtful and parity.tolist() == [False, True, False] and [r.tolist() for r in rows] == [[7, 7], [], [7, 7]]
    m = pieces.PieceModel(MODEL)
    rows, parity = m.checked(pa.array([*TEXTS, None], pa.large_string()).fill_null(""))
    assert parity.all() and not m.doubtful and [r.tolist() for r in rows] == [*map(m.judge.encode, TEXTS), []]


def test_models_that_cannot_be_rebuilt_are_refused():
    for raw in (unigram(trainer=b"\xc0\x01\x01"), unigram(more=[("own", 0, 4)])):
        with pytest.raises(ValueError, match="not supported"):
            pieces.build(pieces.read_model(raw))


def test_very_long_text(spark):
    text = "some words of text, 123 and more. " * 20_000
    (r,) = pieces.encoded(spark.createDataFrame([(1, text)], "doc_id long, text string"), MODEL).collect()
    assert r.parity and r.round_trip and r.n_tokens > 100_000


def test_edge_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (1, None), (1, ""), (2, "x y"), (2, "x y")], "doc_id long, text string").selectExpr("*", "1 as parity")
    rows = pieces.encoded(df, MODEL).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 0, 2, 2, 2] and all(r.parity and r.round_trip for r in rows)
    assert pieces.encoded(df.limit(0), MODEL).count() == 0
