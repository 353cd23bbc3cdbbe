"""SentencePiece models on the tokenizers library.

The model file is a protobuf; its pieces, scores and specifications are read
here without generated code, and an encoder of the tokenizers library is built
from them: the normaliser (the precompiled character map, the added first space,
runs of blanks), the marker that stands for a space, unigram scores or the merges that
pair scores imply, and byte fallback.

Where no piece has a marker after another character, a text's ids are those of
its words in a row, so each distinct word is encoded once, in batches on several
threads; other texts are encoded whole, in batches too. Parity with the
sentencepiece library is verified on all that is encoded: every distinct word, and
every text encoded whole. As soon as a word differs, a worker compares whole texts
from then on; where one differs, the row says so and its ids are sentencepiece's.
Decoding is checked against the text.
Models with user-defined pieces or with the marker behind words are refused.

Null and empty texts have no ids. Texts of any length are encoded whole. Repeated
rows give equal results; rows with null ids are kept; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, table
from .lexing import buffer_of, chunks, distinct_words, spread, words_array
from .wordbpe import Pieces

#: Fixed values of the format: the marker for a space and the kinds of pieces.
MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(raw: bytes):
    """(number, value) of each field of a protobuf message: whole numbers, 4 or 8 raw bytes, or bytes."""

    def varint(at):
        n = shift = 0
        while True:
            b = raw[at]
            n |= (b & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if b < 0x80:
                return n, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        wire = key & 7
        if wire == 0:
            value, at = varint(at)
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = raw[at : at + size], at + size
        elif wire == 2:
            size, at = varint(at)
            value, at = raw[at : at + size], at + size
        else:
            raise ValueError(f"unknown wire type {wire}")
        yield key >> 3, value


@dataclass
class Spec:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    marker_behind: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True


def read_model(raw: bytes) -> Spec:
    """Parses a model file."""
    spec = Spec()
    for number, value in fields(raw):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for k, v in fields(value):
                if k == 1:
                    text = v.decode()
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            spec.pieces.append((text, score, kind))
        elif number == 2:
            for k, v in fields(value):
                if k == 3:
                    spec.model_type = v
                elif k == 35:
                    spec.byte_fallback = bool(v)
                elif k == 40:
                    spec.unk_id = v
                elif k == 24:
                    spec.marker_behind = bool(v)
        elif number == 3:
            for k, v in fields(value):
                if k == 2:
                    spec.charsmap = v
                elif k == 3:
                    spec.dummy_prefix = bool(v)
                elif k == 4:
                    spec.remove_extra = bool(v)
                elif k == 5:
                    spec.escape = bool(v)
    return spec


def merges_of(spec: Spec) -> list[tuple[str, str]]:
    """The merges that a BPE model's scores imply: every way to make a piece of two others, the best score first."""
    place = {p: i for i, (p, _, kind) in enumerate(spec.pieces) if kind in (NORMAL, USER_DEFINED)}
    out = []
    for p, i in place.items():
        score = spec.pieces[i][1]
        halves = [(place[p[:k]], place[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in place and p[k:] in place]
        out += [(-score, i, *h) for h in sorted(halves)]
    out.sort(key=lambda x: x[:4])
    return [(x[4], x[5]) for x in out]


def build(spec: Spec):
    """An encoder of the tokenizers library for the model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if spec.marker_behind or any(kind == USER_DEFINED for _, _, kind in spec.pieces):
        raise ValueError("models with user-defined pieces or with the marker behind words are not supported")
    if spec.model_type == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], spec.unk_id, spec.byte_fallback)
    elif spec.model_type == BPE:
        model = models.BPE({p: i for i, (p, _, _) in enumerate(spec.pieces)}, merges_of(spec), unk_token=spec.pieces[spec.unk_id][0], fuse_unk=True, byte_fallback=spec.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models are supported")
    steps = []
    if spec.charsmap:
        steps.append(normalizers.Precompiled(spec.charsmap))
    if spec.remove_extra:
        steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if spec.escape:
        steps.append(normalizers.Replace(" ", MARKER))
    tok = Tokenizer(model)
    if steps:
        tok.normalizer = normalizers.Sequence(steps)
    tok.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else [])])
    return tok


class PieceModel(Pieces):
    """Encoder and decoder for one model file; use `load`."""

    item = 2000

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            self.spec = read_model(f.read())
        super().__init__(build(self.spec))
        # word by word is exact if a marker only ever begins a piece (or follows another marker)
        inner = any(MARKER in p.lstrip(MARKER) for p, _, kind in self.spec.pieces if kind in (NORMAL, USER_DEFINED))
        self.by_word = self.spec.model_type == BPE and not (inner or self.spec.charsmap or self.spec.remove_extra) and self.spec.dummy_prefix and self.spec.escape
        self.judge = sentencepiece.SentencePieceProcessor(model_file=path)
        self.doubtful = False  # whether some word has other ids than sentencepiece's
        raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(MARKER, " ").encode() for p, _, kind in self.spec.pieces]
        self.sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def spelled(self, word: bytes) -> str:
        """Words come with their spaces; markers take their place."""
        return word.decode().replace(" ", MARKER)

    def _learn(self, words: list[bytes]) -> None:
        normal, self.tok.normalizer = self.tok.normalizer, None
        try:
            super()._learn(words)
        finally:
            if normal is not None:
                self.tok.normalizer = normal
        if not self.doubtful:
            # the first blank of a word is the one that sentencepiece puts before a text
            said = self.judge.encode([w[1:].decode() for w in words], num_threads=1)
            said = [s if w != b" " else [self.judge.piece_to_id(MARKER)] for w, s in zip(words, said)]  # a blank alone, at the end of a text
            count = self.count[len(self.count) - len(words) :]
            mine = self.flat[len(self.flat) - int(count.sum()) :]
            self.doubtful = not (np.array_equal(count, np.fromiter(map(len, said), np.int64, len(said))) and np.array_equal(mine, np.fromiter((i for s in said for i in s), np.uint32, len(mine))))

    def checked(self, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        """The ids of each text, and whether they are those of the rebuilt encoder: where those differ from sentencepiece's, its own stand."""
        ids, off = self.encode(texts)
        rows = [ids[a:b] for a, b in zip(off.tolist(), off[1:].tolist())]
        parity = np.ones(len(rows), bool)
        asked = np.arange(len(rows)) if self.doubtful else self._whole(texts)
        if len(asked):
            for i, said in zip(asked.tolist(), self.judge.encode([texts[int(i)].as_py() for i in asked], num_threads=1)):
                said = np.asarray(said, np.uint32)
                if not np.array_equal(rows[i], said):
                    parity[i], rows[i] = False, said
        return rows, parity

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """The texts that can't be encoded word by word."""
        if not self.by_word:
            return np.arange(len(texts))
        data, off = buffer_of(texts)
        marks = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81) if len(data) > 2 else np.zeros(0, bool)
        odd = np.append(np.flatnonzero(marks), np.flatnonzero(data == 0))
        return np.unique(np.searchsorted(off, odd, "right") - 1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids start."""
        data, off = buffer_of(texts)
        whole = self._whole(texts)
        slow = dict(zip(whole.tolist(), (np.asarray(e.ids, np.uint32) for e in self.tok.encode_batch_fast([texts[int(i)].as_py() for i in whole], add_special_tokens=False)))) if len(whole) else {}
        if len(slow) == len(texts):
            ids, ends = np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        else:
            size = np.diff(off)
            size[whole] = 0
            used = size > 0
            # each text with a space before it
            new_off = np.concatenate([[0], np.cumsum(size + used)])
            buf = np.full(int(new_off[-1]), 0x20, np.uint8)
            buf[spread(size, new_off[:-1] + 1)] = data[spread(size, off[:-1])]
            blank = buf == 0x20
            start = blank.copy()
            start[1:] &= ~blank[:-1]
            start[new_off[:-1][used]] = True
            starts = np.flatnonzero(start)
            codes, values = distinct_words(words_array(buf, np.ones(len(buf), bool), np.diff(np.append(starts, len(buf)))))
            ids, of_word = self.ids(codes, values)
            ends = of_word[np.searchsorted(starts, new_off)]
        if not slow:
            return ids, ends
        parts = [slow.get(i, ids[ends[i] : ends[i + 1]]) for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that aren't UTF-8 are replaced."""
        n = self.sizes[ids]
        text = self.bytes[spread(n, self.starts[ids])].tobytes().decode(errors="replace")
        return text[1:] if self.spec.dummy_prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    """The model of a file, one per worker process."""
    return PieceModel(path)


OUT = "doc_id bigint, n_tokens bigint, ids_crc32 bigint, parity boolean, round_trip boolean"


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """Per document the number and digest of its ids, whether sentencepiece gives the same, and whether they decode to the text; no shuffle."""
    ship(docs.sparkSession)

    def run(batches):
        m = load(model)
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                rows, parity = m.checked(texts)
                strings = texts.to_pylist()
                columns = [part.column(0), pa.array([len(r) for r in rows], pa.int64()), pa.array([zlib.crc32(r.astype("<u4").tobytes()) for r in rows], pa.int64()), pa.array(parity, pa.bool_()), pa.array([m.decode(r) == t for r, t in zip(rows, strings)], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded with the byte-fallback model."""
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
