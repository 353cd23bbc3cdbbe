"""Token ids in shard files with Elias-Fano coded document boundaries.

A shard holds the ids of its documents in a row, as unsigned 16- or 32-bit
numbers, and where each document begins as an Elias-Fano code: the lower bits of
all offsets in a packed array, the upper bits in unary, with the place of every
256th one noted so that `select` (the offsets of documents in a row) decodes the
stretches between those places and nothing else. For n documents over m ids this
takes about 2 + log2(m / n) bits a document; no table of 64-bit offsets is stored
or made. The document ids, which ascend too, are coded likewise. Shards follow one
another in ascending document id; the manifest has how many ids come before each.

Null text counts as empty and still has its end id. Rows whose id is null come
first; rows with one id are ordered by a hash of their texts, so that a frequent
id is dealt to several tasks; repeated rows are kept. A text of any length is
encoded whole and makes its shard as long as it takes. Extra columns are ignored.
No rows give an empty manifest.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settled, shared_folder, ship, table, width
from .files import read_at, write_once
from .lexing import chunks
from .wordbpe import load

END = 2
SAMPLE = 256
MAGIC = b"SKEINID1"


class EliasFano:
    """A non-decreasing sequence of numbers below 2^63 in near-minimal space."""

    def __init__(self, n: int, bits: int, lower: np.ndarray, upper: np.ndarray, samples: np.ndarray):
        self.n, self.bits, self.lower, self.upper, self.samples = n, bits, lower, upper, samples

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        """The code of the values."""
        n = len(values)
        last = int(values[-1]) if n else 0
        bits = max(0, (last // n).bit_length() - 1) if n else 0
        low = (values & ((1 << bits) - 1)).astype(np.uint64)
        lower = np.packbits(((low[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> bits).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        flags[ones] = 1
        return cls(n, bits, lower, np.packbits(flags, bitorder="little"), ones[::SAMPLE].astype(np.uint64))

    def select(self, first: int, end: int | None = None) -> np.ndarray:
        """The values from the first-th up to the end-th (or that one alone)."""
        end = first + 1 if end is None else end
        if not 0 <= first <= end <= self.n:
            raise IndexError((first, end))
        if first == end:
            return np.zeros(0, np.int64)
        noted, last = first // SAMPLE, -(-end // SAMPLE)
        at = int(self.samples[noted]) >> 3
        stop = (int(self.samples[last]) >> 3) + 1 if last < len(self.samples) else len(self.upper)
        bits = np.unpackbits(self.upper[at:stop], bitorder="little")
        bits[: int(self.samples[noted]) & 7] = 0
        place = np.arange(first, end)
        high = np.flatnonzero(bits)[first - noted * SAMPLE : end - noted * SAMPLE] + (at << 3) - place
        if not self.bits:
            return high
        a, b = first * self.bits, end * self.bits
        low = np.unpackbits(self.lower[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a].reshape(-1, self.bits).astype(np.int64)
        return (high << self.bits) | (low << np.arange(self.bits)).sum(axis=1)

    def to_bytes(self) -> bytes:
        """The stored form."""
        return struct.pack("<QBQQQ", self.n, self.bits, self.lower.nbytes, self.upper.nbytes, len(self.samples)) + self.lower.tobytes() + self.upper.tobytes() + self.samples.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple["EliasFano", int]:
        """The code in its stored form, and the bytes it takes."""
        n, bits, a, b, c = struct.unpack_from("<QBQQQ", raw)
        at = struct.calcsize("<QBQQQ")
        return cls(n, bits, np.frombuffer(raw, np.uint8, a, at), np.frombuffer(raw, np.uint8, b, at + a), np.frombuffer(raw, "<u8", c, at + a + b)), at + a + b + 8 * c


HEAD = "<8sBQQQQQQqq"  # magic, bytes of an id, documents, ids, bytes of the boundaries and of the document ids, null ids, ids below zero, least of those, least of the others
MANIFEST = "part int, seq int, uri string, n_docs bigint, n_ids bigint, first_doc bigint"
#: A shard is closed once it has this many ids.
SHARD_IDS = 16 << 20


def write(docs: DataFrame, vocabulary: str, folder: str, end: int = END, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the shards and returns the manifest, one row a shard. Run it once: each run writes shards of its own."""
    ship(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        encoder = load(vocabulary)
        unit = "<u2" if encoder.tok.get_vocab_size() <= 1 << 16 and end < 1 << 16 else "<u4"
        ids, bounds, keys, held, seq = [], [], [], 0, 0
        context = TaskContext.get()
        part_id = context.partitionId() if context else 0

        def closed():
            nonlocal held, seq
            sizes = np.concatenate(bounds)
            offsets = np.cumsum(sizes) - sizes
            key = pa.concat_arrays(keys)
            code = EliasFano.of(offsets).to_bytes()
            known = key.drop_null().to_numpy()
            below, above = known[known < 0], known[known >= 0]
            least = [int(x[0]) if len(x) else 0 for x in (below, above)]
            names = EliasFano.of(below - least[0]).to_bytes() + EliasFano.of(above - least[1]).to_bytes()
            head = struct.pack(HEAD, MAGIC, 2 if unit == "<u2" else 4, len(sizes), held, len(code), len(names), key.null_count, len(below), *least)
            uri = write_once(folder, f"ids-{part_id:06d}-{seq:04d}", [head, code, names, *ids])
            row = {"part": part_id, "seq": seq, "uri": uri, "n_docs": len(sizes), "n_ids": held, "first_doc": key[0].as_py()}
            ids.clear()
            bounds.clear()
            keys.clear()
            held, seq = 0, seq + 1
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_doc", pa.int64())]))

        for batch in batches:
            for part, texts in chunks(batch, "text"):
                got, off = encoder.encode_ended(texts, end)
                ids.append(got.astype(unit).tobytes())
                bounds.append(np.diff(off))
                keys.append(part.column(0))
                held += len(got)
                if held >= shard_ids:
                    yield closed()
        if keys:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("__salt"))
    return rows.repartitionByRange(width(docs.sparkSession), "doc_id", "__salt").sortWithinPartitions("doc_id", "__salt").drop("__salt").mapInArrow(run, MANIFEST)


class Shard:
    """An open shard: `bounds` gives a document's first id, `ids(k)` reads only that document's ids."""

    def __init__(self, uri: str):
        self.file = read_at(uri)
        size = struct.calcsize(HEAD)
        magic, self.unit, self.n_docs, self.n_ids, code, names, self.nulls, self.below, *self.least = struct.unpack(HEAD, self.file.read_at(size, 0))
        if magic != MAGIC:
            raise ValueError(f"not a shard of ids: {uri}")
        self.bounds, _ = EliasFano.from_bytes(self.file.read_at(code, size))
        raw = self.file.read_at(names, size + code)
        below, used = EliasFano.from_bytes(raw)
        self.names = below, EliasFano.from_bytes(raw[used:])[0]
        self.first = size + code + names

    def keys(self, first: int, end: int) -> pa.Array:
        """The ids of the documents in those places."""
        parts, at = [pa.nulls(max(0, min(end, self.nulls) - first), pa.int64())], self.nulls
        for code, least in zip(self.names, self.least):
            a, b = max(first, at) - at, min(end, at + code.n) - at
            if a < b:
                parts.append(pa.array(code.select(a, b) + least))
            at += code.n
        return pa.concat_arrays(parts)

    def starts(self, first: int, end: int) -> np.ndarray:
        """Where those documents begin in the shard, and where the last of them ends."""
        return self.bounds.select(first, end + 1) if end < self.n_docs else np.append(self.bounds.select(first, end), self.n_ids)

    def span(self, k: int) -> tuple[int, int]:
        """Where the k-th document's ids begin and end in the shard."""
        a, b = self.starts(k, k + 1).tolist()
        return a, b

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        a, b = self.span(k)
        return np.frombuffer(self.file.read_at((b - a) * self.unit, self.first + a * self.unit), f"<u{self.unit}").astype("<u4")

    def batches(self, docs: int = 4096):
        """Places, spans and ids of documents in a row, a few thousand at a time."""
        at = 0
        while at < self.n_docs:
            starts = self.starts(at, min(self.n_docs, at + docs))
            n = max(1, min(len(starts) - 1, int(np.searchsorted(starts, starts[0] + (4 << 20), "right")) - 1))
            a, b = int(starts[0]), int(starts[n])
            yield at, starts[: n + 1], np.frombuffer(self.file.read_at((b - a) * self.unit, self.first + a * self.unit), f"<u{self.unit}").astype("<u4")
            at += n


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with `base`, the ids in all shards before: sums within each writing task, and over the tasks (one row a task)."""
    before = W.rowsBetween(W.unboundedPreceding, -1)
    tasks = manifest.groupBy("part").agg(F.sum("n_ids").alias("__n")).select("part", F.coalesce(F.sum("__n").over(before.orderBy("part")), F.lit(0)).alias("__base"))
    within = F.coalesce(F.sum("n_ids").over(before.partitionBy("part").orderBy("seq")), F.lit(0))
    return manifest.select("*", within.alias("__within")).join(tasks, "part").select("uri", (F.col("__base") + F.col("__within")).alias("base"), "n_ids")


READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read(manifest: DataFrame) -> DataFrame:
    """Each document's place and digest, from the files."""
    spark = manifest.sparkSession
    schema = pa.schema([(c.split()[0], pa.int64()) for c in READ.split(", ")])

    def run(batches):
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(uri)
                for at, starts, ids in shard.batches():
                    raw = memoryview(ids.tobytes())
                    cuts = ((starts - starts[0]) * 4).tolist()
                    crc = [zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:])]
                    n = len(crc)
                    yield pa.RecordBatch.from_arrays([shard.keys(at, at + n), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], schema=schema)

    return placed(manifest).repartition(width(spark), "uri").select("uri", "base").mapInArrow(run, READ)


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token ids in ascending id order, and read back."""
    import public_tokenizers

    return read(settled(write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), shared_folder(spark, "ids")), "ids-manifest"))
