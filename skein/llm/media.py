"""Media columns: payloads as PNG images in tar shards, addressed by content.

A text's payload is its UTF-8 bytes filled with spaces up to a positive multiple
of 192: rows of 64 pixels of three 8-bit samples. It is stored losslessly as a
PNG image. Each input partition writes its images into tar shards of a bounded
size in the shared folder; an image that occurs again in the partition is stored
once. Rows carry the digest, the shard, and the offset and length of the stored
bytes in it. `headers` fills the metadata columns from the first bytes of each
image alone; `decoded` reads whole images back and computes features.

Null text counts as empty: one row of 64 spaces. Repeated rows share one image.
Rows with null ids are kept; extra columns are ignored; no rows give no shard.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled, shared_folder, ship, table, width
from .files import read_at, write_once
from .lexing import chunks

UNIT = 192
PIXELS = 64
#: A shard is closed once it has this many bytes.
SHARD_BYTES = 64 << 20
#: Images that a task remembers by digest, so as to store copies once.
REMEMBERED = 500_000
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and first chunk: all that the metadata columns need.
HEADER = len(SIGNATURE) + 25


def payload(raw: bytes) -> bytes:
    """The bytes with spaces up to a positive multiple of 192."""
    return raw + b" " * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def to_png(samples: bytes, level: int = 6) -> bytes:
    """An RGB image of 64 pixels a row whose samples are the bytes."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)  # each row begins with its filter, none
    lines[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", PIXELS, len(rows), 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(first: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from the first bytes of an image."""
    if first[:8] != SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">IIBB", first[16:26])


def from_png(stored: bytes) -> bytes:
    """The samples of an image written by to_png, with every chunk's check sum verified."""
    w, h, depth, colour = png_header(stored)
    if (w, depth, colour) != (PIXELS, 8, 2):
        raise ValueError("not an image of this format")
    at, data = len(SIGNATURE), []
    while at < len(stored):
        n, kind = struct.unpack(">I4s", stored[at : at + 8])
        body = stored[at + 8 : at + 8 + n]
        if struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("damaged image")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, UNIT + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return np.ascontiguousarray(lines[:, 1:]).tobytes()


def tar_header(name: str, size: int) -> bytes:
    """The 512 bytes that precede a file in a tar archive."""
    head = bytearray(512)
    for at, what in ((0, name.encode()), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % size if size < 8 << 30 else b"\x80" + size.to_bytes(11, "big")), (136, b"00000000000\0"), (148, b" " * 8), (156, b"0"), (257, b"ustar\x0000")):
        head[at : at + len(what)] = what
    head[148:156] = b"%06o\0 " % sum(head)
    return bytes(head)


INDEX = "doc_id bigint, n_bytes bigint, digest string, shard string, offset bigint, length bigint"


def store(docs: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards and returns the index, one row for each row of docs. Run it once: each run writes shards of its own."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches):
        seen: dict[str, tuple[str, int, int]] = {}
        waiting: list = []  # rows whose shard is still open
        parts: list[bytes] = []
        places: dict[str, tuple[int, int]] = {}
        at = 0

        def closed():
            nonlocal at
            if not waiting:
                return None
            uri = write_once(folder, "shard.tar", [*parts, b"\0" * 1024]) if parts else ""
            if len(seen) > REMEMBERED:
                seen.clear()
            seen.update({d: (uri, o, n) for d, (o, n) in places.items()})
            rows = [(k, n, d, *(seen[d] if place is None else place)) for k, n, d, place in waiting]
            waiting.clear()
            parts.clear()
            places.clear()
            at = 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for part, texts in chunks(batch, "text"):
                for key, text in zip(part.column(0).to_pylist(), texts.to_pylist()):
                    raw = text.encode()
                    samples = payload(raw)
                    digest = hashlib.sha256(samples).hexdigest()
                    place = seen.get(digest)
                    if place is None and digest not in places:
                        image = to_png(samples)
                        places[digest] = at + 512, len(image)
                        parts += [tar_header(f"{digest}.png", len(image)), image, b"\0" * (-len(image) % 512)]
                        at += 512 + len(image) + -len(image) % 512
                    waiting.append((key, len(raw), digest, place))
                    if at >= shard_bytes or len(waiting) >= 100_000:
                        yield closed()
        if waiting:
            yield closed()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, INDEX)


def _by_place(index: DataFrame, run, out: str) -> DataFrame:
    """Applies run to the index with each task's rows in the order in which their bytes lie."""
    n = width(index.sparkSession)
    return index.repartition(n, "shard").sortWithinPartitions("shard", "offset").mapInArrow(run, out)


def _ranges(batches, whole: bool):
    """The rows of each batch, with the stored bytes of each (or their first ones); a range is read once for rows in a row."""
    uri, source, last, got = None, None, None, b""
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            if r["shard"] != uri:
                if source is not None:
                    source.close()
                uri, source, last = r["shard"], read_at(r["shard"]), None
            if (r["offset"], r["length"]) != last:
                last = r["offset"], r["length"]
                got = source.read_at(r["length"] if whole else min(HEADER, r["length"]), r["offset"])
            yield r, got
    if source is not None:
        source.close()


def _batched(rows, schema: pa.Schema, size: int = 5000):
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


METADATA = ("width", "height", "depth", "colour")
INDEXED = INDEX + "".join(f", {c} bigint" for c in METADATA)


def _arrow(columns: str) -> pa.Schema:
    return pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in columns.split(", ")])


def headers(index: DataFrame) -> DataFrame:
    """The index with width, height, depth and colour type, from range reads of 33 bytes for each image."""

    def run(batches):
        yield from _batched((r | dict(zip(METADATA, png_header(first))) for r, first in _ranges(batches, False)), _arrow(INDEXED))

    return _by_place(index.select(*(c.split()[0] for c in INDEX.split(", "))), run, INDEXED)


def feature(samples: bytes) -> str:
    """Height, mean, spread and a 64-bit brightness hash of the image, all in whole numbers."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    n, total, square = len(x), int(x.sum()), int((x * x).sum())
    cells = np.add.reduceat(x, np.arange(64) * (n // 64))
    bits = int.from_bytes(np.packbits(cells * n >= total * (n // 64)).tobytes(), "big")
    return f"h={n // UNIT};mean={total // n};var={(square * n - total * total) // (n * n)};ahash={bits:016x}"


DECODED = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, shard string, offset bigint" + "".join(f", {c} bigint" for c in METADATA)


def decoded(indexed: DataFrame) -> DataFrame:
    """Whole images read back from the shards: digests of payload and stored form, and features, beside the metadata that `headers` gave."""

    def run(batches):
        def rows():
            last, made = None, {}
            for r, stored in _ranges(batches, True):
                if (r["shard"], r["offset"]) != last:
                    last, samples = (r["shard"], r["offset"]), from_png(stored)
                    made = {"payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-16:]), "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(), "feature": feature(samples)}
                    if made["payload_sha256"] != r["digest"] or len(samples) != r["width"] * r["height"] * 3:
                        raise ValueError(f"the bytes at {r['shard']}:{r['offset']} don't have the digest and size of their row")
                yield {c: r[c] for c in ("doc_id", "n_bytes", "shard", "offset", *METADATA)} | made

        yield from _batched(rows(), _arrow(DECODED))

    return _by_place(indexed, run, DECODED)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as images, their metadata filled by header reads, and the images read back."""
    index = settled(store(table(spark, sf_dir, "documents"), shared_folder(spark, "media")), "media-index")
    return decoded(settled(headers(index), "media-metadata")).drop("shard", "offset")
