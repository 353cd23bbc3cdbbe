"""Packing documents into sequences: best-fit decreasing over open windows.

Documents are encoded, each followed by an end id. Those longer than a window
are first cut into full windows; what remains of each document is placed, the
longest first, into the open window with the least room that still takes it. A
segment tree over the room left (one leaf for each amount) finds that window in
logarithmic time. Every input partition packs its own documents in groups of at
most GROUP pieces, so memory is bounded and texts aren't shuffled. What a group
leaves part-filled (windows with more than a hundredth of room) is packed once
more: such windows' contents, each kept together, are dealt to tasks of about
OPEN windows each and placed by the same rule, so padding doesn't depend on how
many partitions the input has.

Null text counts as empty and still has its end id. A document longer than a
window spans several sequences; no piece does. Repeated rows are packed as often
as they occur. Extra columns of the input are ignored. An empty input gives no
rows. Sequence ids are unique over the whole result but not consecutive.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled, ship, table
from .lexing import chunks
from .wordbpe import load

WINDOW = 2048
END = 1
#: Pieces that are packed together at most, and part-filled windows that are dissolved in one task, about.
GROUP, OPEN = 200_000, 10_000


class RoomTree:
    """A segment tree over amounts of room; a leaf counts the open windows with that room."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.sum = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.sum[at] += n
            at >>= 1

    def put(self, room: int, window: int) -> None:
        """Opens a window with that room."""
        self.open[room].append(window)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns the window with the least room that is at least `least`."""
        at, tree = least + self.size, self.sum
        if not tree[at]:
            while True:  # to the first subtree on the right that has a window
                while at & 1:
                    at >>= 1
                if at == 0:
                    return None
                at |= 1
                if tree[at]:
                    break
            while at < self.size:
                at <<= 1
                if not tree[at]:
                    at |= 1
        room = at - self.size
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """For each length (1 to window) its window and offset in it, and the number of windows.

    Ties keep the order given, so equal input gives equal output.
    """
    order = np.argsort(-lengths, kind="stable")
    at, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, n = RoomTree(window), 0
    for i in order.tolist():
        need = int(lengths[i])
        found = tree.take(need) if n else None
        if found is None:
            found = window, n
            n += 1
        room, w = found
        at[i], offset[i] = w, window - room
        if room > need:
            tree.put(room - need, w)
    return at, offset, n


def cut(doc_tokens: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents: the place of the document, where the piece starts, its length. Full windows come first."""
    pieces = -(-doc_tokens // window)
    doc = np.repeat(np.arange(len(doc_tokens)), pieces)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
    return doc, start, np.minimum(window, doc_tokens[doc] - start)


SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])
#: Second-step sequence ids begin here; first-step ids are below.
_AGAIN = 1 << 60


def _base(context) -> int:
    return (context.partitionId() if context else 0) << 36


def packed_once(docs: DataFrame, vocabulary: str, window: int = WINDOW, end: int = END, group: int = GROUP, tokenizer: Callable = load) -> DataFrame:
    """One row for each piece, packed within input partitions, with `used`, the tokens of its sequence."""
    ship(docs.sparkSession)

    def run(batches):
        base, held, held_pieces = _base(TaskContext.get()), [], 0
        encoder = tokenizer(vocabulary)

        def packed():
            nonlocal base
            ids, null, tokens, doc, start, length, crc = (np.concatenate(x) for x in zip(*held))
            at, offset, n = best_fit_decreasing(length, window)
            used = np.bincount(at, length, n).astype(np.int64)[at]
            order = np.lexsort((offset, at))
            cols = [pa.array(ids[doc], mask=null[doc]), *map(pa.array, (start, length, crc, tokens[doc], base + at, offset, used))]
            base += n
            rows = pa.RecordBatch.from_arrays(cols, schema=_ARROW.append(pa.field("used", pa.int64()))).take(pa.array(order))
            for k in range(0, rows.num_rows, 50_000):
                yield rows.slice(k, 50_000)

        docs_held = 0
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                ids, off = encoder.encode_ended(texts, end)
                tokens = np.diff(off)
                doc, start, length = cut(tokens, window)
                raw = memoryview(ids.astype("<u4").tobytes())
                first = (off[doc] + start) * 4
                crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(first.tolist(), (first + length * 4).tolist())), np.int64, len(doc))
                key = part.column(0)
                held.append((key.fill_null(0).to_numpy(zero_copy_only=False), key.is_null().to_numpy(zero_copy_only=False), tokens, doc + docs_held, start, length, crc))
                docs_held += len(tokens)
                held_pieces += len(doc)
                if held_pieces >= group:
                    yield from packed()
                    held.clear()
                    held_pieces = docs_held = 0
        if held:
            yield from packed()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA + ", used bigint")


def packed_again(pieces: DataFrame, tasks: int, window: int = WINDOW) -> DataFrame:
    """The pieces of part-filled sequences, dissolved and packed anew; a sequence's pieces go to one task."""

    def run(batches):
        base, held = _AGAIN + _base(TaskContext.get()), [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        at, offset, _ = best_fit_decreasing(rows.column("length").to_numpy(), window)
        order = np.lexsort((offset, at))
        cols = [c.combine_chunks() for c in rows.columns[:5]]
        yield from pa.table([*cols, pa.array(base + at), pa.array(offset)], schema=_ARROW).take(pa.array(order)).to_batches(50_000)

    return pieces.repartition(tasks, "sequence_id").sortWithinPartitions("sequence_id", "offset").mapInArrow(run, SCHEMA)


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end: int = END, group: int = GROUP, tokenizer: Callable = load) -> DataFrame:
    """One row for each piece: its document, place in it, digest, sequence and place in that."""
    pieces = settled(packed_once(docs, vocabulary, window, end, group, tokenizer), "pieces")
    part_filled = f"used * 100 < {window * 99}"
    windows, rows = pieces.where(part_filled).agg(F.count_distinct("sequence_id"), F.count("*")).first()
    again = packed_again(pieces.where(part_filled), max(-(-windows // OPEN), -(-rows // group), 1), window)
    return pieces.where(f"not ({part_filled})").drop("used").unionByName(again)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
