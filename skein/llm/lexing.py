"""Vectorised word handling over Arrow string columns.

Every text operator of this subpackage works on whole batches of texts: the
UTF-8 bytes of a batch are classified with numpy tables, words are cut out with
array arithmetic and dictionary-encoded by Arrow, so that per-word Python work
is done once per *distinct* word of a batch and not once per occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at once; bounds the memory of a Python worker.
CHUNK_BYTES = 3 << 20

#: Space and the control characters 9 to 13 part words.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, every other byte as it is.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[0x41:0x5B] += 0x20


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one string array in which null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each text starts (one more entry than texts)."""
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batch whose texts have at most `limit` bytes together (one longer text stands alone)."""
    if not batch.num_rows:
        return
    texts = texts_of(batch.column(batch.schema.get_field_index(column)))
    _, off = buffer_of(texts)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at), texts.slice(at, end - at)
        at = end


def runs(kept: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of kept bytes; a run never crosses from one text into the next."""
    edge = np.zeros(len(kept) + 1, bool)
    edge[off] = True
    before = np.empty(len(kept), bool)
    before[:1] = False
    before[1:] = kept[:-1]
    starts = np.flatnonzero(kept & (~before | edge[:-1]))
    after = np.empty(len(kept), bool)
    after[-1:] = False
    after[:-1] = kept[1:]
    ends = np.flatnonzero(kept & (~after | edge[1:])) + 1
    return starts, ends


def words_array(data: np.ndarray, kept: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The words as a binary array; lengths must add up to the number of kept bytes."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[kept]))])


def distinct_words(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each word the place of its value in the array of distinct values, and that array."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def plain_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words parted by blanks, with A-Z lower-cased.

    Returns the code of each word, the distinct words, and for each text where
    its words start among the codes (one more entry than texts).
    """
    data, off = buffer_of(texts)
    kept = ~BLANK[data]
    starts, ends = runs(kept, off)
    codes, values = distinct_words(words_array(ASCII_LOWER[data] if lower else data, kept, ends - starts))
    return codes, values, np.searchsorted(starts, off)


def spread(lengths: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Positions first, first+1, ... (length of them) of each item, in a row."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(firsts - (ends - lengths), lengths) + np.arange(total)
