"""Batch encoding with a word-level BPE vocabulary of the tokenizers library.

The library's own pipeline (normalise, split, byte-pair merges) tracks offsets
for every character and so takes about a CPU second per MB. A BPE that splits
into words first gives each word its ids regardless of the words around it, so
here texts are cut into the very pieces the library's splitter cuts, and the
library encodes each distinct piece once. The character tables come from the
library's normaliser and splitter; a text with any character for which a table
cannot be exact (beyond U+02FF, apostrophes, marks of special tokens, letters
whose lower case differs between libraries) is encoded whole by the library.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .lexing import buffer_of, distinct_words, spread, words_array

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
#: Code points below this have their own table entry; all are unchanged by NFC.
TABLE = 0x300
#: Distinct pieces that a worker remembers before it starts anew.
REMEMBERED = 400_000


class Pieces:
    """Ids of distinct pieces of text, each encoded by the library once and then remembered."""

    #: Pieces in each item of a batch, of which the library encodes several at once on threads; all pieces in one item take one thread.
    item = 1 << 62

    def __init__(self, tok):
        self.tok = self.learner = tok
        self.known: dict[bytes, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.known.clear()
        self.flat = np.zeros(0, np.uint32)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def spelled(self, word: bytes) -> str:
        """The piece as the library's model is given it."""
        return word.decode()

    def _learn(self, words: list[bytes]) -> None:
        spelled = list(map(self.spelled, words))
        lists = [spelled[i : i + self.item] for i in range(0, len(spelled), self.item)]
        done = self.learner.encode_batch(lists, is_pretokenized=True, add_special_tokens=False) if len(lists) > 1 else [self.learner.encode(lists[0], is_pretokenized=True, add_special_tokens=False)]
        ids = np.concatenate([np.asarray(e.ids, np.uint32) for e in done])
        count = np.concatenate([np.bincount(np.asarray(e.word_ids, np.int64), minlength=len(x)) for e, x in zip(done, lists)])
        base, n = len(self.flat), len(self.first)
        self.flat = np.concatenate([self.flat, ids])
        self.first = np.concatenate([self.first, base + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.known.update(zip(words, range(n, n + len(words))))

    def ids(self, codes: np.ndarray, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in a row, given as codes into distinct values, and where each piece's ids start."""
        if len(self.known) > REMEMBERED:
            self._reset()
        words = values.to_pylist()
        known = self.known
        fresh = [w for w in words if w not in known]
        if fresh:
            self._learn(fresh)
        place = np.fromiter((known[w] for w in words), np.int64, len(words))
        of_word = place[codes] if len(codes) else np.zeros(0, np.int64)
        count = self.count[of_word]
        return self.flat[spread(count, self.first[of_word])], np.concatenate([[0], np.cumsum(count)])


class WordBpe(Pieces):
    """Encoder for one vocabulary file; use `load`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(Tokenizer.from_file(path))
        self.exact = self._checked()
        if self.exact:
            self.learner = self._short()

    def _short(self):
        """The library's model without normaliser and splitter, which find nothing to do in a piece; the whole one if ids of sample pieces differ."""
        from tokenizers import Tokenizer, pre_tokenizers

        short = Tokenizer.from_str(self.tok.to_str())
        short.normalizer = None
        short.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        plain = [chr(c).lower() for c in range(TABLE) if not self.odd[c] and self.kind[c] != SPACE]
        letters = [c for c in plain if self.kind[ord(c)] == LETTER]
        pieces = plain + [a + b for a, b in zip(letters, letters[7:] + letters[:7])] + ["the", "internationalisation", "größenordnung", "señalización", "œuvre", "...", "!?--", "7"]
        same = lambda t: (lambda e: (e.ids, e.word_ids))(t.encode(pieces, is_pretokenized=True, add_special_tokens=False))
        return short if same(short) == same(self.tok) else self.tok

    def _checked(self) -> bool:
        """Fills the tables; False if this vocabulary doesn't split by the classes used here."""
        norm, pre = self.tok.normalizer, self.tok.pre_tokenizer
        self.kind, self.odd = np.zeros(TABLE, np.uint8), np.zeros(TABLE, bool)
        if norm is None or pre is None:
            return False
        for c in range(TABLE):
            ch = chr(c)
            low = norm.normalize_str(ch)
            quick = pc.utf8_lower(pa.scalar(ch)).as_py()
            n = len(pre.pre_tokenize_str(norm.normalize_str(f"a{ch}a")))
            two = len(pre.pre_tokenize_str(norm.normalize_str(ch * 2)))
            self.kind[c] = LETTER if n == 1 else SPACE if n == 2 else OTHER if two == 1 else DIGIT
            blank = self.kind[c] == SPACE
            self.odd[c] = (not blank and (low != quick or len(low) != 1 or ord(low) >= TABLE)) or (blank and low not in (" ", "")) or c == 0x27 or (blank and two)
        # the assumption that the pieces of a run are as the classes say, on a mixed sample
        sample = "Ab12 cd.,;x9_z\t- (q)é7ß¿ \nEnd"
        pieces = len(pre.pre_tokenize_str(norm.normalize_str(sample)))
        return pieces == len(self._pieces(pa.array([sample], pa.large_string()))[0])

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        low = pc.utf8_lower(texts)
        data, off = buffer_of(low)
        kind = self.kind[:256][data]
        lead = np.flatnonzero(data >= 0xC2)
        if len(lead):
            cp = ((data[lead].astype(np.int32) & 0x1F) << 6) | (data[lead + 1] & 0x3F)
            kind[lead] = self.kind[cp]
            kind[lead + 1] = kind[lead]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        new = np.empty(len(data), bool)
        new[:1] = True
        new[1:] = kind[1:] != kind[:-1]
        new |= edge[:-1] | (kind == DIGIT)
        kept = kind != SPACE
        new &= kept
        if len(lead):
            new[lead + 1] = False
        starts = np.flatnonzero(new)
        filled = np.cumsum(kept)
        # a piece ends where the next begins, or before the blanks in between
        begun = filled[starts] - 1
        lengths = np.diff(np.append(begun, filled[-1] if len(filled) else 0))
        codes, values = distinct_words(words_array(data, kept, lengths))
        return codes, values, np.searchsorted(starts, off)

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Texts that only the library can encode exactly."""
        data, off = buffer_of(texts)
        bad = data >= 0xCC
        ascii_odd = np.zeros(256, bool)
        ascii_odd[:0x80] = self.odd[:0x80]
        bad |= ascii_odd[data]
        lead = np.flatnonzero((data >= 0xC2) & (data < 0xCC))
        if len(lead):
            cp = ((data[lead].astype(np.int32) & 0x1F) << 6) | (data[lead + 1] & 0x3F)
            bad[lead[self.odd[cp]]] = True
        if len(data) > 1:
            bad[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        return np.unique(np.searchsorted(off, np.flatnonzero(bad), "right") - 1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (unsigned 32 bit), and where each text's ids start."""
        whole = self._whole(texts) if self.exact else np.arange(len(texts))
        slow: dict[int, np.ndarray] = {}
        if len(whole):
            for i, e in zip(whole.tolist(), self.tok.encode_batch_fast([texts[int(i)].as_py() for i in whole], add_special_tokens=False)):
                slow[i] = np.asarray(e.ids, np.uint32)
            mask = np.zeros(len(texts), bool)
            mask[whole] = True
            texts = pc.if_else(pa.array(mask), pa.scalar("", texts.type), texts)
        codes, values, word_off = self._pieces(texts)
        ids, ends = self.ids(codes, values)
        off = ends[word_off]
        if not slow:
            return ids, off
        parts = [slow.get(i, ids[off[i] : off[i + 1]]) for i in range(len(texts))]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])

    def encode_ended(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode, with the end id after each text's ids."""
        ids, off = self.encode(texts)
        out = np.insert(ids, off[1:], np.uint32(end))
        return out, off + np.arange(len(off))


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    """The encoder of a vocabulary file, one per worker process."""
    return WordBpe(path)
