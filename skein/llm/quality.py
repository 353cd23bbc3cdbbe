"""Quality: histogram gradient-boosted trees over statistics of a document.

Each text becomes a row of numbers (shares of character classes, lengths of
words and lines, how often words, word pairs and lines repeat). Trees are grown
on histograms of at most BINS quantile bins, with the second-order gain of the
logistic loss, and flattened into arrays, so that scoring walks all trees of all
documents with a few numpy gathers a level.

The trees are fitted on a bounded sample of labelled documents (BOUNDS); every
document is scored, whole. Null and empty texts have statistics of zero and are
scored as such. Repeated rows score alike. Extra columns are ignored, rows with
null ids are kept. With labels of one kind only, that kind's score is 1 or 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship, table
from .labelled import remainder, sample
from .lexing import BLANK, buffer_of, chunks, distinct_words, runs, words_array

FOLDS, HELD = 3, 1
#: Documents of each label that the trees are fitted on at most.
BOUNDS = {1: 10_000, 0: 10_000}
TREES, DEPTH, BINS, RATE, LAMBDA, LEAST_HESSIAN = 80, 4, 64, 0.15, 1.0, 2.0


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode())] = True
    return t


_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _table("abcdefghijklmnopqrstuvwxyz")
_LETTER[0x80:] = True
_DIGIT = _table("0123456789")
_STOP = _table(".!?")
_POINT = _table(".,;:'\"()-!?")
_MARK = ~(_LETTER | _DIGIT | _POINT | BLANK)
_LINE = _table("\n")
#: Classes of bytes whose shares are statistics.
SHARES = {"upper": _UPPER, "letter": _LETTER, "beyond_ascii": np.arange(256) >= 0x80, "digit": _DIGIT, "stop": _STOP, "point": _POINT, "mark": _MARK, "blank": BLANK, "line": _LINE, "bar": _table("|"), "shout": _table("!")}
STATISTICS = [
    *(f"share_{k}" for k in SHARES), "log_bytes", "log_words", "word_mean", "word_spread", "word_longest", "words_without_letter", "words_with_mark", "words_shouted",
    "words_distinct", "word_most", "word_entropy", "pairs_distinct", "pair_most", "line_mean", "lines_distinct", "line_bytes_again", "line_most",
]


def _share(a, b):
    return np.where(b > 0, a / np.maximum(b, 1), 0.0)


def _repeats(owner: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each owner how many distinct codes it has, how often its commonest occurs, and the sum of c * log(c)."""
    if not len(owner):
        return np.zeros(n), np.zeros(n), np.zeros(n)
    key, count = np.unique((owner.astype(np.uint64) << np.uint64(40)) | code.astype(np.uint64), return_counts=True)
    who = (key >> np.uint64(40)).astype(np.int64)
    first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
    most = np.zeros(n)
    most[who[first]] = np.maximum.reduceat(count, first)
    return np.bincount(who, minlength=n).astype(float), most, np.bincount(who, count * np.log(count), n)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text."""
    data, off = buffer_of(texts)
    n, size = len(texts), np.diff(off).astype(float)

    def per_text(mask):
        c = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return np.diff(c[off]).astype(float), c

    cols = []
    for mask in SHARES.values():
        cols.append(_share(per_text(mask[data])[0], size))
    kept = ~BLANK[data]
    starts, ends = runs(kept, off)
    codes, _ = distinct_words(words_array(data, kept, ends - starts))
    owner = np.searchsorted(off, starts, "right") - 1
    length = (ends - starts).astype(float)
    words = np.bincount(owner, minlength=n).astype(float)
    total = lambda x: np.bincount(owner, x, n)
    letters, marks, upper = (np.diff(c[np.stack([starts, ends])], axis=0)[0] for c in (per_text(_LETTER[data])[1], per_text(_MARK[data])[1], per_text(_UPPER[data])[1]))
    mean = _share(total(length), words)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    cols += [np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(0, _share(total(length * length), words) - mean * mean)), np.log1p(longest)]
    cols += [_share(total(letters == 0), words), _share(total(marks > 0), words), _share(total((upper == letters) & (letters > 1)), words)]
    distinct, most, clogc = _repeats(owner, codes, n)
    cols += [_share(distinct, words), _share(most, words), np.log(np.maximum(words, 1)) - _share(clogc, words)]
    same = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
    pair = (codes[:-1].astype(np.uint64) * np.uint64(0x9E3779B1) + codes[1:].astype(np.uint64) * np.uint64(0x85EBCA77))[same] & np.uint64((1 << 40) - 1)
    distinct, most, _ = _repeats(owner[1:][same], pair, n)
    pairs = np.maximum(words - 1, 0)
    cols += [_share(distinct, pairs), _share(most, pairs)]
    full = ~_LINE[data]
    starts, ends = runs(full, off)
    codes, _ = distinct_words(words_array(data, full, ends - starts))
    owner = np.searchsorted(off, starts, "right") - 1
    lines = np.bincount(owner, minlength=n).astype(float)
    distinct, most, _ = _repeats(owner, codes, n)
    length = (ends - starts).astype(float)
    if len(owner):
        _, first, back, count = np.unique((owner.astype(np.uint64) << np.uint64(40)) | codes.astype(np.uint64), return_index=True, return_inverse=True, return_counts=True)
        again = (np.arange(len(owner)) != first[back]) & (count[back] > 1)
    else:
        again = np.zeros(0, bool)
    cols += [_share(np.bincount(owner, length, n), lines), _share(distinct, lines), _share(np.bincount(owner, length * again, n), size), _share(most, lines)]
    return np.stack(cols, axis=1)


@dataclass
class Forest:
    """Trees flattened into arrays; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of each row."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 of each row."""
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _grow(binned, edges, g, h, nodes) -> np.ndarray:
    """Adds one tree to the node lists, level by level; returns each row's value."""
    feature, threshold, left, right, value = nodes
    n, d = binned.shape
    out = np.zeros(n)

    def leaf(rows):
        feature.append(0)
        threshold.append(np.inf)
        left.append(len(value))
        right.append(len(value))
        value.append(float(-g[rows].sum() / (h[rows].sum() + LAMBDA)) * RATE)
        return len(value) - 1

    level = [(leaf(np.arange(n)), np.arange(n))]
    for _ in range(DEPTH):
        below = []
        for node, rows in level:
            b = binned[rows] + np.arange(d) * BINS
            hist = lambda w, b=b: np.bincount(b.ravel(), np.repeat(w, d), d * BINS).reshape(d, BINS).cumsum(axis=1)
            gl, hl = hist(g[rows]), hist(h[rows])
            gt, ht = gl[0, -1], hl[0, -1]
            gain = gl**2 / (hl + LAMBDA) + (gt - gl) ** 2 / (ht - hl + LAMBDA) - gt**2 / (ht + LAMBDA)
            gain[(hl < LEAST_HESSIAN) | (ht - hl < LEAST_HESSIAN)] = -1
            f, k = divmod(int(gain.argmax()), BINS)
            if gain[f, k] <= 1e-6 or k >= len(edges[f]):
                continue
            go = binned[rows, f] <= k
            a, b2 = rows[go], rows[~go]
            la, lb = leaf(a), leaf(b2)
            feature[node], threshold[node], left[node], right[node], value[node] = f, float(edges[f][k]), la, lb, 0.0
            below += [(la, a), (lb, b2)]
        level_done = [x for x in level if left[x[0]] == x[0]]
        for node, rows in level_done:
            out[rows] = value[node]
        level = below
    for node, rows in level:
        out[rows] = value[node]
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """A forest for labels 0 and 1."""
    if len(y) == 0 or y.min() == y.max():
        constant = 0.0 if len(y) == 0 else 40.0 * (2 * float(y[0]) - 1)
        return Forest(np.zeros(1, int), np.array([np.inf]), np.zeros(1, int), np.zeros(1, int), np.zeros(1), np.zeros(1, int), constant, 0)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin, nodes, roots = np.full(len(y), base), ([], [], [], [], []), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(len(nodes[0]))
        margin += _grow(binned, edges, p - y, p * (1 - p), nodes)
    feature, threshold, left, right, value = map(np.array, nodes)
    return Forest(feature, threshold, left, right, value, np.array(roots), base, DEPTH)


def with_statistics(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns with `__x`, the statistics of the text."""
    ship(docs.sparkSession)
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string").alias("text"))
    out = T.StructType([*(docs.schema[c] for c in keep), T.StructField("__x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                x = statistics(texts)
                col = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), col], [*keep, "__x"])

    return rows.mapInArrow(run, out)


def train(docs: DataFrame, labels: DataFrame) -> Forest:
    """A forest from the labelled rows outside the held-out fold."""
    chosen = sample(docs, labels, "quality", FOLDS, HELD, BOUNDS)
    rows = with_statistics(chosen, ("doc_id", "label")).toArrow().sort_by([("doc_id", "ascending")])
    x = rows.column("__x").combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS)) if rows.num_rows else np.zeros((0, len(STATISTICS)))
    return fit(x, rows.column("label").to_numpy().astype(float))


def score(docs: DataFrame, forest: Forest, into: str = "score") -> DataFrame:
    """All columns of docs with the score of `text` in a new column; one pass, no shuffle."""
    ship(docs.sparkSession)
    out = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())])

    def run(batches):
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(forest.score(statistics(texts)))], [*part.schema.names, into])

    return docs.mapInArrow(run, out)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    scored = score(rows, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
