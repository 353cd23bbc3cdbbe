"""Toxicity as a multiple-instance problem: a document is a bag of sentences.

A sentence's chance of being offensive is a logistic function of its words and
their stems; a document's is the noisy-or of its sentences, 1 - prod(1 - p). The
weights are learnt from document labels alone, by gradient ascent on the
documents' log-likelihood, and then point out the offending sentences.

The weights are fitted on a bounded sample of labelled documents (BOUNDS, of at
most LONGEST characters each); every document is scored, whole. Null and empty
texts have no sentence and score 0. Repeated rows score alike. Extra columns are
ignored, rows with null ids are kept. Without any toxic or any clean label every
score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settled, ship, table
from .labelled import remainder, sample
from .lexing import buffer_of, chunks, distinct_words, runs, spread, words_array

FOLDS, HELD = 5, 0
#: Documents of each label, and characters of one, that the weights are fitted on at most.
BOUNDS = {1: 2000, 0: 4000}
LONGEST = 20_000
#: Bytes of the stems of a word that count beside the word itself.
STEMS = range(3, 9)
#: A feature must be in so many documents of the sample; of the surest, so many for each toxic document are used, and at most so many.
LEAST_DOCS, PER_TOXIC, FEATURES = 4, 5, 3000
STEPS, RATE, DECAY = 400, 0.1, 2e-5

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_STOP = np.zeros(256, bool)
_STOP[[0x0A, 0x21, 0x2E, 0x3F]] = True


@dataclass
class Bags:
    """Words of sentences of texts: `codes` into `words`, the sentence of each word, the text of each sentence."""

    codes: np.ndarray
    words: pa.Array
    sentence: np.ndarray
    text: np.ndarray
    starts: np.ndarray  # of sentences, in bytes of the lower-cased buffer
    ends: np.ndarray
    n_texts: int


def bags(texts: pa.Array) -> Bags:
    """Cuts texts into sentences (at full stops, ! ? and line ends) and words (runs of letters and digits, lower case).

    A sentence without a word is none.
    """
    low = pc.utf8_lower(texts)
    data, off = buffer_of(low)
    kept = _WORD[data]
    quote = np.flatnonzero((data[:-2] == 0xE2) & ((data[1:-1] == 0x80) | (data[1:-1] == 0x81))) if len(data) > 2 else np.zeros(0, np.int64)
    for k in range(3):  # general punctuation beyond ASCII isn't part of words
        kept[quote + k] = False
    starts, ends = runs(kept, off)
    codes, words = distinct_words(words_array(data, kept, ends - starts))
    stops = np.cumsum(_STOP[data])
    text = np.searchsorted(off, starts, "right") - 1
    # a sentence is what no stop and no beginning of a text parts
    part = stops[starts] + text if len(starts) else np.zeros(0, np.int64)
    new = np.ones(len(part), bool)
    new[1:] = part[1:] != part[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(part)) - 1 if len(part) else first
    return Bags(codes, words, np.cumsum(new) - 1, text[first], starts[first], ends[last] if len(part) else starts[:0], len(texts))


def noisy_or(chance: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """1 - prod(1 - p) over the sentences of each text; 0 without any."""
    return -np.expm1(np.bincount(text, np.log1p(-np.minimum(chance, 1 - 1e-9)), n)) if len(text) else np.zeros(n)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def features(word: bytes) -> list[bytes]:
    """What a word counts as: itself, and the stems it begins with."""
    return [b"=" + word, *(word[:k] for k in STEMS if k < len(word))]


@dataclass
class Model:
    """Feature weights and the bias of a sentence."""

    weights: dict[bytes, float]
    bias: float

    def _weight(self, word: bytes) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(word))

    def sentences(self, b: Bags) -> np.ndarray:
        """The chance of each sentence."""
        of_word = np.fromiter(map(self._weight, b.words.to_pylist()), float, len(b.words))
        return _sigmoid(self.bias + np.bincount(b.sentence, of_word[b.codes], len(b.text))) if len(b.text) else np.zeros(0)

    def texts(self, texts: pa.Array) -> np.ndarray:
        """The score of each text."""
        if not self.weights:
            return np.zeros(len(texts))
        b = bags(texts)
        return noisy_or(self.sentences(b), b.text, b.n_texts)


def _pairs(owner: np.ndarray, codes: np.ndarray, of_word: list[list[int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, feature) pairs; of_word has the features (below n) of each distinct word."""
    count = np.fromiter(map(len, of_word), np.int64, len(of_word))
    flat = np.fromiter((f for fs in of_word for f in fs), np.int64, int(count.sum()))
    first = np.cumsum(count) - count
    times = count[codes]
    key = np.unique(np.repeat(owner, times) * n + flat[spread(times, first[codes])]) if n else np.zeros(0, np.int64)
    return key // max(n, 1), key % max(n, 1)


def chosen_features(rows: DataFrame) -> list[str]:
    """Features (as hex) that occur in more toxic documents than their frequency lets expect, the surest first.

    They are ranked, not held to a level that only many labels reach.
    """

    def run(batches):
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                label = part.column(part.schema.get_field_index("label")).to_numpy(zero_copy_only=False)
                b = bags(texts)
                known: dict[bytes, int] = {}
                of_word = [[known.setdefault(f, len(known)) for f in features(w)] for w in b.words.to_pylist()]
                text, feature = _pairs(b.text[b.sentence].astype(np.int64), b.codes, of_word, len(known))
                n = np.bincount(feature, minlength=len(known))
                toxic = np.bincount(feature, label[text], len(known)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.binary()), pa.array(n), pa.array(toxic)], ["feature", "n", "toxic"])

    total = rows.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    if not total.n or not total.toxic or total.toxic == total.n:
        return []
    r = total.toxic / total.n
    counted = rows.mapInArrow(run, "feature binary, n bigint, toxic bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    z = (F.col("toxic") - F.col("n") * r) / F.sqrt(F.col("n") * r * (1 - r))
    return [x.f for x in counted.where(F.col("n") >= LEAST_DOCS).withColumn("z", z).where("z > 0").select("z", F.hex("feature").alias("f")).orderBy(F.desc("z"), "f").limit(min(FEATURES, PER_TOXIC * int(total.toxic))).collect()]


def fit(sent: np.ndarray, feature: np.ndarray, text: np.ndarray, y: np.ndarray, k: int, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights of k features and a bias, by gradient ascent (Adam) on the noisy-or likelihood of document labels.

    sent and feature: the features of sentences; text: the document of each sentence; y: the label of each document.
    """
    n, s = len(y), len(text)
    w, bias = np.zeros(k), -4.0
    m, q, mb, qb = np.zeros(k), np.zeros(k), 0.0, 0.0
    for step in range(1, steps + 1):
        p = _sigmoid(bias + np.bincount(sent, w[feature], s))
        score = np.clip(noisy_or(p, text, n), 1e-7, 1 - 1e-7)
        # d log-likelihood / d z of a sentence: -p for a clean text, p (1 - P) / P for a toxic one
        d = np.where(y == 1, (1 - score) / score, -1.0)[text] * p
        g, gb = np.bincount(feature, d[sent], k) / n - DECAY * w, d.sum() / n
        m, q = 0.9 * m + 0.1 * g, 0.99 * q + 0.01 * g * g
        mb, qb = 0.9 * mb + 0.1 * gb, 0.99 * qb + 0.01 * gb * gb
        a, c = 1 - 0.9**step, 1 - 0.99**step
        w += RATE * (m / a) / (np.sqrt(q / c) + 1e-6)
        bias += RATE * (mb / a) / ((qb / c) ** 0.5 + 1e-6)
    return w, bias


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled rows outside the held-out fold."""
    ship(docs.sparkSession)
    rows = settled(sample(docs, labels, "toxic", FOLDS, HELD, BOUNDS).where(F.length("text") <= LONGEST), "toxic-sample")
    chosen = [bytes.fromhex(f) for f in chosen_features(rows)]
    if not chosen:
        return Model({}, 0.0)
    place = {f: i for i, f in enumerate(chosen)}

    def run(batches):
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                b = bags(texts)
                of_word = [[place[f] for f in features(w) if f in place] for w in b.words.to_pylist()]
                sent, feature = _pairs(b.sentence.astype(np.int64), b.codes, of_word, len(place))
                first = np.searchsorted(b.text, np.arange(len(texts) + 1))  # of each text's sentences
                cut = np.searchsorted(sent, first).astype(np.int32)
                of_text = b.text[sent] if len(sent) else sent
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("doc_id")), part.column(part.schema.get_field_index("label")), pa.array(np.diff(first).astype(np.int32)), pa.ListArray.from_arrays(cut, pa.array((sent - first[of_text]).astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(feature.astype(np.int32)))],
                    ["doc_id", "label", "sentences", "sent", "feature"],
                )

    got = rows.mapInArrow(run, "doc_id bigint, label int, sentences int, sent array<int>, feature array<int>").toArrow().sort_by([("doc_id", "ascending")])
    n = got.column("sentences").to_numpy().astype(np.int64)
    y = got.column("label").to_numpy().astype(float)
    sent = got.column("sent").combine_chunks()
    per = np.diff(sent.offsets.to_numpy())
    w, bias = fit(sent.flatten().to_numpy() + np.repeat(np.cumsum(n) - n, per), got.column("feature").combine_chunks().flatten().to_numpy(), np.repeat(np.arange(len(n)), n), y, len(chosen))
    return Model({f: float(x) for f, x in zip(chosen, w.tolist()) if abs(x) > 1e-3}, float(bias))


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """All columns of docs with the score of `text` in a new column; one pass, no shuffle."""
    ship(docs.sparkSession)
    out = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())])

    def run(batches):
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.texts(texts))], [*part.schema.names, into])

    return docs.mapInArrow(run, out)


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, score, sentences): the offending sentences of each document, as code-point spans with their chances."""
    ship(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                b = bags(texts)
                p = model.sentences(b) if model.weights else np.zeros(len(b.text))
                data, off = buffer_of(pc.utf8_lower(texts))
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                spans: list[list] = [[] for _ in range(len(texts))]
                for i in np.flatnonzero(p >= least).tolist():
                    t = int(b.text[i])
                    spans[t].append({"start": int(points[b.starts[i]] - points[off[t]]), "end": int(points[b.ends[i]] - points[off[t]]), "score": float(p[i])})
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(noisy_or(p, b.text, b.n_texts)), pa.array(spans, kind)], ["doc_id", "score", "sentences"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double, sentences array<struct<start:bigint,end:bigint,score:double>>")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document and how many of its sentences offend."""
    docs = table(spark, sf_dir, "documents")
    found = locate(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (remainder("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("sentences").cast("long").alias("n_offending"))
