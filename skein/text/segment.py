"""Blocks and sentences with verifiable offsets."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

SEGMENTATION_VERSION = "1.0"
_BLOCK = re.compile(r" {2,}|[·•]+|\n+")
_STOP = re.compile(r"[.!?]+(?=[\s\"')\]]*(?:\s|$))|(?<=[0-9A-Za-z)])\.(?=\s*[A-Z][a-z])|(?<=[a-z])\.(?=[0-9])")
_ABBREVIATED = re.compile(r"\b(?:Dr|Mr|Mrs|Ms|Prof|vs|e\.g|i\.e|approx|No|Fig|St)$")
#: Characters of the longest abbreviation, and one before it.
_ABBREVIATION = 7
_SOME = re.compile(r"[^\W_]")
SENTENCES = "array<struct<text:string,char_start:int,char_end:int>>"


def blocks(text: str, base: int = 0) -> list[tuple[int, int]]:
    """Offsets of the parts between runs of two or more spaces, bullets or line ends; blank parts are left out."""
    out, at = [], 0
    for m in [*_BLOCK.finditer(text), None]:
        end = m.start() if m else len(text)
        if text[at:end].strip():
            out.append((base + at, base + end))
        at = m.end() if m else at
    return out


def sentences(text: str | None) -> list[tuple[str, int, int]]:
    """(sentence, start, end), trimmed; parts without a letter or digit are left out."""
    out = []
    for s, e in blocks(text or ""):
        cuts, at = [], s
        for m in _STOP.finditer(text, s, e):
            if not _ABBREVIATED.search(text, max(s, m.start() - _ABBREVIATION), m.start()) or m.end() == e:
                cuts.append(m.end())
        for end in [*cuts, e]:
            if _SOME.search(text, at, end):
                piece = text[at:end]
                whole = piece.strip()
                a = at + len(piece) - len(piece.lstrip())
                out.append((whole, a, a + len(whole)))
            at = end
    return out


def lossless(text: str) -> list[str]:
    """Sentences and what stands between them, in turn; joined they are the text."""
    return re.split(r"((?<=[.!?])\s+(?=[A-ZÇĞİÖŞÜ]))", text)


def sentence_spans(text: Column) -> Column:
    """The sentences of each text."""

    @F.pandas_udf(SENTENCES)
    def cut(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: [{"text": t, "char_start": s, "char_end": e} for t, s, e in sentences(x)])

    return cut(text)


def section_offsets(findings: Column, impression: Column) -> tuple[Column, Column]:
    """Where each section begins in the text of both, parted by an empty line; null for an empty section."""
    has = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    first = F.when(has(findings), 0)
    return first, F.when(has(impression), F.when(has(findings), F.length(findings) + 2).otherwise(0))


def explode_sentences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row a sentence: key, sent_idx from 0, text, offsets and version. Null texts have none."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = [sentences(x) for x in batch.column(1).to_pylist()]
            counts = [len(x) for x in found]
            flat = [x for some in found for x in some]
            place = pa.array([i for i, n in enumerate(counts) for _ in range(n)], pa.int64())
            idx = pa.array([k for n in counts for k in range(n)], pa.int32())
            words, start, end = zip(*flat) if flat else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(place), idx, pa.array(words, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], [key, "sent_idx", "text", "char_start", "char_end"])

    rows = docs.select(key, F.col(text).cast("string").alias("__text"))
    x = rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, sent_idx int, text string, char_start int, char_end int")
    return x.withColumn("segmentation_version", F.lit(SEGMENTATION_VERSION))


def offset_errors(sentences: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Sentences whose text isn't the slice that their offsets name."""
    d = docs.select(key, F.col(text).alias("__whole"))
    return sentences.join(d, key).where(F.expr("substring(__whole, char_start + 1, char_end - char_start) <> text")).drop("__whole")
