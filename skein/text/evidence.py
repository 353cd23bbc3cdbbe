"""Evidence of findings in free text: mentions with their region, time, negation and what is said around them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F

#: Characters around a mention in which words count; fixed values: for a benign remark on either side, for a remark on
#: spread on either side, for a hedge before and after, for a suspicion before and after.
BENIGN, SPREAD, HEDGE, SUSPICION = 120, 60, (70, 30), (40, 80)
#: Characters between a negation and its term, at most; fixed value.
REACH = 120


@dataclass(frozen=True)
class EvidenceLexicon:
    """Patterns: kinds of mentions, regions, times in order of priority, and the words that change a mention's meaning."""

    kinds: dict[str, str]
    regions: dict[str, str]
    times: dict[str, str]
    negation: str
    breaker: str
    benign: str
    hedge: str
    suspicion: str
    spread: str
    ignored: str = r"(?!)"
    now: str = "current"
    nowhere: str = "unknown"


class Collector:
    """Collects the evidence of texts; made once for each worker."""

    def __init__(self, lexicon: EvidenceLexicon):
        self.lexicon = lexicon
        one = lambda p: re.compile(p, re.I)
        self.kinds, self.regions, self.times = ({k: one(p) for k, p in d.items()} for d in (lexicon.kinds, lexicon.regions, lexicon.times))
        self.negation, self.breaker, self.benign, self.hedge, self.suspicion, self.spread, self.ignored = map(one, (lexicon.negation, lexicon.breaker, lexicon.benign, lexicon.hedge, lexicon.suspicion, lexicon.spread, lexicon.ignored))

    @staticmethod
    def sentences(text: str | None) -> list[str]:
        """Parts between full stops that stand apart, semicolons and a full stop at the end."""
        return [x.strip() for x in re.split(r" \. |\.\Z|;", re.sub(r"\s+", " ", (text or "").strip())) if x.strip()]

    def negated(self, sentence: str, at: int) -> bool:
        """Whether the place lies in the scope of the last negation before it."""
        end = max((m.end() for m in self.negation.finditer(sentence[:at])), default=None)
        return end is not None and at - end <= REACH and not self.breaker.search(sentence[end:at])

    def region(self, sentence: str, at: int) -> str:
        """The region whose word is nearest to the place; of equally near ones the first listed."""
        near = [(0 if m.start() <= at <= m.end() else min(abs(at - m.start()), abs(at - m.end())), i, m.start(), k) for i, (k, p) in enumerate(self.regions.items()) for m in p.finditer(sentence)]
        return min(near)[3] if near else self.lexicon.nowhere

    def time(self, sentence: str) -> str:
        """The first time class whose pattern the sentence meets."""
        return next((k for k, p in self.times.items() if p.search(sentence)), self.lexicon.now)

    def collect(self, text: str | None) -> list[dict]:
        """Evidence in the order of sentences, kinds and places."""
        out = []
        for n, sentence in enumerate(self.sentences(text)):
            clean, time = self.ignored.sub(lambda m: " " * len(m[0]), sentence), self.time(sentence)
            around = lambda a, b, m: clean[max(0, m.start() - a) : m.end() + b]
            for kind, pattern in self.kinds.items():
                for m in pattern.finditer(clean):
                    suspected = any(not self.negated(clean, x.start()) for x in self.suspicion.finditer(clean, max(0, m.start() - SUSPICION[0]), min(len(clean), m.end() + SUSPICION[1])))
                    out.append({
                        "sent_idx": n, "kind": kind, "term": m[0], "region": self.region(sentence, m.start()), "time": time, "negated": self.negated(clean, m.start()), "benign": bool(self.benign.search(around(BENIGN, BENIGN, m))),
                        "hedged": bool(self.hedge.search(around(*HEDGE, m))), "suspicious": suspected, "spread": bool(self.spread.search(around(SPREAD, SPREAD, m))),
                    })
        return out


EVIDENCE = "array<struct<sent_idx:int,kind:string,term:string,region:string,time:string,negated:boolean,benign:boolean,hedged:boolean,suspicious:boolean,spread:boolean>>"


def evidence(lexicon: EvidenceLexicon):
    """A column function from texts to their evidence; a null text has none."""

    @F.pandas_udf(EVIDENCE)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        collector = Collector(lexicon)
        for text in batches:
            yield text.map(collector.collect)

    return scan
