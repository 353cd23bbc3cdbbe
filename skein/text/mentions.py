"""Mentions of concepts in a sentence, their side, context and relations."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F

from .lexicon import Concept, Cue, Lexicon, union_matcher

#: Characters within which a side counts, the locatives before an anatomy, the phrases that refer to
#: another time, and those that single out the largest of several.
SIDE_WINDOW = 60
_LOCATIVE_BEFORE = re.compile(r"\b(?:in|within|at|on|into)\s+(?:\w+[\s-]+){0,3}$", re.I)
_LOCATIVE = re.compile(r"\b(?:in|within|at|on|into|inside)\b", re.I)
TIME_REFERENCES = ("previous", "previously", "prior", "former", "control", "follow-up", "followup", "compared to", "compared with", "current examination", "old CT", "old examination", "newly", "in comparison")
LARGEST = ("largest of which", "the largest", "biggest of which")
_TIME_REFERENCE = re.compile(r"\b(?:" + "|".join(map(re.escape, TIME_REFERENCES)) + r")\b", re.I)
_LARGEST = re.compile("|".join(map(re.escape, LARGEST)), re.I)


@dataclass
class Mention:
    """A mention: the concept and its place."""

    concept: str
    kind: str
    start: int
    end: int
    text: str
    takes_side: bool = False


def _merged(found: list[Mention], sentence: str) -> list[Mention]:
    out: list[Mention] = []
    for m in found:
        last = out[-1] if out else None
        if last and last.concept == m.concept and sentence[last.end : m.start] in (" ", "-", ""):
            out[-1] = Mention(m.concept, m.kind, last.start, m.end, sentence[last.start : m.end], m.takes_side)
        else:
            out.append(m)
    return out


class Engine:
    """Scans sentences with one lexicon; made once for each worker."""

    def __init__(self, lexicon: Lexicon):
        self.matcher, self.entries = union_matcher(lexicon.concepts)
        self.cues: list[tuple[Cue, re.Pattern]] = [(c, re.compile("|".join(rf"\b(?:{p})" + ("" if c.direction == "attached" else r"\b") for p in c.patterns), re.I)) for c in lexicon.cues]
        self.stop = re.compile("|".join(rf"\b(?:{p})\b" if p[:1].isalnum() else p for p in lexicon.terminators), re.I) if lexicon.terminators else None
        self.sides = [(re.compile(rf"\b(?:{p})\b", re.I), side) for p, side in lexicon.sides.items()]

    def mentions(self, sentence: str) -> list[Mention]:
        """Leftmost non-overlapping mentions; neighbours of one concept are one."""
        found = []
        for m in self.matcher.finditer(sentence):
            c: Concept = self.entries[int(m.lastgroup[1:])]
            found.append(Mention(c.name, c.kind, m.start(), m.end(), m[0], c.takes_side))
        return _merged(found, sentence)

    def side(self, m: Mention, sentence: str) -> str | None:
        """The nearest side within the window; one inside counts as nearest of all, the left one at equal distance."""
        best = None
        for pattern, name in self.sides:
            for x in pattern.finditer(sentence):
                inside = m.start <= x.start() and x.end() <= m.end
                gap = 0 if inside else max(m.start - x.end(), x.start() - m.end, 0)
                rank = (gap, x.start() >= m.end, x.start())
                if gap <= SIDE_WINDOW and (best is None or rank < best[0]):
                    best = rank, name
        return best[1] if best else None

    def found_cues(self, sentence: str) -> list[tuple[Cue, int, int, int, int]]:
        """(cue, start, end, scope start, scope end), by lexicon order, then place."""
        stops = [x.span() for x in self.stop.finditer(sentence)] if self.stop else []
        out = []
        for cue, pattern in self.cues:
            for m in pattern.finditer(sentence):
                ahead = min((s for s, _ in stops if s >= m.end()), default=len(sentence))
                back = max((e for _, e in stops if e <= m.start()), default=0)
                lo = back if cue.direction in ("backward", "both") else m.start()
                hi = ahead if cue.direction in ("forward", "both") else m.end()
                out.append((cue, m.start(), m.end(), lo, hi))
        return out

    def assertion(self, m: Mention, sentence: str, cues, every: list[Mention]) -> tuple[str, str, str | None]:
        """(assertion, rule, cue): priority uncertainty, negation, uncertainty, inference, then present."""
        of = lambda section: [x for x in cues if x[0].section == section]
        covers = lambda x: x[3] <= m.start and m.end <= x[4]
        meets = lambda a, b: a[1] < b[2] and b[1] < a[2]
        for x in of("priority_uncertain"):
            if covers(x):
                return "uncertain", f"priority:{x[0].name}", sentence[x[1] : x[2]]
        blocked = of("pseudo_negation") + of("priority_uncertain")
        technical = of("technical")
        for section, result in (("negation", "absent"), ("uncertain", "uncertain"), ("inference", "present")):
            for x in of(section):
                if section == "negation":
                    if any(t[1] <= x[1] and x[2] <= t[2] for t in technical) or any(meets(x, b) for b in blocked):
                        continue
                reach = x[2] == m.start if x[0].direction == "attached" else covers(x)
                if reach and not (section != "inference" and m.kind == "anatomy" and self._kept(m, x, sentence, every)):
                    return x[0].result or result, f"{section}:{x[0].name}", sentence[x[1] : x[2]]
        return "present", "default", None

    @staticmethod
    def _kept(m: Mention, x, sentence: str, every: list[Mention]) -> bool:
        """An anatomy isn't itself negated if the scope has a finding too, or a locative stands before it in the scope."""
        if any(o.kind != "anatomy" and x[3] <= o.start and o.end <= x[4] for o in every):
            return True
        return bool(_LOCATIVE.search(sentence, x[3], m.start))

    def time(self, m: Mention, sentence: str, cues) -> tuple[str, str | None, str, str | None]:
        """(temporality, cue, change, cue)."""
        covers = lambda x: x[3] <= m.start and m.end <= x[4]
        near = [(abs(x[1] - m.start), i, x) for i, x in enumerate(cues) if x[0].section in ("prior", "current") and covers(x)]
        when, when_cue = ("current", None) if not near else (lambda x: (x[0].section, sentence[x[1] : x[2]]))(min(near)[2])
        for x in cues:
            if x[0].section == "pseudo_negation" and covers(x):
                return when, when_cue, "stable", sentence[x[1] : x[2]]
        for x in cues:
            if x[0].section == "change" and covers(x) and not (x[0].needs_time and not _TIME_REFERENCE.search(sentence)):
                return when, when_cue, x[0].result or "unknown", sentence[x[1] : x[2]]
        return when, when_cue, "unknown" if any(x[0].section in ("prior", "current") for x in cues) else "none", None

    @staticmethod
    def _closest(m: Mention, others: list[tuple[int, int, int]], right_on_tie: bool) -> tuple[int | None, bool]:
        """(place in the list, tie) of the nearest of (start, end, place)."""
        ranked = sorted((max(s - m.end, m.start - e, 0), 0 if not right_on_tie or s >= m.start else 1, i) for s, e, i in others)
        if not ranked:
            return None, False
        if len(ranked) > 1 and ranked[0][:2] == ranked[1][:2]:
            return None, True
        return ranked[0][2], False

    def relations(self, sentence: str, found: list[Mention], measures: list[dict]) -> tuple[list[dict], list[dict]]:
        """(relations, unresolved): located_at, modify and measured_by, by places in the lists."""
        edges, open_ = [], []
        spans = lambda kinds: [(m.start, m.end, i) for i, m in enumerate(found) if m.kind in kinds]

        def link(head, kind, rule, targets, right, m):
            at, tie = self._closest(m, targets, right)
            if at is None:
                open_.append({"head": head, "relation": kind, "reason": "tie" if tie else "no_candidate"})
            else:
                edges.append({"head": head, "tail": at, "relation": kind, "rule": rule})

        for i, m in enumerate(found):
            if m.kind in ("observation", "device"):
                link(i, "located_at", "nearest_anatomy", spans({"anatomy"}), False, m)
            elif m.kind == "qualifier":
                target = spans({"observation", "device"}) or spans({"anatomy"})
                link(i, "modify", "nearest", target, True, m)
        for j, x in enumerate(measures):
            here = Mention("", "measurement", x["char_start"], x["char_end"], "")
            targets = spans({"observation", "device"})
            rule = "nearest_observation"
            if not targets:
                targets = [(s, e, i) for s, e, i in spans({"anatomy"}) if not _LOCATIVE_BEFORE.search(sentence[:s])] or spans({"anatomy"})
                rule = "nearest_anatomy"
            at, tie = self._closest(here, targets, True)
            if at is None:
                open_.append({"head": -1 - j, "relation": "measured_by", "reason": "tie" if tie else "no_candidate"})
            else:
                largest = _LARGEST.search(sentence[: x["char_start"]])
                edges.append({"head": at, "tail": -1 - j, "relation": "measured_by", "rule": "largest_of_which" if largest else rule})
        return edges, open_

    def annotate(self, sentence: str) -> list[dict]:
        """Mentions with side, assertion and time."""
        every, cues = self.mentions(sentence), self.found_cues(sentence)
        out = []
        for m in every:
            a, rule, cue = self.assertion(m, sentence, cues, every)
            when, when_cue, change, change_cue = self.time(m, sentence, cues)
            out.append({"concept": m.concept, "kind": m.kind, "char_start": m.start, "char_end": m.end, "raw_text": m.text, "laterality": self.side(m, sentence) if m.takes_side else None, "assertion": a, "assertion_rule": rule, "assertion_cue": cue, "temporality": when, "temporality_cue": when_cue, "change_type": change, "change_cue": change_cue})
        return out


MENTIONS = "array<struct<concept:string,kind:string,char_start:int,char_end:int,raw_text:string,laterality:string,assertion:string,assertion_rule:string,assertion_cue:string,temporality:string,temporality_cue:string,change_type:string,change_cue:string>>"


def annotator(lexicon: Lexicon):
    """A column function from sentences to their annotated mentions; the matcher is built once for each batch stream."""

    @F.pandas_udf(MENTIONS)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        engine = Engine(lexicon)
        for text in batches:
            yield text.map(lambda x: engine.annotate(x) if x else [])

    return scan


def concept_sets(lexicon: Lexicon, right_boundary: bool = False):
    """A column function from whole texts to the sorted names of the concepts in them; a null text has none."""

    @F.pandas_udf("array<string>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher, entries = union_matcher(lexicon.concepts, right_boundary)
        for text in batches:
            yield text.map(lambda x: sorted({entries[int(m.lastgroup[1:])].name for m in matcher.finditer(x or "")}))

    return scan
