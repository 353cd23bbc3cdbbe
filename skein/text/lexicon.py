"""Concepts and cues as data, and the one matcher that is built of all their patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Concept:
    """A concept: its name, kind (observation, anatomy, qualifier, device) and patterns."""

    name: str
    kind: str
    patterns: tuple[str, ...]
    group: str | None = None
    takes_side: bool = False


@dataclass(frozen=True)
class Cue:
    """A context cue: its section (negation, uncertain, ...) and the direction in which it reaches."""

    name: str
    section: str
    patterns: tuple[str, ...]
    direction: str = "forward"
    result: str | None = None
    needs_time: bool = False


@dataclass
class Lexicon:
    """All concepts, cues and terminators of an engine."""

    concepts: list[Concept]
    cues: list[Cue] = field(default_factory=list)
    terminators: list[str] = field(default_factory=list)
    sides: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_yaml(cls, path: str, expected: int | None = None) -> "Lexicon":
        """Reads a lexicon; `expected` is the number of concepts it must have."""
        import yaml

        with open(path, encoding="utf-8") as f:
            raw = yaml.safe_load(f)
        concepts = [Concept(x["name"], x["kind"], tuple(x["patterns"]), x.get("group"), bool(x.get("takes_side"))) for x in raw.get("concepts", [])]
        if expected is not None and len(concepts) != expected:
            raise ValueError(f"{path}: {len(concepts)} concepts, not {expected}")
        cues = [Cue(x["name"], x["section"], tuple(x["patterns"]), x.get("direction", "forward"), x.get("result"), bool(x.get("needs_time"))) for x in raw.get("cues", [])]
        return cls(concepts, cues, raw.get("terminators", []), raw.get("sides", {}))

    def frame(self, spark: SparkSession) -> DataFrame:
        """Concepts and patterns as a table."""
        return spark.createDataFrame([(c.name, c.kind, c.group, p) for c in self.concepts for p in c.patterns], "concept string, kind string, grp string, pattern string")


def longest(pattern: str) -> int:
    """About how long a match of the pattern can be; what repeats without a bound counts three times."""
    from re import _parser

    def size(parts) -> int:
        total = 0
        for op, arg in parts:
            name = str(op)
            if name == "BRANCH":
                total += max(map(size, arg[1]))
            elif name == "SUBPATTERN":
                total += size(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                total += size(arg[2]) * min(int(arg[1]), max(3, int(arg[0])) if arg[1] == _parser.MAXREPEAT else int(arg[1]))
            elif name in ("AT", "ASSERT", "ASSERT_NOT"):
                continue
            else:
                total += 1
        return total

    return size(_parser.parse(pattern))


def has_capture(pattern: str) -> bool:
    """Whether the pattern has a capturing group."""
    return re.compile(pattern).groups > 0


def union_matcher(concepts: list[Concept], right_boundary: bool = True) -> tuple[re.Pattern, list[Concept]]:
    """One expression for all patterns, the longest first; group g<i> is the i-th entry of the returned list.

    A match begins at a word boundary, unless its pattern begins with a bracket.
    Without right_boundary it may end within a word, as agglutinative languages need.
    """
    entries = [(p, c) for c in concepts for p in c.patterns]
    for p, c in entries:
        if has_capture(p):
            raise ValueError(f"{c.name}: capturing group in {p!r}")
    entries.sort(key=lambda x: (-longest(x[0]), -len(x[0])))
    edge = r"\b" if right_boundary else ""
    left = lambda p: "" if p.startswith(r"\(") else r"\b"  # noqa: E731  before a bracket a boundary would ask for a word
    body = "|".join(rf"{left(p)}(?P<g{i}>{p})" for i, (p, _) in enumerate(entries))
    return re.compile(rf"(?:{body}){edge}", re.I), [c for _, c in entries]
