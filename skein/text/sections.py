"""Sections of marked-up reports: headings, buckets, scope."""

from __future__ import annotations

import re
import unicodedata

_HASH = re.compile(r"^\s{0,3}#{1,6}\s+(.*)$")
_ITEM = re.compile(r"^\s*(?:[-*+]|[0-9]+[.)])\s+")
_BOLD = re.compile(r"^\s*\*\*([^*]+)\*\*\s*:?\s*(.*)$")


def normal_heading(raw: str, known: set[str] = frozenset(), prefixes: tuple[str, ...] = ()) -> str:
    """The heading in NFKC and lower case, without marks, numbers and colon; a prefix goes if what is left is known."""
    x = unicodedata.normalize("NFKC", raw)
    x = re.sub(r"[*#]+", "", x).strip()
    x = re.sub(r"^[0-9]+(?:\.[0-9]+)*[.)]?\s+", "", x)
    x = re.sub(r"\s+", " ", x.rstrip(": ")).strip().lower()
    for p in prefixes:
        if x.startswith(p) and x[len(p) :].strip() in known:
            x = x[len(p) :].strip()
    return x


def sections(text: str | None, known: set[str]) -> list[tuple[str, str]]:
    """(heading, body) in order. Lines with # are always headings, bold labels, also of list items, only if known; text before any heading has an empty one; a heading that returns is a new section."""
    out: list[tuple[str, list[str]]] = [("", [])]
    for line in (text or "").split("\n"):
        if m := _HASH.match(line):
            out.append((m[1].strip().rstrip("#").strip(), []))
        elif (m := _BOLD.match(_ITEM.sub("", line))) and normal_heading(m[1], known) in known:
            out.append((m[1].strip(), [m[2]] if m[2] else []))
        else:
            out[-1][1].append(line)
    return [(h, "\n".join(b).strip()) for h, b in out if h or "".join(b).strip()]


def bucket(heading: str, buckets: dict[str, str], in_scope: set[str]) -> tuple[str, bool, bool]:
    """(bucket, in scope, unknown); an unknown heading is out of scope."""
    b = buckets.get(heading)
    return ("unknown", False, True) if b is None else (b, b in in_scope, False)


def scoped_text(text: str | None, known: set[str], away: set[str]) -> str:
    """The bodies of all sections but those away, joined by blanks; the whole text if it has no headings or nothing is left."""
    found = sections(text, known)
    kept = [b for h, b in found if b and normal_heading(h, known) not in away]
    return " ".join(kept) if kept and any(h for h, _ in found) else text or ""
