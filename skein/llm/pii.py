"""Personal data: patterns propose, checksums confirm, context words adjust the score.

Each detector is a regular expression; what it proposes must pass a validator
(digit sums, Luhn, mod-97, ranges), and starts with the detector's own score,
which words nearby raise or lower. A span is reported if its score reaches the
threshold. The four base kinds (email, ip, card, phone) are fixed by their
patterns and validators alone and are always reported; context only moves their
score. The further kinds (iban, ssn, mac, secret) need what is stated with each: a
checksum, a valid number, a fixed form, or for secrets (long runs of mixed
characters) a word nearby that says so. Context words count whole or not at all.

Null text counts as empty; rows with null ids are kept; extra columns of the
input are ignored. Texts of any length are scanned whole, in time linear in
their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .lexing import chunks

#: The base kinds in the order in which spans are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "ssn", "mac", "secret")
KINDS = BASE_KINDS + EXTRA_KINDS

#: A span is reported from this score on.
THRESHOLD = 0.5
#: Characters on either side of a span in which context words count.
WINDOW = 48
RAISE, LOWER = 0.35, 0.35

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The part before the first full stop starts at the beginning of its digits in
# any leftmost match, so saying so changes no match and keeps the scan linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_MAC = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
#: What every kind needs one of: a digit, an @ sign, or the colons of a MAC address, which can be all letters.
_TRIGGER = re.compile(r"[0-9@]|:[A-Fa-f]{2}:")
_WORDS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"[0-9]")

#: Words that make a kind likelier, and words that make any kind less likely.
CONTEXT = {
    "email": {"email", "mail", "contact", "write", "correo", "courriel"},
    "ip": {"ip", "address", "host", "server", "login"},
    "card": {"card", "visa", "mastercard", "credit", "payment", "karte", "carte", "tarjeta"},
    "phone": {"phone", "call", "tel", "mobile", "fax", "telefon", "téléphone", "teléfono"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
    "ssn": {"ssn", "social", "security", "taxpayer"},
    "mac": {"mac", "device", "hardware", "adapter"},
    "secret": {"token", "secret", "password", "passwd", "apikey", "key", "credential", "credentials", "bearer"},
}
AGAINST = {"version", "isbn", "example", "invoice", "order", "serial", "model", "part"}
#: What a confirmed proposal scores before context is read.
START = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.95, "ssn": 0.2, "mac": 0.6, "secret": 0.3}


@dataclass(frozen=True)
class Span:
    """A found item: kind, start and exclusive end in code points, score from 0 to 1."""

    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i & 1:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether an account number without blanks passes the mod-97 check."""
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their @ signs."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed proposals of all kinds."""
    for s, e in emails(text):
        yield "email", s, e
    for m in _IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and m.end() - m.start() <= 37 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                yield "phone", *m.span()
    at = 0
    while m := _IBAN.search(text, at):
        # a capital word that follows may have been taken in: the code may end at any blank
        at, end = m.start() + 4, m.end()
        while end > m.start():
            if 15 <= len(code := text[m.start() : end].replace(" ", "")) <= 34 and mod97(code):
                yield "iban", m.start(), end
                at = end
                break
            end = text.rfind(" ", m.start(), end)
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", *m.span()
    if ":" in text:
        for m in _MAC.finditer(text):
            yield "mac", *m.span()
    for m in _SECRET.finditer(text):
        kinds = [any(map(test, m[0])) for test in (str.isdigit, str.isalpha)]
        if all(kinds) and len(set(m[0].lower())) >= 8:
            yield "secret", *m.span()


def _near(text: str, s: int, e: int) -> set[str]:
    """The words of which no part lies farther than WINDOW from the span."""
    left, right = max(0, s - WINDOW), min(len(text), e + WINDOW)
    before = [m for m in _WORDS.finditer(text, left, s) if m.start() > left or left == 0 or not _WORDS.match(text[left - 1])]
    after = [m for m in _WORDS.finditer(text, e, right) if m.end() < right or right == len(text) or not _WORDS.match(text[right])]
    return {m[0].lower() for m in before + after}


def find(text: str | None) -> list[Span]:
    """All spans of a text, by kind as listed in KINDS, then start."""
    if not text or not _TRIGGER.search(text):
        return []
    out = []
    for kind, s, e in _proposed(text):
        score = START[kind]
        near = _near(text, s, e)
        if near & CONTEXT[kind]:
            score = min(1.0, score + RAISE)
        if near & AGAINST:
            score = max(0.0, score - LOWER)
        if kind in BASE_KINDS or score >= THRESHOLD:
            out.append(Span(kind, s, e, round(score, 3)))
    return out


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind in square brackets; overlapping spans become one, named by the leftmost."""
    if not spans or text is None:
        return text
    out, done = [], 0
    for x in sorted(spans, key=lambda x: (x.start, -x.end)):
        if x.start >= done:
            out += [text[done : x.start], f"[{x.kind.upper()}]"]
        done = max(done, x.end)
    return "".join(out) + text[done:]


_SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
_SPANS_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def detect(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), redacted: bool = False) -> DataFrame:
    """The kept columns with `spans`, and if asked for the `redacted` text. One pass over the rows, without a shuffle."""
    ship(docs.sparkSession)
    fields = [docs.schema[c] for c in keep]
    cols = [F.col(f"`{c}`") for c in keep]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", spans {_SPANS}" + ", redacted string" * redacted

    def run(batches):
        for batch in batches:
            for part, texts in chunks(batch, "__text"):
                strings = texts.to_pylist()
                found = [find(x) for x in strings]
                arrays = [part.column(i) for i in range(len(keep))]
                arrays.append(pa.array([[vars(x) for x in xs] for xs in found], _SPANS_TYPE))
                names = [*keep, "spans"]
                if redacted:
                    null = part.column(len(keep)).is_null().to_pylist()
                    arrays.append(pa.array([None if n else redact(t, xs) for n, t, xs in zip(null, strings, found)], pa.string()))
                    names.append("redacted")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(*cols, F.col(f"`{text}`").alias("__text")).mapInArrow(run, out)


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, all spans as text and their scores, from `spans`."""
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    base = of(*BASE_KINDS)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda x: x["score"].cast("string")), ",").alias("scores"))


def reference_digest(text: str | None) -> str:
    """The base digest by plain Python, for tests."""
    spans = [x for x in find(text) if x.kind in BASE_KINDS]
    return hashlib.sha256(",".join(f"{x.kind}:{x.start}:{x.end}" for x in spans).encode()).hexdigest()


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents."""
    from ..session import table

    return digest_columns(detect(table(spark, sf_dir, "documents")))
