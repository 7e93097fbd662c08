"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Candidates of the base kinds (email, ip, card, phone) count once their validator confirms
them, whatever stands around; words nearby only move their score. All other candidates
(account numbers and secrets, card numbers that fail their checksum among them) need words
nearby, or the mod-97 checksum of an IBAN.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from trialspark.llm.columns import from_text, with_text

KINDS = ("email", "ip", "card", "phone", "iban", "account", "secret")
BASE_KINDS = KINDS[:4]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive runs: no digit run is scanned twice.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}")
_ACCOUNT = re.compile(r"(?<![0-9])[0-9]{6,13}(?![0-9])")
_SECRET = re.compile(r"(?<![0-9A-Za-z_/+-])[0-9A-Za-z_/+-]{20,128}(?![0-9A-Za-z_/+-])")
_NOT_DIGIT = re.compile(r"[^0-9]")

# Length of account numbers by country code (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18,
    "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24,
    "XK": 20,
}
_IBAN_OF = {
    n: re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())
}

# Words that make each kind likelier, and words that make all kinds less likely.
_BANK = r"account|acct|konto|cuenta|compte|bank|iban|bic|swift|card|customer no"
_FOR = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write to|correo|courriel)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|address|host|server|client|login)\b"),
    "card": re.compile(rf"(?i)\b(?:{_BANK}|visa|mastercard|credit|debit)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|telephone|call|fax|mobile|cell)\b"),
    "iban": re.compile(rf"(?i)\b(?:{_BANK})\b"),
    "account": re.compile(rf"(?i)\b(?:{_BANK})\b"),
    "secret": re.compile(r"(?i)\b(?:token|secret|password|passwd|pwd|bearer|api[ _-]?key|access[ _-]?key|private[ _-]?key)\b"),
}
_AGAINST = re.compile(r"(?i)\b(?:example|sample|order|invoice|isbn|doi|version|part no)\b")
CONTEXT = 40
START_SCORE = {"email": 0.8, "ip": 0.8, "card": 0.8, "phone": 0.8, "iban": 0.8, "account": 0.2, "secret": 0.2}
MIN_SCORE = 0.5


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Checksum of card numbers."""
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        total += value if i % 2 == 0 else value * 2 - 9 * (value > 4)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Checksum of international account numbers: the moved code is 1 modulo 97."""
    moved = code[4:] + code[:4]
    return int("".join(str(int(char, 36)) for char in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # From each @ back over the local part: linear where a forward search would rescan long runs.
    done = 0
    for found in _DOMAIN.finditer(text):
        start = found.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < found.start():
            done = found.end()
            yield start, done


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for found in _IP.finditer(text):
        parts = [part.lstrip("0") for part in found.group().split(".")]
        if all(len(part) < 3 or (len(part) == 3 and part <= "255") for part in parts):
            yield found.span()


def _card_candidates(text: str) -> Iterator[tuple[int, int, bool]]:
    """Digit runs as long as card numbers, and whether their checksum holds."""
    for found in _CARD.finditer(text):
        if found.end() - found.start() >= 14:
            digits = _NOT_DIGIT.sub("", found.group())
            if 14 <= len(digits) <= 19:
                yield *found.span(), luhn(digits)


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for found in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", found.group())) <= 15:
            yield found.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for head in _IBAN_HEAD.finditer(text):
        length = IBAN_LENGTHS.get(head.group(1))
        found = _IBAN_OF[length].match(text, head.start()) if length else None
        if found and mod97(found.group().replace(" ", "")):
            yield found.span()


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    """Long runs that mix letters with digits, as keys and tokens do."""
    for found in _SECRET.finditer(text):
        run = found.group()
        if any(c.isdigit() for c in run) and any(c.isalpha() for c in run) and len(set(run)) >= 8:
            yield found.span()


def _scored(text: str, kind: str, start: int, end: int) -> float:
    around = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]
    score = START_SCORE[kind]
    score += 0.4 * bool(_FOR[kind].search(around)) - 0.4 * bool(_AGAINST.search(around))
    return min(max(score, 0.0), 1.0)


class _Taken:
    """Disjoint stretches of a text that spans cover, in order."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end) - 1
        return before >= 0 and self.ends[before] > start


def find_spans(text: str) -> list[Span]:
    """Spans by start, then kind; ends are exclusive, in characters.

    Every confirmed span of the four base kinds is kept, and its score tells how far words
    nearby speak for it. The other kinds are kept from ``MIN_SCORE`` on, and only where
    they overlap neither a base span nor a span of a kind before theirs. Time grows with the
    text and the logarithm of its number of spans.
    """
    cards = list(_card_candidates(text))
    base = [
        list(_emails(text)) if "@" in text else [],
        list(_ips(text)),
        [(start, end) for start, end, valid in cards if valid],
        list(_phones(text)) if "+" in text else [],
    ]
    spans = [
        Span(start, kind, end, _scored(text, KINDS[kind], start, end))
        for kind, found in enumerate(base)
        for start, end in found
    ]
    numbers = sorted({found.span() for found in _ACCOUNT.finditer(text)} | {c[:2] for c in cards if not c[2]})
    for kind, candidates in ((4, _ibans(text)), (5, numbers), (6, _secrets(text))):
        taken, last = _Taken([(span.start, span.end) for span in spans]), 0
        for start, end in candidates:
            if start < last or taken.meets(start, end):
                continue
            score = _scored(text, KINDS[kind], start, end)
            if score >= MIN_SCORE:
                spans.append(Span(start, kind, end, score))
                last = end
    return sorted(spans)


SPANS = "pii array<struct<kind:string,start:long,end:long,score:double>>"


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``pii``, the spans of each text. Null and empty texts have none."""

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        found = [find_spans(text) if text else [] for text in part.column("text").to_pylist()]
        kind = pa.struct(
            [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]
        )
        rows = [
            [{"kind": KINDS[s.kind], "start": s.start, "end": s.end, "score": s.score} for s in spans]
            for spans in found
        ]
        return [pa.array(rows, pa.list_(kind))]

    return from_text(docs, SPANS, compute)


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in angle brackets; null stays null."""

    def compute(part: pa.RecordBatch) -> pa.Array:
        return pa.array([mask(text) for text in part.column("text").to_pylist()], pa.string())

    return with_text(docs, compute)


def mask(text: str | None) -> str | None:
    if not text:
        return text
    out, done = [], 0
    for span in find_spans(text):
        if span.start >= done:
            out += [text[done : span.start], f"<{KINDS[span.kind]}>"]
        done = max(done, span.end)
    return "".join([*out, text[done:]])
