"""Personal data in texts, also when disguised, with spans in source characters.

The plain detectors run on the text as it is.  Then transducers rewrite it, keeping for every
character they write the source characters it stands for: look-alike letters, wide forms and any
script's digits become ASCII and invisible characters go; "[at]", "(dot)", "name at host dot com"
become signs, in any mix with signs ("name at host.com", too); said addresses and runs of spelled
digits become digits, a run of few spelled ones if a detector accepts it.  The detectors run again, and what they find
is mapped back.  A found span that overlaps a plain one of its kind adds nothing.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlore.llm.common import id_and_text, slices

KINDS = ("email", "ip", "card", "phone")

# Letters that look like a Latin one, in the order of the Latin letters beside them.
LOOK_ALIKES = dict(zip("аАВсСԁеЕНһіІјКӏМоОрРԛѕЅТԝхХуУѴαΑΒεΕΗΙικΚΜΝνοΟρΡΤυΥχΧΖ",
                       "aABcCdeEHhiIjKlMoOpPqsSTwxXyYVaABeEHIikKMNvoOpPTuYxXZ", strict=True))
DASHES, DOTS, SPACES = "‐‑‒–—―−", "․。｡", "      　"
INVISIBLE = "­​‌‍⁠﻿"
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
               "seven": "7", "eight": "8", "nine": "9"}
LEAST_DIGIT_WORDS = 4         # spelled digits in a row that count as a number

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only begin where a run of digits does; saying so keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# bounded white space keeps these linear
_SIGN = re.compile(r"[\[({<]\s{0,3}(at|dot|@|\.)\s{0,3}[\])}>]", re.IGNORECASE)
_SAID = re.compile(r"(?:(?P<at> {1,3}at {1,3})|@)[A-Za-z0-9-]+(?:(?: {1,3}dot {1,3}|\.)[A-Za-z0-9-]+)+", re.IGNORECASE)
_DOT_WORD = re.compile(r" {1,3}dot {1,3}", re.IGNORECASE)
_DIGIT_WORD = "(?:" + "|".join(DIGIT_WORDS) + ")"
_SPELLED = re.compile(rf"(?:\bplus[ -]{{1,3}})?\b(?:{_DIGIT_WORD}|[0-9]+)(?:[ ,-]{{1,3}}(?:{_DIGIT_WORD}|[0-9]+))+\b", re.IGNORECASE)
_ANY_DOT_WORD = re.compile(rf"{_DIGIT_WORD}\.|\.{_DIGIT_WORD}")
_GROUP = rf"(?:[0-9]{{1,3}}|{_DIGIT_WORD}(?:[ -]{_DIGIT_WORD}){{0,2}})"
_SAID_IP = re.compile(rf"(?<![0-9.])\b{_GROUP}(?:(?: {{1,3}}dot {{1,3}}|\.){_GROUP}){{3}}\b", re.IGNORECASE)
_ANY_DIGIT_WORD = re.compile(rf"\b{_DIGIT_WORD}[ ,-]{{1,3}}(?:{_DIGIT_WORD}|[0-9])|[0-9][ ,-]{{1,3}}{_DIGIT_WORD}\b", re.IGNORECASE)
_SINGLES = {**LOOK_ALIKES, **dict.fromkeys(DASHES, "-"), **dict.fromkeys(DOTS, "."), **dict.fromkeys(SPACES, " "),
            **dict.fromkeys(INVISIBLE, ""), **{chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}}
_OTHER_DIGITS = "".join(c for c in map(chr, range(0x80, 0x20000)) if unicodedata.decimal(c, None) is not None)
_SINGLE = re.compile("[" + re.escape("".join(_SINGLES)) + _OTHER_DIGITS + "]")

Span = tuple[int, int, int]   # kind's number, start, end


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each @ outwards, so linear on any text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def detect(text: str) -> list[Span]:
    """Plain spans by start, then kind."""
    found = [(0, s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(d):
            found.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((3, *m.span()))
    return sorted(found, key=lambda x: (x[1], x[0], x[2]))


@dataclass
class Rewritten:
    """A rewritten text and, for each of its characters, the source span it stands for."""

    text: str
    start: list[int]
    end: list[int]

    @classmethod
    def of(cls, text: str) -> "Rewritten":
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)))

    def replace(self, spans: list[tuple[int, int, str]]) -> "Rewritten":
        """With the text of each span (in order, apart) replaced; new characters share the span."""
        text, start, end, at = [], [], [], 0
        for a, b, new in spans:
            text += (self.text[at:a], new)
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        return Rewritten("".join((*text, self.text[at:])), start + self.start[at:], end + self.end[at:])


def _plain_letters(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), _SINGLES[m[0]] if m[0] in _SINGLES else str(unicodedata.decimal(m[0]))) for m in _SINGLE.finditer(text)]


def _signs(text: str) -> list[tuple[int, int, str]]:
    out, end = [], 0
    for m in _SIGN.finditer(text):
        a, b = m.span()
        while a > end and text[a - 1] == " ":
            a -= 1
        while b < len(text) and text[b] == " ":
            b += 1
        end = b
        if a < b:
            out.append((a, b, "@" if m[1].lower() in ("at", "@") else "."))
    # signs that touch: the spaces between went to the first
    return [(max(a, out[k - 1][1] if k else 0), b, new) for k, (a, b, new) in enumerate(out)]


def _said_signs(text: str) -> list[tuple[int, int, str]]:
    out, end = [], 0
    for m in _SAID.finditer(text):
        if m.start() <= end or text[m.start() - 1] not in _LOCAL:
            continue
        end = m.end()
        dots = list(_DOT_WORD.finditer(text, m.start(), end))
        last = m[0].rpartition(".")[2]
        if m["at"] and (dots or (len(last) > 1 and last.isalpha() and (last.islower() or last.isupper()))):   # "at 10.30" is a time
            out.append((*m.span("at"), "@"))
        out += [(*d.span(), ".") for d in dots]
    return out


def _said_ips(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _SAID_IP.finditer(text):
        parts = [[DIGIT_WORDS.get(d, d) for d in re.split("[ -]", p)] for p in re.split(r" {1,3}dot {1,3}|\.", m[0].lower())]
        new = ".".join(map("".join, parts))
        if new != m[0] and any(k == 1 for k, _, _ in detect(new)):
            out.append((*m.span(), new))
    return out


def _spelled_digits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _SPELLED.finditer(text):
        parts = re.split("[ ,-]+", m[0].lower())
        spelled = sum(p in DIGIT_WORDS for p in parts)
        new = "".join("+" if p == "plus" else DIGIT_WORDS.get(p, p) for p in parts)
        if spelled >= LEAST_DIGIT_WORDS or (spelled and detect("+" * text.startswith("+", m.start() - 1) + new)):
            out.append((*m.span(), new))
    return out


def normalise(text: str) -> Rewritten | None:
    """The text without disguises; None if it has none."""
    out = None
    if not text.isascii() and (spans := _plain_letters(text)):
        out = Rewritten.of(text).replace(spans)
    for wanted, transducer in ((_SIGN, _signs), (_SAID, _said_signs), (_SAID_IP, _said_ips), (_ANY_DIGIT_WORD, _spelled_digits)):
        now = out.text if out else text
        low = now.lower() if wanted in (_SAID, _SAID_IP) else ""
        if low and " dot " not in low and (" at " not in low if wanted is _SAID else not _ANY_DOT_WORD.search(low)):
            continue
        if wanted.search(now) and (spans := transducer(now)):
            out = (out or Rewritten.of(text)).replace(spans)
    return out


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Plain spans, and all spans."""
    plain = detect(text or "")
    clear = normalise(text) if text else None
    if clear is None:
        return plain, plain
    taken = [[(a, b) for k, a, b in plain if k == kind] for kind in range(len(KINDS))]   # apart, so in order by end too
    done, added = [0] * len(KINDS), []
    for kind, s, e in detect(clear.text):
        a, b = clear.start[s], clear.end[e - 1]
        after = bisect_left(taken[kind], (b,))
        if a >= done[kind] and (not after or taken[kind][after - 1][1] <= a):
            added.append((kind, a, b))
            done[kind] = b
    return plain, sorted(plain + added, key=lambda x: (x[1], x[0], x[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span replaced by its kind in brackets (overlaps merge under the first)."""
    if not spans:
        return text
    out, at = [], 0
    for k, a, b in spans:
        if a >= at:
            out += (text[at:a], f"[{KINDS[k].upper()}]")
        at = max(at, b)
    return "".join((*out, text[at:]))


SCHEMA = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_spans string, "
          "spans string, redacted string")


def _run(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.string()] * 3
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                plain, spans = find(text)
                rows.append((doc, *(sum(k == n for k, _, _ in plain) for n in range(4)), len(spans) - len(plain),
                             joined(plain), joined(spans), redact(text, spans) if with_text else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def find_pii(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Per document: counts of the plain finds by kind, the number added by deobfuscation, all spans as
    ``kind:start:end`` (code points, end exclusive, by start, then kind) and the redacted text.

    Null and empty text: no finds (``redacted`` stays null or empty).  Spans of different kinds may
    overlap.  Repeated rows are each returned.  A null ``doc_id`` stays null.  An empty table gives no rows.
    """
    return id_and_text(docs).mapInArrow(_run(with_text), SCHEMA)


def digest(docs: DataFrame) -> DataFrame:
    found = find_pii(docs, with_text=False)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"),
                        "spans", "n_added")
