"""Operator 6: personal data, also where it is disguised.

Plain identifiers (email, ip, card, phone) are matched in the text itself. Then transducers rewrite the text step by step: invisible
characters go, look-alike letters and wide forms become ASCII, at and dot disguises become signs, and spelled digits become digits. Every
rewritten character keeps the start and end of the source characters that it stands for, so that identifiers found in the rewritten text
come back as spans of the source. Those that overlap no plain identifier, or hold one and more, are added.

Offsets are code points of the source, end exclusive. Defined results: null or empty text: no spans (`masked` returns a null text as an empty one). Repeated rows: each by itself.
Empty table: empty result. Extra columns are ignored by `detected` and kept by `masked`.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import longs, map_texts, strings

KINDS = ["email", "ip", "card", "phone"]
Span = tuple[str, int, int]

#: Look-alikes of ASCII letters (Cyrillic, Greek), each pair side by side.
LOOKALIKES = "аa еe оo рp сc хx уy іi ѕs јj ԁd һh ԛq ԝw ɡg ոn тt кk мm вb нh АA ВB ЕE КK МM НH ОO РP СC ТT ХX УY ІI ЅS ЈJ αa οo νv ρp τt υu ιi κk ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX"
DIGIT_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
INVISIBLE = "­​‌‍‎‏⁠﻿"
#: Wide forms of the printable ASCII characters lie at this distance.
WIDE = 0xFEE0

CHARACTERS = {x[0]: x[1] for x in LOOKALIKES.split()} | {chr(c + WIDE): chr(c) for c in range(33, 127)} | dict.fromkeys(INVISIBLE, "") | {"　": " "}
ODD = re.compile("[" + "".join(map(re.escape, CHARACTERS)) + "]")
#: A-Z and a-z only: other letters that fold to them (long s, dotless i, the kelvin sign) are no letters of these words.
FOLDED = re.IGNORECASE | re.ASCII
SIGN = re.compile(r"[ ]?[\[({<][ ]?(?:(at|@)|dot|\.)[ ]?[\])}>][ ]?", FOLDED)
#: Spelled at and dot are signs in the form of an address only: local part, at, labels with a dot; and between four numbers.
SPOKEN = re.compile(r"(?<![A-Za-z0-9._%+-])(?<![A-Za-z0-9._%+-] dot )[A-Za-z0-9._%+-]++(?: dot [A-Za-z0-9._%+-]++)*?( at |@)[A-Za-z0-9-]++(?:(?: dot |\.)[A-Za-z0-9-]++)+", FOLDED)
SPOKEN_DOT = re.compile(" dot ", FOLDED)
SPOKEN_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:(?: dot |\.)[0-9]++){3}", FOLDED)
DIGIT = "(?:" + "|".join(DIGIT_WORDS) + ")"
#: Digit words beside each other, digits and dots: seven digits at least, or the four numbers of an address.
SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:{DIGIT}(?![A-Za-z])|[0-9]++)(?:(?: dot |[ ().,-]{{0,3}})(?:(?<![A-Za-z]){DIGIT}(?![A-Za-z])|[0-9]++))+", FOLDED)
SPELLED_DIGIT = re.compile(rf"{DIGIT}|[0-9]+", FOLDED)

EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")  # a run of digits is tried from its first one only
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(v * 2 - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @ so that long runs of other characters cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def plain(text: str) -> list[Span]:
    """The identifiers that stand in the text as such, by kind, then start."""
    spans: list[Span] = [("email", *s) for s in emails(text)] if "@" in text else []
    digits = re.search("[0-9]", text)
    if not digits:
        return spans
    if text.count(".") > 2:
        spans += [("ip", *m.span()) for m in IP.finditer(text, digits.start()) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text, digits.start()):
        if m.end() - m.start() >= 16:
            number = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(number) <= 19 and luhn(number):
                spans.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m.group())) <= 15:
                spans.append(("phone", *m.span()))
    return spans


class Rewritten:
    """A text and, for each of its characters, the source characters that it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.start = range(len(text))
        self.end = range(1, len(text) + 1)

    def rewrite(self, changes: Iterator[tuple[int, int, str]]) -> None:
        """Applies (from, to, new text) in order; all new characters stand for all old ones."""
        text, start, end, done = [], [], [], 0
        for a, b, new in changes:
            text += [self.text[done:a], new]
            start += [*self.start[done:a], *[self.start[a]] * len(new)]
            end += [*self.end[done:a], *[self.end[b - 1]] * len(new)]
            done = b
        if done or text:
            text.append(self.text[done:])
            self.text, self.start, self.end = "".join(text), [*start, *self.start[done:]], [*end, *self.end[done:]]


def spelled(text: str) -> list[tuple[int, int, str]]:
    """Changes that make digits of spelled ones; what stands between two digits goes if one of them is spelled, but for dots."""
    places = []
    for m in SPELLED.finditer(text):
        found = list(SPELLED_DIGIT.finditer(text, *m.span()))
        words = [not d.group()[0].isdigit() for d in found]
        between = [text[x.end() : y.start()] for x, y in zip(found, found[1:])]
        dots = sum(b.lower() in (".", " dot ") for b in between)
        if not any(words) or dots != 3 and sum(1 if w else len(d.group()) for w, d in zip(words, found)) < 7:
            continue
        if sum(words) < 3 and plain(text[max(0, m.start() - 1) : m.end()]):
            continue  # "+1 555 123 4567 one more time": the number is whole without the word
        for k, (d, w) in enumerate(zip(found, words)):
            gap = between[k - 1] if k else ""
            if gap.lower() == " dot ":
                places.append((d.start() - len(gap), d.start(), "."))
            if gap and gap.lower() not in (".", " dot ") and (w or words[k - 1]) and not set(gap) & set("()"):
                places.append((d.start() - len(gap), d.end(), str(DIGIT_WORDS.index(d.group().lower())) if w else d.group()))
            elif w:
                places.append((*d.span(), str(DIGIT_WORDS.index(d.group().lower()))))
    return places


def normalised(text: str) -> Rewritten | None:
    """The text after all transducers; None if none of them has anything to do."""
    out, plain_text = Rewritten(text), text
    if not text.isascii():
        out.rewrite((m.start(), m.end(), CHARACTERS[m.group()]) for m in ODD.finditer(out.text))
    low = out.text.lower()
    if any(c in low for c in "[({<") and ("at" in low or "dot" in low or "@" in low or "." in low):
        out.rewrite((m.start(), m.end(), "@" if m.group(1) else ".") for m in SIGN.finditer(out.text))
        low = out.text.lower()
    if sum(w in low for w in DIGIT_WORDS):
        out.rewrite(iter(spelled(out.text)))
        low = out.text.lower()
    if " at " in low or "@" in low and " dot " in low:
        places = []
        for m in SPOKEN.finditer(out.text):
            places += [(*d.span(), ".") for d in SPOKEN_DOT.finditer(out.text, m.start(), m.start(1))]
            places += [(*m.span(1), "@"), *((*d.span(), ".") for d in SPOKEN_DOT.finditer(out.text, m.end(1), m.end()))]
        out.rewrite(iter(places))
    if " dot " in low:
        out.rewrite((*d.span(), ".") for m in SPOKEN_IP.finditer(out.text) for d in SPOKEN_DOT.finditer(out.text, *m.span()))
    return out if out.text != plain_text else None


def detect(text: str) -> tuple[list[Span], list[Span]]:
    """The plain spans, and all spans, by kind, then start."""
    base = plain(text)
    changed = normalised(text)
    if changed is None:
        return base, base
    taken = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))  # reach: the greatest end up to each span
    more = []
    for kind, s, e in plain(changed.text):
        a, b = changed.start[s], changed.end[e - 1]
        k, whole = bisect_left(starts, b) - 1, True
        while whole and k >= 0 and reach[k] > a:  # back over the spans that begin before b, as far as one may reach over a
            s, e = taken[k]
            whole = e <= a or (a <= s and e <= b and b - a > e - s)
            k -= 1
        if whole:
            more.append((kind, a, b))
    return base, sorted(base + more, key=lambda x: (KINDS.index(x[0]), x[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def detected(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the plain spans, and spans (all)."""

    def make() -> Callable[[list[bytes]], dict]:
        def work(texts: list[bytes]) -> dict:
            both = [detect(t.decode()) for t in texts]
            counts = {f"n_{k}": longs([sum(s[0] == k for s in base) for base, _ in both]) for k in KINDS}
            return counts | {"base_sha256": strings([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in both]), "spans": strings([joined(a) for _, a in both])}

        return work

    return map_texts(docs, make, ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string", ["doc_id"])


def mask(text: str) -> str:
    """The text with a placeholder for each span; overlapping spans share the first one's."""
    _, spans = detect(text)
    out, done = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= done:
            out += [text[done:s], f"[{kind.upper()}]"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def masked(docs: DataFrame) -> DataFrame:
    """docs with placeholders for personal data in text, and n_chars, if there is one, of the new text."""
    others = [c for c in docs.columns if c != "text"]

    def make() -> Callable[[list[bytes]], dict]:
        return lambda texts: {"text": pa.array([mask(t.decode()) for t in texts], pa.string())}

    out = map_texts(docs, make, "text string", others)
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
