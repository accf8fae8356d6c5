"""Operator 7: token counts at every prefix, by dynamic programming over a byte-level BPE vocabulary.

Let P be a piece that the tokenizer's pattern cuts out of a text. The encoding of P's first i bytes ends in one token t, which is
the only suffix token such that the pair (last token of the first i - |t| bytes, t) survives the merges unchanged. So the table
`last token, count` of all prefixes of P is filled from left to right, and the count of a longer prefix never needs a new encoding.
Text is cut where white space follows something else; the pattern never crosses such a place and looks no further than it, so
counts add up over these units, and a text's count at any prefix is the count before its unit plus the count within the unit.

Defined results: null or empty text: no bytes, no tokens, fit_chars 0. Special strings inside a text are one token each, as the library has
it. Repeated rows: counted each. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import longs, map_texts

#: The published splitting pattern of this vocabulary family, and Unicode white space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = "\t-\r \x85\xa0  -     　"
#: Token lengths up to this are looked up one by one; longer tokens are few and found by their last bytes.
SHORT = 16
#: Pieces and units whose counts a task remembers at most; the memory starts anew when it is full.
REMEMBERED = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, back to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class PrefixCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        as_bytes = lambda s: bytes(back[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.ids = {as_bytes(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.rank = {(as_bytes(a), as_bytes(b)): k for k, (a, b) in enumerate(merges)}
        self.spelled = {i: b for b, i in self.ids.items()}
        long = [b for b in self.ids if len(b) > SHORT]
        self.long_ends = {b[-SHORT:] for b in long}
        self.longest = max([SHORT, *map(len, long)])
        self.split = regex.compile(PATTERN)
        self.units = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.blank = re.compile(f"[{WHITE}]*")
        self.specials = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.pieces: dict[str, int] = {}
        self.known: dict[str, int] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Plain merging, for strings of one or two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def follows(self, before: int, token: int) -> bool:
        if len(self.pairs) > 4 * REMEMBERED:
            self.pairs.clear()
        a, b = self.spelled[before], self.spelled[token]
        got = self.pairs[(before, token)] = self.merged(a + b) == [a, b]
        return got

    def begins(self, token: int) -> bool:
        got = self.alone.get(token)
        if got is None:
            got = self.alone[token] = len(self.merged(self.spelled[token])) == 1
        return got

    def table(self, data: bytes) -> list[int]:
        """The token count of each prefix of one piece, from the empty one on."""
        n, ids, pairs = len(data), self.ids, self.pairs
        count, last = [0] * (n + 1), [-1] * (n + 1)
        for i in range(1, n + 1):
            most = min(i, self.longest if i > SHORT and data[i - SHORT : i] in self.long_ends else SHORT)
            for start in range(i - 1, i - most - 1, -1):  # exactly one start fits, mostly a near one
                token = ids.get(data[start:i])
                if token is None:
                    continue
                if start:
                    before = last[start]
                    fits = pairs.get((before, token))
                    if fits is None:
                        fits = self.follows(before, token)
                else:
                    fits = self.begins(token)
                if fits:
                    last[i], count[i] = token, count[start] + 1
                    break
        return count

    def piece(self, piece: str) -> int:
        got = self.pieces.get(piece)
        if got is None:
            if len(self.pieces) > REMEMBERED:
                self.pieces.clear()
            got = self.pieces[piece] = self.table(piece.encode())[-1]
        return got

    def unit(self, unit: str) -> int:
        got = self.known.get(unit)
        if got is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            got = self.known[unit] = sum(map(self.piece, self.split.findall(unit)))
        return got

    def within(self, unit: str) -> list[int]:
        """The token count of each prefix of a unit by code points, the whole unit last."""
        chars = lambda s: np.cumsum([0, *(len(c.encode()) for c in s)]).tolist()
        blank = self.blank.match(unit).end()
        table = self.table(unit[:blank].encode())  # white space at a text's end is one piece
        out, before = [table[k] for k in chars(unit[:blank])], 0
        for m in self.split.finditer(unit):
            if m.end() > blank:
                table, at = self.table(m.group().encode()), chars(m.group())
                inner = [before + table[k] for k in at]
                if m.group()[0] == "'" and len(m.group()) == 3 and m.group()[1:].isalpha():  # half a contraction is two pieces
                    inner[2] = before + self.piece("'") + self.piece(m.group()[1])
                out += inner[max(blank, m.start()) + 1 - m.start() :]
            before += self.piece(m.group())
        return out

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """The text's stretches, and whether each is a special string."""
        if not self.specials or not self.specials.search(text):
            return [(text, False)]
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [(text[at : m.start()], False), (m.group(), True)]
            at = m.end()
        return [*out, (text[at:], False)]

    def marks(self, text: str) -> tuple[list[str], list[int]]:
        """The text's units and the count of each."""
        if not self.specials or not self.specials.search(text):
            units = self.units.findall(text)
            return units, [self.known[u] if u in self.known else self.unit(u) for u in units]
        units, counts = [], []
        for part, special in self.parts(text):
            mine = [part] if special else self.units.findall(part)
            units += mine
            counts += [1] if special else list(map(self.unit, mine))
        return units, counts

    def prefix_counts(self, text: str) -> np.ndarray:
        """The exact token count of text[:i] for each i from 0 to len(text); a cut special string counts as plain text."""
        out, total, before, unit = [0], 0, 0, ""
        for part, special in self.parts(text):
            if special:  # a cut one is text that goes on from the unit before it
                out += [before + self.count(unit + part[:k]) for k in range(1, len(part))]
                total += 1
                before, unit = total, ""
                out.append(total)
                continue
            for unit in self.units.findall(part):
                before = total
                out += [before + k for k in self.within(unit)[1:]]
                total = out[-1]
        return np.array(out, dtype=np.int64)

    def count(self, text: str) -> int:
        return sum(self.marks(text)[1])

    def fit(self, units: list[str], counts: list[int], limit: int) -> int:
        """The most code points of the text's start that are at most `limit` tokens."""
        chars = total = best = 0
        for u, c in zip(units, counts, strict=True):
            if total + c > limit and u not in self.special:
                inner = self.within(u)
                best = max([best, *(chars + k for k, x in enumerate(inner) if total + x <= limit)])
            chars, total = chars + len(u), total + c
            if total <= limit:
                best = chars
            if total > limit:
                break
        return best


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_maker(path: str, limit: int) -> Callable[[], Callable[[list[bytes]], dict]]:
    def make() -> Callable[[list[bytes]], dict]:
        tables = counter(path)

        def counts(texts: list[bytes]) -> dict:
            marks = [tables.marks(t.decode()) for t in texts]
            totals = [sum(c) for _, c in marks]
            fits = [sum(map(len, u)) if n <= limit else tables.fit(u, c, limit) for (u, c), n in zip(marks, totals, strict=True)]
            return {"n_bytes": longs([len(t) for t in texts]), "n_tokens": longs(totals), "fit_chars": longs(fits)}

        return counts

    return make


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and fit_chars: the longest start of the text (code points) within the limit."""
    found = map_texts(docs, count_maker(tokenizer, limit), "n_bytes long, n_tokens long, fit_chars long", ["doc_id"])
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars")


def prefix_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and counts: the exact token count at every prefix of the text, by code points."""

    def make() -> Callable[[list[bytes]], dict]:
        tables = counter(tokenizer)
        return lambda texts: {"counts": pa.array([tables.prefix_counts(t.decode()) for t in texts], pa.list_(pa.int64()))}

    return map_texts(docs, make, "counts array<long>", ["doc_id"])


def budgets(tables: DataFrame, limits: list[int]) -> DataFrame:
    """From stored prefix tables (doc_id, counts): for each limit the longest start (code points) of at most so many tokens, and the tokens of that start. Nothing is encoded again."""
    each = tables.select("doc_id", "counts", F.explode(F.array(*(F.lit(n).cast("long") for n in limits))).alias("limit"))
    fit = F.array_max(F.transform("counts", lambda n, i: F.when(n <= F.col("limit"), i)))
    found = each.select("doc_id", "limit", "counts", fit.alias("fit"))
    return found.select("doc_id", "limit", F.col("fit").cast("long").alias("fit_chars"), F.get("counts", F.col("fit")).alias("fit_tokens"))
