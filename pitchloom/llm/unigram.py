"""Operator 4: SentencePiece encoding and decoding by unigram Viterbi over a double-array trie.

Each text gets a leading space, spaces become the marker U+2581, and the segmentation into pieces with the greatest sum of log scores is
found by Viterbi. The pieces that begin at a byte are read off a double-array trie over their UTF-8. A character that no piece covers costs
less than any piece and is written as byte pieces. No piece has a marker behind another character, so a best segmentation never spans the place
before a run of markers: texts are cut there, and units seen before are remembered. Decoding joins the pieces and bytes, turns markers into
spaces and drops the leading one; it returns the text.

Scores are those of the vocabulary file (a piece's log score; greater is likelier). Defined results: null or empty text: no pieces. Ties: the
segmentation whose last piece starts first. Repeated rows: encoded each. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import longs, map_texts

MARKER = "▁"
REMEMBERED = 400_000
#: Below any sum of scores.
LEAST = float("-inf")


class DoubleArray:
    """A trie in two arrays: the child of state s by byte b is base[s] + b if check there is s. value[s]: the key that ends at s, or -1."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, value in sorted(keys.items()):
            node = 0
            for b in key:
                if b not in children[node]:
                    children.append({})
                    children[node][b] = len(children) - 1
                node = children[node][b]
            ends[node] = value
        size = 2 * len(children) + 512
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        # a slot taken by the root's own number can never be a child: bases are 1 or more
        free = {True: 1, False: 1}  # where the search goes on, for states with one child and with more
        self.check[0] = 0
        todo = [(0, 0)]
        for node, state in todo:
            self.value[state] = ends.get(node, -1)
            kids = sorted(children[node])
            if not kids:
                continue
            one = len(kids) == 1
            slot = free[one]
            while self.check[slot] >= 0 or any(self.check[slot + b - kids[0]] >= 0 for b in kids) or slot <= kids[0]:
                slot += 1
                if slot + 256 >= len(self.check):
                    self.base += [0] * size
                    self.check += [-1] * size
                    self.value += [-1] * size
            free[one] = slot if one else max(free[one], slot - 256)
            base = slot - kids[0]
            self.base[state] = base
            for b in kids:
                self.check[base + b] = state
                todo.append((children[node][b], base + b))


class Unigram:
    def __init__(self, pieces: list[tuple[str, float, str]]):
        """pieces: (piece, score, kind) by id; kind is normal, byte, unknown or control."""
        self.scores = [s for _, s, _ in pieces]
        normal = {p.encode(): i for i, (p, _, kind) in enumerate(pieces) if kind == "normal"}
        self.trie = DoubleArray(normal)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.unknown = next(i for i, (_, _, kind) in enumerate(pieces) if kind == "unknown")
        self.unknown_score = min(s for _, s, kind in pieces if kind == "normal") - 10
        texts = {"normal": lambda p: p.encode(), "byte": lambda p: bytes([int(p[3:5], 16)]), "unknown": lambda p: " ⁇ ".encode(), "control": lambda p: b""}
        self.spelled = [texts[kind](p) for p, _, kind in pieces]
        inner = any(MARKER in p.lstrip(MARKER) for p, _, kind in pieces if kind == "normal")
        self.units = re.compile("(?s).+" if inner else f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+")
        self.known: dict[str, bytes] = {}

    def best(self, unit: str) -> list[int]:
        """The ids of the best segmentation of a unit."""
        data = unit.encode()
        n, scores, unknown = len(data), self.scores, self.unknown_score
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        total = [LEAST] * (n + 1)
        came: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        total[0] = 0.0
        at = 0
        while at < n:
            lead = data[at]
            size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, single, state, end = total[at], False, 0, at
            while end < n:  # down the trie along the text
                to = base[state] + data[end]
                if check[to] != state:
                    break
                state = to
                end += 1
                piece = value[state]
                if piece >= 0:
                    score = here + scores[piece]
                    if score > total[end]:
                        total[end], came[end] = score, (at, piece)
                    if end == at + size:
                        single = True
            if not single and here + unknown > total[at + size]:
                total[at + size], came[at + size] = here + unknown, (at, -1)
            at += size
        out: list[list[int]] = []
        while n:
            start, piece = came[n]
            out.append([piece] if piece >= 0 else [self.bytes[b] for b in data[start:n]] if self.bytes else [self.unknown])
            n = start
        return [i for ids in reversed(out) for i in ids]

    def unit(self, unit: str) -> bytes:
        got = self.known.get(unit)
        if got is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            got = self.known[unit] = np.array(self.best(unit), dtype="<u4").tobytes()
        return got

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<u4")
        return np.frombuffer(b"".join(map(self.unit, self.units.findall(MARKER + text.replace(" ", MARKER)))), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.spelled.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARKER, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(path: str) -> Unigram:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if sp.is_byte(i) else "unknown" if sp.is_unknown(i) else "control" if sp.is_control(i) or sp.is_unused(i) else "normal"
    return Unigram([(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())])


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids: the pieces of each text."""

    def make() -> Callable[[list[bytes]], dict]:
        c = codec(model)
        return lambda texts: {"ids": pa.array([c.encode(t.decode()) for t in texts], pa.list_(pa.int32()))}

    return map_texts(docs, make, "ids array<int>", ["doc_id"])


def decoded(pieces: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids."""
    schema = "doc_id long, text string"

    def run(batches):
        c = codec(model)
        for batch in batches:
            texts = [c.decode(np.array(x or [], dtype=np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return pieces.select("doc_id", "ids").mapInArrow(run, schema)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32 (little-endian unsigned 32-bit ids), and whether decoding returns the text."""

    def make() -> Callable[[list[bytes]], dict]:
        c = codec(model)
        fallback = np.zeros(len(c.spelled), dtype=bool)
        fallback[list(c.bytes.values())] = True

        def work(texts: list[bytes]) -> dict:
            strings = [t.decode() for t in texts]
            ids = [c.encode(s) for s in strings]
            return {
                "n_pieces": longs([len(x) for x in ids]),
                "n_byte_pieces": longs([np.count_nonzero(fallback[x]) for x in ids]),
                "ids_crc32": longs([zlib.crc32(x.tobytes()) for x in ids]),
                "same_text": pa.array([c.decode(x) == s for x, s in zip(ids, strings, strict=True)]),
            }

        return work

    return map_texts(docs, make, "n_pieces long, n_byte_pieces long, ids_crc32 long, same_text boolean", ["doc_id"])
