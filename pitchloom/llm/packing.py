"""Operator 10: packing of documents into token windows by best-fit decreasing.

A document's ids come from a tokenizer file, with an end id after them. A document longer than a window is first cut into full
windows; each is a sequence of its own. The rests (all shorter than a window) are packed longest first, each into the open
sequence with the least room that holds it, found in a segment tree over remaining capacities. Rests are dealt by a hash of
doc_id into buckets of about BUCKET_ROWS that are packed independently, so the packing is distributed, repeatable, and leaves a
few partly filled sequences a bucket.

Defined results: null or empty text: the end id alone. Repeated rows: packed each. Ties in length: by doc_id. Empty table: empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, longs, map_texts, nested
from .token_counts import byte_alphabet

WINDOW = 2048
END_ID = 1
BUCKET_ROWS = 20_000
#: Words whose ids a worker remembers at most, twice over, and their length in bytes; the memory starts anew when it is full.
REMEMBERED, REMEMBERED_BYTES = 300_000, 40
#: Pieces of words that it remembers at most, twice over: they serve words that were not seen with just this punctuation.
PIECES_REMEMBERED = 100_000
#: Words of printable ASCII and the letters of Latin-1: normal form C leaves them as they are.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: Fixed value: the tokenizer file's splitting pattern, for lower-cased plain words.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


@lru_cache(maxsize=2)
def token_ids(path: str) -> Callable[[bytes], bytes]:
    """A function from a text's UTF-8 to its ids as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its words, one after another; ids of words seen before
    are remembered.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model
    known: dict[bytes, bytes] = {}
    pieces: dict[str, bytes] = {}
    older: list[dict] = [{}, {}]  # what was remembered before the last start anew: frequent words move over
    signs = {byte: sign for sign, byte in byte_alphabet().items()}

    def piece(p: str) -> bytes:
        got = pieces.get(p)
        if got is None:
            if len(pieces) > PIECES_REMEMBERED:
                older[1] = dict(pieces)
                pieces.clear()
            got = older[1].get(p)
            if got is None:
                found = [t.id for t in model.tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(signs))]
                got = struct.pack(f"<{len(found)}I", *found)
            if len(p) <= REMEMBERED_BYTES:
                pieces[p] = got
        return got

    def plain(word: str) -> bytes:
        """Ids of a word of PLAIN characters."""
        return b"".join(map(piece, PIECES.findall(word.lower())))

    def ids(text: bytes) -> bytes:
        words = text.split()
        distinct = set(words)
        if len(known) > REMEMBERED:
            for w in [w for w in known if len(w) > REMEMBERED_BYTES]:
                del known[w]
            older[0] = dict(known)
            known.clear()
        others = []
        for w in distinct:
            if w in known:
                continue
            got = older[0].get(w)
            if got is None:
                s = w.decode()
                if PLAIN.fullmatch(s) and "<|" not in s:
                    got = plain(s)
                else:
                    others.append((w, s))
                    continue
            known[w] = got
        if others:
            for (w, _), g in zip(others, tokenizer.encode_batch_fast([s for _, s in others], add_special_tokens=False), strict=True):
                known[w] = struct.pack(f"<{len(g.ids)}I", *g.ids)
        return b"".join(map(known.__getitem__, words))

    return ids


def piece_maker(path: str) -> Callable[[], Callable[[list[bytes]], dict]]:
    def make() -> Callable[[list[bytes]], dict]:
        ids = token_ids(path)
        end = np.array([END_ID], dtype="<u4").tobytes()

        def pieces(texts: list[bytes]) -> dict:
            total, crcs, counts = [], [], []
            for t in texts:
                x = ids(t) + end
                own = [zlib.crc32(x[k : k + 4 * WINDOW]) for k in range(0, len(x), 4 * WINDOW)]
                total.append(len(x) // 4)
                crcs += own
                counts.append(len(own))
            return {"doc_tokens": longs(total), "crcs": nested(np.array(crcs, dtype=np.int64), counts, pa.int64())}

        return pieces

    return make


class Capacities:
    """A segment tree over remaining capacities 0..size-1: how many open sequences have each, and the least one that is enough."""

    def __init__(self, size: int):
        self.size = 1 << max(0, size - 1).bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def add(self, room: int, item: tuple[int, int]) -> None:
        self.open[room].append(item)
        k = room + self.size
        while k:
            self.tree[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, tuple[int, int]] | None:
        """Removes the sequence with the least room of at least `need`."""
        k = need + self.size
        while not self.tree[k]:  # up to the first right neighbour that has one
            while k & 1:
                k >>= 1
                if not k:
                    return None
            k += 1
        while k < self.size:
            k = 2 * k if self.tree[2 * k] else 2 * k + 1
        room = k - self.size
        item = self.open[room].pop()
        while k:
            self.tree[k] -= 1
            k >>= 1
        return room, item


def best_fit(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece; lengths, all at most window, must come longest first."""
    tree, out, n = Capacities(window + 1), [], 0
    for length in lengths:
        found = tree.take(length)
        room, (sequence, offset) = found or (window, (n, 0))
        n += found is None
        out.append((sequence, offset))
        if room > length:
            tree.add(room - length, (sequence, offset + length))
    return out


def packed(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    made = cut(map_texts(docs, piece_maker(tokenizer), "doc_tokens long, crcs array<long>", ["doc_id"]))
    pieces = made.select("doc_id", "doc_tokens", F.posexplode("crcs").alias("k", "ids_crc32"))
    start = F.col("k").cast("long") * WINDOW
    pieces = pieces.select("doc_id", start.alias("start"), F.least(F.lit(WINDOW), F.col("doc_tokens") - start).alias("length"), "ids_crc32", "doc_tokens")
    n = max(1, -(-made.count() // BUCKET_ROWS))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(n)))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        places = best_fit(table.column("length").to_pylist(), WINDOW)
        first = key[0].as_py() << 32  # a bucket has fewer sequences
        table = table.drop_columns(["bucket"]).append_column("sequence_id", longs([first + s for s, _ in places]))
        return table.append_column("offset", longs([o for _, o in places]))

    return dealt.groupBy("bucket").applyInArrow(pack, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
