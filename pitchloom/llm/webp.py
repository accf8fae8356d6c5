"""Operator 8: media columns in lossless WebP.

A text's UTF-8, filled up with bytes 255 to a multiple of ROW_BYTES, becomes the samples of an image, which is stored as a lossless WebP file (several, one after another, if it
has more than MOST_ROWS rows) and read back. The form follows the content: samples of at most 16 values are grey pixels with a palette, which packs two to eight of them into
one; texts whose groups of three samples come four times or more on average are RGB pixels with a colour cache; others are grey pixels whose red and blue are what subtract-green
leaves. All have back-references to equal stretches before. The reader takes any file of
the format: prefix codes (simple and normal, one group or several), back-references, colour cache, and the inverse predictor, cross-colour, subtract-green and
palette transforms. With one group of codes, code lengths are looked up at every bit position at once, and a
walk over them finds the pixels; other files are read pixel by pixel.

Defined results: null or empty text: one row of 255. Equal texts give equal files. Repeated rows: stored each. Empty table: empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import longs, map_texts, strings

ROW_BYTES, MOST_ROWS = 576, 16384
#: Fixed values of the format: the order in which lengths of the code-length code come, and the near pixels (dx, dy) of short distance codes.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
NEAR = """0,1 1,0 1,1 -1,1 0,2 2,0 1,2 -1,2 2,1 -2,1 2,2 -2,2 0,3 3,0 1,3 -1,3 3,1 -3,1 2,3 -2,3 3,2 -3,2 0,4 4,0 1,4 -1,4 4,1 -4,1 3,3 -3,3
2,4 -2,4 4,2 -4,2 0,5 3,4 -3,4 4,3 -4,3 5,0 1,5 -1,5 5,1 -5,1 2,5 -2,5 5,2 -5,2 4,4 -4,4 3,5 -3,5 5,3 -5,3 0,6 6,0 1,6 -1,6 6,1 -6,1
2,6 -2,6 6,2 -6,2 4,5 -4,5 5,4 -5,4 3,6 -3,6 6,3 -6,3 0,7 7,0 1,7 -1,7 5,5 -5,5 7,1 -7,1 4,6 -4,6 6,4 -6,4 2,7 -2,7 7,2 -7,2 3,7 -3,7
7,3 -7,3 5,6 -5,6 6,5 -6,5 8,0 4,7 -4,7 7,4 -7,4 8,1 8,2 6,6 -6,6 8,3 5,7 -5,7 7,5 -7,5 8,4 6,7 -6,7 7,6 -7,6 8,5 7,7 -7,7 8,6 8,7"""
DISTANCES = [tuple(map(int, x.split(","))) for x in NEAR.split()]
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Alphabets of the five codes of a group, without the colour cache: green with lengths, red, blue, alpha, distance.
ALPHABETS = (256 + 24, 256, 256, 256, 40)
#: Least pixels of a back-reference in a grey and in an RGB image (powers of two), most pixels, and how far back it may reach.
LEAST_GREY, LEAST_RGB, MOST_COPIED, MOST_BACK = 16, 4, 4096, 1 << 16


# ---- prefix codes


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code of each symbol, first bit lowest."""
    codes = np.zeros(len(lengths), dtype=np.int64)
    used = np.flatnonzero(lengths)
    if len(used):
        most = int(lengths.max())
        order = used[np.argsort(lengths[used], kind="stable")]
        spread = 1 << (most - lengths[order])
        codes[order] = reversal(most)[np.cumsum(spread) - spread]
    return codes


REVERSED: dict[int, np.ndarray] = {}


def reversal(bits: int) -> np.ndarray:
    """Each number below 2**bits with its bits in reverse."""
    if bits not in REVERSED:
        out = np.zeros(1, dtype=np.int64)
        for _ in range(bits):
            out = np.r_[2 * out, 2 * out + 1]
        REVERSED[bits] = out
    return REVERSED[bits]


NOTHING = np.zeros(1, dtype=np.int64)


class Code:
    """A prefix code as tables over its next `bits` bits: the symbol and its length (0: the only symbol)."""

    def __init__(self, lengths: np.ndarray):
        used = lengths.nonzero()[0]
        if len(used) < 2:
            self.bits, self.symbol, self.length = 0, used if len(used) else NOTHING, NOTHING
            return
        lengths = lengths[used]
        self.bits = int(lengths.max())
        order = np.argsort(lengths, kind="stable")
        lengths = lengths[order]
        spread = 1 << (self.bits - lengths)
        assert spread.sum() == 1 << self.bits, "not a full prefix code"
        at = reversal(self.bits)
        self.symbol, self.length = np.repeat(used[order], spread)[at], np.repeat(lengths, spread)[at]

    def lists(self) -> tuple[list[int], list[int]]:
        if not hasattr(self, "listed"):
            self.listed = self.symbol.tolist(), self.length.tolist()
        return self.listed


NONE = 1 << 60  # more than any weight


def huffman(counts: np.ndarray, most: int) -> np.ndarray:
    """Code lengths of at most `most` bits; a lone symbol gets one bit. Leaves and joined nodes are two queues, each in order of weight."""
    lengths = np.zeros(len(counts), dtype=np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    counts = counts[used]
    while True:
        order, n = np.argsort(counts, kind="stable"), len(used)
        leaf, node, parent = [*counts[order].tolist(), NONE], [], [0] * (2 * n - 1)
        i = j = 0
        for k in range(n, 2 * n - 1):  # node[m] has number n + m
            node.append(NONE)
            if leaf[i] <= node[j]:
                total, parent[i], i = leaf[i], k, i + 1
            else:
                total, parent[n + j], j = node[j], k, j + 1
            if leaf[i] <= node[j]:
                total, parent[i], i = total + leaf[i], k, i + 1
            else:
                total, parent[n + j], j = total + node[j], k, j + 1
            node[-1] = total
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth) <= most:
            lengths[used[order]] = depth[:n]
            return lengths
        counts = counts // 2 + 1


# ---- reading


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        a = self.at >> 3
        got = int.from_bytes(self.data[a : a + 5], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return got

    def symbol(self, code: Code) -> int:
        if not code.bits:
            return int(code.symbol[0])
        a = self.at >> 3
        window = int.from_bytes(self.data[a : a + 4], "little") >> (self.at & 7) & ((1 << code.bits) - 1)
        self.at += int(code.length[window])
        return int(code.symbol[window])

    def number(self, prefix: int) -> int:
        """A length or distance from its prefix symbol."""
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + self.read(extra) + 1


@lru_cache(maxsize=64)
def length_code_of(packed: int, n: int) -> Code:
    """The code for code lengths from its own n lengths, three bits each."""
    lengths = np.zeros(19, dtype=np.int64)
    for i, k in enumerate(LENGTH_ORDER[:n]):
        lengths[k] = packed >> 3 * i & 7
    return Code(lengths)


def read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, dtype=np.int64)
    if bits.read(1):
        two = bits.read(1)
        if not two:
            lone = Code(NOTHING)
            lone.symbol = np.array([bits.read(8 if bits.read(1) else 1)])
            return lone
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        lengths[bits.read(8)] = 1
        return Code(lengths)
    n = 4 + bits.read(4)
    packed = bits.read(30) | bits.read(27) << 30 if n == 19 else sum(bits.read(3) << 3 * k for k in range(n))
    code = length_code_of(packed, n)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    symbol, length, mask = *code.lists(), (1 << code.bits) - 1
    a, used = bits.at >> 3, bits.at & 7
    window = int.from_bytes(bits.data[a : a + 2 * size], "little") >> used  # 14 bits a length at most
    start, found, before, k = bits.at, [0] * (size + 138), 8, 0
    while k < size and left:
        left -= 1
        s, n = symbol[window & mask], length[window & mask]
        window >>= n
        start += n
        if s < 16:
            if s:
                found[k] = before = s
            k += 1
            continue
        n, least = ((2, 3), (3, 3), (7, 11))[s - 16]
        times = least + (window & ((1 << n) - 1))
        window >>= n
        start += n
        if s == 16:
            found[k : k + times] = [before] * times
        k += times
    bits.at = start
    return Code(np.array(found[:size], dtype=np.int64))


def far(code: int, width: int) -> int:
    """The distance in pixels of a distance code."""
    if code > len(DISTANCES):
        return code - len(DISTANCES)
    dx, dy = DISTANCES[code - 1]
    return max(1, dx + dy * width)


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels as unsigned 32-bit ARGB, row by row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    block, groups_of, n_groups = 0, None, 1
    if main and bits.read(1):
        block = bits.read(3) + 2
        groups_of = (read_image(bits, -(-width >> block), -(-height >> block), False) >> 8) & 0xFFFF
        n_groups = int(groups_of.max()) + 1
    sizes = (ALPHABETS[0] + (1 << cache_bits if cache_bits else 0), *ALPHABETS[1:])
    groups = [[read_code(bits, n) for n in sizes] for _ in range(n_groups)]
    if n_groups == 1:
        return read_fast(bits, width, width * height, groups[0], cache_bits)
    out = [0] * (width * height)
    cache, done, k = [0] * (1 << cache_bits), 0, 0
    across = -(-width >> block) if block else 1
    while k < len(out):
        group = groups[int(groups_of[(k // width >> block) * across + (k % width >> block)])] if block else groups[0]
        s = bits.symbol(group[0])
        if s < 256:
            red, blue, alpha = (bits.symbol(c) for c in group[1:4])
            out[k] = alpha << 24 | red << 16 | s << 8 | blue
            k += 1
        elif s < ALPHABETS[0]:
            length = bits.number(s - 256)
            back = far(bits.number(bits.symbol(group[4])), width)
            for _ in range(min(length, len(out) - k)):
                out[k] = out[k - back]
                k += 1
        else:
            for p in out[done:k]:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            done = k
            out[k] = cache[s - ALPHABETS[0]]
            k += 1
    return np.array(out, dtype=np.uint32)


def read_fast(bits: Bits, width: int, n: int, group: list[Code], cache_bits: int) -> np.ndarray:
    """Pixels of an image with one group of codes."""
    codes = group[:4]
    if not any(c.bits for c in codes) and codes[0].symbol[0] < 256:
        green, red, blue, alpha = (int(c.symbol[0]) for c in codes)
        return np.full(n, alpha << 24 | red << 16 | green << 8 | blue, dtype=np.uint32)
    raw = np.frombuffer(bits.data[bits.at >> 3 :] + b"\0" * 16, dtype=np.uint8).astype(np.uint32)
    loaded = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16
    window = (loaded[:, None] >> np.arange(8, dtype=np.uint32)).reshape(-1)  # the bits from each place on; 15 are enough
    last = len(window) - 1
    mask = np.uint32((1 << codes[0].bits) - 1)
    special = codes[0].symbol >= 256
    if not cache_bits and not any(c.bits for c in codes[1:]):  # a grey image
        own = [None] * 4
        steps = np.where(special, 0, codes[0].length)[window & mask]
    else:
        own = [c.length[window & ((1 << c.bits) - 1)] if c.bits else None for c in codes]
        step = first = own[0] if own[0] is not None else np.zeros(len(window), dtype=np.int64)
        for sizes in own[1:]:
            if sizes is not None:
                at = np.arange(len(window)) + step
                step = step + sizes[np.minimum(at, last, out=at)]
        if special.any():
            green = codes[0].symbol[window & mask]
            step = np.where(green < 256, step, np.where(green < ALPHABETS[0], 0, first))
        steps = step
    at, base = bits.at & 7, bits.at & ~7
    one = np.minimum(np.arange(last + 1) + steps, last)
    two = one[one]
    four = two[two]
    eight = four[four]
    far_on, near_on, ends = memoryview(eight), memoryview(one), memoryview(steps)
    found: list[int] = []
    sizes_of_runs, copies, k = [], [], 0  # tokens up to each copy, and (length, distance) of the copy
    seen = found.append
    while k < n:
        before, left = len(found), n - k
        while ends[at] and left > 0:  # in strides of eight tokens; a stride ends early at a copy, where steps are 0
            seen(at)
            at = far_on[at]
            left -= 8
        tokens = n - k
        if not ends[at] and found and len(found) > before:
            place, tokens = found[-1], 8 * (len(found) - before - 1)
            while ends[place]:
                place, tokens = near_on[place], tokens + 1
            at = place
        elif not ends[at]:
            tokens = 0
        if tokens >= n - k:
            tokens = n - k
            place = found[-1] if len(found) > before else at
            for _ in range(tokens - 8 * (len(found) - before - 1) if len(found) > before else 0):
                place = near_on[place]
            at = place
        sizes_of_runs.append((len(found) - before, tokens))
        k += tokens
        if k < n:
            bits.at = base + at
            length = min(bits.number(bits.symbol(codes[0]) - 256), n - k)
            copies.append((length, far(bits.number(bits.symbol(group[4])), width)))
            k += length
            at = bits.at - base
    bits.at = base + at
    stride = np.array(found, dtype=np.int64)
    odd = one[stride]
    strides = np.stack([stride, odd, two[stride], two[odd], four[stride], four[odd], four[two[stride]], four[two[odd]]], axis=1) if len(found) else np.zeros((0, 8), dtype=np.int64)
    kept, row = np.zeros(8 * len(found), dtype=bool), 0
    for rows, tokens in sizes_of_runs:
        kept[8 * row : 8 * row + tokens] = True
        row += rows
    runs = np.cumsum([t for _, t in sizes_of_runs]).tolist()
    at = strides.reshape(-1)[kept]
    token = codes[0].symbol[window[at] & mask]
    value = (token.astype(np.uint32) & np.uint32(255)) << np.uint32(8)
    for k, shift in ((1, 16), (2, 0), (3, 24)):
        if own[k - 1] is not None and any(c.bits for c in codes[k:]):
            at = np.minimum(at + own[k - 1][at], last)
        value |= codes[k].symbol[window[at] & ((1 << codes[k].bits) - 1)].astype(np.uint32) << np.uint32(shift) if codes[k].bits else np.uint32(int(codes[k].symbol[0]) << shift)
    if cache_bits:
        return resolved(token, value, runs, copies, cache_bits)
    out, done, k = np.zeros(n, dtype=np.uint32), 0, 0
    for end, (length, back) in zip(runs, [*copies, (0, 1)], strict=False):
        out[k : k + end - done] = value[done:end]
        k, done = k + end - done, end
        done_now = 0
        while done_now < length:  # what is copied doubles where it overlaps itself
            part = min(back + done_now, length - done_now)
            out[k + done_now : k + done_now + part] = out[k - back : k - back + part]
            done_now += part
        k += length
    return out


def slots(pixels: np.ndarray, cache_bits: int) -> np.ndarray:
    return (np.uint32(CACHE_FACTOR) * pixels) >> np.uint32(32 - cache_bits)


def resolved(token: np.ndarray, value: np.ndarray, runs: list[int], copies: list[tuple[int, int]], cache_bits: int) -> np.ndarray:
    """Pixels of literals, colour cache hits and copies; each pixel goes into the cache."""
    hit = token >= ALPHABETS[0]
    value, slot, hit = value.tolist(), np.where(hit, token - ALPHABETS[0], slots(value, cache_bits)).tolist(), hit.tolist()
    cache, out, done = [0] * (1 << cache_bits), [], 0
    add, shift = out.append, 32 - cache_bits
    for end, (length, back) in zip(runs, [*copies, (0, 1)]):
        for k in range(done, end):
            if hit[k]:
                add(cache[slot[k]])
            else:
                cache[slot[k]] = value[k]
                add(value[k])
        done = end
        for _ in range(length):
            p = out[-back]
            cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
            add(p)
    return np.array(out, dtype=np.uint32)


# ---- transforms; images are arrays of rows, columns and the channels alpha, red, green, blue


def channels(pixels: np.ndarray, width: int) -> np.ndarray:
    return np.stack([pixels >> s & 0xFF for s in (24, 16, 8, 0)], axis=-1).astype(np.int64).reshape(-1, width, 4)


def pixels(image: np.ndarray) -> np.ndarray:
    a, r, g, b = (image[..., k].reshape(-1).astype(np.uint32) & 0xFF for k in range(4))
    return a << 24 | r << 16 | g << 8 | b


def predicted(mode: int, left, top, top_left, top_right):
    half = lambda x, y: (x + y) >> 1
    if mode == 0:
        return np.array([255, 0, 0, 0])
    if mode < 5:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return half(half(left, top_right), top)
    if mode < 10:
        return half(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return half(half(left, top_left), half(top, top_right))
    if mode == 11:
        near_left = np.abs(top - top_left).sum() < np.abs(left - top_left).sum()
        return left if near_left else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    mean = half(left, top)
    return np.clip(mean + ((mean - top_left) / 2).astype(np.int64), 0, 255)


def predict(image: np.ndarray, modes: np.ndarray, block: int, inverse: bool) -> np.ndarray:
    """Adds (inverse) or takes away each pixel's prediction from its neighbours."""
    out = image.copy()
    seen = out if inverse else image
    height, width = image.shape[:2]
    sign = 1 if inverse else -1
    for y in range(height):
        for x in range(width):
            if not y:
                guess = seen[0, x - 1] if x else np.array([255, 0, 0, 0])
            elif not x:
                guess = seen[y - 1, 0]
            else:
                right = seen[y - 1, x + 1] if x + 1 < width else seen[y, 0]
                guess = predicted(int(modes[y >> block, x >> block]), seen[y, x - 1], seen[y - 1, x], seen[y - 1, x - 1], right)
            out[y, x] = (image[y, x] + sign * guess) & 0xFF
    return out


def cross_colour(image: np.ndarray, elements: np.ndarray, block: int, inverse: bool) -> np.ndarray:
    height, width = image.shape[:2]
    own = elements[np.arange(height)[:, None] >> block, np.arange(width)[None, :] >> block]
    signed = lambda x: ((x & 0xFF) ^ 0x80) - 0x80
    delta = lambda factor, colour: signed(factor) * signed(colour) >> 5
    out, sign = image.copy(), 1 if inverse else -1
    red, green = image[..., 1], image[..., 2]
    new_red = (red + sign * delta(own[..., 3], green)) & 0xFF
    source_red = new_red if inverse else red
    out[..., 1] = new_red
    out[..., 3] = (image[..., 3] + sign * (delta(own[..., 2], green) + delta(own[..., 1], source_red))) & 0xFF
    return out


def subtract_green(image: np.ndarray) -> np.ndarray:
    out = image.copy()
    out[..., 1::2] = (image[..., 1::2] - image[..., 2:3]) & 0xFF
    return out


def pack_bits(size: int) -> int:
    """How many bits of the column number a palette of this size packs into one pixel."""
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def read_pixels(data: bytes) -> tuple[np.ndarray, int]:
    """The pixels of a file as unsigned 32-bit ARGB, row by row, and its width."""
    assert data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8L" and data[20] == 0x2F, "not a lossless WebP file"
    bits = Bits(data[21 : 20 + struct.unpack("<I", data[16:20])[0]])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(4)
    full, todo = width, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            across = -(-width >> block)
            part = channels(read_image(bits, across, -(-height >> block), False), across)
            todo.append((kind, (part[..., 2] & 15 if kind == PREDICTOR else part, block)))
        elif kind == PALETTE:
            size = bits.read(8) + 1
            table = np.cumsum(channels(read_image(bits, size, 1, False), size)[0], axis=0) & 0xFF
            todo.append((kind, (pixels(table), width)))
            width = -(-width >> pack_bits(size))
        else:
            todo.append((kind, None))
    found = read_image(bits, width, height, True)
    for kind, own in reversed(todo):
        if kind == PALETTE:
            table, across = own
            each = 8 >> pack_bits(len(table))
            index = (found >> 8 & 0xFF).reshape(height, -1)
            if each < 8:
                x = np.arange(across)
                index = index[:, x * each // 8] >> (x * each % 8).astype(np.uint32) & ((1 << each) - 1)
            found = np.concatenate([table, np.zeros(256, dtype=np.uint32)])[index.reshape(-1)]
            width = across
        elif kind == SUBTRACT_GREEN:
            green = found >> 8 & np.uint32(255)
            found = (found & np.uint32(0xFF00FF00)) | ((found & np.uint32(0xFF00FF)) + (green << np.uint32(16) | green) & np.uint32(0xFF00FF))
        else:
            found = pixels((predict if kind == PREDICTOR else cross_colour)(channels(found, width), *own, True))
    return found, full


def read_file(data: bytes) -> np.ndarray:
    """The image of a file as rows, columns and channels (alpha, red, green, blue)."""
    return channels(*read_pixels(data))


# ---- writing


class Writer:
    """Bits from the lowest on."""

    def __init__(self):
        self.value = self.size = 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def write_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """The values, sizes[i] bits (at most 32, so that they fit a word and its neighbour) each. Codes lie beside each other in 32-bit words, so sums of shifted values are exact."""
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        starts = ends - sizes
        shifted = values.astype(np.uint64) << (starts & 31).astype(np.uint64)
        word, n = starts >> 5, (total >> 5) + 2
        words = np.bincount(word, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), n) + np.bincount(word + 1, (shifted >> np.uint64(32)).astype(np.float64), n)
        self.write(int.from_bytes(words.astype("<u4").tobytes(), "little"), total)

    def data(self) -> bytes:
        return self.value.to_bytes(-(-self.size // 8), "little")


def length_code() -> tuple[np.ndarray, np.ndarray]:
    """The writer's code for code lengths, a full one for every image: five bits for the six rarest, four for the others."""
    lengths = np.full(19, 4, dtype=np.int64)
    lengths[[1, 2, 13, 14, 15, 16]] = 5
    return lengths, canonical(lengths)


LENGTH_CODE = length_code()


def write_code(out: Writer, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes a code for symbols with these counts; returns codes and lengths (0: nothing to write)."""
    used = counts.nonzero()[0]
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        symbols = used.tolist() or [0]
        out.write(1 | (len(symbols) - 1) << 1 | 1 << 2, 3)
        for s in symbols:
            out.write(s, 8)
        lengths = np.zeros(len(counts), dtype=np.int64)
        if len(symbols) == 1:
            return lengths, lengths
        lengths[symbols] = 1
        return canonical(lengths), lengths
    if len(used) == 1:
        counts = counts.copy()
        counts[0] = 1
    lengths = huffman(counts, 15)
    used = np.flatnonzero(lengths)
    gap = np.diff(used, prepend=-1) - 1
    first = np.where(gap >= 3, -(-gap // 138), gap)  # tokens before each length: one for up to 138 zeros, or single zeros
    ends = np.cumsum(first + 1)
    tokens = int(ends[-1])  # the rest has no length
    symbol, extra, size = (np.zeros(tokens, dtype=np.int64) for _ in range(3))
    symbol[ends - 1] = lengths[used]
    for at, n in zip((ends - 1 - first)[gap >= 3].tolist(), gap[gap >= 3].tolist()):
        while n > 0:
            few = min(n, 138) if not 138 < n < 141 else n - 3  # three at least are left over
            symbol[at], extra[at], size[at] = (17, few - 3, 3) if few < 11 else (18, few - 11, 7)
            n, at = n - few, at + 1
    own, own_codes = LENGTH_CODE
    out.write(0, 1)
    out.write(15, 4)
    out.write(sum(n << 3 * k for k, n in enumerate(own[LENGTH_ORDER].tolist())), 57)
    if used[-1] + 1 < len(lengths) and tokens >= 2:
        n = max(1, -(-(tokens - 2).bit_length() // 2))
        out.write(1 | (n - 1) << 1, 4)
        out.write(tokens - 2, 2 * n)
    else:
        pad = len(lengths) - int(used[-1]) - 1
        out.write(0, 1)
        assert not pad or tokens < 2
        symbol = np.concatenate([symbol, np.zeros(pad, dtype=np.int64)])
        extra, size = (np.concatenate([x, np.zeros(pad, dtype=np.int64)]) for x in (extra, size))
    out.write_all(np.stack([own_codes[symbol], extra], axis=1).reshape(-1), np.stack([own[symbol], size], axis=1).reshape(-1))
    return canonical(lengths), lengths


def prefix_of(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra value and extra bits of a length or distance."""
    if value < 5:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    return 2 * high + second, v - ((2 + second) << (high - 1)), high - 1


def repeats(image: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(place, length, distance) of stretches of `least` pixels or more that stand before, greedily from the left: where so many pixels last stood, as far as they go on."""
    n = len(image)
    if n < least + 1:
        return []
    key, width = image.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1
    while width < least:  # keys of windows twice as wide
        key, width = key[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + key[width:], 2 * width
    order = np.argsort((key >> np.uint64(48)).astype(np.uint16), kind="stable")  # sixteen bits are sorted by radix; a chance collision between two equal ones hides a copy, no more
    key = key[order]
    same = key[1:] == key[:-1]
    at, before = order[1:][same], order[:-1][same]
    near = at - before <= MOST_BACK
    at, before = at[near], before[near]
    by_place = np.argsort(at)
    out, done, data = [], 0, image.tobytes()
    for i, j in zip(at[by_place].tolist(), before[by_place].tolist()):
        if i < done:
            continue
        length, piece = 0, 16
        while length < MOST_COPIED:  # in pieces that grow while they are equal
            a, b = data[4 * (i + length) : 4 * (i + length + piece)], data[4 * (j + length) : 4 * (j + length) + min(4 * piece, len(data) - 4 * (i + length))]
            if a != b:
                length += int(np.argmax(image[i + length : i + length + piece] != image[j + length : j + length + len(a) // 4]))
                break
            length += len(a) // 4
            if len(a) < 4 * piece:
                break
            piece *= 2
        length = min(length, MOST_COPIED, n - i)
        if length >= least:
            out.append((i, length, i - j))
            done = i + length
    return out


def distance_code(back: int, width: int) -> int:
    return next((k + 1 for k, (dx, dy) in enumerate(DISTANCES) if dx + dy * width == back), back + len(DISTANCES)) if back == 1 or abs(back - round(back / width) * width) <= 8 and back <= 8 * width + 8 else back + len(DISTANCES)


def cache_hits(image: np.ndarray, cache_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each pixel, and whether the last pixel of that slot is the same."""
    slot = slots(image, cache_bits).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    hit = np.zeros(len(image), dtype=bool)
    hit[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (image[order[1:]] == image[order[:-1]])
    return slot, hit


def write_image(out: Writer, image: np.ndarray, width: int, main: bool, copies: int = 0, cache_bits: int = 0, grey: bool = False) -> None:
    """image: ARGB pixels; grey: only green varies. copies: writes stretches of so many pixels (a power of two) or more that stand before as back-references; cache_bits: uses a colour cache."""
    out.write(1 | cache_bits << 1, 5) if cache_bits else out.write(0, 1)
    if main:
        out.write(0, 1)
    stays = np.ones(len(image), dtype=bool)
    back = repeats(image, copies) if copies else []
    for i, length, _ in back:
        stays[i : i + length] = False
    place = np.flatnonzero(stays)
    plain = image[place]
    same = [int(image[0]) >> s & 0xFF if grey else None for s in (16, 0, 24)]  # red, blue, alpha where they do not vary
    channel = [(plain >> 8 & 0xFF).astype(np.int64), *((plain >> s & 0xFF).astype(np.int64) if v is None else None for s, v in zip((16, 0, 24), same))]
    literal, token = np.ones(len(place), dtype=bool), channel[0]
    if cache_bits:
        token = token.copy()
        slot, hit = cache_hits(image, cache_bits)
        literal = ~hit[place]
        token[~literal] = ALPHABETS[0] + slot[place][~literal]
    lengths = [prefix_of(n) for _, n, _ in back]
    distances = [prefix_of(distance_code(d, width)) for _, _, d in back]
    size = ALPHABETS[0] + (1 << cache_bits if cache_bits else 0)
    counts = np.bincount(token, minlength=size)
    for s, _, _ in lengths:
        counts[256 + s] += 1
    codes = [write_code(out, counts)]
    for x, v, n in zip(channel[1:], same, ALPHABETS[1:4], strict=True):
        if v is not None or (x == x[0]).all():
            out.write(5 | (int(x[0]) if v is None else v) << 3, 11)  # one symbol of eight bits
            codes.append((NOTHING, NOTHING))
        else:
            codes.append(write_code(out, np.bincount(x[literal], minlength=n)))
    codes.append(write_code(out, np.bincount(np.array([s for s, _, _ in distances], dtype=np.int64), minlength=ALPHABETS[4])))
    shown = [k for k in range(4) if codes[k][1].any()]
    columns = max(1, len(shown), 2 * bool(back))
    value, bits = (np.zeros((len(image), columns), dtype=np.int64) for _ in range(2))  # a row a pixel; copied ones have no bits
    for column, k in enumerate(shown):
        value[place, column] = codes[k][0][channel[k] if k else token]
        bits[place, column] = codes[k][1][token] if not k else np.where(literal, codes[k][1][channel[k]], 0) if cache_bits else codes[k][1][channel[k]]
    for (i, _, _), *pair in zip(back, lengths, distances):
        for column, (s, extra, n), (code, size), first in zip((0, 1), pair, (codes[0], codes[4]), (256, 0)):
            value[i, column], bits[i, column] = int(code[first + s]) | extra << int(size[first + s]), size[first + s] + n
    for k in range(0, len(value), 1 << 16):  # bounds the bits held apart
        some, size = value[k : k + (1 << 16)].reshape(-1), bits[k : k + (1 << 16)].reshape(-1)
        has = size > 0
        out.write_all(some[has], size[has])


def write_file(image: np.ndarray, transforms: tuple[int, ...] = (), block: int = 2, copies: int = 0, cache_bits: int = 0) -> bytes:
    """A file of an image of rows, columns and channels; transforms are applied in the order given."""
    height, width = image.shape[:2]
    out = Writer()
    out.write(width - 1, 14)
    out.write(height - 1, 14)
    out.write(1, 1)
    out.write(0, 3)
    for kind in transforms:
        out.write(1 | kind << 1, 3)
        across, down = -(-width >> block), -(-height >> block)
        if kind == PREDICTOR:
            modes = np.arange(across * down).reshape(down, across) % 14
            out.write(block - 2, 3)
            write_image(out, (modes << 8).reshape(-1).astype(np.uint32), across, False)
            image = predict(image, modes, block, False)
        elif kind == CROSS_COLOUR:
            elements = (np.arange(across * down * 4).reshape(down, across, 4) * 37) & 0xFF
            out.write(block - 2, 3)
            write_image(out, pixels(elements), across, False)
            image = cross_colour(image, elements, block, False)
        elif kind == SUBTRACT_GREEN:
            image = subtract_green(image)
        else:
            packed, width = indexed(out, pixels(image), width)
            image = channels(packed, width)
    out.write(0, 1)
    write_image(out, pixels(image), width, True, copies, cache_bits)
    return wrapped(out)


# ---- texts


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % ROW_BYTES if text else ROW_BYTES)


def stored(payload: bytes) -> bytes:
    """The payload as images, one after another."""
    most = ROW_BYTES * MOST_ROWS
    return b"".join(write_samples(np.frombuffer(payload[k : k + most], dtype=np.uint8)) for k in range(0, len(payload), most))


def write_samples(samples: np.ndarray) -> bytes:
    wide, out, cache_bits, copies = samples.astype(np.uint32), Writer(), 0, LEAST_GREY
    height, width = len(samples) // ROW_BYTES, ROW_BYTES
    few = np.count_nonzero(np.bincount(samples, minlength=256)) <= 16
    if not few:
        three = wide[::3] << 16 | wide[1::3] << 8 | wide[2::3]
        ordered = np.sort(three)
        distinct = 1 + np.count_nonzero(ordered[1:] != ordered[:-1])
        if 4 * distinct <= len(three):
            cache_bits, width, copies = min(10, int(distinct).bit_length()), ROW_BYTES // 3, LEAST_RGB
    image = np.uint32(0xFF000000) | (three if cache_bits else wide << 8)
    out.write(width - 1, 14)
    out.write(height - 1, 14)
    out.write(0, 4)
    if few:
        out.write(1 | PALETTE << 1, 3)
        image, width = indexed(out, image, width)
    elif not cache_bits:
        out.write(1 | SUBTRACT_GREEN << 1, 3)
    out.write(0, 1)
    write_image(out, image, width, True, copies, cache_bits, not cache_bits)
    return wrapped(out)


def wrapped(out: Writer) -> bytes:
    body = b"\x2f" + out.data()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def indexed(out: Writer, image: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """Writes the palette of ARGB pixels; returns the pixels that hold the packed numbers of colours, and their width."""
    table, index = np.unique(image, return_inverse=True)
    assert len(table) <= 256, "too many colours for a palette"
    out.write(len(table) - 1, 8)
    write_image(out, pixels(np.diff(channels(table, len(table))[0], axis=0, prepend=0) & 0xFF), len(table), False)
    each = 8 >> pack_bits(len(table))
    index, x = index.reshape(-1, width), np.arange(width)
    packed = np.zeros((len(index), -(-width >> pack_bits(len(table)))), dtype=np.uint32)
    for k in range(8 // each):
        own = x[x % (8 // each) == k]
        packed[:, own * each // 8] |= (index[:, own] << (k * each)).astype(np.uint32)
    return (np.uint32(0xFF000000) | packed << 8).reshape(-1), packed.shape[1]


def read_back(media: bytes) -> bytes:
    """The samples of images: all three colours of an RGB one, one of a grey one."""
    out, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        found, width = read_pixels(media[at : at + size])
        bytes_ = found.astype(">u4").view(np.uint8).reshape(-1, 4)
        out.append(bytes_[:, 2].tobytes() if width == ROW_BYTES else bytes_[:, 1:].tobytes())
        at += size
    return b"".join(out)


def feature(payload: bytes) -> str:
    """rows, least, greatest, distinct samples and mean of the samples."""
    counts = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256)
    seen = np.flatnonzero(counts)
    return f"{len(payload) // ROW_BYTES}:{seen[0]}:{seen[-1]}:{len(seen)}:{(counts * np.arange(256)).sum() / len(payload):.4f}"


def media_digests(docs: DataFrame) -> DataFrame:
    """doc_id and what the stored form and its samples, read back, are like."""
    columns = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def make() -> Callable[[list[bytes]], dict]:
        def work(texts: list[bytes]) -> dict:
            media = [stored(payload_of(t)) for t in texts]
            back = [read_back(m) for m in media]
            digest = lambda items: strings([hashlib.sha256(x).hexdigest() for x in items])
            return {
                "n_bytes": longs([len(t) for t in texts]),
                "payload_bytes": longs([len(x) for x in back]),
                "payload_sha256": digest(back),
                "tail_crc32": longs([zlib.crc32(x[-32:]) for x in back]),
                "media_bytes": longs([len(m) for m in media]),
                "media_sha256": digest(media),
                "feature": strings([feature(x) for x in back]),
            }

        return work

    return map_texts(docs, make, columns, ["doc_id"])


def images(docs: DataFrame) -> DataFrame:
    """doc_id and media: the stored form of each text."""
    return map_texts(docs, lambda: lambda texts: {"media": pa.array([stored(payload_of(t)) for t in texts], pa.binary())}, "media binary", ["doc_id"])
