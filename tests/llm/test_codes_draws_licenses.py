"""Operators 11 to 13 against brute force, and their defined results for odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pitchloom.llm import importance, licenses, vector_codes

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ODD = [None, "", " \n ", "one", "é🙂 日本\u0000x Äb", "mit license " * 30000, "same text here for all of us now", "same text here for all of us now"]


def low(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", "z", "w") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, bucket string, word string, `a.b` string, hits string")


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and not any(x is None or not math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    d = len(kept[0][1]) // parts
    cut = lambda v, k: v[k * d : (k + 1) * d]
    books = [[cut(v, k) for _, v, _ in kept[:entries]] for k in range(parts)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(e, x)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            own = [(nearest(books[k], cut(v, k))[1], cut(v, k)) for _, v, _ in kept]
            for j in range(len(books[k])):
                of = [x for at, x in own if at == j]
                if of:
                    books[k][j] = [sum(c) // len(of) for c in zip(*of)]
    out, by_label = [], Counter()
    for i, v, label in kept:
        found = [nearest(books[k], cut(v, k)) for k in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(s for s, _ in found), label))
        by_label[label] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label], sha) for i, c, e, label in out), key=repr)


def test_codes_against_all_distances(spark):
    r = random.Random(11)
    rows = [(k, [r.choice([-2, -1, 0, 1, 1.5]) / 64 for _ in range(8)], r.choice([None, 1, 1, 2])) for k in range(140)]
    rows += [(r.randrange(140), rows[3][1], 3) for _ in range(20)]  # repeated ids, equal vectors
    rows += [(500, None, 1), (501, [None] * 8, 1), (502, [float("nan")] * 8, 1), (503, [1.0] * 7 + [float("inf")], 2), (None, [0.25] * 8, None)]
    table = spark.createDataFrame([(*x, "e", "f") for x in rows], "vec_id long, embedding array<double>, label int, error string, `c.d` string")
    got = vector_codes.compressed(table, entries=40)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute_codes(rows, 4, 40, 4)
    assert vector_codes.compressed(table.where("false")).count() == 0


def test_codes_of_few_odd_and_huge_vectors(spark):
    table = spark.createDataFrame([(1, [0.5] * 6, 1), (2, [3e30] * 6, 1), (3, [1.0], 1), (4, [], 1)], "vec_id long, embedding array<double>, label int")
    got = {x.vec_id: x for x in vector_codes.compressed(table).collect()}
    assert set(got) == {1, 2} and got[1].code == "00000000" and got[2].code == "01010101"  # the usual length is six; as many entries as vectors
    assert {x.error for x in got.values()} == {0}
    assert [vector_codes.cuts(6, 4), vector_codes.cuts(8, 4)] == [[(0, 2), (2, 4), (4, 5), (5, 6)], [(0, 2), (2, 4), (4, 6), (6, 8)]]


@pytest.mark.parametrize("scale", [3, 900, 2**30])
def test_tree_search_keeps_lower_numbers_among_equals(scale):
    r = np.random.default_rng(scale)
    points = r.integers(-scale, scale + 1, (200, 3))
    points[100:150] = points[:50]
    queries = np.concatenate([r.integers(-scale, scale + 1, (300, 3)), points])
    found, best = vector_codes.nearest(vector_codes.grown(points, np.arange(200)), points, queries)
    for q, at, d in zip(queries.tolist(), found.tolist(), best.tolist()):
        each = [sum((a - b) ** 2 for a, b in zip(p, q)) for p in points.tolist()]
        assert (int(d), at) == (min(each), each.index(min(each)))


def brute_draw(rows, target, order, buckets, seed, percent, least):
    runs = lambda w: [" ".join(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]
    hashed = lambda text: [zlib.crc32(f.encode()) % buckets for f in runs(low(text))]
    s, t = (Counter(b for x in texts for b in hashed(x)) for texts in ([x for _, x in rows], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, x in rows:
        f = hashed(x)
        w = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(low(x))])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(able[: percent * len(able) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=repr)


@pytest.mark.parametrize("order", [1, 3])
def test_draws_against_plain_counts(spark, order):
    r = random.Random(order)
    rows = [(k, " ".join(r.choice(["Ab", "cd", "é", "x1", "yy", "zz-q"]) for _ in range(r.randint(0, 60)))) for k in range(120)]
    rows += [(900 + k, x) for k, x in enumerate(ODD)] + [(None, "ab cd " * 20), (7, rows[7][1]), (7, "other words " * 12)]
    target = ["ab x1 x1 yy", None, "cd cd é"]
    got = importance.drawn(documents(spark, rows), spark.createDataFrame([(x,) for x in target], "text string"), order, 50, percent=30)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute_draw(rows, target, order, 50, 2024, 30, 20)


def test_draws_from_and_for_nothing(spark):
    none = spark.createDataFrame([], "text string")
    some = documents(spark, [(1, "a b c " * 9), (2, None)])
    assert importance.drawn(some.where("false"), none).count() == 0
    got = {x.doc_id: x for x in importance.drawn(some, none, percent=100).collect()}
    assert got[1].rank == 1 and got[2].rank is None and (got[2].n_features, got[2].weight) == (0, 0)


def brute_licenses(text, templates):
    w = low(text)
    places = []
    for t in templates:
        for s in range(-len(t.words), len(w)):
            if all(s + a >= 0 and tuple(w[s + a : s + b]) == t.words[a:b] for a, b in t.keys):
                share = sum(0 <= s + i < len(w) and w[s + i] == t.words[i] for i in range(len(t.words))) / len(t.words)
                if share >= licenses.COVERED:
                    places.append((t, s, share))
    base = [s for t, s, _ in places if t.base]
    labels = lambda rows: ",".join(sorted({t.label for t, _, _ in rows}))
    return len(w), len(base), min(base, default=None), max(base, default=None), labels([p for p in places if p[0].base]), labels(places), max((x for _, _, x in places), default=0.0)


def test_licenses_against_all_places(spark):
    r = random.Random(13)
    texts = list(ODD)
    for t in licenses.TEMPLATES:
        for changes in (0, 1, 3, 9):
            w = list(t.words)
            for _ in range(changes):
                w[r.randrange(len(w))] = r.choice(["other", "license", "the"])
            texts.append(" ".join([*r.choices(["the", "gnu", "Apache", "zz", "mit", "cc"], k=r.randint(0, 9)), *w, *r.choices(["by", "license", "x"], k=5)]))
        texts.append(" ".join(t.words[2:] + t.words))  # begins before the text does
    texts += ["Licensed under CC BY-NC 4.0.", "mit\nLICENSE, apache-license. GNU General Public License v3; CC\tBY", "licenseé mit", "cc by cc by cc by nc"]
    got = licenses.scanned(documents(spark, [*enumerate(texts[1:], 1), (None, texts[0])]))
    want = {k or None: brute_licenses(x, licenses.TEMPLATES) for k, x in enumerate(texts)}
    assert {x.doc_id: tuple(x)[1:] for x in got.collect()} == want
    assert sum("mpl" in x[5] for x in want.values()) > 1
    assert licenses.scanned(documents(spark, []).where("false")).count() == 0


def test_rarest_key_words_are_looked_up():
    t = next(t for t in licenses.TEMPLATES if t.label == "isc")
    frequency = {w: 9 for w in t.words} | {"fee": 2, "granted": 1}
    assert [t.words[i] for i in licenses.lookups(t, frequency)] == ["granted", "fee"]
