"""Operator 3: secrets by patterns and by the entropy of sliding windows; DataFrame expressions only.

Patterns find assignments, access keys and hexadecimal strings. Candidate strings (long runs of key characters) are then scanned
with a window of WINDOW characters. The count of each character in the window is carried along, and so are the counts of each character class and the sum of
c * log2(c) over the characters' counts c: each step takes out the character that leaves and puts in the one that comes. The entropy log2(WINDOW) - sum / WINDOW is held against the limit of the
window's character class, and each stretch that windows over the limit cover is a span of kind entropy. Candidates that are paths of plain words are
passed over, and so are parts of candidates (between = and /) that hold listed harmless strings; what lies between those is scanned. Entropy spans that touch a pattern's span are not added.

Offsets are code points, end exclusive. Defined results: null or empty text: no spans. Repeated rows: each by itself. Empty table: empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex", "entropy"]
#: pattern, group whose length counts, least length
PATTERNS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
#: What a text must contain for a pattern to be worth running.
HINTS = {"assign": r"(?i)(?:passw|secret|token|api_?key)", "access": "AKIA", "hex": "[0-9a-f]{16}"}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Least entropy in bits a character of a window, by the class of its characters; a window of only letters in one case or of digits is never a secret.
LIMITS = {"hex": 3.0, "mixed": 3.6}
#: Harmless parts (between = and /) of a candidate: placeholders, repeated units.
ALLOWED = r"(?i)example|placeholder|changeme|dummy|sample|lorem|xxxx|0000|1234567|abcdef"
#: Key characters by class: digits, small letters, capital letters (hexadecimal ones first in both), signs.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: Places in ALPHABET, end exclusive.
CLASSES = {"digit": (0, 10), "low": (10, 36), "low_hex": (10, 16), "high": (36, 62), "high_hex": (36, 42), "sign": (62, 67)}
SPANS = "array<struct<kind:string,rank:int,s:int,e:int>>"
#: Lists grow in blocks, so that adding to a long one does not copy all of it.
BLOCK = 256


def path(word: Column) -> Column:
    """The candidate is a path of plain words from end to end."""
    return word.rlike("^[A-Za-z/_-]+$") & word.rlike("[A-Za-z][/_-]") & ~word.rlike("[/_-]{2}")


def empty(kind: str) -> Column:
    """A list of blocks: struct<full, last>."""
    return F.struct(F.array().cast(f"array<{kind}>").alias("full"), F.array().cast(kind).alias("last"))


def added(blocks: Column, item: Column, when: Column) -> Column:
    more = F.concat(blocks["last"], F.array(item))
    full = F.size(blocks["last"]) >= BLOCK
    grown = F.when(full, F.struct(F.concat(blocks["full"], F.array(blocks["last"])).alias("full"), F.array(item).alias("last"))).otherwise(F.struct(blocks["full"].alias("full"), more.alias("last")))
    return F.when(when, grown).otherwise(blocks)


def listed(blocks: Column) -> Column:
    return F.concat(F.flatten(blocks["full"]), blocks["last"])


def spans_of(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<kind, rank, s, e>> of the leftmost matches whose group is long enough. Places are sums of the lengths of gaps and matches before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(found, F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    groups = sizes if not group else F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        span = F.struct(F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("rank"), start.alias("s"), (start + x["size"]).alias("e"))
        return F.struct((start + x["size"]).alias("at"), added(done["out"], span, x["need"] >= least).alias("out"))

    rows = F.arrays_zip(sizes.alias("size"), groups.alias("need"), F.slice(gaps, F.lit(1), F.size(sizes)).alias("gap"))
    return F.aggregate(rows, F.struct(F.lit(0).alias("at"), empty(SPANS).alias("out")), step, lambda done: listed(done["out"]))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def weight(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def limit(n: Column) -> Column:
    """The entropy limit of a window with n characters of each class; null if it is never a secret."""
    hexadecimal = (n["digit"] > 0) & (((n["low_hex"] > 0) & (n["digit"] + n["low_hex"] == WINDOW)) | ((n["high_hex"] > 0) & (n["digit"] + n["high_hex"] == WINDOW)))
    mixed = ((n["digit"] > 0) & (n["low"] + n["high"] > 0)) | ((n["low"] > 0) & (n["high"] > 0) & (n["sign"] > 0))
    return F.when(hexadecimal, F.lit(LIMITS["hex"])).when(mixed, F.lit(LIMITS["mixed"]))


def high_entropy(word: Column) -> Column:
    """array<struct<s, e>> of the stretches of a candidate that windows over their limit cover. Characters are their places in ALPHABET."""
    places = F.array(F.transform(F.regexp_extract_all(word, F.lit("."), F.lit(0)), lambda c: F.instr(F.lit(ALPHABET), c) - 1))
    return F.get(F.transform(places, scan_windows), 0)


def scan_windows(places: Column) -> Column:
    inside = lambda p, name: ((p >= CLASSES[name][0]) & (p < CLASSES[name][1])).cast("int")
    size, kind = F.lit(float(WINDOW)), "array<struct<s:int,e:int>>"

    def seen(state: Column, now: Column, i: Column) -> Column:
        """The state after a window; now: its counts, classes and total."""
        over = F.coalesce(F.log2(size) - now["total"] / size >= limit(now["classes"]), F.lit(False))

        def after(x: Column) -> Column:  # x: is it over the limit, and does it begin a stretch
            stretch = F.struct(state["s"].alias("s"), state["e"].alias("e"))
            out = F.when(x["apart"] & (state["e"] >= 0), added(state["out"], stretch, F.lit(True))).otherwise(state["out"])
            return F.struct(*(now[k].alias(k) for k in ("counts", "classes", "total")), F.when(x["apart"], i).otherwise(state["s"]).alias("s"), F.when(x["over"], i + WINDOW).otherwise(state["e"]).alias("e"), out.alias("out"))

        return let(F.struct(over.alias("over")), lambda o: let(F.struct(o["over"].alias("over"), (o["over"] & (state["e"] < i)).alias("apart")), after))

    def moved(state: Column, m: Column) -> Column:
        """Counts, classes and total when m.gone leaves and m.come enters."""
        a, b = F.get(state["counts"], m["gone"]), F.get(state["counts"], m["come"]) - (m["gone"] == m["come"]).cast("int")
        counts = F.transform(state["counts"], lambda n, p: F.when(p == m["come"], n + 1).otherwise(n) - F.when(p == m["gone"], 1).otherwise(0))
        classes = F.struct(*((state["classes"][k] - inside(m["gone"], k) + inside(m["come"], k)).alias(k) for k in CLASSES))
        total = lambda c: state["total"] - weight(c["a"]) + weight(c["a"] - 1) - weight(c["b"]) + weight(c["b"] + 1)
        return F.struct(counts.alias("counts"), classes.alias("classes"), let(F.struct(a.alias("a"), b.alias("b")), total).alias("total"))

    def step(state: Column, i: Column) -> Column:
        pair = F.struct(F.get(places, i - 1).alias("gone"), F.get(places, i + WINDOW - 1).alias("come"))
        return let(pair, lambda m: let(moved(state, m), lambda now: seen(state, now, i)))

    def count(window: Column, name: str) -> Column:
        return F.size(F.filter(window, lambda x: inside(x, name) == 1))

    first = F.slice(places, 1, WINDOW)
    counts = F.transform(F.sequence(F.lit(0), F.lit(len(ALPHABET) - 1)), lambda p: F.size(F.filter(first, lambda x: x == p)))
    classes = F.struct(*(count(first, k).alias(k) for k in CLASSES))
    total = F.aggregate(counts, F.lit(0.0), lambda t, n: t + weight(n))
    none = F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"), empty(kind).alias("out"))
    steps = F.when(F.size(places) > WINDOW, F.sequence(F.lit(1), F.size(places) - WINDOW)).otherwise(F.array().cast("array<int>"))
    closed = lambda state: listed(added(state["out"], F.struct(state["s"].alias("s"), state["e"].alias("e")), state["e"] >= 0))
    first = let(F.struct(counts.alias("counts"), classes.alias("classes"), total.alias("total")), lambda now: seen(none, now, F.lit(0)))
    return F.aggregate(steps, first, step, closed)


def segments(word: Column) -> Column:
    """array<struct<s, e>> of the stretches of a candidate that hold no harmless part and are long enough for a window."""
    none = F.array().cast("array<struct<s:int,e:int>>")
    closed = lambda done, end: F.when(end - done["s"] >= WINDOW, F.concat(done["out"], F.array(F.struct(done["s"].alias("s"), end.alias("e"))))).otherwise(done["out"])

    def step(done: Column, part: Column) -> Column:
        after, harmless = done["at"] + F.length(part) + 1, part.rlike(ALLOWED)
        return F.struct(after.alias("at"), F.when(harmless, after).otherwise(done["s"]).alias("s"), F.when(harmless, closed(done, done["at"] - 1)).otherwise(done["out"]).alias("out"))

    whole = F.array(F.struct(F.lit(0).alias("s"), F.length(word).alias("e")))
    parts = F.aggregate(F.split(word, "[=/]", -1), F.struct(F.lit(0).alias("at"), F.lit(0).alias("s"), none.alias("out")), step, lambda done: closed(done, done["at"] - 1))
    return F.when(path(word), none).when(word.rlike(ALLOWED), parts).otherwise(whole)


def entropy_spans(text: Column) -> Column:
    words = F.arrays_zip(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("word"), spans_of(text, "entropy", CANDIDATE, 0, WINDOW).alias("span"))
    cuts = F.transform(words, lambda w: F.transform(segments(w["word"]), lambda x: F.struct((w["span"]["s"] + x["s"]).alias("at"), F.substring(w["word"], x["s"] + 1, x["e"] - x["s"]).alias("word"))))
    both = F.transform(F.flatten(cuts), lambda x: F.transform(high_entropy(x["word"]), lambda y: F.struct((x["at"] + y["s"]).alias("s"), (x["at"] + y["e"]).alias("e"))))
    return F.transform(F.flatten(both), lambda x: F.struct(F.lit("entropy").alias("kind"), F.lit(KINDS.index("entropy")).alias("rank"), x["s"].alias("s"), x["e"].alias("e")))


def apart(found: Column, base: Column) -> Column:
    """The found spans that overlap no base span: one walk over both by start, and one back, which each look at the nearest base span passed."""
    tagged = lambda spans, own: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(own).alias("own"), x.alias("span")))
    rows = F.array_sort(F.concat(tagged(found, True), tagged(base, False)))
    kind = "array<struct<s:int,e:int,own:boolean,span:struct<kind:string,rank:int,s:int,e:int>>>"

    def forth(done: Column, x: Column) -> Column:
        keeps = ~x["own"] | (done["until"] <= x["s"])
        return F.struct(F.when(x["own"], done["until"]).otherwise(F.greatest(done["until"], x["e"])).alias("until"), added(done["out"], x, keeps).alias("out"))

    def back(done: Column, x: Column) -> Column:
        keeps = x["own"] & (done["since"] >= x["e"])
        return F.struct(F.when(x["own"], done["since"]).otherwise(x["s"]).alias("since"), added(done["out"], x["span"], keeps).alias("out"))

    half = F.aggregate(rows, F.struct(F.lit(-1).alias("until"), empty(kind).alias("out")), forth, lambda done: listed(done["out"]))
    return F.aggregate(F.reverse(half), F.struct(F.lit(2**31 - 1).alias("since"), empty(SPANS).alias("out")), back, lambda done: listed(done["out"]))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 of the patterns' spans, and spans (all, by start, then kind)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(SPANS)
    found = {k: F.when(text.rlike(HINTS[k]), spans_of(text, k, *PATTERNS[k])).otherwise(none) for k in PATTERNS}
    out = docs.select("doc_id", *(x.alias(k) for k, x in found.items()), F.when(text.rlike(CANDIDATE), entropy_spans(text)).otherwise(none).alias("entropy"))
    by_start = lambda spans: F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["s"], x["rank"], x["e"], x["kind"]))), lambda x: F.struct(x["kind"], x["s"], x["e"]))
    base = F.concat("assign", "access", "hex")
    out = out.withColumn("base", base)
    more = F.when(F.size("entropy") > 0, apart(F.col("entropy"), F.col("base"))).otherwise(none)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return out.select("doc_id", *counts, F.sha2(joined(by_start(F.col("base"))), 256).alias("base_sha256"), joined(by_start(F.concat(F.col("base"), more))).alias("spans"))
