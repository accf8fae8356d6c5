"""Operator 9: near-duplicate documents by SuperMinHash, banding, verification and components.

A document's set is its distinct 5-word shingles (A-Z lower-cased; words are runs without ASCII white space); with fewer words
the whole sequence is its one shingle. Two documents are linked if 100 * |intersection| >= 75 * |union|. Shingles are compared
as 64-bit hashes of hashed words.

Equal sets are first collapsed to their smallest doc_id. Each bucket of a band then names its smallest member as its hub, and documents that share a
bucket with a hub make the hub's group. Groups are dealt into parts of bounded size, each with a copy of the hub, and all intersections within a part are counted
exactly; a part yields a spanning forest of its links, so no pairs are emitted. A group of one part is done with that. In a group of several parts, members that the links so far join to
the hub are joined to each other; the others are held against the members of all other parts by their signatures (one byte a slot, in blocks), which tells the blocks and the members that may hold
links (an agreement within five standard deviations of the limit); those are then counted exactly as well. So every link between two documents that share a bucket counts, however large it is. With 32
bands of 4 values a pair of similarity 0.75 shares no bucket with probability 5e-6.

Defined results: null, empty or wordless text: n_shingles 0, own component, kept. Ties: the smallest doc_id. Repeated rows (same doc_id): all
are returned and share a component; if their texts differ, the doc_id is linked by each of them. Null doc_id: kept, in no component. Empty table: empty result. Extra columns are ignored by `components_of` and kept by `deduplicated`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, longs, map_texts, mix, nested, shingle_sets, text_bytes
from .components import connected_components, forest
from .minhash import band_keys, superminhash

SLOTS, BANDS, ROWS = 128, 32, 4
#: About how many members and bytes of text a part of a group has.
PART_MEMBERS, PART_BYTES = 250, 1 << 21
#: Slots that agree in pairs worth verifying: 128 * 0.75 less five standard deviations.
AGREE = 71
COLUMNS = 2048
#: Bytes of text that are hashed at once: each shingle holds its own shuffle of the slots.
AT_ONCE = 1 << 19


def sketch(texts: list[bytes]) -> dict:
    sets = shingle_sets([t.lower() for t in texts])
    starts = np.zeros(len(sets) + 1, dtype=np.int64)
    np.cumsum([len(s) for s in sets], out=starts[1:])
    signature = superminhash(np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64), starts, SLOTS)
    keys = band_keys(signature, BANDS, ROWS).view(np.int64)
    marks = np.ascontiguousarray(mix(signature).astype(np.uint8))
    return {
        "n_bytes": longs([len(t) for t in texts]),
        "n_shingles": longs([len(s) for s in sets]),
        "set_id": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
        "bands": nested(keys.reshape(-1), [BANDS] * len(sets), pa.int64()),
        "marks": pa.array([m.tobytes() for m in marks], pa.binary()),
    }


def intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """|x[i] and y[j]| for all i, j: products of 0/1 matrices, COLUMNS shingles at a time."""
    values = np.concatenate([*x, *y])
    owner = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    often = times[column] > 1
    column, owner = (np.cumsum(times > 1) - 1)[column[often]], owner[often]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(x), len(y)), dtype=np.float32)
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [k, k + COLUMNS])
        ones = np.zeros((len(x) + len(y), COLUMNS), dtype=np.float32)
        ones[owner[a:b], column[a:b] - k] = 1
        total += ones[: len(x)] @ ones[len(x) :].T
    return total


def spanning(ids: list[int], x: list[int], y: list[int], sets: list[np.ndarray]) -> pa.Table:
    """A spanning forest of the links between members x and y (positions in ids and sets)."""
    if not x or not y:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    both = intersections([sets[i] for i in x], [sets[j] for j in y])
    nx, ny = (np.array([len(sets[i]) for i in side], dtype=np.float32) for side in (x, y))
    i, j = np.nonzero((100 * both >= 75 * (nx[:, None] + ny[None, :] - both)) & (both > 0))
    root: dict[int, int] = {}
    name = np.array(ids, dtype=np.int64)
    forest(np.stack([name[np.array(x)[i]], name[np.array(y)[j]]], axis=1) if len(i) else np.zeros((0, 2), dtype=np.int64), root)
    links = [(u, v) for u, v in root.items() if u != v]
    return pa.table({"a": pa.array([u for u, _ in links], pa.int64()), "b": pa.array([v for _, v in links], pa.int64())})


def within_part(table: pa.Table) -> pa.Table:
    sets = shingle_sets([t.lower() for t in text_bytes(table.column("text"))])
    everyone = list(range(len(sets)))
    return spanning(table.column("rid").to_pylist(), everyone, everyone, sets)


def across_parts(table: pa.Table) -> pa.Table:
    sets = shingle_sets([t.lower() for t in text_bytes(table.column("text"))])
    stray = table.column("stray").to_pylist()
    x, y = ([i for i, s in enumerate(stray) if s == want] for want in (True, False))
    return spanning(table.column("rid").to_pylist(), x, y, sets)


def alike(key: tuple, table: pa.Table) -> pa.Table:
    """The strays and the members of another part of a block that may be linked over components, by sizes and signatures: one row each."""
    stray = table.column("stray").to_numpy(zero_copy_only=False)
    ids, sizes, known = (table.column(c).to_numpy() for c in ("rid", "n_shingles", "c"))
    marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), dtype=np.uint8).reshape(-1, SLOTS)
    x, y = np.flatnonzero(stray), np.flatnonzero(~stray)
    found = np.zeros(len(ids), dtype=bool)
    for i in x.tolist():
        fits = y[(known[y] != known[i]) & (100 * np.minimum(sizes[y], sizes[i]) >= 75 * np.maximum(sizes[y], sizes[i]))]
        fits = fits[(marks[fits] == marks[i]).sum(axis=1) >= AGREE]
        found[fits] = True
        found[i] = len(fits) > 0
    own = {n: longs(np.full(int(found.sum()), k.as_py())) for n, k in zip(("hub", "part", "block"), key, strict=True)}
    return pa.table(own | {"rid": longs(ids[found]), "stray": pa.array(stray[found], pa.bool_())})


def dealt(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """rid, hub, part and parts of each member of a hub's group, from pairs (rid, hub); the hub itself is in every part."""
    pairs = cut(pairs.join(sets.select("rid", "n_bytes"), "rid"))
    parts = cut(pairs.groupBy("hub").agg(F.greatest(F.ceil(F.count(F.lit(1)) / PART_MEMBERS), F.ceil(F.sum("n_bytes") / PART_BYTES)).alias("parts")))
    members = pairs.join(parts, "hub").select("rid", "hub", F.pmod(F.xxhash64("rid"), F.col("parts")).alias("part"), "parts")
    hubs = parts.select(F.col("hub").alias("rid"), "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "parts")
    return cut(members.unionByName(hubs))


def strays(members: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """hub, part, block, rid, stray: what is to be compared beyond the parts. Members of groups of several parts that are not yet joined to the hub (strays, in blocks) meet those of other parts."""
    own = members.where("parts > 1 and rid <> hub").join(sets.select("rid", "n_shingles", "marks"), "rid")
    own = own.join(found.withColumnRenamed("node", "rid"), "rid", "left").withColumn("c", F.coalesce("component", "rid")).drop("component")
    hubs = found.select(F.col("node").alias("hub"), F.col("component").alias("hub_c"))
    own = cut(own.join(hubs, "hub", "left").withColumn("stray", F.col("c") != F.coalesce("hub_c", "hub")).drop("hub_c"))
    counts = cut(own.where("stray").groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / PART_MEMBERS).alias("blocks")))
    rows = own.join(counts, "hub").withColumnRenamed("part", "own")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["hub", "part", "block", "rid", "n_shingles", "marks", "c", "stray"]
    x = rows.where("stray").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks"))).withColumn("part", upto("parts")).where("part <> own").select(*columns)
    y = rows.withColumn("part", F.col("own")).withColumn("block", upto("blocks")).withColumn("stray", F.lit(False)).select(*columns)
    return cut(x.unionByName(y).groupBy("hub", "part", "block").applyInArrow(alike, "hub long, part long, block long, rid long, stray boolean"))


def repeated_ids(sketches: DataFrame, first: DataFrame) -> DataFrame:
    """Links between the sets of a doc_id that has several texts."""
    several = sketches.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    rows = sketches.select("doc_id", "set_id").join(several, "doc_id").join(first.select("set_id", "rid"), "set_id").select("doc_id", "rid").distinct()
    low = rows.groupBy("doc_id").agg(F.min("rid").alias("low"))
    return rows.join(low, "doc_id").where("rid <> low").select("rid", "low")


def components_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    columns = "n_bytes long, n_shingles long, set_id binary, bands array<long>, marks binary"
    sketches = cut(map_texts(docs, lambda: sketch, columns, ["doc_id"], most_bytes=AT_ONCE).withColumn("row", F.monotonically_increasing_id()))
    least = F.min(F.struct("doc_id", "row")).alias("r")
    first = cut(sketches.where("n_shingles > 0 and doc_id is not null").groupBy("set_id").agg(least).select("set_id", F.col("r.doc_id").alias("rid"), "r.row"))
    sets = cut(sketches.join(first.select("row"), "row", "left_semi").select(F.col("doc_id").alias("rid"), "n_bytes", "n_shingles", "bands", "marks"))

    rows = sets.select("rid", F.explode("bands").alias("key"))
    hubs = cut(rows.groupBy("key").agg(F.min("rid").alias("hub"), F.max("rid").alias("other")).where("hub <> other").select("key", "hub"))
    members = dealt(rows.join(hubs, "key").where("rid <> hub").select("rid", "hub").distinct(), sets)
    texts = docs.select(F.col("doc_id").alias("rid"), "text")
    held = cut(members.hint("merge").join(texts, "rid"))  # texts are dealt by id at any size: each goes to the parts that it is in
    links = cut(held.groupBy("hub", "part").applyInArrow(within_part, "a long, b long"))
    found = connected_components(links.union(repeated_ids(sketches, first)))
    if not members.where("parts > 1").isEmpty():
        meet = strays(members, found, sets)
        mates = held.where("parts > 1 and rid <> hub").select("hub", "rid", "text")
        more = meet.join(mates, ["hub", "rid"]).groupBy("hub", "part", "block").applyInArrow(across_parts, "a long, b long")
        found = connected_components(found.union(cut(more)))
    named = cut(first.join(found.withColumnRenamed("node", "rid"), "rid", "left").select("set_id", F.coalesce("component", "rid").alias("component")))
    final = sketches.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    final = final.select("doc_id", "n_shingles", component.alias("component_id"))
    return final.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without the documents that are not the smallest of their component."""
    gone = components_of(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  WHERE x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 75 * (nx.n + ny.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id, r.doc_id = min(r.other) AS kept
FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
