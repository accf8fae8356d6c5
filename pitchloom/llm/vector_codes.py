"""Operator 11: product codes of vectors, trained by rounds of nearest-entry search over kd-trees.

Vectors become integers floor(SCALE * x), cut into PARTS consecutive parts. Each part position has a codebook, which starts as that part of
the ENTRIES smallest vectors by id. In each round the codebooks' kd-trees (at most PARTS * ENTRIES points, whatever the data) are broadcast;
each task finds the nearest entry of its parts by branch and bound and adds up integer sums by entry, Spark adds these over tasks, and the driver divides at
most PARTS * ENTRIES of them. A node whose box is as far as the best entry so far is visited as well, so that among equally near entries the lowest
number wins. Searches run for all vectors of a batch at once: a node gets the vectors for which it is still open.

Distances are exact: whole numbers in doubles as long as they stay below 2**53, else Python integers.

Defined results: a null vector, or one with a null or non-finite component: no row. Vectors of another length than the most frequent one (ties: the longer):
no row, as they have no parts in common. A length that PARTS doesn't divide: the first parts are one longer. Scaled components beyond 32 bits are
held at the nearest 32-bit integer; errors beyond 64 bits at the greatest. Fewer vectors than ENTRIES: as many entries. Repeated ids: each row by itself, order by id, then vector. Null ids: last.
Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, longs, strings

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a leaf at most.
LEAF = 16
EXACT = 2.0**53


@dataclass
class Node:
    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray | None = None  # of a leaf, ascending
    left: Node | None = None
    right: Node | None = None


def grown(points: np.ndarray, entries: np.ndarray) -> Node:
    """A tree over points[entries], split at the median of the widest component."""
    own = points[entries]
    node = Node(own.min(axis=0), own.max(axis=0))
    axis = int(np.argmax(node.high.astype(float) - node.low.astype(float)))
    if len(entries) <= LEAF or node.high[axis] == node.low[axis]:
        node.entries = np.sort(entries)
        return node
    order = entries[np.argsort(own[:, axis], kind="stable")]
    node.left, node.right = grown(points, order[: len(order) // 2]), grown(points, order[len(order) // 2 :])
    return node


def bounds(node: Node, queries: np.ndarray) -> np.ndarray:
    """The least squared distance that any point in the node's box can have."""
    off = np.maximum(np.maximum(node.low - queries, queries - node.high), 0)
    return (off * off).sum(axis=1)


def nearest(tree: Node, points: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest point of each query (ties: the lowest number) and its squared distance."""
    width = max(1, points.shape[1])
    reach = float(np.abs(points).max(initial=0)) + float(np.abs(queries).max(initial=0))
    kind = np.float64 if width * reach * reach < EXACT else object
    points, queries = points.astype(kind), queries.astype(kind)
    best = np.full(len(queries), np.inf, dtype=kind)
    found = np.full(len(queries), len(points), dtype=np.int64)

    def visit(node: Node, q: np.ndarray) -> None:
        if not len(q):
            return
        if node.entries is not None:
            x, y = queries[q], points[node.entries]
            distance = (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]
            at = np.argmin(distance, axis=1)
            distance, entry = distance[np.arange(len(q)), at], node.entries[at]
            better = ((distance < best[q]) | ((distance == best[q]) & (entry < found[q]))).astype(bool)
            best[q[better]], found[q[better]] = distance[better], entry[better]
            return
        left, right = bounds(node.left, queries[q]), bounds(node.right, queries[q])
        nearer = (left <= right).astype(bool)
        a, b = q[nearer], q[~nearer]
        visit(node.left, a)
        visit(node.right, b)
        visit(node.right, a[(right[nearer] <= best[a]).astype(bool)])
        visit(node.left, b[(left[~nearer] <= best[b]).astype(bool)])

    visit(tree, np.arange(len(queries)))
    return found, best


def cuts(width: int, parts: int) -> list[tuple[int, int]]:
    sizes = [width // parts + (k < width % parts) for k in range(parts)]
    return [(sum(sizes[:k]), sum(sizes[: k + 1])) for k in range(parts)]


def packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, vector) with the vector as 32-bit integers, packed so that their order is that of the bytes."""
    for batch in batches:
        lists = batch.column("vector")
        ends = np.asarray(lists.offsets)
        flat = np.asarray(lists.values.to_numpy(zero_copy_only=False), dtype=np.float64)
        with np.errstate(over="ignore"):
            whole = np.clip(np.floor(flat * SCALE), -(2**31), 2**31 - 1) + 2.0**31
        whole = whole.astype(">u4")
        data = pa.array([whole[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), data], names=["id", "label", "data"])


def whole_vectors(vectors: DataFrame, id_column: str, vector: str, label: str) -> DataFrame:
    """id, label and data (packed integers) of the vectors that are kept, as a table in the shared folder."""
    rows = vectors.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vector").isNotNull() & finite)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    kept = cut(rows.mapInArrow(packed_rows, f"id {kinds['id']}, label {kinds['label']}, data binary"))
    usual = kept.groupBy(F.octet_length("data").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return kept.where(F.octet_length("data") == (usual.n if usual else 0))


def parts_of(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u4").reshape(-1, width).astype(np.int64) - 2**31


def trained(kept: DataFrame, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """The codebook of each part after all rounds."""
    first = [r.data for r in kept.orderBy(F.col("id").asc_nulls_last(), "data").limit(entries).collect()]
    width = len(first[0]) // 4 if first else 0
    start = parts_of(pa.array(first, pa.binary()), width) if width else np.zeros((len(first), 0), dtype=np.int64)
    books = [start[:, a:b].copy() for a, b in cuts(width, parts)]
    if not width:
        return books
    widest = max(b - a for a, b in cuts(width, parts))
    for _ in range(rounds):
        shared = kept.sparkSession.sparkContext.broadcast([(grown(b, np.arange(len(b))), b) for b in books])

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trees = shared.value
            count = np.zeros((parts, len(trees[0][1])), dtype=np.int64)
            total = np.zeros((parts, len(trees[0][1]), widest), dtype=np.int64)
            for batch in batches:
                if batch.num_rows:
                    rows = parts_of(batch.column(0), width)
                    for k, ((a, b), (tree, book)) in enumerate(zip(cuts(width, parts), trees, strict=True)):
                        entry, _ = nearest(tree, book, rows[:, a:b])
                        count[k] += np.bincount(entry, minlength=len(book))
                        np.add.at(total[k, :, : b - a], entry, rows[:, a:b])
            k, entry = np.nonzero(count)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(k) + 1) * widest, widest, dtype=np.int32)), pa.array(total[k, entry].reshape(-1)))
            yield pa.RecordBatch.from_arrays([longs(k), longs(entry), longs(count[k, entry]), lists], names=["part", "entry", "n", "sums"])

        added = kept.select("data").mapInArrow(sums, "part long, entry long, n long, sums array<long>").groupBy("part", "entry")
        for r in added.agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(widest))).alias("sums")).collect():
            books[r.part][r.entry] = [s // r.n for s in r.sums[: books[r.part].shape[1]]]
        shared.unpersist()
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.reshape(-1).tolist()).encode()).hexdigest()


def coded(kept: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """id, label, code (two hex digits a part) and error (squared distances summed over parts)."""
    width = sum(b.shape[1] for b in books)
    shared = kept.sparkSession.sparkContext.broadcast([(grown(b, np.arange(len(b))), b) for b in books] if width else None)
    parts = len(books)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            entry = np.zeros((batch.num_rows, parts), dtype=np.uint8)
            error = np.zeros(batch.num_rows, dtype=object)
            if width:
                rows = parts_of(batch.column("data"), width)
                for k, ((a, b), (tree, book)) in enumerate(zip(cuts(width, parts), trees, strict=True)):
                    found, distance = nearest(tree, book, rows[:, a:b])
                    entry[:, k] = found
                    error += np.array([int(d) for d in distance], dtype=object)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), strings([bytes(e).hex() for e in entry]), longs([min(e, 2**63 - 1) for e in error])], names=["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    return kept.mapInArrow(codes, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def compressed(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (error summed over equal labels, nulls together) and codebooks_sha256. entries: at most 256."""
    kept = whole_vectors(vectors, id_column, vector, label)
    books = trained(kept, parts, entries, rounds)
    rows = cut(coded(kept, books))
    by_label = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = rows.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select(F.col("id").alias(id_column), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same by all distances: one row a component. The dimension is fixed by the widest vector; parts are equal."""
    ctes = [
        f"""whole AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""flat AS MATERIALIZED (SELECT vec_id, label, i * {parts} // len(v) AS part, i % (len(v) // {parts}) AS pos, v[i + 1] AS x FROM (SELECT *, unnest(range(len(v))) AS i FROM whole))""",
        f"first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM whole ORDER BY vec_id LIMIT {entries})",
        "b0 AS MATERIALIZED (SELECT f.part, e.entry, f.pos, f.x FROM flat f JOIN first e USING (vec_id))",
    ]
    for k in range(rounds + 1):
        ctes.append(f"d{k} AS (SELECT f.vec_id, f.part, b.entry, sum((f.x - b.x) * (f.x - b.x)) AS d FROM flat f JOIN b{k} b ON f.part = b.part AND f.pos = b.pos GROUP BY 1, 2, 3)")
        ctes.append(f"a{k} AS MATERIALIZED (SELECT vec_id, part, min_by(entry, d::HUGEINT * {entries} + entry) AS entry, min(d)::BIGINT AS d FROM d{k} GROUP BY 1, 2)")
        if k < rounds:
            ctes.append(f"n{k} AS (SELECT a.part, a.entry, f.pos, floor(sum(f.x) / count(*))::BIGINT AS x FROM flat f JOIN a{k} a ON f.vec_id = a.vec_id AND f.part = a.part GROUP BY 1, 2, 3)")
            ctes.append(f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(n.x, b.x) AS x FROM b{k} b LEFT JOIN n{k} n ON n.part = b.part AND n.entry = b.entry AND n.pos = b.pos)")
    ctes.append(f"coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY 1)")
    return f"""WITH {", ".join(ctes)} SELECT w.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY w.label))::BIGINT AS label_error,
      (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256 FROM whole w JOIN coded c USING (vec_id)"""


ORACLE = oracle()
