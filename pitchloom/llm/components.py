"""Connected components of links between documents, by union-find within partitions and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Members that a task's union-find holds at most, give or take a batch.
HELD = 200_000


def forest(pairs: np.ndarray, root: dict[int, int]) -> None:
    """Adds links to a union-find forest whose roots are the smallest members."""

    def find(x: int) -> int:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)


def stars(root: dict[int, int]) -> pa.RecordBatch:
    """u and the root v of each member that is none."""
    rows = []
    for u in root:
        top = u
        while root[top] != top:
            top = root[top]
        if top != u:
            rows.append((u, top))
    u, v = zip(*rows, strict=True) if rows else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars (u to the smallest v that it reaches), HELD members at a time."""
    root: dict[int, int] = {}
    for batch in batches:
        forest(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1), root)
        if len(root) > HELD:
            yield stars(root)
            root = {}
    yield stars(root)


def connected_components(links: DataFrame) -> DataFrame:
    """links: two long columns. Returns node, component (the smallest node reachable) for every node with a link to another.

    Large-star and small-star steps alternate until nothing changes; each step's edges are written to the shared folder.
    A node's neighbours are never collected: only their minimum is. Minima are tables of their own, so that a join with the links of a node
    that has very many (two numbers a link) is between two shuffles and adaptive execution can split it.
    """
    a, b = links.columns
    links = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges, before = cut(links.mapInArrow(contracted, "u long, v long").distinct()), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF)))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        before = now
        both = edges.union(edges.select("v", "u"))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        edges = cut(small.distinct())
