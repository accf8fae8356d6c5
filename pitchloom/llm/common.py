"""Helpers that the text operators share: batches, word hashes, shingle sets and cut lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local one only if the session names none and runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master.startswith("local[") or sc.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: later reads neither recompute it nor depend on one executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; a null is an empty text."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about most_bytes of text, one row at least: bounds what a task holds at once."""
    if not batch.num_rows:
        return
    sizes = np.nan_to_num(np.asarray(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False), dtype=float))
    group = (np.cumsum(sizes) - sizes) // most_bytes
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def map_texts(df: DataFrame, make: Callable[[], Callable[[list[bytes]], dict[str, pa.Array]]], added: str, keep: list[str], text: str = "text", most_bytes: int = 1 << 21) -> DataFrame:
    """df's columns `keep` and what make()'s function finds in each text (one value a row for each column of the DDL string `added`).

    make runs once in each task, so that tables are built or loaded where they are used; its function gets about most_bytes of text at once.
    """
    found = T.StructType.fromDDL(added)
    kept = [df.schema[c] for c in keep]
    schema = T.StructType([*kept, *found.fields])
    names = [f.name for f in found.fields]
    shipped = f"__k{keep.index(text)}" if text in keep else "__text"  # a text that is kept is sent once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, shipped, most_bytes):
                got = work(text_bytes(part.column(shipped)))
                yield pa.RecordBatch.from_arrays([*(part.column(f"__k{i}") for i in range(len(keep))), *(got[n] for n in names)], names=[*keep, *names])

    own = [] if text in keep else [F.col(f"`{text}`").alias("__text")]
    return df.select(*(F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)), *own).mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(n: int) -> np.ndarray:
    return mix(GOLDEN * np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs without ASCII white space) of the texts, and where each text's words begin (one more than texts)."""
    words = [t.split() for t in texts]
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) for w in words], out=starts[1:])
    flat = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), dtype=np.uint64, count=int(starts[-1]))
    return flat, starts


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each window of k words; windows may span texts, callers pick those that don't."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for i, m in enumerate(multipliers(k)):
        total += words[i : i + n] * m
    return mix(total)


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each text as 64-bit hashes; fewer words: the whole sequence as one; no word: none."""
    words, starts = word_hashes(texts)
    windows = window_hashes(words, k)
    few = multipliers(k + 1)
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(windows[a : b - k + 1]))
        elif b > a:
            out.append(mix(np.sum(words[a:b] * few[: b - a], keepdims=True) + few[k:] * np.array([b - a], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def strings(values: list[str]) -> pa.Array:
    return pa.array(values, pa.string())


def longs(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64))


def nested(flat: np.ndarray, sizes, kind: pa.DataType) -> pa.Array:
    """An array column from its values laid end to end."""
    ends = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))
