"""Evidence items made from linked documents: updated where they exist, made once where they do not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .linking import evidence_identity

KEYS = [f"__k{i}" for i in range(5)]


def identified(rows: DataFrame) -> DataFrame:
    return rows.withColumns(dict(zip(KEYS, evidence_identity(F.col("match_id"), F.col("source_id"), F.lit("news"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("summary")), F.col("url")), strict=True)))


def targeted(documents: DataFrame, evidence: DataFrame) -> DataFrame:
    """documents with `target`, the id of their item (P04): the one they are linked to if it is there, else the smallest one of the same identity, else a new one, which documents of one identity share.

    Identities are those before the batch. A new id follows from the smallest document_id, so a task that runs again makes the same one. documents: document_id, linked_evidence_id, match_id, source_id, captured_s, title, url, summary, confidence.
    evidence: evidence_id, match_id, source_id, kind, captured_s, title, url, summary, confidence. All lookups are joins by equality; null sides of an identity are equal to each other.
    """
    there = evidence.select(F.col("evidence_id").alias("__linked"))
    same = identified(evidence.where("kind = 'news'")).groupBy(*KEYS).agg(F.min("evidence_id").alias("__same"))
    rows = identified(documents).alias("d").join(there, F.col("linked_evidence_id") == F.col("__linked"), "left")
    rows = rows.join(same.alias("s"), [F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}")) for k in KEYS], "left").drop(*(F.col(f"s.{k}") for k in KEYS))
    found = F.coalesce("__linked", "__same")
    first = F.min(F.when(found.isNull(), F.col("document_id"))).over(W.partitionBy(*KEYS))
    return rows.withColumn("target", F.coalesce(found, F.concat(F.lit("doc-"), first.cast("string")))).drop(*KEYS, "__linked", "__same")


def evidence_after(documents: DataFrame, evidence: DataFrame) -> DataFrame:
    """evidence after a batch of documents: an item's title, url, summary and confidence are those of its last document; match, source and time of capture stay as they were, and are the first document's in a new one. The same batch again changes nothing, once its links are kept."""
    taken = ["title", "url", "summary", "confidence"]
    new = targeted(documents, evidence).groupBy(F.col("target").alias("evidence_id")).agg(F.max_by(F.struct(*taken), "document_id").alias("u"), F.min_by(F.struct("match_id", "source_id", "captured_s"), "document_id").alias("f"))
    rows = evidence.withColumn("__old", F.lit(True)).join(new, "evidence_id", "full")
    values = {c: F.when(F.col("u").isNotNull(), F.col(f"u.{c}")).otherwise(F.col(c)) for c in taken} | {c: F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"f.{c}")) for c in ("match_id", "source_id", "captured_s")}
    return rows.withColumns(values | {"kind": F.when(F.col("__old"), F.col("kind")).otherwise("news")}).select(*evidence.columns)


def links_after(documents: DataFrame, evidence: DataFrame) -> DataFrame:
    """documents with the match and the item that they are linked to after the batch; one that was linked to an item keeps its link."""
    return targeted(documents, evidence).withColumn("linked_evidence_id", F.col("target")).select(*documents.columns)
