"""Plans of evidence: documents of the corpus as linked news, some of them told before."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchloom.operators import evidence
from pitchloom.sources import derive

from .core import plan

NEWS = """.
dv AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'e' || doc_id // 3 * 3 WHEN doc_id % 10 = 5 THEN 'gone' END AS linked, doc_id % 40 AS match_id, source, doc_id * 10 AS captured_s, CASE WHEN doc_id % 4 <> 0 THEN ' News ' || doc_id % 3 ELSE '' END AS title, CASE WHEN doc_id % 11 <> 0 THEN 'u/' || doc_id % 2 END AS url, lang || n_chars % 5 AS summary, doc_id % 9 / 10 AS confidence FROM documents),
ev AS (SELECT 'e' || doc_id AS evidence_id, match_id, source, CASE WHEN doc_id % 2 = 0 THEN 'news' ELSE 'note' END AS kind, captured_s, upper(title) AS title, url, summary, confidence FROM dv WHERE doc_id % 3 = 0),
di AS (SELECT *, lower(trim(CASE WHEN trim(title) <> '' THEN title ELSE summary END)) AS k, lower(coalesce(url, '')) AS v FROM dv), ei AS (SELECT min(evidence_id) AS same, match_id, source, lower(trim(CASE WHEN trim(title) <> '' THEN title ELSE summary END)) AS k, lower(coalesce(url, '')) AS v FROM ev WHERE kind = 'news' GROUP BY 2, 3, 4, 5),
tg0 AS (SELECT di.*, coalesce(e.evidence_id, same) AS found FROM di LEFT JOIN ev e ON e.evidence_id = linked LEFT JOIN ei ON (ei.match_id, ei.source, ei.k, ei.v) = (di.match_id, di.source, di.k, di.v)),
tg AS (SELECT *, coalesce(found, 'doc-' || min(CASE WHEN found IS NULL THEN doc_id END) OVER (PARTITION BY match_id, source, k, v)) AS target FROM tg0),
up AS (SELECT target, arg_max(struct_pack(title, url, summary, confidence), doc_id) AS u, arg_min(struct_pack(match_id, source, captured_s), doc_id) AS f FROM tg GROUP BY 1)
"""


def news(spark, sf_dir):
    d = F.col("doc_id")
    rows = derive.table(spark, sf_dir, "documents").select(
        d.alias("document_id"), F.when(d % 10 == 0, F.concat(F.lit("e"), (F.expr("doc_id div 3") * 3).cast("string"))).when(d % 10 == 5, "gone").alias("linked_evidence_id"), (d % 40).alias("match_id"), F.col("source").alias("source_id"), (d * 10).alias("captured_s"),
        F.when(d % 4 != 0, F.concat(F.lit(" News "), (d % 3).cast("string"))).otherwise("").alias("title"), F.when(d % 11 != 0, F.concat(F.lit("u/"), (d % 2).cast("string"))).alias("url"), F.concat("lang", (F.col("n_chars") % 5).cast("string")).alias("summary"), (d % 9 / 10).alias("confidence"),
    )
    told = rows.where("document_id % 3 = 0").select(F.concat(F.lit("e"), F.col("document_id").cast("string")).alias("evidence_id"), "match_id", "source_id", F.when(F.col("document_id") % 2 == 0, "news").otherwise("note").alias("kind"), "captured_s", F.upper("title").alias("title"), "url", "summary", "confidence")
    return rows, told


@plan(
    "p04_evidence",
    NEWS
    + """SELECT coalesce(evidence_id, target) AS evidence_id, coalesce(ev.match_id, f.match_id) AS match_id, coalesce(ev.source, f.source) AS source_id, coalesce(kind, 'news') AS kind, coalesce(ev.captured_s, f.captured_s) AS captured_s, CASE WHEN target IS NULL THEN title ELSE u.title END AS title,
  CASE WHEN target IS NULL THEN url ELSE u.url END AS url, CASE WHEN target IS NULL THEN summary ELSE u.summary END AS summary, CASE WHEN target IS NULL THEN confidence ELSE u.confidence END AS confidence FROM ev FULL JOIN up ON evidence_id = target""",
)
def evidence_after(spark, sf_dir):
    return evidence.evidence_after(*news(spark, sf_dir))


@plan("p04_document_links", NEWS + "SELECT doc_id AS document_id, match_id, target AS linked_evidence_id FROM tg")
def document_links(spark, sf_dir):
    return evidence.links_after(*news(spark, sf_dir)).select("document_id", "match_id", "linked_evidence_id")
