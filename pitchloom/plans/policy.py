"""Plans of competitions' policies and of the engine of each match."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchloom.operators import policy
from pitchloom.sources import derive

from .core import plan

COMPETITIONS = """.
cp AS (SELECT DISTINCT competition_id AS c, CASE WHEN competition_id % 7 = 0 THEN 'progol-concurso-' ELSE 'liga-' END || competition_id AS competition_key FROM matches)
"""


def key(c):
    return F.concat(F.when(c % 7 == 0, policy.STAND_IN).otherwise("liga-"), c.cast("string"))


def competitions(spark, sf_dir):
    return derive.matches(spark, sf_dir).select(F.col("competition_id").alias("c")).distinct().withColumn("competition_key", key(F.col("c")))


@plan(
    "i15_policies",
    COMPETITIONS
    + f"""SELECT competition_key, CASE WHEN c % 5 = 0 THEN 'ready' WHEN c % 5 = 1 THEN 'not_ready' WHEN c % 4 = 0 THEN 'covered' WHEN c % 7 = 0 THEN 'context_only' ELSE 'unclassified' END AS readiness, CASE WHEN c % 5 < 2 THEN c % 5 = 0 WHEN c % 4 = 0 THEN c % 8 = 0 ELSE false END AS live_pick_allowed,
  CASE WHEN c % 4 = 0 AND c % 3 > 0 THEN 'own ' || c WHEN c % 5 = 0 THEN '{policy.READY}' WHEN c % 5 = 1 THEN '{policy.BLOCKED}' WHEN c % 4 = 0 THEN NULL WHEN c % 7 = 0 THEN '{policy.CONTEXT}' ELSE '{policy.UNKNOWN}' END AS policy_reason,
  CASE WHEN c % 4 = 0 THEN 0.5 WHEN c % 5 > 1 AND c % 7 = 0 THEN 0.25 END::DOUBLE AS w_elo, CASE WHEN c % 4 = 0 THEN 0.3 WHEN c % 5 > 1 AND c % 7 = 0 THEN 0.2 END::DOUBLE AS w_poisson, CASE WHEN c % 4 = 0 THEN 0.2 WHEN c % 5 > 1 AND c % 7 = 0 THEN 0.55 END::DOUBLE AS w_profile,
  CASE WHEN c % 4 <> 0 AND c % 5 > 1 AND c % 7 = 0 THEN 0 END::DOUBLE AS draw_bias FROM cp""",
)
def policies(spark, sf_dir):
    rows, c = competitions(spark, sf_dir), F.col("c")
    own = rows.where("c % 4 = 0").select("competition_key", F.lit("covered").alias("readiness"), (c % 8 == 0).alias("live_pick_allowed"), F.when(c % 3 > 0, F.concat(F.lit("own "), c.cast("string"))).alias("policy_reason"), F.lit(0.5).alias("w_elo"), F.lit(0.3).alias("w_poisson"), F.lit(0.2).alias("w_profile"), F.lit(None).cast("double").alias("draw_bias"))
    settings = rows.where("c % 5 = 0").select("competition_key", F.lit(True).alias("ready")).unionByName(rows.where("c % 5 < 2 and c % 10 <> 0").select("competition_key", F.lit(False).alias("ready")))
    return policy.policies(rows.select("competition_key"), own, settings)


@plan(
    "i16_engines",
    COMPETITIONS
    + """SELECT match_id, competition_key, CASE match_id % 5 WHEN 0 THEN CASE WHEN match_id % 2 = 0 THEN 'placeholder' ELSE 'heuristic_blend' END WHEN 1 THEN 'similarity_knn' WHEN 2 THEN 'heuristic_blend' ELSE CASE WHEN c % 3 <> 0 THEN 'heuristic_blend_gated' WHEN match_id % 4 > 0 THEN 'xgboost' ELSE 'heuristic_blend' END END AS engine FROM matches JOIN cp ON c = competition_id""",
)
def engines(spark, sf_dir):
    """Each match with one of the kinds of artifact; the verdict, of one entry a competition, approves of every third one."""
    m, c = F.col("match_id"), F.col("c")
    entry = F.struct("competition_key", F.when(c % 3 < 2, c % 3 == 0).alias("xgboost_beats_heuristic"))
    files = competitions(spark, sf_dir).agg(F.to_json(F.struct(F.collect_list(entry).alias("competitions"))).alias("text")).select(F.lit(1).alias("rank"), "text")
    rows = derive.matches(spark, sf_dir).select("match_id", key(F.col("competition_id")).alias("competition_key"), F.when(m % 5 == 1, "similarity_knn").when(m % 5 == 2, "heuristic").when(m % 5 > 2, "xgboost_multiclass").alias("model_type"), (m % 2).alias("sample_size"), (m % 4 > 0).alias("has_score"))
    return policy.engines(rows, files).select("match_id", "competition_key", "engine")
