"""Which competitions a pick may be shown for, and which engine scores a match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Readiness and reason where a competition is settled by settings, is a slate's stand-in, or is unknown; the weights of a stand-in.
READY, BLOCKED = "Competition explicitly approved for live picks.", "Competition explicitly blocked for live picks."
STAND_IN = "progol-concurso-"
CONTEXT = "Fixture sin historial dedicado en la base; el modelo lo califica con contexto de quiniela. No usar como jugada simple segura."
UNKNOWN = "Competition has no historical benchmark yet; live picks stay blocked."
WEIGHTS = {"w_elo": 0.25, "w_poisson": 0.20, "w_profile": 0.55, "draw_bias": 0.0}


def policies(rows: DataFrame, overrides: DataFrame, settings: DataFrame) -> DataFrame:
    """rows (with competition_key) with readiness, live_pick_allowed, policy_reason, WEIGHTS (I15): a setting's readiness over an override's, whose reason and weights stay; without either, a stand-in gives context only and anything else is unclassified.

    overrides: competition_key, readiness, live_pick_allowed, policy_reason, WEIGHTS, any of them null. settings: competition_key, ready; a key that is approved and blocked is approved. Tables of competitions, joined by equality.
    """
    mine = ["readiness", "live_pick_allowed", "policy_reason", *WEIGHTS]
    own = overrides.select("competition_key", F.lit(True).alias("__own"), *(F.col(c).alias(f"__{c}") for c in mine))
    chosen = settings.groupBy("competition_key").agg(F.max("ready").alias("__ready"))
    found = rows.join(own, "competition_key", "left").join(chosen, "competition_key", "left")
    ready, bare, stand_in = F.col("__ready"), F.col("__own").isNull() & F.col("__ready").isNull(), F.coalesce(F.startswith("competition_key", F.lit(STAND_IN)), F.lit(False))
    by_default = lambda there, other: F.when(bare & stand_in, there).when(bare, other)
    values = {
        "readiness": F.when(ready, "ready").when(~ready, "not_ready").otherwise(F.coalesce(by_default("context_only", "unclassified"), "__readiness")),
        "live_pick_allowed": F.coalesce(ready, F.when(bare, False), "__live_pick_allowed"),
        "policy_reason": F.coalesce("__policy_reason", F.when(ready, READY).when(~ready, BLOCKED), by_default(CONTEXT, UNKNOWN)),
    } | {c: F.when(bare & stand_in, value).otherwise(F.col(f"__{c}")) for c, value in WEIGHTS.items()}
    return found.withColumns(values).drop("__own", "__ready", *(f"__{c}" for c in mine))


def verdict(files: DataFrame) -> DataFrame:
    """The published verdict that counts: the file of the smallest rank, as one row of its text, null if it is no JSON (I17). files: rank, text."""
    return files.agg(F.min_by("text", "rank").alias("text")).select(F.when(F.get_json_object("text", "$").isNotNull(), F.col("text")).alias("text"))


def approved(files: DataFrame) -> DataFrame:
    """competition_key of those in which the booster beats the heuristic by the verdict."""
    entries = F.from_json("text", "competitions array<struct<competition_key: string, xgboost_beats_heuristic: boolean>>")["competitions"]
    return verdict(files).select(F.explode(entries).alias("e")).where("e.xgboost_beats_heuristic and e.competition_key is not null").select("e.competition_key").distinct()


def engines(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows with `engine` (I16): a booster only where it gives a score and, if there is a verdict, where that approves of it; what the verdict turns away is `heuristic_blend_gated`, what fails is `heuristic_blend`.

    rows: competition_key, model_type (null: nothing is trained), sample_size (of the heuristic), has_score (the booster's). The verdict's presence is one row; its keys are joined by equality.
    """
    there = verdict(files).select(F.col("text").isNotNull().alias("__there"))  # one row
    found = rows.join(approved(files).withColumn("__approved", F.lit(True)), "competition_key", "left").join(F.broadcast(there))
    kind: Column = F.col("model_type")
    boosted = F.when(F.col("__there") & F.col("__approved").isNull(), "heuristic_blend_gated").when(F.coalesce("has_score", F.lit(False)), "xgboost").otherwise("heuristic_blend")
    blank = F.when(F.coalesce(F.col("sample_size"), F.lit(0)) <= 0, "placeholder").otherwise("heuristic_blend")
    engine = F.when(kind.isNull(), blank).when(kind == "xgboost_multiclass", boosted).when(kind == "similarity_knn", "similarity_knn").otherwise("heuristic_blend")
    return found.withColumn("engine", engine).drop("__there", "__approved")
