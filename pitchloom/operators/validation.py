"""Checks of completed slates: own results against a provider's, and result files typed in by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sign_of(code: Column) -> Column:
    """Home, draw and away codes as the letters of a ticket; anything else stays, nothing is null."""
    return F.when(code == "1", "L").when(code == "X", "E").when(code == "2", "V").otherwise(F.nullif(code, F.lit("")))


def score_sign(home: Column, away: Column) -> Column:
    return F.when(home > away, "L").when(home < away, "V").when(home == away, "E")


def provider_sign(score: Column, status: Column) -> Column:
    """The sign of a finished match's score `h-a`, else null."""
    part = lambda i: F.trim(F.get(F.split(score, "-", 2), i)).try_cast("int")
    return F.when(status == "finished", score_sign(part(0), part(1)))


def predicted_signs(links: DataFrame, predictions: DataFrame) -> DataFrame:
    """slate_id, match_id, predicted: the newest prediction made for this slate, else the newest of the match. Two equi-joins, not an "or"."""
    newest = lambda rows, key, name: rows.groupBy(*key).agg(F.max_by("code", F.struct("generated_at", "code")).alias(name))
    own = newest(predictions.where("slate_id is not null"), ["slate_id", "match_id"], "own")
    rows = links.select("slate_id", "match_id").join(own, ["slate_id", "match_id"], "left").join(newest(predictions, ["match_id"], "any"), "match_id", "left")
    return rows.select("slate_id", "match_id", sign_of(F.coalesce("own", "any")).alias("predicted"))


def validated(links: DataFrame, predictions: DataFrame, results: DataFrame, provider: DataFrame, consult: bool = True) -> DataFrame:
    """Per slate: how many positions are predicted, known here and known to the provider, conflicts, hits, blockers, and whether the provider's results could be applied (C20).

    The provider fills gaps: a slate whose positions all have a result of their own does not look at it. links: slate_id, position, match_id. predictions: match_id, slate_id, generated_at, code.
    results: match_id, played_at, result_code. provider: slate_id, position, score, status.
    """
    local = results.groupBy("match_id").agg(F.max_by("result_code", F.struct("played_at", "result_code")).alias("code")).select("match_id", sign_of(F.col("code")).alias("local"))
    offered = provider.select("slate_id", "position", provider_sign(F.col("score"), F.col("status")).alias("offered")).groupBy("slate_id", "position").agg(F.min("offered").alias("offered"))
    rows = links.join(local, "match_id", "left").join(offered, ["slate_id", "position"], "left").join(predicted_signs(links, predictions), ["slate_id", "match_id"], "left")
    count = lambda c, name: F.count_if(c).alias(name)
    gap = F.col("local").isNull()
    sums = rows.groupBy("slate_id").agg(
        F.count(F.lit(1)).alias("match_count"), F.count("predicted").alias("predictions_count"), F.count("local").alias("local_results_count"), F.count("offered").alias("offered"), count(gap & F.col("offered").isNotNull(), "filled"),
        count(F.col("local") != F.col("offered"), "apart"), count(F.col("local") == F.col("predicted"), "own_hits"), count(gap & (F.col("offered") == F.col("predicted")), "filled_hits"),
    )
    gaps = F.col("local_results_count") < F.col("match_count")
    asked = gaps & F.lit(consult)
    used = lambda c: F.when(asked, F.col(c)).otherwise(0).cast("long")
    n, known, found, conflicts = F.col("match_count"), F.col("local_results_count"), used("offered"), used("apart")
    covered = known + used("filled")
    blockers = F.array_compact(F.array(
        F.when(asked & (found == 0), "missing_provider_results"), F.when(known == 0, "missing_local_results"), F.when(conflicts > 0, "result_conflicts"), F.when(covered < n, "incomplete_coverage"), F.when(F.col("predictions_count") < n, "incomplete_predictions"),
    ))
    status = F.when(asked, "consulted").when(gaps, "not_consulted").otherwise("skipped_local_complete")
    return sums.select(
        "slate_id", "match_count", "predictions_count", "local_results_count", found.alias("provider_results_count"), status.alias("provider_status"), F.round(covered / n, 4).alias("coverage"), conflicts.alias("conflicts"),
        (F.col("own_hits") + used("filled_hits")).alias("hits"), ((covered == n) & (conflicts == 0) & (found == n)).alias("ready_to_apply"), F.array_join(blockers, ",").alias("blockers"),
    )


def manual_evaluated(files: DataFrame, rows: DataFrame, slates: DataFrame, links: DataFrame, canonical: DataFrame) -> DataFrame:
    """Whether a file of results typed in by hand may be applied to its slate, and what stands against it (C27). Nothing is written.

    files: file_id, slate_id, draw_code, is_trusted. rows: file_id, position, sign, home_goals, away_goals. slates: slate_id, slate_draw. links: slate_id, position, match_id. canonical: match_id, result_code (the best source's, conflicting or not).
    """
    sizes = links.groupBy("slate_id").agg(F.count(F.lit(1)).alias("match_count"))
    heads = files.join(slates, "slate_id").join(sizes, "slate_id", "left").withColumn("match_count", F.coalesce("match_count", F.lit(0)))
    known = links.join(canonical, "match_id").select("slate_id", "position", sign_of(F.col("result_code")).alias("existing")).groupBy("slate_id", "position").agg(F.min("existing").alias("existing"))
    scored = score_sign(F.col("home_goals"), F.col("away_goals"))
    sign = F.nullif("sign", F.lit(""))
    typed = rows.join(heads.select("file_id", "slate_id", "match_count"), "file_id").join(known, ["slate_id", "position"], "left").withColumns({"scored": scored, "stated": sign, "effective": F.coalesce(sign, scored, F.lit(""))})
    inside = F.col("position").between(1, F.col("match_count"))
    sums = typed.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("provided_count"), F.size(F.collect_set("position")).alias("different"), F.size(F.collect_set(F.when(inside, F.col("position")))).cast("long").alias("inside"), F.count_if(~inside).alias("outside"),
        F.count_if(F.col("stated") != F.col("scored")).alias("mismatches"), F.count_if(F.col("scored").isNull()).alias("scoreless"), F.count_if(F.col("existing") != F.col("effective")).alias("conflicts"),
    )
    found = heads.join(sums, "file_id", "left").fillna(0, ["provided_count", "different", "inside", "outside", "mismatches", "scoreless", "conflicts"])
    n, given = F.col("match_count"), F.col("provided_count")
    blockers = F.array_compact(F.array(
        F.when(~F.col("draw_code").eqNullSafe(F.col("slate_draw")), "draw_code_mismatch"), F.when(given != F.col("different"), "duplicate_positions"), F.when(F.col("outside") > 0, "position_out_of_range"),
        F.when((F.col("inside") != n) | (F.col("outside") > 0), "incomplete_positions"), F.when(given != n, "match_count_mismatch"), F.when(F.col("mismatches") > 0, "sign_score_mismatch"), F.when(F.col("scoreless") > 0, "missing_score"),
        F.when(F.col("conflicts") > 0, "result_conflict"), F.when(~F.col("is_trusted"), "low_source_confidence"),
    ))
    return found.select("file_id", "slate_id", n.alias("match_count"), "provided_count", F.when(n > 0, F.round(F.col("inside") / n, 4)).otherwise(0.0).alias("coverage"), "conflicts", ((F.size(blockers) == 0) & (n > 0)).alias("ready_to_apply"), F.array_join(blockers, ",").alias("blockers"))
