"""Plans of the decision layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchloom.operators import decisions, results
from pitchloom.sources import derive

from .core import plan
from .results import CANONICAL



def inputs(spark, sf_dir):
    """Latest predictions with anchors that follow from match_id."""
    latest = results.latest(derive.predictions(spark, sf_dir), ["match_id"], ["version"])
    k = F.col("match_id")
    sharp = [F.pow(p, 2) for p in decisions.P]
    total = sum(sharp)
    return latest.select(
        "match_id", "slate_id", "position", *((x / total).alias(p) for x, p in zip(sharp, decisions.P, strict=True)), (k % 3).alias("evidence"), (k % 5).alias("h2h"), (k % 7).alias("home_recent"), (k % 8).alias("away_recent"),
        ((k % 21 - 10) / 10).alias("edge"), (k % 6 == 0).alias("is_knockout"), ((k % 40) / 10).alias("expected_goals"), (k % 9 == 0).alias("is_friendly"), (k % 4 == 1).alias("fallback_used"),
    )


INPUTS = (
    CANONICAL
    + """,
i0 AS (SELECT match_id, slate_id, position, p_home ** 2 AS h, p_draw ** 2 AS d, p_away ** 2 AS a FROM latest),
i AS (SELECT match_id, slate_id, position, h / (h + d + a) AS p_home, d / (h + d + a) AS p_draw, a / (h + d + a) AS p_away, match_id % 3 AS evidence, match_id % 5 AS h2h, match_id % 7 AS home_recent, match_id % 8 AS away_recent,
  (match_id % 21 - 10) / 10 AS edge, match_id % 6 = 0 AS is_knockout, (match_id % 40) / 10 AS expected_goals, match_id % 9 = 0 AS is_friendly, match_id % 4 = 1 AS fallback_used FROM i0),
l AS (SELECT *, greatest(p_home, p_draw, p_away) AS top, list_sort([p_home, p_draw, p_away])[2] AS second, home_recent + away_recent + h2h < 4 OR NOT ((home_recent >= 2 AND away_recent >= 2) OR h2h >= 3) AS thin,
  evidence >= 1 OR h2h >= 2 OR (home_recent >= 3 AND away_recent >= 3) AS anch, (home_recent >= 5 AND away_recent >= 5) OR h2h >= 3 AS deep FROM i),
b AS (SELECT *, CASE WHEN thin THEN 'blocked' WHEN top >= 0.55 AND round(top - second, 9) >= 0.12 AND anch THEN 'high' WHEN top >= 0.40 AND round(top - second, 9) >= 0.02 AND anch THEN 'medium' ELSE 'low' END AS band,
  CASE WHEN thin OR NOT anch THEN 'low' WHEN deep AND evidence >= 1 THEN 'high' ELSE 'medium' END AS level FROM l)
"""
)


def banded(spark, sf_dir):
    rows = inputs(spark, sf_dir)
    return rows.select("*", decisions.confidence_band().alias("band"), decisions.evidence_level().alias("level"))


@plan("j06_confidence_band", INPUTS + "SELECT match_id, band, level, thin AS insufficient FROM b")
def confidence_band(spark, sf_dir):
    return banded(spark, sf_dir).select("match_id", "band", "level", decisions.insufficient().alias("insufficient"))


@plan(
    "j02_context_adjusted",
    INPUTS
    + """,
w AS (SELECT *, (evidence > 0 OR h2h > 0) AND abs(edge) >= 0.01 AS moves, least(abs(edge) * 0.06, 0.1) AS sw FROM i), v AS (SELECT *, least(greatest(p_draw - 0.12, 0), sw * 0.35) AS cut FROM w),
n AS (SELECT match_id, CASE WHEN NOT moves THEN p_home WHEN edge > 0 THEN p_home + sw + cut / 2 ELSE greatest(p_home - sw, 0.05) END AS h, CASE WHEN moves THEN p_draw - cut ELSE p_draw END AS d,
  CASE WHEN NOT moves THEN p_away WHEN edge > 0 THEN greatest(p_away - sw, 0.05) ELSE p_away + sw + cut / 2 END AS a FROM v)
SELECT match_id, round(h / (h + d + a), 6) AS p_home, round(d / (h + d + a), 6) AS p_draw, round(a / (h + d + a), 6) AS p_away FROM n""",
)
def context_adjusted(spark, sf_dir):
    return decisions.context_adjusted(inputs(spark, sf_dir)).select("match_id", *(F.round(p, 6).alias(p) for p in decisions.P))


@plan(
    "j04_knockout_adjusted",
    INPUTS
    + """,
s AS (SELECT *, CASE WHEN NOT is_knockout THEN 0 WHEN home_recent < 1 AND away_recent < 1 THEN 0.10 ELSE 0.10 + 0.15 * least(greatest((expected_goals - 1) / 3, 0), 1) END * p_draw AS f FROM i)
SELECT match_id, round(p_home + f * p_home / (p_home + p_away), 6) AS p_home, round(p_draw - f, 6) AS p_draw, round(p_away + f * p_away / (p_home + p_away), 6) AS p_away FROM s""",
)
def knockout_adjusted(spark, sf_dir):
    return decisions.knockout_adjusted(inputs(spark, sf_dir)).select("match_id", *(F.round(p, 6).alias(p) for p in decisions.P))


SANE = (
    INPUTS
    + """,
x AS (SELECT *, top >= 0.75 AND level <> 'high' AS extreme, least(p_home, p_away) <= 0.05 AS suspicious FROM b),
y AS (SELECT *, least(0.9, CASE WHEN level = 'low' THEN 0.6 ELSE 0.9 END, CASE WHEN (is_friendly AND level <> 'high') OR extreme THEN 0.65 ELSE 0.9 END) AS cap,
  CASE WHEN band = 'blocked' THEN 'BLOQUEADO' WHEN level = 'low' OR extreme THEN 'REVISAR' WHEN band = 'high' AND (fallback_used OR is_friendly) THEN 'LISTO' WHEN band = 'high' THEN 'FIJO' WHEN band = 'medium' THEN 'LISTO' ELSE 'REVISAR' END AS status FROM x),
z AS (SELECT * EXCLUDE (p_home, p_draw, p_away), k * p_home + (1 - k) / 3 AS p_home, k * p_draw + (1 - k) / 3 AS p_draw, k * p_away + (1 - k) / 3 AS p_away FROM (SELECT *, CASE WHEN top > cap THEN (cap - 1.0::DOUBLE / 3) / (top - 1.0::DOUBLE / 3) ELSE 1.0 END AS k FROM y)),
r AS (SELECT *, CASE WHEN status IN ('REVISAR', 'BLOQUEADO') OR extreme OR suspicious OR level = 'low' THEN 'high' WHEN status = 'LISTO' OR level = 'medium' THEN 'medium' ELSE 'low' END AS risk FROM z),
san AS (SELECT *, ['baja', 'media-baja', 'media', 'alta'][1 + least(CASE status WHEN 'BLOQUEADO' THEN 0 WHEN 'REVISAR' THEN 1 WHEN 'LISTO' THEN 2 ELSE 3 END,
  CASE WHEN level = 'low' OR fallback_used OR extreme OR suspicious OR band = 'blocked' OR risk = 'high' THEN 1 ELSE 3 END, CASE WHEN is_friendly THEN 2 ELSE 3 END)] AS visible_confidence,
  CASE WHEN status = 'BLOQUEADO' THEN 'EVITAR' WHEN status = 'REVISAR' OR risk = 'high' THEN 'NO_DEJAR_SIMPLE' WHEN level = 'low' OR fallback_used OR extreme OR suspicious OR status = 'LISTO' THEN 'DOBLE_RECOMENDADO' ELSE 'SIMPLE' END AS strategy,
  array_to_string(list_filter([CASE WHEN level = 'low' THEN 'LOW_EVIDENCE' END, CASE WHEN is_friendly THEN 'INTERNATIONAL_FRIENDLY' END, CASE WHEN fallback_used THEN 'FALLBACK_USED' END, CASE WHEN band = 'blocked' THEN 'BLOCKED_INSUFFICIENT_DATA' END,
  CASE WHEN suspicious THEN 'SUSPICIOUS_CLASS_PROBABILITY' END, CASE WHEN extreme THEN 'EXTREME_PROBABILITY_WITHOUT_EVIDENCE' END, CASE WHEN top > cap + 1e-6 THEN 'EXTREME_PROBABILITY_CAPPED' END, CASE WHEN top > cap + 1e-6 AND is_friendly THEN 'FRIENDLY_UNCERTAINTY_PENALTY' END], lambda f: f IS NOT NULL), ',') AS flags FROM r)
"""
)


@plan("j10_sanity", SANE + "SELECT match_id, round(p_home, 6) AS p_home, round(p_draw, 6) AS p_draw, round(p_away, 6) AS p_away, status, risk, visible_confidence, strategy, flags FROM san")
def sanity(spark, sf_dir):
    found = decisions.sanity(banded(spark, sf_dir))
    return found.select("match_id", *(F.round(p, 6).alias(p) for p in decisions.P), "status", "risk", "visible_confidence", "strategy", F.array_join("flags", ",").alias("flags"))


DRAWN = (
    SANE
    + """,
dt AS (SELECT *, greatest(p_home, p_draw, p_away) AS tp, list_sort([p_home, p_draw, p_away])[2] AS sd FROM san),
du AS (SELECT *, band IN ('low', 'blocked') OR level = 'low' OR status IN ('REVISAR', 'BLOQUEADO') OR round(tp - sd, 9) <= 0.15 OR -(p_home * ln(greatest(p_home, 1e-9)) + p_draw * ln(greatest(p_draw, 1e-9)) + p_away * ln(greatest(p_away, 1e-9))) / ln(3) >= 0.9 AS unc,
  least(p_draw + 0.35 * (0.27 - p_draw), p_draw + 0.08, tp - 0.03) AS target FROM dt),
dr AS (SELECT *, unc AND round(0.27 - p_draw, 9) >= 0.06 AND target > p_draw + 1e-6 AS draw_lifted FROM du),
dl AS (SELECT * EXCLUDE (p_home, p_draw, p_away), p_home * (1 - f / (p_home + p_away)) AS p_home, p_draw + f AS p_draw, p_away * (1 - f / (p_home + p_away)) AS p_away,
  CASE WHEN NOT unc THEN 'high_confidence_unchanged' WHEN round(0.27 - p_draw, 9) < 0.06 THEN 'draw_already_sufficient' WHEN NOT draw_lifted THEN 'lift_below_threshold' ELSE 'lifted' END AS draw_reason
  FROM (SELECT *, CASE WHEN draw_lifted THEN target - p_draw ELSE 0 END AS f FROM dr))
"""
)


@plan("j15_draw_calibrated", DRAWN + "SELECT match_id, round(p_home, 6) AS p_home, round(p_draw, 6) AS p_draw, round(p_away, 6) AS p_away, draw_lifted, draw_reason FROM dl")
def draw_calibrated(spark, sf_dir):
    found = decisions.draw_calibrated(decisions.sanity(banded(spark, sf_dir)), 0.27)
    return found.select("match_id", *(F.round(p, 6).alias(p) for p in decisions.P), "draw_lifted", "draw_reason")


GUARDED = (
    DRAWN
    + """,
gd AS (SELECT *, list_filter([CASE WHEN status = 'BLOQUEADO' THEN 'blocked' END, CASE WHEN status = 'REVISAR' THEN 'review' END, CASE WHEN risk = 'high' THEN 'risk_high' END, CASE WHEN strategy = 'NO_DEJAR_SIMPLE' THEN 'no_dejar_simple' END,
  CASE WHEN strategy NOT IN ('SIMPLE', 'NO_DEJAR_SIMPLE') THEN 'requires_coverage' END, CASE WHEN suspicious THEN 'suspicious_class' END, CASE WHEN fallback_used AND level = 'low' THEN 'fallback_low_evidence' END], lambda f: f IS NOT NULL) AS reasons FROM dl),
ge AS (SELECT *, strategy = 'SIMPLE' AND len(reasons) = 0 AS simple_allowed FROM gd)
"""
)


@plan(
    "j16_presentation_guard",
    GUARDED
    + """SELECT match_id, simple_allowed, array_to_string(reasons, ',') AS reasons, CASE WHEN status = 'BLOQUEADO' THEN 'blocked' WHEN fallback_used AND extreme AND level = 'low' AND NOT simple_allowed THEN 'unreliable' WHEN status = 'REVISAR' THEN 'review'
  WHEN top > cap + 1e-6 OR extreme THEN 'review' WHEN level = 'low' OR draw_lifted OR (fallback_used AND band = 'high') THEN 'low' WHEN band = 'high' AND NOT simple_allowed THEN 'review' ELSE band END AS shown_band FROM ge""",
)
def presentation_guard(spark, sf_dir):
    found = decisions.guarded(decisions.draw_calibrated(decisions.sanity(banded(spark, sf_dir)), 0.27))
    return found.select("match_id", "simple_allowed", F.array_join("reasons", ",").alias("reasons"), "shown_band")


@plan(
    "b13_slate_dates",
    """.
k AS (SELECT match_id AS slate_id, epoch(kickoff_at)::BIGINT AS ko FROM matches),
r AS (SELECT slate_id, CASE WHEN slate_id % 11 = 0 THEN NULL ELSE ko END AS cl, ko + (slate_id % 5 - 3) * 21600 AS cr, ko + (slate_id % 9 - 4) * 86400 AS ob, CASE WHEN slate_id % 13 = 0 THEN ko + 1 END AS pr, slate_id % 17 = 0 AS lo, slate_id % 2 = 0 AS fx, slate_id % 3 = 0 AS ot FROM k)
SELECT slate_id, CASE WHEN cl IS NULL AND ot THEN 'source_invalid' WHEN cl IS NULL AND fx THEN 'needs_official_pdf_date' WHEN cl IS NULL THEN 'needs_operator_confirmation' WHEN lo THEN 'stale_source' WHEN cl < cr - 43200 THEN 'stale_source'
  WHEN cl < ob - 259200 THEN 'stale_source' WHEN cl <= pr THEN 'date_suspect' ELSE 'date_valid' END AS date_status FROM r""",
)
def slate_dates(spark, sf_dir):
    s, shift = F.col("slate_id"), lambda seconds: F.timestamp_seconds(F.unix_seconds("kickoff_at") + seconds)
    rows = derive.matches(spark, sf_dir).select(F.col("match_id").alias("slate_id"), "kickoff_at").select(
        "slate_id", F.when(s % 11 != 0, F.col("kickoff_at")).alias("closes_at"), shift((s % 5 - 3) * 21600).alias("created_at"), shift((s % 9 - 4) * 86400).alias("observed_at"), F.when(s % 13 == 0, shift(F.lit(1))).alias("prev_closes_at"),
        F.when(s % 17 == 0, "low").otherwise("high").alias("confidence"), (s % 2 == 0).alias("has_fixtures"), (s % 3 == 0).alias("other_contest"),
    )
    return decisions.slate_dates(rows).select("slate_id", "date_status")
