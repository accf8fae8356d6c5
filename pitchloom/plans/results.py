"""Plans of results: canonical rows, conflicts, live state, scoring of slates."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchloom.operators import results
from pitchloom.sources import derive

from .core import plan

CANONICAL = """.
canon AS (SELECT match_id, source_id, home_goals, away_goals, result_code FROM results
  QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY priority, source_id) = 1 AND min(result_code) OVER (PARTITION BY match_id) = max(result_code) OVER (PARTITION BY match_id)),
latest AS (SELECT * FROM predictions WHERE version = 1)
"""
STATE = """,
ob AS (SELECT *, status = 'full_time' AS fin, row_number() OVER (PARTITION BY match_id, source_id ORDER BY observed_at, event_id) AS rn FROM live),
ac AS (SELECT * FROM (SELECT *, min(rn) FILTER (WHERE fin) OVER (PARTITION BY match_id, source_id) AS ff FROM ob) WHERE fin OR ff IS NULL OR rn < ff),
st0 AS (SELECT match_id, source_id, arg_max(status, rn) AS status, arg_max(minute, rn) FILTER (WHERE minute IS NOT NULL) AS minute, arg_max(home_goals, rn) FILTER (WHERE home_goals IS NOT NULL) AS home_goals,
  arg_max(away_goals, rn) FILTER (WHERE away_goals IS NOT NULL) AS away_goals, bool_or(fin) AS is_final, max(observed_at) AS observed_at FROM ac GROUP BY 1, 2),
state AS (SELECT *, CASE WHEN home_goals > away_goals THEN '1' WHEN home_goals = away_goals THEN 'X' WHEN home_goals < away_goals THEN '2' END AS result_code FROM st0),
bl AS (SELECT * FROM state QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY source_id) = 1)
"""


@plan("c17_canonical_results", CANONICAL + "SELECT * FROM canon")
def canonical(spark, sf_dir):
    return results.canonical(derive.results(spark, sf_dir))


@plan(
    "c25_conflict_info",
    """SELECT match_id, source_id, home_goals, away_goals, result_code, min(result_code) OVER m <> max(result_code) OVER m AS is_conflicting, count(*) OVER m AS sources FROM results
  WINDOW m AS (PARTITION BY match_id) QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY priority, source_id) = 1""",
)
def with_conflicts(spark, sf_dir):
    return results.with_conflicts(derive.results(spark, sf_dir))


@plan("c26_conflict_ids", "SELECT match_id FROM results GROUP BY 1 HAVING count(DISTINCT result_code) > 1")
def conflict_ids(spark, sf_dir):
    return results.conflicts(derive.results(spark, sf_dir))


@plan("e08_latest_predictions", "SELECT match_id, version, slate_id, position, round(p_home, 9) AS p_home, round(p_draw, 9) AS p_draw, round(p_away, 9) AS p_away FROM predictions QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY version DESC) = 1")
def latest_predictions(spark, sf_dir):
    found = results.latest(derive.predictions(spark, sf_dir), ["match_id"], ["version"])
    return found.select("match_id", "version", "slate_id", "position", *(F.round(c, 9).alias(c) for c in ("p_home", "p_draw", "p_away")))


@plan("n01_live_state", CANONICAL + STATE + "SELECT * EXCLUDE observed_at FROM state")
def live_state(spark, sf_dir):
    return results.live_state(derive.live(spark, sf_dir)).drop("observed_at")


@plan(
    "n02_promoted_finals",
    CANONICAL
    + STATE
    + """,
kn AS (SELECT match_id, source_id, event_id, observed_at, fin, last_value(home_goals IGNORE NULLS) OVER w AS home_goals, last_value(away_goals IGNORE NULLS) OVER w AS away_goals FROM ac
  WINDOW w AS (PARTITION BY match_id, source_id ORDER BY rn ROWS UNBOUNDED PRECEDING))
SELECT match_id, source_id, epoch_us(observed_at) AS played_us, home_goals, away_goals FROM kn WHERE fin AND home_goals IS NOT NULL AND away_goals IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY match_id, source_id, observed_at ORDER BY event_id DESC) = 1""",
)
def promoted_finals(spark, sf_dir):
    found = results.promoted(derive.live(spark, sf_dir))
    return found.select("match_id", "source_id", F.unix_micros("played_at").alias("played_us"), "home_goals", "away_goals")


@plan(
    "c18_merged_status",
    CANONICAL
    + STATE
    + """SELECT coalesce(c.match_id, s.match_id) AS match_id, CASE WHEN c.match_id IS NOT NULL THEN 'full_time' ELSE status END AS status, CASE WHEN c.match_id IS NOT NULL THEN c.home_goals ELSE s.home_goals END AS home_goals,
  CASE WHEN c.match_id IS NOT NULL THEN c.away_goals ELSE s.away_goals END AS away_goals, CASE WHEN c.match_id IS NOT NULL THEN 'canonical' ELSE 'live' END AS origin FROM canon c FULL JOIN bl s ON c.match_id = s.match_id""",
)
def merged_status(spark, sf_dir):
    return results.merged_status(results.canonical(derive.results(spark, sf_dir)), results.best_live(results.live_state(derive.live(spark, sf_dir))))


@plan(
    "g01_greedy_dedupe",
    """.
r AS (SELECT match_id, competition_id, home_team_id, away_team_id, home_goals, away_goals, epoch(kickoff_at)::BIGINT AS tm FROM played),
g AS (SELECT competition_id, home_team_id, away_team_id, home_goals, away_goals, list({'tm': tm, 'id': match_id} ORDER BY tm DESC, match_id DESC) AS rows FROM r GROUP BY ALL),
f AS (SELECT * EXCLUDE rows, list_reduce(list_prepend([], list_transform(rows, lambda x: [x])), lambda done, x: CASE WHEN len(list_filter(done, lambda y: abs(y.tm - x[1].tm) <= 48 * 3600)) > 0 THEN done ELSE list_concat(done, x) END) AS kept FROM g)
SELECT unnest(list_transform(kept, lambda x: x.id)) AS match_id, competition_id, home_team_id, away_team_id, home_goals, away_goals FROM f""",
)
def greedy_dedupe(spark, sf_dir):
    return results.without_repeats(derive.played(spark, sf_dir))


SCORES = (
    CANONICAL
    + """,
j AS (SELECT l.*, c.result_code AS rc, CASE WHEN p_home >= p_draw AND p_home >= p_away THEN '1' WHEN p_away >= p_draw THEN '2' ELSE 'X' END AS pick,
  CASE c.result_code WHEN '1' THEN p_home WHEN 'X' THEN p_draw WHEN '2' THEN p_away END AS own FROM latest l LEFT JOIN canon c ON c.match_id = l.match_id),
b AS (SELECT *, (p_home - (rc = '1')::INT) ** 2 + (p_draw - (rc = 'X')::INT) ** 2 + (p_away - (rc = '2')::INT) ** 2 AS brier, CASE WHEN rc IS NOT NULL THEN -ln(least(greatest(own, 1e-6), 1 - 1e-6)) END AS loss,
  (p_home > own)::INT + (p_draw > own)::INT + (p_away > own)::INT AS better FROM j)
"""
)


@plan(
    "d15_score_slates",
    SCORES
    + """SELECT slate_id, count(*) AS predicted, count(rc) AS scored, count(*) FILTER (WHERE pick = rc) AS hits, count(*) FILTER (WHERE better <= 1) AS top2_hits,
  round(avg(brier), 6) AS brier, round(avg(loss), 6) AS log_loss, round(count(*) FILTER (WHERE pick = rc) / nullif(count(rc), 0), 6) AS hit_rate FROM b GROUP BY 1""",
)
def score_slates(spark, sf_dir):
    latest = results.latest(derive.predictions(spark, sf_dir), ["match_id"], ["version"])
    return results.scored_slates(latest, results.canonical(derive.results(spark, sf_dir)))


@plan(
    "g11_gap_batches",
    """.
o AS (SELECT match_id, event_id, epoch_us(observed_at) AS tm FROM live),
m AS (SELECT *, CASE WHEN tm - lag(tm) OVER (PARTITION BY match_id ORDER BY tm, event_id) <= 86400000000 THEN 0 ELSE 1 END AS new FROM o)
SELECT match_id, event_id, (sum(new) OVER (PARTITION BY match_id ORDER BY tm, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS batch FROM m""",
)
def gap_batches(spark, sf_dir):
    return results.gap_batches(derive.live(spark, sf_dir), "match_id", "observed_at", 86400).select("match_id", "event_id", "batch")
