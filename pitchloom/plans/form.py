"""Plans of as-of features."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchloom.operators import features
from pitchloom.sources import derive

from .core import plan

TEAM_ROWS = """.
t AS (SELECT match_id, competition_id, kickoff_at, epoch(kickoff_at)::BIGINT AS tm, home_team_id AS team_id, true AS is_home, home_goals AS gf, away_goals AS ga FROM played
  UNION ALL SELECT match_id, competition_id, kickoff_at, epoch(kickoff_at)::BIGINT, away_team_id, false, away_goals, home_goals FROM played),
tp AS (SELECT *, CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END AS points FROM t)
"""

FORM_SQL = (
    TEAM_ROWS
    + """,
p AS (SELECT x.match_id, x.team_id, y.points, y.gf, y.ga, y.tm, row_number() OVER (PARTITION BY x.match_id, x.team_id ORDER BY y.tm DESC, y.match_id DESC) AS k
  FROM tp x JOIN tp y ON x.team_id = y.team_id AND y.tm < x.tm AND y.tm >= x.tm - 365 * 86400),
s AS (SELECT match_id, team_id, count(*) AS n, sum(points) AS points, sum(gf) AS gf, sum(ga) AS ga, max(tm) AS prior FROM p WHERE k <= 8 GROUP BY ALL)
SELECT t.match_id, t.team_id, t.is_home, coalesce(n, 0)::BIGINT AS matches, coalesce(s.points, 0)::BIGINT AS points, coalesce(s.gf, 0)::BIGINT AS goals_for, coalesce(s.ga, 0)::BIGINT AS goals_against,
  (coalesce(s.gf, 0) - coalesce(s.ga, 0))::BIGINT AS goal_balance, CASE WHEN n > 0 THEN round(s.points / n, 4) ELSE 0.0 END AS points_per_match,
  coalesce(round((t.tm - prior) / 86400, 4), 7.0) AS days_rest FROM t LEFT JOIN s ON s.match_id = t.match_id AND s.team_id = t.team_id"""
)


@plan("e04_recent_form", FORM_SQL)
def recent_form(spark, sf_dir):
    return features.recent_form(derive.played(spark, sf_dir))


@plan(
    "d06_head_to_head",
    """.
m AS (SELECT *, epoch(kickoff_at)::BIGINT AS tm, least(home_team_id, away_team_id) AS lo, greatest(home_team_id, away_team_id) AS hi FROM played),
p AS (SELECT x.match_id, CASE WHEN y.home_team_id = x.home_team_id THEN y.home_goals - y.away_goals ELSE y.away_goals - y.home_goals END AS b,
  row_number() OVER (PARTITION BY x.match_id ORDER BY y.tm DESC, y.match_id DESC) AS k FROM m x JOIN m y ON x.lo = y.lo AND x.hi = y.hi AND y.tm < x.tm)
SELECT m.match_id, count(b) FILTER (WHERE k <= 5) AS meetings, count(*) FILTER (WHERE k <= 5 AND b > 0) AS home_wins, count(*) FILTER (WHERE k <= 5 AND b < 0) AS away_wins,
  count(*) FILTER (WHERE k <= 5 AND b = 0) AS draws, coalesce(sum(b) FILTER (WHERE k <= 5), 0)::BIGINT AS goal_balance FROM m LEFT JOIN p ON p.match_id = m.match_id GROUP BY m.match_id""",
)
def head_to_head(spark, sf_dir):
    return features.head_to_head(derive.played(spark, sf_dir))


ROLLING_SQL = (
    TEAM_ROWS
    + """,
h AS (SELECT x.match_id, x.team_id, y.points, y.gf, y.ga, y.tm, row_number() OVER (PARTITION BY x.match_id, x.team_id ORDER BY y.tm DESC, y.match_id DESC) AS k FROM tp x JOIN tp y ON x.team_id = y.team_id AND y.tm < x.tm),
hs AS (SELECT match_id, team_id, avg(gf) FILTER (WHERE k <= 5) AS f5, avg(ga) FILTER (WHERE k <= 5) AS a5, avg(gf) AS f10, avg(ga) AS a10, avg(points) AS p10, max(tm) AS prior FROM h WHERE k <= 10 GROUP BY ALL),
bs AS (SELECT competition_id, avg(home_goals) AS hm, avg(away_goals) AS am FROM played GROUP BY 1),
rolling AS (SELECT t.match_id, t.team_id, t.is_home::INT::DOUBLE AS home_indicator, round(coalesce(f5, 0), 6) AS rolling_goals_for_5, round(coalesce(a5, 0), 6) AS rolling_goals_against_5, round(coalesce(f10, 0), 6) AS rolling_goals_for_10,
  round(coalesce(a10, 0), 6) AS rolling_goals_against_10, round(coalesce(p10, 0), 6) AS points_per_match_10, round(hm, 6) AS competition_baseline_home_goals, round(am, 6) AS competition_baseline_away_goals,
  least(coalesce(round((t.tm - prior) / 86400, 6), 30.0), 30.0) AS days_rest FROM t JOIN bs USING (competition_id) LEFT JOIN hs ON hs.match_id = t.match_id AND hs.team_id = t.team_id)
"""
)


@plan("e06_rolling_goals", ROLLING_SQL + "SELECT * FROM rolling")
def rolling_goals(spark, sf_dir):
    return features.rolling_goals(derive.played(spark, sf_dir))


RECENT = """,
rr AS (SELECT x.match_id, x.team_id, y.match_id AS past_match_id, y.tm AS played_seconds, row_number() OVER (PARTITION BY x.match_id, x.team_id ORDER BY y.tm DESC, y.match_id DESC) AS rank FROM tp x JOIN tp y ON x.team_id = y.team_id AND y.tm < x.tm),
mm AS (SELECT *, epoch(kickoff_at)::BIGINT AS tm, least(home_team_id, away_team_id) AS lo, greatest(home_team_id, away_team_id) AS hi FROM played),
mt AS (SELECT x.match_id, y.match_id AS past_match_id, y.tm AS played_seconds, row_number() OVER (PARTITION BY x.match_id ORDER BY y.tm DESC, y.match_id DESC) AS rank FROM mm x JOIN mm y ON x.lo = y.lo AND x.hi = y.hi AND y.tm < x.tm)
"""


@plan("c10_recent_results", TEAM_ROWS + RECENT + "SELECT match_id, team_id, rank, past_match_id, played_seconds FROM rr WHERE rank <= 8")
def recent_results(spark, sf_dir):
    return features.recent_results(derive.played(spark, sf_dir))


@plan("c11_meetings", TEAM_ROWS + RECENT + "SELECT match_id, rank, past_match_id, played_seconds FROM mt WHERE rank <= 5")
def meetings(spark, sf_dir):
    return features.meetings(derive.played(spark, sf_dir))


@plan(
    "c12_context_results",
    TEAM_ROWS
    + RECENT
    + """, cx AS (SELECT match_id, past_match_id, max(played_seconds) AS played_seconds, bool_or(h) AS is_h2h FROM (SELECT match_id, past_match_id, played_seconds, true AS h FROM mt WHERE rank <= 5 UNION ALL SELECT match_id, past_match_id, played_seconds, false FROM rr WHERE rank <= 5) GROUP BY 1, 2)
SELECT match_id, past_match_id, is_h2h, row_number() OVER (PARTITION BY match_id ORDER BY is_h2h DESC, played_seconds DESC, past_match_id DESC) AS rank FROM cx""",
)
def context_results(spark, sf_dir):
    return features.context_results(derive.played(spark, sf_dir))


@plan(
    "e01_cadence",
    """.
s AS (SELECT competition_id, match_id, epoch(kickoff_at) AS tm, unnest([home_team_id, away_team_id]) AS team_id FROM matches),
g AS (SELECT competition_id, (tm - lag(tm) OVER (PARTITION BY competition_id, team_id ORDER BY tm, match_id)) / 86400 AS gap, count(*) OVER (PARTITION BY competition_id, team_id) AS n FROM s),
c AS (SELECT competition_id, median(gap) FILTER (WHERE gap > 0 AND n >= 4) AS g FROM g GROUP BY 1)
SELECT competition_id, round(g, 6) AS median_gap, round(CASE WHEN g IS NULL THEN 240.0 ELSE least(greatest(3 * g, 90.0), 365.0) END, 6) AS window_days,
  round(CASE WHEN g IS NULL THEN 14.0 ELSE least(greatest(1.5 * g, 5.0), 30.0) END, 6) AS tolerance_days FROM c""",
)
def cadence(spark, sf_dir):
    return features.cadence(derive.matches(spark, sf_dir))


@plan("e13_decay_weights", "SELECT match_id, round(exp(-((SELECT max(epoch(kickoff_at)) FROM played) - epoch(kickoff_at)) / 86400 / 365.0), 9) AS weight FROM played")
def decay_weights(spark, sf_dir):
    return features.decay_weights(derive.played(spark, sf_dir))


@plan("d04_league_baselines", "SELECT competition_id, count(*) AS matches, round(avg(home_goals), 6) AS home_mean, round(avg(away_goals), 6) AS away_mean FROM played GROUP BY 1")
def league_baselines(spark, sf_dir):
    return features.league_baselines(derive.played(spark, sf_dir))


@plan(
    "c09_pair_competition",
    """.
p AS (SELECT least(home_team_id, away_team_id) AS low_team, greatest(home_team_id, away_team_id) AS high_team, competition_id, count(*) AS n FROM matches GROUP BY ALL)
SELECT low_team, high_team, competition_id, n FROM p QUALIFY row_number() OVER (PARTITION BY low_team, high_team ORDER BY n DESC, competition_id) = 1""",
)
def pair_competition(spark, sf_dir):
    return features.unordered_pair_counts(derive.matches(spark, sf_dir))


@plan(
    "c04_nearest_fixture",
    """.
w AS (SELECT match_id AS request_id, competition_id, home_team_id, away_team_id, epoch(kickoff_at) + 3600 * (match_id % 97) AS tm FROM matches)
SELECT request_id, match_id, abs(m.tm - w.tm)::BIGINT AS seconds_apart FROM w JOIN (SELECT *, epoch(kickoff_at) AS tm FROM matches) m USING (competition_id, home_team_id, away_team_id)
WHERE abs(m.tm - w.tm) <= 48 * 3600 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY abs(m.tm - w.tm), m.tm, match_id) = 1""",
)
def nearest_fixture(spark, sf_dir):
    found = derive.matches(spark, sf_dir)
    tm = F.timestamp_seconds(F.unix_seconds("kickoff_at") + 3600 * (F.col("match_id") % 97))
    wanted = found.select(F.col("match_id").alias("request_id"), "competition_id", "home_team_id", "away_team_id", tm.alias("kickoff_at"))
    return features.nearest_fixture(wanted, found)
