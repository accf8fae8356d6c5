"""Plans of ratings and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchloom.operators import evaluation, rating
from pitchloom.sources import derive

from .core import plan
from .form import TEAM_ROWS

SIDES = (("", "true"), ("home_", "is_home"), ("away_", "NOT is_home"))
SUMS = ", ".join(
    f"count(*) FILTER (WHERE {own}) AS {n}matches, coalesce(sum(points) FILTER (WHERE {own}), 0)::BIGINT AS {n}points, coalesce(sum(gf) FILTER (WHERE {own}), 0)::BIGINT AS {n}goals_for, "
    f"coalesce(sum(ga) FILTER (WHERE {own}), 0)::BIGINT AS {n}goals_against, coalesce(sum(gf - ga) FILTER (WHERE {own}), 0)::BIGINT AS {n}goal_balance, count(*) FILTER (WHERE {own} AND gf = ga) AS {n}draws"
    for n, own in SIDES
)
PROFILES = TEAM_ROWS + f", prof AS (SELECT team_id, {SUMS} FROM tp GROUP BY 1)\n"
COMPETITIONS = """,
c AS (SELECT competition_id, count(*) AS matches, count(*) FILTER (WHERE home_goals > away_goals) AS home_wins, count(*) FILTER (WHERE home_goals < away_goals) AS away_wins, count(*) FILTER (WHERE home_goals = away_goals) AS draws,
  sum(home_goals)::BIGINT AS home_goals, sum(away_goals)::BIGINT AS away_goals FROM played GROUP BY 1),
comp AS (SELECT *, CASE WHEN matches >= 10 THEN least(greatest(55.0::DOUBLE + (home_wins - away_wins) / matches * 120 + (home_goals - away_goals) / matches * 18, 35.0), 110.0) ELSE 75.0 END AS home_bonus,
  CASE WHEN matches >= 10 THEN greatest(home_goals / matches, 0.4) ELSE 1.45 END AS home_rate, CASE WHEN matches >= 10 THEN greatest(away_goals / matches, 0.3) ELSE 1.15 END AS away_rate, draws / matches AS draw_rate FROM c)
"""


def strength_sql(side: str) -> str:
    mixed = lambda c: f"((CASE WHEN {side}_matches >= 5 THEN 0.7 ELSE 0.45 END) * coalesce({side}_{c} / nullif({side}_matches, 0), 0) + (1 - CASE WHEN {side}_matches >= 5 THEN 0.7 ELSE 0.45 END) * coalesce({c} / nullif(matches, 0), 0))"
    return f"0.55::DOUBLE * {mixed('points')} + 0.3::DOUBLE * {mixed('goal_balance')} + 0.12::DOUBLE * {mixed('goals_for')} - 0.1::DOUBLE * {mixed('goals_against')}"


@plan("d02_team_profiles", PROFILES + "SELECT * FROM prof")
def team_profiles(spark, sf_dir):
    return rating.team_profiles(derive.played(spark, sf_dir))


@plan("i10_profile_strength", PROFILES + f"SELECT team_id, round({strength_sql('home')}, 9) AS s_home, round({strength_sql('away')}, 9) AS s_away FROM prof")
def profile_strength(spark, sf_dir):
    found = rating.team_profiles(derive.played(spark, sf_dir))
    return found.select("team_id", F.round(rating.profile_strength("home"), 9).alias("s_home"), F.round(rating.profile_strength("away"), 9).alias("s_away"))


@plan("i08_competition_profiles", TEAM_ROWS + COMPETITIONS + "SELECT competition_id, matches, home_wins, away_wins, draws, home_goals, away_goals, round(home_bonus, 6) AS home_bonus, round(home_rate, 6) AS home_rate, round(away_rate, 6) AS away_rate, round(draw_rate, 6) AS draw_rate FROM comp")
def competition_profiles(spark, sf_dir):
    found = rating.competition_profiles(derive.played(spark, sf_dir))
    return found.select("competition_id", "matches", "home_wins", "away_wins", "draws", "home_goals", "away_goals", *(F.round(c, 6).alias(c) for c in ("home_bonus", "home_rate", "away_rate", "draw_rate")))


PRIORS = ", ".join(f"round((count(*) FILTER (WHERE result_code = '{c}') + 1) / (count(*) + 3), 4) AS prior_{k}" for c, k in (("1", "home"), ("X", "draw"), ("2", "away")))


@plan("d03_class_priors", f"SELECT {PRIORS}, round(count(*) FILTER (WHERE result_code = 'X') / count(*), 4) AS league_draw_rate FROM played")
def class_priors(spark, sf_dir):
    return rating.class_priors(derive.played(spark, sf_dir))


FOLD = "list_reduce(list_prepend(1.0::DOUBLE, list({c} ORDER BY tm, match_id)), lambda old, x: (old + 1 + x / 4) / 2)"
MOVING = ", mov AS (SELECT team_id, round(" + FOLD.format(c="gf::DOUBLE") + ", 9) AS offense, round(" + FOLD.format(c="ga::DOUBLE") + ", 9) AS defense FROM tp GROUP BY 1)\n"


@plan("d01_moving_strength", TEAM_ROWS + MOVING + "SELECT * FROM mov")
def moving_strength(spark, sf_dir):
    return rating.moving_strength(derive.played(spark, sf_dir))


GRID = """,
gr AS (SELECT i, j FROM range(9) x(i), range(9) y(j)),
lam AS (SELECT competition_id, home_rate AS lh, away_rate AS la, greatest(least((greatest(least(draw_rate, 0.45), 0.18) - 0.26) * 1.4, 0.2), -0.2) AS rho FROM comp),
cells AS (SELECT competition_id, i, j, exp(-lh) * pow(lh, i) / factorial(i::INT) * exp(-la) * pow(la, j) / factorial(j::INT) *
  CASE WHEN i = 0 AND j = 0 THEN 1 - lh * la * rho WHEN i = 0 AND j = 1 THEN 1 + lh * rho WHEN i = 1 AND j = 0 THEN 1 + la * rho WHEN i = 1 AND j = 1 THEN 1 - rho ELSE 1 END AS p FROM lam, gr)
SELECT competition_id, round(sum(p) FILTER (WHERE i > j) / sum(p), 6) AS p_home, round(sum(p) FILTER (WHERE i = j) / sum(p), 6) AS p_draw, round(sum(p) FILTER (WHERE i < j) / sum(p), 6) AS p_away FROM cells GROUP BY 1"""


@plan("h22_dixon_coles", TEAM_ROWS + COMPETITIONS + GRID)
def dixon_coles(spark, sf_dir):
    found = rating.competition_profiles(derive.played(spark, sf_dir))
    grid = found.select("competition_id", rating.dixon_coles(F.col("home_rate"), F.col("away_rate"), rating.low_score_rho(F.col("draw_rate"))).alias("g"))
    return grid.select("competition_id", *(F.round(f"g.{k}", 6).alias(f"p_{k}") for k in ("home", "draw", "away")))


def team_table(played):
    """The newest rating, strengths and profile of each team."""
    rated = played.select("match_id", "kickoff_at", "home_team_id", "away_team_id").join(rating.elo(played), "match_id")
    sides = rated.select("kickoff_at", "match_id", F.explode(F.array(F.struct(F.col("home_team_id").alias("team_id"), F.col("home_after").alias("rating")), F.struct(F.col("away_team_id").alias("team_id"), F.col("away_after").alias("rating")))).alias("s"))
    newest = sides.groupBy("s.team_id").agg(F.max_by("s.rating", F.struct("kickoff_at", "match_id")).alias("rating"))
    return newest.join(rating.moving_strength(played), "team_id").join(rating.team_profiles(played), "team_id")


@plan("i07_heuristic_blend")
def heuristic_blend(spark, sf_dir):
    played = derive.played(spark, sf_dir)
    found = rating.blended(derive.matches(spark, sf_dir), team_table(played), rating.competition_profiles(played), rating.class_priors(played))
    return found.select("match_id", *(F.round(c, 6).alias(c) for c in ("p_home", "p_draw", "p_away")))


@plan("l01_walk_forward_elo")
def walk_forward_elo(spark, sf_dir):
    """Fixtures scored by the ratings before them; the draw share is the competition's so far."""
    played = derive.played(spark, sf_dir)
    rows = features_before(played).join(rating.elo(played), "match_id")
    share = 1 / (1 + F.pow(F.lit(10.0), (F.col("away_before") - F.col("home_before") - rating.HOME_EDGE) / 400))
    draw = F.least(F.greatest(F.col("draws") / F.col("n"), F.lit(0.08)), F.lit(0.42))
    rows = rows.select("match_id", "competition_id", "result_code", (share * (1 - draw)).alias("p_home"), draw.alias("p_draw"), ((1 - share) * (1 - draw)).alias("p_away"))
    return evaluation.verdicts(evaluation.samples(rows.drop("result_code"), rows.select("match_id", "result_code")), "competition_id", 0.5)


def features_before(played, least_before: int = 20):
    from pyspark.sql import Window as W

    w = W.partitionBy("competition_id").orderBy("kickoff_at", "match_id").rowsBetween(W.unboundedPreceding, -1)
    return played.select("match_id", "competition_id", "result_code", F.count(F.lit(1)).over(w).alias("n"), F.count_if(F.col("result_code") == "X").over(w).alias("draws")).where(F.col("n") >= least_before)
