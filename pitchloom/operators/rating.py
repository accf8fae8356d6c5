"""Ratings and scores: Elo, moving averages, profiles, Dixon-Coles, the blend and its calibration towards class priors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .features import team_rows

#: Fixed values of the rating scheme.
BASE, STEP, HOME_EDGE = 1500.0, 24.0, 75.0
BLEND = {"elo": 0.30, "poisson": 0.25, "profile": 0.45}
PRIOR_SHARE = 0.18
GRID = 8


def elo(played: DataFrame, newest_first: bool = False) -> DataFrame:
    """match_id with both ratings before and after it. A rating depends on both teams' history, so a competition's matches pass through one task in order.

    They are sorted outside Python (the sort spills) and come in batches; only the teams' ratings are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rating = None, None
        for batch in batches:
            rows = []
            for competition, match, home, away, code in zip(*(batch.column(c).to_pylist() for c in ("competition_id", "match_id", "home_team_id", "away_team_id", "result_code")), strict=True):
                if rating is None or competition != current:
                    current, rating = competition, {}
                h, a = rating.get(home, BASE), rating.get(away, BASE)
                change = STEP * ({"1": 1.0, "2": 0.0}.get(code, 0.5) - 1 / (1 + 10 ** ((a - h - HOME_EDGE) / 400)))
                rating[home], rating[away] = h + change, a - change
                rows.append((match, h, a, h + change, a - change))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.float64()] * 4), strict=True)], ["match_id", "home_before", "away_before", "home_after", "away_after"])

    rows = played.select("competition_id", "match_id", F.unix_seconds("kickoff_at").alias("at"), "home_team_id", "away_team_id", "result_code")
    at = F.col("at").desc_nulls_last() if newest_first else F.col("at").asc_nulls_last()
    rows = rows.repartition("competition_id").sortWithinPartitions("competition_id", at, "match_id")
    return rows.mapInArrow(run, "match_id long, home_before double, away_before double, home_after double, away_after double")


def moving_strength(played: DataFrame) -> DataFrame:
    """team_id, offense, defense: moving averages (old + 1 + goals / 4) / 2 from 1 over a team's matches in order. They need no other team's state.

    The k-th newest of n matches weighs 2^-k and the start 2^-n, so they are sums and no team's matches are collected.
    """
    w = W.partitionBy("team_id").orderBy(*(F.desc(c) for c in ("kickoff_at", "match_id", "goals_for", "goals_against")))
    rows = team_rows(played).withColumn("k", F.row_number().over(w))
    half = lambda k: F.pow(F.lit(0.5), k)
    average = lambda c: F.round(F.sum((1.0 + F.col(c) / 4.0) * half(F.col("k"))) + half(F.max("k")), 9)
    return rows.groupBy("team_id").agg(average("goals_for").alias("offense"), average("goals_against").alias("defense"))


def team_profiles(played: DataFrame) -> DataFrame:
    """Sums over all, home and away matches of each team."""
    rows = team_rows(played).withColumn("balance", F.col("goals_for") - F.col("goals_against")).withColumn("draw", (F.col("goals_for") == F.col("goals_against")).cast("long"))
    sums = []
    for name, own in (("", F.lit(True)), ("home_", F.col("is_home")), ("away_", ~F.col("is_home"))):
        sums.append(F.count_if(own).alias(f"{name}matches"))
        sums += [F.sum(F.when(own, F.col(c)).otherwise(0)).alias(f"{name}{n}") for c, n in (("points", "points"), ("goals_for", "goals_for"), ("goals_against", "goals_against"), ("balance", "goal_balance"), ("draw", "draws"))]
    return rows.groupBy("team_id").agg(*sums)


def rate(total: Column, n: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.when(n > 0, total / n), F.lit(0.0))


def profile_strength(side: str) -> Column:
    """A team's strength from its profile: rates of the side's matches and of all, mixed by how many there are."""
    n, own = F.col("matches"), F.col(f"{side}_matches")
    w = F.when(own >= 5, F.lit(0.7)).otherwise(F.lit(0.45))
    mixed = lambda c: w * rate(F.col(f"{side}_{c}"), own) + (1 - w) * rate(F.col(c), n)
    return 0.55 * mixed("points") + 0.3 * mixed("goal_balance") + 0.12 * mixed("goals_for") - 0.1 * mixed("goals_against")


def competition_profiles(played: DataFrame) -> DataFrame:
    """Per competition: outcome and goal sums, Elo's home bonus, base scoring rates and the draw rate."""
    h, a = F.col("home_goals"), F.col("away_goals")
    sums = played.groupBy("competition_id").agg(
        F.count(F.lit(1)).alias("matches"), F.count_if(h > a).alias("home_wins"), F.count_if(h < a).alias("away_wins"), F.count_if(h == a).alias("draws"), F.sum(h).alias("home_goals"), F.sum(a).alias("away_goals"),
    )
    n, enough = F.col("matches"), F.col("matches") >= 10
    bonus = 55.0 + (F.col("home_wins") - F.col("away_wins")) / n * 120.0 + (F.col("home_goals") - F.col("away_goals")) / n * 18.0
    return sums.select(
        "*",
        F.when(enough, F.least(F.greatest(bonus, F.lit(35.0)), F.lit(110.0))).otherwise(F.lit(75.0)).alias("home_bonus"),
        F.when(enough, F.greatest(F.col("home_goals") / n, F.lit(0.4))).otherwise(F.lit(1.45)).alias("home_rate"),
        F.when(enough, F.greatest(F.col("away_goals") / n, F.lit(0.3))).otherwise(F.lit(1.15)).alias("away_rate"),
        (F.col("draws") / n).alias("draw_rate"),
    )


def low_score_rho(draw_rate: Column) -> Column:
    """The low-score correction from a draw rate."""
    return F.least(F.greatest((F.least(F.greatest(draw_rate, F.lit(0.18)), F.lit(0.45)) - 0.26) * 1.4, F.lit(-0.2)), F.lit(0.2))


def poisson(rate_: Column, k: Column) -> Column:
    """Closed form; all mass at 0 where the rate is not positive."""
    return F.when(rate_ <= 0, (k == 0).cast("double")).otherwise(F.exp(-rate_) * F.pow(rate_, k) / F.factorial(k))


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def dixon_coles(home: Column, away: Column, rho: Column, most: int = GRID) -> Column:
    """struct<home, draw, away> over scores 0..most.

    Sums over the independent grid come from running totals; the correction touches four cells only and is added to them.
    """
    goals = F.sequence(F.lit(0), F.lit(most))
    pmf = lambda rate_: F.transform(goals, lambda k: poisson(rate_, k))

    def shares(x: Column) -> Column:
        h, a, lh, la, r = x["h"], x["a"], x["lh"], x["la"], x["r"]
        sums = x["sums"]
        at = lambda i, j: F.get(h, F.lit(i)) * F.get(a, F.lit(j))
        return F.struct(
            (sums["home"] + at(1, 0) * la * r).alias("home"),
            (sums["draw"] - at(0, 0) * lh * la * r - at(1, 1) * r).alias("draw"),
            (sums["away"] + at(0, 1) * lh * r).alias("away"),
        )

    def scaled(p: Column) -> Column:
        whole = p["home"] + p["draw"] + p["away"]
        return F.struct(*(F.when(whole > 0, p[k] / whole).otherwise(F.lit(1 / 3)).alias(k) for k in ("home", "draw", "away")))

    def summed(x: Column) -> Column:
        """Each side's running total of the goals below stands beside the other's at every step: one walk over both."""
        names = ("home", "draw", "away", "h", "a")
        step = lambda s, p: (s["home"] + p["h"] * s["a"], s["draw"] + p["h"] * p["a"], s["away"] + p["a"] * s["h"], s["h"] + p["h"], s["a"] + p["a"])
        both = F.zip_with(x["h"], x["a"], lambda p, q: F.struct(p.alias("h"), q.alias("a")))
        sums = F.aggregate(both, F.struct(*(F.lit(0.0).alias(n) for n in names)), lambda s, p: F.struct(*(v.alias(n) for n, v in zip(names, step(s, p), strict=True))))
        return F.struct(*(x[n].alias(n) for n in ("h", "a", "lh", "la", "r")), sums.alias("sums"))

    inputs = F.struct(pmf(home).alias("h"), pmf(away).alias("a"), home.alias("lh"), away.alias("la"), rho.alias("r"))
    return let(let(let(inputs, summed), shares), scaled)


def class_priors(played: DataFrame) -> DataFrame:
    """One row: (n of the class + 1) / (n + 3), rounded to 4 places, and the draw rate."""
    n = F.count("result_code")
    return played.agg(*(F.round((F.count_if(F.col("result_code") == c) + 1) / (n + 3), 4).alias(f"prior_{k}") for c, k in (("1", "home"), ("X", "draw"), ("2", "away"))), F.round(F.count_if(F.col("result_code") == "X") / n, 4).alias("league_draw_rate"))


def blended(fixtures: DataFrame, teams: DataFrame, competitions: DataFrame, priors: DataFrame, weights: dict[str, float] = BLEND) -> DataFrame:
    """match_id, p_home, p_draw, p_away of the heuristic blend.

    teams: team_id, rating, offense, defense and the profile's sums. The score grid owns the draw; Elo, scores and profiles vote on how the rest is split.
    Unknown teams have rating 1500, strengths 1 and no profile.
    """
    strengths = teams.select("team_id", "rating", "offense", "defense", profile_strength("home").alias("s_home"), profile_strength("away").alias("s_away"))
    side = lambda s: strengths.select(F.col("team_id").alias(f"{s}_team_id"), *(F.col(c).alias(f"{s}_{c}") for c in ("rating", "offense", "defense", f"s_{s}")))
    rows = fixtures.select("match_id", "competition_id", "home_team_id", "away_team_id").join(side("home"), "home_team_id", "left").join(side("away"), "away_team_id", "left")
    rows = rows.join(competitions.select("competition_id", "home_bonus", "home_rate", "away_rate"), "competition_id", "left").join(F.broadcast(priors))
    return with_priors(blend_scores(rows, weights))


def blend_scores(rows: DataFrame, weights: dict[str, float] = BLEND) -> DataFrame:
    """rows with r_home, r_draw, r_away: the blend before priors and curves (I07). rows: both sides' ratings, strengths and profile strengths, the competition's home bonus and scoring rates, league_draw_rate."""
    own = rows.columns
    or_ = lambda c, x: F.coalesce(F.col(c), F.lit(x))
    by_elo = 1 / (1 + F.pow(F.lit(10.0), (or_("away_rating", BASE) - or_("home_rating", BASE) - or_("home_bonus", HOME_EDGE)) / 400))
    positive = lambda c: F.greatest(or_(c, 1.0), F.lit(0.05))
    home = F.greatest(or_("home_rate", 1.45) * positive("home_offense") * positive("away_defense"), F.lit(0.05))
    away = F.greatest(or_("away_rate", 1.15) * positive("away_offense") * positive("home_defense"), F.lit(0.05))
    rows = rows.select("*", by_elo.alias("by_elo"), home.alias("lh"), away.alias("la"))
    rows = rows.withColumn("grid", dixon_coles(F.col("lh"), F.col("la"), low_score_rho(F.col("league_draw_rate"))))
    edge = F.least(F.greatest(or_("home_s_home", 0.0) - or_("away_s_away", 0.0), F.lit(-1.5)), F.lit(1.5))
    decisive = F.col("grid.home") + F.col("grid.away")
    share = weights["elo"] * F.col("by_elo") + weights["poisson"] * F.when(decisive > 0, F.col("grid.home") / decisive).otherwise(F.lit(0.5)) + weights["profile"] / (1 + F.exp(-1.35 * edge))
    rows = rows.select(*own, F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)).alias("share"), F.least(F.greatest(F.col("grid.draw"), F.lit(0.08)), F.lit(0.42)).alias("draw"))
    return rows.select(*own, (F.col("share") * (1 - F.col("draw"))).alias("r_home"), F.col("draw").alias("r_draw"), ((1 - F.col("share")) * (1 - F.col("draw"))).alias("r_away"))


def with_priors(rows: DataFrame) -> DataFrame:
    """match_id, p_home, p_draw, p_away: raw scores drawn towards the class priors."""
    mixed = {k: (1 - PRIOR_SHARE) * F.col(f"r_{k}") + PRIOR_SHARE * F.col(f"prior_{k}") for k in ("home", "draw", "away")}
    total = mixed["home"] + mixed["draw"] + mixed["away"]
    return rows.select("match_id", *((p / total).alias(f"p_{k}") for k, p in mixed.items()))


def small_sample_rule(features: DataFrame) -> DataFrame:
    """match_id and probabilities from weighted gaps between the sides."""
    weights = {"form_gap": 0.75, "goal_gap": 0.55, "rest_gap": 0.08, "h2h_points_gap": 0.35, "h2h_goal_gap": 0.22, "context_gap": 0.45}
    strength = F.least(F.greatest(sum(w * F.col(c) for c, w in weights.items()), F.lit(-4.0)), F.lit(4.0))
    rows = features.select("match_id", strength.alias("s"))
    draw = F.greatest(F.lit(0.18), 0.34 - F.least(F.abs("s") * 0.05, F.lit(0.16)))
    home = (1 - draw) / (1 + F.exp(-F.col("s")))
    return rows.select("match_id", home.alias("p_home"), draw.alias("p_draw"), (1 - draw - home).alias("p_away"))
