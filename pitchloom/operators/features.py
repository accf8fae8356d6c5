"""As-of features of fixtures: recent form, head-to-head, rolling goals, cadence of competitions, decay weights.

Everything before a kickoff means strictly before: fixtures at the same time never see each other. Running sums are looked up at two places
instead of collecting histories, so a team's history of any length costs one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = 86400


def team_rows(played: DataFrame) -> DataFrame:
    """Two rows a match: team_id, is_home, goals_for, goals_against, points."""
    side = lambda home: F.struct(
        F.col("home_team_id" if home else "away_team_id").alias("team_id"), F.col("away_team_id" if home else "home_team_id").alias("opponent_id"), F.lit(home).alias("is_home"),
        F.col("home_goals" if home else "away_goals").alias("goals_for"), F.col("away_goals" if home else "home_goals").alias("goals_against"),
    )
    rows = played.select("match_id", "competition_id", "kickoff_at", F.explode(F.array(side(True), side(False))).alias("s")).select("match_id", "competition_id", "kickoff_at", "s.*")
    points = F.when(F.col("goals_for") > F.col("goals_against"), 3).when(F.col("goals_for") == F.col("goals_against"), 1).otherwise(0)
    return rows.withColumn("points", points.cast("long"))


def with_past(rows: DataFrame, key: list[str], values: list[str], last: int) -> DataFrame:
    """rows with `past`: the last `last` rows of the key strictly before, oldest first, as structs of at (seconds), match_id and the values.

    A kickoff's first row has nothing but earlier kickoffs before it, so its bounded frame is what all rows of the kickoff get and ties never see each other: one shuffle and one sort. Rows without a kickoff or key are left out.
    """
    timed = rows.withColumn("at", F.unix_seconds("kickoff_at")).where(F.col("at").isNotNull()).dropna(subset=key)
    before = F.collect_list(F.struct("at", "match_id", *values)).over(W.partitionBy(*key).orderBy("at", "match_id", *values).rowsBetween(-last, -1))
    first = F.first("past").over(W.partitionBy(*key, "at").orderBy("match_id", *values).rowsBetween(W.unboundedPreceding, 0))
    return timed.withColumn("past", before).withColumn("past", first)


def last_sums(rows: DataFrame, key: list[str], values: list[str], last: int, max_age_days: int | None) -> DataFrame:
    """rows with, for the last `last` rows of the key strictly before and at most max_age_days old: n, prior_at and the sums last_<value>."""
    found = with_past(rows, key, values, last)
    if max_age_days is not None:
        found = found.withColumn("past", F.expr(f"filter(past, x -> x.at >= at - {max_age_days * DAY})"))
    total = lambda v: F.aggregate("past", F.lit(0).cast("long"), lambda t, x: t + x[v])
    prior = F.timestamp_seconds(F.try_element_at("past", F.lit(-1))["at"])
    return found.select(*rows.columns, F.size("past").cast("long").alias("n"), prior.alias("prior_at"), *(total(v).alias(f"last_{v}") for v in values))


def per_match(total: str, n: str = "n") -> Column:
    """0 where there is no match, else the rate rounded to 4 places."""
    return F.when(F.col(n) > 0, F.round(F.col(total) / F.col(n), 4)).otherwise(F.lit(0.0))


def recent_form(played: DataFrame, last: int = 8, max_age_days: int = 365) -> DataFrame:
    """Per match and team: sums and rates of its last results, and days of rest, 7 where unknown."""
    rows = last_sums(team_rows(played), ["team_id"], ["points", "goals_for", "goals_against"], last, max_age_days)
    rest = (F.unix_seconds("kickoff_at") - F.unix_seconds("prior_at")) / DAY
    return rows.select(
        "match_id", "team_id", "is_home", F.col("n").alias("matches"), F.col("last_points").alias("points"), F.col("last_goals_for").alias("goals_for"), F.col("last_goals_against").alias("goals_against"),
        (F.col("last_goals_for") - F.col("last_goals_against")).alias("goal_balance"), per_match("last_points").alias("points_per_match"), F.coalesce(F.round(rest, 4), F.lit(7.0)).alias("days_rest"),
    )


def head_to_head(played: DataFrame, last: int = 5) -> DataFrame:
    """Per match: the last meetings of its two teams, seen from the home team."""
    low, high = F.least("home_team_id", "away_team_id"), F.greatest("home_team_id", "away_team_id")
    home_is_low = F.col("home_team_id") == F.col("low")
    balance = F.when(home_is_low, 1).otherwise(-1) * (F.col("home_goals") - F.col("away_goals"))
    rows = played.select("*", low.alias("low"), high.alias("high")).withColumn("low_balance", balance)
    rows = rows.withColumn("low_wins", (F.col("low_balance") > 0).cast("long")).withColumn("high_wins", (F.col("low_balance") < 0).cast("long"))
    found = last_sums(rows, ["low", "high"], ["low_balance", "low_wins", "high_wins"], last, None)
    own = lambda x, y: F.when(home_is_low, F.col(x)).otherwise(F.col(y))
    return found.select(
        "match_id", F.col("n").alias("meetings"), own("last_low_wins", "last_high_wins").alias("home_wins"), own("last_high_wins", "last_low_wins").alias("away_wins"),
        (F.col("n") - F.col("last_low_wins") - F.col("last_high_wins")).alias("draws"), (F.when(home_is_low, 1).otherwise(-1) * F.col("last_low_balance")).alias("goal_balance"),
    )


def rolling_goals(played: DataFrame, most_rest: float = 30.0) -> DataFrame:
    """Per match and team: means of goals and points over the last 5 and 10 matches strictly before (0 where there is none), the competition's means over all its matches, and days of rest up to most_rest."""
    found = with_past(team_rows(played), ["team_id"], ["goals_for", "goals_against", "points"], 10)

    def mean(value: str, last: int) -> Column:
        part = F.slice("past", F.greatest(F.lit(1), F.size("past") - last + 1), last)
        return F.when(F.size("past") > 0, F.aggregate(part, F.lit(0.0), lambda t, x: t + x[value]) / F.size(part)).otherwise(F.lit(0.0))

    rest = (F.col("at") - F.try_element_at("past", F.lit(-1))["at"]) / DAY
    means = {f"rolling_goals_{side}_{k}": mean(f"goals_{side}", k) for k in (5, 10) for side in ("for", "against")} | {"points_per_match_10": mean("points", 10)}
    base = played.groupBy("competition_id").agg(F.avg("home_goals").alias("home_mean"), F.avg("away_goals").alias("away_mean"))
    rows = found.select("match_id", "team_id", "competition_id", F.col("is_home").cast("double").alias("home_indicator"), *(F.round(m, 6).alias(n) for n, m in means.items()), F.least(F.coalesce(F.round(rest, 6), F.lit(most_rest)), F.lit(most_rest)).alias("days_rest"))
    with_base = rows.join(base, "competition_id")
    return with_base.select("match_id", "team_id", "home_indicator", *means, F.round("home_mean", 6).alias("competition_baseline_home_goals"), F.round("away_mean", 6).alias("competition_baseline_away_goals"), "days_rest")


def recent_results(played: DataFrame, last: int = 8) -> DataFrame:
    """Per match and team: its last results strictly before, newest first."""
    found = with_past(team_rows(played), ["team_id"], [], last)
    return found.select("match_id", "team_id", F.posexplode(F.reverse("past")).alias("rank", "p")).select("match_id", "team_id", (F.col("rank") + 1).cast("long").alias("rank"), F.col("p.match_id").alias("past_match_id"), F.col("p.at").alias("played_seconds"))


def meetings(played: DataFrame, last: int = 5) -> DataFrame:
    """Per match: the last meetings of its two teams strictly before, newest first (C11)."""
    rows = played.select("match_id", "kickoff_at", F.least("home_team_id", "away_team_id").alias("low"), F.greatest("home_team_id", "away_team_id").alias("high"))
    found = with_past(rows, ["low", "high"], [], last)
    return found.select("match_id", F.posexplode(F.reverse("past")).alias("rank", "p")).select("match_id", (F.col("rank") + 1).cast("long").alias("rank"), F.col("p.match_id").alias("past_match_id"), F.col("p.at").alias("played_seconds"))


def context_results(played: DataFrame, per_team: int = 5) -> DataFrame:
    """Per match: its teams' meetings and both teams' recent results, each once, meetings and newer ones first."""
    both = meetings(played).select("match_id", "past_match_id", "played_seconds", F.lit(True).alias("is_h2h"))
    both = both.unionByName(recent_results(played, per_team).select("match_id", "past_match_id", "played_seconds", F.lit(False).alias("is_h2h")))
    once = both.groupBy("match_id", "past_match_id").agg(F.max("played_seconds").alias("played_seconds"), F.max("is_h2h").alias("is_h2h"))
    order = W.partitionBy("match_id").orderBy(F.desc("is_h2h"), F.desc("played_seconds"), F.desc("past_match_id"))
    return once.select("match_id", "past_match_id", "is_h2h", F.row_number().over(order).cast("long").alias("rank"))


def model_features(played: DataFrame, windows: DataFrame, told: DataFrame, last: int = 8, last_meetings: int = 5) -> DataFrame:
    """The feature vector of each match as of its kickoff (E04): form over the competition's window, meetings, narrative signals, and what is known of the match.

    windows: competition_id, window_days; told: match_id, the signals of texts and reports, evidence_count.
    """
    sides = with_past(team_rows(played).join(windows, "competition_id"), ["team_id"], ["goals_for", "goals_against", "points"], last)
    sides = sides.withColumn("past", F.expr(f"filter(past, x -> at - x.at <= window_days * {DAY})"))
    total = lambda v: F.aggregate("past", F.lit(0).cast("long"), lambda t, x: t + x[v])
    rest = F.coalesce(F.round((F.col("at") - F.try_element_at("past", F.lit(-1))["at"]) / DAY, 2), F.lit(7.0))
    form = sides.select("match_id", "is_home", F.size("past").cast("long").alias("n"), total("points").alias("p"), total("goals_for").alias("gf"), total("goals_against").alias("ga"), rest.alias("rest")).withColumn("gb", F.col("gf") - F.col("ga"))
    rates = {"points": "p", "goal_balance": "gb", "goals_for": "gf", "goals_against": "ga"}

    known = F.struct(*(per_match(c).alias(f"{n}_per_match") for n, c in rates.items()), F.col("n").cast("double").alias("recent_matches"), "rest")
    both = form.groupBy("match_id").agg(F.collect_list(F.when(F.col("is_home"), known)).alias("home"), F.collect_list(F.when(~F.col("is_home"), known)).alias("away"))  # one row a side
    both = both.withColumn("home", F.explode("home")).withColumn("away", F.explode("away"))
    both = both.select("match_id", *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("home", "away") for c in (*(f"{n}_per_match" for n in rates), "recent_matches", "rest")))

    met = head_to_head(played, last_meetings)
    meetings_ = met.select("match_id", F.col("meetings").cast("double").alias("head_to_head_matches"), per_match_of(3 * (F.col("home_wins") - F.col("away_wins"))).alias("head_to_head_points_gap"), per_match_of(F.col("goal_balance")).alias("head_to_head_goal_balance_gap"))
    own = played.select("match_id", (F.col("home_team_id") % 3 == F.col("away_team_id") % 3).cast("double").alias("same_country_matchup"), (F.col("match_id") % 2 == 0).cast("double").alias("venue_known"), F.lit(1.0).alias("home_advantage"))
    rows = both.join(meetings_, "match_id").join(told, "match_id").join(own, "match_id")
    gap = lambda c: F.round(F.col(f"home_{c}") - F.col(f"away_{c}"), 4)
    signals = [c for c in told.columns if c.endswith(("_signals", "_signal_total"))]
    return rows.select(
        "match_id", *(c for s in ("home", "away") for c in (*(f"{s}_{n}_per_match" for n in rates), f"{s}_recent_matches")), gap("points_per_match").alias("form_gap"), gap("goal_balance_per_match").alias("goal_balance_gap"), F.round(F.col("home_rest") - F.col("away_rest"), 2).alias("rest_gap_days"),
        "head_to_head_matches", "head_to_head_points_gap", "head_to_head_goal_balance_gap", F.col("evidence_count").cast("double").alias("evidence_count"), *(F.col(c).cast("double").alias(c) for c in signals), F.col("home_availability_impact").alias("home_context_signal"),
        F.col("away_availability_impact").alias("away_context_signal"), "same_country_matchup", "venue_known", "home_advantage",
    )


def per_match_of(total: Column) -> Column:
    return F.when(F.col("meetings") > 0, F.round(total / F.col("meetings"), 4)).otherwise(F.lit(0.0))


def cadence(matches: DataFrame, least_matches: int = 4) -> DataFrame:
    """Per competition: the median positive gap in days between a team's fixtures, over teams with least_matches or more; the form window and the
    matching tolerance that follow from it (E01, E02, E03). Fixtures count whether or not they have a result."""
    sides = matches.select("competition_id", "match_id", "kickoff_at", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"))
    w = W.partitionBy("competition_id", "team_id").orderBy("kickoff_at", "match_id")
    gaps = sides.select("competition_id", ((F.unix_seconds("kickoff_at") - F.unix_seconds(F.lag("kickoff_at").over(w))) / DAY).alias("gap"), F.count(F.lit(1)).over(W.partitionBy("competition_id", "team_id")).alias("n"))
    medians = gaps.groupBy("competition_id").agg(F.median(F.when((F.col("gap") > 0) & (F.col("n") >= least_matches), F.col("gap"))).alias("median_gap"))
    clamp = lambda x, low, high, other: F.coalesce(F.least(F.greatest(x, F.lit(low)), F.lit(high)), F.lit(other))
    gap = F.col("median_gap")
    return medians.select("competition_id", F.round("median_gap", 6).alias("median_gap"), F.round(clamp(3 * gap, 90.0, 365.0, 240.0), 6).alias("window_days"), F.round(clamp(1.5 * gap, 5.0, 30.0, 14.0), 6).alias("tolerance_days"))


def decay_weights(played: DataFrame, decay_days: float = 365.0) -> DataFrame:
    """exp(-age / decay_days), age from the latest kickoff of all (E13): an e-folding time, not a half-life."""
    newest = played.agg(F.max(F.unix_seconds("kickoff_at")).alias("newest"))  # one row
    age = (F.col("newest") - F.unix_seconds("kickoff_at")) / DAY
    return played.join(F.broadcast(newest)).select("match_id", F.round(F.exp(-age / decay_days), 9).alias("weight"))


def league_baselines(played: DataFrame) -> DataFrame:
    """Mean goals by competition."""
    return played.groupBy("competition_id").agg(F.count(F.lit(1)).alias("matches"), F.round(F.avg("home_goals"), 6).alias("home_mean"), F.round(F.avg("away_goals"), 6).alias("away_mean"))


def unordered_pair_counts(matches: DataFrame) -> DataFrame:
    """The competition that each unordered pair of teams met in most; ties: the smaller one."""
    pairs = matches.groupBy(F.least("home_team_id", "away_team_id").alias("low_team"), F.greatest("home_team_id", "away_team_id").alias("high_team"), "competition_id").agg(F.count(F.lit(1)).alias("n"))
    best = pairs.groupBy("low_team", "high_team").agg(F.max_by(F.struct("competition_id", "n"), F.struct("n", -F.col("competition_id"))).alias("r"))
    return best.select("low_team", "high_team", "r.competition_id", "r.n")


def nearest_fixture(wanted: DataFrame, matches: DataFrame, hours: int = 48) -> DataFrame:
    """For each wanted (request_id, competition, teams, kickoff) the nearest fixture within `hours`; ties: the earlier, then the smaller id."""
    keys = ["competition_id", "home_team_id", "away_team_id"]
    other = matches.select(*keys, F.col("match_id"), F.unix_seconds("kickoff_at").alias("m_at"))
    near = wanted.withColumn("w_at", F.unix_seconds("kickoff_at")).join(other, keys).withColumn("apart", F.abs(F.col("m_at") - F.col("w_at"))).where(F.col("apart") <= hours * 3600)
    best = near.groupBy("request_id").agg(F.min(F.struct("apart", "m_at", "match_id")).alias("r"))
    return best.select("request_id", "r.match_id", F.col("r.apart").alias("seconds_apart"))
