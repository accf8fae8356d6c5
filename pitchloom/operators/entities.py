"""Finding teams, competitions and fixtures by name. Lookups are equi-joins; a choice among hits is an aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR = 3600


def by_alias(wanted: DataFrame, things: DataFrame, aliases: DataFrame, thing: str) -> DataFrame:
    """For each wanted (request_id, name, normalized) the team or competition with this name or alias: real ones first, then alias hits, then by name, then by id.

    The two ways to match are two joins rather than one with "or", which would be a nested loop. things: <thing>, name, is_placeholder; aliases: <thing>, normalized_alias.
    """
    own = things.select(thing, F.col("name").alias("own_name"), "is_placeholder")
    named = wanted.join(own, wanted["name"] == own["own_name"]).select("request_id", thing, "own_name", "is_placeholder", F.lit(1).alias("by_name"))
    known = aliases.join(own, thing)
    called = wanted.join(known, wanted["normalized"] == known["normalized_alias"]).select("request_id", thing, "own_name", "is_placeholder", F.lit(0).alias("by_name"))
    order = F.struct("is_placeholder", "by_name", "own_name", thing)
    return named.unionByName(called).groupBy("request_id").agg(F.min_by(thing, order).alias(thing))


def same_identity(wanted: DataFrame, matches: DataFrame) -> DataFrame:
    """request_id and match_id with equal competition, teams and kickoff."""
    return wanted.join(matches.select("match_id", "competition_id", "home_team_id", "away_team_id", "kickoff_at"), ["competition_id", "home_team_id", "away_team_id", "kickoff_at"]).select("request_id", "match_id")


def upcoming(wanted: DataFrame, matches: DataFrame) -> DataFrame:
    """For each wanted (request_id, teams, from_s, to_s) the earliest real fixture of the two teams within the window, both ends included."""
    real = matches.where("not is_placeholder").select("match_id", "home_team_id", "away_team_id", F.unix_seconds("kickoff_at").alias("k"))
    within = wanted.join(real, ["home_team_id", "away_team_id"]).where("k >= from_s and k <= to_s")
    return within.groupBy("request_id").agg(F.min_by("match_id", F.struct("k", "match_id")).alias("match_id"))


def resolved_pairs(wanted: DataFrame, teams: DataFrame, aliases: DataFrame, matches: DataFrame) -> DataFrame:
    """For each wanted (request_id, home_name, home_normalized, away_name, away_normalized, closes_s) the fixture from 12 hours before the deadline to 96 hours after it."""
    ids = both_sides(wanted, teams, aliases)
    window = ids.where("home_team_id is not null and away_team_id is not null").withColumns({"from_s": F.col("closes_s") - 12 * HOUR, "to_s": F.col("closes_s") + 96 * HOUR})
    return upcoming(window.select("request_id", "home_team_id", "away_team_id", "from_s", "to_s"), matches)


def both_sides(wanted: DataFrame, teams: DataFrame, aliases: DataFrame) -> DataFrame:
    """wanted with home_team_id and away_team_id, null where a name is not known."""
    out = wanted
    for side in ("home", "away"):
        asked = wanted.select("request_id", F.col(f"{side}_name").alias("name"), F.col(f"{side}_normalized").alias("normalized"))
        out = out.join(by_alias(asked, teams, aliases, "team_id").withColumnRenamed("team_id", f"{side}_team_id"), "request_id", "left")
    return out


def team_competitions(matches: DataFrame) -> DataFrame:
    """team_id, competition_id, n: real fixtures of each team by competition."""
    sides = matches.where("not is_placeholder").select("competition_id", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"))
    return sides.groupBy("team_id", "competition_id").agg(F.count(F.lit(1)).alias("n"))


def top(rows: DataFrame, key: list[str]) -> DataFrame:
    """The competition with most fixtures; ties: the smaller id."""
    return rows.groupBy(*key).agg(F.max_by("competition_id", F.struct("n", -F.col("competition_id"))).alias("competition_id"))


def pair_competition(matches: DataFrame) -> DataFrame:
    """low, high (team ids) and the competition in which the two met most."""
    low, high = F.least("home_team_id", "away_team_id").alias("low"), F.greatest("home_team_id", "away_team_id").alias("high")
    return top(matches.where("not is_placeholder").groupBy(low, high, "competition_id").agg(F.count(F.lit(1)).alias("n")), ["low", "high"])


def shared_competition(pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """For each pair (request_id, home_team_id, away_team_id) the competition that both have played in, with most fixtures of either; a fixture between the two counts once."""
    counts = team_competitions(matches)
    side = lambda name: counts.select(F.col("team_id").alias(f"{name}_team_id"), "competition_id", F.col("n").alias(f"n_{name}"))
    both = pairs.select("request_id", "home_team_id", "away_team_id").join(side("home"), "home_team_id").join(side("away"), ["away_team_id", "competition_id"])
    met = matches.where("not is_placeholder").groupBy(F.least("home_team_id", "away_team_id").alias("low"), F.greatest("home_team_id", "away_team_id").alias("high"), "competition_id").agg(F.count(F.lit(1)).alias("met"))
    own = both.select("*", F.least("home_team_id", "away_team_id").alias("low"), F.greatest("home_team_id", "away_team_id").alias("high")).join(met, ["low", "high", "competition_id"], "left")
    return top(own.withColumn("n", F.col("n_home") + F.col("n_away") - F.coalesce("met", F.lit(0))), ["request_id"])


def inferred_competition(ids: DataFrame, matches: DataFrame) -> DataFrame:
    """The competition that a pair most likely plays in: where the two met, else where both play; one team's own only if the other is unknown (C23). ids: request_id, home_team_id, away_team_id (null: unknown)."""
    known = ids.where("home_team_id is not null and away_team_id is not null")
    met = known.select("request_id", F.least("home_team_id", "away_team_id").alias("low"), F.greatest("home_team_id", "away_team_id").alias("high")).join(pair_competition(matches), ["low", "high"]).select("request_id", F.col("competition_id").alias("met"))
    both = shared_competition(known, matches).withColumnRenamed("competition_id", "both")
    lone = ids.where("home_team_id is null or away_team_id is null").select("request_id", F.coalesce("home_team_id", "away_team_id").alias("team_id"))
    single = lone.join(top(team_competitions(matches), ["team_id"]), "team_id").select("request_id", F.col("competition_id").alias("single"))
    out = ids.select("request_id").join(met, "request_id", "left").join(both, "request_id", "left").join(single, "request_id", "left")
    return out.select("request_id", F.coalesce("met", "both", "single").alias("competition_id"))


def new_things(wanted: DataFrame, things: DataFrame, aliases: DataFrame, thing: str) -> DataFrame:
    """Names that nothing is known by, once each: what a get-or-create would create."""
    found = by_alias(wanted, things, aliases, thing)
    return wanted.join(found, "request_id", "left_anti").groupBy("normalized").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("requests"))


def promoted_flags(asked: DataFrame, things: DataFrame, thing: str) -> DataFrame:
    """is_placeholder of known things after requests (thing, is_placeholder): one request for a real one makes it real, none makes it a placeholder again."""
    real = asked.groupBy(thing).agg(F.min("is_placeholder").alias("asked"))
    return things.join(real, thing, "left").select(thing, (F.col("is_placeholder") & F.coalesce("asked", F.lit(True))).alias("is_placeholder"))


def shares_prefix(a: Column, b: Column, n: int = 4) -> Column:
    """One name begins with the other's first n characters; nothing shares with an empty one."""
    return (a != "") & (b != "") & (a.startswith(F.substring(b, 1, n)) | b.startswith(F.substring(a, 1, n)))
