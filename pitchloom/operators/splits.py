"""Team rows that are one club written in two ways (C16), and the audits that stood at a slate's close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of women's sides.
WOMEN = ["femenil", "femenino", "femenina", "women", "womens", "w"]
THIN_MOST, RICH_LEAST, SHORTEST = 10, 30, 3


def leading_words(short: Column, long: Column) -> Column:
    """The short label is a whole leading word sequence of the long one."""
    return (short != "") & (long != "") & (short != long) & long.startswith(F.concat(short, F.lit(" ")))


def abbreviated(a: Column, b: Column) -> Column:
    """As many words, two at least; each pair equal or one (three letters at least) the beginning of the other; one pair equal."""
    pairs = F.arrays_zip(F.split(a, " ").alias("x"), F.split(b, " ").alias("y"))
    short, long = (lambda p: F.when(F.length(p["x"]) <= F.length(p["y"]), p["x"]).otherwise(p["y"])), (lambda p: F.when(F.length(p["x"]) <= F.length(p["y"]), p["y"]).otherwise(p["x"]))
    fits = lambda p: (p["x"] == p["y"]) | ((F.length(short(p)) >= SHORTEST) & long(p).startswith(short(p)))
    same_size = (F.size(F.split(a, " ")) == F.size(F.split(b, " "))) & (F.size(F.split(a, " ")) >= 2)
    return same_size & (a != b) & F.coalesce(F.forall(pairs, fits), F.lit(False)) & F.coalesce(F.exists(pairs, lambda p: p["x"] == p["y"]), F.lit(False))


def womens(label: Column) -> Column:
    return F.arrays_overlap(F.split(label, " "), F.array(*map(F.lit, WOMEN)))


def looks_split(thin: Column, rich: Column) -> Column:
    return (womens(thin) == womens(rich)) & (leading_words(thin, rich) | abbreviated(thin, rich))


def block_keys(label: Column) -> Column:
    """What two labels that look split share at least one of: the first word (a leading word sequence), or a word in its place among as many (an abbreviation)."""
    words = F.split(label, " ")
    placed = F.transform(words, lambda w, i: F.concat_ws("|", F.size(words).cast("string"), i.cast("string"), w))
    return F.array_append(F.when(F.size(words) >= 2, placed).otherwise(F.array().cast("array<string>")), F.concat(F.lit("first|"), words[0]))


def split_candidates(teams: DataFrame, matches: DataFrame, competitions: DataFrame) -> DataFrame:
    """Each thin team (THIN_MOST matches or fewer, one at least) beside the team of RICH_LEAST matches or more of one of its competitions that it looks like a split of: the one with most matches, ties: the smaller id.

    teams: team_id, label (lower case, ASCII, single spaces); matches: match_id, competition_id, home_team_id, away_team_id; competitions: competition_id, name. Teams meet by competition and a block key; no two rows
    that pass the rules are without a common one, so no pair is lost, and only thin rows meet rich ones.
    """
    sides = matches.select("competition_id", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"))
    places = sides.groupBy("team_id", "competition_id").agg(F.count(F.lit(1)).alias("n"))
    counts = places.groupBy("team_id").agg(F.sum("n").alias("n"))
    rows = teams.where("label <> ''").join(counts, "team_id").where((F.col("n") <= THIN_MOST) | (F.col("n") >= RICH_LEAST)).join(places.select("team_id", "competition_id"), "team_id")
    keyed = rows.withColumn("key", F.explode(block_keys(F.col("label"))))
    side = lambda name, test: keyed.where(test).select("competition_id", "key", *(F.col(c).alias(f"{name}_{c}") for c in ("team_id", "label", "n")))
    met = side("thin", F.col("n") <= THIN_MOST).join(side("rich", F.col("n") >= RICH_LEAST), ["competition_id", "key"]).where("thin_team_id <> rich_team_id").drop("key").distinct()
    alike = met.where(looks_split(F.col("thin_label"), F.col("rich_label"))).join(competitions.select("competition_id", "name"), "competition_id")
    pairs = alike.groupBy("thin_team_id", "rich_team_id").agg(F.first("thin_n").alias("thin_matches"), F.first("rich_n").alias("rich_matches"), F.min("name").alias("shared_competition"))
    best = pairs.groupBy("thin_team_id").agg(F.max_by(F.struct("thin_matches", "rich_team_id", "rich_matches", "shared_competition"), F.struct("rich_matches", -F.col("rich_team_id"))).alias("r"))
    return best.select("thin_team_id", "r.*")


def historical_audits(predictions: DataFrame, slates: DataFrame) -> DataFrame:
    """Of each slate and match the newest audit that stood at the cutoff and can be read: raw and decision vectors.

    predictions: prediction_id, slate_id, match_id, composition_hash, generated_at, audit (JSON); slates: slate_id, composition_hash, cutoff. An audit that is no JSON or lacks a vector is passed over and the one before it counts;
    decision vectors come from the decision's, else the display's. Order: generated_at, then id. A slate has one cutoff, so this is a join on the slate, a filter and a maximum, which combines before the shuffle.
    """
    known = slates.where("composition_hash <> '' and cutoff is not null").select("slate_id", "composition_hash", "cutoff")
    rows = predictions.where("audit <> ''").join(known, ["slate_id", "composition_hash"]).where("generated_at <= cutoff")
    text = lambda k: F.get_json_object("audit", f"$.{k}")
    vector = lambda k: F.array(*(text(f"{k}.{s}").try_cast("double") for s in "LEV"))
    filled = lambda x: x.isNotNull() & ~x.isin("", "{}", "null", "false", "0", "[]")  # noqa: E731  what stands for "there is one"
    chosen = F.when(filled(text("decision_probabilities")), vector("decision_probabilities")).otherwise(vector("display_probabilities"))
    rows = rows.select("slate_id", "match_id", "generated_at", "prediction_id", vector("raw_probabilities").alias("raw"), chosen.alias("decision"), text("ticket_strategy").alias("ticket_strategy"))
    whole = lambda c: F.forall(c, lambda x: x.isNotNull())
    newest = rows.where(whole("raw") & whole("decision")).groupBy("slate_id", "match_id").agg(F.max_by(F.struct("prediction_id", "raw", "decision", "ticket_strategy"), F.struct("generated_at", "prediction_id")).alias("r"))
    named = [F.col(f"r.{v}")[k].alias(f"{v}_{s.lower()}") for v in ("raw", "decision") for k, s in enumerate("LEV")]
    return newest.select("slate_id", "match_id", "r.prediction_id", *named, "r.ticket_strategy")
