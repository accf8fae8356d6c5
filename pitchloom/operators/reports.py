"""Reports over predictions and results: coverage of audits, dataset readiness, segments, observers, calibration bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a learning dataset must have.
LEAST_SLATES, LEAST_MATCHES, MOST_CONFLICTS, LEAST_ROWS = 8, 112, 0.05, 20


def audit_coverage(predictions: DataFrame) -> DataFrame:
    """Per draw: predictions, those with an audit, and whether all, some or none have one."""
    sums = predictions.groupBy("draw_code").agg(F.count(F.lit(1)).alias("predictions"), F.count("audit").alias("with_audit"))
    return sums.select("*", F.when(F.col("with_audit") == 0, "none").when(F.col("with_audit") < F.col("predictions"), "partial").otherwise("all").alias("coverage"))


def latest_ingested(states: DataFrame, slates: DataFrame, sources: list[int], most: int = 5) -> DataFrame:
    """The slates whose results were seen last: rows, finals and time (D18). The limit is the operator's."""
    rows = states.where(F.col("source_id").isin(sources)).join(slates, "match_id")
    sums = rows.groupBy("slate_id").agg(F.count(F.lit(1)).alias("result_rows"), F.count_if("is_final").alias("final_rows"), F.max(F.unix_micros("observed_at")).alias("last_us"))
    return sums.orderBy(F.desc("last_us"), "slate_id").limit(most)


def segments(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Hits and totals of scored positions by each of several columns, nulls as unknown (D20, D13). One pass: rows are expanded to their segments, which combine before the shuffle."""
    parts = F.array(*(F.struct(F.lit(n).alias("segment"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("label")) for n, c in columns.items()))
    each = rows.select("hit", F.explode(parts).alias("s")).select("hit", "s.*")
    return each.groupBy("segment", "label").agg(F.count(F.lit(1)).alias("total"), F.count_if("hit").alias("hits"), F.round(F.count_if("hit") / F.count(F.lit(1)), 4).alias("accuracy"))


def dataset_summary(rows: DataFrame) -> DataFrame:
    """Rows with canonical, sign-only, conflicting and missing results, hit rate and Brier score of those that can be learned from (D11, L13, M12). rows: conflict, code, has_goals, hit, brier."""
    usable = ~F.col("conflict") & F.col("code").isNotNull()
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(usable & F.col("has_goals")).alias("canonical"), F.count_if(usable & ~F.col("has_goals")).alias("sign_only"), F.count_if("conflict").alias("conflicts"), F.count_if(~F.col("conflict") & F.col("code").isNull()).alias("without_result"),
        F.round(F.avg(F.when(usable, F.col("hit").cast("double"))), 4).alias("hit_rate"), F.round(F.avg(F.when(usable, F.col("brier"))), 4).alias("brier"),
    )


def readiness(slates: DataFrame) -> DataFrame:
    """Whether there is enough to learn from, and what is missing (D16, L11). slates: comparable, matches, usable, conflicts a slate."""
    sums = slates.agg(F.count_if("comparable").alias("comparable_slates"), F.coalesce(F.sum(F.when(F.col("comparable"), F.col("usable"))), F.lit(0)).alias("comparable_matches"), F.sum("conflicts").alias("conflicts"), F.sum("matches").alias("matches"))
    ratio = F.coalesce(F.try_divide("conflicts", "matches"), F.lit(0.0))
    missing = {"few_slates": F.col("comparable_slates") < LEAST_SLATES, "few_matches": F.col("comparable_matches") < LEAST_MATCHES, "many_conflicts": ratio > MOST_CONFLICTS, "few_rows": F.col("comparable_matches") < LEAST_ROWS}
    reasons = F.array_join(F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in missing.items()))), ",")
    return sums.select("*", F.round(ratio, 6).alias("conflict_ratio"), reasons.alias("reasons"), (reasons == "").alias("ready"))


def exclusion_reason() -> Column:
    """Why a slate does not count, by precedence (D16). official, predictions, matches, conflicts, results."""
    c = F.col
    return F.when(~c("official"), "not_official").when(c("predictions") == 0, "no_predictions").when(c("conflicts") > 0, "conflicts").when(c("results") < c("matches"), "incomplete_results")


def confidence_bins(rows: DataFrame) -> DataFrame:
    """Per tenth of confidence: matches, mean confidence, hit rate, their difference, Brier score (L04). rows: top, hit, brier of walk-forward predictions in whatever order."""
    low = F.least(F.floor(F.col("top") * 10) / 10, F.lit(0.9))
    sums = rows.groupBy(low.alias("low")).agg(F.count(F.lit(1)).alias("matches"), F.avg("top").alias("conf"), F.avg(F.col("hit").cast("double")).alias("rate"), F.avg("brier").alias("b"))
    return sums.select(F.concat(F.format_number("low", 1), F.lit("-"), F.format_number(F.col("low") + 0.1, 1)).alias("confidence_bin"), "matches", F.round("conf", 4).alias("average_confidence"), F.round("rate", 4).alias("hit_rate"), F.round(F.col("conf") - F.col("rate"), 4).alias("calibration_gap"), F.round("b", 4).alias("brier_score"))


def visible(audit: str, columns: list[str]) -> list[Column]:
    """Home, draw, away as shown: the audit's decision vector, else its display vector, else the columns."""
    vector = lambda k: [F.get_json_object(audit, f"$.{k}.{s}").try_cast("double") for s in "LEV"]
    decided, shown = vector("decision_probabilities"), vector("display_probabilities")
    whole = lambda v: v[0].isNotNull() & v[1].isNotNull() & v[2].isNotNull()
    return [F.when(whole(decided), d).when(whole(shown), s).otherwise(F.col(c)) for d, s, c in zip(decided, shown, columns)]


def raw_vector(audit: str) -> list[Column]:
    """Home, draw, away of the model itself, null unless the audit has all three."""
    v = [F.get_json_object(audit, f"$.raw_probabilities.{s}").try_cast("double") for s in "LEV"]
    return [F.when(v[0].isNotNull() & v[1].isNotNull() & v[2].isNotNull(), x) for x in v]


def ticket_picks(snapshots: DataFrame) -> DataFrame:
    """snapshot_id, match_id, mode, pick_type and picks of a ticket's JSON payload; payloads that cannot be read have none."""
    kind = "struct<recommendations:array<struct<match_id:string,decisions:map<string,struct<pick_type:string,picks:array<string>>>>>>"
    rows = snapshots.select("snapshot_id", F.explode(F.from_json("payload", kind)["recommendations"]).alias("r")).where("r.match_id <> ''")
    modes = rows.select("snapshot_id", "r.match_id", F.explode("r.decisions").alias("mode", "d"))
    return modes.select("snapshot_id", "match_id", "mode", F.coalesce("d.pick_type", F.lit("fixed")).alias("pick_type"), F.array_join(F.coalesce("d.picks", F.array().cast("array<string>")), ",").alias("picks"))


def shrinkage(draw_rate: Column, target: float = 0.22) -> tuple[Column, Column]:
    """Least and greatest share of the draw that a knock-out match moves to the sides, from its league's draw rate."""
    base = F.greatest(F.lit(0.0), 1 - target / draw_rate)
    unknown = draw_rate.isNull() | (draw_rate < 0.05)
    return F.when(unknown, 0.15).otherwise(F.greatest(F.lit(0.10), base * 0.6)), F.when(unknown, 0.55).otherwise(F.least(F.lit(0.90), F.greatest(base * 2, base + 0.20)))


def shrinkage_bands(played: DataFrame, least: int = 30) -> DataFrame:
    """competition_id, shrink_min, shrink_max of every competition (I18); a draw rate from fewer than `least` matches is unknown."""
    rates = played.groupBy("competition_id").agg(F.when(F.count(F.lit(1)) >= least, F.avg((F.col("result_code") == "X").cast("double"))).alias("r"))
    low, high = shrinkage(F.col("r"))
    return rates.select("competition_id", low.alias("shrink_min"), high.alias("shrink_max"))


def candidates(fixtures: DataFrame, since_s: Column, until_s: Column) -> DataFrame:
    """Fixtures of documents within a window, one for each competition and teams (case aside): with a position first, then the smallest position, earliest, by name.

    A fixture without a competition has its document's (document_competition), else "Unknown Competition"; one that is blank beyond that, or lacks a team, is none. Position 0 comes last among positions. Names are trimmed.
    """
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    of_document = [given("document_competition")] if "document_competition" in fixtures.columns else []
    named = {"competition": F.trim(F.coalesce(given("competition"), *of_document, F.lit("Unknown Competition"))), "home": F.trim("home"), "away": F.trim("away")}
    rows = fixtures.withColumns(named).where((F.col("kickoff_s") >= since_s) & (F.col("kickoff_s") <= until_s) & (F.col("home") != "") & (F.col("away") != "") & (F.col("competition") != ""))
    order = F.struct(F.col("position").isNull().alias("none"), F.coalesce(F.nullif("position", F.lit(0)), F.lit(999)).alias("position"), "kickoff_s", "competition", "home", "away", "document_id")
    best = rows.groupBy(*(F.lower(c).alias(c[0]) for c in named)).agg(F.min_by(F.struct("document_id", "competition", "home", "away", "position", "kickoff_s"), order).alias("r"))
    return best.select("r.*")
