"""Results: canonical choice among sources, conflicts, latest rows, live merging and near-duplicate fixtures."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def canonical(results: DataFrame) -> DataFrame:
    """Of each match whose sources agree on the result code, the row of the best source (C17). Ties: the smaller source_id. One shuffle."""
    row = F.struct("priority", "source_id", "home_goals", "away_goals", "result_code")
    best = results.groupBy("match_id").agg(F.min(row).alias("r"), F.min("result_code").alias("low"), F.max("result_code").alias("high"))
    return best.where(F.col("low").eqNullSafe(F.col("high"))).select("match_id", "r.source_id", "r.home_goals", "r.away_goals", "r.result_code")


def with_conflicts(results: DataFrame) -> DataFrame:
    """The best source's row of every match, and whether its sources disagree on the result code (C25). Different scores alone are no conflict."""
    row = F.struct("priority", "source_id", "home_goals", "away_goals", "result_code")
    best = results.groupBy("match_id").agg(F.min(row).alias("r"), (F.min("result_code") != F.max("result_code")).alias("is_conflicting"), F.count(F.lit(1)).alias("sources"))
    return best.select("match_id", "r.source_id", "r.home_goals", "r.away_goals", "r.result_code", F.coalesce("is_conflicting", F.lit(False)).alias("is_conflicting"), "sources")


def conflicts(results: DataFrame) -> DataFrame:
    """match_id of matches with two result codes or more."""
    return results.groupBy("match_id").agg(F.min("result_code").alias("low"), F.max("result_code").alias("high")).where("low <> high").select("match_id")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the greatest `order` (E08, E10, D-latest): an aggregate rather than a window, so that keys combine before the shuffle."""
    others = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r"))
    return best.select(*key, *(F.col(f"r.{c}").alias(c) for c in others))


LIVE = ["match_id", "source_id"]


def accepted(observations: DataFrame) -> DataFrame:
    """Observations that change the state of their match and source: all finals, and others before the first final."""
    final, at = F.col("status") == "full_time", F.struct("observed_at", "event_id")
    first = F.min(F.when(final, at)).over(W.partitionBy(*LIVE))
    return observations.withColumn("is_final", final).withColumn("first_final", first).where(F.col("is_final") | F.col("first_final").isNull() | (at < F.col("first_final"))).drop("first_final")


def live_state(observations: DataFrame) -> DataFrame:
    """What the observations of a match by a source leave behind (N01 as a batch): a final is replaced by later finals only, and known goals and minutes are not blanked."""
    at = F.struct("observed_at", "event_id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    state = accepted(observations).groupBy(*LIVE).agg(*(last(c) for c in ("status", "minute", "home_goals", "away_goals")), F.max("is_final").alias("is_final"), F.max("observed_at").alias("observed_at"))
    h, a = F.col("home_goals"), F.col("away_goals")
    return state.withColumn("result_code", F.when(h > a, "1").when(h == a, "X").when(h < a, "2"))


def promoted(observations: DataFrame) -> DataFrame:
    """Finals with both goals known, as they stood at each final observation: results by match, source and time (N02). Two at one time: the later one."""
    before = W.partitionBy(*LIVE).orderBy("observed_at", "event_id")
    known = accepted(observations).select(*LIVE, "event_id", F.col("observed_at").alias("played_at"), "is_final", *(F.last(c, ignorenulls=True).over(before).alias(c) for c in ("home_goals", "away_goals")))
    complete = known.where("is_final and home_goals is not null and away_goals is not null").drop("is_final")
    return latest(complete, [*LIVE, "played_at"], ["event_id"]).drop("event_id")


def best_live(states: DataFrame) -> DataFrame:
    """Each match's state by its best source: the smallest source_id."""
    others = [c for c in states.columns if c != "match_id"]
    best = states.groupBy("match_id").agg(F.min_by(F.struct(*others), "source_id").alias("r"))
    return best.select("match_id", *(F.col(f"r.{c}").alias(c) for c in others))


def merged_status(canonical_rows: DataFrame, live_rows: DataFrame) -> DataFrame:
    """Canonical finals before live rows, by a full join."""
    c = canonical_rows.select("match_id", F.col("home_goals").alias("ch"), F.col("away_goals").alias("ca"), F.lit("full_time").alias("cs"))
    v = live_rows.select("match_id", F.col("home_goals").alias("lh"), F.col("away_goals").alias("la"), F.col("status").alias("ls"))
    both = c.join(v, "match_id", "full")
    known = F.col("cs").isNotNull()
    pick = lambda x, y: F.when(known, F.col(x)).otherwise(F.col(y))
    return both.select("match_id", F.coalesce("cs", "ls").alias("status"), pick("ch", "lh").alias("home_goals"), pick("ca", "la").alias("away_goals"), F.when(known, "canonical").otherwise("live").alias("origin"))


def without_repeats(played: DataFrame, hours: int = 48) -> DataFrame:
    """Greedy removal of repeats (G01): newest first, a row goes if a kept row of the same competition, teams and score lies within `hours`.

    Rows of one fixture and score pass through one task in order (sorted outside Python, in batches). The nearest kept row is the last one kept, so no other is held.
    """
    key = ["competition_id", "home_team_id", "away_team_id", "home_goals", "away_goals"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = None, None
        for batch in batches:
            keep = []
            for *own, at in zip(*(batch.column(c).to_pylist() for c in (*key, "at")), strict=True):
                if own != current:
                    current, last = own, None
                keep.append(last is None or last - at > hours * 3600)
                last = at if keep[-1] else last
            yield batch.select(["match_id", *key]).filter(pa.array(keep, pa.bool_()))

    rows = played.select("match_id", *key, F.unix_seconds("kickoff_at").alias("at"))
    ordered = rows.repartition(*key).sortWithinPartitions(*key, F.desc("at"), F.desc("match_id"))
    return ordered.mapInArrow(run, rows.drop("at").schema)


def scored_slates(predictions: DataFrame, canonical_rows: DataFrame) -> DataFrame:
    """Per slate: predicted and scored positions, hits, both hit rates, top-2 hits, Brier score and log-loss.

    The argmax prefers home, then away, then draw. simple_hit_rate divides by results, hit_rate by scored positions.
    """
    joined = predictions.join(canonical_rows.select("match_id", "result_code"), "match_id", "left")
    p = {"1": F.col("p_home"), "X": F.col("p_draw"), "2": F.col("p_away")}
    top = F.greatest(*p.values())
    pick = F.when(p["1"] == top, "1").when(p["2"] == top, "2").otherwise("X")
    has = F.col("result_code").isNotNull()
    own = F.when(F.col("result_code") == "1", p["1"]).when(F.col("result_code") == "X", p["X"]).otherwise(p["2"])
    brier = sum((x - F.when(F.col("result_code") == k, 1.0).otherwise(0.0)) ** 2 for k, x in p.items())
    better = sum((x > own).cast("int") for x in p.values())
    rows = joined.select("slate_id", has.alias("has"), (pick == F.col("result_code")).alias("hit"), F.when(has, brier).alias("brier"), F.when(has, -F.log(F.least(F.greatest(own, F.lit(1e-6)), F.lit(1 - 1e-6)))).alias("loss"), (has & (better <= 1)).alias("top2"))
    return rows.groupBy("slate_id").agg(
        F.count(F.lit(1)).alias("predicted"), F.count_if("has").alias("scored"), F.count_if("hit").alias("hits"), F.count_if("top2").alias("top2_hits"),
        F.round(F.avg("brier"), 6).alias("brier"), F.round(F.avg("loss"), 6).alias("log_loss"),
    ).withColumn("hit_rate", F.round(F.try_divide("hits", "scored"), 6))


def gap_batches(rows: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Numbers the batches of each key: a new one starts where the gap to the row before is over `seconds`."""
    w = W.partitionBy(key).orderBy(at, "event_id")
    gap = F.unix_micros(at) - F.unix_micros(F.lag(at).over(w))
    marked = rows.withColumn("new", F.coalesce((gap > seconds * 1_000_000).cast("long"), F.lit(1).cast("long")))
    return marked.withColumn("batch", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("new")
