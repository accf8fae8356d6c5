"""Streams of live observations and slate proposals, with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "status string, minute long, home_goals long, away_goals long, is_final boolean, seen_at long, seen_id long"


def merge(state: tuple | None, row: tuple) -> tuple:
    """The state after an observation (status, minute, home_goals, away_goals, at, id): a final gives way to later finals only; known goals and minutes are not blanked."""
    status, minute, home, away, at, event = row
    final = status == "full_time"
    if state is not None:
        if (at, event) <= (state[5], state[6]) or (state[4] and not final):
            return state
        minute, home, away = (old if new is None else new for new, old in ((minute, state[1]), (home, state[2]), (away, state[3])))
    return (status, minute, home, away, final, at, event)


def live_states(observations: DataFrame) -> DataFrame:
    """A stream of match_id and source_id with their state after each batch of observations (N01). Replays, and rows older than the last one applied, leave it as it is.

    observations: match_id, source_id, event_id, observed_at, status, minute, home_goals, away_goals.
    """
    columns = ["status", "minute", "home_goals", "away_goals", "at", "event_id"]

    def update(key: tuple, tables: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        for table in tables:
            ordered = table.sort_values(["at", "event_id"])[columns].astype(object)
            for row in ordered.where(ordered.notna(), None).to_numpy().tolist():
                now = merge(now, (row[0], *(None if x is None else int(x) for x in row[1:])))
        if now is not None:
            state.update(now)
            yield pd.DataFrame([(*key, *now[:5])], columns=["match_id", "source_id", "status", "minute", "home_goals", "away_goals", "is_final"])

    rows = observations.select("match_id", "source_id", "event_id", F.unix_micros("observed_at").alias("at"), "status", "minute", "home_goals", "away_goals")
    kind = "match_id long, source_id long, status string, minute long, home_goals long, away_goals long, is_final boolean"
    return rows.groupBy("match_id", "source_id").applyInPandasWithState(update, kind, STATE, "update", "NoTimeout")


def proposals(sightings: DataFrame, needed: int = 2) -> DataFrame:
    """A stream of draw_code, signature, sightings, confirmed: a proposal is confirmed by `needed` sightings in a row with one signature; a new one starts over."""

    def update(key: tuple, tables: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        signature, times, at = state.get if state.exists else (None, 0, -1)
        for table in tables:
            for r in table.sort_values("at").itertuples(index=False):
                if r.at > at:
                    times, signature, at = (times + 1 if r.signature == signature else 1), r.signature, int(r.at)
        state.update((signature, times, at))
        yield pd.DataFrame([(key[0], signature, times, times >= needed)], columns=["draw_code", "signature", "sightings", "confirmed"])

    rows = sightings.select("draw_code", "signature", F.unix_micros("observed_at").alias("at"))
    return rows.groupBy("draw_code").applyInPandasWithState(update, "draw_code string, signature string, sightings long, confirmed boolean", "signature string, sightings long, at long", "update", "NoTimeout")


def windowed_counts(observations: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Observations by status and window, with a watermark for late ones."""
    return observations.withWatermark("observed_at", late).groupBy(F.window("observed_at", window), "status").agg(F.count(F.lit(1)).alias("n")).select("window.start", "status", "n")
