"""A watched guide: whether it changed, when its slate closes, and which slates that opens. Times are seconds since 1970.

Ticks: feed, tick_id, seen_s, digest (null: the guide could not be read), draw_code, week_type, fixtures, closes_s, close_source (null: the guide itself), accepted (the deadline belongs to this draw), rejected_draw (the draw it belongs to instead).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Sources of a deadline from the strongest on, positions of a midweek slate, days that a guide without a deadline of its own is held open.
OFFICIAL, OPERATOR, PROVISIONAL = "official_pdf_close", "operator_date_override", "provisional_ms_pdf_window"
MIDWEEK, DAYS = 9, 5


def number(draw_code: Column) -> Column:
    """The digits a draw's code ends with; guides, operators and slates write different letters before them."""
    return F.nullif(F.regexp_extract(draw_code, r"(\d+)$", 1), F.lit(""))


def remembered(ticks: DataFrame) -> DataFrame:
    """ticks with what the watcher remembers of the earlier ones of their feed: changed, changed_s (of the last change) and first_s (when the draw was first seen). `streaming.watch` holds the same as keyed state. A feed is one task's time."""
    order = ["seen_s", "tick_id"]
    before, upto = (W.partitionBy("feed").orderBy(*order).rowsBetween(W.unboundedPreceding, end) for end in (-1, 0))
    rows = ticks.withColumn("changed", F.col("digest").isNotNull() & ~F.col("digest").eqNullSafe(F.last("digest", ignorenulls=True).over(before)))
    first = F.min(F.when(F.col("digest").isNotNull(), F.col("seen_s"))).over(W.partitionBy("feed", "draw_code").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumns({"changed_s": F.last(F.when(F.col("changed"), F.col("seen_s")), ignorenulls=True).over(upto), "first_s": first})


def decided(ticks: DataFrame, overrides: DataFrame, slates: DataFrame) -> DataFrame:
    """What each remembered tick means (N04): status, and the slate it opens with its deadline and the deadline's source.

    A deadline of the guide that belongs to its draw stands; else an operator's, the latest one recorded by then that is still ahead; else, for a midweek guide with another draw's deadline, some days from when it was first seen, but never past the
    first kickoff. A slate that has started, by a kickoff or a result, is left alone. Both joins are equi-joins on the draw's number, so ticks may be a stream. overrides: draw_code, recorded_s, closes_s. slates: slate_id, draw_code, first_kickoff_s, observed_s.
    """
    typed = overrides.where("closes_s is not null").groupBy(number(F.col("draw_code")).alias("__n")).agg(F.sort_array(F.collect_list(F.struct("recorded_s", F.col("closes_s").alias("at"))), asc=False).alias("__typed"))
    known = slates.groupBy(number(F.col("draw_code")).alias("__n")).agg(F.min_by(F.struct("slate_id", "first_kickoff_s", "observed_s"), "slate_id").alias("__slate"))
    rows = ticks.withColumn("__n", number(F.col("draw_code"))).join(typed, "__n", "left").join(known, "__n", "left")
    now, read = F.col("seen_s"), F.col("digest").isNotNull()
    full = F.coalesce(F.col("fixtures"), F.lit(0))
    status = (
        F.when(~read, "parse_error").when(~F.col("changed"), "unchanged").when(full == 0, "parse_error").when(F.col("closes_s").isNotNull() & F.coalesce("accepted", F.lit(False)), "changed_valid").otherwise("changed_invalid")
    )
    own_source = F.coalesce("close_source", F.lit(OFFICIAL))
    override = F.get(F.filter("__typed", lambda x: (x["recorded_s"] <= now) & (x["at"] > now)), 0)["at"]
    open_until = F.col("first_s") + DAYS * 86400
    held = F.when((F.col("week_type") == "midweek") & (full >= MIDWEEK) & F.col("rejected_draw").isNotNull() & (open_until > now), open_until)
    by_hand = (F.col("closes_s").isNull() | (own_source != OFFICIAL)) & override.isNotNull()
    close = F.when(by_hand, override).otherwise(F.coalesce("closes_s", held))
    source = F.when(by_hand, OPERATOR).when(F.col("closes_s").isNull() & held.isNotNull(), PROVISIONAL).otherwise(own_source)
    slate = F.col("__slate")
    started = F.coalesce(slate["first_kickoff_s"] <= now, F.lit(False)) | F.coalesce(slate["observed_s"] <= now, F.lit(False))
    opens = read & F.coalesce(close > now, F.lit(False)) & slate.isNotNull() & ~started
    ends = F.when(source == PROVISIONAL, F.least(close, slate["first_kickoff_s"])).otherwise(close)
    return rows.select(
        "feed", "tick_id", "seen_s", "draw_code", "digest", "changed_s", status.alias("status"), opens.alias("activated"), F.when(opens, slate["slate_id"]).alias("slate_id"), F.when(opens, ends).alias("closes_s"), F.when(opens, source).alias("close_source"),
    )


def reopened(slates: DataFrame, decisions: DataFrame) -> DataFrame:
    """slates (slate_id, closes_s, archived) after the decisions: the last tick that opened a slate sets its deadline, and it is no longer archived."""
    last = decisions.where("activated").groupBy("slate_id").agg(F.max_by("closes_s", F.struct("seen_s", "feed", "tick_id")).alias("__closes"))
    rows = slates.join(last, "slate_id", "left")
    return rows.withColumns({"closes_s": F.coalesce("__closes", "closes_s"), "archived": F.col("archived") & F.col("__closes").isNull()}).select(*slates.columns)
