"""Plans of the watcher: every event is a look at one of twenty guides."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchloom.operators import watch
from pitchloom.sources import derive
from pitchloom.sources.landing import landing
from pitchloom.streaming import watch as stream

from .core import plan

STEP, RUN = 600, 400  # seconds between events, events on one draw

WATCHED = f"""
tk AS (SELECT user_id % 20 AS feed, event_id AS tick_id, event_id * {STEP} AS seen_s, CASE WHEN event_type <> 'error' THEN 'h' || floor(value)::BIGINT % 3 END AS digest, event_id // {RUN} AS n, CASE WHEN event_id % 7 = 0 THEN 0 ELSE 9 END AS fixtures,
  CASE WHEN event_id % 3 = 0 THEN event_id * {STEP} + (event_id % 4 - 1) * 86400 END AS own, CASE WHEN event_id % 6 = 3 THEN 'provisional_ms_pdf_window' ELSE 'official_pdf_close' END AS src, event_id % 2 = 0 AS accepted, event_id % 5 < 3 AS other FROM events),
ov AS (SELECT event_id // {RUN} AS n, event_id * {STEP} AS recorded_s, event_id * {STEP} + event_id % 5 * 40000 AS till FROM events WHERE user_id % 9 = 0), dn AS (SELECT DISTINCT event_id // {RUN} AS n FROM events),
sl AS (SELECT n, n * {RUN * STEP} + n % 5 * 80000 AS kick, CASE WHEN n % 6 = 5 THEN n * {RUN * STEP} + 90000 END AS obs FROM dn WHERE n % 8 <> 7),
mm AS (SELECT *, last_value(digest IGNORE NULLS) OVER (PARTITION BY feed ORDER BY tick_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior, min(seen_s) FILTER (WHERE digest IS NOT NULL) OVER (PARTITION BY feed, n ORDER BY tick_id) AS first_s FROM tk),
mc AS (SELECT *, digest IS NOT NULL AND digest IS DISTINCT FROM prior AS changed FROM mm), oa AS (SELECT tick_id, arg_max(till, recorded_s) AS typed FROM tk JOIN ov USING (n) WHERE recorded_s <= seen_s AND till > seen_s GROUP BY 1),
mo AS (SELECT mc.*, typed, sl.n AS sid, kick, obs, CASE WHEN fixtures >= 9 AND other AND first_s + 432000 > seen_s THEN first_s + 432000 END AS held, max(CASE WHEN changed THEN seen_s END) OVER (PARTITION BY feed ORDER BY tick_id) AS changed_s FROM mc LEFT JOIN oa USING (tick_id) LEFT JOIN sl USING (n)),
mp AS (SELECT *, CASE WHEN own IS NOT NULL AND src LIKE 'off%' THEN own WHEN typed IS NOT NULL THEN typed WHEN own IS NOT NULL THEN own ELSE held END AS close, CASE WHEN own IS NOT NULL AND src LIKE 'off%' THEN src WHEN typed IS NOT NULL THEN 'operator_date_override' WHEN own IS NOT NULL THEN src ELSE 'provisional_ms_pdf_window' END AS how FROM mo),
mr AS (SELECT *, digest IS NOT NULL AND close IS NOT NULL AND close > seen_s AND sid IS NOT NULL AND kick > seen_s AND (obs IS NULL OR obs > seen_s) AS act FROM mp),
dc AS (SELECT feed, tick_id, seen_s, 'MS ' || n AS draw_code, digest, changed_s, CASE WHEN digest IS NULL THEN 'parse_error' WHEN NOT changed THEN 'unchanged' WHEN fixtures = 0 THEN 'parse_error' WHEN own IS NOT NULL AND accepted THEN 'changed_valid' ELSE 'changed_invalid' END AS status, act AS activated,
  CASE WHEN act THEN sid END AS slate_id, CASE WHEN act AND how LIKE 'prov%' THEN least(close, kick) WHEN act THEN close END AS closes_s, CASE WHEN act THEN how END AS close_source FROM mr)
"""


def ticks(spark, sf_dir):
    e, at = F.col("event_id"), F.col("event_id") * STEP
    return derive.table(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).alias("feed"), e.alias("tick_id"), at.alias("seen_s"), F.when(F.col("event_type") != "error", F.concat(F.lit("h"), (F.floor("value").cast("long") % 3).cast("string"))).alias("digest"),
        F.concat(F.lit("MS "), F.expr(f"event_id div {RUN}").cast("string")).alias("draw_code"), F.lit("midweek").alias("week_type"), F.when(e % 7 == 0, 0).otherwise(9).cast("long").alias("fixtures"),
        F.when(e % 3 == 0, at + (e % 4 - 1) * 86400).alias("closes_s"), F.when(e % 6 == 3, watch.PROVISIONAL).alias("close_source"), (e % 2 == 0).alias("accepted"), F.when(e % 5 < 3, "800").alias("rejected_draw"),
    )


def others(spark, sf_dir):
    """Deadlines typed in by operators, and the slates: one of eight draws has none, some have a result before the kickoff."""
    events, draw = derive.table(spark, sf_dir, "events"), F.expr(f"event_id div {RUN}")
    code, at = F.concat(F.lit("PGM-"), draw.cast("string")).alias("draw_code"), F.col("event_id") * STEP
    overrides = events.where("user_id % 9 = 0").select(code, at.alias("recorded_s"), (at + F.col("event_id") % 5 * 40000).alias("closes_s"))
    slates = events.select(draw.alias("slate_id"), code).distinct().where("slate_id % 8 <> 7")
    n = F.col("slate_id")
    return overrides, slates.withColumns({"first_kickoff_s": n * RUN * STEP + n % 5 * 80000, "observed_s": F.when(n % 6 == 5, n * RUN * STEP + 90000)})


@plan("n04_watched_guides", WATCHED.replace("\ntk AS", ".tk AS", 1) + "SELECT * FROM dc")
def watched_guides(spark, sf_dir):
    return watch.decided(watch.remembered(ticks(spark, sf_dir)), *others(spark, sf_dir))


@plan("n04_reopened_slates", WATCHED.replace("\ntk AS", ".tk AS", 1) + "SELECT sl.n AS slate_id, coalesce(arg_max(d.closes_s, d.tick_id), 0) AS closes_s, count(d.tick_id) = 0 AS archived FROM sl LEFT JOIN dc d ON d.slate_id = sl.n AND d.activated GROUP BY 1")
def reopened_slates(spark, sf_dir):
    """The ticks as a stream, with state by feed; then the slates that it opened."""
    source, out = landing(spark, "ticks"), landing(spark, "decisions")
    rows, (overrides, slates) = ticks(spark, sf_dir), others(spark, sf_dir)
    rows.write.parquet(source)
    found = watch.decided(stream.remembered(spark.readStream.schema(rows.schema).parquet(source)), overrides, slates)
    found.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", landing(spark, "watch")).trigger(availableNow=True).start().awaitTermination()
    return watch.reopened(slates.select("slate_id", F.lit(0).cast("long").alias("closes_s"), F.lit(True).alias("archived")), spark.read.parquet(out))
