"""Fixture, result, slate, prediction and live tables derived from the driver's star schema, as DataFrames and as SQL.

The same derivation is written once for Spark and once as SQL CTEs, so that each plan can be compared with its SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sources of results: a smaller priority number is better.
PRIORITY = {1: 10, 2: 50}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table, hinted for sort-merge joins: sizes that are guessed from a few compressed columns would let joins collect millions of rows on the driver to broadcast them. A nearer hint (F.broadcast) still wins."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").hint("merge")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, competition_id, home_team_id, away_team_id, kickoff_at: one fixture an order, ten teams a competition."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    league = F.expr("o_custkey div 10")
    return orders.select(
        F.col("o_orderkey").alias("match_id"),
        league.alias("competition_id"),
        F.col("o_custkey").alias("home_team_id"),
        (league * 10 + (F.col("o_custkey") % 10 + 1 + F.col("o_orderkey") % 9) % 10).alias("away_team_id"),
        F.col("o_orderdate").cast("timestamp").alias("kickoff_at"),
    )


def result_code(home: str = "home_goals", away: str = "away_goals"):
    """'1', 'X' or '2'; null if either side's goals are unknown."""
    h, a = F.col(home), F.col(away)
    return F.when(h > a, "1").when(h == a, "X").when(h < a, "2")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, source_id, priority, home_goals, away_goals, result_code. Source 2 repeats every third match, every thirtieth with swapped goals."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount")
    goals = lines.groupBy(F.col("l_orderkey").alias("match_id")).agg(
        F.least(F.count_if(F.col("l_quantity") >= 25), F.lit(6)).cast("long").alias("home_goals"),
        F.least(F.count_if((F.col("l_quantity") < 25) & (F.col("l_discount") < 0.07)), F.lit(6)).cast("long").alias("away_goals"),
    )
    swapped = F.col("match_id") % 30 == 0
    one, two = (F.lit(k).cast("long") for k in (1, 2))
    both = goals.select("*", F.explode(F.when(F.col("match_id") % 3 == 0, F.array(one, two)).otherwise(F.array(one))).alias("source_id"))
    turned = swapped & (F.col("source_id") == 2)
    both = both.select(
        "match_id",
        "source_id",
        F.when(F.col("source_id") == 1, PRIORITY[1]).otherwise(PRIORITY[2]).cast("long").alias("priority"),
        F.when(turned, F.col("away_goals")).otherwise(F.col("home_goals")).alias("home_goals"),
        F.when(turned, F.col("home_goals")).otherwise(F.col("away_goals")).alias("away_goals"),
    )
    return both.withColumn("result_code", result_code())


def played(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with source 1's result: the table that features and ratings are built on."""
    first = results(spark, sf_dir).where("source_id = 1").drop("source_id", "priority")
    return matches(spark, sf_dir).join(first, "match_id")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, version, slate_id, position, p_home, p_draw, p_away: two versions a match; version 1 is the later one."""
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match_id"))
    k = F.col("match_id") + F.col("version")
    rows = ids.select("match_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("version"))
    rows = rows.select("*", (4 + k * 7 % 11).alias("h"), (3 + k * 5 % 7).alias("d"), (2 + k * 3 % 9).alias("a"))
    total = F.col("h") + F.col("d") + F.col("a")
    return rows.select(
        "match_id", "version", F.expr("match_id div 14").alias("slate_id"), (F.col("match_id") % 14 + 1).alias("position"),
        *((F.col(x) / total).alias(n) for x, n in (("h", "p_home"), ("d", "p_draw"), ("a", "p_away"))),
    )


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, match_id, source_id, observed_at, status, minute, home_goals, away_goals: one observation an event, about twenty matches' worth of orders a match. Some goals are unknown."""
    folded = table(spark, sf_dir, "orders").agg((F.expr("count(*) div 20") + 1).alias("n"))  # one row
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value").join(F.broadcast(folded))
    status = F.when(F.col("event_type") == "purchase", "full_time").when(F.col("event_type") == "signup", "scheduled").when(F.col("event_type") == "error", "postponed").otherwise("live")
    minute = F.floor("value").cast("long") % 90
    return events.select(
        "event_id", (F.col("event_id") % F.col("n")).alias("match_id"), (F.expr("event_id div 7") % 2 + 1).alias("source_id"), F.col("ts").cast("timestamp").alias("observed_at"), status.alias("status"), minute.alias("minute"),
        F.when(F.col("event_id") % 5 != 0, minute % 4).alias("home_goals"), F.when(F.col("event_id") % 6 != 0, F.floor("value").cast("long") % 3).alias("away_goals"),
    )


SQL = """
matches AS (SELECT o_orderkey AS match_id, o_custkey // 10 AS competition_id, o_custkey AS home_team_id,
  (o_custkey // 10) * 10 + (o_custkey % 10 + 1 + o_orderkey % 9) % 10 AS away_team_id, o_orderdate AS kickoff_at FROM orders),
goals AS (SELECT l_orderkey AS match_id, least(count(*) FILTER (WHERE l_quantity >= 25), 6)::BIGINT AS h,
  least(count(*) FILTER (WHERE l_quantity < 25 AND l_discount < 0.07), 6)::BIGINT AS a FROM lineitem GROUP BY 1),
results AS (SELECT match_id, source_id, priority, home_goals, away_goals, CASE WHEN home_goals > away_goals THEN '1' WHEN home_goals = away_goals THEN 'X' ELSE '2' END AS result_code FROM (
  SELECT match_id, 1::BIGINT AS source_id, 10::BIGINT AS priority, h AS home_goals, a AS away_goals FROM goals UNION ALL
  SELECT match_id, 2, 50, CASE WHEN match_id % 30 = 0 THEN a ELSE h END, CASE WHEN match_id % 30 = 0 THEN h ELSE a END FROM goals WHERE match_id % 3 = 0)),
played AS (SELECT m.*, r.home_goals, r.away_goals, r.result_code FROM matches m JOIN results r ON r.match_id = m.match_id AND r.source_id = 1),
predictions AS (SELECT match_id, version, match_id // 14 AS slate_id, match_id % 14 + 1 AS position, h / (h + d + a) AS p_home, d / (h + d + a) AS p_draw, a / (h + d + a) AS p_away FROM (
  SELECT o_orderkey AS match_id, v AS version, 4 + (o_orderkey + v) * 7 % 11 AS h, 3 + (o_orderkey + v) * 5 % 7 AS d, 2 + (o_orderkey + v) * 3 % 9 AS a FROM orders, (VALUES (0::BIGINT), (1::BIGINT)) x(v))),
live AS (SELECT event_id, event_id % ((SELECT count(*) FROM orders) // 20 + 1) AS match_id, event_id // 7 % 2 + 1 AS source_id, ts AS observed_at, CASE event_type WHEN 'purchase' THEN 'full_time' WHEN 'signup' THEN 'scheduled' WHEN 'error' THEN 'postponed' ELSE 'live' END AS status,
  floor(value)::BIGINT % 90 AS minute, CASE WHEN event_id % 5 <> 0 THEN floor(value)::BIGINT % 90 % 4 END AS home_goals, CASE WHEN event_id % 6 <> 0 THEN floor(value)::BIGINT % 3 END AS away_goals FROM events)
"""
