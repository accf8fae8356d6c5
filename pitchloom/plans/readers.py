"""Plans of readers and streams: files are written from the tables first, then read back as a feed would be."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchloom.sources import derive, feeds
from pitchloom.sources.landing import landing
from pitchloom.streaming import live

from .core import plan


def named(word, c):
    return F.concat(F.lit(word), F.col(c).cast("string"))


@plan("a01_csv_documents", "SELECT 'Team ' || home_team_id || ', \"first\" - ' || away_team_id AS title, NULL::VARCHAR AS summary, 'u/' || match_id AS url, 'Team ' || home_team_id AS home_team, 'Team ' || away_team_id AS away_team, NULL::VARCHAR AS competition FROM matches")
def csv_documents(spark, sf_dir):
    path = landing(spark, "csv")
    rows = derive.matches(spark, sf_dir).select(F.concat(named("Team ", "home_team_id"), F.lit(', "first" - '), F.col("away_team_id").cast("string")).alias("match"), named("u/", "match_id").alias("url"), named("Team ", "home_team_id").alias("home_team"), named("Team ", "away_team_id").alias("away_team"))
    rows.write.csv(path, header=True, escape='"')
    return feeds.csv_documents(spark, path)


@plan("a02_json_documents", "SELECT n_name AS title, 'nation ' || n_nationkey AS summary, 'u/' || n_nationkey AS url FROM nation")
def json_documents(spark, sf_dir):
    path = landing(spark, "json")
    items = F.collect_list(F.struct(F.col("n_name").alias("title"), named("nation ", "n_nationkey").alias("summary"), named("u/", "n_nationkey").alias("url")))
    derive.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.struct(items.alias("items"))).alias("value")).select("value").repartition(5).write.text(path)
    return feeds.json_documents(spark, path)


@plan("a03_rss_documents", "SELECT p_name AS title, p_brand || ' & ' || p_type AS summary, 'u/' || p_partkey AS url FROM part")
def rss_documents(spark, sf_dir):
    path = landing(spark, "xml")
    rows = derive.table(spark, sf_dir, "part").select(F.col("p_name").alias("title"), F.concat_ws(" & ", "p_brand", "p_type").alias("description"), named("u/", "p_partkey").alias("link"))
    rows.write.format("xml").option("rootTag", "rss").option("rowTag", "item").save(path)
    return feeds.rss_documents(spark, path)


@plan(
    "a12_season_results",
    "SELECT 'L' || competition_id AS competition, 'Team ' || home_team_id AS home_team, 'Team ' || away_team_id AS away_team, CASE WHEN match_id % 20 <> 0 THEN home_goals::INT END AS home_goals, away_goals::INT AS away_goals, CASE WHEN match_id % 9 <> 0 THEN epoch(date_trunc('day', kickoff_at))::BIGINT END AS played_s FROM played",
)
def season_results(spark, sf_dir):
    path = landing(spark, "season")
    m, day = F.col("match_id"), lambda f: F.date_format("kickoff_at", f)
    date = F.when(m % 9 == 0, "").when(m % 3 == 1, day("dd/MM/yyyy")).when(m % 3 == 2, day("yyyy-MM-dd")).otherwise(day("dd/MM/yy"))
    rows = derive.played(spark, sf_dir).select(named("L", "competition_id").alias("Div"), date.alias("Date"), named("Team ", "home_team_id").alias("HomeTeam"), named("Team ", "away_team_id").alias("AwayTeam"), F.when(m % 20 == 0, "x").otherwise(F.col("home_goals").cast("string")).alias("FTHG"), F.col("away_goals").alias("FTAG"))
    rows.write.csv(path, header=True)
    found = feeds.season_results(spark, path)
    return found.withColumn("played_s", F.unix_seconds("played_at")).drop("played_at")


@plan(
    "a10_scoreboard",
    """SELECT 'L' || competition_id AS league, match_id::VARCHAR AS id, CASE WHEN match_id % 4 = 0 THEN 'LIVE' ELSE 'FINISHED' END AS status, 'Team ' || home_team_id AS home_team, 'Team ' || away_team_id AS away_team, CASE WHEN match_id % 4 <> 0 THEN home_goals::INT END AS home_goals,
CASE WHEN match_id % 4 <> 0 THEN away_goals::INT END AS away_goals FROM played WHERE match_id % 25 <> 0""",
)
def scoreboard(spark, sf_dir):
    m = F.col("match_id")
    side = lambda kind: F.struct(F.lit(kind).alias("homeAway"), F.when((m % 25 != 0) | (F.lit(kind) == "home"), named("Team ", f"{kind}_team_id")).alias("team"), F.col(f"{kind}_goals").cast("string").alias("score"))
    events = derive.played(spark, sf_dir).select(named("L", "competition_id").alias("league"), m.cast("string").alias("id"), F.when(m % 4 == 0, "LIVE").otherwise("FINISHED").alias("status"), F.col("kickoff_at").cast("string").alias("date"), F.array(side("away"), side("home")).alias("competitors"))
    return feeds.scoreboard_fixtures(events.unionByName(events.where("cast(id as long) % 7 = 0"))).drop("kickoff_at")


GUIDE = "CONCURSO "


@plan(
    "a06_guides",
    """.
gd AS (SELECT match_id // 14 AS slate_id, match_id % 14 + 1 AS position, home_team_id, away_team_id FROM matches), gn AS (SELECT *, slate_id % 5 = 0 AND position > 9 AS after FROM gd)
SELECT slate_id, slate_id::VARCHAR AS draw_code, position::INT AS position, 'TEAM ' || home_team_id AS home, 'TEAM ' || away_team_id AS away FROM gn WHERE NOT after""",
)
def guides(spark, sf_dir):
    """A guide's text for each slate; in every fifth one the positions fall back after the ninth, where reading stops."""
    p = F.col("position")
    rows = derive.matches(spark, sf_dir).select(F.expr("match_id div 14").alias("slate_id"), (F.col("match_id") % 14 + 1).alias("position"), "home_team_id", "away_team_id")
    shown = F.when((F.col("slate_id") % 5 == 0) & (p > 9), p - 9).otherwise(p)
    line = F.concat(named("TEAM ", "home_team_id"), F.lit(" VS\nCASILLERO "), shown.cast("string"), named("\nTEAM ", "away_team_id"))
    texts = rows.groupBy("slate_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    texts = texts.select("slate_id", F.concat(F.lit("GUIA\nCONCURSO "), F.col("slate_id").cast("string"), F.lit("\n"), "body").alias("text"))
    found = texts.select("slate_id", feeds.draw_code(F.col("text")).alias("draw_code"), F.explode(feeds.guide_fixtures(F.col("text"))).alias("f"))
    return found.select("slate_id", "draw_code", "f.*")


@plan(
    "b01_parsed_feeds",
    """.
pf AS (SELECT m.match_id // 14 AS slate_id, m.match_id, home_goals FROM matches m LEFT JOIN played p ON p.match_id = m.match_id)
SELECT 'slate ' || slate_id AS title, count(*) AS fixtures, count(home_goals) FILTER (WHERE match_id % 6 <> 0) AS results FROM pf GROUP BY slate_id""",
)
def parsed_feeds(spark, sf_dir):
    rows = derive.matches(spark, sf_dir).join(derive.played(spark, sf_dir).select("match_id", "home_goals", "away_goals"), "match_id", "left")
    fixture = F.struct("match_id", F.when(F.col("match_id") % 6 != 0, F.col("home_goals")).alias("home_goals"), "away_goals")
    documents = rows.groupBy(F.expr("match_id div 14").alias("slate_id")).agg(F.collect_list(fixture).alias("fixtures")).select(named("slate ", "slate_id").alias("title"), F.lit("u").alias("url"), "fixtures")
    return feeds.parsed(documents).select("title", F.size("fixture_candidates").cast("long").alias("fixtures"), F.size("historical_results").cast("long").alias("results"))


@plan(
    "n03_proposal_sightings",
    """.
sg AS (SELECT (user_id % 40)::VARCHAR AS draw_code, event_type AS signature, event_id FROM events),
sh AS (SELECT *, CASE WHEN lag(signature) OVER w = signature THEN 0 ELSE 1 END AS new FROM sg WINDOW w AS (PARTITION BY draw_code ORDER BY event_id)), si AS (SELECT *, sum(new) OVER (PARTITION BY draw_code ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM sh)
SELECT draw_code, signature, count(*) AS sightings, count(*) >= 2 AS confirmed FROM si GROUP BY draw_code, signature, run QUALIFY row_number() OVER (PARTITION BY draw_code ORDER BY run DESC) = 1""",
)
def proposal_sightings(spark, sf_dir):
    """The state of every draw after a stream of sightings (all that is there, then it stops)."""
    source, out = landing(spark, "sightings"), landing(spark, "proposals")
    events = derive.table(spark, sf_dir, "events").select((F.col("user_id") % 40).cast("string").alias("draw_code"), F.col("event_type").alias("signature"), F.timestamp_seconds("event_id").alias("observed_at"))
    events.write.parquet(source)
    found = live.proposals(spark.readStream.schema(events.schema).parquet(source))
    keep = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)
    found.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", landing(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out)
    return rows.groupBy("draw_code").agg(F.max_by(F.struct("signature", "sightings", "confirmed"), "batch").alias("r")).select("draw_code", "r.*")


@plan("n01_windowed_counts", "SELECT epoch(time_bucket(INTERVAL '1 hour', observed_at))::BIGINT AS start_s, status, count(*) AS n FROM live GROUP BY 1, 2")
def windowed_counts(spark, sf_dir):
    found = live.windowed_counts(derive.live(spark, sf_dir), window="1 hour")
    return found.select(F.unix_seconds("start").alias("start_s"), "status", "n")
