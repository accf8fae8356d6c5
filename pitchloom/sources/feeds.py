"""Readers of feed files and their projection to documents and fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def csv_documents(spark: SparkSession, path: str) -> DataFrame:
    """One document a row; alternative headers are tried in order."""
    rows = spark.read.csv(path, header=True, escape='"')
    pick = lambda *names: F.coalesce(*(F.col(n) for n in names if n in rows.columns), F.lit(None).cast("string"))
    return rows.select(pick("title", "match").alias("title"), pick("summary").alias("summary"), pick("url").alias("url"), pick("home_team").alias("home_team"), pick("away_team").alias("away_team"), pick("competition").alias("competition"))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """A list of documents, or an object with `items`."""
    raw = spark.read.schema("items array<struct<title: string, summary: string, url: string>>, title string, summary string, url string").json(path, multiLine=True)
    items = F.when(F.col("items").isNotNull(), F.col("items")).otherwise(F.array(F.struct("title", "summary", "url")))
    return raw.select(F.explode(items).alias("i")).select("i.*")


def rss_documents(spark: SparkSession, path: str) -> DataFrame:
    """Items of an XML feed."""
    rows = spark.read.format("xml").option("rowTag", "item").schema("title string, description string, link string").load(path)
    return rows.select("title", F.col("description").alias("summary"), F.col("link").alias("url"))


def season_results(spark: SparkSession, path: str) -> DataFrame:
    """Season files with either set of headers; three date formats, blank dates null."""
    rows = spark.read.csv(path, header=True, escape='"')
    pick = lambda *names: F.coalesce(*(F.col(n) for n in names if n in rows.columns), F.lit(None).cast("string"))
    date = pick("Date")
    read = lambda f: F.try_to_timestamp(date, F.lit(f))
    short = read("dd/MM/yy")  # of two digits, 69 and more are of the last century
    played = F.coalesce(read("dd/MM/yyyy"), F.when(F.year(short) >= 2069, short - F.expr("INTERVAL 100 YEAR")).otherwise(short), read("yyyy-MM-dd"))
    goals = lambda *n: pick(*n).try_cast("int")
    return rows.select(pick("Div", "League").alias("competition"), pick("HomeTeam", "Home").alias("home_team"), pick("AwayTeam", "Away").alias("away_team"), goals("FTHG", "HG").alias("home_goals"), goals("FTAG", "AG").alias("away_goals"), played.alias("played_at"))


def scoreboard_fixtures(events: DataFrame) -> DataFrame:
    """Nested scoreboard events to flat fixtures, goals only of finished ones, one row a (league, id)."""
    side = lambda kind: F.get(F.filter("competitors", lambda c: c["homeAway"] == kind), 0)
    rows = events.select("league", "id", "status", F.col("date").alias("kickoff_at"), side("home").alias("h"), side("away").alias("a")).where("h.team is not null and a.team is not null")
    goals = lambda s: F.when(F.col("status") == "FINISHED", F.col(f"{s}.score").try_cast("int"))
    return rows.select("league", "id", "status", "kickoff_at", F.col("h.team").alias("home_team"), F.col("a.team").alias("away_team"), goals("h").alias("home_goals"), goals("a").alias("away_goals")).dropDuplicates(["league", "id"])


def parsed(documents: DataFrame) -> DataFrame:
    """fixtures as they are, and as results where both sides' goals are known; the stage stays."""
    known = F.filter("fixtures", lambda f: f["home_goals"].isNotNull() & f["away_goals"].isNotNull())
    return documents.select("title", "url", F.coalesce("fixtures", F.array().cast(documents.schema["fixtures"].dataType)).alias("fixture_candidates"), F.coalesce(known, F.array().cast(documents.schema["fixtures"].dataType)).alias("historical_results"))


def guide_fixtures(text: Column) -> Column:
    """array<struct<position, home, away>> of a weekend guide's text, 14 at most, up to where positions stop growing."""
    pattern = r"(?:^|\n)[. ]*([^\n]+?) VS\s*\nCASILLERO (\d+)\s*\n([^\n]+)"
    part = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    clean = lambda s: F.trim(F.regexp_replace(s, r"^LOCAL VISITANTE\s+", ""))
    rows = F.transform(F.arrays_zip(part(2).alias("p"), part(1).alias("h"), part(3).alias("a")), lambda x: F.struct(x["p"].cast("int").alias("position"), clean(x["h"]).alias("home"), clean(x["a"]).alias("away")))
    none = F.array().cast("array<struct<position:int,home:string,away:string>>")
    start = F.struct(F.lit(0).alias("last"), F.lit(False).alias("stop"), none.alias("out"))

    def step(s: Column, x: Column) -> Column:
        stop = s["stop"] | (x["position"] <= s["last"])
        return F.struct(x["position"].alias("last"), stop.alias("stop"), F.when(stop, s["out"]).otherwise(F.concat(s["out"], F.array(x))).alias("out"))

    return F.slice(F.aggregate(rows, start, step, lambda s: s["out"]), 1, 14)


def draw_code(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"CONCURSO\s+(\d+)", 1), F.lit(""))


def pages(rows: DataFrame) -> DataFrame:
    """page_id, title, first heading, number of headings and links of raw pages."""
    html = F.col("html")
    count = lambda p: F.size(F.regexp_extract_all(html, F.lit(p), F.lit(0))).cast("long")
    return rows.select("page_id", F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(html, "<h[1-6][^>]*>([^<]*)</h[1-6]>", 1).alias("heading"), count("<h[1-6]").alias("headings"), count("<a ").alias("links"))
