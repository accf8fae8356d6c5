"""Plans of versioned slates: two batches of payloads over stored slates."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchloom.operators import versions
from pitchloom.sources import derive

from .core import plan

#: Every fifth slate is not stored yet; every third stored one gets another first fixture; every seventh has no digest; every fourth comes twice, the second time as stored.
SLATES = """.
f0 AS (SELECT match_id // 14 AS s, match_id % 14 + 1 AS position, ' Equipo ' || home_team_id || CASE WHEN home_team_id % 4 = 0 THEN ' Ñandú' ELSE '' END AS home_team, 'Team "' || away_team_id || '"' AS away_team, 'Liga ' || competition_id || CASE WHEN competition_id % 2 = 0 THEN ' Cup' ELSE '' END AS competition, kickoff_at FROM matches),
j0 AS (SELECT s, v, string_agg('{"away_team":"' || replace(lower(trim(away_team)), '"', '\\"') || '","competition":"' || lower(competition) || '","home_team":"' || replace(replace(lower(trim(home_team)), 'ñ', '\\u00f1'), 'ú', '\\u00fa') || CASE WHEN v = 1 AND position = first THEN ' b' ELSE '' END || '","kickoff_at":"' || strftime(kickoff_at, '%Y-%m-%dT%H:%M:%S') || '+00:00","position":' || position || '}', ',' ORDER BY position) AS body
  FROM (SELECT *, min(position) OVER (PARTITION BY s) AS first FROM f0), (VALUES (0), (1)) x(v) GROUP BY 1, 2),
hs AS (SELECT s, v, sha256('{"draw_code":"D' || s || '","fixtures":[' || body || '],"week_type":"' || CASE s % 2 WHEN 0 THEN 'weekend' ELSE 'midweek' END || '"}') AS hash FROM j0),
st AS (SELECT a.s, a.s % 5 <> 0 AS known, CASE WHEN a.s % 7 <> 0 THEN a.hash END AS stored, CASE WHEN a.s % 3 = 0 THEN b.hash ELSE a.hash END AS one, a.s % 4 = 0 AS twice, a.hash AS two FROM hs a JOIN hs b ON b.s = a.s AND b.v = 1 WHERE a.v = 0),
ch AS (SELECT *, CASE WHEN known THEN stored END AS prior, (CASE WHEN known THEN stored END IS NOT NULL AND stored <> one)::BIGINT AS c1, (twice AND one <> two)::BIGINT AS c2 FROM st)
"""


def fixtures(spark, sf_dir):
    """s (the slate's number) and its fixtures, names as they came."""
    k = derive.matches(spark, sf_dir)
    rows = k.select(
        F.expr("match_id div 14").alias("s"), (F.col("match_id") % 14 + 1).alias("position"), F.concat(F.lit(" Equipo "), F.col("home_team_id").cast("string"), F.when(F.col("home_team_id") % 4 == 0, " Ñandú").otherwise("")).alias("home_team"),
        F.concat(F.lit('Team "'), F.col("away_team_id").cast("string"), F.lit('"')).alias("away_team"), "kickoff_at", F.concat(F.lit("Liga "), F.col("competition_id").cast("string"), F.when(F.col("competition_id") % 2 == 0, " Cup").otherwise("")).alias("competition"),
    )
    return rows.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("position", "home_team", "away_team", "kickoff_at", "competition"))).alias("fixtures"))


def changed(listed):
    """The fixtures with another home team in the first place."""
    return F.transform(listed, lambda f, i: F.when(i == 0, f.withField("home_team", F.concat(F.rtrim(f["home_team"]), F.lit(" B ")))).otherwise(f))


def stored(spark, sf_dir):
    rows = fixtures(spark, sf_dir).where("s % 5 <> 0")
    draw, kind = F.concat(F.lit("D"), F.col("s").cast("string")), F.when(F.col("s") % 2 == 0, "weekend").otherwise("midweek")
    rows = rows.select(F.col("s").cast("string").alias("slate_id"), draw.alias("draw_code"), F.lit("old").alias("label"), kind.alias("week_type"), F.lit(0).cast("long").alias("closes_at"), F.lit(False).alias("is_archived"), "fixtures", "s")
    return rows.withColumns({"composition_hash": F.when(F.col("s") % 7 != 0, versions.composition_hash(F.col("draw_code"), F.col("week_type"), F.col("fixtures"))), "slate_version": F.when(F.col("s") % 7 != 0, F.col("s") % 3 + 1)}).drop("fixtures", "s")


def payloads(spark, sf_dir):
    rows = fixtures(spark, sf_dir)
    one = F.when(F.col("s") % 3 == 0, changed(F.col("fixtures"))).otherwise(F.col("fixtures"))
    both = rows.select("s", F.explode(F.when(F.col("s") % 4 == 0, F.array(F.struct(F.lit(1).alias("seq"), one.alias("fixtures")), F.struct(F.lit(2).alias("seq"), F.col("fixtures")))).otherwise(F.array(F.struct(F.lit(1).alias("seq"), one.alias("fixtures"))))).alias("p"))
    kind = F.when(F.col("s") % 2 == 0, "weekend").otherwise("midweek")
    return both.select(F.concat(F.lit("D"), F.col("s").cast("string")).alias("draw_code"), "p.seq", F.concat(F.lit("batch "), F.col("p.seq").cast("string")).alias("label"), kind.alias("week_type"), F.col("s").alias("closes_at"), (F.col("s") % 6 == 0).alias("is_archived"), "p.fixtures")


@plan("h27_composition_hashes", SLATES + "SELECT 'D' || s AS draw_code, hash AS composition_hash FROM hs WHERE v = 0")
def composition_hashes(spark, sf_dir):
    rows = fixtures(spark, sf_dir).withColumns({"draw_code": F.concat(F.lit("D"), F.col("s").cast("string")), "week_type": F.when(F.col("s") % 2 == 0, "weekend").otherwise("midweek")})
    return rows.select("draw_code", versions.composition_hash(F.col("draw_code"), F.col("week_type"), F.col("fixtures")).alias("composition_hash"))


@plan("h28_backfilled_hashes", SLATES + "SELECT s::VARCHAR AS slate_id, two AS composition_hash, CASE WHEN s % 7 = 0 THEN 1 ELSE s % 3 + 1 END AS slate_version FROM st WHERE known")
def backfilled_hashes(spark, sf_dir):
    links = fixtures(spark, sf_dir).select(F.col("s").cast("string").alias("slate_id"), F.explode("fixtures").alias("f")).select("slate_id", "f.*")
    return versions.backfilled(stored(spark, sf_dir), links).select("slate_id", "composition_hash", "slate_version")


@plan(
    "p02_upserted_slates",
    SLATES
    + """SELECT CASE WHEN known THEN s::VARCHAR ELSE 'draw-D' || s END AS slate_id, 'D' || s AS draw_code, CASE WHEN twice THEN 'batch 2' ELSE 'batch 1' END AS label, CASE s % 2 WHEN 0 THEN 'weekend' ELSE 'midweek' END AS week_type, s AS closes_at, s % 6 = 0 AS is_archived,
  CASE WHEN twice THEN two ELSE one END AS composition_hash, CASE WHEN known AND s % 7 <> 0 THEN s % 3 + 1 ELSE 1 END + c1 + c2 AS slate_version FROM ch""",
)
def upserted_slates(spark, sf_dir):
    return versions.upserted_slates(stored(spark, sf_dir), payloads(spark, sf_dir))


@plan(
    "p02_invalidated_snapshots",
    SLATES
    + """SELECT p.match_id AS snapshot_id, s::VARCHAR AS slate_id, coalesce(p.version = 1 AND c1 + c2 = 0, false) AS is_valid, CASE WHEN p.version = 1 AND c1 + c2 > 0 THEN 99 WHEN p.version = 0 THEN 7 END AS invalidated_at,
  CASE WHEN p.version = 0 THEN 'older' WHEN c1 = 1 THEN 'composition_changed_from_' || stored[1:8] WHEN c2 = 1 THEN 'composition_changed_from_' || one[1:8] END AS reason, p.version FROM predictions p JOIN ch ON s = p.slate_id WHERE known""",
)
def invalidated_snapshots(spark, sf_dir):
    old = F.col("version") == 0
    snapshots = derive.predictions(spark, sf_dir).where("slate_id % 5 <> 0").select(F.col("match_id").alias("snapshot_id"), F.col("slate_id").cast("string").alias("slate_id"), (~old).alias("is_valid"), F.when(old, 7).cast("long").alias("invalidated_at"), F.when(old, "older").alias("reason"), "version")
    return versions.invalidated(snapshots, stored(spark, sf_dir), payloads(spark, sf_dir), F.lit(99).cast("long"))


@plan(
    "p02_links",
    SLATES
    + """SELECT 'D' || s AS draw_code, position, CASE WHEN s % 3 = 0 AND s % 4 <> 0 AND position = min(position) OVER (PARTITION BY s) THEN home_team || ' B ' ELSE home_team END AS home_team, away_team, competition,
  CASE WHEN s % 5 <> 0 AND position % 4 = 1 THEN s % 2 = 0 ELSE competition LIKE '% Cup' END AS is_knockout, CASE WHEN s % 5 <> 0 AND position % 4 = 1 THEN 'operator' ELSE 'auto' END AS knockout_source FROM f0""",
)
def links(spark, sf_dir):
    before = derive.matches(spark, sf_dir).select(F.expr("match_id div 14").alias("s"), (F.col("match_id") % 14 + 1).alias("position")).where("s % 5 <> 0")
    before = before.select(F.concat(F.lit("D"), F.col("s").cast("string")).alias("draw_code"), "position", (F.col("s") % 2 == 0).alias("is_knockout"), F.when(F.col("position") % 4 == 1, "operator").otherwise("auto").alias("knockout_source"))
    return versions.relinked(before, stored(spark, sf_dir), payloads(spark, sf_dir))
