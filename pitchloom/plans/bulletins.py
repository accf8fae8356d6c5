"""Plans of bulletins and midweek guides: texts are written from the fixtures, then read."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchloom.sources import bulletins, derive

from .core import plan
from .readers import named

BULLETIN = """.
bl AS (SELECT m.match_id // 14 AS id, m.match_id % 14 + 1 AS position, m.match_id, m.home_team_id, m.away_team_id, p.home_goals AS h, p.away_goals AS a, p.result_code AS rc, CASE WHEN m.match_id // 14 % 7 = 0 THEN 'page' WHEN p.match_id IS NULL OR m.match_id % 6 = 0 THEN 'open' WHEN m.match_id % 6 = 1 THEN 'sign' ELSE 'score' END AS kind
  FROM matches m LEFT JOIN played p ON p.match_id = m.match_id),
pg AS (SELECT id, list(coalesce(rc, 'X') ORDER BY position) AS codes FROM bl WHERE kind = 'page' GROUP BY 1)
"""


@plan(
    "a08_bulletin_results",
    BULLETIN
    + """SELECT id, (100 + id % 900)::VARCHAR AS draw_code, position::INT AS position, CASE WHEN kind <> 'sign' THEN 'TEAM ' || chr((65 + home_team_id % 26)::INT) END AS home, CASE WHEN kind <> 'sign' THEN 'TEAM ' || chr((65 + away_team_id % 26)::INT) END AS away,
  CASE WHEN kind = 'score' THEN h::INT END AS home_goals, CASE WHEN kind = 'score' THEN a::INT END AS away_goals, CASE WHEN kind <> 'open' THEN rc END AS result_code,
  CASE WHEN kind = 'open' THEN 'scheduled' WHEN kind = 'score' AND match_id % 6 = 2 THEN 'live' WHEN kind = 'score' AND match_id % 6 = 3 THEN 'halftime' ELSE 'full_time' END AS status,
  CASE WHEN kind = 'score' AND match_id % 6 = 2 THEN (match_id % 90)::INT END AS minute, kind = 'sign' OR (kind = 'score' AND match_id % 6 > 3) AS is_final FROM bl WHERE kind <> 'page'
UNION ALL SELECT id, (100 + id % 900)::VARCHAR, unnest(range(1, len(codes) + 1))::INT, NULL, NULL, NULL, NULL, unnest(codes), 'full_time', NULL, true FROM pg WHERE len(codes) IN (7, 9, 14)""",
)
def bulletin_results(spark, sf_dir):
    """A bulletin a slate: scores of ended, running and half-time matches, fixtures without a score, signs alone, repeated positions; every seventh slate's bulletin is a page with a row of signs."""
    m, played = F.col("match_id"), derive.played(spark, sf_dir).select("match_id", "home_goals", "away_goals", "result_code")
    rows = derive.matches(spark, sf_dir).join(played, "match_id", "left").withColumns({"id": F.expr("match_id div 14"), "position": m % 14 + 1})
    team = lambda c: F.concat(F.lit("TEAM "), F.char(65 + F.col(c) % 26))
    sign = F.when(F.col("result_code") == "1", "L").when(F.col("result_code") == "2", "V").otherwise("E")
    tail = F.when(m % 6 == 2, F.concat(F.lit(" EN VIVO "), (m % 90).cast("string"), F.lit("'"))).when(m % 6 == 3, " Medio tiempo").when(m % 6 == 4, " final").otherwise("")
    place = F.col("position").cast("string")
    scored = F.concat(place, F.lit(". "), team("home_team_id"), F.lit("  "), F.col("home_goals").cast("string"), F.lit(" - "), F.col("away_goals").cast("string"), F.lit(" "), team("away_team_id"), tail)
    open_ = F.concat(place, F.lit(" "), team("home_team_id"), F.lit(" vs "), team("away_team_id"), F.when(m % 4 == 0, " Pendiente").otherwise(""))
    line = F.when(F.col("result_code").isNull() | (m % 6 == 0), open_).when(m % 6 == 1, F.concat(F.lit("  "), place, F.lit(") "), sign)).otherwise(scored)
    again = F.concat(F.lit("RESULTADOS\n"), line, F.lit("\n"), place, F.lit(" E"))  # a later line of the same position says nothing
    slates = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("position", again.alias("line"), sign.alias("sign")))).alias("lines"))
    joined = lambda field, by: F.array_join(F.transform("lines", lambda x: x[field]), by)
    draw = (100 + F.col("id") % 900).cast("string")
    page = F.concat(F.lit("<table><tr><th>Sorteo</th></tr><tr class='r'><td>"), draw, F.lit("</td> <td>01/02</td><td> "), joined("sign", " "), F.lit(" </td></tr></table>"))
    texts = slates.select("id", F.when(F.col("id") % 7 == 0, page).otherwise(F.concat(F.lit("Concurso "), draw, F.lit("\n"), joined("line", "\r\n"))).alias("text"))
    return bulletins.results_of(texts)


@plan(
    "a07_midweek_guides",
    """.
mw AS (SELECT match_id // 9 AS id, match_id % 9 + 1 AS position, chr((65 + home_team_id % 26)::INT) AS h, chr((65 + away_team_id % 26)::INT) AS a FROM matches)
SELECT id, (500 + id % 400)::VARCHAR AS draw_code, position::INT AS position, 'CLUB ' || h AS home, 'EQUIPO ' || a AS away FROM mw""",
)
def midweek_guides(spark, sf_dir):
    """A guide of nine positions a slate: home teams before a VS, one moved behind all marks, one later on in a line of its own without VS."""
    rows = derive.matches(spark, sf_dir).select(F.expr("match_id div 9").alias("id"), (F.col("match_id") % 9 + 1).alias("position"), "home_team_id", "away_team_id")
    letter = lambda c: F.char(65 + F.col(c) % 26)
    late, bare = F.col("position") == F.col("id") % 9 + 1, F.col("position") == F.col("id") % 9 + 4
    club, mark = F.concat(F.lit("CLUB "), letter("home_team_id")), F.concat(F.lit("CASILLERO "), F.col("position").cast("string"), F.lit("\n1.85 veces\n EQUIPO "), letter("away_team_id"), F.lit("\n"))
    before = F.when(late, "").when(bare, F.concat(F.lit("UEFA\n"), club, F.lit("\nLOCAL\n"))).otherwise(F.concat(F.lit("juega en casa\n"), club, F.lit(" VS\n")))
    behind = F.when(late, F.concat(club, F.lit("\nVS\n"))).otherwise("")
    slates = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("position", F.concat(before, mark).alias("line"), behind.alias("late")))).alias("lines"))
    joined = lambda field: F.array_join(F.transform("lines", lambda x: x[field]), "")
    text = F.concat(F.lit("guía\nCONCURSO "), (500 + F.col("id") % 400).cast("string"), F.lit("\n"), joined("line"), F.lit("1.2 momios\n"), joined("late"))
    found = slates.select("id", text.alias("text"))
    return found.select("id", bulletins.draw_code(F.col("text")).alias("draw_code"), F.explode(bulletins.midweek_fixtures(F.col("text"))).alias("f")).select("id", "draw_code", "f.*")
