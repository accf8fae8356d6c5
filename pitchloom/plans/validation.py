"""Plans of the checks of completed slates."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchloom.operators import results, validation
from pitchloom.sources import derive

from .core import plan

LINKS = """.
lk AS (SELECT match_id // 14 AS slate_id, match_id % 14 + 1 AS position, match_id FROM matches), sg(code, letter) AS (VALUES ('1', 'L'), ('X', 'E'), ('2', 'V'))
"""
#: Every third slate has all its own results; elsewhere each fifth match has none. The provider knows all matches of even slates, each eleventh one wrongly, and leaves each thirteenth of odd ones unfinished or garbled.
CHECKED = (
    LINKS
    + """,
lr AS (SELECT match_id, arg_max(result_code, source_id) AS rc FROM results GROUP BY 1), lo AS (SELECT lk.*, rc, CASE WHEN slate_id % 3 = 0 OR lk.match_id % 5 <> 0 THEN letter END AS local FROM lk LEFT JOIN lr USING (match_id) LEFT JOIN sg ON code = rc),
pv AS (SELECT lo.*, CASE WHEN rc IS NULL OR (slate_id % 2 = 1 AND match_id % 13 < 2) THEN NULL WHEN match_id % 11 = 0 THEN 'E' ELSE letter END AS offered FROM lo LEFT JOIN sg ON code = rc),
pd AS (SELECT pv.*, CASE WHEN slate_id % 4 = 0 AND match_id % 7 = 0 THEN NULL WHEN match_id % 6 < 2 THEN 'L' WHEN match_id % 6 < 4 THEN 'E' ELSE 'V' END AS predicted FROM pv),
sm AS (SELECT slate_id, count(*) AS n, count(predicted) AS p, count(local) AS k, count(offered) AS o, count(*) FILTER (WHERE local IS NULL AND offered IS NOT NULL) AS f, count(*) FILTER (WHERE local <> offered) AS c, count(*) FILTER (WHERE local = predicted) AS h, count(*) FILTER (WHERE local IS NULL AND offered = predicted) AS g FROM pd GROUP BY 1),
sk AS (SELECT slate_id, n, p, k, k < n AS ask, CASE WHEN k < n THEN o ELSE 0 END AS o, CASE WHEN k < n THEN c ELSE 0 END AS c, k + CASE WHEN k < n THEN f ELSE 0 END AS cov, h + CASE WHEN k < n THEN g ELSE 0 END AS h FROM sm)
"""
)


@plan(
    "c20_validated_slates",
    CHECKED
    + """SELECT slate_id, n AS match_count, p AS predictions_count, k AS local_results_count, o AS provider_results_count, CASE WHEN ask THEN 'consulted' ELSE 'skipped_local_complete' END AS provider_status, round(cov / n, 4) AS coverage, c AS conflicts, h AS hits, cov = n AND c = 0 AND o = n AS ready_to_apply,
  array_to_string(list_filter([CASE WHEN ask AND o = 0 THEN 'missing_provider_results' END, CASE WHEN k = 0 THEN 'missing_local_results' END, CASE WHEN c > 0 THEN 'result_conflicts' END, CASE WHEN cov < n THEN 'incomplete_coverage' END, CASE WHEN p < n THEN 'incomplete_predictions' END], lambda b: b IS NOT NULL), ',') AS blockers FROM sk""",
)
def validated_slates(spark, sf_dir):
    m = F.col("match_id")
    links = derive.matches(spark, sf_dir).select(F.expr("match_id div 14").alias("slate_id"), (m % 14 + 1).alias("position"), "match_id")
    rows = derive.results(spark, sf_dir).withColumn("slate_id", F.expr("match_id div 14"))
    own = rows.where("slate_id % 3 = 0 or match_id % 5 <> 0").select("match_id", F.col("source_id").alias("played_at"), "result_code")
    newest = rows.groupBy("slate_id", "match_id").agg(F.max_by("home_goals", "source_id").alias("h"), F.max_by("away_goals", "source_id").alias("a"))
    score = F.when((F.col("slate_id") % 2 == 1) & (m % 13 == 0), "2:0").when(m % 11 == 0, "1-1").otherwise(F.concat(F.col("h").cast("string"), F.lit(" - "), F.col("a").cast("string")))
    provider = newest.select("slate_id", (m % 14 + 1).alias("position"), score.alias("score"), F.when((F.col("slate_id") % 2 == 1) & (m % 13 == 1), "live").otherwise("finished").alias("status"))
    code = F.when(m % 6 < 2, "1").when(m % 6 < 4, "X").otherwise("2")
    made = links.where("not (slate_id % 4 = 0 and match_id % 7 = 0)")
    right = made.select("match_id", F.when(m % 2 == 0, F.col("slate_id")).alias("slate_id"), F.lit(5).alias("generated_at"), code.alias("code"))
    older = made.where("match_id % 2 = 1").select("match_id", F.lit(None).cast("long").alias("slate_id"), F.lit(3).alias("generated_at"), F.lit("X").alias("code"))
    others = made.where("match_id % 2 = 0").select("match_id", (F.col("slate_id") + 1).alias("slate_id"), F.lit(9).alias("generated_at"), F.lit("2").alias("code"))  # newer, but of another slate
    return validation.validated(links, right.unionByName(older).unionByName(others), own, provider)


@plan(
    "c27_manual_results",
    LINKS
    + """,
mr AS (SELECT slate_id, position + CASE WHEN slate_id % 9 = 4 AND position = 2 THEN 30 ELSE 0 END AS position, CASE WHEN slate_id % 9 = 3 AND position = 5 THEN NULL ELSE p.home_goals END AS h, p.away_goals AS a, letter, result_code, lk.match_id FROM lk JOIN played p USING (match_id) JOIN sg ON code = p.result_code WHERE NOT (slate_id % 9 = 5 AND position = 7)),
md AS (SELECT *, CASE WHEN h > a THEN 'L' WHEN h < a THEN 'V' WHEN h = a THEN 'E' END AS scored, CASE WHEN slate_id % 9 = 6 AND position = 1 THEN 'V' WHEN position % 2 = 0 THEN letter END AS stated FROM mr UNION ALL SELECT *, CASE WHEN h > a THEN 'L' WHEN h < a THEN 'V' WHEN h = a THEN 'E' END, NULL FROM mr WHERE slate_id % 9 = 7 AND position = 3),
kn AS (SELECT match_id, arg_min(result_code, priority) AS rc FROM results GROUP BY 1), sz AS (SELECT slate_id, count(*) AS n FROM lk GROUP BY 1),
mx AS (SELECT slate_id, count(*) AS given, count(DISTINCT position) AS diff, count(DISTINCT position) FILTER (WHERE position <= n) AS ins, count(*) FILTER (WHERE position > n) AS outs, count(*) FILTER (WHERE stated <> scored) AS mm, count(*) FILTER (WHERE scored IS NULL) AS ms,
  count(*) FILTER (WHERE ex <> coalesce(stated, scored, '')) AS cf FROM (SELECT md.*, n, s2.letter AS ex FROM md JOIN sz USING (slate_id) LEFT JOIN lk l2 ON l2.slate_id = md.slate_id AND l2.position = md.position LEFT JOIN kn ON kn.match_id = l2.match_id LEFT JOIN sg s2 ON s2.code = kn.rc) GROUP BY 1),
mb AS (SELECT slate_id, n, coalesce(given, 0) AS given, coalesce(ins, 0) AS ins, coalesce(cf, 0) AS cf, list_filter([CASE WHEN slate_id % 9 = 8 THEN 'draw_code_mismatch' END, CASE WHEN given <> diff THEN 'duplicate_positions' END, CASE WHEN outs > 0 THEN 'position_out_of_range' END, CASE WHEN coalesce(ins, 0) <> n OR outs > 0 THEN 'incomplete_positions' END,
  CASE WHEN coalesce(given, 0) <> n THEN 'match_count_mismatch' END, CASE WHEN mm > 0 THEN 'sign_score_mismatch' END, CASE WHEN ms > 0 THEN 'missing_score' END, CASE WHEN cf > 0 THEN 'result_conflict' END, CASE WHEN slate_id % 10 = 0 THEN 'low_source_confidence' END], lambda b: b IS NOT NULL) AS bl FROM sz LEFT JOIN mx USING (slate_id))
SELECT 'f' || slate_id AS file_id, slate_id, n AS match_count, given AS provided_count, round(ins / n, 4) AS coverage, cf AS conflicts, len(bl) = 0 AS ready_to_apply, array_to_string(bl, ',') AS blockers FROM mb""",
)
def manual_results(spark, sf_dir):
    """A file a slate; one in nine each lacks a score, moves a position, drops one, contradicts its score, repeats a position, or names another draw; in a tenth the source is not trusted."""
    m, s = F.col("match_id"), F.col("slate_id")
    links = derive.matches(spark, sf_dir).select(F.expr("match_id div 14").alias("slate_id"), (m % 14 + 1).alias("position"), "match_id")
    slates = links.select("slate_id").distinct().withColumn("slate_draw", F.concat(F.lit("D"), s.cast("string")))
    files = slates.select(F.concat(F.lit("f"), s.cast("string")).alias("file_id"), "slate_id", F.when(s % 9 == 8, "D0").otherwise(F.col("slate_draw")).alias("draw_code"), (s % 10 != 0).alias("is_trusted"))
    known = links.join(derive.played(spark, sf_dir).select("match_id", "home_goals", "away_goals", "result_code"), "match_id").where("not (slate_id % 9 = 5 and position = 7)")
    sign = F.when((s % 9 == 6) & (F.col("position") == 1), "V").when(F.col("position") % 2 == 0, validation.sign_of(F.col("result_code"))).otherwise("")
    typed = known.select(F.concat(F.lit("f"), s.cast("string")).alias("file_id"), F.when((s % 9 == 4) & (F.col("position") == 2), 32).otherwise(F.col("position")).alias("position"), sign.alias("sign"), F.when(~((s % 9 == 3) & (F.col("position") == 5)), F.col("home_goals")).alias("home_goals"), "away_goals", "slate_id")
    twice = typed.where("slate_id % 9 = 7 and position = 3").withColumn("sign", F.lit(None).cast("string"))
    return validation.manual_evaluated(files, typed.unionByName(twice).drop("slate_id"), slates, links, results.with_conflicts(derive.results(spark, sf_dir)).select("match_id", "result_code"))
