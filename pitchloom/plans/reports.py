"""Plans of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchloom.operators import evaluation, reports, results, slates as slate_operators
from pitchloom.sources import derive

from .core import plan
from .evaluation import SAMPLES, samples
from .learning import POSITIONS, positions
from .results import CANONICAL, STATE
from .slates import SLATES, all_slates

#: The band of the share of the draw that knock-out matches move, by competition.
BANDS = """kb AS (SELECT competition_id, CASE WHEN count(*) >= 30 THEN avg((result_code = 'X')::INT) END AS r FROM played GROUP BY 1),
kc AS (SELECT competition_id, CASE WHEN r IS NULL OR r < 0.05 THEN 0.15::DOUBLE ELSE greatest(0.10, greatest(0, 1 - 0.22 / r) * 0.6) END AS lo, CASE WHEN r IS NULL OR r < 0.05 THEN 0.55::DOUBLE ELSE least(0.90, greatest(greatest(0, 1 - 0.22 / r) * 2, greatest(0, 1 - 0.22 / r) + 0.20)) END AS hi FROM kb)"""
VECTORS = [None, '{"decision_probabilities": {"L": 0.5, "E": 0.3, "V": 0.2}, "raw_probabilities": {"L": 0.6, "E": 0.3, "V": 0.1}}', '{"display_probabilities": {"L": 0.4, "E": 0.35, "V": 0.25}}', '{"decision_probabilities": {"L": 0.5}, "display_probabilities": {"L": 0.1, "E": 0.2, "V": 0.7}}', "broken"]
LISTED = "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in VECTORS) + "]"


def chosen(values, key):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.col(key) % len(values) + 1).cast("int"))


@plan(
    "d14_audit_coverage",
    SLATES
    + """, pa AS (SELECT draw_code, CASE WHEN slate_id % 5 = 0 OR (slate_id % 5 = 1 AND match_id % 2 = 0) THEN NULL ELSE 'x' END AS audit FROM matches JOIN slates ON slate_id = match_id // 14)
SELECT draw_code, count(*) AS predictions, count(audit) AS with_audit, CASE WHEN count(audit) = 0 THEN 'none' WHEN count(audit) < count(*) THEN 'partial' ELSE 'all' END AS coverage FROM pa GROUP BY 1""",
)
def audit_coverage(spark, sf_dir):
    rows = derive.matches(spark, sf_dir).withColumn("slate_id", F.expr("match_id div 14")).join(all_slates(spark, sf_dir).select("slate_id", "draw_code"), "slate_id")
    none = (F.col("slate_id") % 5 == 0) | ((F.col("slate_id") % 5 == 1) & (F.col("match_id") % 2 == 0))
    return reports.audit_coverage(rows.select("draw_code", F.when(~none, "x").alias("audit")))


@plan(
    "d18_latest_ingested",
    CANONICAL + STATE + "SELECT match_id // 14 AS slate_id, count(*) AS result_rows, count(*) FILTER (WHERE is_final) AS final_rows, max(epoch_us(observed_at)) AS last_us FROM state WHERE source_id IN (1) GROUP BY 1 ORDER BY last_us DESC, slate_id LIMIT 5",
)
def latest_ingested(spark, sf_dir):
    """The five slates seen last: the limit is the operator."""
    slates = derive.matches(spark, sf_dir).select("match_id", F.expr("match_id div 14").alias("slate_id"))
    return reports.latest_ingested(results.live_state(derive.live(spark, sf_dir)), slates, [1])


@plan(
    "d20_prediction_segments",
    POSITIONS
    + """, sg AS (SELECT hit, unnest([{'s': 'confidence', 'l': status}, {'s': 'evidence', 'l': level}, {'s': 'sign', 'l': prediction}, {'s': 'source', 'l': CASE WHEN match_id % 3 <> 0 THEN 'model' END}]) AS x FROM px WHERE actual IS NOT NULL AND NOT conflict)
SELECT x.s AS segment, coalesce(x.l, 'unknown') AS label, count(*) AS total, count(*) FILTER (WHERE hit) AS hits, round(count(*) FILTER (WHERE hit) / count(*), 4) AS accuracy FROM sg GROUP BY 1, 2""",
)
def prediction_segments(spark, sf_dir):
    rows = positions(spark, sf_dir).where("actual is not null and not conflict")
    rows = rows.withColumns({"hit": F.col("prediction") == F.col("actual"), "source": F.when(F.col("match_id") % 3 != 0, "model")})
    return reports.segments(rows, {"confidence": "status", "evidence": "level", "sign": "prediction", "source": "source"})


DATASET = (
    POSITIONS
    + """, da AS (SELECT match_id, slate_id, conflict, CASE WHEN actual IS NOT NULL OR conflict THEN coalesce(actual, '?') END AS code, match_id % 5 <> 0 AS has_goals, hit,
  (p_home - (actual = 'L')::INT) ** 2 + (p_draw - (actual = 'E')::INT) ** 2 + (p_away - (actual = 'V')::INT) ** 2 AS brier FROM px)
"""
)


def dataset_rows(spark, sf_dir):
    rows = positions(spark, sf_dir)
    brier = sum((F.col(p) - F.when(F.col("actual") == s, 1.0).otherwise(0.0)) ** 2 for p, s in (("p_home", "L"), ("p_draw", "E"), ("p_away", "V")))
    return rows.select("match_id", "slate_id", "conflict", F.when(F.col("actual").isNotNull() | F.col("conflict"), F.coalesce("actual", F.lit("?"))).alias("code"), (F.col("match_id") % 5 != 0).alias("has_goals"), (F.col("prediction") == F.col("actual")).alias("hit"), brier.alias("brier"))


@plan(
    "d11_dataset_summary",
    DATASET
    + """, du AS (SELECT *, NOT conflict AND code IS NOT NULL AS usable FROM da)
SELECT count(*) AS rows, count(*) FILTER (WHERE usable AND has_goals) AS canonical, count(*) FILTER (WHERE usable AND NOT has_goals) AS sign_only, count(*) FILTER (WHERE conflict) AS conflicts, count(*) FILTER (WHERE NOT conflict AND code IS NULL) AS without_result,
  round(avg(hit::INT) FILTER (WHERE usable), 4) AS hit_rate, round(avg(brier) FILTER (WHERE usable), 4) AS brier FROM du""",
)
def dataset_summary(spark, sf_dir):
    return reports.dataset_summary(dataset_rows(spark, sf_dir))


READY = (
    DATASET
    + """, rs AS (SELECT slate_id, slate_id % 3 = 0 AS official, count(*) AS matches, count(*) FILTER (WHERE match_id % 37 <> 0) AS predictions, count(*) FILTER (WHERE conflict) AS conflicts, count(*) FILTER (WHERE NOT conflict AND code IS NOT NULL) AS usable,
  count(*) FILTER (WHERE code IS NOT NULL) AS results FROM da GROUP BY 1),
re AS (SELECT *, CASE WHEN NOT official THEN 'not_official' WHEN predictions = 0 THEN 'no_predictions' WHEN conflicts > 0 THEN 'conflicts' WHEN results < matches THEN 'incomplete_results' END AS reason FROM rs)
"""
)


def ready_slates(spark, sf_dir):
    usable = ~F.col("conflict") & F.col("code").isNotNull()
    rows = dataset_rows(spark, sf_dir).groupBy("slate_id").agg(F.count(F.lit(1)).alias("matches"), F.count_if(F.col("match_id") % 37 != 0).alias("predictions"), F.count_if("conflict").alias("conflicts"), F.count_if(usable).alias("usable"), F.count("code").alias("results"))
    rows = rows.withColumn("official", F.col("slate_id") % 3 == 0)
    return rows.withColumn("reason", reports.exclusion_reason())


@plan("d16_exclusion_reasons", READY + "SELECT slate_id, reason FROM re")
def exclusion_reasons(spark, sf_dir):
    return ready_slates(spark, sf_dir).select("slate_id", "reason")


@plan(
    "l11_readiness",
    READY
    + """, rt AS (SELECT count(*) FILTER (WHERE reason IS NULL) AS comparable_slates, coalesce(sum(usable) FILTER (WHERE reason IS NULL), 0)::BIGINT AS comparable_matches, sum(conflicts)::BIGINT AS conflicts, sum(matches)::BIGINT AS matches FROM re),
ru AS (SELECT *, array_to_string(list_filter([CASE WHEN comparable_slates < 8 THEN 'few_slates' END, CASE WHEN comparable_matches < 112 THEN 'few_matches' END, CASE WHEN conflicts / matches > 0.05 THEN 'many_conflicts' END, CASE WHEN comparable_matches < 20 THEN 'few_rows' END], lambda f: f IS NOT NULL), ',') AS reasons FROM rt)
SELECT *, round(conflicts / matches, 6) AS conflict_ratio, reasons = '' AS ready FROM ru""",
)
def readiness(spark, sf_dir):
    return reports.readiness(ready_slates(spark, sf_dir).withColumn("comparable", F.col("reason").isNull()))


@plan(
    "l04_confidence_bins",
    SAMPLES
    + """, cb AS (SELECT least(floor(top * 10) / 10, 0.9) AS low, count(*) AS matches, avg(top) AS conf, avg(hit::INT) AS rate, avg(brier) AS b FROM eb GROUP BY 1)
SELECT printf('%.1f-%.1f', low, low + 0.1) AS confidence_bin, matches, round(conf, 4) AS average_confidence, round(rate, 4) AS hit_rate, round(conf - rate, 4) AS calibration_gap, round(b, 4) AS brier_score FROM cb""",
)
def confidence_bins(spark, sf_dir):
    return reports.confidence_bins(samples(spark, sf_dir))


@plan(
    "h30_visible_probabilities",
    CANONICAL
    + f"""
, vj AS (SELECT match_id, p_home, p_draw, p_away, CASE WHEN a LIKE '{{%' THEN a END AS j FROM (SELECT *, {LISTED}[match_id % 5 + 1] AS a FROM latest)),
vv AS (SELECT *, [(j ->> '$.decision_probabilities.L')::DOUBLE, (j ->> '$.decision_probabilities.E')::DOUBLE, (j ->> '$.decision_probabilities.V')::DOUBLE] AS d, [(j ->> '$.display_probabilities.L')::DOUBLE, (j ->> '$.display_probabilities.E')::DOUBLE, (j ->> '$.display_probabilities.V')::DOUBLE] AS s,
  (j ->> '$.raw_probabilities.L')::DOUBLE AS raw_home FROM vj),
vw AS (SELECT match_id, raw_home, CASE WHEN d[1] IS NOT NULL AND d[2] IS NOT NULL AND d[3] IS NOT NULL THEN d WHEN s[1] IS NOT NULL AND s[2] IS NOT NULL AND s[3] IS NOT NULL THEN s ELSE [p_home, p_draw, p_away] END AS v FROM vv)
SELECT match_id, round(v[1], 9) AS p_home, round(v[2], 9) AS p_draw, round(v[3], 9) AS p_away, raw_home FROM vw""",
)
def visible_probabilities(spark, sf_dir):
    names = ["p_home", "p_draw", "p_away"]
    rows = results.latest(derive.predictions(spark, sf_dir), ["match_id"], ["version"]).withColumn("audit", chosen(VECTORS, "match_id"))
    return rows.select("match_id", *(F.round(x, 9).alias(n) for n, x in zip(names, reports.visible("audit", names))), reports.raw_vector("audit")[0].alias("raw_home"))


TICKETS = [
    '{"recommendations": [{"match_id": "a", "decisions": {"simple": {"pick_type": "fixed", "picks": ["1"]}, "full": {"pick_type": "triple", "picks": ["1", "X", "2"]}}}, {"match_id": "", "decisions": {"simple": {"picks": ["2"]}}}]}',
    '{"recommendations": [{"match_id": "b", "decisions": {"doubles": {"picks": ["1", "X"]}}}]}', "broken", "{}",
]


@plan(
    "h32_ticket_picks",
    """.
tk AS (SELECT c_custkey AS snapshot_id, c_custkey % 4 AS k FROM customer)
SELECT snapshot_id, x.m AS match_id, x.d AS mode, x.t AS pick_type, x.p AS picks FROM (SELECT snapshot_id, unnest(CASE k WHEN 0 THEN [{'m': 'a', 'd': 'simple', 't': 'fixed', 'p': '1'}, {'m': 'a', 'd': 'full', 't': 'triple', 'p': '1,X,2'}] WHEN 1 THEN [{'m': 'b', 'd': 'doubles', 't': 'fixed', 'p': '1,X'}] ELSE [] END) AS x FROM tk)""",
)
def ticket_picks(spark, sf_dir):
    return reports.ticket_picks(derive.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("snapshot_id"), chosen(TICKETS, "c_custkey").alias("payload")))


@plan(
    "i18_knockout_shrinkage",
    f""".
{BANDS}
SELECT competition_id, round(lo, 6) AS shrink_min, round(hi, 6) AS shrink_max FROM kc""",
)
def knockout_shrinkage(spark, sf_dir):
    return reports.shrinkage_bands(derive.played(spark, sf_dir)).select("competition_id", F.round("shrink_min", 6).alias("shrink_min"), F.round("shrink_max", 6).alias("shrink_max"))


@plan(
    "b05_fixture_candidates",
    """.
fc AS (SELECT match_id AS document_id, coalesce(nullif(CASE WHEN match_id % 13 = 0 THEN '' WHEN match_id % 29 = 0 THEN '  ' WHEN match_id % 17 <> 0 THEN CASE WHEN match_id % 2 = 0 THEN 'League ' ELSE ' league ' END || competition_id END, ''),
  CASE WHEN match_id % 26 = 0 THEN 'League ' || competition_id END, 'Unknown Competition') AS competition, 'Team ' || home_team_id AS home, CASE WHEN match_id % 19 = 0 THEN ' ' ELSE 'team ' || away_team_id END AS away, CASE WHEN match_id % 3 = 0 THEN match_id % 15 END AS position,
  epoch(kickoff_at)::BIGINT AS kickoff_s FROM matches), mid AS (SELECT (min(kickoff_s) + max(kickoff_s)) // 2 AS s, max(kickoff_s) AS u FROM fc)
SELECT document_id, trim(competition) AS competition, trim(home) AS home, trim(away) AS away, position, kickoff_s FROM fc, mid WHERE kickoff_s >= s AND kickoff_s <= u - 86400 AND trim(home) <> '' AND trim(away) <> '' AND trim(competition) <> ''
QUALIFY row_number() OVER (PARTITION BY lower(trim(competition)), lower(trim(home)), lower(trim(away)) ORDER BY position IS NULL, coalesce(nullif(position, 0), 999), kickoff_s, trim(competition), trim(home), trim(away), document_id) = 1""",
)
def fixture_candidates(spark, sf_dir):
    m = F.col("match_id")
    text = lambda word, c: F.concat(F.lit(word), F.col(c).cast("string"))
    rows = derive.matches(spark, sf_dir).select(
        m.alias("document_id"), F.when(m % 13 == 0, "").when(m % 29 == 0, "  ").when(m % 17 != 0, F.when(m % 2 == 0, text("League ", "competition_id")).otherwise(text(" league ", "competition_id"))).alias("competition"), F.when(m % 26 == 0, text("League ", "competition_id")).alias("document_competition"), text("Team ", "home_team_id").alias("home"), F.when(m % 19 == 0, " ").otherwise(text("team ", "away_team_id")).alias("away"),
        F.when(m % 3 == 0, m % 15).alias("position"), F.unix_seconds("kickoff_at").alias("kickoff_s"),
    )
    ends = rows.agg(F.expr("(min(kickoff_s) + max(kickoff_s)) div 2").alias("since_s"), (F.max("kickoff_s") - 86400).alias("until_s"))  # one row
    return reports.candidates(rows.join(F.broadcast(ends)), F.col("since_s"), F.col("until_s"))


@plan(
    "n09_to_finalize",
    SLATES
    + """, dn AS (SELECT match_id // 14 AS slate_id, count(*) FILTER (WHERE match_id IN (SELECT match_id FROM results)) = count(*) AS is_complete FROM matches GROUP BY 1)
SELECT sc.slate_id, draw_code FROM sc JOIN dn USING (slate_id) WHERE closed AND slate_id % 3 <> 1 AND is_complete AND slate_id % 7 <> 0""",
)
def to_finalize(spark, sf_dir):
    found = all_slates(spark, sf_dir).withColumn("official", F.col("slate_id") % 3 != 1)
    known = derive.results(spark, sf_dir).select("match_id").distinct().withColumn("known", F.lit(True))
    scores = derive.matches(spark, sf_dir).select("match_id", F.expr("match_id div 14").alias("slate_id")).join(known, "match_id", "left").groupBy("slate_id").agg((F.count("known") == F.count(F.lit(1))).alias("is_complete"))
    saved = found.select("slate_id", (F.col("slate_id") % 7 == 0).alias("is_complete"))
    return slate_operators.to_finalize(found, scores, saved)


@plan(
    "d13_calibration_by_sign",
    SAMPLES
    + """, bins AS (SELECT pick, bin, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE own >= second) AS top2, sum(brier) AS brier, sum(loss) AS loss, sum(top) AS conf FROM eb GROUP BY GROUPING SETS ((pick, bin), (bin)))
SELECT pick, sum(n)::BIGINT AS n, round(sum(hits) / sum(n), 6) AS hit_rate, round(sum(top2) / sum(n), 6) AS top2_rate, round(sum(brier) / sum(n), 6) AS brier, round(sum(loss) / sum(n), 6) AS log_loss, round(sum(abs(hits - conf)) / sum(n), 6) AS ece FROM bins GROUP BY pick""",
)
def calibration_by_sign(spark, sf_dir):
    return evaluation.calibration(samples(spark, sf_dir), "pick")
