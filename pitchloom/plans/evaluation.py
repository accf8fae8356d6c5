"""Plans of evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchloom.operators import evaluation, results
from pitchloom.sources import derive

from .core import plan
from .results import SCORES

SAMPLES = (
    SCORES
    + """,
e AS (SELECT *, greatest(p_home, p_draw, p_away) AS top, list_sort([p_home, p_draw, p_away])[2] AS second, pick = rc AS hit FROM b WHERE rc IS NOT NULL),
eb AS (SELECT *, CASE WHEN top >= 0.55 AND top - second >= 0.12 THEN 'high' WHEN top >= 0.40 AND top - second >= 0.02 THEN 'medium' ELSE 'low' END AS band, least(floor(top * 10), 9) AS bin FROM e)
"""
)


def samples(spark, sf_dir):
    latest = results.latest(derive.predictions(spark, sf_dir), ["match_id"], ["version"])
    return evaluation.samples(latest, results.canonical(derive.results(spark, sf_dir)))


@plan(
    "d12_calibration_by_band",
    SAMPLES
    + """,
bins AS (SELECT band, bin, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE own >= second) AS top2, sum(brier) AS brier, sum(loss) AS loss, sum(top) AS conf FROM eb GROUP BY GROUPING SETS ((band, bin), (bin)))
SELECT band, sum(n)::BIGINT AS n, round(sum(hits) / sum(n), 6) AS hit_rate, round(sum(top2) / sum(n), 6) AS top2_rate, round(sum(brier) / sum(n), 6) AS brier, round(sum(loss) / sum(n), 6) AS log_loss,
  round(sum(abs(hits - conf)) / sum(n), 6) AS ece FROM bins GROUP BY band""",
)
def calibration_by_band(spark, sf_dir):
    return evaluation.calibration(samples(spark, sf_dir).withColumn("band", evaluation.band()), "band")


@plan(
    "d08_draw_priors",
    SCORES
    + """,
o AS (SELECT CASE slate_id % 3 WHEN 0 THEN 'weekend' WHEN 1 THEN 'midweek' ELSE 'revancha' END AS week_type, rc FROM b WHERE rc IS NOT NULL),
c AS (SELECT week_type, count(*) AS n, count(*) FILTER (WHERE rc = 'X') AS d FROM o GROUP BY ROLLUP (week_type))
SELECT week_type, n, round(least(1.0, n / 150) * d / n + (1 - least(1.0, n / 150)) * 0.27, 4) AS prior, CASE WHEN n >= 150 THEN 'high' WHEN n >= 60 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN n >= 150 THEN 'observed' ELSE 'blended' END AS origin FROM c""",
)
def draw_priors(spark, sf_dir):
    kind = F.when(F.col("slate_id") % 3 == 0, "weekend").when(F.col("slate_id") % 3 == 1, "midweek").otherwise("revancha")
    return evaluation.draw_priors(samples(spark, sf_dir).withColumn("week_type", kind))


@plan(
    "l07_walk_forward_priors",
    """.
n AS (SELECT match_id, competition_id, result_code AS rc, count(*) OVER w AS n, count(*) FILTER (WHERE result_code = '1') OVER w AS n1, count(*) FILTER (WHERE result_code = 'X') OVER w AS nx, count(*) FILTER (WHERE result_code = '2') OVER w AS n2
  FROM played WINDOW w AS (PARTITION BY competition_id ORDER BY kickoff_at, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT competition_id, rc, (n1 + 1) / (n + 3) AS h, (nx + 1) / (n + 3) AS d, (n2 + 1) / (n + 3) AS a FROM n WHERE n >= 20),
q AS (SELECT *, greatest(h, d, a) AS top, CASE rc WHEN '1' THEN h WHEN 'X' THEN d ELSE a END AS own, CASE WHEN h >= d AND h >= a THEN '1' WHEN a >= d THEN '2' ELSE 'X' END = rc AS hit,
  (h - (rc = '1')::INT) ** 2 + (d - (rc = 'X')::INT) ** 2 + (a - (rc = '2')::INT) ** 2 AS brier FROM p),
s AS (SELECT competition_id, count(*) AS evaluated, count(*) FILTER (WHERE hit) AS hits, round(avg(brier), 6) AS brier, round(avg(-ln(least(greatest(own, 1e-6), 1 - 1e-6))), 6) AS log_loss,
  count(*) FILTER (WHERE top >= 0.5) AS confident_picks, count(*) FILTER (WHERE top >= 0.5 AND hit) AS confident_hits FROM q GROUP BY 1)
SELECT *, round(hits / evaluated, 6) AS hit_rate, round(coalesce(confident_hits / nullif(confident_picks, 0), 0.0), 6) AS confident_hit_rate,
  CASE WHEN confident_picks < 8 THEN 'insufficient_confident_samples' WHEN hits / evaluated >= 0.5 AND brier <= 0.62 AND coalesce(confident_hits / nullif(confident_picks, 0), 0) >= 0.55 THEN 'ready' ELSE 'not_ready' END AS verdict FROM s""",
)
def walk_forward_priors(spark, sf_dir):
    return evaluation.expanding_priors(derive.played(spark, sf_dir))


@plan(
    "i22_drift",
    """.
b AS (SELECT home_goals::DOUBLE AS v FROM played WHERE match_id % 2 = 0), s AS (SELECT home_goals::DOUBLE AS v FROM played WHERE match_id % 2 = 1),
l AS (SELECT list(v ORDER BY v) AS x, count(*) AS n, max(v) AS top FROM b),
g AS (SELECT list_transform(range(1, 11), lambda i: CASE WHEN i = 10 THEN top ELSE x[least(round_even(i * n / 10, 0)::BIGINT, n - 1) + 1] END) AS edges FROM l),
bb AS (SELECT least(len(list_filter(edges, lambda e: e < v)), 9) AS bin, count(*) AS c FROM b, g GROUP BY 1), sb AS (SELECT least(len(list_filter(edges, lambda e: e < v)), 9) AS bin, count(*) AS c FROM s, g GROUP BY 1),
f AS (SELECT greatest(coalesce(bb.c, 0) / (SELECT count(*) FROM b), 1e-6) AS p, greatest(coalesce(sb.c, 0) / (SELECT count(*) FROM s), 1e-6) AS q FROM bb FULL JOIN sb ON bb.bin = sb.bin),
r AS (SELECT sum((q - p) * ln(q / p)) AS psi FROM f)
SELECT 'home_goals' AS feature, round(psi, 6) AS psi, CASE WHEN psi >= 0.25 THEN 'severe' WHEN psi >= 0.10 THEN 'moderate' ELSE 'stable' END AS severity FROM r""",
)
def drift(spark, sf_dir):
    played = derive.played(spark, sf_dir)
    return evaluation.psi(played.where("match_id % 2 = 0"), played.where("match_id % 2 = 1"), "home_goals")


@plan(
    "i31_temperature",
    SAMPLES
    + """,
g AS (SELECT p_home AS h, p_draw AS d, p_away AS a, rc, count(*) AS n FROM eb GROUP BY ALL),
t AS (SELECT 0.5::DOUBLE + i * 0.01::DOUBLE AS t FROM range(1151) x(i)),
l AS (SELECT t, sum(n * (ln(exp(ln(greatest(h, 1e-9)) / t) + exp(ln(greatest(d, 1e-9)) / t) + exp(ln(greatest(a, 1e-9)) / t)) - ln(greatest(CASE rc WHEN '1' THEN h WHEN 'X' THEN d ELSE a END, 1e-9)) / t)) / sum(n) AS loss FROM g, t GROUP BY t)
SELECT round(t, 2) AS temperature, round(loss, 6) AS loss FROM l ORDER BY round(loss, 9), t LIMIT 1""",
)
def temperature(spark, sf_dir):
    return evaluation.temperature(samples(spark, sf_dir))


def curve_points(rows):
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(c).alias("x"), (F.col("result_code") == k).cast("int").alias("y")) for k, c in evaluation.CLASSES.items())))
    return rows.select(pairs.alias("p")).select("p.*")


@plan("i19_isotonic_curves")
def isotonic_curves(spark, sf_dir):
    return evaluation.isotonic(curve_points(samples(spark, sf_dir)))


@plan("i13_isotonic_calibrated")
def isotonic_calibrated(spark, sf_dir):
    rows = samples(spark, sf_dir)
    return evaluation.calibrated(rows.select("match_id", "p_home", "p_draw", "p_away"), evaluation.isotonic(curve_points(rows)))
