"""Plans of tickets."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchloom.operators import tickets
from pitchloom.sources import derive

from .core import plan
from .decisions import INPUTS, banded, inputs
from .evaluation import SAMPLES, samples

PMF = """,
ps AS (SELECT slate_id, list(top ORDER BY position) AS p FROM eb GROUP BY 1),
pm AS (SELECT slate_id, p, list_reduce(list_prepend([1.0::DOUBLE], list_transform(p, lambda x: [x])), lambda acc, x: list_transform(range(1, len(acc) + 2), lambda i: coalesce(acc[i], 0) * (1 - x[1]) + CASE WHEN i > 1 THEN acc[i - 1] ELSE 0 END * x[1])) AS f FROM ps)
SELECT slate_id, len(p) AS positions, round(list_sum(p), 6) AS expected, round(coalesce(list_sum(f[9:]), 0), 6) AS at_least_8, round(coalesce(list_sum(f[11:]), 0), 6) AS at_least_10, round(coalesce(list_sum(f[13:]), 0), 6) AS at_least_12, round(f[-1], 9) AS clean,
  CASE WHEN f[-1] > 0 AND f[-1] < 1 THEN ceil(ln(0.5) / ln(1 - f[-1]))::BIGINT END AS tickets_for_half FROM pm"""


@plan("k06_coverage", SAMPLES + PMF)
def coverage(spark, sf_dir):
    return tickets.coverage(samples(spark, sf_dir))


@plan(
    "k06_coverage_modes",
    INPUTS
    + """,
rk AS (SELECT slate_id, position, list_sort([p_home, p_draw, p_away]) AS o, match_id % 3 AS d, match_id % 5 AS f FROM i),
md AS (SELECT slate_id, unnest(['simple', 'doubles', 'full']) AS mode, unnest([list(o[3] ORDER BY position), list(CASE WHEN d = 2 THEN least(o[3] + o[2], 1) ELSE o[3] END ORDER BY position), list(CASE f WHEN 2 THEN least(o[3] + o[2], 1) WHEN 3 THEN 1.0 ELSE o[3] END ORDER BY position)]) AS p FROM rk GROUP BY 1),
mf AS (SELECT *, len(p) AS n, list_reduce(list_prepend([1.0::DOUBLE], list_transform(p, lambda x: [x])), lambda acc, x: list_transform(range(1, len(acc) + 2), lambda i: coalesce(acc[i], 0) * (1 - x[1]) + CASE WHEN i > 1 THEN acc[i - 1] ELSE 0 END * x[1])) AS g FROM md),
mt AS (SELECT *, greatest(1, least(ceil(n * 0.9)::BIGINT, n)) AS t, greatest(1, n // 2) AS lo FROM mf)
SELECT slate_id, mode, round(list_sum(p), 4) AS expected, t AS target_floor, round(list_sum(g[t + 1:]), 6) AS target_probability, round(list_sum(g[t + 1:]), 6) >= 0.8 AS target_met, round(g[n + 1], 6) AS jackpot, round(CASE WHEN n >= 2 THEN g[n] + g[n + 1] ELSE g[n + 1] END, 6) AS near_jackpot,
  CASE WHEN g[n + 1] > 0 AND g[n + 1] < 1 THEN ceil(ln(0.5) / ln(1 - g[n + 1]))::BIGINT END AS tickets_for_half, k AS hits, round(list_sum(g[k + 1:]), 6) AS chance FROM mt, unnest(range(lo, n + 1)) r(k)""",
)
def coverage_modes(spark, sf_dir):
    """All three tickets of each slate; ranks follow from match_id, the legal tickets of k09 have the same shape."""
    k = F.col("match_id")
    return tickets.coverage_modes(inputs(spark, sf_dir).withColumns({"doubles_rank": F.when(k % 3 > 0, k % 3), "full_rank": F.when(k % 5 > 0, F.least(k % 5, F.lit(4)))}))


@plan(
    "k15_prices",
    """.
t AS (SELECT match_id, CASE match_id % 4 WHEN 0 THEN 'weekend' WHEN 1 THEN 'midweek' WHEN 2 THEN 'revancha' ELSE 'unknown' END AS week_type, match_id % 10 AS doubles, match_id % 6 AS triples FROM matches),
c AS (SELECT *, (pow(2, doubles) * pow(3, triples))::BIGINT AS combinations, CASE week_type WHEN 'weekend' THEN 8 ELSE 3 END AS md, CASE week_type WHEN 'weekend' THEN 5 ELSE 2 END AS mt, CASE week_type WHEN 'weekend' THEN 324 ELSE 72 END AS mc,
  CASE week_type WHEN 'weekend' THEN 15.0::DOUBLE WHEN 'midweek' THEN 15.0::DOUBLE WHEN 'revancha' THEN 5.0::DOUBLE END AS price FROM t)
SELECT match_id, week_type, doubles, triples, combinations, array_to_string(list_filter([CASE WHEN doubles > md THEN 'too_many_doubles' END, CASE WHEN triples > mt THEN 'too_many_triples' END, CASE WHEN combinations > mc THEN 'too_many_combinations' END], lambda f: f IS NOT NULL), ',') AS violations,
  combinations * price AS cost FROM c""",
)
def prices(spark, sf_dir):
    k = F.col("match_id")
    kind = F.when(k % 4 == 0, "weekend").when(k % 4 == 1, "midweek").when(k % 4 == 2, "revancha").otherwise("unknown")
    return tickets.priced(derive.matches(spark, sf_dir).select("match_id", kind.alias("week_type"), (k % 10).alias("doubles"), (k % 6).alias("triples")))


@plan("k01_optimised_ticket")
def optimised_ticket(spark, sf_dir):
    found = tickets.optimised(samples(spark, sf_dir), 3, 2)
    return found.withColumn("log_clean", F.round("log_clean", 9))


@plan("k02_covered_plans")
def covered_plans(spark, sf_dir):
    found = tickets.covered_plans(samples(spark, sf_dir), 3, 2)
    return found.withColumns({"chance": F.round("chance", 9), "expected": F.round("expected", 9)})


@plan("k03_least_budgets")
def least_budgets(spark, sf_dir):
    return tickets.budgets(samples(spark, sf_dir), 0.8, 3, 2).withColumn("chance", F.round("chance", 9))


def weekly(spark, sf_dir):
    kind = F.when(F.col("slate_id") % 3 == 0, "weekend").when(F.col("slate_id") % 3 == 1, "midweek").otherwise("revancha")
    return inputs(spark, sf_dir).withColumn("week_type", kind)


@plan("k09_legal_tickets")
def legal_tickets(spark, sf_dir):
    return tickets.legal_tickets(weekly(spark, sf_dir))


@plan(
    "k12_draw_risks",
    INPUTS
    + """, dr AS (SELECT *, 1 + (p_home > p_draw)::INT + (p_away > p_draw)::INT AS k, 1 + (p_home >= p_draw)::INT + (p_away > p_draw)::INT AS place, 1 + position % 2 AS dbl, 1 + position % 3 AS ful FROM i)
SELECT match_id, round(p_draw, 4) AS p_draw, k AS draw_rank, p_draw >= 0.25 AS is_live_draw, p_draw >= 0.3 AS is_strong_draw, place <= 1 AS covered_simple, place <= dbl AS covered_doubles, place <= ful AS covered_full FROM dr""",
)
def draw_risks(spark, sf_dir):
    rows = inputs(spark, sf_dir).withColumns({"doubles_rank": 1 + F.col("position") % 2, "full_rank": 1 + F.col("position") % 3})
    return tickets.draw_risk(rows)


@plan(
    "k16_ticket_totals",
    INPUTS
    + """, tt AS (SELECT slate_id, 1 + position % 3 AS rank, match_id % 4 = 0 AS ns FROM i)
SELECT slate_id, count(*) FILTER (WHERE rank = 1) AS simples, count(*) FILTER (WHERE rank = 2) AS doubles, count(*) FILTER (WHERE rank = 3) AS triples, product(rank)::BIGINT AS combinations, count(*) FILTER (WHERE ns AND rank = 1) AS uncovered_no_simple,
  count(*) FILTER (WHERE ns AND rank = 1) = 0 AS covers_all_no_simple FROM tt GROUP BY 1""",
)
def ticket_totals(spark, sf_dir):
    rows = inputs(spark, sf_dir).select("slate_id", "position", (1 + F.col("position") % 3).alias("rank"), (F.col("match_id") % 4 == 0).alias("no_simple"))
    return tickets.ticket_totals(rows)


@plan(
    "k11_risk_profile",
    INPUTS
    + """,
o AS (SELECT *, list_sort([p_home, p_draw, p_away])[1] AS third, greatest(evidence, h2h) AS anchors, round(top - second, 9) AS gap FROM b),
e AS (SELECT *, -(greatest(top, 0.001) * ln(greatest(top, 0.001)) + greatest(second, 0.001) * ln(greatest(second, 0.001)) + greatest(third, 0.001) * ln(greatest(third, 0.001))) / ln(3) AS ent FROM o),
k AS (SELECT *, ent + CASE band WHEN 'high' THEN -0.08 WHEN 'medium' THEN 0.02 WHEN 'low' THEN 0.14 ELSE 0.16 END + CASE WHEN anchors <= 0 THEN 0.08 WHEN anchors < 2 THEN 0.03 ELSE -0.02 END
  + CASE WHEN gap <= 0.08 THEN 0.14 WHEN gap <= 0.14 THEN 0.08 WHEN gap <= 0.22 THEN 0.03 ELSE -0.04 END + CASE WHEN third >= 0.24 THEN 0.09 WHEN third >= 0.20 THEN 0.05 ELSE 0 END AS risk FROM e)
SELECT match_id, round(ent, 6) AS entropy, round(gap, 6) AS top_gap, round(risk, 6) AS risk, round(risk + second * 0.7 - gap * 0.35, 6) AS double_score, round(risk + third * 1.45 - gap * 0.18 - (second - third) * 0.1, 6) AS triple_score FROM k""",
)
def risk_profile(spark, sf_dir):
    rows = banded(spark, sf_dir).withColumn("anchors", F.greatest("evidence", "h2h"))
    return tickets.risk_profile(rows)
