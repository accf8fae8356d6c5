"""Plans of learning reports."""

from __future__ import annotations

from pitchloom.operators import decisions, learning, results
from pitchloom.sources import derive

from .core import plan
from .decisions import SANE, banded

POSITIONS = (
    SANE
    + """,
info AS (SELECT match_id, min(result_code) <> max(result_code) AS conflict FROM results GROUP BY 1),
pos AS (SELECT s.match_id, s.slate_id, s.position, s.p_home, s.p_draw, s.p_away, s.status, s.level, CASE WHEN s.p_home >= s.p_draw AND s.p_home >= s.p_away THEN 'L' WHEN s.p_away >= s.p_draw THEN 'V' ELSE 'E' END AS prediction,
  CASE c.result_code WHEN '1' THEN 'L' WHEN 'X' THEN 'E' WHEN '2' THEN 'V' END AS actual, coalesce(i.conflict, false) AS conflict, s.slate_id % 5 = 0 AS money_blocked, s.status IN ('BLOQUEADO', 'REVISAR') AS engaged
  FROM san s LEFT JOIN info i ON i.match_id = s.match_id LEFT JOIN canon c ON c.match_id = s.match_id),
px AS (SELECT *, prediction = actual AS hit, CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 'L' WHEN p_draw >= p_away THEN 'E' ELSE 'V' END AS favourite, CASE prediction WHEN 'L' THEN p_home WHEN 'E' THEN p_draw ELSE p_away END AS own,
  CASE actual WHEN 'L' THEN (p_draw > p_home)::INT + (p_away > p_home)::INT WHEN 'E' THEN (p_home >= p_draw)::INT + (p_away > p_draw)::INT WHEN 'V' THEN (p_home >= p_away)::INT + (p_draw >= p_away)::INT END AS rk,
  round(list_sort([p_home, p_draw, p_away])[3] - list_sort([p_home, p_draw, p_away])[2], 6) AS margin FROM pos)
"""
)


def positions(spark, sf_dir):
    sourced = derive.results(spark, sf_dir)
    return learning.positions(decisions.sanity(banded(spark, sf_dir)), results.with_conflicts(sourced), results.canonical(sourced))


@plan(
    "m01_error_attribution",
    POSITIONS
    + """, ma AS (SELECT *, NOT conflict AND actual IS NOT NULL AS judged FROM px)
SELECT match_id, slate_id, CASE WHEN conflict THEN 'result_conflict' WHEN actual IS NULL THEN 'data_quality_issue' WHEN hit AND engaged THEN 'guardrail_missed' WHEN hit THEN 'correct' WHEN level = 'low' AND engaged THEN 'low_evidence_correctly_blocked'
  WHEN engaged THEN 'guardrail_saved' WHEN actual = 'E' THEN 'draw_underestimated' WHEN prediction = favourite AND own >= 0.5 THEN 'favorite_overestimated' WHEN prediction = 'V' THEN 'away_overestimated' ELSE 'wrong_favorite' END AS error_type,
  NOT judged AS missing_data, judged AND coalesce(NOT hit, false) AND NOT engaged AND NOT money_blocked AS should_have_blocked,
  CASE WHEN judged AND money_blocked AND hit THEN 'money_mode_too_conservative' WHEN judged AND money_blocked THEN 'money_mode_correctly_blocked' END AS money_mode_label, CASE WHEN judged AND money_blocked THEN NOT hit END AS money_mode_correct FROM ma""",
)
def error_attribution(spark, sf_dir):
    return learning.attribution(positions(spark, sf_dir))


ECONOMICS = (
    POSITIONS
    + """,
es AS (SELECT slate_id, count(*) AS positions, count(actual) AS scorable_positions, count(*) FILTER (WHERE rk < 1) AS c1, count(*) FILTER (WHERE rk < 2) AS c2, count(*) FILTER (WHERE rk < 3) AS c3 FROM px GROUP BY 1),
ee AS (SELECT slate_id, positions, scorable_positions, unnest([{'s': 'model_top1', 'k': 1, 'c': c1}, {'s': 'model_top2', 'k': 2, 'c': c2}, {'s': 'full_cover', 'k': 3, 'c': c3}]) AS x FROM es),
ec AS (SELECT slate_id, x.s AS strategy, positions, scorable_positions, x.c AS covered_positions, scorable_positions = positions AND x.c = positions AS perfect_covered, scorable_positions = positions AS complete, pow(x.k::DOUBLE, positions) AS combinations,
  pow(x.k::DOUBLE, positions) AS cost_units, CASE WHEN scorable_positions = positions AND x.c = positions THEN pow(x.k::DOUBLE, positions) END AS break_even_payout_units FROM ee)
"""
)


@plan("m02_economic_shadow", ECONOMICS + "SELECT * FROM ec")
def economic_shadow(spark, sf_dir):
    return learning.economics(positions(spark, sf_dir))


@plan("m03_economic_summary", ECONOMICS + "SELECT strategy, count(*) AS slate_count, count(*) FILTER (WHERE complete) AS complete_count, count(*) FILTER (WHERE perfect_covered) AS perfect_count, round(sum(cost_units), 4) AS total_cost_units FROM ec GROUP BY 1")
def economic_summary(spark, sf_dir):
    return learning.economics_summary(learning.economics(positions(spark, sf_dir)))


VALUES = ", ".join(f"({i}, '{n}', '{kind}', {'1 << 30' if most is None else most})" for i, (n, kind, most) in enumerate(learning.STRATEGIES))
STRATEGY_SQL = (
    POSITIONS
    + f""",
sr AS (SELECT slate_id, actual, rk, row_number() OVER (PARTITION BY slate_id ORDER BY margin, position) AS by_margin, row_number() OVER (PARTITION BY slate_id ORDER BY engaged DESC, margin, position) AS by_guardrail FROM px),
sp AS (SELECT * FROM (VALUES {VALUES}) x(place, strategy, kind, most)),
sx AS (SELECT *, CASE kind WHEN 'margin' THEN by_margin ELSE by_guardrail END <= most AS doubled FROM sr, sp),
ss AS (SELECT slate_id, place, strategy, count(*) AS positions, count(actual) AS scorable_positions, count(*) FILTER (WHERE rk < CASE WHEN doubled THEN 2 ELSE 1 END) AS covered_positions, count(*) FILTER (WHERE doubled) AS double_count FROM sx GROUP BY ALL),
sc AS (SELECT slate_id, place, strategy, positions, scorable_positions, covered_positions, round(covered_positions::DOUBLE / nullif(scorable_positions, 0), 4) AS coverage_rate, scorable_positions = positions AND covered_positions = positions AS perfect_covered, double_count,
  pow(2.0::DOUBLE, double_count) AS combinations, pow(2.0::DOUBLE, double_count) AS cost_units, CASE WHEN scorable_positions = positions AND covered_positions = positions THEN pow(2.0::DOUBLE, double_count) END AS break_even_payout_units, scorable_positions = positions AS complete FROM ss)
"""
)


@plan("m04_ticket_strategies", STRATEGY_SQL + "SELECT * EXCLUDE place FROM sc")
def ticket_strategies(spark, sf_dir):
    return learning.strategies(positions(spark, sf_dir)).drop("place")


@plan("f04_best_strategies", STRATEGY_SQL + "SELECT slate_id, strategy, covered_positions, perfect_covered, cost_units FROM sc QUALIFY row_number() OVER (PARTITION BY slate_id ORDER BY perfect_covered DESC, covered_positions DESC, cost_units, place) = 1")
def best_strategies(spark, sf_dir):
    return learning.best_strategies(learning.strategies(positions(spark, sf_dir)))


@plan(
    "m05_strategy_summary",
    STRATEGY_SQL
    + """, sm AS (SELECT place, strategy, count(*) AS slate_count, count(*) FILTER (WHERE complete) AS complete_count, count(*) FILTER (WHERE perfect_covered) AS perfect_count, sum(covered_positions)::BIGINT AS covered_positions, sum(positions)::BIGINT AS positions,
  round(sum(cost_units), 4) AS total_cost_units FROM sc GROUP BY 1, 2)
SELECT * EXCLUDE place, round(covered_positions::DOUBLE / positions, 4) AS coverage_rate, row_number() OVER (ORDER BY perfect_count DESC, covered_positions DESC, total_cost_units, place) = 1 AS is_best FROM sm""",
)
def strategy_summary(spark, sf_dir):
    return learning.strategy_summary(learning.strategies(positions(spark, sf_dir)))
