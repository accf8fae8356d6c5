"""Learning reports over scored positions: error attribution, shadow economics, ticket strategies.

Positions: match_id, slate_id, position, p_home, p_draw, p_away, prediction and actual (signs L, E, V; null: unknown), status, level, conflict, money_blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SIGNS = {"L": "p_home", "E": "p_draw", "V": "p_away"}
#: Statuses in which the guardrail has stepped in.
ENGAGED = ["BLOQUEADO", "REVISAR"]
#: Strategy, what ranks positions for doubles, most doubles (null: all). The two budgets are whole powers of two.
STRATEGIES = [
    ("top1_only", "margin", 0), ("top2_all", "margin", None), ("uncertainty_4_doubles", "margin", 4), ("uncertainty_6_doubles", "margin", 6),
    ("guardrail_first_6_doubles", "guardrail", 6), ("budget_32", "margin", 5), ("budget_128", "margin", 7),
]


def sign(code: Column) -> Column:
    return F.when(code == "1", "L").when(code == "X", "E").when(code == "2", "V")


def positions(decided: DataFrame, sourced: DataFrame, canonical_rows: DataFrame) -> DataFrame:
    """Positions of decided predictions (P, status, level, slate_id, position). sourced: match_id, is_conflicting, one row a match; no canonical row: no result."""
    rows = decided.join(sourced.select("match_id", F.col("is_conflicting").alias("conflict")), "match_id", "left").join(canonical_rows.select("match_id", "result_code"), "match_id", "left")
    top = F.greatest(*SIGNS.values())
    pick = F.when(F.col("p_home") == top, "L").when(F.col("p_away") == top, "V").otherwise("E")
    return rows.select(
        "match_id", "slate_id", "position", *SIGNS.values(), "status", "level", pick.alias("prediction"), sign(F.col("result_code")).alias("actual"), F.coalesce("conflict", F.lit(False)).alias("conflict"), (F.col("slate_id") % 5 == 0).alias("money_blocked")
    )


def attribution(rows: DataFrame) -> DataFrame:
    """Why a position was right or wrong, by precedence, and whether it should have been blocked (M01). The money-mode label stands beside the error, never in its place."""
    conflict, missing = F.col("conflict"), F.col("actual").isNull() | F.col("prediction").isNull()
    engaged, low, hit = F.col("status").isin(ENGAGED), F.col("level") == "low", F.col("prediction") == F.col("actual")
    top = F.greatest(*SIGNS.values())
    favourite = F.when(F.col("p_home") == top, "L").when(F.col("p_draw") == top, "E").otherwise("V")
    own = F.when(F.col("prediction") == "L", F.col("p_home")).when(F.col("prediction") == "E", F.col("p_draw")).otherwise(F.col("p_away"))
    error = (
        F.when(conflict, "result_conflict").when(missing, "data_quality_issue").when(hit & engaged, "guardrail_missed").when(hit, "correct")
        .when(low & engaged, "low_evidence_correctly_blocked").when(engaged, "guardrail_saved").when(F.col("actual") == "E", "draw_underestimated")
        .when((F.col("prediction") == favourite) & (own >= 0.5), "favorite_overestimated").when(F.col("prediction") == "V", "away_overestimated").otherwise("wrong_favorite")
    )
    judged = ~conflict & ~missing
    money = F.when(judged & F.col("money_blocked"), F.when(hit, "money_mode_too_conservative").otherwise("money_mode_correctly_blocked"))
    should = F.coalesce(judged & ~hit & ~engaged & ~F.col("money_blocked"), F.lit(False))
    return rows.select("match_id", "slate_id", error.alias("error_type"), (~judged).alias("missing_data"), should.alias("should_have_blocked"), money.alias("money_mode_label"), (money == "money_mode_correctly_blocked").alias("money_mode_correct"))


def actual_rank() -> Column:
    """How many signs stand before the actual one, by probability, then in the order L, E, V."""
    h, d, a = (F.col(c) for c in SIGNS.values())
    before = lambda *tests: sum(t.cast("long") for t in tests)
    return F.when(F.col("actual") == "L", before(d > h, a > h)).when(F.col("actual") == "E", before(h >= d, a > d)).when(F.col("actual") == "V", before(h >= a, d >= a))


def ratio(x: Column, y: Column) -> Column:
    return F.round(F.try_divide(x.cast("double"), y.cast("double")), 4)


def economics(rows: DataFrame, unit_cost: float = 1.0) -> DataFrame:
    """Per slate and strategy (top one, top two, all three signs): combinations, cost, covered positions, break-even payout (M02). Without a payout there is no return."""
    slates = rows.groupBy("slate_id").agg(F.count(F.lit(1)).alias("positions"), F.count("actual").alias("scorable"), *(F.count_if(actual_rank() < k).alias(f"in_{k}") for k in (1, 2, 3)))
    each = slates.select("*", F.explode(F.array(*(F.struct(F.lit(n).alias("strategy"), F.lit(k).alias("k"), F.col(f"in_{k}").alias("covered")) for n, k in (("model_top1", 1), ("model_top2", 2), ("full_cover", 3))))).alias("s"))
    complete = F.col("scorable") == F.col("positions")
    perfect = complete & (F.col("s.covered") == F.col("positions"))
    combinations = F.pow(F.col("s.k").cast("double"), F.col("positions"))
    cost = combinations * unit_cost
    return each.select("slate_id", "s.strategy", "positions", F.col("scorable").alias("scorable_positions"), F.col("s.covered").alias("covered_positions"), perfect.alias("perfect_covered"), complete.alias("complete"), combinations.alias("combinations"), cost.alias("cost_units"), F.when(perfect, cost).alias("break_even_payout_units"))


def economics_summary(per_slate: DataFrame) -> DataFrame:
    """Over all slates."""
    return per_slate.groupBy("strategy").agg(F.count(F.lit(1)).alias("slate_count"), F.count_if("complete").alias("complete_count"), F.count_if("perfect_covered").alias("perfect_count"), F.round(F.sum("cost_units"), 4).alias("total_cost_units"))


def strategies(rows: DataFrame, unit_cost: float = 1.0) -> DataFrame:
    """Per slate and strategy: how many positions its singles and doubles cover, and what it costs (M04). Doubles go to the closest positions, of those that the guardrail holds back first where the strategy says so."""
    p = F.array_sort(F.array(*SIGNS.values()))
    margin = F.round(p[2] - p[1], 6)
    slate = W.partitionBy("slate_id")
    ranked = rows.withColumn("margin", margin).withColumn("held", F.col("status").isin(ENGAGED).cast("int")).select(
        "slate_id", "actual", actual_rank().alias("rank"), F.row_number().over(slate.orderBy("margin", "position")).alias("by_margin"), F.row_number().over(slate.orderBy(F.desc("held"), "margin", "position")).alias("by_guardrail"),
    )
    everything = 1 << 30
    plans = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(n).alias("strategy"), F.lit(everything if most is None else most).alias("most"), F.col(f"by_{kind}").alias("order")) for i, (n, kind, most) in enumerate(STRATEGIES)))
    each = ranked.select("slate_id", "actual", "rank", F.explode(plans).alias("s")).select("slate_id", "actual", "rank", "s.*")
    covered = F.col("rank") < F.when(F.col("order") <= F.col("most"), 2).otherwise(1)
    sums = each.groupBy("slate_id", "place", "strategy").agg(F.count(F.lit(1)).alias("positions"), F.count("actual").alias("scorable_positions"), F.count_if(covered).alias("covered_positions"), F.count_if(F.col("order") <= F.col("most")).alias("double_count"))
    complete = F.col("scorable_positions") == F.col("positions")
    perfect = complete & (F.col("covered_positions") == F.col("positions"))
    combinations = F.pow(F.lit(2.0), F.col("double_count"))
    return sums.select(
        "slate_id", "place", "strategy", "positions", "scorable_positions", "covered_positions", ratio(F.col("covered_positions"), F.col("scorable_positions")).alias("coverage_rate"), perfect.alias("perfect_covered"), "double_count", combinations.alias("combinations"),
        (combinations * unit_cost).alias("cost_units"), F.when(perfect, combinations * unit_cost).alias("break_even_payout_units"), complete.alias("complete"),
    )


def best_strategies(per_slate: DataFrame) -> DataFrame:
    """Each slate's best strategy: perfect, then most covered, then cheapest, then first of the list."""
    order = F.struct((~F.col("perfect_covered")).alias("a"), (-F.col("covered_positions")).alias("b"), F.col("cost_units").alias("c"), F.col("place").alias("d"))
    best = per_slate.groupBy("slate_id").agg(F.min_by(F.struct("strategy", "covered_positions", "perfect_covered", "cost_units"), order).alias("r"))
    return best.select("slate_id", "r.*")


def strategy_summary(per_slate: DataFrame) -> DataFrame:
    """Over all slates, and which strategy is best: most perfect slates, then most covered, then cheapest, then first of the list."""
    sums = per_slate.groupBy("place", "strategy").agg(
        F.count(F.lit(1)).alias("slate_count"), F.count_if("complete").alias("complete_count"), F.count_if("perfect_covered").alias("perfect_count"), F.sum("covered_positions").alias("covered_positions"), F.sum("positions").alias("positions"), F.round(F.sum("cost_units"), 4).alias("total_cost_units"),
    )
    best = sums.agg(F.min_by("strategy", F.struct((-F.col("perfect_count")).alias("a"), (-F.col("covered_positions")).alias("b"), F.col("total_cost_units").alias("c"), F.col("place").alias("d"))).alias("best"))  # one row
    return sums.join(F.broadcast(best)).select("strategy", "slate_count", "complete_count", "perfect_count", "covered_positions", "positions", "total_cost_units", ratio(F.col("covered_positions"), F.col("positions")).alias("coverage_rate"), (F.col("strategy") == F.col("best")).alias("is_best"))
