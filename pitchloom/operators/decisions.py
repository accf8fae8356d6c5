"""Decision guardrails as columns: bands, evidence, caps, status, risk, draw calibration, presentation. All rows are independent: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import entropy

#: Fixed values of the policy.
EXTREME, LOW_CAP, FRIENDLY_CAP, HIGH_CAP, SUSPICIOUS = 0.75, 0.60, 0.65, 0.90, 0.05
CONFIDENCE = ["baja", "media-baja", "media", "alta"]
DRAW_GAP, DRAW_LIFT, DRAW_MOST, DRAW_MARGIN = 0.06, 0.35, 0.08, 0.03

P = ("p_home", "p_draw", "p_away")


def c(name: str) -> Column:
    return F.col(name)


def insufficient() -> Column:
    """Fewer than 4 anchors, or neither both sides with form nor a head-to-head history."""
    sides = (c("home_recent") >= 2) & (c("away_recent") >= 2)
    return (c("home_recent") + c("away_recent") + c("h2h") < 4) | ~(sides | (c("h2h") >= 3))


def anchored() -> Column:
    return (c("evidence") >= 1) | (c("h2h") >= 2) | ((c("home_recent") >= 3) & (c("away_recent") >= 3))


def evidence_level(deep_recent: int = 5, deep_h2h: int = 3) -> Column:
    """low, medium or high."""
    deep = ((c("home_recent") >= deep_recent) & (c("away_recent") >= deep_recent)) | (c("h2h") >= deep_h2h)
    return F.when(insufficient() | ~anchored(), "low").when(deep & (c("evidence") >= 1), "high").otherwise("medium")


def top_two() -> tuple[Column, Column]:
    ordered = F.array_sort(F.array(*P))
    return ordered[2], ordered[1]


def confidence_band() -> Column:
    """blocked, high, medium or low."""
    top, second = top_two()
    spread = F.round(top - second, 9)
    return F.when(insufficient(), "blocked").when((top >= 0.55) & (spread >= 0.12) & anchored(), "high").when((top >= 0.40) & (spread >= 0.02) & anchored(), "medium").otherwise("low")


def context_adjusted(rows: DataFrame) -> DataFrame:
    """Moves at most 0.1 towards the side that `edge` favours, partly out of the draw; sums to 1 (J02, J03). Only rows with context move."""
    moves = ((c("evidence") > 0) | (c("h2h") > 0)) & (F.abs("edge") >= 0.01)
    swing = F.least(F.abs("edge") * 0.06, F.lit(0.1))
    cut = F.least(F.greatest(c("p_draw") - 0.12, F.lit(0.0)), swing * 0.35)
    up, down = (lambda p: c(p) + swing + cut / 2), (lambda p: F.greatest(c(p) - swing, F.lit(0.05)))
    to_home = c("edge") > 0
    new = [F.when(to_home, up("p_home")).otherwise(down("p_home")), c("p_draw") - cut, F.when(to_home, down("p_away")).otherwise(up("p_away"))]
    moved = rows.select(*(x for x in rows.columns if x not in P), *(F.when(moves, n).otherwise(c(p)).alias(p) for n, p in zip(new, P, strict=True)))
    total = c("p_home") + c("p_draw") + c("p_away")
    return moved.select(*(x for x in rows.columns if x not in P), *((c(p) / total).alias(p) for p in P))


def knockout_adjusted(rows: DataFrame, least: float = 0.10, most: float = 0.25) -> DataFrame:
    """In knockouts a share of the draw goes to the sides, more where more goals are expected (J04). The share's band is the competition's (columns shrink_min and shrink_max, see I18), or the given one where rows have none."""
    low, high = (c(x) if x in rows.columns else F.lit(y) for x, y in (("shrink_min", least), ("shrink_max", most)))
    share = low + (high - low) * F.least(F.greatest((c("expected_goals") - 1.0) / 3.0, F.lit(0.0)), F.lit(1.0))
    share = F.when((c("home_recent") < 1) & (c("away_recent") < 1), low).otherwise(share)
    freed, sides = c("p_draw") * F.when(c("is_knockout"), share).otherwise(F.lit(0.0)), c("p_home") + c("p_away")
    part = lambda p: F.when(sides > 1e-9, c(p) / sides).otherwise(F.lit(0.5))
    others = [x for x in rows.columns if x not in (*P, "shrink_min", "shrink_max")]
    return rows.select(*others, (c("p_home") + freed * part("p_home")).alias("p_home"), (c("p_draw") - freed).alias("p_draw"), (c("p_away") + freed * part("p_away")).alias("p_away"))


def sanity(rows: DataFrame) -> DataFrame:
    """Flags, caps, status, risk and visible confidence (J10 to J13). rows: P, band, level, is_friendly, fallback_used.

    A cap draws the whole vector towards the uniform one until its top stands at the cap.
    """
    top = F.greatest(*P)
    high, low = c("level") == "high", c("level") == "low"
    extreme = (top >= EXTREME) & ~high
    suspicious = F.least("p_home", "p_away") <= SUSPICIOUS
    cap = F.least(F.lit(HIGH_CAP), F.when(low, LOW_CAP).otherwise(HIGH_CAP), F.when((c("is_friendly") & ~high) | extreme, FRIENDLY_CAP).otherwise(HIGH_CAP))
    rows = rows.select("*", top.alias("top"), extreme.alias("extreme"), suspicious.alias("suspicious"), cap.alias("cap"))
    keep = F.when(c("top") > c("cap"), (c("cap") - 1 / 3) / (c("top") - 1 / 3)).otherwise(F.lit(1.0))
    capped = c("top") > c("cap") + 1e-6
    before = F.when(c("band") == "blocked", "BLOQUEADO").when(c("band") == "high", "FIJO").when(c("band") == "medium", "LISTO").otherwise("REVISAR")
    status = F.when(before == "BLOQUEADO", "BLOQUEADO").when(low | c("extreme"), "REVISAR").when((before == "FIJO") & (c("fallback_used") | c("is_friendly")), "LISTO").otherwise(before)
    flags = {
        "LOW_EVIDENCE": low, "INTERNATIONAL_FRIENDLY": c("is_friendly"), "FALLBACK_USED": c("fallback_used"), "BLOCKED_INSUFFICIENT_DATA": c("band") == "blocked",
        "SUSPICIOUS_CLASS_PROBABILITY": c("suspicious"), "EXTREME_PROBABILITY_WITHOUT_EVIDENCE": c("extreme"), "EXTREME_PROBABILITY_CAPPED": capped, "FRIENDLY_UNCERTAINTY_PENALTY": capped & c("is_friendly"),
    }
    out = rows.select(
        *(x for x in rows.columns if x not in (*P, "top", "cap")), *((keep * c(p) + (1 - keep) / 3).alias(p) for p in P), status.alias("status"),
        F.array_compact(F.array(*(F.when(on, name) for name, on in flags.items()))).alias("flags"),
    )
    risk = F.when(c("status").isin("REVISAR", "BLOQUEADO") | c("extreme") | c("suspicious") | low, "high").when((c("status") == "LISTO") | (c("level") == "medium"), "medium").otherwise("low")
    out = out.withColumn("risk", risk)
    start = F.when(c("status") == "BLOQUEADO", 0).when(c("status") == "REVISAR", 1).when(c("status") == "LISTO", 2).otherwise(3)
    limit = F.least(F.when(low | c("fallback_used") | c("extreme") | c("suspicious") | (c("band") == "blocked") | (c("risk") == "high"), 1).otherwise(3), F.when(c("is_friendly"), 2).otherwise(3))
    visible = F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.least(start, limit) + 1)
    single = low | c("fallback_used") | c("extreme") | c("suspicious")
    strategy = F.when(c("status") == "BLOQUEADO", "EVITAR").when((c("status") == "REVISAR") | (c("risk") == "high"), "NO_DEJAR_SIMPLE").when(single | (c("status") == "LISTO"), "DOBLE_RECOMENDADO").otherwise("SIMPLE")
    return out.select("*", visible.alias("visible_confidence"), strategy.alias("strategy"))


def draw_calibrated(rows: DataFrame, prior: float) -> DataFrame:
    """Lifts a draw that stands well below the prior where the pick is uncertain, never up to the top."""
    top, second = top_two()
    level = entropy(*map(F.col, P))
    uncertain = c("band").isin("low", "blocked") | (c("level") == "low") | c("status").isin("REVISAR", "BLOQUEADO") | (F.round(top - second, 9) <= 0.15) | (level >= 0.90)
    target = F.least(c("p_draw") + DRAW_LIFT * (prior - c("p_draw")), c("p_draw") + DRAW_MOST, top - DRAW_MARGIN)
    applied = uncertain & (F.round(prior - c("p_draw"), 9) >= DRAW_GAP) & (target > c("p_draw") + 1e-6)
    reason = F.when(~uncertain, "high_confidence_unchanged").when(F.round(prior - c("p_draw"), 9) < DRAW_GAP, "draw_already_sufficient").when(~applied, "lift_below_threshold").otherwise("lifted")
    lift, sides = F.when(applied, target - c("p_draw")).otherwise(F.lit(0.0)), c("p_home") + c("p_away")
    others = [x for x in rows.columns if x not in P]
    new = [c("p_home") * (1 - lift / sides), c("p_draw") + lift, c("p_away") * (1 - lift / sides)]
    return rows.select(*others, *(n.alias(p) for n, p in zip(new, P, strict=True)), applied.alias("draw_lifted"), reason.alias("draw_reason"))


def guarded(rows: DataFrame) -> DataFrame:
    """Whether a single pick may be shown, why not, and the band that is shown."""
    has = lambda name: F.array_contains("flags", name)
    reasons = {
        "blocked": c("status") == "BLOQUEADO", "review": c("status") == "REVISAR", "risk_high": c("risk") == "high", "no_dejar_simple": c("strategy") == "NO_DEJAR_SIMPLE",
        "requires_coverage": ~c("strategy").isin("SIMPLE", "NO_DEJAR_SIMPLE"), "suspicious_class": has("SUSPICIOUS_CLASS_PROBABILITY"), "fallback_low_evidence": c("fallback_used") & has("LOW_EVIDENCE"),
    }
    found = F.array_compact(F.array(*(F.when(on, name) for name, on in reasons.items())))
    rows = rows.withColumn("reasons", found).withColumn("simple_allowed", (c("strategy") == "SIMPLE") & (F.size("reasons") == 0))
    extreme, low = has("EXTREME_PROBABILITY_WITHOUT_EVIDENCE"), has("LOW_EVIDENCE")
    shown = (
        F.when(c("status") == "BLOQUEADO", "blocked").when(c("fallback_used") & extreme & low & ~c("simple_allowed"), "unreliable").when(c("status") == "REVISAR", "review")
        .when(has("EXTREME_PROBABILITY_CAPPED") | extreme, "review").when(low | c("draw_lifted") | (c("fallback_used") & (c("band") == "high")), "low")
        .when((c("band") == "high") & ~c("simple_allowed"), "review").otherwise(c("band"))
    )
    return rows.withColumn("shown_band", shown)


def slate_dates(rows: DataFrame) -> DataFrame:
    """Status of a slate's closing date by ordered rules (B13). rows: closes_at, created_at, observed_at, prev_closes_at, confidence, has_fixtures, other_contest."""
    at = lambda x: F.unix_seconds(x)
    status = (
        F.when(c("closes_at").isNull() & c("other_contest"), "source_invalid").when(c("closes_at").isNull() & c("has_fixtures"), "needs_official_pdf_date").when(c("closes_at").isNull(), "needs_operator_confirmation")
        .when(c("confidence") == "low", "stale_source").when(at("closes_at") < at("created_at") - 12 * 3600, "stale_source").when(at("closes_at") < at("observed_at") - 3 * 86400, "stale_source")
        .when(at("closes_at") <= at("prev_closes_at"), "date_suspect").otherwise("date_valid")
    )
    return rows.withColumn("date_status", status)
