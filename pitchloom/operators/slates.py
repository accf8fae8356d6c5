"""Slates: states, order, deadlines, snapshots, live scores, distribution reports and gates. Times are seconds since 1970.

Slates: slate_id, week_type, draw_code, match_count, first_s, last_s, closes_s (null: unknown), created_s, archived, observed, now_s.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Readiness from the least permissive on, and the most that a guessed competition may have.
READINESS = ["unclassified", "not_ready", "context_only", "covered", "ready"]
CEILING = "context_only"
#: Limits of the alarms and warnings.
MOST_AWAY, MOST_SUSPICIOUS, LEAST_MATCHES, EXTREME, LOW_CAP, FRIENDLY_CAP, SUSPICIOUS = 0.55, 0.30, 6, 0.75, 0.60, 0.65, 0.05
LEAST_SAMPLE, RAW_EXTREME, RATING_GAP = 3, 0.75, 250.0
#: What a prediction's audit must hold.
VECTORS = ["raw_probabilities", "display_probabilities", "decision_probabilities"]
FIELDS = ["final_status", "evidence_level", "sanity_policy_version"]


def c(name: str) -> Column:
    return F.col(name)


def flags(**tests: Column) -> Column:
    """The names whose test holds, in order, joined by commas."""
    return F.array_join(F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items()))), ",")


def week_type(match_count: Column, contest: Column, title: Column) -> Column:
    """By the number of matches, else by the contest's name, else by the title, else weekend."""
    has = lambda x, word: F.coalesce(F.lower(x).contains(word), F.lit(False))
    return (
        F.when(match_count == 9, "midweek").when(match_count == 7, "revancha").when(match_count == 14, "weekend").when(has(contest, "revancha"), "revancha").when(has(contest, "media"), "midweek")
        .when(has(title, "revancha"), "revancha").when(has(title, "media semana"), "midweek").otherwise("weekend")
    )


def closed() -> Column:
    """Archived, seen with a result, or past its deadline; without one, past its first kickoff."""
    return c("archived") | c("observed") | F.coalesce(c("closes_s") <= c("now_s"), c("first_s") <= c("now_s"), F.lit(False))


def active_or_future() -> Column:
    """The deadline or any kickoff is not past."""
    return F.coalesce(c("closes_s") >= c("now_s"), F.lit(False)) | F.coalesce(c("last_s") >= c("now_s"), F.lit(False))


def urgency(slates: DataFrame) -> DataFrame:
    """The keys that slates are shown by: open with a deadline, open by kickoff, closed, unknown; then seconds, week, newest."""
    is_closed, week = closed(), F.when(c("week_type") == "weekend", 0).when(c("week_type") == "midweek", 1).when(c("week_type") == "revancha", 2).otherwise(3)
    group = F.when(is_closed, 2).when(c("closes_s").isNotNull(), 0).when(c("first_s").isNotNull(), 1).otherwise(3)
    seconds = F.when(is_closed, c("now_s") - F.coalesce("closes_s", "last_s", "created_s")).otherwise(F.coalesce(c("closes_s") - c("now_s"), c("first_s") - c("now_s"), F.lit(0)))
    return slates.select("slate_id", group.alias("urgency"), seconds.alias("seconds"), week.alias("week_priority"), (-c("created_s")).alias("newest")).orderBy("urgency", "seconds", "week_priority", "newest")


def inventory_state() -> Column:
    """What a slate waits for (B15). predictions, results, conflicts: counts; comparable: its lineage can be compared."""
    open_ = F.when(F.coalesce(c("closes_s") > c("now_s"), F.lit(False)), "upcoming").otherwise("active")
    done = F.when(c("comparable") & (c("predictions") >= c("match_count")), "closed_comparable").otherwise("closed_partial_results")
    return (
        F.when(~c("archived"), open_).when(c("predictions") == 0, "archived_no_predictions").when(c("conflicts") > 0, "closed_conflict").when(c("results") == 0, "closed_pending_results")
        .when(c("results") < c("match_count"), "closed_partial_results").otherwise(done)
    )


def current(slates: DataFrame) -> DataFrame:
    """The one slate to show: of those active or to come, one with a kickoff ahead, the soonest, then the greatest draw number."""
    ahead = c("next_s").isNotNull()
    key = F.struct(ahead.alias("a"), F.when(ahead, c("now_s") - c("next_s")).otherwise(0).alias("b"), c("draw_number").alias("d"))
    return slates.where(active_or_future()).agg(F.max_by("slate_id", key).alias("slate_id"))


def previous_close(slates: DataFrame) -> DataFrame:
    """The deadline of the contest of the same kind with the next lower number, the trailing digits of its code."""
    number = F.regexp_extract("draw_code", r"(\d+)$", 1).cast("long")
    w = W.partitionBy("week_type").orderBy("number")
    return slates.withColumn("number", number).where("number is not null").select("slate_id", "number", F.lag("closes_s").over(w).alias("prev_closes_s"))


def original_snapshots(slates: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Each slate's newest valid snapshot of its composition up to the deadline, else its newest valid one."""
    own = snapshots.join(slates.select("slate_id", "closes_s", "composition_hash"), ["slate_id", "composition_hash"]).where("is_valid")
    in_time = F.coalesce(c("generated_s") <= c("closes_s"), F.lit(True))
    best = own.groupBy("slate_id").agg(F.max_by("snapshot_id", F.struct(in_time.alias("t"), c("generated_s"), c("snapshot_id"))).alias("snapshot_id"))
    return best


def preferred_predictions(wanted: DataFrame, predictions: DataFrame) -> DataFrame:
    """For each wanted (match_id, slate_id, composition_hash) the prediction of this slate, of this composition, the newest, the greatest id, in that order."""
    p = predictions.select("match_id", c("slate_id").alias("p_slate"), c("composition_hash").alias("p_hash"), "generated_s", "prediction_id")
    key = F.struct((c("p_slate") == c("slate_id")).alias("a"), (c("p_hash") == c("composition_hash")).alias("b"), c("generated_s"), c("prediction_id"))
    return wanted.join(p, "match_id").groupBy("slate_id", "match_id").agg(F.max_by("prediction_id", key).alias("prediction_id"))


def rebased(entries: DataFrame, hours: int = 12) -> DataFrame:
    """New kickoffs of made-up ladders after their deadline was corrected; only those that move (G12). entries: slate_id, position, kickoff_s, closes_s."""
    step = 3600
    base = c("kickoff_s") - (c("position") - 1) * step
    ladders = entries.groupBy("slate_id").agg(F.count(F.lit(1)).alias("n"), F.min(base).alias("low"), F.max(base).alias("high"), F.count_distinct("position").alias("p")).where("n >= 3 and low = high and p = n").select("slate_id")
    target = c("closes_s") + (hours + c("position") - 1) * step
    return entries.join(ladders, "slate_id").select("slate_id", "position", target.alias("kickoff_s"), c("kickoff_s").alias("before_s")).where("kickoff_s <> before_s").drop("before_s")


def leaks_raw(raw: list[str], shown: list[str], decided: list[str], tolerance: float = 1e-6) -> Column:
    """The shown vector differs from the raw one, and yet decisions follow the raw one."""
    differs = lambda x, y: F.greatest(*(F.abs(c(a) - c(b)) for a, b in zip(x, y, strict=True))) > tolerance
    return differs(raw, shown) & ~differs(decided, raw)


def lineage_missing(audit: str) -> Column:
    """What a prediction lacks to be traced (J18). audit: a JSON column."""
    got = lambda k: F.get_json_object(audit, f"$.{k}")
    absent = lambda x: x.isNull() | (x == "")
    no_audit = ~F.coalesce(F.trim(audit).startswith("{"), F.lit(False))
    tests = {k: absent(c(k)) for k in ("match_id", "slate_id", "composition_hash")} | {"slate_version": c("slate_version").isNull(), "recommended_outcome": absent(c("recommended_outcome")), "sanity_audit_json": no_audit}
    tests |= {f"sanity_audit.{k}": ~no_audit & (~F.coalesce(got(k).startswith("{"), F.lit(False)) | F.coalesce(got(k) == "{}", F.lit(False))) for k in VECTORS}
    tests |= {f"sanity_audit.{k}": ~no_audit & absent(got(k)) for k in FIELDS}
    tests["sanity_audit.model_artifact_id|fallback_used"] = ~no_audit & absent(got("model_artifact_id")) & (F.coalesce(got("fallback_used"), F.lit("false")) != "true")
    return flags(**tests)


def distribution(rows: DataFrame) -> DataFrame:
    """Per slate: picks, mean and greatest probabilities, counts of what should be rare, and alarms (D09). rows: P, pick (L, E, V), level, status, is_friendly."""
    p = [c("p_home"), c("p_draw"), c("p_away")]
    top, low = F.greatest(*p), c("level") == "low"
    sums = rows.groupBy("slate_id").agg(
        F.count(F.lit(1)).alias("total_matches"), *(F.count_if(c("pick") == s).alias(f"count_{s}") for s in "LEV"), *(F.round(F.avg(x), 6).alias(f"avg_p_{s}") for s, x in zip("LEV", p)), F.round(F.max(top), 6).alias("max_probability"),
        F.count_if(top >= EXTREME).alias("p_gt_75"), F.count_if(low & (top > LOW_CAP)).alias("low_evidence_p_gt_60"), F.count_if(c("is_friendly") & (top > FRIENDLY_CAP)).alias("friendly_p_gt_65"),
        F.count_if(p[0] <= SUSPICIOUS).alias("home_under_5"), F.count_if(p[2] <= SUSPICIOUS).alias("away_under_5"), F.count_if(low & c("status").isin("FIJO", "LISTO")).alias("ready_but_low"), F.count_if(low & (c("status") == "FIJO")).alias("fixed_but_low"),
    )
    away, odd, enough = c("count_V") / c("total_matches"), (c("home_under_5") + c("away_under_5")) / c("total_matches"), c("total_matches") >= LEAST_MATCHES
    alarms = flags(AWAY_BIAS=enough & (away > MOST_AWAY), SUSPICIOUS_CLASS_DISTRIBUTION=enough & (odd > MOST_SUSPICIOUS), STATUS_INTEGRITY=c("fixed_but_low") > 0)
    return sums.select("*", F.round(away, 6).alias("away_share"), F.round(odd, 6).alias("suspicious_share"), alarms.alias("alarms"))


def publication_status() -> Column:
    """Whether a slate may be played (M06). money_status, blocked_count, placeholder_count, has_data_blockers."""
    stop = c("has_data_blockers") | (c("placeholder_count") > 0) | (c("blocked_count") > 0) | (c("money_status") == "NO_JUGAR")
    return F.when(stop, "DO_NOT_PLAY").when(c("money_status") == "JUGAR_SOLO_CONSERVADOR", "PLAY_CONSERVATIVE_ONLY").when(c("money_status") == "JUGAR_BALANCEADO", "READY_TO_PLAY").otherwise("REVIEW_REQUIRED")


def capped_policy(rows: DataFrame) -> DataFrame:
    """Readiness and live-pick permission of competitions, withdrawn down to the ceiling where the competition is only guessed (J08). rows: readiness, live_pick_allowed, is_placeholder."""
    level = F.array_position(F.array(*map(F.lit, READINESS)), c("readiness"))
    over = c("is_placeholder") & (level > READINESS.index(CEILING) + 1)
    unknown = c("is_placeholder") & (level == 0)
    return rows.select("match_id", F.when(over, CEILING).otherwise(c("readiness")).alias("readiness"), (c("live_pick_allowed") & ~over & ~unknown).alias("live_pick_allowed"), c("is_placeholder").alias("competition_inferred"))


def sign_check(official: Column, scored: Column) -> Column:
    """A sign without a score against a scored result."""
    return F.when(official.isNull() | scored.isNull() | (official == "") | (scored == ""), "not_available").when(official == scored, "matches").otherwise("conflict")


def signal_warnings(rows: DataFrame) -> DataFrame:
    """Named warnings of a match's raw signal; two structural ones or more make it suspicious (M14). rows: P, level, fallback_used, is_friendly, home_recent, away_recent, rating_diff, neutral, risky_name."""
    p = [c("p_home"), c("p_draw"), c("p_away")]
    top, thin, low = F.greatest(*p), F.least("home_recent", "away_recent") < LEAST_SAMPLE, c("level") == "low"
    pick = F.when(p[0] == top, "L").when(p[2] == top, "V").otherwise("E")
    far = (pick == "V") & (p[2] >= RAW_EXTREME)
    tests = dict(
        FALLBACK_SIGNAL=c("fallback_used"), LOW_TEAM_SAMPLE=thin, RAW_ARGMAX_LOW_SUPPORT=(pick != "E") & thin, RAW_EXTREME_WITH_LOW_EVIDENCE=(top >= RAW_EXTREME) & low, SUSPICIOUS_AWAY_BIAS=far & (low | c("is_friendly")),
        SUSPICIOUS_HOME_UNDERDOG=F.coalesce(c("rating_diff") > 0, F.lit(False)) & far, RATING_DIFF_EXAGGERATED=F.coalesce(F.abs("rating_diff") >= RATING_GAP, F.lit(False)), FRIENDLY_EXTRAPOLATION=c("is_friendly") & c("fallback_used") & thin,
    )
    structural = sum(t.cast("int") for t in (*tests.values(), c("risky_name")))
    return rows.select("match_id", flags(BASE_SIGNAL_SUSPICIOUS=structural >= 2, **tests, UNKNOWN_NEUTRALITY=c("neutral") == "unknown", CANONICALIZATION_RISK=c("risky_name")).alias("warnings"))


def live_scores(rows: DataFrame) -> DataFrame:
    """Per slate: what is decided, hits of each ticket mode so far, the most and least reachable, draws against expectation (D17). rows: slate_id, is_final, is_live, result_code, P, simple, doubles, full (arrays of codes)."""
    final, modes = c("is_final"), ("simple", "doubles", "full")
    hit = lambda m: F.coalesce(final & F.array_contains(m, c("result_code")), F.lit(False))
    brier = sum((c(p) - F.when(c("result_code") == k, 1.0).otherwise(0.0)) ** 2 for k, p in (("1", "p_home"), ("X", "p_draw"), ("2", "p_away")))
    sums = rows.groupBy("slate_id").agg(
        F.count(F.lit(1)).alias("total_matches"), F.count_if(final).alias("evaluated_matches"), F.count_if(~final & c("is_live")).alias("live_matches"), *(F.count_if(hit(m)).alias(f"{m}_hits") for m in modes), *(F.count_if(~final & (F.size(m) > 0)).alias(f"{m}_possible_remaining") for m in modes),
        F.count_if(~final & (F.size("simple") >= 3)).alias("sure"), F.count_if(final & (c("result_code") == "X")).alias("draws"), F.round(F.sum("p_draw"), 4).alias("draws_expected"), F.sum(F.when(final, c("p_draw")).otherwise(0.0)).alias("x"), F.round(F.avg(F.when(final & c("result_code").isNotNull(), brier)), 4).alias("brier_partial"),
    )
    out = sums.withColumns({
        "pending_matches": c("total_matches") - c("evaluated_matches") - c("live_matches"), "current_hit_rate": F.round(F.try_divide("simple_hits", "evaluated_matches"), 4), "max_possible_hits": c("simple_hits") + c("simple_possible_remaining"),
        "min_possible_hits": c("simple_hits") + c("sure"), "draw_delta_partial": F.round(c("draws") - c("x"), 4), "is_complete": c("evaluated_matches") == c("total_matches"),
    })
    return out.drop("sure", "x")


def to_finalize(slates: DataFrame, scores: DataFrame, saved: DataFrame) -> DataFrame:
    """Closed, official slates whose matches are all final and that have no complete score yet (N09). saved: slate_id, is_complete."""
    ready = scores.where("is_complete").select("slate_id")
    return slates.where(closed() & c("official")).join(ready, "slate_id", "left_semi").join(saved.where("is_complete"), "slate_id", "left_anti").select("slate_id", "draw_code")


def survivors(matches: DataFrame, clusters: DataFrame, links: DataFrame, results: DataFrame) -> DataFrame:
    """Of each cluster of repeated fixtures the one that stays: linked to a slate, real, with most results, earliest, smallest id."""
    n = results.groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))
    linked = links.select("match_id").distinct().withColumn("linked", F.lit(True))
    rows = matches.join(clusters, "match_id").join(n, "match_id", "left").join(linked, "match_id", "left")
    order = F.struct((-F.coalesce(c("linked"), F.lit(False)).cast("int")).alias("l"), c("is_placeholder").cast("int").alias("p"), (-F.coalesce("n", F.lit(0))).alias("n"), F.unix_seconds("kickoff_at").alias("k"), c("match_id"))
    return rows.groupBy("cluster_id").agg(F.min_by("match_id", order).alias("survivor_id"), F.count(F.lit(1)).alias("members"))


def repointed(dependents: DataFrame, moves: DataFrame, unique: list[str]) -> DataFrame:
    """dependents with the loser's match_id replaced by the survivor's, unless the survivor has a row with equal `unique` columns: those stay (G08). moves: match_id, survivor_id."""
    both = dependents.join(moves, "match_id", "left")
    taken = dependents.select(c("match_id").alias("survivor_id"), *unique, F.lit(True).alias("taken"))
    target = F.when(c("survivor_id").isNotNull() & c("taken").isNull(), c("survivor_id")).otherwise(c("match_id"))
    return both.join(taken, ["survivor_id", *unique], "left").select(target.alias("match_id"), *[x for x in dependents.columns if x != "match_id"])


def superseded(snapshots: DataFrame) -> DataFrame:
    """Appended snapshots with only the newest of each slate, version and composition valid."""
    w = W.partitionBy("slate_id", "model_version", "composition_hash").orderBy(F.desc("generated_s"), F.desc("snapshot_id"))
    newest = F.row_number().over(w) == 1
    return snapshots.select("snapshot_id", "slate_id", (c("is_valid") & newest).alias("is_valid"), F.when(c("is_valid") & ~newest, "superseded_by_new_snapshot").alias("invalidation_reason"))


def orphans(matches: DataFrame, links: DataFrame, results: DataFrame, snapshots: DataFrame, predictions: DataFrame, since_s: Column) -> DataFrame:
    """Matches with predictions and what speaks against pruning each."""
    mark = lambda df, name: df.select("match_id").distinct().withColumn(name, F.lit(True))
    rows = matches.join(predictions.select("match_id").distinct(), "match_id", "left_semi")
    for df, name in ((links, "linked"), (results, "result"), (snapshots, "snapshot")):
        rows = rows.join(mark(df, name), "match_id", "left")
    has = lambda name: F.coalesce(c(name), F.lit(False))
    return rows.select("match_id", flags(linked_to_slate=has("linked"), has_result=has("result"), has_feature_snapshot=has("snapshot"), outside_window=F.coalesce(F.unix_seconds("kickoff_at") < since_s, F.lit(True))).alias("blockers"))


def side_counts(matches: DataFrame) -> DataFrame:
    """Matches of each team, at home and away together."""
    return matches.select(F.explode(F.array("home_team_id", "away_team_id")).alias("team_id")).groupBy("team_id").agg(F.count(F.lit(1)).alias("matches"))


def due_jobs(jobs: DataFrame) -> DataFrame:
    """Active jobs whose time has come, those that never ran first, then the longest waiting."""
    return jobs.where("is_active and next_run_s <= now_s").orderBy(c("last_run_s").asc_nulls_first(), "next_run_s").select("job_id", "last_run_s", "next_run_s")


def signatures(fixtures: DataFrame) -> DataFrame:
    """A digest of each draw's code and its ordered fixtures (H29): SHA-256 of JSON with spaces after commas and colons, names escaped, unknown values null. A draw has few fixtures; those without a position come first."""
    quoted = lambda x: F.coalesce(F.to_json(F.array(x)), F.lit("[null]"))
    inner = lambda x: F.expr(f"substring({x}, 2, length({x}) - 2)")
    rows = fixtures.select("draw_code", "position", "home", "away", quoted(F.col("home")).alias("h"), quoted(F.col("away")).alias("a"))
    row = F.concat(F.lit("["), F.coalesce(F.col("position").cast("string"), F.lit("null")), F.lit(", "), inner("h"), F.lit(", "), inner("a"), F.lit("]"))
    rows = rows.select("draw_code", F.struct("position", "home", "away", row.alias("row")).alias("x"))
    draws = rows.groupBy("draw_code").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["row"]), ", ").alias("rows")).withColumn("code", quoted(F.col("draw_code")))
    return draws.select("draw_code", F.sha2(F.concat(F.lit('{"draw_code": '), inner("code"), F.lit(', "fixtures": ['), "rows", F.lit("]}")), 256).alias("signature"))


def quality_score(rows: DataFrame) -> DataFrame:
    """What is known of a match, as 0 to 100, and its level (M13). rows: evidence, recent, h2h, readiness, availability, venue_known."""
    score = (
        F.when(c("evidence") > 0, 30).otherwise(0) + F.when(c("recent") >= 2, 25).when(c("recent") > 0, 12).otherwise(0) + F.when(c("h2h") > 0, 20).otherwise(0)
        + F.when(c("readiness").isin("ready", "covered"), 15).when(c("readiness") == "context_only", 8).otherwise(0) + F.when(c("availability") > 0, 5).otherwise(0) + F.when(c("venue_known"), 5).otherwise(0)
    )
    return rows.select("match_id", F.least(score, F.lit(100)).alias("quality_score"), F.when(score >= 70, "good").when(score >= 40, "partial").otherwise("thin").alias("quality_level"))


def money_decision() -> Column:
    """Whether and what to play (K17). has_data_blockers, prediction_status, uncovered (positions that even the conservative ticket leaves), match_count, balanced_covers."""
    residual = F.coalesce(F.try_divide("uncovered", "match_count"), F.lit(1.0))
    stop = c("has_data_blockers") | c("prediction_status").isin("pending", "missing") | (residual > 0.34)
    return F.when(stop, "NO_JUGAR").when(c("uncovered") > 0, "JUGAR_SOLO_CONSERVADOR").when(c("balanced_covers"), "JUGAR_BALANCEADO").otherwise("JUGAR_SOLO_CONSERVADOR")
