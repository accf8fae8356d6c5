"""Plans of slates: states, order, deadlines, snapshots, live scores, reports and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchloom.operators import decisions, linking, results, slates
from pitchloom.sources import derive

from .core import plan
from .decisions import SANE, banded
from .learning import POSITIONS, positions

SLATES = """.
sl AS (SELECT match_id // 14 AS slate_id, count(*) AS match_count, min(epoch(kickoff_at))::BIGINT AS first_s, max(epoch(kickoff_at))::BIGINT AS last_s FROM matches GROUP BY 1),
nw AS (SELECT (min(first_s) + max(first_s)) // 2 AS now_s FROM sl),
slates AS (SELECT slate_id, CASE slate_id % 3 WHEN 0 THEN 'weekend' WHEN 1 THEN 'midweek' ELSE 'revancha' END AS week_type, CASE slate_id % 3 WHEN 0 THEN 'PG-' WHEN 1 THEN 'PGM-' ELSE 'PR-' END || slate_id AS draw_code, match_count, first_s, last_s,
  CASE WHEN slate_id % 11 <> 0 THEN first_s + (slate_id % 7 - 3) * 86400 END AS closes_s, first_s - 864000 AS created_s, slate_id % 4 = 0 AS archived, slate_id % 6 = 5 AS observed, now_s FROM sl, nw),
sc AS (SELECT *, archived OR observed OR coalesce(closes_s <= now_s, first_s <= now_s, false) AS closed FROM slates)
"""


def all_slates(spark, sf_dir):
    s = F.col("slate_id")
    k = F.unix_seconds("kickoff_at")
    found = derive.matches(spark, sf_dir).groupBy(F.expr("match_id div 14").alias("slate_id")).agg(F.count(F.lit(1)).alias("match_count"), F.min(k).alias("first_s"), F.max(k).alias("last_s"))
    now = found.agg(F.expr("(min(first_s) + max(first_s)) div 2").alias("now_s"))  # one row
    pick = lambda a, b, c: F.when(s % 3 == 0, a).when(s % 3 == 1, b).otherwise(c)
    return found.join(F.broadcast(now)).select(
        "slate_id", pick("weekend", "midweek", "revancha").alias("week_type"), F.concat(pick("PG-", "PGM-", "PR-"), s.cast("string")).alias("draw_code"), "match_count", "first_s", "last_s",
        F.when(s % 11 != 0, F.col("first_s") + (s % 7 - 3) * 86400).alias("closes_s"), (F.col("first_s") - 864000).alias("created_s"), (s % 4 == 0).alias("archived"), (s % 6 == 5).alias("observed"), "now_s",
    )


@plan("b14_closed_slates", SLATES + "SELECT slate_id, closed FROM sc")
def closed_slates(spark, sf_dir):
    return all_slates(spark, sf_dir).select("slate_id", slates.closed().alias("closed"))


@plan("b17_active_slates", SLATES + "SELECT slate_id FROM sc WHERE coalesce(closes_s >= now_s, false) OR last_s >= now_s")
def active_slates(spark, sf_dir):
    return all_slates(spark, sf_dir).where(slates.active_or_future()).select("slate_id")


@plan(
    "f01_slate_urgency",
    SLATES
    + """SELECT slate_id, CASE WHEN closed THEN 2 WHEN closes_s IS NOT NULL THEN 0 ELSE 1 END AS urgency, CASE WHEN closed THEN now_s - coalesce(closes_s, last_s) ELSE coalesce(closes_s, first_s) - now_s END AS seconds,
  CASE week_type WHEN 'weekend' THEN 0 WHEN 'midweek' THEN 1 ELSE 2 END AS week_priority, -created_s AS newest FROM sc""",
)
def slate_urgency(spark, sf_dir):
    return slates.urgency(all_slates(spark, sf_dir))


@plan("m16_open_slates", SLATES + "SELECT slate_id, draw_code, closes_s FROM sc WHERE NOT closed ORDER BY closes_s, slate_id")
def open_slates(spark, sf_dir):
    """Open slates, the soonest deadline first."""
    return all_slates(spark, sf_dir).where(~slates.closed()).orderBy("closes_s", "slate_id").select("slate_id", "draw_code", "closes_s")


COUNTED = """,
pc AS (SELECT match_id // 14 AS slate_id, count(*) FILTER (WHERE match_id % 37 <> 0) AS predictions FROM matches GROUP BY 1),
rc AS (SELECT match_id // 14 AS slate_id, count(*) FILTER (WHERE NOT x) AS results, count(*) FILTER (WHERE x) AS conflicts FROM (SELECT match_id, min(result_code) <> max(result_code) AS x FROM results GROUP BY 1) GROUP BY 1)
"""


@plan(
    "b15_inventory_states",
    SLATES
    + COUNTED
    + """SELECT sc.slate_id, CASE WHEN NOT archived THEN CASE WHEN coalesce(closes_s > now_s, false) THEN 'upcoming' ELSE 'active' END WHEN predictions = 0 THEN 'archived_no_predictions' WHEN coalesce(conflicts, 0) > 0 THEN 'closed_conflict'
  WHEN coalesce(results, 0) = 0 THEN 'closed_pending_results' WHEN results < match_count THEN 'closed_partial_results' WHEN sc.slate_id % 8 = 0 AND predictions >= match_count THEN 'closed_comparable' ELSE 'closed_partial_results' END AS state
  FROM sc JOIN pc USING (slate_id) LEFT JOIN rc ON rc.slate_id = sc.slate_id""",
)
def inventory_states(spark, sf_dir):
    slate = F.expr("match_id div 14").alias("slate_id")
    predicted = derive.matches(spark, sf_dir).groupBy(slate).agg(F.count_if(F.col("match_id") % 37 != 0).alias("predictions"))
    known = results.with_conflicts(derive.results(spark, sf_dir)).groupBy(slate).agg(F.count_if(~F.col("is_conflicting")).alias("results"), F.count_if("is_conflicting").alias("conflicts"))
    rows = all_slates(spark, sf_dir).join(predicted, "slate_id").join(known, "slate_id", "left").fillna(0, ["results", "conflicts"]).withColumn("comparable", F.col("slate_id") % 8 == 0)
    return rows.select("slate_id", slates.inventory_state().alias("state"))


@plan(
    "f07_current_slate",
    SLATES
    + """, nx AS (SELECT sc.slate_id, min(epoch(kickoff_at)::BIGINT) FILTER (WHERE epoch(kickoff_at) >= now_s) AS next_s FROM sc JOIN matches ON match_id // 14 = sc.slate_id GROUP BY 1)
SELECT slate_id FROM sc JOIN nx USING (slate_id) WHERE coalesce(closes_s >= now_s, false) OR last_s >= now_s ORDER BY next_s IS NOT NULL DESC, next_s, slate_id DESC LIMIT 1""",
)
def current_slate(spark, sf_dir):
    found = all_slates(spark, sf_dir)
    ahead = derive.matches(spark, sf_dir).select(F.expr("match_id div 14").alias("slate_id"), F.unix_seconds("kickoff_at").alias("k")).join(found.select("slate_id", "now_s"), "slate_id")
    soonest = ahead.where("k >= now_s").groupBy("slate_id").agg(F.min("k").alias("next_s"))
    return slates.current(found.join(soonest, "slate_id", "left").withColumn("draw_number", F.col("slate_id")))


@plan("e15_previous_close", SLATES + "SELECT slate_id, slate_id AS number, lag(closes_s) OVER (PARTITION BY week_type ORDER BY slate_id) AS prev_closes_s FROM slates")
def previous_close(spark, sf_dir):
    return slates.previous_close(all_slates(spark, sf_dir))


SNAPSHOTS = """,
sn AS (SELECT slate_id * 4 + v AS snapshot_id, slate_id, 'm' || (v % 2) AS model_version, 'h' || ((slate_id + v) // 3 % 2) AS composition_hash, coalesce(closes_s, first_s) + (v - 2) * 43200 AS generated_s, (slate_id + v) % 5 <> 0 AS is_valid FROM slates, (VALUES (0), (1), (2), (3)) x(v))
"""


def all_snapshots(spark, sf_dir):
    s, v = F.col("slate_id"), F.col("v")
    rows = all_slates(spark, sf_dir).select("slate_id", F.coalesce("closes_s", "first_s").alias("at_s"), F.explode(F.array(*(F.lit(i).cast("long") for i in range(4)))).alias("v"))
    return rows.select((s * 4 + v).alias("snapshot_id"), "slate_id", F.concat(F.lit("m"), (v % 2).cast("string")).alias("model_version"), F.concat(F.lit("h"), F.expr("(slate_id + v) div 3 % 2").cast("string")).alias("composition_hash"), (F.col("at_s") + (v - 2) * 43200).alias("generated_s"), ((s + v) % 5 != 0).alias("is_valid"))


@plan(
    "e12_original_snapshots",
    SLATES
    + SNAPSHOTS
    + """SELECT s.slate_id, snapshot_id FROM slates s JOIN sn ON sn.slate_id = s.slate_id AND sn.composition_hash = 'h' || (s.slate_id // 2 % 2) WHERE is_valid
QUALIFY row_number() OVER (PARTITION BY s.slate_id ORDER BY coalesce(generated_s <= closes_s, true) DESC, generated_s DESC, snapshot_id DESC) = 1""",
)
def original_snapshots(spark, sf_dir):
    found = all_slates(spark, sf_dir).withColumn("composition_hash", F.concat(F.lit("h"), F.expr("slate_id div 2 % 2").cast("string")))
    return slates.original_snapshots(found, all_snapshots(spark, sf_dir))


@plan(
    "p06_superseded_snapshots",
    SLATES
    + SNAPSHOTS
    + """, rk AS (SELECT *, row_number() OVER (PARTITION BY slate_id, model_version, composition_hash ORDER BY generated_s DESC, snapshot_id DESC) = 1 AS newest FROM sn)
SELECT snapshot_id, slate_id, is_valid AND newest AS is_valid, CASE WHEN is_valid AND NOT newest THEN 'superseded_by_new_snapshot' END AS invalidation_reason FROM rk""",
)
def superseded_snapshots(spark, sf_dir):
    return slates.superseded(all_snapshots(spark, sf_dir))


@plan(
    "e11_preferred_predictions",
    """.
pp AS (SELECT match_id, match_id // 14 + (match_id + version) % 2 AS slate_id, 'h' || (match_id // 14 + version) % 2 AS composition_hash, (match_id * 7 + version) % 5 AS generated_s, match_id * 2 + version AS prediction_id FROM predictions)
SELECT m.match_id // 14 AS slate_id, m.match_id, prediction_id FROM matches m JOIN pp USING (match_id)
QUALIFY row_number() OVER (PARTITION BY m.match_id ORDER BY slate_id = m.match_id // 14 DESC, composition_hash = 'h' || (m.match_id // 14 % 2) DESC, generated_s DESC, prediction_id DESC) = 1""",
)
def preferred_predictions(spark, sf_dir):
    v = F.col("version")
    p = derive.predictions(spark, sf_dir).select(
        "match_id", (F.expr("match_id div 14") + (F.col("match_id") + v) % 2).alias("slate_id"), F.concat(F.lit("h"), ((F.expr("match_id div 14") + v) % 2).cast("string")).alias("composition_hash"),
        ((F.col("match_id") * 7 + v) % 5).alias("generated_s"), (F.col("match_id") * 2 + v).alias("prediction_id"),
    )
    wanted = derive.matches(spark, sf_dir).select("match_id", F.expr("match_id div 14").alias("slate_id"), F.concat(F.lit("h"), F.expr("match_id div 14 % 2").cast("string")).alias("composition_hash"))
    return slates.preferred_predictions(wanted, p)


@plan(
    "g12_rebased_ladders",
    SLATES
    + """,
en AS (SELECT slate_id, match_id % 14 + 1 AS position, first_s + (12 + match_id % 14) * 3600 + CASE WHEN match_id % 23 = 0 THEN 60 ELSE 0 END AS kickoff_s, first_s + (slate_id % 3) * 3600 AS closes_s FROM matches JOIN sl ON sl.slate_id = match_id // 14),
ok AS (SELECT slate_id FROM en GROUP BY 1 HAVING count(*) >= 3 AND min(kickoff_s - (position - 1) * 3600) = max(kickoff_s - (position - 1) * 3600))
SELECT slate_id, position, closes_s + (11 + position) * 3600 AS kickoff_s FROM en JOIN ok USING (slate_id) WHERE closes_s + (11 + position) * 3600 <> kickoff_s""",
)
def rebased_ladders(spark, sf_dir):
    m = F.col("match_id")
    rows = derive.matches(spark, sf_dir).select("match_id", F.expr("match_id div 14").alias("slate_id")).join(all_slates(spark, sf_dir).select("slate_id", "first_s"), "slate_id")
    entries = rows.select("slate_id", (m % 14 + 1).alias("position"), (F.col("first_s") + (12 + m % 14) * 3600 + F.when(m % 23 == 0, 60).otherwise(0)).alias("kickoff_s"), (F.col("first_s") + (F.col("slate_id") % 3) * 3600).alias("closes_s"))
    return slates.rebased(entries)


@plan(
    "b06_week_types",
    """.
wt AS (SELECT p_partkey, CASE WHEN p_partkey % 6 < 3 THEN [9, 7, 14][p_partkey % 6 + 1] END AS n, CASE p_partkey % 5 WHEN 0 THEN 'progol_revancha' WHEN 1 THEN 'progol_media_semana' END AS contest, ['Progol Revancha', 'Media Semana 7', NULL, p_name][p_partkey % 4 + 1] AS title FROM part)
SELECT p_partkey, CASE WHEN n = 9 THEN 'midweek' WHEN n = 7 THEN 'revancha' WHEN n = 14 THEN 'weekend' WHEN contest LIKE '%revancha%' THEN 'revancha' WHEN contest LIKE '%media%' THEN 'midweek' WHEN lower(title) LIKE '%revancha%' THEN 'revancha'
  WHEN lower(title) LIKE '%media semana%' THEN 'midweek' ELSE 'weekend' END AS week_type FROM wt""",
)
def week_types(spark, sf_dir):
    k = F.col("p_partkey")
    n = F.when(k % 6 == 0, 9).when(k % 6 == 1, 7).when(k % 6 == 2, 14)
    contest = F.when(k % 5 == 0, "progol_revancha").when(k % 5 == 1, "progol_media_semana")
    title = F.when(k % 4 == 0, "Progol Revancha").when(k % 4 == 1, "Media Semana 7").when(k % 4 == 3, F.col("p_name"))
    return derive.table(spark, sf_dir, "part").select("p_partkey", slates.week_type(n, contest, title).alias("week_type"))


@plan(
    "f02_due_jobs",
    "SELECT c_custkey AS job_id, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey * 31 % 9973 END AS last_run_s, c_custkey * 60 % 7919 AS next_run_s FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey * 60 % 7919 <= 4000",
)
def due_jobs(spark, sf_dir):
    k = F.col("c_custkey")
    jobs = derive.table(spark, sf_dir, "customer").select(k.alias("job_id"), (k % 5 != 0).alias("is_active"), F.when(k % 7 != 0, k * 31 % 9973).alias("last_run_s"), (k * 60 % 7919).alias("next_run_s"), F.lit(4000).alias("now_s"))
    return slates.due_jobs(jobs)


@plan(
    "j14_raw_leaks",
    SANE
    + """SELECT s.match_id, greatest(abs(l.p_home - s.p_home), abs(l.p_draw - s.p_draw), abs(l.p_away - s.p_away)) > 1e-6 AND (s.match_id % 3 = 0 OR greatest(abs(l.p_home - s.p_home), abs(l.p_draw - s.p_draw), abs(l.p_away - s.p_away)) <= 1e-6) AS leaks
FROM san s JOIN b l ON l.match_id = s.match_id""",
)
def raw_leaks(spark, sf_dir):
    raw = banded(spark, sf_dir)
    shown = decisions.sanity(raw).select("match_id", *(F.col(p).alias(f"s_{p}") for p in decisions.P))
    rows = raw.select("match_id", *decisions.P).join(shown, "match_id")
    decided = [F.when(F.col("match_id") % 3 == 0, F.col(p)).otherwise(F.col(f"s_{p}")).alias(f"d_{p}") for p in decisions.P]
    named = lambda k: [f"{k}{p}" for p in decisions.P]
    return rows.select("*", *decided).select("match_id", slates.leaks_raw(named(""), named("s_"), named("d_")).alias("leaks"))


AUDITS = [None, "{}", '{"raw_probabilities": {"L": 1}, "display_probabilities": {"L": 1}, "decision_probabilities": {"L": 1}, "final_status": "FIJO", "evidence_level": "high", "sanity_policy_version": "1", "fallback_used": true}', '{"raw_probabilities": {}, "display_probabilities": {"L": 1}, "decision_probabilities": 3, "final_status": "", "evidence_level": "low", "sanity_policy_version": "1", "model_artifact_id": "a"}', "broken"]


@plan(
    "j18_lineage",
    """.
au AS (SELECT match_id, ["""
    + ", ".join("NULL" if a is None else f"'{a}'" for a in AUDITS)
    + """][match_id % 5 + 1] AS audit FROM matches), av AS (SELECT *, audit IS NULL OR audit NOT LIKE '{%' AS none, CASE WHEN audit LIKE '{%' THEN audit END AS j FROM au)
SELECT match_id, array_to_string(list_filter([CASE WHEN match_id % 7 = 0 THEN 'composition_hash' END, CASE WHEN match_id % 9 = 0 THEN 'slate_version' END, CASE WHEN none THEN 'sanity_audit_json' END,
  CASE WHEN NOT none AND coalesce(json_type(j, '$.raw_probabilities') <> 'OBJECT' OR (j -> '$.raw_probabilities')::VARCHAR = '{}', true) THEN 'sanity_audit.raw_probabilities' END,
  CASE WHEN NOT none AND coalesce(json_type(j, '$.display_probabilities') <> 'OBJECT' OR (j -> '$.display_probabilities')::VARCHAR = '{}', true) THEN 'sanity_audit.display_probabilities' END,
  CASE WHEN NOT none AND coalesce(json_type(j, '$.decision_probabilities') <> 'OBJECT' OR (j -> '$.decision_probabilities')::VARCHAR = '{}', true) THEN 'sanity_audit.decision_probabilities' END,
  CASE WHEN NOT none AND coalesce(j ->> '$.final_status', '') = '' THEN 'sanity_audit.final_status' END, CASE WHEN NOT none AND coalesce(j ->> '$.evidence_level', '') = '' THEN 'sanity_audit.evidence_level' END,
  CASE WHEN NOT none AND coalesce(j ->> '$.sanity_policy_version', '') = '' THEN 'sanity_audit.sanity_policy_version' END,
  CASE WHEN NOT none AND coalesce(j ->> '$.model_artifact_id', '') = '' AND coalesce(j ->> '$.fallback_used', 'false') <> 'true' THEN 'sanity_audit.model_artifact_id|fallback_used' END], lambda f: f IS NOT NULL), ',') AS missing FROM av""",
)
def lineage(spark, sf_dir):
    k = F.col("match_id")
    audit = F.element_at(F.array(*(F.lit(a) for a in AUDITS)), (k % 5 + 1).cast("int"))
    rows = derive.matches(spark, sf_dir).select(k.cast("string").alias("match_id"), F.lit("s").alias("slate_id"), F.when(k % 7 != 0, "h").alias("composition_hash"), F.when(k % 9 != 0, 1).alias("slate_version"), F.lit("1").alias("recommended_outcome"), audit.alias("audit"))
    return rows.select(F.col("match_id").cast("long").alias("match_id"), slates.lineage_missing("audit").alias("missing"))


@plan(
    "d09_slate_distribution",
    POSITIONS
    + """,
dd AS (SELECT px.*, san.is_friendly, greatest(px.p_home, px.p_draw, px.p_away) AS top FROM px JOIN san ON san.match_id = px.match_id),
ds AS (SELECT slate_id, count(*) AS total_matches, count(*) FILTER (WHERE prediction = 'L') AS count_L, count(*) FILTER (WHERE prediction = 'E') AS count_E, count(*) FILTER (WHERE prediction = 'V') AS count_V, round(avg(p_home), 6) AS avg_p_L, round(avg(p_draw), 6) AS avg_p_E,
  round(avg(p_away), 6) AS avg_p_V, round(max(top), 6) AS max_probability, count(*) FILTER (WHERE top >= 0.75) AS p_gt_75, count(*) FILTER (WHERE level = 'low' AND top > 0.6) AS low_evidence_p_gt_60, count(*) FILTER (WHERE is_friendly AND top > 0.65) AS friendly_p_gt_65,
  count(*) FILTER (WHERE p_home <= 0.05) AS home_under_5, count(*) FILTER (WHERE p_away <= 0.05) AS away_under_5, count(*) FILTER (WHERE level = 'low' AND status IN ('FIJO', 'LISTO')) AS ready_but_low, count(*) FILTER (WHERE level = 'low' AND status = 'FIJO') AS fixed_but_low FROM dd GROUP BY 1)
SELECT *, round(count_V / total_matches, 6) AS away_share, round((home_under_5 + away_under_5) / total_matches, 6) AS suspicious_share, array_to_string(list_filter([CASE WHEN total_matches >= 6 AND count_V / total_matches > 0.55 THEN 'AWAY_BIAS' END,
  CASE WHEN total_matches >= 6 AND (home_under_5 + away_under_5) / total_matches > 0.3 THEN 'SUSPICIOUS_CLASS_DISTRIBUTION' END, CASE WHEN fixed_but_low > 0 THEN 'STATUS_INTEGRITY' END], lambda f: f IS NOT NULL), ',') AS alarms FROM ds""",
)
def slate_distribution(spark, sf_dir):
    rows = positions(spark, sf_dir).join(banded(spark, sf_dir).select("match_id", "is_friendly"), "match_id").withColumn("pick", F.col("prediction"))
    return slates.distribution(rows)


@plan(
    "m06_publication_gate",
    """.
g AS (SELECT match_id, ['NO_JUGAR', 'JUGAR_SOLO_CONSERVADOR', 'JUGAR_BALANCEADO', 'OTRO'][match_id % 4 + 1] AS money, match_id % 17 = 0 AS db, match_id % 13 = 0 AS ph, match_id % 11 = 0 AS bl FROM matches)
SELECT match_id, CASE WHEN db OR ph OR bl OR money = 'NO_JUGAR' THEN 'DO_NOT_PLAY' WHEN money = 'JUGAR_SOLO_CONSERVADOR' THEN 'PLAY_CONSERVATIVE_ONLY' WHEN money = 'JUGAR_BALANCEADO' THEN 'READY_TO_PLAY' ELSE 'REVIEW_REQUIRED' END AS gate FROM g""",
)
def publication_gate(spark, sf_dir):
    k = F.col("match_id")
    rows = derive.matches(spark, sf_dir).select("match_id", F.element_at(F.array(*map(F.lit, ["NO_JUGAR", "JUGAR_SOLO_CONSERVADOR", "JUGAR_BALANCEADO", "OTRO"])), (k % 4 + 1).cast("int")).alias("money_status"), (k % 17 == 0).alias("has_data_blockers"), (k % 13 == 0).cast("int").alias("placeholder_count"), (k % 11 == 0).cast("int").alias("blocked_count"))
    return rows.select("match_id", slates.publication_status().alias("gate"))


@plan(
    "j08_capped_policy",
    """.
po AS (SELECT match_id, ['unclassified', 'not_ready', 'context_only', 'covered', 'ready', 'odd'][match_id % 6 + 1] AS r, match_id % 5 < 4 AS live, match_id % 3 = 0 AS ph FROM matches)
SELECT match_id, CASE WHEN ph AND r IN ('covered', 'ready') THEN 'context_only' ELSE r END AS readiness, live AND NOT (ph AND r IN ('covered', 'ready', 'odd')) AS live_pick_allowed, ph AS competition_inferred FROM po""",
)
def capped_policy(spark, sf_dir):
    k = F.col("match_id")
    rows = derive.matches(spark, sf_dir).select("match_id", F.element_at(F.array(*map(F.lit, [*slates.READINESS, "odd"])), (k % 6 + 1).cast("int")).alias("readiness"), (k % 5 < 4).alias("live_pick_allowed"), (k % 3 == 0).alias("is_placeholder"))
    return slates.capped_policy(rows)


@plan(
    "c29_sign_check",
    """.
one AS (SELECT match_id, result_code FROM results WHERE source_id = 1), two AS (SELECT match_id, result_code FROM results WHERE source_id = 2)
SELECT match_id, CASE WHEN one.result_code IS NULL OR two.result_code IS NULL THEN 'not_available' WHEN one.result_code = two.result_code THEN 'matches' ELSE 'conflict' END AS sign_check FROM one FULL JOIN two USING (match_id)""",
)
def sign_check(spark, sf_dir):
    found = derive.results(spark, sf_dir)
    side = lambda s, name: found.where(f"source_id = {s}").select("match_id", F.col("result_code").alias(name))
    return side(1, "scored").join(side(2, "official"), "match_id", "full").select("match_id", slates.sign_check(F.col("official"), F.col("scored")).alias("sign_check"))


@plan(
    "m14_signal_warnings",
    SANE
    + """,
w0 AS (SELECT *, CASE WHEN match_id % 10 <> 0 THEN (match_id % 700 - 350)::DOUBLE END AS rd, CASE WHEN match_id % 4 = 0 THEN 'unknown' ELSE 'no' END AS neutral, match_id % 15 = 0 AS risky, CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 'L' WHEN p_away >= p_draw THEN 'V' ELSE 'E' END AS am,
  least(home_recent, away_recent) < 3 AS few FROM b),
w1 AS (SELECT *, [CASE WHEN fallback_used THEN 'FALLBACK_SIGNAL' END, CASE WHEN few THEN 'LOW_TEAM_SAMPLE' END, CASE WHEN am <> 'E' AND few THEN 'RAW_ARGMAX_LOW_SUPPORT' END, CASE WHEN top >= 0.75 AND level = 'low' THEN 'RAW_EXTREME_WITH_LOW_EVIDENCE' END,
  CASE WHEN am = 'V' AND p_away >= 0.75 AND (level = 'low' OR is_friendly) THEN 'SUSPICIOUS_AWAY_BIAS' END, CASE WHEN rd > 0 AND am = 'V' AND p_away >= 0.75 THEN 'SUSPICIOUS_HOME_UNDERDOG' END, CASE WHEN abs(rd) >= 250 THEN 'RATING_DIFF_EXAGGERATED' END,
  CASE WHEN is_friendly AND fallback_used AND few THEN 'FRIENDLY_EXTRAPOLATION' END, CASE WHEN neutral = 'unknown' THEN 'UNKNOWN_NEUTRALITY' END, CASE WHEN risky THEN 'CANONICALIZATION_RISK' END] AS all_w FROM w0),
w2 AS (SELECT match_id, list_filter(all_w, lambda x: x IS NOT NULL) AS ws FROM w1)
SELECT match_id, array_to_string(CASE WHEN len(list_filter(ws, lambda x: x <> 'UNKNOWN_NEUTRALITY')) >= 2 THEN list_prepend('BASE_SIGNAL_SUSPICIOUS', ws) ELSE ws END, ',') AS warnings FROM w2""",
)
def signal_warnings(spark, sf_dir):
    k = F.col("match_id")
    rows = banded(spark, sf_dir).withColumns({"rating_diff": F.when(k % 10 != 0, (k % 700 - 350).cast("double")), "neutral": F.when(k % 4 == 0, "unknown").otherwise("no"), "risky_name": k % 15 == 0})
    return slates.signal_warnings(rows)


LIVE = (
    POSITIONS
    + """,
lv AS (SELECT slate_id, match_id % 3 = 0 AS fin, match_id % 3 = 1 AS live, p_home, p_draw, p_away, CASE actual WHEN 'L' THEN '1' WHEN 'E' THEN 'X' WHEN 'V' THEN '2' END AS rc, CASE prediction WHEN 'L' THEN '1' WHEN 'E' THEN 'X' ELSE '2' END AS pk, position FROM px),
lm AS (SELECT *, CASE WHEN position % 2 = 0 THEN list_distinct([pk, 'X']) ELSE [pk] END AS dbl, CASE WHEN position % 4 = 0 THEN ['1', 'X', '2'] ELSE [pk] END AS ful, (p_home - (rc = '1')::INT) ** 2 + (p_draw - (rc = 'X')::INT) ** 2 + (p_away - (rc = '2')::INT) ** 2 AS br FROM lv),
ls AS (SELECT slate_id, count(*) AS total_matches, count(*) FILTER (WHERE fin) AS evaluated_matches, count(*) FILTER (WHERE NOT fin AND live) AS live_matches, count(*) FILTER (WHERE NOT fin AND NOT live) AS pending_matches, count(*) FILTER (WHERE fin AND pk = rc) AS simple_hits,
  count(*) FILTER (WHERE fin AND list_contains(dbl, rc)) AS doubles_hits, count(*) FILTER (WHERE fin AND list_contains(ful, rc)) AS full_hits, count(*) FILTER (WHERE NOT fin) AS simple_possible_remaining, count(*) FILTER (WHERE NOT fin) AS doubles_possible_remaining,
  count(*) FILTER (WHERE NOT fin) AS full_possible_remaining, count(*) FILTER (WHERE fin AND rc = 'X') AS draws, round(sum(p_draw), 4) AS draws_expected, coalesce(sum(p_draw) FILTER (WHERE fin), 0) AS x, round(avg(br) FILTER (WHERE fin AND rc IS NOT NULL), 4) AS brier_partial FROM lm GROUP BY 1),
scores AS (SELECT * EXCLUDE x, round(simple_hits / nullif(evaluated_matches, 0), 4) AS current_hit_rate, simple_hits + simple_possible_remaining AS max_possible_hits, simple_hits AS min_possible_hits, round(draws - x, 4) AS draw_delta_partial, evaluated_matches = total_matches AS is_complete FROM ls)
"""
)


def live_rows(spark, sf_dir):
    code = lambda s: F.when(F.col(s) == "L", "1").when(F.col(s) == "E", "X").when(F.col(s) == "V", "2")
    k, pick = F.col("match_id"), code("prediction")
    rows = positions(spark, sf_dir)
    return rows.select(
        "slate_id", (k % 3 == 0).alias("is_final"), (k % 3 == 1).alias("is_live"), code("actual").alias("result_code"), *decisions.P, F.array(pick).alias("simple"), F.when(F.col("position") % 2 == 0, F.array_distinct(F.array(pick, F.lit("X")))).otherwise(F.array(pick)).alias("doubles"),
        F.when(F.col("position") % 4 == 0, F.array(F.lit("1"), F.lit("X"), F.lit("2"))).otherwise(F.array(pick)).alias("full"),
    )


@plan("d17_live_scores", LIVE + "SELECT * FROM scores")
def live_scores(spark, sf_dir):
    return slates.live_scores(live_rows(spark, sf_dir))


@plan(
    "g07_survivors",
    """.
r AS (SELECT match_id, competition_id, least(home_team_id, away_team_id) AS lo, greatest(home_team_id, away_team_id) AS hi, epoch(kickoff_at)::BIGINT AS tm FROM matches),
g AS (SELECT *, CASE WHEN tm - lag(tm) OVER w <= 48 * 3600 THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY competition_id, lo, hi ORDER BY tm, match_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY competition_id, lo, hi ORDER BY tm, match_id ROWS UNBOUNDED PRECEDING) AS isl FROM g),
k AS (SELECT match_id, tm, min(match_id) OVER (PARTITION BY competition_id, lo, hi, isl) AS cluster_id FROM i), n AS (SELECT match_id, count(*) AS n FROM results GROUP BY 1)
SELECT cluster_id, k.match_id AS survivor_id, count(*) OVER (PARTITION BY cluster_id) AS members FROM k LEFT JOIN n ON n.match_id = k.match_id
QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY k.match_id % 4 = 1 DESC, k.match_id % 5 = 0, coalesce(n, 0) DESC, tm, k.match_id) = 1""",
)
def survivors(spark, sf_dir):
    found = derive.matches(spark, sf_dir).withColumn("is_placeholder", F.col("match_id") % 5 == 0)
    return slates.survivors(found, linking.fixture_clusters(found), found.where("match_id % 4 = 1"), derive.results(spark, sf_dir))


@plan(
    "g08_repointed_results",
    """.
mv AS (SELECT match_id, match_id - 1 AS survivor_id FROM matches WHERE match_id % 50 = 1)
SELECT CASE WHEN mv.match_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM results o WHERE o.match_id = mv.survivor_id AND o.source_id = r.source_id) THEN mv.survivor_id ELSE r.match_id END AS match_id, source_id, home_goals, away_goals FROM results r LEFT JOIN mv ON mv.match_id = r.match_id""",
)
def repointed_results(spark, sf_dir):
    rows = derive.results(spark, sf_dir).select("match_id", "source_id", "home_goals", "away_goals")
    moves = derive.matches(spark, sf_dir).where("match_id % 50 = 1").select("match_id", (F.col("match_id") - 1).alias("survivor_id"))
    return slates.repointed(rows, moves, ["source_id"])


@plan(
    "g10_orphan_matches",
    """.
pd AS (SELECT DISTINCT match_id FROM predictions WHERE match_id % 3 = 0), mid AS (SELECT (min(epoch(kickoff_at)::BIGINT) + max(epoch(kickoff_at)::BIGINT)) // 2 AS s FROM matches)
SELECT m.match_id, array_to_string(list_filter([CASE WHEN m.match_id % 2 = 0 THEN 'linked_to_slate' END, CASE WHEN EXISTS (SELECT 1 FROM results r WHERE r.match_id = m.match_id) THEN 'has_result' END, CASE WHEN m.match_id % 7 = 0 THEN 'has_feature_snapshot' END,
  CASE WHEN epoch(kickoff_at)::BIGINT < mid.s THEN 'outside_window' END], lambda f: f IS NOT NULL), ',') AS blockers FROM matches m JOIN pd USING (match_id), mid""",
)
def orphan_matches(spark, sf_dir):
    found = derive.matches(spark, sf_dir)
    middle = found.agg(F.expr("(min(unix_seconds(kickoff_at)) + max(unix_seconds(kickoff_at))) div 2").alias("since_s"))  # one row
    rows = found.join(F.broadcast(middle))
    return slates.orphans(rows, found.where("match_id % 2 = 0"), derive.results(spark, sf_dir), found.where("match_id % 7 = 0"), derive.predictions(spark, sf_dir).where("match_id % 3 = 0"), F.col("since_s"))


@plan("d19_match_counts", ". s AS (SELECT unnest([home_team_id, away_team_id]) AS team_id FROM matches) SELECT team_id, count(*) AS matches FROM s GROUP BY 1")
def match_counts(spark, sf_dir):
    return slates.side_counts(derive.matches(spark, sf_dir))


@plan(
    "h29_signatures",
    SLATES
    + """, fx AS (SELECT draw_code, CASE WHEN match_id % 23 <> 0 THEN match_id % 14 + 1 END AS position, CASE WHEN match_id % 31 <> 0 THEN 'Team "' || home_team_id || '"' END AS home, 'Team \\ ñ' || away_team_id AS away FROM matches JOIN slates ON slate_id = match_id // 14)
SELECT draw_code, sha256('{"draw_code": ' || coalesce(to_json(draw_code)::VARCHAR, 'null') || ', "fixtures": [' || string_agg('[' || coalesce(position::VARCHAR, 'null') || ', ' || coalesce(to_json(home)::VARCHAR, 'null') || ', ' || coalesce(to_json(away)::VARCHAR, 'null') || ']', ', ' ORDER BY position NULLS FIRST, home NULLS FIRST, away NULLS FIRST) || ']}') AS signature FROM fx GROUP BY draw_code""",
)
def signatures(spark, sf_dir):
    m = F.col("match_id")
    rows = derive.matches(spark, sf_dir).withColumn("slate_id", F.expr("match_id div 14")).join(all_slates(spark, sf_dir).select("slate_id", "draw_code"), "slate_id")
    home, away = F.concat(F.lit('Team "'), "home_team_id", F.lit('"')), F.concat(F.lit("Team \\ ñ"), "away_team_id")
    return slates.signatures(rows.select("draw_code", F.when(m % 23 != 0, m % 14 + 1).alias("position"), F.when(m % 31 != 0, home).alias("home"), away.alias("away")))


@plan(
    "m13_quality_scores",
    """.
q AS (SELECT match_id, match_id % 3 AS evidence, match_id % 4 AS recent, match_id % 5 AS h2h, ['unclassified', 'context_only', 'covered', 'ready'][match_id % 4 + 1] AS r, match_id % 6 AS av, match_id % 2 = 0 AS v FROM matches),
qs AS (SELECT match_id, CASE WHEN evidence > 0 THEN 30 ELSE 0 END + CASE WHEN recent >= 2 THEN 25 WHEN recent > 0 THEN 12 ELSE 0 END + CASE WHEN h2h > 0 THEN 20 ELSE 0 END + CASE WHEN r IN ('ready', 'covered') THEN 15 WHEN r = 'context_only' THEN 8 ELSE 0 END
  + CASE WHEN av > 0 THEN 5 ELSE 0 END + CASE WHEN v THEN 5 ELSE 0 END AS s FROM q)
SELECT match_id, least(s, 100) AS quality_score, CASE WHEN s >= 70 THEN 'good' WHEN s >= 40 THEN 'partial' ELSE 'thin' END AS quality_level FROM qs""",
)
def quality_scores(spark, sf_dir):
    k = F.col("match_id")
    rows = derive.matches(spark, sf_dir).select("match_id", (k % 3).alias("evidence"), (k % 4).alias("recent"), (k % 5).alias("h2h"), F.element_at(F.array(*map(F.lit, ["unclassified", "context_only", "covered", "ready"])), (k % 4 + 1).cast("int")).alias("readiness"), (k % 6).alias("availability"), (k % 2 == 0).alias("venue_known"))
    return slates.quality_score(rows)


@plan(
    "k17_money_decisions",
    """.
md AS (SELECT match_id, match_id % 19 = 0 AS db, ['live', 'pending', 'persisted', 'persisted'][match_id % 4 + 1] AS ps, match_id % 8 AS u, match_id % 15 AS n, match_id % 2 = 0 AS bc FROM matches)
SELECT match_id, CASE WHEN db OR ps = 'pending' OR coalesce(u / nullif(n, 0), 1.0) > 0.34 THEN 'NO_JUGAR' WHEN u > 0 THEN 'JUGAR_SOLO_CONSERVADOR' WHEN bc THEN 'JUGAR_BALANCEADO' ELSE 'JUGAR_SOLO_CONSERVADOR' END AS decision FROM md""",
)
def money_decisions(spark, sf_dir):
    k = F.col("match_id")
    rows = derive.matches(spark, sf_dir).select("match_id", (k % 19 == 0).alias("has_data_blockers"), F.element_at(F.array(*map(F.lit, ["live", "pending", "persisted", "persisted"])), (k % 4 + 1).cast("int")).alias("prediction_status"), (k % 8).alias("uncovered"), (k % 15).alias("match_count"), (k % 2 == 0).alias("balanced_covers"))
    return rows.select("match_id", slates.money_decision().alias("decision"))
