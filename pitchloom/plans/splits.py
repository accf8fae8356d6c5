"""Plans of split team rows and of audits at a slate's close."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchloom.operators import splits
from pitchloom.sources import derive

from .core import plan
from .names import chosen

LABELS = ["manchester", "man united", "manchester united", "real", "manchester women", "seattle sounders", "seattle", "sea sounders", "mancha united", "ma united"]

SPLIT = f""".
sm AS (SELECT match_id, competition_id, home_team_id // 5 + CASE WHEN match_id % 9 = 0 THEN 1000000 ELSE 0 END AS h, away_team_id // 5 + CASE WHEN match_id % 31 = 0 THEN 2000000 ELSE 0 END AS a FROM matches),
ss AS (SELECT competition_id, unnest([h, a]) AS team_id FROM sm), sn AS (SELECT team_id, count(*) AS n FROM ss GROUP BY 1), sp AS (SELECT DISTINCT competition_id, team_id FROM ss),
tl AS (SELECT team_id, n, {LABELS}[(team_id % 1000000 + 3 * (team_id // 1000000)) % 10 + 1] AS label FROM sn),
tw AS (SELECT *, string_split(label, ' ') AS w, list_has_any(string_split(label, ' '), ['femenil', 'femenino', 'femenina', 'women', 'womens', 'w']) AS f FROM tl),
pr AS (SELECT x.team_id AS thin_team_id, x.n AS thin_matches, y.team_id AS rich_team_id, y.n AS rich_matches, 'League ' || p.competition_id AS name FROM tw x JOIN sp p ON p.team_id = x.team_id JOIN sp q ON q.competition_id = p.competition_id JOIN tw y ON y.team_id = q.team_id AND y.team_id <> x.team_id
  WHERE x.n <= 10 AND y.n >= 30 AND x.f = y.f AND x.label <> y.label AND (starts_with(y.label, x.label || ' ') OR (len(x.w) = len(y.w) AND len(x.w) >= 2 AND len(list_filter(range(1, len(x.w) + 1), lambda i: x.w[i] = y.w[i])) > 0
    AND len(list_filter(range(1, len(x.w) + 1), lambda i: x.w[i] = y.w[i] OR (least(len(x.w[i]), len(y.w[i])) >= 3 AND (starts_with(x.w[i], y.w[i]) OR starts_with(y.w[i], x.w[i]))))) = len(x.w)))),
pc AS (SELECT thin_team_id, thin_matches, rich_team_id, rich_matches, min(name) AS shared_competition FROM pr GROUP BY ALL)
SELECT * FROM pc QUALIFY row_number() OVER (PARTITION BY thin_team_id ORDER BY rich_matches DESC, rich_team_id) = 1"""


@plan("c16_split_candidates", SPLIT)
def split_candidates(spark, sf_dir):
    m = F.col("match_id")
    moved = lambda c, every, by: F.expr(f"{c} div 5") + F.when(m % every == 0, by).otherwise(0)
    matches = derive.matches(spark, sf_dir).select("match_id", "competition_id", moved("home_team_id", 9, 1_000_000).alias("home_team_id"), moved("away_team_id", 31, 2_000_000).alias("away_team_id"))
    ids = matches.select(F.explode(F.array("home_team_id", "away_team_id")).alias("team_id")).distinct()
    teams = ids.withColumn("k", F.col("team_id") % 1_000_000 + 3 * F.expr("team_id div 1000000")).select("team_id", chosen(LABELS, "k").alias("label"))
    leagues = matches.select("competition_id").distinct().withColumn("name", F.concat(F.lit("League "), F.col("competition_id").cast("string")))
    return splits.split_candidates(teams, matches, leagues)


AUDITS = [
    '{"raw_probabilities": {"L": 0.5, "E": 0.3, "V": 0.2}, "decision_probabilities": {"L": 0.45, "E": 0.3, "V": 0.25}, "ticket_strategy": "SIMPLE"}',
    '{"raw_probabilities": {"L": 0.6, "E": 0.2, "V": 0.2}, "decision_probabilities": {}, "display_probabilities": {"L": 0.4, "E": 0.35, "V": 0.25}}',
    '{"raw_probabilities": {"L": 0.6, "E": 0.2}, "decision_probabilities": {"L": 0.4, "E": 0.35, "V": 0.25}}', "broken", "", None, "[1]",
]
STOOD = (
    """.
pa AS (SELECT match_id * 3 + k AS prediction_id, match_id // 14 AS slate_id, match_id, CASE WHEN k = 1 AND match_id % 8 = 0 THEN 'old' ELSE 'h' || (match_id // 14 % 50) END AS composition_hash, kickoff_at - INTERVAL 1 DAY * ((match_id + k * 5) % 4) AS generated_at,
  ["""
    + ", ".join("NULL" if a is None else f"'{a}'" for a in AUDITS)
    + f"""][(match_id + k) % {len(AUDITS)} + 1] AS audit FROM matches, range(3) x(k)),
sl AS (SELECT match_id // 14 AS slate_id, CASE WHEN match_id // 14 % 11 = 0 THEN '' ELSE 'h' || (match_id // 14 % 50) END AS composition_hash, min(kickoff_at) + INTERVAL 2 DAY * 400 AS cutoff FROM matches GROUP BY ALL),
st AS (SELECT p.*, CASE WHEN json_valid(audit) AND audit LIKE '{{%' THEN audit END AS j FROM pa p JOIN sl s ON s.slate_id = p.slate_id AND s.composition_hash = p.composition_hash AND s.composition_hash <> '' AND generated_at <= cutoff),
sv AS (SELECT slate_id, match_id, prediction_id, generated_at, [(j ->> '$.raw_probabilities.L')::DOUBLE, (j ->> '$.raw_probabilities.E')::DOUBLE, (j ->> '$.raw_probabilities.V')::DOUBLE] AS r,
  CASE WHEN coalesce(j ->> '$.decision_probabilities', '{{}}') <> '{{}}' THEN [(j ->> '$.decision_probabilities.L')::DOUBLE, (j ->> '$.decision_probabilities.E')::DOUBLE, (j ->> '$.decision_probabilities.V')::DOUBLE]
    ELSE [(j ->> '$.display_probabilities.L')::DOUBLE, (j ->> '$.display_probabilities.E')::DOUBLE, (j ->> '$.display_probabilities.V')::DOUBLE] END AS d, j ->> '$.ticket_strategy' AS ticket_strategy FROM st WHERE j IS NOT NULL)
SELECT slate_id, match_id, prediction_id, r[1] AS raw_l, r[2] AS raw_e, r[3] AS raw_v, d[1] AS decision_l, d[2] AS decision_e, d[3] AS decision_v, ticket_strategy FROM sv WHERE r[1] + r[2] + r[3] IS NOT NULL AND d[1] + d[2] + d[3] IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY slate_id, match_id ORDER BY generated_at DESC, prediction_id DESC) = 1"""
)


@plan("c19_historical_audits", STOOD)
def historical_audits(spark, sf_dir):
    m, k = F.col("match_id"), F.col("k")
    rows = derive.matches(spark, sf_dir).withColumn("slate_id", F.expr("match_id div 14"))
    own = F.concat(F.lit("h"), (F.col("slate_id") % 50).cast("string"))
    each = rows.select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("k")).withColumn("a", m + k)
    back = F.timestamp_seconds(F.unix_seconds("kickoff_at") - 86400 * ((m + k * 5) % 4))
    predictions = each.select((m * 3 + k).alias("prediction_id"), "slate_id", "match_id", F.when((k == 1) & (m % 8 == 0), "old").otherwise(own).alias("composition_hash"), back.alias("generated_at"), chosen(AUDITS, "a").alias("audit"))
    slates = rows.groupBy("slate_id").agg(F.timestamp_seconds(F.min(F.unix_seconds("kickoff_at")) + 86400 * 800).alias("cutoff")).withColumn("composition_hash", F.when(F.col("slate_id") % 11 == 0, "").otherwise(own))
    return splits.historical_audits(predictions, slates)
