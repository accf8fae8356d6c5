"""Plans of entity lookups, fuzzy matching and narrative signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchloom.operators import entities, matching, narrative
from pitchloom.sources import derive

from .core import plan

TEAMS = """.
mp AS (SELECT *, match_id % 10 = 0 AS is_placeholder FROM matches),
teams AS (SELECT c_custkey AS team_id, 'Team ' || c_custkey AS name, c_custkey % 9 = 0 AS is_placeholder FROM customer),
aliases AS (SELECT c_custkey AS team_id, 'equipo-' || c_custkey AS normalized_alias FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'team-' || (c_custkey + 1) FROM customer WHERE c_custkey % 5 = 0),
ask AS (SELECT match_id AS request_id, CASE match_id % 3 WHEN 0 THEN 'Team ' || home_team_id WHEN 1 THEN 'Equipo ' || home_team_id ELSE 'Ghost ' || home_team_id END AS home_name, CASE match_id % 4 WHEN 3 THEN 'Ghost ' ELSE 'Team ' END || away_team_id AS away_name,
  epoch(kickoff_at)::BIGINT - 86400 AS closes_s FROM matches),
hit0 AS (SELECT request_id, side, team_id, t.is_placeholder, 1 AS by_name, t.name FROM (SELECT request_id, 'h' AS side, home_name AS name FROM ask UNION ALL SELECT request_id, 'a', away_name FROM ask) q JOIN teams t USING (name)
  UNION ALL SELECT request_id, side, team_id, t.is_placeholder, 0, t.name FROM (SELECT request_id, 'h' AS side, home_name AS name FROM ask UNION ALL SELECT request_id, 'a', away_name FROM ask) q JOIN aliases a ON a.normalized_alias = replace(lower(q.name), ' ', '-') JOIN teams t USING (team_id)),
hit AS (SELECT request_id, side, team_id FROM hit0 QUALIFY row_number() OVER (PARTITION BY request_id, side ORDER BY is_placeholder, by_name, name, team_id) = 1),
ids AS (SELECT a.request_id, h.team_id AS home_team_id, w.team_id AS away_team_id, closes_s FROM ask a LEFT JOIN hit h ON h.request_id = a.request_id AND h.side = 'h' LEFT JOIN hit w ON w.request_id = a.request_id AND w.side = 'a')
"""


def teams(spark, sf_dir):
    k = F.col("c_custkey")
    rows = derive.table(spark, sf_dir, "customer").select(k.alias("team_id"), F.concat(F.lit("Team "), k.cast("string")).alias("name"), (k % 9 == 0).alias("is_placeholder"))
    t = F.col("team_id")
    aliases = rows.where("team_id % 2 = 0").select("team_id", F.concat(F.lit("equipo-"), t.cast("string")).alias("normalized_alias")).unionByName(rows.where("team_id % 5 = 0").select("team_id", F.concat(F.lit("team-"), (t + 1).cast("string")).alias("normalized_alias")))
    return rows, aliases


def real_matches(spark, sf_dir):
    return derive.matches(spark, sf_dir).withColumn("is_placeholder", F.col("match_id") % 10 == 0)


def asked(spark, sf_dir):
    m, home, away = F.col("match_id"), F.col("home_team_id").cast("string"), F.col("away_team_id").cast("string")
    first = F.when(m % 3 == 0, "Team ").when(m % 3 == 1, "Equipo ").otherwise("Ghost ")
    slug = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("-"))
    rows = derive.matches(spark, sf_dir).select(m.alias("request_id"), F.concat(first, home).alias("home_name"), F.concat(F.when(m % 4 == 3, "Ghost ").otherwise("Team "), away).alias("away_name"), (F.unix_seconds("kickoff_at") - 86400).alias("closes_s"))
    return rows.select("*", slug(F.col("home_name")).alias("home_normalized"), slug(F.col("away_name")).alias("away_normalized"))


def pair_ids(spark, sf_dir):
    return entities.both_sides(asked(spark, sf_dir), *teams(spark, sf_dir))


@plan("c01_teams_by_alias", TEAMS + "SELECT request_id, team_id FROM hit WHERE side = 'h'")
def teams_by_alias(spark, sf_dir):
    wanted = asked(spark, sf_dir).select("request_id", F.col("home_name").alias("name"), F.col("home_normalized").alias("normalized"))
    return entities.by_alias(wanted, *teams(spark, sf_dir), "team_id")


@plan("c03_same_identity", "SELECT a.match_id AS request_id, b.match_id FROM matches a JOIN matches b USING (competition_id, home_team_id, away_team_id, kickoff_at)")
def same_identity(spark, sf_dir):
    found = derive.matches(spark, sf_dir)
    return entities.same_identity(found.withColumnRenamed("match_id", "request_id"), found)


@plan(
    "c05_upcoming_fixtures",
    TEAMS
    + """SELECT a.match_id AS request_id, b.match_id FROM matches a JOIN mp b ON a.home_team_id = b.away_team_id AND a.away_team_id = b.home_team_id AND NOT b.is_placeholder AND epoch(b.kickoff_at) BETWEEN epoch(a.kickoff_at) AND epoch(a.kickoff_at) + 200 * 86400
QUALIFY row_number() OVER (PARTITION BY a.match_id ORDER BY b.kickoff_at, b.match_id) = 1""",
)
def upcoming_fixtures(spark, sf_dir):
    """The return fixture within 200 days."""
    k = F.unix_seconds("kickoff_at")
    wanted = derive.matches(spark, sf_dir).select(F.col("match_id").alias("request_id"), F.col("away_team_id").alias("home_team_id"), F.col("home_team_id").alias("away_team_id"), k.alias("from_s"), (k + 200 * 86400).alias("to_s"))
    return entities.upcoming(wanted, real_matches(spark, sf_dir))


@plan(
    "c07_resolved_pairs",
    TEAMS
    + """SELECT i.request_id, m.match_id FROM ids i JOIN mp m ON m.home_team_id = i.home_team_id AND m.away_team_id = i.away_team_id AND NOT m.is_placeholder AND epoch(m.kickoff_at) BETWEEN closes_s - 12 * 3600 AND closes_s + 96 * 3600
QUALIFY row_number() OVER (PARTITION BY i.request_id ORDER BY m.kickoff_at, m.match_id) = 1""",
)
def resolved_pairs(spark, sf_dir):
    return entities.resolved_pairs(asked(spark, sf_dir), *teams(spark, sf_dir), real_matches(spark, sf_dir))


COMPETITIONS = """,
tc AS (SELECT team_id, competition_id, count(*) AS n FROM (SELECT competition_id, unnest([home_team_id, away_team_id]) AS team_id FROM mp WHERE NOT is_placeholder) GROUP BY 1, 2),
bc AS (SELECT i.request_id, m.competition_id, count(*) AS n FROM ids i JOIN mp m ON NOT m.is_placeholder AND (m.home_team_id IN (i.home_team_id, i.away_team_id) OR m.away_team_id IN (i.home_team_id, i.away_team_id))
  WHERE EXISTS (SELECT 1 FROM tc WHERE tc.team_id = i.home_team_id AND tc.competition_id = m.competition_id) AND EXISTS (SELECT 1 FROM tc WHERE tc.team_id = i.away_team_id AND tc.competition_id = m.competition_id) GROUP BY 1, 2),
bb AS (SELECT request_id, competition_id FROM bc QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY n DESC, competition_id) = 1)
"""


@plan("c08_shared_competitions", TEAMS + COMPETITIONS + "SELECT * FROM bb")
def shared_competitions(spark, sf_dir):
    known = pair_ids(spark, sf_dir).where("home_team_id is not null and away_team_id is not null")
    return entities.shared_competition(known, real_matches(spark, sf_dir))


@plan(
    "c23_inferred_competitions",
    TEAMS
    + COMPETITIONS
    + """,
mt AS (SELECT i.request_id, m.competition_id, count(*) AS n FROM ids i JOIN mp m ON NOT m.is_placeholder AND least(m.home_team_id, m.away_team_id) = least(i.home_team_id, i.away_team_id) AND greatest(m.home_team_id, m.away_team_id) = greatest(i.home_team_id, i.away_team_id)
  WHERE i.home_team_id IS NOT NULL AND i.away_team_id IS NOT NULL GROUP BY 1, 2), mb AS (SELECT request_id, competition_id FROM mt QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY n DESC, competition_id) = 1),
sg AS (SELECT i.request_id, tc.competition_id FROM ids i JOIN tc ON tc.team_id = coalesce(i.home_team_id, i.away_team_id) WHERE i.home_team_id IS NULL OR i.away_team_id IS NULL QUALIFY row_number() OVER (PARTITION BY i.request_id ORDER BY n DESC, tc.competition_id) = 1)
SELECT i.request_id, coalesce(mb.competition_id, bb.competition_id, sg.competition_id) AS competition_id FROM ids i LEFT JOIN mb USING (request_id) LEFT JOIN bb USING (request_id) LEFT JOIN sg USING (request_id)""",
)
def inferred_competitions(spark, sf_dir):
    return entities.inferred_competition(pair_ids(spark, sf_dir), real_matches(spark, sf_dir))


@plan(
    "c21_new_teams",
    TEAMS + "SELECT replace(lower(home_name), ' ', '-') AS normalized, min(home_name) AS name, count(*) AS requests FROM ask WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.request_id = ask.request_id AND side = 'h') GROUP BY 1",
)
def new_teams(spark, sf_dir):
    wanted = asked(spark, sf_dir).select("request_id", F.col("home_name").alias("name"), F.col("home_normalized").alias("normalized"))
    return entities.new_things(wanted, *teams(spark, sf_dir), "team_id")


@plan(
    "c22_promoted_flags",
    TEAMS + ", rq AS (SELECT home_team_id AS team_id, bool_and(match_id % 40 <> 0) AS asked FROM matches GROUP BY 1) SELECT team_id, is_placeholder AND coalesce(asked, true) AS is_placeholder FROM teams LEFT JOIN rq USING (team_id)",
)
def promoted_flags(spark, sf_dir):
    requests = derive.matches(spark, sf_dir).select(F.col("home_team_id").alias("team_id"), (F.col("match_id") % 40 != 0).alias("is_placeholder"))
    return entities.promoted_flags(requests, teams(spark, sf_dir)[0], "team_id")


@plan(
    "h34_shared_prefixes",
    """.
nn AS (SELECT match_id, ['team', 'toluca', 'tol', '', 'america'][match_id % 5 + 1] AS a, ['toluca fc', 'america', 'teams', 'to'][match_id % 4 + 1] AS b FROM matches)
SELECT match_id, a <> '' AND b <> '' AND (starts_with(a, left(b, 4)) OR starts_with(b, left(a, 4))) AS shares FROM nn""",
)
def shared_prefixes(spark, sf_dir):
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("match_id") % len(values) + 1).cast("int"))
    return derive.matches(spark, sf_dir).select("match_id", entities.shares_prefix(pick(["team", "toluca", "tol", "", "america"]), pick(["toluca fc", "america", "teams", "to"])).alias("shares"))


def provider_rows(spark, sf_dir):
    """Slate rows of every match, and provider fixtures of the same matches with other spellings, shifted dates, turned sides and lacking scores."""
    m = F.col("match_id")
    name = lambda c, word: F.concat(F.lit(word), F.col(c).cast("string"))
    club = lambda c: F.substring(F.md5(F.col(c).cast("string")), 1, 9)  # noqa: E731  names as unlike each other as clubs' are
    rows = derive.matches(spark, sf_dir)
    slate = rows.select(m.alias("row_id"), F.expr("match_id div 14").alias("slate_id"), club("home_team_id").alias("home"), club("away_team_id").alias("away"), name("competition_id", "league-").alias("competition"), F.to_date("kickoff_at").alias("date"))
    home, away = club("home_team_id"), F.when(m % 6 == 0, F.concat(F.lit("-"), F.substring(club("away_team_id"), 2, 8))).otherwise(club("away_team_id"))
    turned = m % 11 == 0
    fixtures = rows.where("match_id % 8 <> 7").select(
        m.alias("fixture_id"), F.when(turned, away).otherwise(home).alias("home"), F.when(turned, home).otherwise(away).alias("away"), F.when(m % 5 == 0, name("competition_id", "league-femenil-")).otherwise(name("competition_id", "league-")).alias("competition"),
        F.date_add(F.to_date("kickoff_at"), (m % 4).cast("int")).alias("date"), F.when(m % 9 == 0, "scheduled").otherwise("finished").alias("status"), (m % 10 != 0).alias("has_score"),
    )
    return slate, fixtures


@plan("f06_scored_candidates")
def scored_candidates(spark, sf_dir):
    return matching.scored_candidates(*provider_rows(spark, sf_dir))


@plan("c14_fixture_matches")
def fixture_matches(spark, sf_dir):
    slate, fixtures = provider_rows(spark, sf_dir)
    return matching.decided(slate, matching.scored_candidates(slate, fixtures))


PROVIDED = """.
sr AS (SELECT match_id AS row_id, match_id // 14 AS slate_id, 'team-' || home_team_id AS home, CASE WHEN match_id % 17 = 0 THEN '' ELSE 'team-' || away_team_id END AS away FROM matches),
pv AS (SELECT match_id * 7 % 1000003 AS seq, match_id, CASE WHEN match_id % 11 = 0 THEN a ELSE h END AS home, CASE WHEN match_id % 11 = 0 THEN h ELSE a END AS away, CASE WHEN match_id % 9 = 0 THEN 'scheduled' ELSE 'finished' END AS status
  FROM (SELECT match_id, 'team-' || home_team_id AS h, CASE WHEN match_id % 6 = 0 THEN 'taem-' ELSE 'team-' END || away_team_id AS a FROM matches WHERE match_id % 8 = 3)),
hi AS (SELECT row_id, min_by(struct_pack(seq := seq, status := status), seq) AS m FROM sr JOIN pv ON ((sr.home = pv.home AND sr.away = pv.away) OR (sr.home = pv.away AND sr.away = pv.home)) AND sr.home <> '' AND sr.away <> '' GROUP BY 1),
lo AS (SELECT row_id, min_by(struct_pack(seq := seq, status := status), seq) AS m FROM sr JOIN (SELECT seq, status, unnest([home, away]) AS name FROM pv) x ON x.name <> '' AND (x.name = sr.home OR x.name = sr.away) GROUP BY 1),
pp AS (SELECT sr.row_id, slate_id, CASE WHEN hi.m IS NOT NULL THEN 'high' WHEN lo.m IS NOT NULL THEN 'low' ELSE 'none' END AS confidence, coalesce(hi.m, lo.m) AS m FROM sr LEFT JOIN hi USING (row_id) LEFT JOIN lo USING (row_id))
"""


def provided(spark, sf_dir):
    """Slate rows and a provider's matches with normalised names, some turned round, misspelt or without a name."""
    m = F.col("match_id")
    name = lambda c, word="team-": F.concat(F.lit(word), F.col(c).cast("string"))
    rows = derive.matches(spark, sf_dir)
    slate = rows.select(m.alias("row_id"), F.expr("match_id div 14").alias("slate_id"), name("home_team_id").alias("home"), F.when(m % 17 == 0, "").otherwise(name("away_team_id")).alias("away"))
    home, away = name("home_team_id"), F.when(m % 6 == 0, name("away_team_id", "taem-")).otherwise(name("away_team_id"))
    provider = rows.where("match_id % 8 = 3").select((m * 7 % 1000003).alias("seq"), F.when(m % 11 == 0, away).otherwise(home).alias("home"), F.when(m % 11 == 0, home).otherwise(away).alias("away"), F.when(m % 9 == 0, "scheduled").otherwise("finished").alias("status"))
    return slate, provider


@plan("c15_provider_pairs", PROVIDED + "SELECT row_id, confidence, m.seq AS seq, m.status AS status FROM pp")
def provider_pairs(spark, sf_dir):
    return matching.paired_provider_rows(*provided(spark, sf_dir))


@plan("c28_match_rates", PROVIDED + "SELECT slate_id, count(*) AS positions, count(*) FILTER (WHERE confidence = 'high') AS matched, round(count(*) FILTER (WHERE confidence = 'high') / count(*), 4) AS match_rate FROM pp GROUP BY 1")
def match_rates(spark, sf_dir):
    slate, provider = provided(spark, sf_dir)
    return matching.match_rate(matching.paired_provider_rows(slate, provider), slate)


@plan(
    "h09_date_scores",
    "SELECT match_id, CASE WHEN match_id % 12 = 0 THEN 0.5 WHEN match_id % 5 = 0 THEN 1.0 WHEN match_id % 5 = 1 THEN 0.9 WHEN match_id % 5 = 2 THEN 0.75 ELSE 0.0 END::DOUBLE AS score FROM matches",
)
def date_scores(spark, sf_dir):
    day = F.when(F.col("match_id") % 12 != 0, F.to_date("kickoff_at"))
    return derive.matches(spark, sf_dir).select("match_id", matching.date_score(day, F.date_sub(F.to_date("kickoff_at"), (F.col("match_id") % 5).cast("int"))).cast("double").alias("score"))


TOLD = ["team {h} has an injured striker", "no verified injury for team {h}, rotation expected", "sin suspendidos; lesionado en {a}", "red card and suspension for team {a}", "nothing to tell", "alternate lineup: rested players of team {h}"]


def evidence_rows(spark, sf_dir):
    m = F.col("match_id")
    text = F.element_at(F.array(*map(F.lit, TOLD)), (F.expr("(match_id + k * 5) % 6") + 1).cast("int"))
    rows = derive.matches(spark, sf_dir).select("match_id", "home_team_id", "away_team_id", F.explode(F.sequence(F.lit(0), (m % 5).cast("int"))).alias("k"))
    filled = F.replace(F.replace(text, F.lit("{h}"), F.concat(F.lit("home"), F.col("home_team_id").cast("string"))), F.lit("{a}"), F.concat(F.lit("away"), F.col("away_team_id").cast("string")))
    return rows.select((m * 10 + F.col("k")).alias("item_id"), "match_id", filled.alias("text"))


EVIDENCE = (
    """.
ev AS (SELECT match_id * 10 + k AS item_id, match_id, replace(replace(["""
    + ", ".join(f"'{t}'" for t in TOLD)
    + """][(match_id + k * 5) % 6 + 1], '{h}', 'home' || home_team_id), '{a}', 'away' || away_team_id) AS text, 'home' || home_team_id AS hn, 'away' || away_team_id AS an FROM matches, range(5) r(k) WHERE k <= match_id % 5),
av AS (SELECT match_id, match_id % 2 = 0 AS home, ['injury', 'suspension', 'rotation'][match_id % 3 + 1] AS category, (match_id % 7) / 10 AS impact, ['Starter', 'bench player', NULL][match_id % 3 + 1] AS role, ['Goalkeeper', 'forward', 'mid', NULL][match_id % 4 + 1] AS position FROM matches WHERE match_id % 3 <> 1)
"""
)


def any_of(words):
    return "(" + " OR ".join(f"contains(text, '{w}')" for w in words) + ")"


SIGNALS = (
    EVIDENCE
    + ", es AS (SELECT match_id, contains(text, hn) AS h, contains(text, an) AS a, "
    + ", ".join(f"{any_of(narrative.KEYWORDS[k])} AND NOT {any_of(narrative.NEGATED[k])} AS {k}" for k in narrative.KEYWORDS)
    + " FROM ev), et AS (SELECT match_id, "
    + ", ".join(f"count(*) FILTER (WHERE {k}) AS {k}_t, count(*) FILTER (WHERE {k} AND h) AS {k}_h, count(*) FILTER (WHERE {k} AND a) AS {k}_a" for k in narrative.KEYWORDS)
    + " FROM es GROUP BY 1), aw AS (SELECT *, impact * greatest(least(CASE WHEN role = 'Starter' THEN 1.3 WHEN role = 'bench player' THEN 0.65 ELSE 1 END::DOUBLE * CASE position WHEN 'Goalkeeper' THEN 1.15 WHEN 'forward' THEN 1.1 ELSE 1 END::DOUBLE, 2), 0.35) AS w FROM av) SELECT m.match_id, "
    + ", ".join(f"{k}_t + coalesce((category = '{k}')::INT, 0) AS {k}_signal_total, {k}_h + coalesce((category = '{k}' AND home)::INT, 0) AS home_{k}_signals, {k}_a + coalesce((category = '{k}' AND NOT home)::INT, 0) AS away_{k}_signals" for k in narrative.KEYWORDS)
    + ", coalesce(round(CASE WHEN home THEN w ELSE 0 END, 3), 0) AS home_availability_impact, coalesce(round(CASE WHEN home THEN 0 ELSE w END, 3), 0) AS away_availability_impact FROM matches m JOIN et ON et.match_id = m.match_id LEFT JOIN aw ON aw.match_id = m.match_id"
)


@plan("d07_narrative_signals", SIGNALS)
def narrative_signals(spark, sf_dir):
    m = F.col("match_id")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (m % len(values) + 1).cast("int"))
    rows = derive.matches(spark, sf_dir)
    named = rows.select("match_id", "home_team_id", "away_team_id", F.concat(F.lit("home"), F.col("home_team_id").cast("string")).alias("home_name"), F.concat(F.lit("away"), F.col("away_team_id").cast("string")).alias("away_name"))
    absent = rows.where("match_id % 3 <> 1").select(
        "match_id", F.when(m % 2 == 0, F.col("home_team_id")).otherwise(F.col("away_team_id")).alias("team_id"), pick(["injury", "suspension", "rotation"]).alias("category"), (m % 7 / 10).alias("impact_score"), pick(["Starter", "bench player", None]).alias("role"), pick(["Goalkeeper", "forward", "mid", None]).alias("position")
    )
    return narrative.signals(named, evidence_rows(spark, sf_dir), absent)


@plan(
    "b08_evidence_summaries",
    """SELECT n_chars % 50 AS match_id, doc_id AS item_id, CASE WHEN len(t) > 320 THEN regexp_replace(left(t, 317), '\\s+$', '') || '...' ELSE t END AS summary FROM (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)
QUALIFY row_number() OVER (PARTITION BY n_chars % 50 ORDER BY doc_id) <= 3""",
)
def evidence_summaries(spark, sf_dir):
    docs = derive.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), (F.col("n_chars") % 50).alias("match_id"), "text")
    return narrative.summaries(docs)


REPORTS = ["Álvaro Núñez de la Torre is out", "João D'Alessandro suspendido", "no name, en duda", "Team news: Kevin O'Higgins returns", "rotacion", ""]


@plan(
    "h14_report_status",
    """.
rp AS (SELECT match_id, ["""
    + ", ".join("'" + r.replace("'", "''") + "'" for r in REPORTS)
    + """][match_id % 6 + 1] AS report FROM matches)
SELECT match_id, CASE WHEN regexp_matches(lower(report), 'out|ruled out|baja|no juega|descartado') THEN 'out' WHEN regexp_matches(lower(report), 'suspended|suspendido|suspension|expulsado') THEN 'suspended' WHEN regexp_matches(lower(report), 'doubtful|questionable|en duda') THEN 'doubtful'
  WHEN regexp_matches(lower(report), 'rotation|rotacion|rest|descanso') THEN 'rotation_risk' WHEN regexp_matches(lower(report), 'available|returns|regresa') THEN 'available' ELSE 'doubtful' END AS status,
  [ 'Álvaro Núñez', 'João D''Alessandro', NULL, 'Kevin O''Higgins', NULL, NULL][match_id % 6 + 1] AS player FROM rp""",
)
def report_status(spark, sf_dir):
    report = F.element_at(F.array(*map(F.lit, REPORTS)), (F.col("match_id") % 6 + 1).cast("int"))
    rows = derive.matches(spark, sf_dir).select("match_id", report.alias("report"))
    return rows.select("match_id", narrative.normal_status(F.col("report")).alias("status"), narrative.player_name(F.col("report")).alias("player"))
