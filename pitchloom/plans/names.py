"""Plans of names and stages, over fixtures of odd spellings."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchloom.functions import text
from pitchloom.sources import derive

from .core import plan

NAMES = ["TBD", "  Por  Definir ", "Pendiénte", "?", "G", "A", "Ab", None, " ", "Ünknown", "América", "Pachuca Femenil"]
STAGES = ["Final", "Semi-Final", "Round of 16", "17", "Group A", "Final Group Stage", "Liguilla", "Jornada 5", "Fase de grupos", "", None, "League phase", "Play-off", "Eliminatorias"]


def listed(values):
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def chosen(values, key):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.col(key) % len(values) + 1).cast("int"))


@plan(
    "b09_suspicious_names",
    f""".
nm AS (SELECT c_custkey, {listed(NAMES)}[c_custkey % {len(NAMES)} + 1] AS name FROM customer), nf AS (SELECT *, trim(regexp_replace(lower(strip_accents(coalesce(name, ''))), '\\s+', ' ', 'g')) AS f FROM nm)
SELECT c_custkey, name, len(f) < 2 OR f IN ('g', 'tbd', 'por definir', 'pendiente', 'unknown', '?') AS suspicious FROM nf""",
)
def suspicious_names(spark, sf_dir):
    rows = derive.table(spark, sf_dir, "customer").select("c_custkey", chosen(NAMES, "c_custkey").alias("name"))
    return rows.withColumn("suspicious", text.suspicious_name(F.col("name")))


STAGE_SQL = f""".
sn AS (SELECT c_custkey, {listed(STAGES)}[c_custkey % {len(STAGES)} + 1] AS stage, CASE c_custkey % 3 WHEN 0 THEN 'fa-cup' WHEN 1 THEN 'gold-cup' ELSE 'liga-mx' END AS slug FROM customer),
sf AS (SELECT *, trim(regexp_replace(lower(stage), '[^a-z0-9]+', ' ', 'g')) AS t FROM sn),
sk AS (SELECT c_custkey, stage, slug, CASE WHEN regexp_full_match(t, '[0-9]+') OR regexp_matches(t, 'group|grupo|regular season|league phase|fase de grupos') THEN false
  WHEN regexp_matches(t, 'final|round of|last 16|last 32|playoff|play off|liguilla|repechaje|octavos|cuartos|semis|eliminat|knockout') THEN true END AS by_stage FROM sf)
"""


@plan("b11_stage_knockout", STAGE_SQL + "SELECT c_custkey, stage, by_stage FROM sk")
def stage_knockout(spark, sf_dir):
    rows = derive.table(spark, sf_dir, "customer").select("c_custkey", chosen(STAGES, "c_custkey").alias("stage"))
    return rows.withColumn("by_stage", text.stage_knockout(F.col("stage")))


@plan("b12_resolved_knockout", STAGE_SQL + "SELECT c_custkey, stage, slug, coalesce(by_stage, CASE slug WHEN 'fa-cup' THEN true WHEN 'liga-mx' THEN false END) AS knockout FROM sk")
def resolved_knockout(spark, sf_dir):
    k = F.col("c_custkey") % 3
    rows = derive.table(spark, sf_dir, "customer").select("c_custkey", chosen(STAGES, "c_custkey").alias("stage"), F.when(k == 0, "fa-cup").when(k == 1, "gold-cup").otherwise("liga-mx").alias("slug"))
    return rows.withColumn("knockout", text.resolved_knockout(F.col("slug"), F.col("stage")))


@plan(
    "h10_gender_mismatch",
    f""".
nm AS (SELECT c_custkey, {listed(NAMES)}[c_custkey % {len(NAMES)} + 1] AS a, {listed(NAMES)}[c_custkey // 5 % {len(NAMES)} + 1] AS b FROM customer)
SELECT c_custkey, coalesce(regexp_matches(lower(a), 'femenil|femenino|femenina|women|womens|feminin'), false) <> coalesce(regexp_matches(lower(b), 'femenil|femenino|femenina|women|womens|feminin'), false) AS mismatch FROM nm""",
)
def gender_mismatch(spark, sf_dir):
    rows = derive.table(spark, sf_dir, "customer").withColumn("k", F.expr("c_custkey div 5")).select("c_custkey", chosen(NAMES, "c_custkey").alias("a"), chosen(NAMES, "k").alias("b"))
    return rows.select("c_custkey", text.gender_mismatch(F.col("a"), F.col("b")).alias("mismatch"))


@plan(
    "h11_abbreviations",
    """.
nb AS (SELECT c_custkey, ['Atl San Luis', 'Atletico San Luis', 'Cruz Azul', 'Man United', 'Manchester United', 'CF', 'Atl'][c_custkey % 7 + 1] AS a, ['Atletico San Luis', 'Manchester United', 'Cruz Azul', 'Atl San Luis', 'CF'][c_custkey // 3 % 5 + 1] AS b FROM customer),
nt AS (SELECT *, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM nb)
SELECT c_custkey, a, b, len(x) = len(y) AND len(list_filter(range(1, len(x) + 1), lambda i: starts_with(coalesce(y[i], ''), x[i]))) = len(x) AND len(list_filter(range(1, len(x) + 1), lambda i: x[i] = coalesce(y[i], ''))) > 0 AND a <> b AS abbreviates FROM nt""",
)
def abbreviations(spark, sf_dir):
    one, two = ["Atl San Luis", "Atletico San Luis", "Cruz Azul", "Man United", "Manchester United", "CF", "Atl"], ["Atletico San Luis", "Manchester United", "Cruz Azul", "Atl San Luis", "CF"]
    rows = derive.table(spark, sf_dir, "customer").withColumn("k", F.expr("c_custkey div 3")).select("c_custkey", chosen(one, "c_custkey").alias("a"), chosen(two, "k").alias("b"))
    return rows.withColumn("abbreviates", text.abbreviates(F.col("a"), F.col("b")))


ALIASED = ["Ath. Bilbao", "Club de Fútbol América", "Liga MX", "C Azul FC", "Pumas UNAM", "WCQ", "Primera División", None, "", "FC", "América  (Fem)", "ATH BILBAO"]
#: Known spellings, as the parameter of the plans.
ALIASES = [("ath bilbao", "athletic-bilbao"), ("wcq", "international-friendlies"), ("c azul fc", "cruz-azul"), ("pumas", "pumas-unam")]


def normal_sql(words):
    return f"""
na AS (SELECT c_custkey, {listed(ALIASED)}[c_custkey % {len(ALIASED)} + 1] || CASE WHEN c_custkey % 5 = 0 THEN ' ' || c_custkey ELSE '' END AS name FROM customer), al(alias, slug) AS (VALUES {", ".join(map(str, ALIASES))}),
nk AS (SELECT *, trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', ' ', 'g')) AS alias FROM na)
SELECT c_custkey, name, coalesce(slug, array_to_string(list_filter(string_split(alias, ' '), lambda w: w NOT IN {words}), '-')) AS normal FROM nk LEFT JOIN al USING (alias)"""


def normal_names(spark, sf_dir, words):
    key = F.col("c_custkey")
    rows = derive.table(spark, sf_dir, "customer").select("c_custkey", F.concat(chosen(ALIASED, "c_custkey"), F.when(key % 5 == 0, F.concat(F.lit(" "), key.cast("string"))).otherwise("")).alias("name"))
    return text.normalized(rows, "name", spark.createDataFrame(ALIASES, "alias string, slug string"), words, "normal")


@plan("h02_team_names", "." + normal_sql(text.TEAM_WORDS))
def team_names(spark, sf_dir):
    return normal_names(spark, sf_dir, text.TEAM_WORDS)


@plan("h03_competition_names", "." + normal_sql(text.COMPETITION_WORDS))
def competition_names(spark, sf_dir):
    return normal_names(spark, sf_dir, text.COMPETITION_WORDS)
