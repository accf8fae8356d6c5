"""Every plan with SQL against DuckDB on the smallest tables; the others against plain Python."""

import math
from pathlib import Path

import duckdb
import pytest

from pitchloom.plans import registry

DATA = "/root/testdata/sf0.001"


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if isinstance(value, float):
        return round(value, 5)
    return int(value) if type(value).__name__.startswith(("int", "uint")) else str(value)


def rows_of(names, tuples):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(t[i]) for i in order) for t in tuples), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_plan_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())


def test_elo_matches_loop(spark):
    from pitchloom.operators import rating
    from pitchloom.sources import derive

    played = derive.played(spark, DATA)
    got = {r.match_id: (r.home_after, r.away_after) for r in rating.elo(played).collect()}
    state: dict = {}
    for r in sorted(played.collect(), key=lambda r: (r.competition_id, r.kickoff_at, r.match_id)):
        h, a = state.get(r.home_team_id, 1500.0), state.get(r.away_team_id, 1500.0)
        d = 24 * ({"1": 1.0, "X": 0.5, "2": 0.0}[r.result_code] - 1 / (1 + 10 ** ((a - h - 75) / 400)))
        state[r.home_team_id], state[r.away_team_id] = h + d, a - d
        assert got[r.match_id] == pytest.approx((h + d, a - d))


def test_blend_sums_to_one(spark):
    rows = registry.queries()["i07_heuristic_blend"](spark, DATA).collect()
    assert rows and all(abs(r.p_home + r.p_draw + r.p_away - 1) < 1e-5 and min(r.p_home, r.p_draw, r.p_away) > 0 for r in rows)


def test_isotonic_is_monotone_and_mean_keeping(spark):
    from pitchloom.operators import evaluation

    rows = registry.queries()["i19_isotonic_curves"](spark, DATA).collect()
    for key in ("1", "X", "2"):
        curve = sorted((r.x, r.y) for r in rows if r.key == key)
        assert all(a[1] <= b[1] for a, b in zip(curve, curve[1:]))
    points = [("k", x, y) for x, y in [(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1), (0.4, 0), (0.5, 1), (0.6, 1)]]
    got = sorted((r.x, r.y) for r in evaluation.isotonic(spark.createDataFrame(points, "key string, x double, y int")).collect())
    assert got == [pytest.approx(p) for p in [(0.1, 0.0), (0.3, 0.5), (0.4, 0.5), (0.5, 1.0), (0.6, 1.0)]]  # a pool stands at its right edge; equal neighbours stay apart


def test_ticket_assignment_against_all(spark):
    from itertools import product

    from pitchloom.operators.tickets import assignment

    options = [(0.5, 0.3), (0.4, 0.35), (0.7, 0.2), (0.36, 0.34), (0.45, 0.3)]
    for doubles, triples in ((0, 0), (1, 1), (2, 1), (3, 2)):
        best = max(
            sum({"f": math.log(t), "d": math.log(t + s), "t": 0.0}[k] for k, (t, s) in zip(kinds, options))
            for kinds in product("fdt", repeat=5) if kinds.count("d") <= doubles and kinds.count("t") <= triples
        )
        kinds, value = assignment(options, doubles, triples)
        assert value == pytest.approx(best) and kinds.count("double") <= doubles and kinds.count("triple") <= triples


def test_future_match_changes_no_past_feature(spark):
    from pyspark.sql import functions as F

    from pitchloom.operators import features
    from pitchloom.sources import derive

    played = derive.played(spark, DATA).where("competition_id = 3").cache()
    last = played.agg(F.max("kickoff_at")).first()[0]
    before = {tuple(r) for r in features.recent_form(played.where(F.col("kickoff_at") < F.lit(last))).collect()}
    after = {tuple(r) for r in features.recent_form(played).collect()}
    assert before <= after


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_one_hot_key_is_folded_in_batches(spark):
    """All matches of two teams with one score: no plan collects a key's rows, and state goes on from batch to batch."""
    from datetime import datetime, timedelta

    from pitchloom.operators import rating, results

    t = datetime(2024, 1, 1)
    n = 500
    rows = [(i, 1, 2, 3, t + timedelta(hours=20 * i), 1, 0, "1") for i in range(n)]
    df = spark.createDataFrame(rows, "match_id long, competition_id long, home_team_id long, away_team_id long, kickoff_at timestamp, home_goals long, away_goals long, result_code string").repartition(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = {f: f(df) for f in (rating.elo, rating.moving_strength, results.without_repeats)}
        got = {f: d.collect() for f, d in found.items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for d in found.values():
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "FlatMapGroups" not in plan
    h, a, want = 1500.0, 1500.0, {}
    for i in range(n):
        d = 24 * (1 - 1 / (1 + 10 ** ((a - h - 75) / 400)))
        h, a = h + d, a - d
        want[i] = (h, a)
    assert len(got[rating.elo]) == n and all((r.home_after, r.away_after) == pytest.approx(want[r.match_id]) for r in got[rating.elo])
    assert {r.team_id: (r.offense, r.defense) for r in got[rating.moving_strength]} == {2: (1.25, 1.0), 3: (1.0, 1.25)}
    assert {r.match_id for r in got[results.without_repeats]} == set(range(n - 1, -1, -3))
