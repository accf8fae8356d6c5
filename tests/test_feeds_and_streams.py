import json
import time
from datetime import datetime

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchloom.functions import text
from pitchloom.operators import linking, results
from pitchloom.sources import derive, feeds
from pitchloom.streaming import live

GUIDE = """GUÍA DE LA QUINIELA
CONCURSO 77
LOCAL VISITANTE NORTE VS
CASILLERO 1
SUR
. ESTE VS
CASILLERO 2
OESTE
ALFA VS
CASILLERO 1
BETA
"""


def test_guide_stops_where_positions_fall(spark):
    r = spark.createDataFrame([(GUIDE,), ("",), (None,)], "t string").select(feeds.guide_fixtures(F.col("t")).alias("f"), feeds.draw_code(F.col("t")).alias("d")).collect()
    assert [tuple(x) for x in r[0].f] == [(1, "NORTE", "SUR"), (2, "ESTE", "OESTE")] and r[0].d == "77"
    assert r[1].f == [] and r[1].d is None


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("match,url,home_team,away_team\nA - B,u,A,B\n")
    (tmp_path / "s.csv").write_text("League,Home,Away,HG,AG,Date\nL,A,B,2,x,03/02/2024\nL,A,B,1,1,\n")
    (tmp_path / "j.json").write_text(json.dumps({"items": [{"title": "t1"}, {"title": "t2", "url": "u"}]}))
    (tmp_path / "x.xml").write_text("<rss><item><title>a</title><description>b</description><link>c</link></item></rss>")
    assert feeds.csv_documents(spark, str(tmp_path / "a.csv")).first().title == "A - B"
    season = feeds.season_results(spark, str(tmp_path / "s.csv")).collect()
    assert season[0].home_goals == 2 and season[0].away_goals is None and season[0].played_at.month == 2 and season[1].played_at is None
    assert [r.title for r in feeds.json_documents(spark, str(tmp_path / "j.json")).collect()] == ["t1", "t2"]
    assert feeds.rss_documents(spark, str(tmp_path / "x.xml")).first().summary == "b"


def test_scoreboard_gates_goals_on_finish(spark):
    schema = "league string, id string, status string, date string, competitors array<struct<homeAway: string, team: string, score: string>>"
    side = lambda k, t, s: (k, t, s)
    rows = [("l", "1", "FINISHED", "d", [side("home", "A", "2"), side("away", "B", "0")]), ("l", "1", "FINISHED", "d", [side("home", "A", "2"), side("away", "B", "0")]), ("l", "2", "LIVE", "d", [side("home", "A", "1"), side("away", "B", "0")]), ("l", "3", "LIVE", "d", [side("home", "A", "1")])]
    got = {r.id: r.home_goals for r in feeds.scoreboard_fixtures(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"1": 2, "2": None}


def test_names(spark):
    rows = spark.createDataFrame([("Cruz Azúl",), ("Cruz Azul Femenil",), (None,), ("",)], "n string").select(text.slug(F.col("n")).alias("s")).collect()
    assert [r.s for r in rows] == ["cruz-azul", "cruz-azul-femenil", None, ""]
    k = spark.createDataFrame([("copa-x",), ("gold-cup",), ("liga-mx",), (None,)], "s string").select(text.knockout(F.col("s")).alias("k")).collect()
    assert [r.k for r in k] == [True, None, False, None]
    a = spark.createDataFrame([("man city", "manchester city"), ("man city", "man city"), ("a b", "c d")], "a string, b string").select(text.abbreviates(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in a] == [True, False, False]


def test_greedy_48_hours(spark):
    from datetime import datetime, timedelta

    t = datetime(2024, 1, 1)
    rows = [(i, 1, 2, 3, t + timedelta(hours=h), 1, 0, "1") for i, h in enumerate((0, 40, 80))]
    df = spark.createDataFrame(rows, "match_id long, competition_id long, home_team_id long, away_team_id long, kickoff_at timestamp, home_goals long, away_goals long, result_code string")
    assert {r.match_id for r in results.without_repeats(df).collect()} == {0, 2}
    assert {r.cluster_id for r in linking.fixture_clusters(df).collect()} == {0}


def test_live_stream_equals_batch(spark, tmp_path):
    rows = derive.live(spark, "/root/testdata/sf0.001")
    edges = [T.Row(event_id=10**6 + i, match_id=-1, source_id=1, observed_at=datetime(2030, 1, 1, i), status=s, minute=m, home_goals=h, away_goals=a) for i, (s, m, h, a) in enumerate([("live", 10, 1, 0), ("full_time", None, None, 2), ("live", 95, 0, 0), ("full_time", 90, 3, None)])]
    rows = rows.unionByName(spark.createDataFrame(edges, rows.schema))
    thirds = rows.withColumn("third", F.ntile(3).over(W.orderBy("observed_at", "event_id")))
    for k in range(3):
        thirds.where(F.col("third") == k + 1).drop("third").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        time.sleep(1.1)  # files are read in the order of their times
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = live.live_states(stream).writeStream.outputMode("update").format("memory").queryName("live_states").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    columns = ["match_id", "source_id", "status", "minute", "home_goals", "away_goals", "is_final"]
    seen = {(r.match_id, r.source_id): tuple(r[c] for c in columns) for r in spark.table("live_states").collect()}  # the last update of each key stays
    want = {(r.match_id, r.source_id): tuple(r[c] for c in columns) for r in results.live_state(rows).collect()}
    assert seen == want and seen[(-1, 1)] == (-1, 1, "full_time", 90, 3, 2, True)


def test_merge_rules():
    final = live.merge(None, ("full_time", 90, 2, 1, 10, 1))
    assert live.merge(final, ("live", 50, 0, 0, 20, 2)) == final
    now = live.merge(None, ("live", 10, 1, 0, 5, 1))
    assert live.merge(now, ("live", 20, None, None, 6, 2))[2:4] == (1, 0)
    assert live.merge(now, ("live", 5, 0, 0, 4, 0)) == now
