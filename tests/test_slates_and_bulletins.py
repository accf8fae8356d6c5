"""Bulletins, versioned slates, links and coverage: odd rows, and plain Python beside the operators."""

import hashlib
import json
import random
from datetime import datetime, timedelta
from itertools import product

import pytest
from pyspark.sql import functions as F

from pitchloom.functions import text
from pitchloom.operators import linking, tickets, validation, versions
from pitchloom.sources import bulletins

BULLETIN = """RESULTADOS
Concurso 2301
1. MÉXICO  2-1  SUDÁFRICA FINAL 90'
1 OTRO 0-0 MISMO
 2) Águilas - Pumas U.N.A.M. Por  jugar
3 x
4 TEAM A 1:1 TEAM B MEDIO TIEMPO 45
5 C 0-3 D en vivo 77'
15 E 1-0 F
0 L
99 X
6 G V.S. H.
7 Z
"""
PAGE = "<table><tr><td>800</td><td>x</td><td>L E V</td></tr>\n<tr class='a'> <td>801</td><td>12/07</td>\n<td> l e v 1 X 2 L L E </td></tr><tr><td>802</td><td></td><td>L L L L L L L</td></tr></table>"


def test_bulletins_give_the_first_line_of_each_position(spark):
    rows = [("a", BULLETIN), ("b", PAGE), ("c", ""), ("d", None), ("e", "CONCURSO 12345\nnothing\n"), ("f", "Concurso 77\r\n1 A 1-0 B\r\n" + PAGE), ("g", BULLETIN)]
    got = {}
    for r in bulletins.results_of(spark.createDataFrame(rows, "id string, text string")).collect():
        got.setdefault((r.id, r.draw_code), []).append((r.position, r.home, r.away, r.home_goals, r.away_goals, r.result_code, r.status, r.minute, r.is_final))
    want = [
        (1, "MÉXICO", "SUDÁFRICA", 2, 1, "1", "full_time", 90, True), (2, "Águilas", "Pumas U.N.A.M", None, None, None, "scheduled", None, False), (3, None, None, None, None, "X", "full_time", None, True),
        (4, "TEAM A", "TEAM B", 1, 1, "X", "halftime", 45, False), (5, "C", "D", 0, 3, "2", "live", 77, False), (6, "G", "H", None, None, None, "scheduled", None, False),
    ]
    signs = [(i, None, None, None, None, c, "full_time", None, True) for i, c in enumerate("1X21X211X", start=1)]
    assert got == {("a", "2301"): want, ("g", "2301"): want, ("b", "801"): signs, ("f", None): [(1, "A", "B", 1, 0, "1", "full_time", None, True)]}


def test_midweek_guide_with_two_columns(spark):
    guide = """PROGOL MEDIA SEMANA
CONCURSO 803
LOCAL VISITANTE
ARGENTINA VS
CASILLERO 1
2.10 momios
 ARGELIA
PAÍSES BAJOS
UEFA
CASILLERO 2
JAPÓN
CASILLERO 3
QATAR
la casa
SUIZA.
VS CASILLERO 4
ECUADOR
pie
CANADÁ
VS
"""
    rows = spark.createDataFrame([(1, guide), (2, ""), (3, None), (4, "CASILLERO 1"), (5, "A VS\nCASILLERO 2\nB")], "id int, text string")
    got = {r.id: r.f and [tuple(x) for x in r.f] for r in rows.select("id", bulletins.midweek_fixtures(F.col("text")).alias("f")).collect()}
    assert got == {1: [(1, "ARGENTINA", "ARGELIA"), (2, "CANADÁ", "JAPÓN"), (3, "JAPÓN", "QATAR"), (4, "SUIZA", "ECUADOR")], 2: [], 3: None, 4: [], 5: [(2, "A", "B")]}


def digest(draw, week, fixtures):
    rows = [{"position": p, "home_team": h.strip().lower(), "away_team": a.strip().lower(), "kickoff_at": at.isoformat() + "+00:00", "competition": c.strip().lower()} for p, h, a, at, c in sorted(fixtures)]
    return hashlib.sha256(json.dumps({"draw_code": draw, "week_type": week, "fixtures": rows}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


FIXTURE = "struct<position:long,home_team:string,away_team:string,kickoff_at:timestamp,competition:string>"
START = datetime(2026, 7, 1, 19, 30)


def slate(*homes, at=START):
    return [(i, h, f"Away {i}", at, "Copa MX") for i, h in enumerate(homes, start=1)]


def test_digest_is_that_of_canonical_json(spark):
    odd = [(2, "  Nandú \t", 'A "b" \\ c', START, "L/M"), (1, "日本 😀", "é", START + timedelta(microseconds=1500), "")]
    rows = spark.createDataFrame([("D1", "weekend", odd), ("D2", None, slate("x")), ("Ñ", "midweek", []), ("D4", "midweek", None)], f"draw string, week string, fixtures array<{FIXTURE}>")
    got = {r.draw: r.h for r in rows.select("draw", versions.composition_hash(F.col("draw"), F.col("week"), F.col("fixtures")).alias("h")).collect()}
    assert got == {"D1": digest("D1", "weekend", odd), "D2": digest("D2", None, slate("x")), "Ñ": None, "D4": None}


def test_slates_change_version_once_a_change(spark):
    one, two = slate("A", "B"), slate("A", "C")
    stored = "slate_id string, draw_code string, label string, week_type string, closes_at long, is_archived boolean, composition_hash string, slate_version int"
    slates = spark.createDataFrame([("s1", "D1", "l", "weekend", 1, False, digest("D1", "weekend", one), 4), ("s2", "D2", "l", "weekend", 1, False, None, None), ("s3", "D3", "l", "weekend", 1, True, "old", 2)], stored)
    batch = [("D1", 1, "p", "weekend", 9, True, two), ("D1", 2, "q", "weekend", 8, False, one), ("D2", 1, "p", "weekend", 9, False, one), ("D9", 1, "p", "weekend", 9, False, one), ("D9", 2, "r", "weekend", 9, False, two), ("D9", 3, "r", "weekend", 9, False, two)]
    payloads = spark.createDataFrame(batch, f"draw_code string, seq int, label string, week_type string, closes_at long, is_archived boolean, fixtures array<{FIXTURE}>")
    after = versions.upserted_slates(slates, payloads)
    got = {r.draw_code: (r.slate_id, r.label, r.closes_at, r.is_archived, r.composition_hash, r.slate_version) for r in after.collect()}
    assert got == {"D1": ("s1", "q", 8, False, digest("D1", "weekend", one), 6), "D2": ("s2", "p", 9, False, digest("D2", "weekend", one), 1), "D3": ("s3", "l", 1, True, "old", 2), "D9": ("draw-D9", "r", 9, False, digest("D9", "weekend", two), 2)}
    last = payloads.where("(draw_code, seq) in (('D1', 2), ('D2', 1), ('D9', 3))")
    again = versions.upserted_slates(after, last)
    assert sorted(map(str, again.collect())) == sorted(map(str, after.collect()))
    assert versions.upserted_slates(slates, payloads.limit(0)).exceptAll(slates).count() == 0
    snapshots = spark.createDataFrame([("s1", True, None, None, 1), ("s1", False, 3, "old", 2), ("s2", True, None, None, 3), ("s3", True, None, None, 4)], "slate_id string, is_valid boolean, invalidated_at long, reason string, n int")
    gone = {r.n: (r.is_valid, r.invalidated_at, r.reason) for r in versions.invalidated(snapshots, slates, payloads, F.lit(50).cast("long")).collect()}
    assert gone == {1: (False, 50, "composition_changed_from_" + digest("D1", "weekend", one)[:8]), 2: (False, 3, "old"), 3: (True, None, None), 4: (True, None, None)}
    links = spark.createDataFrame([("D1", 1, False, "operator"), ("D1", 2, False, "auto")], "draw_code string, position long, is_knockout boolean, knockout_source string")
    new = {(r.draw_code, r.position): (r.is_knockout, r.knockout_source) for r in versions.relinked(links, slates, payloads).collect()}
    assert new[("D1", 1)] == (False, "operator") and new[("D1", 2)] == (True, "auto") and len(new) == 6


def test_links_equal_all_pairs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)] + ["real"] * 6
    name = lambda low, high: "-".join(dict.fromkeys(rng.choice(words) for _ in range(rng.randint(low, high))))
    fixtures = [(i, START + timedelta(days=rng.randint(0, 3)), name(1, 3), name(0, 3), name(0, 2)) for i in range(60)]
    fixtures += [(100 + i, *f[1:]) for i, f in enumerate(fixtures[:5])]
    documents = [(i, " ".join(rng.choice(words).upper() + "," for _ in range(rng.randint(0, 8)))) for i in range(120)] + [(900, None), (901, "")]
    got = {r.hay_id: (r.match_id, r.confidence) for r in linking.linked_to_fixtures(spark.createDataFrame(documents, "hay_id int, text string"), spark.createDataFrame(fixtures, "match_id long, kickoff_at timestamp, home string, away string, competition string")).collect()}
    want = {}
    for (hay, body), (k, at, *names) in product(documents, fixtures):
        found = set((body or "").lower().replace(",", "").split())
        sets = [set(n.split("-")) - {""} for n in names]
        held = [len(s & found) for s in sets]
        if held[0] and held[1] and sum(held) / sum(map(len, sets)) >= 0.55:
            want[hay] = max(want.get(hay, (0,)), (sum(held) / sum(map(len, sets)), at, -k))
    assert len(want) > 20 and got == {hay: (-w[2], pytest.approx(round(w[0], 2), abs=0.0101)) for hay, w in want.items()}


def test_names_by_alias_keep_whole_names_only(spark):
    rows = spark.createDataFrame([(1, "Club C. Azul"), (2, "C. Azul"), (3, None), (4, "FC"), (5, "Atlético de Madrid")], "k int, name string")
    aliases = spark.createDataFrame([("c azul", "cruz-azul")], "alias string, slug string")
    assert {r.k: r.n for r in text.normalized(rows, "name", aliases, text.TEAM_WORDS, "n").collect()} == {1: "c-azul", 2: "cruz-azul", 3: None, 4: "", 5: "atletico-madrid"}


def test_coverage_of_small_slates(spark):
    rows = [(1, 1, 0.5, 0.3, 0.2, None, 3), (2, 1, 0.5, 0.3, 0.2, 2, 3), (2, 2, 0.2, 0.2, 0.6, None, 2)]
    got = {(r.slate_id, r.mode, r.hits): r for r in tickets.coverage_modes(spark.createDataFrame(rows, "slate_id int, position int, p_home double, p_draw double, p_away double, doubles_rank int, full_rank int")).collect()}
    assert len(got) == 9  # one number of hits for the slate of one, two for the slate of two
    assert got[(1, "simple", 1)].chance == 0.5 and got[(1, "simple", 1)].tickets_for_half == 1 and got[(1, "full", 1)].tickets_for_half is None
    assert got[(2, "doubles", 2)].chance == pytest.approx(0.8 * 0.6) and got[(2, "doubles", 1)].chance == pytest.approx(1 - 0.2 * 0.4) == got[(2, "doubles", 1)].near_jackpot
    assert got[(2, "full", 2)].jackpot == pytest.approx(0.8) and got[(2, "full", 2)].target_met and not got[(2, "simple", 2)].target_met


def test_provider_scores_that_cannot_be_read(spark):
    rows = [("2-0", "finished", "L"), (" 1 - 1 ", "finished", "E"), ("0-3", "live", None), ("x-1", "finished", None), ("21", "finished", None), ("", "finished", None), (None, "finished", None), ("1-2-3", "finished", None)]
    got = spark.createDataFrame(rows, "score string, status string, want string").select("want", validation.provider_sign(F.col("score"), F.col("status")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_watcher_as_a_stream_replays_and_restarts(spark, tmp_path):
    from pitchloom.operators import watch
    from pitchloom.streaming import watch as stream

    schema = "feed long, tick_id long, seen_s long, digest string, draw_code string, week_type string, fixtures long, closes_s long, close_source string, accepted boolean, rejected_draw string"
    tick = lambda i, digest, draw="MS 806": (1, i, i * 100, digest, draw, "midweek", 9, None, None, False, "800")
    ticks = [tick(1, "a"), tick(2, None), tick(3, "a"), tick(4, "b"), tick(5, "a", "MS 807"), tick(6, "a", "MS 807"), (2, 1, 100, None, None, None, None, None, None, None, None)]
    batch = watch.remembered(spark.createDataFrame(ticks, schema))
    assert [(r.tick_id, r.changed, r.changed_s, r.first_s) for r in batch.where("feed = 1").orderBy("tick_id").collect()] == [(1, True, 100, 100), (2, False, 100, 100), (3, False, 100, 100), (4, True, 400, 100), (5, True, 500, 500), (6, False, 500, 500)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        found = stream.remembered(spark.readStream.schema(schema).parquet(source))
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    run(ticks[:3])
    run(ticks[:4])  # the first three again
    run(ticks[4:])
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, batch.collect()))


def test_deadlines_by_precedence(spark):
    from pitchloom.operators import watch

    schema = "feed int, tick_id int, seen_s long, digest string, draw_code string, week_type string, fixtures int, closes_s long, close_source string, accepted boolean, rejected_draw string, changed boolean, changed_s long, first_s long"
    day = 86400
    row = lambda i, draw, closes=None, by=None, other="800", at=1000: (1, i, at, "x", draw, "midweek", 9, closes, by, closes is not None, other, True, at, 500)
    rows = [row(1, "806"), row(2, "807", 5000), row(3, "807", 5000, watch.PROVISIONAL), row(4, "808"), row(5, "809"), row(6, "810", None, None, None), row(7, "811"), row(8, "812", 900), row(9, None), row(10, "806", None, None, "800", 500 + 6 * day)]
    overrides = spark.createDataFrame([("PGM-807", 100, 7000), ("PGM-807", 200, 800), ("PGM-807", 2000, 9000), ("PGM-806", 10, None)], "draw_code string, recorded_s long, closes_s long")
    slates = spark.createDataFrame([(1, "PGM-806", 10**9, None), (2, "PGM-807", 6000, None), (3, "PGM-808", 3000, None), (4, "PGM-809", 10**9, 900), (5, "PGM-810", None, None), (7, "PGM-812", None, None)], "slate_id int, draw_code string, first_kickoff_s long, observed_s long")
    got = {r.tick_id: (r.slate_id, r.closes_s, r.close_source, r.status) for r in watch.decided(spark.createDataFrame(rows, schema), overrides, slates).collect()}
    shut = (None, None, None, "changed_invalid")
    assert got == {
        1: (1, 500 + 5 * day, watch.PROVISIONAL, "changed_invalid"), 2: (2, 5000, watch.OFFICIAL, "changed_valid"), 3: (2, 7000, watch.OPERATOR, "changed_valid"), 4: (3, 3000, watch.PROVISIONAL, "changed_invalid"), 5: shut, 6: shut, 7: shut,
        8: (None, None, None, "changed_valid"), 9: shut, 10: shut,
    }


def test_documents_share_one_new_item(spark):
    from pitchloom.operators import evidence

    documents = spark.createDataFrame([(1, None, 7, "s", 10, " Title", None, "a", 0.5), (2, None, 7, "s", 20, "TITLE ", "", "b", 0.6), (3, "e1", 8, "s", 30, None, None, "c", 0.7), (4, "gone", None, None, None, None, None, None, None)], "document_id long, linked_evidence_id string, match_id long, source_id string, captured_s long, title string, url string, summary string, confidence double")
    items = spark.createDataFrame([("e1", 9, "t", "note", 1, "old", "u", "old", 0.1), ("e2", 7, "s", "note", 1, "title", None, "x", 0.2)], "evidence_id string, match_id long, source_id string, kind string, captured_s long, title string, url string, summary string, confidence double")
    after = evidence.evidence_after(documents, items)
    want = {("e1", 9, "t", "note", 1, None, None, "c", 0.7), ("e2", 7, "s", "note", 1, "title", None, "x", 0.2), ("doc-1", 7, "s", "news", 10, "TITLE ", "", "b", 0.6), ("doc-4", None, None, "news", None, None, None, None, None)}
    assert {tuple(r) for r in after.collect()} == want
    linked = evidence.links_after(documents, items)
    assert {r.document_id: r.linked_evidence_id for r in linked.collect()} == {1: "doc-1", 2: "doc-1", 3: "e1", 4: "doc-4"}
    assert {tuple(r) for r in evidence.evidence_after(linked, after).collect()} == want
    assert evidence.evidence_after(documents.limit(0), items).exceptAll(items).count() == 0


@pytest.mark.parametrize(
    ("files", "want"),
    [
        ([], ["xgboost", "xgboost", "heuristic_blend", "placeholder"]),
        ([(2, '{"competitions": [{"competition_key": "a", "xgboost_beats_heuristic": true}, {"competition_key": "b", "xgboost_beats_heuristic": false}]}')], ["xgboost", "heuristic_blend_gated", "heuristic_blend", "placeholder"]),
        ([(1, "{broken"), (2, '{"competitions": []}')], ["xgboost", "xgboost", "heuristic_blend", "placeholder"]),
        ([(1, '{"other": 1}')], ["heuristic_blend_gated", "heuristic_blend_gated", "heuristic_blend_gated", "placeholder"]),
    ],
)
def test_engines_by_verdict(spark, files, want):
    from pitchloom.operators import policy

    rows = [(1, "a", "xgboost_multiclass", 5, True), (2, "b", "xgboost_multiclass", 5, True), (3, "a", "xgboost_multiclass", 5, None), (4, None, None, None, None)]
    found = policy.engines(spark.createDataFrame(rows, "k int, competition_key string, model_type string, sample_size int, has_score boolean"), spark.createDataFrame(files, "rank int, text string"))
    assert [r.engine for r in found.orderBy("k").collect()] == want
