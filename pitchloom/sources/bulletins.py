"""Result bulletins and midweek guides as text: one row a position, read by expressions over a document's lines, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands behind a line's score or fixture, the words of a half-time, a running and a finished match, and the signs.
SCORED = ["FINAL(?:IZADO)?", "JUGADO", r"EN\s+VIVO", "VIVO", r"MEDIO\s+TIEMPO", "DESCANSO", "ENTRETIEMPO"]
UNPLAYED = ["PENDIENTE", "PROGRAMADO", r"NO\s+INICIADO", r"POR\s+JUGAR"]
HALF_TIME, RUNNING = ["MEDIO TIEMPO", "DESCANSO", "ENTRETIEMPO"], ["VIVO"]
SIGNS = {"L": "1", "E": "X", "V": "2", "1": "1", "X": "X", "2": "2"}
#: Positions of a bulletin, sizes of a row of signs, letters that begin a name in a guide, what stands for no team there, and what a name may inherit in front.
POSITIONS, ROW_SIZES = 14, [7, 9, 14]
CAPITALS = "A-ZÁÉÍÓÚÜÑ"
HEADINGS, CUPS = ["LOCAL", "VISITANTE", "LOCAL VISITANTE"], ["UEFA", "FIFA", "CONMEBOL", "CONCACAF", "AFC", "CAF", "OFC", "COPA", "VS"]
BEFORE_NAMES = ["LOCAL VISITANTE", "GUÍA DE LA QUINIELA", "LOCAL", "VISITANTE"]

PLACE = r"(?i)^(\d{1,2})[.)]?\s+"
SCORE_LINE = PLACE + rf"(.+?)\s+(\d{{1,2}})\s*[-:]\s*(\d{{1,2}})\s+(.+?)(?:\s+({'|'.join(SCORED)}))?(?:\s+(\d{{1,3}})\s*'?)?$"
FIXTURE_LINE = PLACE + rf"(.+?)\s+(?:VS|V\.S\.?|-)\s+(.+?)(?:\s+(?:{'|'.join(UNPLAYED)}))?$"
SIGN_LINE = PLACE + "([LEV12X])$"
SIGN_ROW = r"(?is)<tr[^>]*>\s*<td[^>]*>\s*(\d{3,5})\s*</td>\s*<td[^>]*>[^<]*</td>\s*<td[^>]*>\s*([LEV12X\s]+)</td>\s*</tr>"
LINE = "struct<position:int,home:string,away:string,home_goals:int,away_goals:int,result_code:string,status:string,minute:int,is_final:boolean>"
PAIR = "struct<position:int,home:string,away:string>"


def draw_code(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?i)CONCURSO\s+(\d{3,5})", 1), F.lit(""))


def squeezed(value: Column, edge: str) -> Column:
    """Single spaces, without what stands in `edge` (a class of characters) at either end."""
    return F.regexp_replace(F.regexp_replace(F.trim(value), r"\s+", " "), f"^[{edge}]+|[{edge}]+$", "")


def code_of(sign: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in SIGNS.items() for x in pair)), F.upper(sign))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def holds(value: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (value.contains(w) for w in words))


def line_of(line: Column) -> Column:
    """What one line says: a score, else a fixture without one, else a sign, else null."""
    part = lambda pattern, g: F.regexp_extract(line, pattern, g)
    name = lambda pattern, g: squeezed(part(pattern, g), ".,;:\\- ")
    none = lambda kind: F.lit(None).cast(kind)
    goals = [part(SCORE_LINE, g).cast("int") for g in (3, 4)]
    word = F.upper(part(SCORE_LINE, 6))
    status = F.when(holds(word, HALF_TIME), "halftime").when(holds(word, RUNNING), "live").otherwise("full_time")
    code = F.when(goals[0] > goals[1], "1").when(goals[0] < goals[1], "2").otherwise("X")
    row = lambda *values: F.struct(*values).cast(LINE)
    scored = row(part(SCORE_LINE, 1).cast("int"), name(SCORE_LINE, 2), name(SCORE_LINE, 5), *goals, code, status, F.nullif(part(SCORE_LINE, 7), F.lit("")).cast("int"), status == "full_time")
    open_ = row(part(FIXTURE_LINE, 1).cast("int"), name(FIXTURE_LINE, 2), name(FIXTURE_LINE, 3), none("int"), none("int"), none("string"), F.lit("scheduled"), none("int"), F.lit(False))
    signed = row(part(SIGN_LINE, 1).cast("int"), none("string"), none("string"), none("int"), none("int"), code_of(part(SIGN_LINE, 2)), F.lit("full_time"), none("int"), F.lit(True))
    return F.when(line.rlike(SCORE_LINE), scored).when(line.rlike(FIXTURE_LINE), open_).when(line.rlike(SIGN_LINE), signed)


def result_lines(text: Column) -> Column:
    """array of LINE by position: of the lines that name a position from 1 to 14 the first one of each."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    read = F.filter(F.transform(F.filter(lines, lambda x: x.rlike(r"^\d")), line_of), lambda x: x["position"].between(1, POSITIONS))
    places = lambda rows: F.transform(rows, lambda y: y["position"])
    first = lambda rows: bound(F.struct(rows.alias("rows"), places(rows).alias("at")), lambda r: F.filter(r["rows"], lambda x, i: F.array_position(r["at"], x["position"]) == i + 1))
    return F.array_sort(bound(read, first))


def sign_rows(text: Column) -> Column:
    """array of (draw_code, signs) of a page's rows of 7, 9 or 14 signs, as results without goals."""
    part = lambda g: F.regexp_extract_all(text, F.lit(SIGN_ROW), F.lit(g))
    codes = lambda row: F.transform(F.filter(F.split(row, r"\s+"), lambda s: F.length(s) == 1), code_of)
    rows = F.transform(F.arrays_zip(part(1).alias("draw"), part(2).alias("row")), lambda x: F.struct(x["draw"].alias("draw_code"), codes(x["row"]).alias("codes")))
    return F.filter(rows, lambda x: F.size(x["codes"]).isin(ROW_SIZES))


def results_of(documents: DataFrame) -> DataFrame:
    """documents (id, text) to id, draw_code and the fields of LINE, one row a position (A08); a text without such lines gives its first row of signs (A09), and no rows if it has none. Null texts give none."""
    first = F.get(F.col("__signs"), 0)
    as_lines = F.transform(first["codes"], lambda c, i: F.struct(i + 1, F.lit(None), F.lit(None), F.lit(None), F.lit(None), c, F.lit("full_time"), F.lit(None), F.lit(True)).cast(LINE))
    rows = documents.select("id", "text", result_lines(F.col("text")).alias("__lines"))
    rows = rows.select("id", "text", "__lines", F.when(F.size("__lines") == 0, sign_rows(F.col("text"))).alias("__signs"))
    listed = F.size("__lines") > 0
    return rows.select("id", F.when(listed, draw_code(F.col("text"))).otherwise(first["draw_code"]).alias("draw_code"), F.explode(F.when(listed, F.col("__lines")).otherwise(as_lines)).alias("x")).select("id", "draw_code", "x.*")


def midweek_fixtures(text: Column) -> Column:
    """array of (position, home, away) of a midweek guide, whose two columns are laid out one after the other.

    A text is cut at its CASILLERO marks. The away team is the first line behind a mark that begins with a capital. The home team is the last name before a VS between the mark before and this one; names before a VS
    behind the last mark go to the positions that lack one, in order; what is still without takes the last line in capitals before its mark, if it is neither a heading nor a body's short name. Positions without both teams are left out.
    """
    name = lambda s: squeezed(s, ".,;: ")
    team = lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(s), r"\s+", " "), r"^[.,;:\- ]+", ""), f"(?i)^(?:{'|'.join(BEFORE_NAMES)})", ""))
    names = lambda part, most, end: F.filter(F.transform(F.regexp_extract_all(part, F.lit(rf"([{CAPITALS}][{CAPITALS}.\s]{{0,{most}}}?)\s*\n?\s*VS{end}"), F.lit(1)), name), lambda n: (n != "") & ~n.isin(HEADINGS))
    last = lambda values: F.when(F.size(values) > 0, F.element_at(values, -1))
    trimmed = lambda part: F.transform(F.split(part, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    in_capitals = lambda lines: F.filter(lines, lambda x: x.rlike(rf"^[{CAPITALS}][{CAPITALS}\s.]{{2,50}}$") & ~x.isin(HEADINGS + CUPS))
    begins = lambda lines: F.get(F.filter(lines, lambda x: x.rlike(f"^[{CAPITALS}]")), 0)
    part = lambda g: F.struct(team(last(names(g, 60, r"\s*(?:\n|\z)"))).alias("home"), team(last(in_capitals(trimmed(g)))).alias("bare"), team(begins(trimmed(g))).alias("away"))
    numbers = F.regexp_extract_all(text, F.lit(r"CASILLERO\s+(\d{1,2})"), F.lit(1))
    tail = lambda gaps: names(F.element_at(gaps, -1), 50, r"\b")
    read = bound(F.split(text, r"CASILLERO\s+\d{1,2}"), lambda gaps: F.struct(numbers.alias("numbers"), F.transform(gaps, part).alias("parts"), tail(gaps).alias("orphans")))

    def fixtures(r: Column) -> Column:
        lacking = lambda i: F.size(F.filter(F.slice(r["parts"], 1, i + 1), lambda p: p["home"].isNull()))
        home = lambda i: F.coalesce(F.get(r["parts"], i)["home"], team(F.get(r["orphans"], lacking(i) - 1)), F.get(r["parts"], i)["bare"])
        away = lambda i: F.get(F.filter(F.transform(F.slice(r["parts"], i + 2, F.size(r["parts"])), lambda p: p["away"]), lambda a: a.isNotNull()), 0)
        return F.transform(r["numbers"], lambda n, i: F.struct(n.cast("int"), home(i), away(i)).cast(PAIR))

    return F.filter(bound(read, fixtures), lambda f: f["home"].isNotNull() & (f["home"] != "") & f["away"].isNotNull() & (f["away"] != ""))
