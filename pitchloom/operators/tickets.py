"""Tickets: Poisson-binomial coverage, prices and limits as columns; the exact assignment of doubles and triples per slate."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most doubles, most triples, most combinations and the price, by product.
LIMITS = {"weekend": (8, 5, 324, 15.0), "midweek": (3, 2, 72, 15.0), "revancha": (3, 2, 72, 5.0)}
FLOOR = 1e-9


def coverage_pmf(p: Column) -> Column:
    """Distribution of the number of hits of independent picks, by convolution."""
    step = lambda pmf, x: F.zip_with(F.concat(F.transform(pmf, lambda v: v * (1 - x)), F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), F.transform(pmf, lambda v: v * x)), lambda a, b: a + b)
    return F.aggregate(p, F.array(F.lit(1.0)), step)


def at_least(pmf: Column, k: int) -> Column:
    """The tail from k on: 1 where k is not positive, 0 beyond the number of picks."""
    if k <= 0:
        return F.lit(1.0)
    return F.aggregate(F.slice(pmf, k + 1, F.greatest(F.size(pmf), F.lit(1))), F.lit(0.0), lambda s, v: s + v)


def coverage(rows: DataFrame, checkpoints: tuple[int, ...] = (8, 10, 12)) -> DataFrame:
    """Per slate: expected hits of the top picks and the chances of at least so many; tickets for an even chance of all."""
    slates = rows.groupBy("slate_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "top"))), lambda x: x["top"]).alias("p"))
    slates = slates.withColumn("pmf", coverage_pmf(F.col("p")))
    clean = F.element_at("pmf", -1)
    half = F.when((clean > 0) & (clean < 1), F.ceil(math.log(0.5) / F.log1p(-clean)))
    return slates.select("slate_id", F.size("p").cast("long").alias("positions"), F.round(F.aggregate("p", F.lit(0.0), lambda s, x: s + x), 6).alias("expected"), *(F.round(at_least(F.col("pmf"), k), 6).alias(f"at_least_{k}") for k in checkpoints), F.round(clean, 9).alias("clean"), half.cast("long").alias("tickets_for_half"))


#: Share of a slate that a ticket aims at, and the chance of it that is enough.
TARGET, ENOUGH = 0.9, 0.8


def coverage_modes(rows: DataFrame) -> DataFrame:
    """Per slate and ticket (simple, doubles, full) and number of hits from half the slate on: the chance of so many, next to the ticket's expected hits, target, chances of all and of all but one, and tickets for an even chance.

    rows: slate_id, position, P, doubles_rank, full_rank: signs covered by the two larger tickets, null for one. A slate's positions are few and make one row.
    """
    ordered = F.array_sort(F.array("p_home", "p_draw", "p_away"))
    hit = lambda rank: F.when(rank == 2, F.least(ordered[2] + ordered[1], F.lit(1.0))).when(rank == 3, F.lit(1.0)).otherwise(ordered[2])
    modes = {"simple": F.lit(1), "doubles": F.col("doubles_rank"), "full": F.col("full_rank")}
    slates = rows.groupBy("slate_id").agg(F.array_sort(F.collect_list(F.struct("position", *(hit(rank).alias(name) for name, rank in modes.items())))).alias("x"))
    each = slates.select("slate_id", F.explode(F.array(*(F.struct(F.lit(name).alias("mode"), F.col(f"x.{name}").alias("p")) for name in modes))).alias("m")).select("slate_id", "m.*")
    n = F.size("p")
    each = each.select("slate_id", "mode", "p", n.alias("n"), F.greatest(F.lit(1), F.least(F.ceil(n * TARGET).cast("int"), n)).alias("target"), coverage_pmf(F.col("p")).alias("pmf"))
    tail = lambda k: F.aggregate(F.slice("pmf", k + 1, F.col("n") + 1), F.lit(0.0), lambda s, v: s + v)
    least = F.greatest(F.lit(1), F.floor(F.col("n") / 2).cast("int"))
    each = each.withColumns({"target_probability": F.when(F.col("target") >= least, F.round(tail(F.col("target")), 6)).otherwise(0.0), "all": tail(F.col("n"))})
    half = F.when((F.col("all") > 0) & (F.col("all") < 1), F.ceil(math.log(0.5) / F.log1p(-F.col("all"))))
    return each.select(
        "slate_id", "mode", F.round(F.aggregate("p", F.lit(0.0), lambda s, x: s + x), 4).alias("expected"), F.col("target").cast("long").alias("target_floor"), "target_probability", (F.col("target_probability") >= ENOUGH).alias("target_met"), F.round("all", 6).alias("jackpot"),
        F.round(F.when(F.col("n") >= 2, tail(F.col("n") - 1)).otherwise(F.col("all")), 6).alias("near_jackpot"), half.cast("long").alias("tickets_for_half"), F.explode(F.transform(F.sequence(least, F.col("n")), lambda k: F.struct(k.cast("long").alias("hits"), F.round(tail(k), 6).alias("chance")))).alias("c"),
    ).select("*", "c.*").drop("c")


def pick(kind: Column, index: int) -> Column:
    value = F.lit(None)
    for name, limits in LIMITS.items():
        value = F.when(kind == name, F.lit(limits[index])).otherwise(value)
    return value


def priced(rows: DataFrame) -> DataFrame:
    """Combinations, violations of the product's limits and the cost, null for an unknown product (K13 to K15). rows: week_type, doubles, triples."""
    kind, d, t = F.col("week_type"), F.col("doubles"), F.col("triples")
    combos = (F.pow(F.lit(2.0), d) * F.pow(F.lit(3.0), t)).cast("long")
    limit = lambda i, other: F.coalesce(pick(kind, i), F.lit(other))
    broken = F.array_compact(F.array(F.when(d > limit(0, 3), "too_many_doubles"), F.when(t > limit(1, 2), "too_many_triples"), F.when(combos > limit(2, 72), "too_many_combinations")))
    return rows.select("*", combos.alias("combinations"), F.array_join(broken, ",").alias("violations"), (combos * pick(kind, 3)).alias("cost"))


def assignment(options: list[tuple[float, float]], doubles: int, triples: int) -> tuple[list[str], float]:
    """The best use of the budget by dynamic programming over (doubles, triples) used; options are (top, second). Ties keep what was found first."""
    best = {(0, 0): (0.0, ())}
    for top, second in options:
        gains = (("fixed", 0, 0, math.log(max(top, FLOOR))), ("double", 1, 0, math.log(max(top + second, FLOOR))), ("triple", 0, 1, 0.0))
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (d, t), (value, kinds) in sorted(best.items()):
            for kind, dd, dt, gain in gains:
                key = (d + dd, t + dt)
                if key[0] <= doubles and key[1] <= triples and (key not in new or value + gain > new[key][0]):
                    new[key] = (value + gain, (*kinds, kind))
        best = new
    top_value, winner = -math.inf, ()
    for _, (value, kinds) in sorted(best.items()):
        if value > top_value:
            top_value, winner = value, kinds
    return list(winner), top_value


def extended(pmf: list[float], p: float) -> list[float]:
    """A distribution of hits after one more pick of chance p."""
    return [a * (1 - p) + b * p for a, b in zip([*pmf, 0.0], [0.0, *pmf])]


def summed(rows: np.ndarray) -> np.ndarray:
    """The sum of each row with Python's own compensation, so that a slate gets what `sum` would give it alone."""
    high, low = np.zeros(len(rows)), np.zeros(len(rows))
    for x in rows.T:
        t = high + x
        low += np.where(np.abs(high) >= np.abs(x), (high - t) + x, (x - t) + high)
        high = t
    return high + low


#: What a state has used (doubles, triples) and its distributions of hits, their tails and kinds (numbers in KINDS), a row a slate.
Covered = dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]
KINDS = np.array(["fixed", "double", "triple"], dtype=object)


def covered_states(top: np.ndarray, second: np.ndarray, doubles: int, triples: int, need: int) -> Covered:
    """The states of K02 of all slates of one length at once (top, second: a row a slate). A state follows from smaller ones only, so those of a smaller budget are among them."""
    n, positions = top.shape
    tail = lambda pmf: np.ones(n) if need <= 0 else summed(pmf[:, need:])
    states: Covered = {(0, 0): (np.ones((n, 1)), np.ones(n), np.zeros((n, positions), dtype=np.int8))}
    for i in range(positions):
        fixed, double = np.clip(top[:, i], 0.0, 1.0), np.clip(top[:, i] + second[:, i], 0.0, 1.0)
        new: Covered = {}
        for d, t in ((d, t) for d in range(doubles + 1) for t in range(triples + 1)):
            for kind, before, p in ((1, (d - 1, t), double), (2, (d, t - 1), np.ones(n)), (0, (d, t), fixed)):
                if before not in states:
                    continue
                pmf, _, kinds = states[before]
                p, edge = p[:, None], np.zeros((n, 1))
                longer = np.hstack([pmf, edge]) * (1 - p) + np.hstack([edge, pmf]) * p
                reached, kinds = tail(longer), kinds.copy()
                kinds[:, i] = kind
                if (d, t) in new:
                    old = new[d, t]
                    better = reached > old[1]
                    longer, reached, kinds = np.where(better[:, None], longer, old[0]), np.where(better, reached, old[1]), np.where(better[:, None], kinds, old[2])
                new[d, t] = longer, reached, kinds
        states = new
    return states


def best_state(states: Covered, doubles: int, triples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each slate's distribution, tail and kinds with the best tail within the budget; of equals, the fewest doubles."""
    found = [s for (d, t), s in sorted(states.items(), key=lambda x: x[0]) if d <= doubles and t <= triples]
    at = np.argmax(np.stack([s[1] for s in found]), axis=0)
    return tuple(np.stack([s[k] for s in found])[at, np.arange(len(at))] for k in range(3))


def sides(options: list[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.array(options, dtype=float).reshape(1, -1, 2)
    return rows[:, :, 0], rows[:, :, 1]


def coverage_plan(options: list[tuple[float, float]], doubles: int, triples: int, need: int) -> tuple[list[str], float, float]:
    """Kinds, chance of `need` hits or more, expected hits: each state (doubles, triples used) keeps the distribution with the best tail, so the result is near the best rather than the best."""
    pmf, chance, kinds = best_state(covered_states(*sides(options), doubles, triples, need), doubles, triples)
    return KINDS[kinds[0]].tolist(), float(chance[0]), float(summed(pmf * np.arange(pmf.shape[1]))[0])


def least_budgets(states: Covered, target: float, doubles: int, triples: int) -> tuple[np.ndarray, ...]:
    """Doubles, triples, chance and whether the target is reached, of each slate: the first budget, few triples before few doubles, that reaches it; else the best one."""
    order = [(d, t) for t in range(triples + 1) for d in range(doubles + 1)]
    chances = np.stack([best_state(states, d, t)[1] for d, t in order])
    reached = chances >= target
    at = np.where(reached.any(axis=0), np.argmax(reached, axis=0), np.argmax(chances, axis=0))
    used = np.array(order, dtype=np.int64)[at]
    return used[:, 0], used[:, 1], chances[at, np.arange(len(at))], reached.any(axis=0)


def least_budget(options: list[tuple[float, float]], target: float, need: int, doubles: int, triples: int) -> tuple[int, int, float, bool]:
    """One slate's budget by `least_budgets`."""
    d, t, chance, reached = least_budgets(covered_states(*sides(options), doubles, triples, need), target, doubles, triples)
    return int(d[0]), int(t[0]), float(chance[0]), bool(reached[0])


def by_length(rows: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[pa.Array]], schema: str) -> DataFrame:
    """Runs an array function on the slates of a batch that have equally many positions: slate ids, and positions, top and second with a row a slate. All slates of a length take one pass of the DP together."""
    slates = rows.groupBy("slate_id").agg(F.array_sort(F.collect_list(F.struct("position", "top", "second"))).alias("p"))
    names = T.StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("slate_id").to_numpy(), batch.column("p")
            sizes, values = lists.value_lengths().to_numpy(), lists.flatten()
            starts = np.cumsum(sizes) - sizes
            position, top, second = (values.field(c).to_numpy(zero_copy_only=False) for c in ("position", "top", "second"))
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                at = starts[own][:, None] + np.arange(size)
                yield pa.RecordBatch.from_arrays(work(ids[own], position[at], top[at], second[at]), names=names)

    return slates.mapInArrow(run, schema)


def by_slate(rows: DataFrame, columns: list[str], work: Callable[[tuple], list[tuple]], schema: str) -> DataFrame:
    """Runs a plain function on each slate's positions in order. A slate is one row with its 14 positions at most, so many slates pass in a batch."""
    slates = rows.groupBy("slate_id").agg(F.array_sort(F.collect_list(F.struct("position", *columns))).alias("p"))
    kind = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for slate, positions in zip(batch.column("slate_id").to_pylist(), batch.column("p").to_pylist(), strict=True):
                out += work((slate, [tuple(x[c] for c in ("position", *columns)) for x in positions]))
            values = list(zip(*out, strict=True)) if out else [[]] * len(kind)
            types = {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array(v, types[f.dataType.simpleString()]) for v, f in zip(values, kind)], names=kind.names)

    return slates.mapInArrow(run, kind)


def optimised(rows: DataFrame, doubles: int, triples: int) -> DataFrame:
    """slate_id, position, decision and the slate's log chance of going clean."""

    def work(slate: tuple) -> list[tuple]:
        slate_id, positions = slate
        kinds, value = assignment([(t, s) for _, t, s in positions], doubles, triples)
        return [(slate_id, p[0], k, value) for p, k in zip(positions, kinds, strict=True)]

    return by_slate(rows, ["top", "second"], work, "slate_id long, position long, decision string, log_clean double")


def covered_plans(rows: DataFrame, doubles: int, triples: int, share: float = 0.9) -> DataFrame:
    """slate_id, position, decision, and the slate's chance of a share of hits and expected hits."""

    def work(ids: np.ndarray, position: np.ndarray, top: np.ndarray, second: np.ndarray) -> list[pa.Array]:
        size = position.shape[1]
        pmf, chance, kinds = best_state(covered_states(top, second, doubles, triples, math.ceil(share * size)), doubles, triples)
        expected = summed(pmf * np.arange(size + 1))
        return [pa.array(np.repeat(ids, size)), pa.array(position.reshape(-1)), pa.array(KINDS[kinds.reshape(-1)], pa.string()), pa.array(np.repeat(chance, size)), pa.array(np.repeat(expected, size))]

    return by_length(rows, work, "slate_id long, position long, decision string, chance double, expected double")


def budgets(rows: DataFrame, target: float, doubles: int, triples: int, share: float = 0.6) -> DataFrame:
    """Per slate the least doubles and triples that reach the target."""

    def work(ids: np.ndarray, position: np.ndarray, top: np.ndarray, second: np.ndarray) -> list[pa.Array]:
        states = covered_states(top, second, doubles, triples, math.ceil(share * position.shape[1]))
        return [pa.array(ids), *map(pa.array, least_budgets(states, target, doubles, triples))]

    return by_length(rows, work, "slate_id long, doubles_needed long, triples_needed long, chance double, target_reached boolean")


#: Budgets by product: doubles of the doubles-only ticket, doubles and triples of the full one. Chances from which a draw is live.
BUDGETS = {"weekend": (8, 2, 4), "midweek": (3, 3, 2), "revancha": (3, 3, 2)}
LIVE_DRAW, STRONG_DRAW = 0.25, 0.30
RANK = {"fixed": 1, "double": 2, "triple": 3}


def ticket_ranks(p: list[tuple[float, float, float]], week: str) -> tuple[list[int], list[int]]:
    """Coverage (1 to 3 signs) of each position in the doubles-only and in the full ticket.

    Plans by K01; the full ticket never covers less than the other (K08); triples that are left go to live draws that nothing covers, the strongest first (K10); then coverage is taken back
    until the ticket is one that can be bought, what no plan asked for first, then the least probable sign (K09).
    """
    order = [sorted(range(3), key=lambda s: -x[s]) for x in p]
    ranked = [(x[o[0]], x[o[1]], x[o[2]]) for x, o in zip(p, order)]
    most_doubles, both_doubles, both_triples = BUDGETS[week]
    plan = lambda d, t: [RANK[k] for k in assignment([(a, b) for a, b, _ in ranked], d, t)[0]]
    doubles, planned = plan(most_doubles, 0), plan(both_doubles, both_triples)
    full = [max(a, b) for a, b in zip(planned, doubles)]
    left = both_triples - sum(r == 3 for r in planned)
    uncovered = [i for i, x in enumerate(p) if x[1] >= LIVE_DRAW and 1 not in order[i][: doubles[i]] and 1 not in order[i][: full[i]]]
    for i in sorted(uncovered, key=lambda i: (-p[i][1], i))[: max(0, left)]:
        full[i] = 3
    high = LIMITS[week]
    for ranks, own in ((doubles, doubles[:]), (full, planned)):
        while True:
            d, t = ranks.count(2), ranks.count(3)
            if d <= high[0] and t <= high[1] and 2**d * 3**t <= high[2]:
                break
            choices = [(own[i] >= r, ranked[i][r - 1], 2 / 3 if r == 3 else 1 / 2, i) for i, r in enumerate(ranks) if r > 1]
            ranks[min(choices)[3]] -= 1
    return doubles, full


def legal_tickets(rows: DataFrame) -> DataFrame:
    """slate_id, position, signs covered by the doubles-only and the full ticket, after all rules (K08 to K10). rows: slate_id, position, week_type, P."""

    def work(slate: tuple) -> list[tuple]:
        slate_id, positions = slate
        doubles, full = ticket_ranks([x[2:] for x in positions], positions[0][1])
        return [(slate_id, x[0], a, b) for x, a, b in zip(positions, doubles, full, strict=True)]

    return by_slate(rows, ["week_type", "p_home", "p_draw", "p_away"], work, "slate_id long, position long, doubles_rank long, full_rank long")


def draw_risk(rows: DataFrame) -> DataFrame:
    """How likely a draw is, and which tickets cover it (K12). rows: match_id, P, doubles_rank, full_rank."""
    h, d, a = (F.col(c) for c in ("p_home", "p_draw", "p_away"))
    rank = 1 + (h > d).cast("int") + (a > d).cast("int")
    place = rank + ((h == d).cast("int"))  # among equals, home stands before the draw
    return rows.select("match_id", F.round(d, 4).alias("p_draw"), rank.alias("draw_rank"), (d >= LIVE_DRAW).alias("is_live_draw"), (d >= STRONG_DRAW).alias("is_strong_draw"), (place <= 1).alias("covered_simple"), (place <= F.col("doubles_rank")).alias("covered_doubles"), (place <= F.col("full_rank")).alias("covered_full"))


def ticket_totals(rows: DataFrame) -> DataFrame:
    """Per slate: singles, doubles, triples, combinations and the positions that must not stay single but do (K16). rows: slate_id, position, rank, no_simple."""
    return rows.groupBy("slate_id").agg(
        F.count_if(F.col("rank") == 1).alias("simples"), F.count_if(F.col("rank") == 2).alias("doubles"), F.count_if(F.col("rank") == 3).alias("triples"), F.product("rank").cast("long").alias("combinations"),
        F.count_if(F.col("no_simple") & (F.col("rank") == 1)).alias("uncovered_no_simple"), (F.count_if(F.col("no_simple") & (F.col("rank") == 1)) == 0).alias("covers_all_no_simple"),
    )


def risk_profile(rows: DataFrame) -> DataFrame:
    """Entropy, gaps and the additive risk that ranks positions for doubles and triples (K11). rows: P, band, anchors."""
    ordered = F.array_sort(F.array("p_home", "p_draw", "p_away"))
    rows = rows.select("*", ordered[2].alias("first"), ordered[1].alias("mid"), ordered[0].alias("third"))
    spread = -sum(F.greatest(F.col(x), F.lit(0.001)) * F.log(F.greatest(F.col(x), F.lit(0.001))) for x in ("first", "mid", "third")) / math.log(3)
    gap, low_gap = F.round(F.col("first") - F.col("mid"), 9), F.col("mid") - F.col("third")
    by_band = F.when(F.col("band") == "high", -0.08).when(F.col("band") == "medium", 0.02).when(F.col("band") == "low", 0.14).when(F.col("band") == "blocked", 0.16).otherwise(0.08)
    by_anchor = F.when(F.col("anchors") <= 0, 0.08).when(F.col("anchors") < 2, 0.03).otherwise(-0.02)
    by_gap = F.when(gap <= 0.08, 0.14).when(gap <= 0.14, 0.08).when(gap <= 0.22, 0.03).otherwise(-0.04)
    by_third = F.when(F.col("third") >= 0.24, 0.09).when(F.col("third") >= 0.20, 0.05).otherwise(0.0)
    risk = spread + by_band + by_anchor + by_gap + by_third
    out = rows.select("match_id", spread.alias("entropy"), gap.alias("top_gap"), risk.alias("risk"), (risk + F.col("mid") * 0.7 - gap * 0.35).alias("double_score"), (risk + F.col("third") * 1.45 - gap * 0.18 - low_gap * 0.1).alias("triple_score"))
    return out.select("match_id", *(F.round(x, 6).alias(x) for x in out.columns[1:]))
