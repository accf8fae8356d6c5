"""Evaluation: calibration metrics, isotonic curves, drift, temperature, walk-forward checks, error attribution and shadow economics."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchloom.sources.landing import written

CLASSES = {"1": "p_home", "X": "p_draw", "2": "p_away"}
BINS = 10


def samples(predictions: DataFrame, canonical_rows: DataFrame) -> DataFrame:
    """Predictions with their result and, per row, top, second, pick (home before away before draw), own, hit, Brier score and log-loss."""
    return judged(predictions.join(canonical_rows.select("match_id", "result_code"), "match_id"))


def judged(rows: DataFrame) -> DataFrame:
    """`samples` of rows that hold their result_code: nothing is joined, so what they come from is computed once."""
    p = {k: F.col(c) for k, c in CLASSES.items()}
    top = F.greatest(*p.values())
    pick = F.when(p["1"] == top, "1").when(p["2"] == top, "2").otherwise("X")
    own = F.when(F.col("result_code") == "1", p["1"]).when(F.col("result_code") == "X", p["X"]).otherwise(p["2"])
    brier = sum((x - F.when(F.col("result_code") == k, 1.0).otherwise(0.0)) ** 2 for k, x in p.items())
    second = F.array_sort(F.array(*p.values()))[1]
    return rows.select("*", top.alias("top"), second.alias("second"), pick.alias("pick"), own.alias("own"), (pick == F.col("result_code")).alias("hit"), brier.alias("brier"), (-F.log(F.least(F.greatest(own, F.lit(1e-6)), F.lit(1 - 1e-6)))).alias("loss"))


def band() -> Column:
    """high from 0.55 with a margin of 0.12, medium from 0.40 with 0.02, else low (J06 without the evidence gate)."""
    margin = F.col("top") - F.col("second")
    return F.when((F.col("top") >= 0.55) & (margin >= 0.12), "high").when((F.col("top") >= 0.40) & (margin >= 0.02), "medium").otherwise("low")


def calibration(rows: DataFrame, by: str) -> DataFrame:
    """n, hit rate, top-2 rate, Brier, log-loss and the expected calibration error over BINS, for each value of `by` and for all (null).

    Two levels of aggregation: bins first, so what is shuffled is a few rows a task.
    """
    bin_ = F.least(F.floor(F.col("top") * BINS), F.lit(BINS - 1)).cast("long")
    bins = rows.withColumn("bin", bin_).groupBy("bin", by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"), F.count_if(F.col("own") >= F.col("second")).alias("top2"), F.sum("brier").alias("brier"), F.sum("loss").alias("loss"), F.sum("top").alias("conf"),
    )
    both = bins.select("*", F.lit(False).alias("all")).union(bins.select("bin", F.lit(None).cast("string").alias(by), *[c for c in bins.columns if c not in ("bin", by)], F.lit(True).alias("all")))
    merged = both.groupBy("all", by, "bin").agg(*(F.sum(c).alias(c) for c in ("n", "hits", "top2", "brier", "loss", "conf")))
    n = F.sum("n")
    return merged.groupBy("all", by).agg(
        n.alias("n"), F.round(F.sum("hits") / n, 6).alias("hit_rate"), F.round(F.sum("top2") / n, 6).alias("top2_rate"), F.round(F.sum("brier") / n, 6).alias("brier"), F.round(F.sum("loss") / n, 6).alias("log_loss"),
        F.round(F.sum(F.abs(F.col("hits") - F.col("conf"))) / n, 6).alias("ece"),
    ).drop("all")


def draw_priors(rows: DataFrame, fallback: float = 0.27, full: int = 150) -> DataFrame:
    """Draw rate by week_type and over all (null), drawn towards the fallback while there are fewer than `full` matches."""
    counts = rows.rollup("week_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("result_code") == "X").alias("draws"))
    w = F.least(F.lit(1.0), F.col("n") / full)
    confidence = F.when(F.col("n") >= full, "high").when(F.col("n") >= 60, "medium").otherwise("low")
    return counts.select("week_type", "n", F.round(w * F.col("draws") / F.col("n") + (1 - w) * fallback, 4).alias("prior"), confidence.alias("confidence"), F.when(w >= 1, "observed").otherwise("blended").alias("origin"))


def isotonic(points: DataFrame, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """Breakpoints of the non-decreasing fit of y on x for each key (I19): the keys, x (the greatest of a pool) and y.

    x is rounded to three decimals, as probabilities are shown; rows with an equal x are first summed, so a fit gets at most 1,001 rows of probabilities however many matches there are. Neighbours are
    then pooled while they fall; equal ones stay apart.
    """
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}

    def pool(table: pa.Table) -> pa.Table:
        blocks: list[list[float]] = []  # weight, sum of y, greatest x
        for x, n, y in sorted(zip(*(table.column(c).to_pylist() for c in ("x", "n", "y")), strict=True)):
            blocks.append([n, y, x])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] > blocks[-1][1] * blocks[-2][0]:
                n, y, x = blocks.pop()
                blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + y, x]
        own = {k: pa.array([table.column(k)[0].as_py()] * len(blocks), table.schema.field(k).type) for k in keys}
        return pa.table(own | {"x": pa.array([b[2] for b in blocks]), "y": pa.array([b[1] / b[0] for b in blocks])})

    sums = points.groupBy(*keys, F.round("x", 3).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("double")).alias("y"))
    return sums.groupBy(*keys).applyInArrow(pool, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "x double, y double"]))


def interpolated(curve: Column, x: Column) -> Column:
    """The curve (array of struct<x, y>, by x) at x: linear between breakpoints, level outside."""
    left, right = F.filter(curve, lambda p: p["x"] <= x), F.filter(curve, lambda p: p["x"] >= x)
    a, b = F.element_at(left, -1), F.get(right, F.lit(0))
    between = F.when(b["x"] == a["x"], a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * (x - a["x"]) / (b["x"] - a["x"]))
    return F.when(F.size(left) == 0, b["y"]).when(F.size(right) == 0, a["y"]).otherwise(between)


def calibrated(predictions: DataFrame, curves: DataFrame, floor: float = 0.02) -> DataFrame:
    """Predictions mapped through their classes' curves, at least `floor` each, made to sum to 1."""
    arrays = curves.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("curve"))
    wide = arrays.groupBy().pivot("key", list(CLASSES)).agg(F.first("curve"))
    rows = predictions.join(F.broadcast(wide))  # three arrays of at most as many points as rounded x
    raw = {c: F.greatest(interpolated(F.col(k), F.col(c)), F.lit(floor)) for k, c in CLASSES.items()}
    rows = rows.select("match_id", *(x.alias(c) for c, x in raw.items()))
    total = F.col("p_home") + F.col("p_draw") + F.col("p_away")
    return rows.select("match_id", *(F.round(F.col(c) / total, 6).alias(c) for c in raw))


def psi(baseline: DataFrame, sample: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Population stability of a whole-number column: right-closed bins at nearest-rank tenths of the baseline, sum of (q - p) ln(q / p).

    Values are counted first; ranks are found on the counts, one row a distinct value.
    """
    counts = lambda df: df.groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ordered = counts(baseline).withColumn("until", F.sum("c").over(W.orderBy("v")))  # distinct values of a bounded feature
    total = ordered.agg(F.sum("c").alias("total"), F.max("v").alias("top"))
    ranks = total.select("total", "top", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("i"))
    rank = F.least(F.bround(F.col("i") * F.col("total") / bins).cast("long"), F.col("total") - 1)
    edges = ranks.join(ordered, (F.col("until") > rank) & (F.col("until") - F.col("c") <= rank)).select("i", F.when(F.col("i") == bins, F.col("top")).otherwise(F.col("v")).alias("edge"))
    edges = edges.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "edge"))), lambda e: e["edge"]).alias("edges"))
    bin_ = F.least(F.size(F.filter("edges", lambda e: e < F.col("v"))), F.lit(bins - 1))
    share = lambda df, name: counts(df).join(F.broadcast(edges)).groupBy(bin_.alias("bin")).agg(F.sum("c").alias("c")).select("bin", (F.col("c") / F.sum("c").over(W.partitionBy())).alias(name))
    both = share(baseline, "p").join(share(sample, "q"), "bin", "full")
    p, q = (F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(1e-6)) for c in "pq")
    value = both.agg(F.sum((q - p) * F.log(q / p)).alias("psi"))
    severity = F.when(F.col("psi") >= 0.25, "severe").when(F.col("psi") >= 0.10, "moderate").otherwise("stable")
    return value.select(F.lit(column).alias("feature"), F.round("psi", 6).alias("psi"), severity.alias("severity"))


def temperature(rows: DataFrame, low: float = 0.5, high: float = 12.0, step: float = 0.01) -> DataFrame:
    """The temperature of the grid with the least cross-entropy, ties: the smallest (I31, I32). Equal vectors with an equal result are counted first."""
    groups = rows.groupBy(*CLASSES.values(), "result_code").agg(F.count(F.lit(1)).alias("n"))
    steps = round((high - low) / step)
    each = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i")).withColumn("t", F.lit(low) + F.col("i") * step)
    logs = {k: F.log(F.greatest(F.col(c), F.lit(1e-9))) / F.col("t") for k, c in CLASSES.items()}
    own = F.when(F.col("result_code") == "1", logs["1"]).when(F.col("result_code") == "X", logs["X"]).otherwise(logs["2"])
    loss = F.log(sum(F.exp(x) for x in logs.values())) - own
    by = each.groupBy("t").agg((F.sum(F.col("n") * loss) / F.sum("n")).alias("loss"))
    best = by.agg(F.min(F.struct(F.round("loss", 9).alias("loss"), F.col("t"))).alias("r"))
    return best.select(F.round("r.t", 2).alias("temperature"), F.round("r.loss", 6).alias("loss"))


def expanding_priors(played: DataFrame, least_before: int = 20, confident: float = 0.5) -> DataFrame:
    """Walk-forward check, per competition, of the class shares so far as probabilities (L01 to L03, L07 with the simplest model).

    A fixture sees those before it in (kickoff, match_id) order; running counts replace the refit at each step.
    """
    w = W.partitionBy("competition_id").orderBy("kickoff_at", "match_id").rowsBetween(W.unboundedPreceding, -1)
    before = {k: F.coalesce(F.count_if(F.col("result_code") == k).over(w), F.lit(0)) for k in CLASSES}
    rows = played.select("match_id", "competition_id", "result_code", F.count(F.lit(1)).over(w).alias("n"), *(x.alias(f"n{k}") for k, x in before.items())).where(F.col("n") >= least_before)
    rows = rows.select("match_id", "competition_id", "result_code", *(((F.col(f"n{k}") + 1) / (F.col("n") + 3)).alias(c) for k, c in CLASSES.items()))
    return verdicts(samples(rows.drop("result_code"), rows.select("match_id", "result_code")), "competition_id", confident)


def verdicts(rows: DataFrame, by: str, confident: float) -> DataFrame:
    """Rates of evaluated rows by key and what they say: insufficient, ready or not ready."""
    sure = F.col("top") >= confident
    sums = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("evaluated"), F.count_if("hit").alias("hits"), F.round(F.avg("brier"), 6).alias("brier"), F.round(F.avg("loss"), 6).alias("log_loss"),
        F.count_if(sure).alias("confident_picks"), F.count_if(sure & F.col("hit")).alias("confident_hits"),
    )
    hit, own = F.col("hits") / F.col("evaluated"), F.coalesce(F.try_divide("confident_hits", "confident_picks"), F.lit(0.0))
    verdict = F.when(F.col("confident_picks") < 8, "insufficient_confident_samples").when((hit >= 0.5) & (F.col("brier") <= 0.62) & (own >= 0.55), "ready").otherwise("not_ready")
    return sums.select("*", F.round(hit, 6).alias("hit_rate"), F.round(own, 6).alias("confident_hit_rate"), verdict.alias("verdict"))


def entropy(*p: Column) -> Column:
    """Shannon entropy over its greatest value."""
    floor = [F.greatest(x, F.lit(1e-9)) for x in p]
    return -sum(x * F.log(x) for x in floor) / math.log(len(p))


def running_counts(counts: DataFrame, key: str, value: str, n: str) -> DataFrame:
    """counts with `until`: how many of its key's rows (n each) are up to the value, and `total`, all of its key's. Ranges of (key, value) are dealt to tasks and each gets what the key's ranges before it hold, so no key is one task's."""
    dealt = written(counts.repartitionByRange(key, value).withColumn("range", F.spark_partition_id()), "ranks")
    parts = dealt.groupBy(key, "range").agg(F.sum(n).alias("own"))  # a row a key and range
    before = parts.select(key, "range", (F.sum("own").over(W.partitionBy(key).orderBy("range")) - F.col("own")).alias("before"), F.sum("own").over(W.partitionBy(key)).alias("total"))
    return dealt.join(before, [key, "range"]).withColumn("until", F.col("before") + F.sum(n).over(W.partitionBy(key, "range").orderBy(value))).drop("range", "before")


def drift_report(baseline: DataFrame, sample: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """feature, psi, severity, sample_size of every feature in one pass (F05 with I21 to I24): right-closed bins at nearest-rank tenths of the baseline, the last one at its greatest value; unknown values count as 0.

    Edges are a row a feature and tenth; what is shuffled is a row a feature and distinct value.
    """
    both = (rows.select(*(F.col(f"`{c}`") for c in features), F.lit(old).alias("__old"), F.lit(not old).alias("__new")) for rows, old in ((baseline, True), (sample, False)))
    return drift(next(both).union(next(both)), "__old", "__new", features, bins)


def drift(rows: DataFrame, old: str, new: str, features: list[str], bins: int = 10) -> DataFrame:
    """`drift_report` of rows that say whether they are of the baseline (column old), of the sample (new) or of both: one pass over what they come from."""
    value = lambda c: F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(0.0)), F.lit(0.0))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("feature"), value(c).alias("v")) for i, c in enumerate(features))))
    counts = rows.select(each.alias("x"), old, new).groupBy("x.feature", "x.v").agg(F.count_if(old).alias("n"), F.count_if(new).alias("m"))
    own = written(running_counts(counts, "feature", "v", "n"), "ranks")
    rank = lambda i: F.least(F.bround(i * F.col("total") / bins).cast("long"), F.col("total") - 1)
    held = F.filter(F.sequence(F.lit(1), F.lit(bins)), lambda i: (rank(i) < F.col("until")) & (rank(i) >= F.col("until") - F.col("n")) & (i < bins))
    edges = own.select("feature", "v", F.explode(held).alias("i")).union(own.where("n > 0").groupBy("feature").agg(F.max("v").alias("v")).select("feature", "v", F.lit(bins)))
    lists = edges.groupBy("feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("edges"))  # `bins` numbers a feature

    def shares(rows: DataFrame, name: str) -> DataFrame:
        bin_ = F.least(F.size(F.filter("edges", lambda e: e < F.col("v"))), F.lit(bins - 1))
        sums = rows.join(F.broadcast(lists), "feature").groupBy("feature", bin_.alias("bin")).agg(F.sum("n").alias("n"))
        return sums.select("feature", "bin", (F.col("n") / F.sum("n").over(W.partitionBy("feature"))).alias(name), F.sum("n").over(W.partitionBy("feature")).alias(f"{name}_size"))

    sampled = own.where("m > 0").select("feature", "v", F.col("m").alias("n"))
    both = shares(own.where("n > 0").select("feature", "v", "n"), "p").join(shares(sampled, "q"), ["feature", "bin"], "full")
    p, q = (F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(1e-6)) for c in "pq")
    out = both.groupBy("feature").agg(F.sum((q - p) * F.log(q / p)).alias("psi"), F.coalesce(F.max("q_size"), F.lit(0)).alias("sample_size")).where("sample_size > 0")
    severity = F.when(F.col("psi") >= 0.25, "severe").when(F.col("psi") >= 0.10, "moderate").otherwise("stable")
    name = F.element_at(F.array(*map(F.lit, features)), F.col("feature") + 1)
    return out.select(name.alias("feature"), F.round("psi", 4).alias("psi"), severity.alias("severity"), "sample_size").orderBy(F.desc("psi"), "feature")
