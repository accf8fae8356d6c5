"""Operator 1: quality rules by host.

Each document is measured against text rules; failures are summed by host; each host's failure rate is shrunk by
a Beta prior fitted to all hosts; hosts whose shrunken rate is well over the prior's mean are suspect, and on those the rules are stricter.

A document goes if it fails the base rules (too short, or mostly repeated 8-word windows), if it breaks a rule
grossly on any host, or if it breaks one mildly on a suspect host. A clean document stays wherever it was found.

Defined results: null or empty text: no words, fails the base rules. Null host: a host of its own. Repeated rows: each
counts. Empty table: empty result. Other columns pass through `apply_rules` whatever
their names; `verdicts` ignores them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, longs, map_texts, window_hashes, word_hashes

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_echo_words"]
VERDICTS = ["base_failed", "kept"]
SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
#: Rule limits a 100 words: symbols, lines seen before, words equal to the word before. The mild ones hold on suspect hosts.
GROSS = {"n_symbols": 40, "n_dup_lines": 30, "n_echo_words": 50}
MILD = {"n_symbols": 20, "n_dup_lines": 15, "n_echo_words": 25}
#: Mean word length in code points, both ends allowed.
WORD_LENGTH = (2, 30)
#: A host is suspect if its shrunken failure rate is over so many times the prior's mean.
SUSPECT_TIMES = 1.2
#: The prior's strength in documents: the least, and the one where hosts differ no more than by chance.
LEAST_STRENGTH, SAME_STRENGTH = 2.0, 1e6


def covered(windows: np.ndarray, width: int) -> int:
    """Words that lie in a window found twice or more in the text, the first find included; windows: the hash of each window in order."""
    ordered = np.sort(windows)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    _, name, times = np.unique(windows, return_inverse=True, return_counts=True)
    at = np.flatnonzero(times[name] > 1)
    edge = np.zeros(len(windows) + width, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(texts: list[bytes], width: int = 8) -> dict:
    hashes, starts = word_hashes(texts)
    windows = window_hashes(hashes, width)
    echo = np.r_[False, hashes[1:] == hashes[:-1]]
    rows = []
    for b, a, z in zip(texts, starts[:-1], starts[1:], strict=True):
        lines = [x for x in b.split(b"\n") if x.strip()]
        rows.append((
            z - a,
            len(b.translate(None, SPACES).decode()),
            len(b) - len(b.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)),
            covered(windows[a : z - width + 1], width) if z - a > width else 0,
            np.count_nonzero(echo[a + 1 : z]),
        ))
    return {name: longs([r[i] for r in rows]) for i, name in enumerate(METRICS)}


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def breaks(limits: dict[str, int]) -> Column:
    """The document has more than the limit of any rule, or words of an odd mean length."""
    over = F.lit(False)
    for name, most in limits.items():
        over = over | (100 * F.col(name) > most * F.col("n_words"))
    low, high = WORD_LENGTH
    return over | (F.col("word_chars") < low * F.col("n_words")) | (F.col("word_chars") > high * F.col("n_words"))


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    return map_texts(docs, lambda: measure, ", ".join(f"{c} long" for c in METRICS), keep, text)


def host_rates(metrics: DataFrame, host: str) -> DataFrame:
    """Per host: n, failures, the failure rate shrunk by the Beta prior, and whether the host is suspect.

    The prior is fitted by beta-binomial moments: its mean is the rate of all documents; what the hosts' rates vary beyond the binomial part, weighted by their documents, gives
    the strength mean (1 - mean) / variance - 1.
    """
    failed = base_failed() | breaks(MILD)
    hosts = metrics.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(failed.cast("long")).alias("failures"))
    n, f = F.col("n").cast("double"), F.col("failures").cast("double")
    sums = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("all"), F.sum(f).alias("bad"), F.sum(f * f / n).alias("squares"), F.sum(n * n).alias("sizes"))
    mean = F.col("bad") / F.col("all")
    between = F.try_divide(F.col("squares") - F.col("bad") * mean - (F.col("k") - 1) * mean * (1 - mean), F.col("all") - F.col("sizes") / F.col("all"))
    strength = F.when(between > 1e-12, F.greatest(F.lit(LEAST_STRENGTH), mean * (1 - mean) / between - 1)).otherwise(F.lit(SAME_STRENGTH))
    prior = sums.select(mean.alias("mean"), strength.alias("strength"))  # one row
    rates = hosts.join(F.broadcast(prior), F.lit(True), "left")
    shrunk = F.round((F.col("failures") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength")), 9)
    return rates.select("host", "n", "failures", shrunk.alias("host_rate"), (shrunk > F.round(F.col("mean") * SUSPECT_TIMES, 9)).alias("suspect"))


def judged(metrics: DataFrame, rates: DataFrame, host: str) -> DataFrame:
    """metrics with base_failed, kept, host_rate and suspect_host; rates: a table of one row a host."""
    own = rates.select(F.col("host").alias("__host"), F.col("host_rate").alias("__rate"), F.col("suspect").alias("__suspect"))
    joined = metrics.join(own, F.col(host).eqNullSafe(F.col("__host")), "left")
    kept = ~base_failed() & ~breaks(GROSS) & ~(F.coalesce(F.col("__suspect"), F.lit(False)) & breaks(MILD))
    return joined.select("*", base_failed().alias("base_failed"), kept.alias("kept")).withColumnsRenamed({"__rate": "host_rate", "__suspect": "suspect_host"}).drop("__host")


def verdicts(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row a document: doc_id, the metrics, base_failed and kept."""
    metrics = cut(measured(docs.select("doc_id", F.col(host).alias("__source"), "text"), ["doc_id", "__source"]))
    return judged(metrics, cut(host_rates(metrics, "__source")), "__source").select("doc_id", *METRICS[:5], *VERDICTS, *METRICS[5:], "host_rate", "suspect_host")


def apply_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that stay, with the columns of docs. Texts are measured twice rather than shuffled."""
    names = [f"__c{i}" for i in range(len(docs.columns))]  # so that no name clashes
    rows = docs.toDF(*names)
    text, source = (names[docs.columns.index(c)] for c in ("text", host))
    rates = cut(host_rates(measured(rows, [source], text), source))
    return judged(measured(rows, names, text), rates, source).where("kept").select(*names).toDF(*docs.columns)


BASE_SQL = r"""
w AS (SELECT doc_id, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) > 7)),
often AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM often) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, w.source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1]))::BIGINT AS n_echo_words
  FROM w LEFT JOIN dup ON dup.doc_id = w.doc_id LEFT JOIN rep ON rep.doc_id = w.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
f AS (SELECT *, word_chars < {low} * n_words OR word_chars > {high} * n_words AS odd FROM b),
g AS (SELECT *, 100 * n_symbols > {gs} * n_words OR 100 * n_dup_lines > {gd} * n_words OR 100 * n_echo_words > {ge} * n_words OR odd AS gross,
  100 * n_symbols > {ms} * n_words OR 100 * n_dup_lines > {md} * n_words OR 100 * n_echo_words > {me} * n_words OR odd AS mild FROM f),
h AS (SELECT source, count(*) AS n, sum((base_failed OR mild)::INT) AS failures FROM g GROUP BY source),
p0 AS (SELECT count(*) AS k, sum(n)::DOUBLE AS total, sum(failures)::DOUBLE AS bad, sum(failures::DOUBLE * failures / n) AS squares, sum(n::DOUBLE * n) AS sizes FROM h),
p1 AS (SELECT bad / total AS mean, (squares - bad * bad / total - (k - 1) * (bad / total) * (1 - bad / total)) / nullif(total - sizes / total, 0) AS between_hosts FROM p0),
p AS (SELECT mean, CASE WHEN between_hosts > 1e-12 THEN greatest({least}, mean * (1 - mean) / between_hosts - 1) ELSE {same} END AS strength FROM p1),
s AS (SELECT source, round((failures + mean * strength) / (n + strength), 9) AS host_rate, round((failures + mean * strength) / (n + strength), 9) > round(mean * {times}, 9) AS suspect_host FROM h, p),
verdict AS (SELECT g.*, s.host_rate, s.suspect_host, NOT base_failed AND NOT gross AND NOT (suspect_host AND mild) AS kept FROM g JOIN s ON g.source IS NOT DISTINCT FROM s.source)
""".format(low=WORD_LENGTH[0], high=WORD_LENGTH[1], gs=GROSS["n_symbols"], gd=GROSS["n_dup_lines"], ge=GROSS["n_echo_words"], me=MILD["n_echo_words"], ms=MILD["n_symbols"], md=MILD["n_dup_lines"], times=SUSPECT_TIMES, least=LEAST_STRENGTH, same=SAME_STRENGTH)
ORACLE = f"WITH {BASE_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_echo_words, host_rate, suspect_host FROM verdict"
