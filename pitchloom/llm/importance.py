"""Operator 12: drawing documents like a target corpus, by importance weights of hashed word n-grams.

Words are exploded with their positions. For orders above one, windows over each document's positions put the following words beside each
word (lead), and concatenations of each order are features; features are hashed to buckets. A bucket's gain is the logarithm of
its smoothed share in the target against that in the documents. Gains (one row a bucket: BUCKETS rows, whatever the data, hence
broadcast) are joined to the features, and a document's weight is their floored mean. Weights plus Gumbel noise from a hash
of the id are scores; those of the highest scores are drawn, which samples without replacement in proportion to exp(weight / 1000). Ranks come from a
range partitioning by score and the sizes of the partitions before, so no task sorts everything.

Defined results: null or empty text, or no word: n_features 0, weight 0, never drawn. Repeated ids: each row by itself, and equal rows rank beside each other. Null id: noise of the empty id;
last among ties. Empty table: empty result; empty target: gains from its smoothing alone. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words once A-Z are small.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORDER, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10


def words_of(text: Column) -> Column:
    """The words of a text, null for none; what split leaves before and after them goes."""
    found = F.split(F.translate(text, UPPER, LOWER), BETWEEN, -1)
    return F.array_remove(found, "")


def features(rows: DataFrame, order: int, buckets: int) -> DataFrame:
    """rows: row (a number of its own for each document), text and more. The other columns of each row and pos and bucket of each of its features; a row without any has one with nulls."""
    others = [c for c in rows.columns if c != "text"]
    words = rows.select(*others, F.posexplode_outer(words_of(F.col("text"))).alias("pos", "word"))
    if order == 1:
        found = words
    else:
        following = Window.partitionBy("row").orderBy("pos")
        runs = [F.col("word")]
        beside = words.select("*", *(F.lead("word", k).over(following).alias(f"__w{k}") for k in range(1, order)))
        for k in range(1, order):
            runs.append(reduce(lambda a, b: F.concat(a, F.lit(" "), F.col(b)), [f"__w{j}" for j in range(1, k + 1)], F.col("word")))
        found = beside.select(*others, "pos", F.explode_outer(F.array_compact(F.array(*runs))).alias("word"))
    return found.select(*others, "pos", (F.crc32(F.col("word").cast("binary")) % buckets).alias("bucket"))


def counted(texts: DataFrame, order: int, buckets: int, name: str) -> DataFrame:
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "text") if order > 1 else texts.select("text")
    return features(rows, order, buckets).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(docs: DataFrame, target: DataFrame, order: int, buckets: int) -> DataFrame:
    """bucket, gain: a row for each bucket."""
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = cut(every.join(counted(docs, order, buckets, "s"), "bucket", "left").join(counted(target, order, buckets, "t"), "bucket", "left").fillna(0))
    total = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    ratio = (F.col("t") + 1.0) * float(total.s + buckets) / ((F.col("s") + 1.0) * float(total.t + buckets))
    return both.select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))


def ranked(rows: DataFrame, best_first: list[Column], rank: str) -> DataFrame:
    """rows with their place (from 1) in the given order. Ranges of the order are dealt to tasks; a range's first place is the number of rows in the ranges before it."""
    dealt = cut(rows.repartitionByRange(*best_first).withColumn("__range", F.spark_partition_id()))
    before = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))  # a row a range
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*best_first))
    return dealt.join(before, "__range").withColumn(rank, (within + F.col("__before")).cast("long")).drop("__range", "__before")


def weighted(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row of docs."""
    gain = gains(docs, target, order, buckets)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    found = features(rows, order, buckets).join(F.broadcast(gain), "bucket", "left")
    n, first = F.count("bucket"), F.col("pos") if order > 1 else None
    words = F.count_distinct("pos") if first is not None else n
    out = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), words.alias("n_words"), n.alias("n_features"), F.sum("gain").alias("total"))
    return out.select("doc_id", "n_words", "n_features", F.when(F.col("n_features") > 0, F.floor(F.col("total") / F.col("n_features"))).otherwise(0).cast("long").alias("weight"))


def drawn(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of each row of docs; docs: doc_id, text; target: text."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("long") + 0.5) / 4294967296
    noise = F.floor(-1000 * F.ln(-F.ln(uniform)))
    scored = cut(weighted(docs, target, order, buckets).withColumn("score", (F.col("weight") + noise).cast("long")))
    able = scored.where(F.col("n_words") >= least_words)
    most = percent * able.count() // 100
    placed = ranked(able, [F.desc("score"), F.col("doc_id").asc_nulls_last()], "rank")
    out = placed.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).unionByName(scored.where(F.col("n_words") < least_words), allowMissingColumns=True)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 is not among the SQL functions: its table is made by eight steps, and words' bytes are folded over it.
ORACLE = rf"""
WITH crc AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS steps FROM range(256) r(n)),
docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bench AS (SELECT unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
counts AS (SELECT word, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM (SELECT word, 1 AS s, 0 AS t FROM (SELECT unnest(w) AS word FROM docs) UNION ALL SELECT word, 0, 1 FROM bench) GROUP BY 1),
bytes AS (SELECT word, s, t, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || hex(encode(word))[2 * i + 1 : 2 * i + 2])::BIGINT) AS b FROM counts),
hashed AS (SELECT word, s, t, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, crc.steps[(xor(c, x) & 255) + 1]))) % {BUCKETS} AS bucket FROM bytes, crc),
buckets AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY 1),
totals AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM buckets),
gains AS (SELECT bucket, floor(1000 * ln((b.t + 1)::DOUBLE * (a.s + {BUCKETS}) / ((b.s + 1)::DOUBLE * (a.t + {BUCKETS}))))::BIGINT AS gain FROM buckets b, totals a),
features AS (SELECT doc_id, count(*) AS n, sum(gain) AS total FROM (SELECT doc_id, unnest(w) AS word FROM docs) JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY 1),
weights AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(floor(total / n), 0)::BIGINT AS weight, ('0x' || sha256('{SEED}:' || doc_id)[1:8])::BIGINT AS h FROM docs LEFT JOIN features USING (doc_id)),
scores AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weights),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scores WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * (SELECT count(*) FROM ranks) // 100 THEN rank END AS rank FROM scores LEFT JOIN ranks USING (doc_id)
"""
