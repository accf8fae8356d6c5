"""Versioned slates: digests of their composition, upserts that notice a change, and what a change makes invalid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchloom.functions import text

FIELDS = ["label", "week_type", "closes_at", "is_archived"]


def ascii_json(value: Column) -> Column:
    """Compact JSON of a struct in the order of its fields, nulls written, other letters as lower-case \\u escapes of UTF-16."""
    json = F.to_json(value, {"ignoreNullFields": "false"})
    escaped = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    parts = F.split(json, r"(?<=[\x00-\x7F])(?=[^\x00-\x7F])|(?<=[^\x00-\x7F])(?=[\x00-\x7F])")  # runs of ASCII and of other letters in turn, not one letter each
    spelled = F.array_join(F.transform(parts, lambda c: F.when(c >= "\u0080", escaped(c)).otherwise(c)), "")
    return F.when(json.rlike(r"[^\x00-\x7F]"), spelled).otherwise(json)


def iso_utc(at: Column) -> Column:
    """The moment with its offset; microseconds only if there are any. Sessions run in UTC."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.when(F.unix_micros(at) % 1_000_000 != 0, F.date_format(at, ".SSSSSS")).otherwise(""), F.lit("+00:00"))


def composition_hash(draw_code: Column, week_type: Column, fixtures: Column) -> Column:
    """SHA-256 of a slate's canonical JSON (H27 on names as they came, H28 on resolved names): keys in alphabetical order, fixtures by position, names trimmed and in lower case. Null without fixtures.

    fixtures: array of structs with position, home_team, away_team, kickoff_at, competition.
    """
    plain = lambda c: F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    row = lambda f: F.struct(plain(f["away_team"]).alias("away_team"), plain(f["competition"]).alias("competition"), plain(f["home_team"]).alias("home_team"), iso_utc(f["kickoff_at"]).alias("kickoff_at"), f["position"].alias("position"))
    ordered = F.array_sort(F.transform(fixtures, lambda f: F.struct(f["position"].alias("at"), row(f).alias("row"))))
    content = F.struct(draw_code.alias("draw_code"), F.transform(ordered, lambda x: x["row"]).alias("fixtures"), week_type.alias("week_type"))
    return F.when(F.size(fixtures) > 0, F.sha2(ascii_json(content), 256))


def backfilled(slates: DataFrame, links: DataFrame) -> DataFrame:
    """slates with the digest of their resolved fixtures where none is stored (H28); stored digests stay, so doing it again changes nothing. links: slate_id and a fixture's fields."""
    fixture = F.struct("position", "home_team", "away_team", "kickoff_at", "competition")
    found = slates.join(links.groupBy("slate_id").agg(F.collect_list(fixture).alias("__fixtures")), "slate_id", "left")
    new = composition_hash(F.col("draw_code"), F.col("week_type"), F.col("__fixtures"))
    return found.withColumns({"composition_hash": F.coalesce("composition_hash", new), "slate_version": F.when(F.col("composition_hash").isNull() & new.isNotNull(), F.coalesce("slate_version", F.lit(1))).otherwise(F.col("slate_version"))}).select(*slates.columns)


def folded(slates: DataFrame, payloads: DataFrame) -> DataFrame:
    """One row a draw_code of the batch: its last payload, how often the digest changed on the way, and the digest before the first change.

    payloads: draw_code, seq, FIELDS, fixtures; several of one draw_code follow each other by seq. A first digest is no change.
    """
    hashed = payloads.withColumn("hash", composition_hash(F.col("draw_code"), F.col("week_type"), F.col("fixtures")))
    stored = slates.select("draw_code", F.col("composition_hash").alias("stored"))
    w = W.partitionBy("draw_code").orderBy("seq")
    steps = hashed.join(stored, "draw_code", "left").withColumn("before", F.coalesce(F.lag("hash").over(w), F.col("stored")))
    changed = F.col("before").isNotNull() & (F.col("before") != F.col("hash"))
    last = F.struct("hash", "fixtures", *FIELDS)
    found = steps.groupBy("draw_code").agg(F.max_by(last, "seq").alias("r"), F.count_if(changed).alias("changes"), F.min_by("before", F.when(changed, F.col("seq"))).alias("left_hash"))
    return found.select("draw_code", "changes", F.when(F.col("changes") > 0, F.col("left_hash")).alias("left_hash"), "r.*")


def upserted_slates(slates: DataFrame, payloads: DataFrame) -> DataFrame:
    """slates after a batch of payloads (P02): new draws at version 1, known ones with the payload's fields, one version more for each change of the digest. The same batch again changes nothing.

    slates: slate_id, draw_code, FIELDS, composition_hash, slate_version. A new slate's id follows from its draw_code, so a task that runs again makes the same one.
    """
    rows = slates.withColumn("__known", F.lit(True)).join(folded(slates, payloads).select("draw_code", "changes", "hash", *(F.col(c).alias(f"__{c}") for c in FIELDS), F.lit(True).alias("__new")), "draw_code", "full")
    taken = {c: F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)) for c in FIELDS}
    version = F.when(F.col("__known").isNull(), 1 + F.col("changes")).when(F.col("__new"), F.coalesce("slate_version", F.lit(1)) + F.col("changes")).otherwise(F.col("slate_version"))
    new_id = F.when(F.col("__known").isNull(), F.concat(F.lit("draw-"), "draw_code")).otherwise(F.col("slate_id").cast("string"))
    return rows.withColumns(taken | {"slate_id": new_id, "slate_version": version, "composition_hash": F.when(F.col("__new"), F.col("hash")).otherwise(F.col("composition_hash"))}).select(*slates.columns)


def invalidated(snapshots: DataFrame, slates: DataFrame, payloads: DataFrame, at: Column) -> DataFrame:
    """snapshots (slate_id, is_valid, invalidated_at, reason) with the valid ones of changed slates made invalid, and from which digest (P02). Others, those invalid before among them, stay as they are."""
    gone = folded(slates, payloads).where("changes > 0").join(slates.select("slate_id", "draw_code"), "draw_code").select("slate_id", "left_hash")
    hit = F.col("is_valid") & F.col("left_hash").isNotNull()
    rows = snapshots.join(gone, "slate_id", "left")
    return rows.withColumns({"is_valid": F.col("is_valid") & F.col("left_hash").isNull(), "invalidated_at": F.when(hit, at).otherwise(F.col("invalidated_at")), "reason": F.when(hit, F.concat(F.lit("composition_changed_from_"), F.substring("left_hash", 1, 8))).otherwise(F.col("reason"))}).select(*snapshots.columns)


def relinked(links: DataFrame, slates: DataFrame, payloads: DataFrame) -> DataFrame:
    """A batch's fixtures as the links of their slates (P02): draw_code, position, names, is_knockout, knockout_source. A position that an operator ruled on keeps the ruling; the others follow the competition's name and stage.

    links: draw_code, position, is_knockout, knockout_source before the batch; fixtures may hold a stage.
    """
    new = folded(slates, payloads).select("draw_code", F.explode("fixtures").alias("f")).select("draw_code", "f.*")
    ruled = links.where("knockout_source = 'operator'").select("draw_code", "position", F.col("is_knockout").alias("__ruled"))
    stage = F.col("stage") if "stage" in new.columns else F.lit(None).cast("string")
    own = F.coalesce(text.resolved_knockout(text.slug(F.col("competition")), stage), F.lit(False))
    rows = new.join(ruled, ["draw_code", "position"], "left")
    return rows.select("draw_code", "position", "home_team", "away_team", "competition", F.coalesce("__ruled", own).alias("is_knockout"), F.when(F.col("__ruled").isNotNull(), "operator").otherwise("auto").alias("knockout_source"))
