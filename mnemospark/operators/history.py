"""History of changing attributes: validity periods from logs of updates, by presence bitmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.operators.ranking import HOT_ROWS, ranked
from mnemospark.session import materialize

WORD = 60  # bits used of a bigint, so that shifts stay clear of the sign


def validity_periods(rows: DataFrame, entity: list[str], value: list[str], snapshot: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per version: entity, value, valid_from and valid_to, both in the type of `snapshot`.

    `rows` holds one value per entity and snapshot. The snapshots of an entity are
    numbered; each (entity, value) gets one bit per snapshot in which it holds, in
    words of 60 bits. A set bit whose predecessor is not set starts a version, which
    lasts to the start of the next version of the entity; the last has a null valid_to.
    A value that comes back after another starts a new version, so gaps need no rule.
    Nulls in entity or value are values of their own; rows with a null snapshot are
    left out. Extra columns are dropped. An empty input gives an empty result.
    """
    base = rows.filter(F.col(snapshot).isNotNull()).select(*entity, *value, F.col(snapshot).alias("_at"))
    base = materialize(ranked(base, entity, ["_at"], "_no", hot_rows).withColumn("_no", F.col("_no") - 1), "snapshots")
    group = [*entity, *value]
    words = base.groupBy(*group, F.floor(F.col("_no") / WORD).alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(_no % {WORD} as int))")).alias("_bits"))
    before = words.select(*[F.col(c).alias(f"_p_{c}") for c in group], (F.col("_word") + 1).alias("_p_word"), F.expr(f"shiftright(_bits, {WORD - 1}) & 1").alias("_carry"))
    on = F.col("_word") == F.col("_p_word")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    carried = words.join(before, on, "left").withColumn("_starts", F.expr("_bits & ~(shiftleft(_bits, 1) | coalesce(_carry, 0L))"))
    bit = F.explode(F.expr(f"filter(sequence(0, {WORD - 1}), p -> (shiftright(_starts, p) & 1) = 1)"))
    starts = carried.select(*group, "_word", bit.alias("_bit")).select(*group, (F.col("_word") * WORD + F.col("_bit")).alias("_no"))
    times = base.select(*[F.col(c).alias(f"_t_{c}") for c in entity], F.col("_no").alias("_t_no"), F.col("_at").alias("valid_from"))
    on = F.col("_no") == F.col("_t_no")
    for c in entity:
        on = on & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    versions = starts.join(times, on).select(*group, "valid_from")
    versions = materialize(ranked(versions, entity, ["valid_from"], "_v", hot_rows), "versions")
    nxt = versions.select(*[F.col(c).alias(f"_n_{c}") for c in entity], (F.col("_v") - 1).alias("_n_v"), F.col("valid_from").alias("valid_to"))
    on = F.col("_v") == F.col("_n_v")
    for c in entity:
        on = on & F.col(c).eqNullSafe(F.col(f"_n_{c}"))
    return versions.join(nxt, on, "left").select(*group, "valid_from", "valid_to")


def relation_history(relations: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Versions of every fact (user_id, subject_key, predicate) of a log of relation updates.

    Each id counts once; of repeated rows of an id that differ, the greatest by all its
    columns stands. predicate and status are brought to one spelling (white space and
    hyphens join to one `_` in predicate), a null status is active. Rows without both
    times are left out and exchanged times put right. Among rows of a fact with one
    effect time the largest id stands. Seconds since 1970; valid_to is -1 where the
    version still holds. Null keys and objects are values of their own.
    """
    predicate = F.regexp_replace(F.lower(F.trim(F.regexp_replace("predicate", r"^\s+|\s+$", ""))), r"[\s_\-]+", "_")
    status = F.coalesce(F.lower(F.regexp_replace("status", r"^\s+|\s+$", "")), F.lit("active"))
    lo, hi = F.least("first_seen", "last_seen"), F.greatest("first_seen", "last_seen")
    rows = relations.filter(F.col("first_seen").isNotNull() & F.col("last_seen").isNotNull()).select(
        "id", "user_id", "subject_key", predicate.alias("predicate"), "object_key", status.alias("status"),
        F.unix_micros(F.when(status.isin("superseded", "retracted"), hi).otherwise(lo).cast("timestamp")).alias("at"),
    )
    rows = rows.groupBy("id").agg(F.max(F.struct("at", "user_id", "subject_key", "predicate", "object_key", "status")).alias("r")).select("id", "r.*")
    fact = ["user_id", "subject_key", "predicate"]
    stands = rows.groupBy(*fact, "at").agg(F.max(F.struct("id", "object_key", "status")).alias("r")).select(*fact, "at", "r.object_key", "r.status")
    versions = validity_periods(stands, fact, ["object_key", "status"], "at", hot_rows)
    seconds = {c: F.floor(F.col(c) / 1_000_000) for c in ("valid_from", "valid_to")}
    return versions.withColumns(seconds).withColumn("valid_to", F.coalesce("valid_to", F.lit(-1).cast("bigint")))
