"""Queries of maintenance: decay and eviction of chunks, counts by state, phrases of time, facts as keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.functions.decay import days_between
from mnemospark.plans import sqlkit as S
from mnemospark.plans.episodic import NOW, ORACLE as EPISODIC_SQL, extraction_gate
from mnemospark.plans.knowledge import _F, facts, now
from mnemospark.sources.tables import one_per_chunk, table


def chunk_decay(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence of a chunk is at most exp(-0.01 days); from the stored value, so it may run again."""
    c = one_per_chunk(table(spark, sf, "chunks").filter("timestamp is not null"), "timestamp", "confidence")
    return c.select("chunk_id", F.round(F.least(F.coalesce("confidence", F.lit(1.0)), F.exp(-0.01 * days_between(F.col("timestamp"), now()))), 6).alias("confidence"))


def eviction_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of little confidence, older than 90 days, that nobody asked for."""
    c = one_per_chunk(table(spark, sf, "chunks").filter("timestamp is not null"), "timestamp", "confidence", "access_count")
    d = days_between(F.col("timestamp"), now())
    left = F.least(F.coalesce("confidence", F.lit(1.0)), F.exp(-0.01 * d))
    return c.filter((left < 0.05) & (d > 90) & (F.coalesce("access_count", F.lit(0)) <= 0)).select("chunk_id")


def fact_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).groupBy("predicate", "status").agg(F.count(F.lit(1)).alias("facts"), F.round(F.avg("confidence"), 6).alias("confidence"))


def fact_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = F.lower(F.concat_ws("|", "subject_key", "predicate", "object_key"))
    return facts(spark, sf).groupBy(key.alias("fact_key")).agg(F.count(F.lit(1)).alias("updates"))


def extraction_stats(spark: SparkSession, sf: str) -> DataFrame:
    g = extraction_gate(spark, sf).groupBy("reason").agg(F.count(F.lit(1)).alias("turns"), F.round(F.avg("importance"), 5).alias("importance"))
    return g


def fact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of 15 characters and more with a name or number, once each by their words: the fallback facts, over 10 characters of key."""
    from mnemospark.plans.episodic import texts

    s = texts(spark, sf).select("chunk_id", F.explode(T.sentences(F.col("text"))).alias("s")).filter((F.length("s") >= 15) & ((F.size(T.proper_nouns(F.col("s"))) > 0) | F.col("s").rlike("[0-9]")))
    k = s.select("chunk_id", F.regexp_replace(F.lower("s"), r"[^\p{L}\p{N}_ ]+", "").alias("k")).filter(F.length("k") > 10)
    return k.groupBy(F.md5("k").alias("fact")).agg(F.count(F.lit(1)).alias("times"), F.min("chunk_id").alias("first_chunk"))


def said_date(phrase: Column, day: Column) -> Column:
    """The day that a phrase of a session on `day` means; null where it can't be told. Months go to the middle or to day 28 at most."""
    n = F.coalesce(F.regexp_extract(phrase, r"(\d+)", 1).try_cast("int"), F.lit(2))
    mid = lambda d: F.date_add(F.trunc(d, "month").cast("date"), 14)
    capped = lambda d: F.date_add(F.trunc(d, "month").cast("date"), F.least(F.day(day), F.lit(28)) - 1)
    ago, few = F.contains(phrase, F.lit("ago")), phrase.rlike("few|couple")
    has = lambda w: F.contains(phrase, F.lit(w))
    return (
        F.when(phrase.isin("yesterday", "last night"), F.date_sub(day, 1)).when(phrase.isin("today", "this week", "this morning", "this afternoon", "this evening", "this year"), day)
        .when(phrase == "last week", F.date_sub(day, 7)).when(phrase == "last month", mid(F.add_months(day, -1))).when(phrase == "last year", F.add_months(day, -12)).when(phrase == "this month", F.trunc(day, "month").cast("date"))
        .when(phrase.isin("recently", "lately", "just now", "just recently", "the other day"), F.date_sub(day, 3))
        .when(ago & has("week"), F.date_sub(day, n * 7)).when(ago & has("month"), capped(F.add_months(day, -n))).when(ago & has("year"), F.add_months(day, -12 * n)).when(ago, F.date_sub(day, n))
        .when(few & has("week"), F.date_sub(day, 14)).when(few & has("month"), mid(F.add_months(day, -2))).when(few, F.date_sub(day, 3))
    )


RELATIVE = (
    r"(?iU)\b(yesterday|today|last\s+(?:week|month|year|night|time)|this\s+(?:week|month|year|morning|afternoon|evening)|the\s+other\s+day|"
    r"(?:a\s+)?(?:few|couple(?:\s+of)?)\s+(?:days?|weeks?|months?)\s+ago|\d+\s+(?:days?|weeks?|months?|years?)\s+ago|recently|lately|just\s+(?:now|recently))\b"
)


def with_dates(text: Column, day: Column) -> Column:
    """A text with every phrase of time replaced by the day it means for a session on `day`; phrases that mean none, or one before the year 1, stay."""
    rest, said = F.split(text, RELATIVE, -1), F.regexp_extract_all(text, F.lit(RELATIVE), 1)

    def dated(s: Column) -> Column:
        d = said_date(F.lower(s), day)
        sound = (F.length(F.regexp_extract(s, r"(\d*)", 1)) <= 6) & (d >= F.lit("0001-01-01").cast("date"))
        return F.when(sound, F.concat(F.lit("on "), F.date_format(d, "d MMMM yyyy"))).otherwise(s)

    days = F.transform(said, dated)
    return F.array_join(F.zip_with(rest, days, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def text_with_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that hold phrases of time, those rewritten against the day of the message."""
    c = one_per_chunk(table(spark, sf, "chunks").filter(F.col("timestamp").isNotNull() & F.col("text").rlike(RELATIVE)), "text", "timestamp")
    return c.select("chunk_id", with_dates(F.col("text"), F.col("timestamp").cast("date")).alias("text"))


QUERIES = {"text_with_dates": text_with_dates, "chunk_decay": chunk_decay, "eviction_candidates": eviction_candidates, "fact_status_counts": fact_status_counts, "fact_keys": fact_keys, "extraction_stats": extraction_stats, "fact_dedup": fact_dedup}

_C = f"""c AS (SELECT chunk_id, any_value(confidence) AS confidence, any_value(access_count) AS a, greatest(0.0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(any_value(timestamp))) / 8.64e10) AS d
  FROM chunks WHERE chunk_id IS NOT NULL AND timestamp IS NOT NULL GROUP BY 1)"""

ORACLE = {
    "chunk_decay": f"WITH {_C} SELECT chunk_id, round(least(coalesce(confidence, 1.0), exp(-0.01 * d)), 6) AS confidence FROM c",
    "eviction_candidates": f"WITH {_C} SELECT chunk_id FROM c WHERE least(coalesce(confidence, 1.0), exp(-0.01 * d)) < 0.05 AND d > 90 AND coalesce(a, 0) <= 0",
    "fact_status_counts": f"WITH {_F} SELECT predicate, status, count(*) AS facts, round(avg(confidence), 6) AS confidence FROM f GROUP BY 1, 2",
    "fact_keys": f"WITH {_F} SELECT lower(concat_ws('|', subject_key, predicate, object_key)) AS fact_key, count(*) AS updates FROM f GROUP BY 1",
    "extraction_stats": f"SELECT reason, count(*) AS turns, round(avg(importance), 5) AS importance FROM ({EPISODIC_SQL['extraction_gate']}) GROUP BY 1",
    "fact_dedup": rf"""WITH {S.TEXTS}, s AS (SELECT chunk_id, unnest({S.sentences('text')}) AS s FROM t),
k AS (SELECT chunk_id, regexp_replace(lower(s), '[^\p{{L}}\p{{N}}_ ]+', '', 'g') AS k FROM s WHERE length(s) >= 15 AND (len({S.proper('s')}) > 0 OR regexp_matches(s, '[0-9]')))
SELECT md5(k) AS fact, count(*) AS times, min(chunk_id) AS first_chunk FROM k WHERE length(k) > 10 GROUP BY 1""",
}
