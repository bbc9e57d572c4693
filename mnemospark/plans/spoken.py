"""Queries of what texts say: dates they name, sessions they date, first persons, facts in answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import temporal as TM
from mnemospark.plans import sqlkit as S
from mnemospark.plans.episodic import texts
from mnemospark.plans.upkeep import said_date
from mnemospark.sources.tables import one_per_chunk, table

I_FORM = r"I(?:'m| am|'ve| have| was| had| do| did)?"


def attributed(text: Column, who: Column) -> Column:
    """The text in the third person: up to the first I, my is the speaker's; that I is the speaker, with the verb in its form; behind it my is their and other first persons stay."""
    parts = rf"(?is)^(.*?)\b({I_FORM})\b(.*)$"
    mine = lambda t, by: F.regexp_replace(t, F.lit(r"(?i)\bmy\b"), by)
    said = F.lower(F.regexp_extract(text, parts, 2))
    verb = F.when(said.isin("i'm", "i am"), " is").when(said.isin("i've", "i have"), " has").when(said == "i was", " was").when(said == "i had", " had").when(said == "i do", " does").when(said == "i did", " did").otherwise("")
    whose = F.concat(who, F.lit("'s"))
    rest = mine(F.regexp_extract(text, parts, 3), F.lit("their"))
    return F.when(said == "", mine(text, whose)).otherwise(F.concat(mine(F.regexp_extract(text, parts, 1), whose), who, verb, rest))


def attribution(spark: SparkSession, sf: str) -> DataFrame:
    """First-person words of users' messages replaced by the user."""
    c = one_per_chunk(table(spark, sf, "chunks").filter("text is not null and user_id is not null"), "text", "user_id", "speaker")
    c = c.filter(F.lower(F.trim("speaker")).isin("user", "human", "me") & F.col("text").rlike(r"(?i)\b(?:i|my)\b"))
    return c.select("chunk_id", F.md5(attributed(F.col("text"), F.col("user_id"))).alias("digest"))


def text_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates named in all texts, by rule and day, with how often each was named."""
    m = texts(spark, sf).select(F.explode(TM.markers(F.col("text"), F.lit("2024-06-15").cast("date"))).alias("m"))
    return m.groupBy("m.rule", "m.starts").agg(F.count(F.lit(1)).alias("times"))


def session_dates(spark: SparkSession, sf: str) -> DataFrame:
    """The date that each text names as that of a session, if it names one."""
    return texts(spark, sf).select("chunk_id", TM.session_date(F.col("text")).alias("day")).filter("day is not null")


PHRASES = "yesterday|last night|last week|last month|last year|this week|this month|recently|lately|[0-9]{1,3} days? ago|[0-9]{1,3} weeks? ago|[0-9]{1,3} months? ago|[0-9]{1,2} years? ago"


def relative_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases of time in all texts and the day each means, told from the day of the message."""
    c = one_per_chunk(table(spark, sf, "chunks").filter("text is not null and timestamp is not null"), "text", "timestamp")
    p = c.select("chunk_id", F.col("timestamp").cast("date").alias("day"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"\b({PHRASES})\b"), 1)).alias("said"))
    return p.groupBy("chunk_id", "said", "day").agg(F.count(F.lit(1)).alias("times")).select("chunk_id", "said", said_date(F.col("said"), F.col("day")).alias("means"), "times")


def facts_of_answer(answer: Column) -> Column:
    """Facts in a model's answer: the JSON array inside it, else its lines without bullets; those over ten characters."""
    inner = F.from_json(F.nullif(F.regexp_extract(answer, r"(?s)(\[.*\])", 1), F.lit("")), "array<string>")
    lines = F.transform(F.split(answer, "\n"), lambda s: F.regexp_replace(s, r"^[\s\-*•\d.)]+", ""))
    return F.filter(F.transform(F.coalesce(inner, lines), lambda s: F.trim(s)), lambda s: F.length(s) > 10)


def answer_facts(spark: SparkSession, sf: str) -> DataFrame:
    """All texts read as answers of a model: how many facts each has, and their digest. Where one holds brackets, what they hold is tried as JSON first."""
    return texts(spark, sf).select("chunk_id", facts_of_answer(F.col("text")).alias("f")).select("chunk_id", F.size("f").alias("facts"), F.md5(F.array_join("f", "\n")).alias("digest"))


QUERIES = {"attribution": attribution, "text_dates": text_dates, "session_dates": session_dates, "relative_phrases": relative_phrases, "answer_facts": answer_facts}


def _marks_sql() -> str:
    """All rules against 15 June 2024, each with its own arithmetic. What ends a word is doubled, for the pattern uses one up on each side."""
    low, months = "regexp_replace(lower(text), '([^\\p{L}\\p{N}_])', '\\1\\1', 'g')", "['" + "', '".join(TM.MONTHS) + "']"
    ref, n, y = "DATE '2024-06-15'", "TRY_CAST(regexp_extract(m, '([0-9]+)', 1) AS INTEGER)", "TRY_CAST(regexp_extract(m, '([0-9]{4})', 1) AS INTEGER)"
    name = f"list_position({months}, regexp_extract(m, '({'|'.join(TM.MONTHS)})', 1))"
    short = "list_position(['" + "', '".join(TM.SHORT_MONTHS) + f"'], regexp_extract(m, '({'|'.join(TM.SHORT_MONTHS)})', 1))"
    day = lambda a, b, c: f"TRY_CAST(printf('%04d-%02d-%02d', {a}, {b}, {c}) AS DATE)"
    iso = [f"TRY_CAST(split_part(m, '-', {i}) AS INTEGER)" for i in (1, 2, 3)]
    starts = {
        "iso_date": day(*iso), "month_year": day(y, name, 1), "short_date": day(y, short, "TRY_CAST(regexp_extract(m, '[a-z]+\\s+([0-9]{1,2})', 1) AS INTEGER)"), "yesterday": f"{ref} - 1", "today": ref, "days_ago": f"{ref} - {n}", "last_week": f"{ref} - 7",
        "weeks_ago": f"{ref} - {n} * 7", "this_week": f"{ref} - 5", "last_month": "DATE '2024-05-01'", "months_ago": f"date_trunc('month', {ref} - to_months({n}))", "this_month": "DATE '2024-06-01'", "last_year": "DATE '2023-01-01'",
        "years_ago": day(f"2024 - {n}", 1, 1), "since_year": day(y, 1, 1), "since_month": day(f"coalesce({y}, 2024)", name, 1), "recently": f"{ref} - 14",
    }
    parts = []
    for r in TM.RULES:
        pattern = r.pattern.replace("-", "--").replace("\\d", "[0-9]") if r.name == "iso_date" else r.pattern.replace("\\d", "[0-9]").replace(",?", "(?:,,)?")
        parts.append(f"SELECT '{r.name}' AS rule, CAST({starts[r.name]} AS DATE) AS starts FROM (SELECT replace(unnest(regexp_extract_all({low}, '(?:^|[^\\p{{L}}\\p{{N}}_])({pattern})(?:$|[^\\p{{L}}\\p{{N}}_])', 1)), '--', '-') AS m FROM t)")
    return " UNION ALL ".join(parts)


_I = I_FORM.replace("'", "''")
_N = "coalesce(TRY_CAST(nullif(regexp_extract(said, '([0-9]+)', 1), '') AS INTEGER), 2)"

ORACLE = {
    "text_dates": f"WITH {S.TEXTS}, m AS ({_marks_sql()}) SELECT rule, starts, count(*) AS times FROM m WHERE starts IS NOT NULL GROUP BY 1, 2",
    "session_dates": rf"""WITH {S.TEXTS}, k AS (SELECT chunk_id, CAST(try_strptime(regexp_extract(lower(text), '(\d{{1,2}} (?:{"|".join(TM.MONTHS)}) \d{{4}})', 1), '%d %B %Y') AS DATE) AS a, TRY_CAST(nullif(regexp_extract(text, '(\d{{4}}-\d{{2}}-\d{{2}})', 1), '') AS DATE) AS b FROM t)
SELECT chunk_id, coalesce(a, b) AS day FROM k WHERE coalesce(a, b) IS NOT NULL""",
    "relative_phrases": rf"""WITH c AS (SELECT chunk_id, any_value(text) AS text, CAST(any_value(timestamp) AS DATE) AS day FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL AND timestamp IS NOT NULL GROUP BY 1),
p AS (SELECT chunk_id, day, unnest(regexp_extract_all(lower(text), '\b({PHRASES})\b', 1)) AS said FROM c), g AS (SELECT chunk_id, said, day, count(*) AS times FROM p GROUP BY 1, 2, 3)
SELECT chunk_id, said, CAST(CASE WHEN said IN ('yesterday', 'last night') THEN day - 1 WHEN said = 'last week' THEN day - 7 WHEN said = 'last month' THEN date_trunc('month', day - INTERVAL 1 MONTH) + INTERVAL 14 DAY WHEN said = 'last year' THEN day - INTERVAL 12 MONTH
  WHEN said = 'this week' THEN day WHEN said = 'this month' THEN date_trunc('month', day) WHEN said IN ('recently', 'lately') THEN day - 3 WHEN contains(said, 'week') THEN day - 7 * {_N}
  WHEN contains(said, 'month') THEN date_trunc('month', day - to_months({_N})) + to_days(least(day(day), 28) - 1) WHEN contains(said, 'year') THEN day - to_months(12 * {_N}) ELSE day - {_N} END AS DATE) AS means, times FROM g""",
    "attribution": rf"""WITH c AS (SELECT chunk_id, any_value(text) AS text, any_value(user_id) AS who, any_value(speaker) AS speaker FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL AND user_id IS NOT NULL GROUP BY 1),
k AS (SELECT chunk_id, text, who, regexp_extract(text, '(?is)^(.*?)\b({_I})\b(.*)$', 1) AS a, lower(regexp_extract(text, '(?is)^(.*?)\b({_I})\b(.*)$', 2)) AS m, regexp_extract(text, '(?is)^(.*?)\b({_I})\b(.*)$', 3) AS z
  FROM c WHERE lower(trim(speaker, ' ')) IN ('user', 'human', 'me') AND regexp_matches(text, '(?i)\b(?:i|my)\b'))
SELECT chunk_id, md5(CASE WHEN m = '' THEN regexp_replace(text, '(?i)\bmy\b', who || '''s', 'g') ELSE regexp_replace(a, '(?i)\bmy\b', who || '''s', 'g') || who
  || CASE WHEN m IN ('i''m', 'i am') THEN ' is' WHEN m IN ('i''ve', 'i have') THEN ' has' WHEN m = 'i was' THEN ' was' WHEN m = 'i had' THEN ' had' WHEN m = 'i do' THEN ' does' WHEN m = 'i did' THEN ' did' ELSE '' END || regexp_replace(z, '(?i)\bmy\b', 'their', 'g') END) AS digest FROM k""",
    "answer_facts": rf"""WITH {S.TEXTS}, j AS (SELECT chunk_id, text, regexp_extract(text, '(?s)(\[.*\])', 1) AS inner_ FROM t),
k AS (SELECT chunk_id, list_filter(list_transform(CASE WHEN json_valid(nullif(inner_, '')) THEN CAST(CAST(inner_ AS JSON) AS VARCHAR[]) ELSE list_transform(string_split(text, chr(10)), lambda s: regexp_replace(s, '^[\s\-*•\d.)]+', '')) END, lambda s: trim(s, ' ')), lambda s: length(s) > 10) AS f FROM j)
SELECT chunk_id, len(f) AS facts, md5(array_to_string(f, chr(10))) AS digest FROM k""",
}
