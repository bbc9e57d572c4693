"""Queries of the ingest chain: gates with novelty, batches for extraction, totals of conversations, sentence and word windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import lexicon as L
from mnemospark.functions import text as T
from mnemospark.operators.ranking import ranked
from mnemospark.plans import sqlkit as S
from mnemospark.plans.episodic import ORACLE as EPISODIC_SQL
from mnemospark.plans.episodic import _usable, novelty, number, scored_rows, texts
from mnemospark.sources.tables import one_per_chunk, table

PHATIC = rf"(?i)^\s*(?:{L.PHATIC_OPENINGS})(?:$|[^\p{{L}}\p{{N}}_])"


def ingest_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Whether facts are taken from each message of the query set: the whole ladder, with novelty against the earlier messages of its user; 1 where that can't be told."""
    t = texts(spark, sf).filter(number("chunk_id") % 50 == 0)
    near = novelty(spark, sf).select(F.col("query_id").alias("chunk_id"), "novelty")
    usable = _usable(scored_rows(spark, sf)).select(F.col("id").alias("chunk_id"), F.lit(True).alias("usable"))
    n, info = F.size(T.words(F.col("text"))), F.regexp_count("text", F.lit("(?imd)" + L.INFO_PATTERN))
    j = t.join(near, "chunk_id", "left").join(usable, "chunk_id", "left").withColumn("novelty", F.coalesce("novelty", F.lit(1.0)))
    weight = F.least(F.lit(1.0), info * 0.3 + n / 30)
    reason = (
        F.when(n < 5, "too_short").when(F.col("text").rlike(PHATIC) & (n < 15), "phatic").when(info >= 2, "high_info_density").when(F.col("usable").isNull(), "zero_embedding")
        .when(F.col("novelty") < 0.25, "low_novelty").when((weight < 0.3) & (F.col("novelty") < 0.5), "low_importance").otherwise("novel")
    )
    return j.select("chunk_id", reason.alias("reason"), reason.isin("high_info_density", "novel").alias("accepted"), F.round(weight, 6).alias("importance"), "novelty")


def gate_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Turns and accepted turns by reason, with the share of each."""
    g = ingest_decisions(spark, sf).groupBy("reason").agg(F.count(F.lit(1)).alias("turns"), F.count_if("accepted").alias("accepted"))
    return g.select("reason", "turns", "accepted", F.round(F.col("accepted") / F.col("turns"), 6).alias("rate"))


def gate_flush(spark: SparkSession, sf: str) -> DataFrame:
    """Every five turns of a user that aren't short or phatic go to extraction as one text; the last batch is flushed as it is."""
    c = one_per_chunk(table(spark, sf, "chunks").filter("text is not null and timestamp is not null"), "text", "timestamp", "user_id")
    n = F.size(T.words(F.col("text")))
    c = c.filter((n >= 5) & ~(F.col("text").rlike(PHATIC) & (n < 15)))
    r = ranked(c, ["user_id"], ["timestamp", "chunk_id"], "n").withColumn("batch", F.floor((F.col("n") - 1) / 5))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n")  # five at most
    return r.groupBy("user_id", "batch").agg(F.md5(joined).alias("digest"), F.count(F.lit(1)).alias("turns"))


def conversation_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Messages, windows and tokens that each conversation adds: sums over its turns."""
    c = one_per_chunk(table(spark, sf, "chunks").filter("text is not null and coalesce(conversation_id, '') <> ''"), "text", "conversation_id")
    per = c.select("conversation_id", F.size(T.windows(T.sentences(F.col("text")))).alias("w"), T.token_count(F.col("text")).alias("t"))
    return per.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("messages"), F.sum("w").alias("windows"), F.sum("t").alias("tokens"))


def word_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of 600 words, 550 apart, for texts that go to extraction in parts."""
    w = texts(spark, sf).select("chunk_id", T.words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(550))
    x = w.select("chunk_id", F.posexplode(F.transform(starts, lambda s: F.array_join(F.slice("w", s + 1, F.lit(600)), " "))).alias("window_no", "text"))
    return x.select("chunk_id", "window_no", F.length("text").alias("chars"), F.md5("text").alias("digest"))


def date_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """The first ISO date of each text with up to thirty characters around it."""
    p = r"\d{4}-\d{2}-\d{2}"
    t = texts(spark, sf).select("chunk_id", "text", F.regexp_extract("text", f"({p})", 1).alias("said")).filter("said <> ''")
    at = F.instr(F.col("text"), F.col("said"))
    lo = F.greatest(F.lit(1), at - 30)
    around = F.substring(F.col("text"), lo, at + F.length("said") + 30 - lo)
    return t.select("chunk_id", "said", F.md5(F.regexp_replace(around, r"^\s+|\s+$", "")).alias("digest"))


def client_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of users with "plan" in the text, without case, cut at 200 characters."""
    c = one_per_chunk(table(spark, sf, "chunks").filter(F.contains(F.lower("text"), F.lit("plan")) & F.lower(F.trim("speaker")).isin("user", "human")), "text", "speaker")
    return c.select("chunk_id", F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text")).alias("shown"))


def candidate_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases that may name something: proper nouns, acronyms and model names, and known tools, by how many texts have them."""
    t = texts(spark, sf)
    nouns = t.select("chunk_id", F.explode(T.proper_nouns(F.col("text"))).alias("p")).withColumn("kind", F.lit("proper"))
    whole = t.select("chunk_id", F.explode(F.filter(F.split("text", T.WORD_BREAK), lambda w: w.rlike("^(?:[A-Z][A-Z0-9]+|[A-Z][a-z]*[0-9]+[a-zA-Z]*)$"))).alias("p"))
    coded = whole.withColumn("kind", F.when(F.col("p").rlike("^[A-Z][A-Z0-9]+$"), "acronym").otherwise("model"))
    tools = t.select("chunk_id", F.explode(F.filter(T.tokens(F.col("text")), lambda w: w.isin(L.TOOL_WORDS))).alias("p")).withColumn("kind", F.lit("tool"))
    every = nouns.unionByName(coded).unionByName(tools).filter(~F.col("p").isin(L.ENTITY_STOP_WORDS))
    return every.groupBy("kind", F.regexp_replace("p", r"\s+", " ").alias("phrase")).agg(F.count_distinct("chunk_id").alias("texts"))


def extra_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of the JSON beside each message and how often each has a value; malformed JSON has none."""
    c = one_per_chunk(table(spark, sf, "chunks").filter("extra is not null"), "extra")
    kv = c.select("chunk_id", F.explode(F.from_json("extra", "map<string,string>")).alias("k", "v"))
    return kv.groupBy("k").agg(F.count(F.lit(1)).alias("messages"), F.count("v").alias("filled"), F.count_distinct("v").alias("values"))


QUERIES = {
    "ingest_decisions": ingest_decisions, "gate_outcomes": gate_outcomes, "gate_flush": gate_flush, "conversation_totals": conversation_totals, "word_windows": word_windows, "date_snippets": date_snippets,
    "client_filter": client_filter, "candidate_phrases": candidate_phrases, "extra_decoded": extra_decoded,
}

_OPENING = rf"(?i)^\s*({L.PHATIC_OPENINGS})($|[^\p{{L}}\p{{N}}_])"
_DECIDED = f"""WITH {S.TEXTS}, nov AS ({EPISODIC_SQL['novelty']}),
vec AS (SELECT chunk_id, any_value(vector) AS v FROM chunks WHERE chunk_id IS NOT NULL AND vector IS NOT NULL GROUP BY 1),
ok AS (SELECT chunk_id FROM vec WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
k AS (SELECT t.chunk_id, text, len({S.words('text')}) AS n, len(regexp_extract_all(text, '(?im){L.INFO_PATTERN}')) AS info, coalesce(nov.novelty, 1.0) AS novelty, ok.chunk_id IS NOT NULL AS usable
  FROM t LEFT JOIN nov ON nov.query_id = t.chunk_id LEFT JOIN ok ON ok.chunk_id = t.chunk_id WHERE CAST(regexp_extract(t.chunk_id, '([0-9]+)$', 1) AS BIGINT) % 50 = 0),
z AS (SELECT *, least(1.0, info * 0.3 + n / 30) AS w FROM k),
d AS (SELECT chunk_id, CASE WHEN n < 5 THEN 'too_short' WHEN regexp_matches(text, '{_OPENING}') AND n < 15 THEN 'phatic' WHEN info >= 2 THEN 'high_info_density' WHEN NOT usable THEN 'zero_embedding'
  WHEN novelty < 0.25 THEN 'low_novelty' WHEN w < 0.3 AND novelty < 0.5 THEN 'low_importance' ELSE 'novel' END AS reason, round(w, 6) AS importance, novelty FROM z)"""

ORACLE = {
    "ingest_decisions": f"{_DECIDED} SELECT chunk_id, reason, reason IN ('high_info_density', 'novel') AS accepted, importance, novelty FROM d",
    "gate_outcomes": f"{_DECIDED} SELECT reason, count(*) AS turns, count(*) FILTER (WHERE reason IN ('high_info_density', 'novel')) AS accepted, round(count(*) FILTER (WHERE reason IN ('high_info_density', 'novel')) / count(*), 6) AS rate FROM d GROUP BY 1",
    "gate_flush": f"""WITH c AS (SELECT chunk_id, any_value(text) AS text, any_value(timestamp) AS ts, any_value(user_id) AS user_id FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL AND timestamp IS NOT NULL GROUP BY 1),
k AS (SELECT *, len({S.words('text')}) AS n FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, chunk_id) AS no FROM k WHERE n >= 5 AND NOT (regexp_matches(text, '{_OPENING}') AND n < 15))
SELECT user_id, CAST(floor((no - 1) / 5.0) AS BIGINT) AS batch, md5(string_agg(text, chr(10) ORDER BY no)) AS digest, count(*) AS turns FROM r GROUP BY 1, 2""",
    "conversation_totals": f"""WITH c AS (SELECT chunk_id, any_value(text) AS text, any_value(conversation_id) AS conversation_id FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL AND coalesce(conversation_id, '') <> '' GROUP BY 1),
k AS (SELECT conversation_id, len({S.sentences('text')}) AS s, greatest(1, CAST(floor(len({S.words('text')}) * 4 / 3.0) AS INTEGER)) AS t FROM c)
SELECT conversation_id, count(*) AS messages, CAST(sum(CASE WHEN s = 0 THEN 0 ELSE 1 + greatest(0, ceil((s - 3) / 2.0)) END) AS BIGINT) AS windows, CAST(sum(t) AS BIGINT) AS tokens FROM k GROUP BY 1""",
    "word_windows": f"""WITH {S.TEXTS}, w AS (SELECT chunk_id, {S.words('text')} AS w FROM t), x AS (SELECT chunk_id, w, unnest(range(0, len(w), 550)) AS lo FROM w WHERE len(w) > 0)
SELECT chunk_id, CAST(lo / 550 AS INTEGER) AS window_no, length(array_to_string(w[lo + 1 : lo + 600], ' ')) AS chars, md5(array_to_string(w[lo + 1 : lo + 600], ' ')) AS digest FROM x""",
    "date_snippets": f"""WITH {S.TEXTS}, k AS (SELECT chunk_id, text, regexp_extract(text, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) AS said FROM t), p AS (SELECT *, instr(text, said) AS a, greatest(1, instr(text, said) - 30) AS lo FROM k WHERE said <> '')
SELECT chunk_id, said, md5(regexp_replace(substr(text, lo, a + length(said) + 30 - lo), '^\\s+|\\s+$', '', 'g')) AS digest FROM p""",
    "client_filter": """WITH c AS (SELECT chunk_id, any_value(text) AS text FROM chunks WHERE chunk_id IS NOT NULL AND contains(lower(text), 'plan') AND lower(trim(speaker, ' ')) IN ('user', 'human') GROUP BY 1)
SELECT chunk_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS shown FROM c""",
    "candidate_phrases": f"""WITH {S.TEXTS}, x AS (SELECT chunk_id, unnest({S.proper('text')}) AS p, 'proper' AS kind FROM t
  UNION ALL SELECT chunk_id, p, CASE WHEN regexp_full_match(p, '[A-Z][A-Z0-9]+') THEN 'acronym' ELSE 'model' END FROM (SELECT chunk_id, unnest(list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z][A-Z0-9]+|[A-Z][a-z]*[0-9]+[a-zA-Z]*'))) AS p FROM t)
  UNION ALL SELECT chunk_id, p, 'tool' FROM (SELECT chunk_id, unnest(list_filter({S.tokens('text')}, lambda w: w IN ({S.quoted(L.TOOL_WORDS)}))) AS p FROM t))
SELECT kind, regexp_replace(p, '\\s+', ' ', 'g') AS phrase, count(DISTINCT chunk_id) AS texts FROM x WHERE p NOT IN ({S.quoted(L.ENTITY_STOP_WORDS)}) GROUP BY 1, 2""",
    "extra_decoded": """WITH c AS (SELECT chunk_id, any_value(extra) AS extra FROM chunks WHERE chunk_id IS NOT NULL AND extra IS NOT NULL GROUP BY 1), k AS (SELECT chunk_id, extra, unnest(json_keys(extra)) AS k FROM c WHERE json_valid(extra)),
v AS (SELECT k, json_extract_string(extra, '$.' || k) AS v FROM k) SELECT k, count(*) AS messages, count(v) AS filled, count(DISTINCT v) AS values FROM v GROUP BY 1""",
}
