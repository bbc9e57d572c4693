"""Queries of the episodic layer: windows, importance, search, tiers, novelty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import lexicon as L
from mnemospark.functions import text as T
from mnemospark.functions.decay import days_between
from mnemospark.operators.graph import greedy_groups
from mnemospark.operators.ranking import ranked
from mnemospark.operators.search import Weights, fused_search
from mnemospark.plans import sqlkit as S
from mnemospark.session import materialize
from mnemospark.sources.tables import one_per_chunk, table

NOW = "2025-01-01 00:00:00"


def texts(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return one_per_chunk(table(spark, sf, "chunks").filter(F.col("text").isNotNull()), "text", *more)


def number(column: str = "chunk_id"):
    return F.regexp_extract(column, r"(\d+)$", 1).cast("bigint")


def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = texts(spark, sf).select("chunk_id", F.posexplode(T.windows(T.sentences(F.col("text")))).alias("window_no", "text"))
    return w.select("chunk_id", "window_no", F.length("text").alias("chars"), F.md5("text").alias("digest"))


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("chunk_id", T.token_count(F.col("text")).alias("tokens"))


def importance_scores(spark: SparkSession, sf: str) -> DataFrame:
    density, length, low = T.text_signals(F.col("text"))
    return texts(spark, sf).select("chunk_id", F.round(density, 6).alias("density"), F.round(length, 6).alias("length_signal"), low.alias("low_value"), F.round(T.importance(F.col("text"), F.lit(0.5)), 6).alias("importance"))


def distinctive(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("chunk_id", F.array_join(T.distinctive_tokens(F.col("text")), "|").alias("tokens"))


def scored_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks as rows of the search: age to NOW in days, access count, confidence, importance."""
    c = one_per_chunk(table(spark, sf, "chunks").filter("vector is not null"), "vector", "timestamp", "access_count", "confidence", "user_id", "text", "conversation_id", "speaker")
    return c.select(
        F.col("chunk_id").alias("id"), "vector", F.coalesce(days_between(F.col("timestamp"), F.lit(NOW).cast("timestamp")), F.lit(365.0)).alias("age"),
        F.coalesce("access_count", F.lit(0)).alias("access"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.lit(0.5).alias("importance"),
        F.col("user_id").alias("grp"), F.unix_micros(F.col("timestamp").cast("timestamp")).alias("ord"), "timestamp", "text", "conversation_id", "speaker",
    )


def query_rows(rows: DataFrame) -> DataFrame:
    """The stated query set: every row whose number is divisible by 50."""
    return rows.filter(number("id") % 50 == 0).select(F.col("id").alias("query_id"), "vector", "grp", "ord")


def _shown(found: DataFrame) -> DataFrame:
    return found.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


def _usable(rows: DataFrame) -> DataFrame:
    ok = (F.size("vector") == 64) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.filter(ok)


def fused_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = _usable(scored_rows(spark, sf)).drop("text", "conversation_id", "speaker", "timestamp")
    return _shown(fused_search(query_rows(rows), rows, 10, Weights(0.30, 0.10, 0.10)))


def fused_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """All filters of the search at once; they reach the scan before any vector is scored."""
    rows = _usable(scored_rows(spark, sf))
    kept = rows.filter((F.col("timestamp") >= F.lit("2024-03-01").cast("timestamp_ntz")) & (F.col("timestamp") <= F.lit("2024-11-30").cast("timestamp_ntz")) & (F.col("confidence") >= 0.5) & F.lower("speaker").isin("user", "human", "me"))
    drop = ("text", "conversation_id", "speaker", "timestamp")
    return _shown(fused_search(query_rows(rows.drop(*drop)), kept.drop(*drop), 10))


def legacy_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The older score: no importance, time 0.3, reinforcement 0.1."""
    rows = _usable(scored_rows(spark, sf)).drop("text", "conversation_id", "speaker", "timestamp")
    return _shown(fused_search(query_rows(rows), rows, 10, Weights(0.3, 0.1, 0.0)))


def own_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Within the memory of the query's user."""
    rows = _usable(scored_rows(spark, sf)).drop("text", "conversation_id", "speaker", "timestamp")
    return _shown(fused_search(query_rows(rows), rows, 5, same_group=True))


SIM = Weights(0.0, 0.0, 0.0)


def _nearest_earlier(spark: SparkSession, sf: str) -> DataFrame:
    rows = _usable(scored_rows(spark, sf)).filter("ord is not null").withColumn("confidence", F.lit(1.0)).drop("text", "conversation_id", "speaker", "timestamp")
    return fused_search(query_rows(rows), rows, 1, SIM, same_group=True, earlier=True)


def novelty(spark: SparkSession, sf: str) -> DataFrame:
    """Novelty of every query row against the earlier rows of its user; 1 where there are none."""
    rows = _usable(scored_rows(spark, sf)).filter("ord is not null")
    asked = query_rows(rows).select("query_id")
    got = _nearest_earlier(spark, sf).select("query_id", "id", "similarity")
    sim = F.col("similarity")
    return asked.join(got, "query_id", "left").select("query_id", F.col("id").alias("nearest"), F.round(F.coalesce(F.greatest(F.lit(0.0), 1 - sim), F.lit(1.0)), 6).alias("novelty"), F.coalesce(sim > 0.95, F.lit(False)).alias("duplicate"))


def smart_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Near pairs (cosine of 0.8 at least) that share their distinctive words: both without any, or Jaccard of 0.5 at least."""
    near = _nearest_earlier(spark, sf).filter("similarity >= 0.8").select("query_id", "id")
    t = texts(spark, sf).select("chunk_id", T.distinctive_tokens(F.col("text")).alias("d"))
    a, b = t.select(F.col("chunk_id").alias("query_id"), F.col("d").alias("da")), t.select(F.col("chunk_id").alias("id"), F.col("d").alias("db"))
    j = T.jaccard(F.col("da"), F.col("db"))
    both = (F.size("da") == 0) & (F.size("db") == 0)
    one = (F.size("da") == 0) | (F.size("db") == 0)
    return near.join(a, "query_id").join(b, "id").select("query_id", "id", F.round(j, 6).alias("overlap"), F.when(both, True).when(one, False).otherwise(j >= 0.5).alias("same"))


def tier_assignment(spark: SparkSession, sf: str, hot: int = 200, warm: int = 1000) -> DataFrame:
    """By recency within a user: the newest are hot, then warm, then cold; more than 10 accesses lift a chunk by one tier."""
    c = one_per_chunk(table(spark, sf, "chunks").filter("timestamp is not null"), "timestamp", "access_count", "user_id")
    r = ranked(c, ["user_id"], [F.col("timestamp").desc(), F.col("chunk_id").asc()], "n")
    tier = F.when(F.col("n") <= hot, 0).when(F.col("n") <= warm, 1).otherwise(2)
    tier = F.greatest(F.lit(0), tier - F.when(F.coalesce("access_count", F.lit(0)) > 10, 1).otherwise(0))
    return r.select("chunk_id", F.element_at(F.array(F.lit("hot"), F.lit("warm"), F.lit("cold")), tier + 1).alias("tier"))


def coretrieval_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """How often two chunks are among the top 5 of one query, both ways; a query has twenty pairs at most."""
    rows = _usable(scored_rows(spark, sf)).drop("text", "conversation_id", "speaker", "timestamp")
    top = materialize(fused_search(query_rows(rows), rows, 5, Weights(0.30, 0.10, 0.10)).select("query_id", "id"), "top5")
    a, b = top.select("query_id", F.col("id").alias("a")), top.select("query_id", F.col("id").alias("b"))
    return a.join(b, "query_id").filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"))


def topic_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks retrieved three times at least with each of two peers or more, a row per peer."""
    strong = materialize(coretrieval_pairs(spark, sf).filter("times >= 3"), "strong")
    n = strong.groupBy("a").agg(F.count(F.lit(1)).alias("peers")).filter("peers >= 2")
    return strong.join(n, "a").select(F.col("a").alias("chunk_id"), F.col("b").alias("peer"), "times", "peers")


def topic_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of chunks retrieved together three times at least, a row per member; a group has the id of the chunk that formed it."""
    strong = coretrieval_pairs(spark, sf).filter("times >= 3")
    return greedy_groups(strong, "a", "b").select(F.col("seed").alias("topic"), F.col("node").alias("chunk_id"))


def budget_trim(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of each conversation from the newest on, as long as their tokens fit 100."""
    c = one_per_chunk(table(spark, sf, "chunks").filter("text is not null and timestamp is not null and coalesce(conversation_id, '') <> ''"), "text", "timestamp", "conversation_id")
    sized = c.select("conversation_id", "chunk_id", "timestamp", T.token_count(F.col("text")).alias("tokens"))
    run = ranked(sized, ["conversation_id"], [F.col("timestamp").desc(), F.col("chunk_id").asc()], "used", value="tokens")
    return run.filter("used <= 100").select("conversation_id", "chunk_id", "tokens", F.col("used").cast("bigint").alias("used"))


def session_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The first 300 characters of every conversation: only messages that begin within them are gathered."""
    c = one_per_chunk(table(spark, sf, "chunks").filter("text is not null and timestamp is not null and coalesce(conversation_id, '') <> ''"), "text", "timestamp", "conversation_id")
    sized = c.select("conversation_id", "chunk_id", "timestamp", F.substring("text", 1, 300).alias("text"), (F.length("text") + 1).alias("n"))
    run = ranked(sized, ["conversation_id"], ["timestamp", "chunk_id"], "upto", value="n")
    head = run.filter(F.col("upto") - F.col("n") <= 300)  # the space before a message is the last character, at most
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "chunk_id", "text"))), lambda x: x["text"]), " ")
    return head.groupBy("conversation_id").agg(F.md5(F.substring(joined, 1, 300)).alias("digest"), F.length(F.substring(joined, 1, 300)).alias("chars"))


def extraction_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The decision ladder on the words of a text, before novelty is known."""
    t = F.col("text")
    n = F.size(T.words(t))
    info = F.regexp_count(t, F.lit(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")) + F.regexp_count(F.lower(t), F.lit(r"[0-9]+\s*(?:percent|%|dollars?|months?|years?|weeks?|days?|hours?|minutes?)"))
    first = F.coalesce(F.get(T.tokens(t), F.lit(0)), F.lit(""))
    reason = F.when(n < 5, "too_short").when(first.isin(L.PHATIC_STARTS) & (n < 15), "phatic").when(info >= 2, "high_info_density").otherwise("by_novelty")
    return texts(spark, sf).select("chunk_id", info.alias("info_hits"), reason.alias("reason"), F.round(F.least(F.lit(1.0), info * 0.3 + n / 30), 6).alias("importance"))


def turn_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of five accepted turns per user."""
    c = one_per_chunk(table(spark, sf, "chunks").filter("text is not null and timestamp is not null"), "text", "timestamp", "user_id")
    c = c.filter(F.size(T.words(F.col("text"))) >= 5).drop("text")
    return ranked(c, ["user_id"], ["timestamp", "chunk_id"], "n").groupBy("user_id", F.floor((F.col("n") - 1) / 5).alias("batch")).agg(F.count(F.lit(1)).alias("turns"), F.min("chunk_id").alias("least_id"))


def summary_density(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences by density (2 proper nouns, 3 numbers, words / 20 up to 1), taken while they fit 500 characters."""
    s = texts(spark, sf).select("chunk_id", F.posexplode(T.sentences(F.col("text"))).alias("no", "s"))
    density = 2 * F.size(T.proper_nouns(F.col("s"))) + 3 * F.regexp_count("s", F.lit("[0-9]+")) + F.least(F.lit(1.0), F.size(T.words(F.col("s"))) / 20)
    scored = s.select("chunk_id", "no", F.length("s").alias("chars"), F.round(density, 6).alias("density"))
    run = ranked(scored, ["chunk_id"], [F.col("density").desc(), F.col("no").asc()], "used", value="chars")
    return run.filter("used <= 500").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("sentences"), F.max("used").cast("bigint").alias("chars"))


QUERIES = {
    "fused_topk": fused_topk, "chunk_windows": chunk_windows, "token_counts": token_counts, "importance_scores": importance_scores, "distinctive_tokens": distinctive,
    "fused_topk_filtered": fused_topk_filtered, "legacy_topk": legacy_topk, "own_topk": own_topk, "novelty": novelty, "smart_dedup": smart_dedup,
    "tier_assignment": tier_assignment, "coretrieval_pairs": coretrieval_pairs, "topic_clusters": topic_clusters, "topic_groups": topic_groups, "budget_trim": budget_trim, "session_summary": session_summary,
    "extraction_gate": extraction_gate, "turn_batches": turn_batches, "summary_density": summary_density,
}

_ROWS = f"""
rows_ AS (
  SELECT chunk_id AS id, any_value(vector) AS vector, any_value(timestamp) AS ts, any_value(user_id) AS grp, any_value(speaker) AS speaker, any_value(conversation_id) AS conv,
         coalesce(greatest(0.0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(any_value(timestamp))) / 8.64e10), 365.0) AS age,
         coalesce(any_value(access_count), 0) AS access, coalesce(any_value(confidence), 1.0) AS confidence
  FROM chunks WHERE chunk_id IS NOT NULL AND vector IS NOT NULL AND len(vector) = 64
    AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0
  GROUP BY chunk_id),
v AS (SELECT * EXCLUDE (vector), list_transform(vector, lambda x: CAST(x AS DOUBLE)) AS d FROM rows_),
u AS (SELECT * EXCLUDE (d), list_transform(d, lambda x: x / sqrt(list_dot_product(d, d))) AS unit FROM v),
q AS (SELECT * FROM u WHERE CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) % 50 = 0)"""


def _topk(k: int, t: float, r: float, i: float, where: str = "true", on: str = "true") -> str:
    return f"SELECT query_id, id, round(similarity, 6) AS similarity, round(score, 6) AS score FROM ({_SIM_SQL(k, t, r, i, where, on)})"


def _SIM_SQL(k: int, t: float, r: float, i: float, where: str = "true", on: str = "true") -> str:  # noqa: N802
    """As _topk, without rounding."""
    return f"""WITH {_ROWS},
d AS (SELECT * FROM u WHERE {where}), m AS (SELECT greatest(max(access), 1) AS top FROM d),
p AS (
  SELECT q.id AS query_id, d.id AS id, list_dot_product(q.unit, d.unit) AS sim, d.*
  FROM q, d WHERE q.id <> d.id AND {on}),
s AS (
  SELECT query_id, p.id, sim, (sim * (1 - {t} - {r} - {i}) + {t} * exp(-0.01 * age) + {r} * ln(1 + access) / (SELECT ln(1 + top) FROM m) + {i} * 0.5) * confidence AS score FROM p)
SELECT query_id, id, sim AS similarity, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= {k}"""


_NEAR = f"""{_ROWS},
near AS (
  SELECT q.id AS query_id, d.id AS id, list_dot_product(q.unit, d.unit) AS sim FROM q JOIN u d ON q.grp = d.grp AND d.ts < q.ts AND q.id <> d.id WHERE q.ts IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.unit, d.unit), 9) DESC, d.id) = 1)"""
_PAIRS = f"""WITH t AS ({_topk(5, 0.30, 0.10, 0.10)}),
pairs AS (SELECT a.id AS a, b.id AS b, count(*) AS times FROM t a JOIN t b ON a.query_id = b.query_id AND a.id <> b.id GROUP BY 1, 2)"""

ORACLE = {
    "chunk_windows": f"""WITH {S.TEXTS}, s AS (SELECT chunk_id, {S.sentences('text')} AS s FROM t),
w AS (SELECT chunk_id, s, unnest(range(0, CAST(greatest(0, ceil((len(s) - 3) / 2.0) * 2) AS BIGINT) + 1, 2)) AS lo FROM s WHERE len(s) > 0)
SELECT chunk_id, CAST(lo / 2 AS INTEGER) AS window_no, length(array_to_string(s[lo + 1 : lo + 3], ' ')) AS chars, md5(array_to_string(s[lo + 1 : lo + 3], ' ')) AS digest FROM w""",
    "token_counts": f"WITH {S.TEXTS} SELECT chunk_id, greatest(1, CAST(floor(len({S.words('text')}) * 4 / 3.0) AS INTEGER)) AS tokens FROM t",
    "importance_scores": f"""WITH {S.TEXTS}, k AS (SELECT chunk_id, {S.padded('text')} AS p, greatest(len({S.words('text')}), 1) AS n, {S.proper('text')} AS e FROM t),
z AS (SELECT chunk_id, least(1.0, len(e) / n * 5) * 0.6 + least(1.0, ({' + '.join(S.any_of('p', x) for x in L.FACT_PHRASES)}) / 3) * 0.4 AS d,
  least(1.0, n / 15) AS l, least(1.0, ({' + '.join(S.any_of('p', x) for x in L.LOW_VALUE_PHRASES)}) / 2) AS a FROM k)
SELECT chunk_id, round(d, 6) AS density, round(l, 6) AS length_signal, a AS low_value, round(greatest(0.1, least(1.0, d * 0.35 + 0.5 * 0.30 + l * 0.15 + (1 - a) * 0.20)), 6) AS importance FROM z""",
    "distinctive_tokens": f"WITH {S.TEXTS} SELECT chunk_id, array_to_string({S.distinctive('text')}, '|') AS tokens FROM t",
    "fused_topk": _topk(10, 0.30, 0.10, 0.10),
    "fused_topk_filtered": _topk(10, 0.15, 0.05, 0.05, "ts >= TIMESTAMP '2024-03-01' AND ts <= TIMESTAMP '2024-11-30' AND confidence >= 0.5 AND lower(speaker) IN ('user', 'human', 'me')"),
    "legacy_topk": _topk(10, 0.3, 0.1, 0.0),
    "own_topk": _topk(5, 0.15, 0.05, 0.05, on="q.grp = d.grp"),
    "novelty": f"""WITH {_NEAR} SELECT q.id AS query_id, near.id AS nearest, round(coalesce(greatest(0.0, 1 - sim), 1.0), 6) AS novelty, coalesce(sim > 0.95, false) AS duplicate
FROM q LEFT JOIN near ON near.query_id = q.id WHERE q.ts IS NOT NULL""",
    "smart_dedup": f"""WITH {_NEAR}, {S.TEXTS}, x AS (SELECT chunk_id, {S.distinctive('text')} AS d FROM t)
SELECT query_id, near.id AS id, round(len(list_intersect(a.d, b.d)) / nullif(len(list_distinct(list_concat(a.d, b.d))), 0), 6) AS overlap,
  CASE WHEN len(a.d) = 0 AND len(b.d) = 0 THEN true WHEN len(a.d) = 0 OR len(b.d) = 0 THEN false ELSE len(list_intersect(a.d, b.d)) / len(list_distinct(list_concat(a.d, b.d))) >= 0.5 END AS same
FROM near JOIN x a ON a.chunk_id = query_id JOIN x b ON b.chunk_id = near.id WHERE sim >= 0.8""",
    "tier_assignment": """WITH c AS (SELECT chunk_id, any_value(timestamp) AS ts, any_value(access_count) AS access, any_value(user_id) AS user_id FROM chunks WHERE chunk_id IS NOT NULL AND timestamp IS NOT NULL GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, chunk_id) AS n FROM c)
SELECT chunk_id, ['hot', 'warm', 'cold'][1 + greatest(0, (CASE WHEN n <= 200 THEN 0 WHEN n <= 1000 THEN 1 ELSE 2 END) - (CASE WHEN coalesce(access, 0) > 10 THEN 1 ELSE 0 END))] AS tier FROM r""",
    "coretrieval_pairs": f"{_PAIRS} SELECT a, b, times FROM pairs",
    "topic_clusters": f"{_PAIRS}, strong AS (SELECT *, count(*) OVER (PARTITION BY a) AS peers FROM pairs WHERE times >= 3) SELECT a AS chunk_id, b AS peer, times, peers FROM strong WHERE peers >= 2",
    "budget_trim": f"""WITH {S.TURNS}, s AS (SELECT *, greatest(1, CAST(floor(len({S.words('text')}) * 4 / 3.0) AS INTEGER)) AS tokens FROM turns),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY conversation_id ORDER BY ts DESC, chunk_id ROWS UNBOUNDED PRECEDING) AS used FROM s)
SELECT conversation_id, chunk_id, tokens, CAST(used AS BIGINT) AS used FROM r WHERE used <= 100""",
    "session_summary": f"""WITH {S.TURNS}, j AS (SELECT conversation_id, substr(string_agg(text, ' ' ORDER BY ts, chunk_id), 1, 300) AS s FROM turns GROUP BY 1)
SELECT conversation_id, md5(s) AS digest, length(s) AS chars FROM j""",
    "extraction_gate": f"""WITH {S.TEXTS}, k AS (
  SELECT chunk_id, len({S.words('text')}) AS n, coalesce({S.tokens('text')}[1], '') AS f,
    len(regexp_extract_all(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) + len(regexp_extract_all(lower(text), '[0-9]+\\s*(?:percent|%|dollars?|months?|years?|weeks?|days?|hours?|minutes?)')) AS info_hits FROM t)
SELECT chunk_id, info_hits, CASE WHEN n < 5 THEN 'too_short' WHEN f IN ({S.quoted(L.PHATIC_STARTS)}) AND n < 15 THEN 'phatic' WHEN info_hits >= 2 THEN 'high_info_density' ELSE 'by_novelty' END AS reason,
  round(least(1.0, info_hits * 0.3 + n / 30), 6) AS importance FROM k""",
    "turn_batches": f"""WITH c AS (SELECT chunk_id, any_value(text) AS text, any_value(timestamp) AS ts, any_value(user_id) AS user_id FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL AND timestamp IS NOT NULL GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, chunk_id) AS n FROM c WHERE len({S.words('text')}) >= 5)
SELECT user_id, CAST(floor((n - 1) / 5.0) AS BIGINT) AS batch, count(*) AS turns, min(chunk_id) AS least_id FROM r GROUP BY 1, 2""",
    "summary_density": f"""WITH {S.TEXTS}, s AS (SELECT chunk_id, unnest({S.sentences('text')}) AS s, generate_subscripts({S.sentences('text')}, 1) AS no FROM t),
d AS (SELECT chunk_id, no, length(s) AS chars, round(2 * len({S.proper('s')}) + 3 * len(regexp_extract_all(s, '[0-9]+')) + least(1.0, len({S.words('s')}) / 20), 6) AS density FROM s),
r AS (SELECT *, sum(chars) OVER (PARTITION BY chunk_id ORDER BY density DESC, no ROWS UNBOUNDED PRECEDING) AS used FROM d)
SELECT chunk_id, count(*) AS sentences, CAST(max(used) AS BIGINT) AS chars FROM r WHERE used <= 500 GROUP BY 1""",
}
