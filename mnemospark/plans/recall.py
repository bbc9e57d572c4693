"""Queries of profile, working and explicit memory, intent, budget, feedback, dates, metrics and assembled context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import lexicon as L
from mnemospark.functions import text as T
from mnemospark.operators.ranking import ranked
from mnemospark.plans import sqlkit as S
from mnemospark.plans.episodic import texts
from mnemospark.plans.knowledge import facts
from mnemospark.session import materialize
from mnemospark.sources.tables import one_per_chunk, table


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """Profile signals, repeated rows once, numbered in time within user and dimension."""
    s = table(spark, sf, "profile_signals").distinct().filter("signal is not null and signal_at is not null")
    return ranked(s, ["user_id", "dimension"], ["signal_at", "signal", "weight"], "i")


def profile_ema(spark: SparkSession, sf: str) -> DataFrame:
    """v = 0.8 v + 0.2 s over all signals in order, from 0.5, in closed form: a sum of signals weighted by powers of 0.8, so nothing is gathered."""
    s = materialize(signals(spark, sf), "signals")
    n = s.groupBy("user_id", "dimension").agg(F.max("i").alias("n"))
    j = s.join(n, ["user_id", "dimension"])
    v = F.pow(F.lit(0.8), F.first("n")) * 0.5 + F.sum(F.col("signal") * 0.2 * F.pow(F.lit(0.8), F.col("n") - F.col("i")))
    g = j.groupBy("user_id", "dimension").agg(F.round(v, 6).alias("value"), F.max("n").alias("signals"))
    return g.withColumn("confidence", F.least(F.lit(1.0), F.least("signals", F.lit(50)) / 20))


def profile_labels(spark: SparkSession, sf: str) -> DataFrame:
    p = profile_ema(spark, sf)
    label = F.lit("unknown")
    for dim, steps in L.PROFILE_LABELS.items():
        own = F.lit("unknown")
        for least, name in reversed(steps):
            own = F.when(F.col("value") >= least, name).otherwise(own)
        label = F.when(F.col("dimension") == dim, own).otherwise(label)
    return p.select("user_id", "dimension", label.alias("label"))


def signal_window50(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of the last 50 signals."""
    s = table(spark, sf, "profile_signals").distinct().filter("signal is not null and signal_at is not null")
    r = ranked(s, ["user_id", "dimension"], [F.col("signal_at").desc(), F.col("signal").desc(), F.col("weight").desc()], "i").filter("i <= 50")
    return r.groupBy("user_id", "dimension").agg(F.round(F.avg("signal"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


def behavioral_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of every message of a user."""
    t = one_per_chunk(table(spark, sf, "chunks").filter(F.col("text").isNotNull() & F.lower(F.trim("speaker")).isin("user", "human")), "text")
    return t.select("chunk_id", *[F.round(c, 6).alias(k) for k, c in T.behavioral_signals(F.col("text")).items()])


def intent_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Scoring weights for every message, taken as a query."""
    return texts(spark, sf).select("chunk_id", *[F.round(c, 6).alias(k) for k, c in T.intent_weights(F.col("text")).items()])


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct words of three letters and more of a reply and of the message it answers."""
    c = one_per_chunk(table(spark, sf, "chunks").filter("text is not null"), "text", "extra", "confidence", "access_count")
    w = F.array_distinct(F.filter(T.tokens(F.col("text")), lambda x: F.length(x) >= 3))
    c = materialize(c.select("chunk_id", w.alias("w"), F.get_json_object("extra", "$.reply_to").alias("to"), "confidence", "access_count"), "words")
    asked = c.select(F.col("chunk_id").alias("to"), F.col("w").alias("wa"), "confidence", "access_count")
    return c.filter("to is not null").select("chunk_id", "to", "w").join(asked, "to")


def feedback_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """A retrieved text was used if a reply shares 0.15 of its words (Jaccard)."""
    j = F.coalesce(T.jaccard(F.col("w"), F.col("wa")), F.lit(0.0))
    return _replies(spark, sf).select("chunk_id", "to", F.round(j, 6).alias("overlap"), (j >= 0.15).alias("used"))


def feedback_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Use adds two accesses, each reply without use takes 5 % of confidence."""
    j = F.coalesce(T.jaccard(F.col("w"), F.col("wa")), F.lit(0.0)) >= 0.15
    g = _replies(spark, sf).groupBy("to").agg(F.count_if(j).alias("used"), F.count_if(~j).alias("unused"), F.first("confidence").alias("c"), F.first("access_count").alias("a"))
    return g.select(F.col("to").alias("chunk_id"), (F.coalesce("a", F.lit(0)) + 2 * F.col("used")).alias("access_count"), F.round(F.coalesce("c", F.lit(1.0)) * F.pow(F.lit(0.95), F.col("unused")), 6).alias("confidence"))


def explicit_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Events as settings: the last value of each (user, type) stands, with the time it was first set."""
    e = table(spark, sf, "events").filter("ts is not null")
    g = e.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "props")).alias("r"), F.min("ts").alias("created"))
    return g.select("user_id", F.col("event_type").alias("key"), F.get_json_object("r.props", "$.k").alias("value"), "created", F.col("r.ts").alias("updated"))


def explicit_search(spark: SparkSession, sf: str) -> DataFrame:
    """Settings whose key or value contains 7 or 'click', without case, ordered by value then key within the user."""
    x = explicit_latest(spark, sf).filter(F.contains(F.lower("key"), F.lit("click")) | F.contains(F.lower("value"), F.lit("7")))
    r = ranked(x, ["user_id"], [F.col("value").cast("int").desc_nulls_last(), F.col("key").asc()], "place")
    return r.select("user_id", "key", "value", "place")


def tombstones(spark: SparkSession, sf: str) -> DataFrame:
    """Settings after deletions: an error event deletes what its user set before it."""
    e = table(spark, sf, "events").filter("ts is not null")
    gone = e.filter("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("gone"))
    kept = e.filter("event_type <> 'error'").join(gone, "user_id", "left").filter("gone is null or ts > gone")
    return kept.groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))


def working_context(spark: SparkSession, sf: str) -> DataFrame:
    """The ten names mentioned most in each conversation."""
    c = one_per_chunk(table(spark, sf, "chunks").filter("coalesce(conversation_id, '') <> ''"), "conversation_id", "entity_mentions")
    n = c.select("conversation_id", F.explode("entity_mentions").alias("name")).filter("name is not null").groupBy("conversation_id", "name").agg(F.count(F.lit(1)).alias("mentions"))
    return ranked(n, ["conversation_id"], [F.col("mentions").desc(), F.col("name").asc()], "place").filter("place <= 10")


def metrics_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Count, mean, median, 99th percentile and maximum of the last 1000 values per event type, by nearest rank."""
    e = table(spark, sf, "events").filter("value is not null")
    last = ranked(e.select("event_type", "event_id", "value", "ts"), ["event_type"], [F.col("ts").desc(), F.col("event_id").desc()], "i").filter("i <= 1000")
    g = last.groupBy("event_type").agg(F.sort_array(F.collect_list("value")).alias("v"))  # a thousand values at most
    n = F.size("v")
    at = lambda q: F.element_at("v", (n * q).cast("int") + 1)
    return g.select("event_type", n.alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / n, 6).alias("mean"), at(0.5).alias("p50"), at(0.99).alias("p99"), F.element_at("v", -1).alias("top"))


def store_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per user of chunks, entities, relations and signals."""
    out = None
    for name, key in (("chunks", "chunk_id"), ("entities", "entity_key"), ("relations", "id"), ("profile_signals", None)):
        t = table(spark, sf, name)
        g = t.groupBy("user_id").agg((F.count_distinct(key) if key else F.count(F.lit(1))).alias("n")).withColumn("layer", F.lit(name))
        out = g if out is None else out.unionByName(g)
    return out


def feedback_totals(spark: SparkSession, sf: str) -> DataFrame:
    f = feedback_overlap(spark, sf)
    return f.agg(F.count(F.lit(1)).alias("replies"), F.count_if("used").alias("used"), F.round(F.count_if("used") / F.count(F.lit(1)), 6).alias("ratio"))


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Mean vector per label, one row per position."""
    e = table(spark, sf, "embeddings").filter("embedding is not null and label is not null")
    return e.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def seed_types(spark: SparkSession, sf: str) -> DataFrame:
    """The label whose centroid is nearest to each vector, by dot product. Centroids are one row per label."""
    e = table(spark, sf, "embeddings").filter("embedding is not null and label is not null")
    c = centroids(spark, sf).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("c"))
    seeds = c.agg(F.collect_list(F.struct("label", "c")).alias("seeds"))  # 64 numbers per label
    j = e.join(F.broadcast(seeds))
    dot = lambda s: F.aggregate(F.zip_with(s["c"], F.transform("embedding", lambda x: x.cast("double")), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scored = F.transform("seeds", lambda s: F.struct(F.round(dot(s), 9).alias("sim"), (-s["label"]).alias("neg")))
    return j.select("vec_id", "label", (-F.array_max(scored)["neg"]).alias("nearest"))


def knowledge_assembly(spark: SparkSession, sf: str, tokens: int = 60) -> DataFrame:
    """Per user the strongest active facts as lines, as long as they fit a token budget; retracted and superseded ones are left out."""
    f = facts(spark, sf).filter("status = 'active' and confidence is not null and subject_key is not null and object_key is not null")
    line = F.concat(F.lit("- "), F.col("subject_key"), F.lit(" "), F.col("predicate"), F.lit(" "), F.col("object_key"))
    f = f.groupBy("user_id", "subject_key", "predicate", "object_key").agg(F.max("confidence").alias("confidence")).withColumn("line", line)
    f = f.withColumn("n", T.token_count(F.col("line")))
    run = ranked(f, ["user_id"], [F.col("confidence").desc(), F.col("line").asc()], "used", value="n").filter(F.col("used") <= tokens)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "line"))), lambda s: s["line"]), "\n")
    return run.groupBy("user_id").agg(F.md5(joined).alias("digest"), F.count(F.lit(1)).alias("facts"), F.max("used").cast("bigint").alias("tokens"))


def access_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Access counts from a log instead of writes on reads: a reply is an access to the message it answers."""
    c = one_per_chunk(table(spark, sf, "chunks"), "extra", "access_count")
    log = c.select(F.get_json_object("extra", "$.reply_to").alias("chunk_id")).filter("chunk_id is not null").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
    return c.select("chunk_id", "access_count").join(log, "chunk_id").select("chunk_id", (F.coalesce("access_count", F.lit(0)) + F.col("n")).alias("access_count"))


def speaker_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Messages per speaker spelling that may feed a profile."""
    c = one_per_chunk(table(spark, sf, "chunks"), "speaker")
    return c.select(F.coalesce(F.lower("speaker"), F.lit("")).alias("speaker")).filter(F.col("speaker").isin("user", "human", "")).groupBy("speaker").agg(F.count(F.lit(1)).alias("messages"))


def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of each event user: a gap of 30 minutes ends one."""
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    g = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return g.select("user_id", F.unix_micros("w.start").alias("start_us"), "events")


QUERIES = {
    "profile_ema": profile_ema, "profile_labels": profile_labels, "signal_window50": signal_window50, "behavioral_signals": behavioral_signals, "intent_weights": intent_weights, 
    "feedback_overlap": feedback_overlap, "feedback_apply": feedback_apply, "feedback_totals": feedback_totals, 
    "explicit_latest": explicit_latest, "explicit_search": explicit_search, "tombstones": tombstones, "working_context": working_context,
    "metrics_histogram": metrics_histogram, "store_stats": store_stats, "centroids": centroids, "seed_types": seed_types, "knowledge_assembly": knowledge_assembly, "access_counts": access_counts,
    "speaker_gate": speaker_gate, "session_windows": session_windows,
}

_SIG = "s AS (SELECT DISTINCT * FROM profile_signals WHERE signal IS NOT NULL AND signal_at IS NOT NULL)"
_EMA = f"""{_SIG}, i AS (SELECT *, row_number() OVER (PARTITION BY user_id, dimension ORDER BY signal_at NULLS FIRST, signal NULLS FIRST, weight NULLS FIRST) AS i, count(*) OVER (PARTITION BY user_id, dimension) AS n FROM s),
ema AS (SELECT user_id, dimension, round(pow(0.8, any_value(n)) * 0.5 + sum(signal * 0.2 * pow(0.8, n - i)), 6) AS value, max(n) AS signals FROM i GROUP BY 1, 2)"""
_REP = f"""c AS (SELECT chunk_id, any_value(text) AS text, any_value(extra) AS extra, any_value(confidence) AS confidence, any_value(access_count) AS access_count FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY 1),
w AS (SELECT *, list_distinct(list_filter({S.tokens('text')}, lambda x: length(x) >= 3)) AS w, CASE WHEN json_valid(extra) THEN json_extract_string(extra, '$.reply_to') END AS "to" FROM c),
r AS (SELECT a.chunk_id, a."to", coalesce(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0), 0.0) AS j, b.confidence, b.access_count FROM w a JOIN w b ON b.chunk_id = a."to")"""


def _labels() -> str:
    return "CASE " + " ".join(f"WHEN dimension = '{d}' THEN CASE {' '.join(f'WHEN value >= {v} THEN {chr(39)}{n}{chr(39)}' for v, n in steps)} ELSE 'unknown' END" for d, steps in L.PROFILE_LABELS.items()) + " ELSE 'unknown' END"


_I = f"""i AS (SELECT chunk_id, {S.count_of('text', L.RECENCY, L.RECENCY_PHRASES)} AS r, {S.count_of('text', L.PRECISION, L.PRECISION_PHRASES)} AS p, {S.count_of('text', L.BREADTH, L.BREADTH_PHRASES)} AS b FROM t),
w AS (SELECT chunk_id, CASE WHEN b > 0 THEN 0.5 ELSE 0.75 - least(0.30, r * 0.15) + least(0.15, p * 0.08) END AS s, CASE WHEN b > 0 THEN 0.2 ELSE 0.15 + least(0.30, r * 0.15) - least(0.15, p * 0.08) * 0.5 END AS t,
  CASE WHEN b > 0 THEN 0.15 ELSE 0.05 END AS f, CASE WHEN b > 0 THEN 0.15 ELSE greatest(0, 0.05 - least(0.15, p * 0.08) * 0.5) END AS m FROM i)"""
_LATEST = "x AS (SELECT user_id, event_type AS key, json_extract_string(arg_max(props, (ts, event_id)), '$.k') AS value, min(ts) AS created, max(ts) AS updated FROM events WHERE ts IS NOT NULL GROUP BY 1, 2)"

ORACLE = {
    "profile_ema": f"WITH {_EMA} SELECT user_id, dimension, value, signals, least(1.0, least(signals, 50) / 20) AS confidence FROM ema",
    "profile_labels": f"WITH {_EMA} SELECT user_id, dimension, {_labels()} AS label FROM ema",
    "signal_window50": f"""WITH {_SIG}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, dimension ORDER BY signal_at DESC NULLS LAST, signal DESC NULLS LAST, weight DESC NULLS LAST) AS i FROM s)
SELECT user_id, dimension, round(avg(signal), 6) AS mean, count(*) AS n FROM r WHERE i <= 50 GROUP BY 1, 2""",
    "behavioral_signals": rf"""WITH t AS (SELECT chunk_id, any_value(text) AS text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL AND lower(trim(speaker, ' ')) IN ('user', 'human') GROUP BY 1),
k AS (SELECT chunk_id, CAST(len({S.words('text')}) AS DOUBLE) AS n, CAST({S.count_of('text', L.PROFILE_TECH)} AS DOUBLE) AS tech, CAST(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+''[\p{{L}}\p{{N}}_]+')) AS DOUBLE) AS c, CAST(greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS DOUBLE) AS e FROM t)
SELECT chunk_id, round(least(1.0, n / 200 * 0.5 + tech / 5 * 0.5), 6) AS response_depth, round(least(1.0, greatest(0.0, n / e / 25 * 0.5 - c / 3 * 0.3 + 0.3)), 6) AS formality,
  round(least(1.0, tech / greatest(n, 1) * 10), 6) AS domain_expertise, round(least(1.0, n / 300), 6) AS verbosity_preference FROM k""",
    "intent_weights": f"""WITH {S.TEXTS}, {_I}
SELECT chunk_id, CAST(round(CAST(s AS DOUBLE) / (s + t + f + m), 6) AS DOUBLE) AS similarity, CAST(round(CAST(t AS DOUBLE) / (s + t + f + m), 6) AS DOUBLE) AS temporal, CAST(round(CAST(f AS DOUBLE) / (s + t + f + m), 6) AS DOUBLE) AS reinforcement, CAST(round(CAST(m AS DOUBLE) / (s + t + f + m), 6) AS DOUBLE) AS importance FROM w""",
    "feedback_overlap": f'WITH {_REP} SELECT chunk_id, "to", round(j, 6) AS overlap, j >= 0.15 AS used FROM r',
    "feedback_apply": f'WITH {_REP} SELECT "to" AS chunk_id, coalesce(any_value(access_count), 0) + 2 * count(*) FILTER (WHERE j >= 0.15) AS access_count, round(coalesce(any_value(confidence), 1.0) * pow(0.95, count(*) FILTER (WHERE j < 0.15)), 6) AS confidence FROM r GROUP BY "to"',
    "feedback_totals": f"WITH {_REP} SELECT count(*) AS replies, count(*) FILTER (WHERE j >= 0.15) AS used, round(count(*) FILTER (WHERE j >= 0.15) / count(*), 6) AS ratio FROM r",
    "explicit_latest": f"WITH {_LATEST} SELECT user_id, key, value, created, updated FROM x",
    "explicit_search": f"WITH {_LATEST} SELECT user_id, key, value, row_number() OVER (PARTITION BY user_id ORDER BY TRY_CAST(value AS INTEGER) DESC NULLS LAST, key) AS place FROM x WHERE contains(lower(key), 'click') OR contains(lower(value), '7')",
    "tombstones": """WITH g AS (SELECT user_id, max(ts) AS gone FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT e.user_id, event_type, max(event_id) AS event_id FROM events e LEFT JOIN g USING (user_id) WHERE event_type <> 'error' AND ts IS NOT NULL AND (gone IS NULL OR ts > gone) GROUP BY 1, 2""",
    "working_context": """WITH c AS (SELECT chunk_id, any_value(conversation_id) AS conversation_id, any_value(entity_mentions) AS m FROM chunks WHERE chunk_id IS NOT NULL AND coalesce(conversation_id, '') <> '' GROUP BY 1),
n AS (SELECT conversation_id, name, count(*) AS mentions FROM (SELECT conversation_id, unnest(m) AS name FROM c) WHERE name IS NOT NULL GROUP BY 1, 2)
SELECT conversation_id, name, mentions, row_number() OVER (PARTITION BY conversation_id ORDER BY mentions DESC, name) AS place FROM n QUALIFY place <= 10""",
    "metrics_histogram": """WITH l AS (SELECT event_type, value FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1000), g AS (SELECT event_type, list_sort(list(value)) AS v FROM l GROUP BY 1)
SELECT event_type, len(v) AS n, round(list_sum(v) / len(v), 6) AS mean, v[CAST(floor(len(v) * 0.5) AS BIGINT) + 1] AS p50, v[CAST(floor(len(v) * 0.99) AS BIGINT) + 1] AS p99, v[len(v)] AS top FROM g""",
    "store_stats": """SELECT user_id, count(DISTINCT chunk_id) AS n, 'chunks' AS layer FROM chunks GROUP BY 1 UNION ALL SELECT user_id, count(DISTINCT entity_key), 'entities' FROM entities GROUP BY 1
UNION ALL SELECT user_id, count(DISTINCT id), 'relations' FROM relations GROUP BY 1 UNION ALL SELECT user_id, count(*), 'profile_signals' FROM profile_signals GROUP BY 1""",
    "centroids": "SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(avg(CAST(embedding[pos] AS DOUBLE)), 6) AS mean FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL) GROUP BY 1, 2",
    "seed_types": """WITH m AS (SELECT label, pos, round(avg(CAST(embedding[pos] AS DOUBLE)), 6) AS mean FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL) GROUP BY 1, 2),
c AS (SELECT label, list(mean ORDER BY pos) AS c FROM m GROUP BY 1)
SELECT vec_id, e.label, arg_max(c.label, (round(list_dot_product(c.c, list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 9), -c.label)) AS nearest FROM embeddings e, c WHERE embedding IS NOT NULL AND e.label IS NOT NULL GROUP BY 1, 2""",
    "knowledge_assembly": rf"""WITH f AS (SELECT DISTINCT ON (id) *, regexp_replace(lower(regexp_replace(predicate, '^\s+|\s+$', '', 'g')), '[\s_-]+', '_', 'g') AS p, coalesce(lower(regexp_replace(status, '^\s+|\s+$', '', 'g')), 'active') AS st FROM relations WHERE id IS NOT NULL ORDER BY id),
g AS (SELECT user_id, '- ' || subject_key || ' ' || p || ' ' || object_key AS line, max(confidence) AS c FROM f WHERE st = 'active' AND confidence IS NOT NULL AND subject_key IS NOT NULL AND object_key IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, sum(greatest(1, CAST(floor(len({S.words('line')}) * 4 / 3.0) AS INTEGER))) OVER (PARTITION BY user_id ORDER BY c DESC, line ROWS UNBOUNDED PRECEDING) AS used FROM g)
SELECT user_id, md5(string_agg(line, chr(10) ORDER BY c DESC, line)) AS digest, count(*) AS facts, CAST(max(used) AS BIGINT) AS tokens FROM r WHERE used <= 60 GROUP BY 1""",
    "access_counts": """WITH c AS (SELECT chunk_id, any_value(extra) AS extra, any_value(access_count) AS a FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1),
l AS (SELECT json_extract_string(extra, '$.reply_to') AS chunk_id, count(*) AS n FROM c WHERE json_valid(extra) GROUP BY 1) SELECT chunk_id, coalesce(a, 0) + n AS access_count FROM c JOIN l USING (chunk_id)""",
    "speaker_gate": "WITH c AS (SELECT chunk_id, any_value(speaker) AS speaker FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1) SELECT coalesce(lower(speaker), '') AS speaker, count(*) AS messages FROM c WHERE coalesce(lower(speaker), '') IN ('user', 'human', '') GROUP BY 1",
    "session_windows": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS events FROM s GROUP BY user_id, no""",
}
