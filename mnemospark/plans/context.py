"""Queries of tiers, scoped and re-ranked search, signals and budgets, and the assembled context of every user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions import lexicon as L
from mnemospark.functions import text as T
from mnemospark.operators.ranking import ranked
from mnemospark.operators.search import fused_search
from mnemospark.plans import sqlkit as S
from mnemospark.plans.episodic import _ROWS, _SIM_SQL, _shown, _topk, _usable, coretrieval_pairs, number, own_topk, query_rows, scored_rows, texts
from mnemospark.plans.episodic import ORACLE as EPISODIC_SQL
from mnemospark.plans.knowledge import _F, facts, now
from mnemospark.session import materialize
from mnemospark.sources.tables import one_per_chunk, table

NOW = "2025-01-01 00:00:00"
HOT, WARM = 20, 60


def tiers(spark: SparkSession, sf: str, hot: int = HOT, warm: int = WARM) -> DataFrame:
    """By recency within a user: the newest are hot, then warm, then cold."""
    c = one_per_chunk(table(spark, sf, "chunks").filter("timestamp is not null"), "timestamp", "user_id")
    r = ranked(c, ["user_id"], [F.col("timestamp").desc(), F.col("chunk_id").asc()], "n")
    return r.select(F.col("chunk_id").alias("id"), F.when(F.col("n") <= hot, "hot").when(F.col("n") <= warm, "warm").otherwise("cold").alias("tier"))


def tier_compaction(spark: SparkSession, sf: str) -> DataFrame:
    """Users with more than 20 chunks move the older half, up to the median time, to the warm tier."""
    c = one_per_chunk(table(spark, sf, "chunks").filter("timestamp is not null and user_id is not null"), "timestamp", "user_id").withColumn("at", F.unix_micros(F.col("timestamp").cast("timestamp")).cast("double"))
    m = c.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.percentile("at", F.lit(0.5)).alias("m"))
    return c.join(m, "user_id").select("chunk_id", F.when((F.col("n") > HOT) & (F.col("at") <= F.col("m")), "warm").otherwise("hot").alias("tier"))


def tier_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks per tier with their mean and greatest age and accesses."""
    c = one_per_chunk(table(spark, sf, "chunks"), "timestamp", "access_count").withColumnRenamed("chunk_id", "id").join(tiers(spark, sf), "id")
    days = F.floor((F.unix_micros(now()) - F.unix_micros(F.col("timestamp").cast("timestamp"))) / 8.64e10)
    a = F.coalesce("access_count", F.lit(0))
    return c.groupBy("tier").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg(days), 6).alias("mean_age"), F.max(days).alias("most_age"), F.round(F.avg(a), 6).alias("mean_access"), F.max(a).alias("most_access"))


def tier_eviction(spark: SparkSession, sf: str) -> DataFrame:
    """Cold chunks that decay has brought under 0.05, older than 90 days and never asked for."""
    c = one_per_chunk(table(spark, sf, "chunks").filter("timestamp is not null"), "timestamp", "confidence", "access_count").withColumnRenamed("chunk_id", "id").join(tiers(spark, sf).filter("tier = 'cold'"), "id")
    d = (F.unix_micros(now()) - F.unix_micros(F.col("timestamp").cast("timestamp"))) / 8.64e10
    left = F.least(F.coalesce("confidence", F.lit(1.0)), F.exp(-0.01 * F.greatest(F.lit(0.0), d)))
    return c.filter((left < 0.05) & (d > 90) & (F.coalesce("access_count", F.lit(0)) <= 0)).select("id")


def tiered_search(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    """Within a user: the hot tier always, the warm one if that gives too few or too poor rows, the cold one if there are too few still. Accesses are normalised per tier."""
    rows = _usable(scored_rows(spark, sf)).drop("text", "conversation_id", "speaker", "timestamp")
    by = materialize(rows.join(tiers(spark, sf), "id"), "tiers")
    q = query_rows(rows)
    got = None
    for tier in ("hot", "warm", "cold"):
        r = fused_search(q, by.filter(F.col("tier") == tier).drop("tier"), k, same_group=True).withColumn("tier", F.lit(tier))
        got = r if got is None else got.unionByName(r)
    got = materialize(got.select("query_id", "id", "similarity", "score", "tier"), "tiered")
    of = lambda t: F.count_if(F.col("tier") == t)
    stat = got.groupBy("query_id").agg(of("hot").alias("h"), of("warm").alias("w"), F.min(F.when(F.col("tier") == "hot", F.col("score"))).alias("worst"))
    warm = (F.col("h") < k) | (F.col("worst") < 0.3)
    cold = F.col("h") + F.when(warm, F.col("w")).otherwise(0) < k
    use = got.join(stat, "query_id").filter((F.col("tier") == "hot") | ((F.col("tier") == "warm") & warm) | ((F.col("tier") == "cold") & cold))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")  # fifteen rows at most
    return use.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"), "tier")


def conversation_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Search within the conversation of the query."""
    rows = _usable(scored_rows(spark, sf)).filter("coalesce(conversation_id, '') <> ''").withColumn("grp", F.col("conversation_id")).drop("text", "conversation_id", "speaker", "timestamp")
    return _shown(fused_search(query_rows(rows), rows, 3, same_group=True))


def _unit(v: str) -> Column:
    d = F.transform(v, lambda x: x.cast("double"))
    return F.transform(d, lambda x: x / F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, y: a + y * y)))


def _scoped(spark: SparkSession, sf: str, column: str, spelled) -> DataFrame:
    """The five rows of the user most similar to a query that share an entry of a list column with it: an equi-join on the entries."""
    rows = _usable(scored_rows(spark, sf)).select("id", "vector", "grp")
    own = one_per_chunk(table(spark, sf, "chunks"), column).select(F.col("chunk_id").alias("id"), F.explode(F.array_distinct(F.transform(column, spelled))).alias("e")).filter("e is not null and e <> ''")
    e = materialize(rows.select("id", "grp").join(own, "id"), "entries")
    q = e.filter(number("id") % 50 == 0).select(F.col("id").alias("query_id"), "grp", "e")
    pairs = q.join(e, ["grp", "e"]).filter("query_id <> id").select("query_id", "id").distinct()
    u = rows.select("id", _unit("vector").alias("u"))
    both = pairs.join(u, "id").join(u.select(F.col("id").alias("query_id"), F.col("u").alias("v")), "query_id")
    sim = F.aggregate(F.zip_with("u", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    best = Window.partitionBy("query_id").orderBy(F.desc("s"), "id")
    return both.select("query_id", "id", F.round(sim, 9).alias("s")).withColumn("n", F.row_number().over(best)).filter("n <= 5").select("query_id", "id", F.round("s", 6).alias("similarity"))


def entity_scoped_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _scoped(spark, sf, "entity_mentions", lambda x: x)


def tag_scoped_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _scoped(spark, sf, "topic_tags", lambda x: F.lower(F.trim(x)))


def lexical_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """The five own rows of every query re-ranked: 8 % more for each word they share with it, 15 % for each name or anchor of it that they or their conversation hold; the three best."""
    top = own_topk(spark, sf).select("query_id", "id", "score")
    c = texts(spark, sf, "conversation_id").withColumn("w", F.array_distinct(T.words(F.lower("text"))))
    anchored = F.regexp_extract_all("text", F.lit(r"(?i)(?:^|[^A-Za-z0-9_])(?:team|project|session|meeting|sprint|channel)\s+([A-Za-z0-9_]+)"), 1)
    named = F.filter(T.proper_nouns(F.col("text")), lambda n: (F.length(n) > 2) & ~F.lower(n).isin(L.ANCHOR_SKIP_WORDS))
    q = c.filter(number("chunk_id") % 50 == 0).select(F.col("chunk_id").alias("query_id"), F.filter("w", lambda x: ~x.isin(L.RERANK_STOP_WORDS)).alias("terms"), F.transform(F.concat(anchored, named), lambda x: F.lower(F.regexp_replace(x, r"\s+", " "))).alias("anchors"))
    j = top.join(q, "query_id").join(c.select(F.col("chunk_id").alias("id"), F.lower("text").alias("low"), F.lower(F.coalesce("conversation_id", F.lit(""))).alias("conv"), "w"), "id")
    overlap = F.size(F.array_intersect("terms", "w"))
    hits = F.size(F.filter("anchors", lambda a: F.contains(F.col("low"), a) | F.contains(F.col("conv"), a)))
    s = j.select("query_id", "id", overlap.alias("overlap"), hits.alias("anchors"), F.round(F.col("score") * (1 + overlap * 0.08) * F.pow(F.lit(1.15), hits), 5).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")  # five rows at most
    return s.withColumn("place", F.row_number().over(best)).filter("place <= 3")


def associated_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The five chunks most often retrieved together with each chunk."""
    return ranked(coretrieval_pairs(spark, sf), ["a"], [F.col("times").desc(), F.col("b").asc()], "place").filter("place <= 5").select(F.col("a").alias("chunk_id"), F.col("b").alias("peer"), "times", "place")


def retrieval_log(spark: SparkSession, sf: str) -> DataFrame:
    """Accesses that the searches of the query set write, and the counts of the chunks after them."""
    log = own_topk(spark, sf).groupBy("id").agg(F.count(F.lit(1)).alias("hits"))
    c = one_per_chunk(table(spark, sf, "chunks"), "access_count").withColumnRenamed("chunk_id", "id")
    return log.join(c, "id").select("id", "hits", (F.coalesce("access_count", F.lit(0)) + F.col("hits")).alias("access_count"))


def layer_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Per query the mean score of its five hits, within 0 and 1, and the mean confidence of the five strongest facts of its user."""
    e = own_topk(spark, sf).groupBy("query_id").agg(F.avg("score").alias("e"))
    user = one_per_chunk(table(spark, sf, "chunks"), "user_id").select(F.col("chunk_id").alias("query_id"), "user_id")
    f = facts(spark, sf).filter("status = 'active' and confidence is not null and user_id is not null")
    s = ranked(f, ["user_id"], [F.col("confidence").desc(), F.col("id").asc()], "n").filter("n <= 5").groupBy("user_id").agg(F.avg("confidence").alias("s"))
    j = e.join(user, "query_id").join(s, "user_id", "left")
    return j.select("query_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("e"))), 6).alias("episodic"), F.round(F.coalesce("s", F.lit(0.0)), 6).alias("semantic"))


def budget_split(spark: SparkSession, sf: str, total: int = 4000) -> DataFrame:
    """Tokens per layer for every query: fixed ones first, the rest by signal (0.6) and configuration (0.4, at four to three). Settings are reserved for users with signals, working memory for messages of a conversation."""
    c = one_per_chunk(table(spark, sf, "chunks"), "user_id", "conversation_id").select(F.col("chunk_id").alias("query_id"), "user_id", (F.coalesce("conversation_id", F.lit("")) != "").alias("w"))
    has = table(spark, sf, "profile_signals").filter("user_id is not null").select("user_id", F.lit(True).alias("x")).distinct()
    b = layer_signals(spark, sf).join(c, "query_id").join(has, "user_id", "left")
    behavioral = min(200, total // 20)
    explicit = F.when(F.col("x"), min(total // 4, max(200, total // 8))).otherwise(0)
    working = F.when(F.col("w"), min(total // 6, max(150, total // 10))).otherwise(0)
    rest = F.lit(total) - behavioral - explicit - working
    share = F.when(F.col("episodic") + F.col("semantic") > 0, F.col("episodic") / (F.col("episodic") + F.col("semantic"))).otherwise(0.6)
    episodic = (rest * (share * 0.6 + 0.4 * 4 / 7)).cast("bigint")
    return b.select("query_id", explicit.cast("bigint").alias("explicit"), working.cast("bigint").alias("working"), episodic.alias("episodic"), (rest - episodic).cast("bigint").alias("semantic"))


HEADS = {1: "## About This User", 2: "\n## Known Facts (from past conversations)", 3: "\n## Previous Sessions", 4: "\n## Relevant Past Details", 5: "\n## Communication Style"}
HEAD_WORDS = {k: len(v.split()) for k, v in HEADS.items()}


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, section, weight, line): what may go into the knowledge of a user. The session that is going on, the last one, is left out."""
    s = table(spark, sf, "profile_signals").filter("signal is not null and signal_at is not null and user_id is not null and dimension is not null")
    last = s.groupBy("user_id", "dimension").agg(F.max(F.struct("signal_at", "signal")).alias("r")).select("user_id", "dimension", F.round(F.col("r.signal") * 100).cast("bigint").alias("v"))
    kind = F.when(F.col("dimension").isin("depth", "verbosity"), 2).when(F.col("dimension").isin("formality", "warmth"), 1).otherwise(0)  # instruction, preference, other
    said = F.concat(F.when(kind == 2, "- [instruction] ").otherwise("- "), F.col("dimension"), F.lit(": "), F.col("v").cast("string"))
    explicit = last.select("user_id", F.lit(1).alias("section"), (-kind).cast("double").alias("weight"), said.alias("line"))
    f = facts(spark, sf).filter("status = 'active' and confidence is not null and subject_key is not null and object_key is not null and user_id is not null")
    fact = f.groupBy("user_id", F.concat(F.lit("- "), "subject_key", F.lit(" "), "predicate", F.lit(" "), "object_key").alias("line")).agg(F.round(F.max("confidence"), 6).alias("weight")).select("user_id", F.lit(2).alias("section"), "weight", "line")
    c = one_per_chunk(table(spark, sf, "chunks").filter("text is not null and timestamp is not null and user_id is not null and coalesce(conversation_id, '') <> ''"), "text", "timestamp", "user_id", "conversation_id")
    c = materialize(c.select("chunk_id", "user_id", "conversation_id", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at"), F.substring("text", 1, 60).alias("head"), F.round(T.importance(F.col("text"), F.lit(0.5)), 6).alias("score")), "past")
    conv = c.groupBy("user_id", "conversation_id").agg(F.max("at").alias("end"), F.min(F.struct("at", "chunk_id", "head")).alias("r"))
    current = conv.groupBy("user_id").agg(F.max(F.struct("end", "conversation_id")).alias("r")).select("user_id", F.col("r.conversation_id").alias("current"))
    past = conv.join(current, "user_id").filter("conversation_id <> current")
    summary = past.select("user_id", F.lit(3).alias("section"), F.col("end").cast("double").alias("weight"), F.concat(F.lit("- ["), "conversation_id", F.lit("] "), "r.head").alias("line"))
    episode = c.join(current, "user_id").filter("conversation_id <> current and score > 0.3").select("user_id", F.lit(4).alias("section"), F.col("score").alias("weight"), F.concat(F.lit("- "), "head").alias("line"))
    depth = F.max(F.when(F.col("dimension") == "depth", F.col("v")))
    formality = F.max(F.when(F.col("dimension") == "formality", F.col("v")))
    hints = F.array_join(F.filter(F.array(F.when(depth > 70, "prefers detailed technical responses").when(depth < 30, "prefers brief responses"), F.when(formality > 70, "formal tone").when(formality < 30, "casual tone")), lambda x: x.isNotNull()), ", ")
    style = last.groupBy("user_id").agg(hints.alias("h")).filter("h <> ''").select("user_id", F.lit(5).alias("section"), F.lit(0.0).alias("weight"), F.concat(F.lit("- "), "h").alias("line"))
    return explicit.unionByName(fact).unionByName(summary).unionByName(episode).unionByName(style)


def knowledge_context(spark: SparkSession, sf: str, budget: int = 200) -> DataFrame:
    """What is known of a user from past sessions as one text of at most `budget` tokens: settings, facts, sessions, details, style.

    Settings and style always stay. To fit, details go first, then sessions, then facts,
    each from the end: what stays is the longest beginning of their sequence that fits.
    """
    r = ranked(_lines(spark, sf), ["user_id", "section"], [F.col("weight").desc(), F.col("line").asc()], "n")
    head = F.element_at(F.create_map(*[x for k, v in HEADS.items() for x in (F.lit(k), F.lit(v))]), F.col("section"))
    words = F.element_at(F.create_map(*[x for k, v in HEAD_WORDS.items() for x in (F.lit(k), F.lit(v))]), F.col("section"))
    first = F.col("n") == 1
    r = r.select("user_id", "section", "n", F.when(first, F.concat(head, F.lit("\n"), "line")).otherwise(F.col("line")).alias("line"), (F.size(T.words(F.col("line"))) + F.when(first, words).otherwise(0)).cast("bigint").alias("words"))
    r = materialize(r, "lines")
    always = r.filter(F.col("section").isin(1, 5))
    base = always.groupBy("user_id").agg(F.sum("words").alias("base"))
    run = ranked(r.filter(~F.col("section").isin(1, 5)), ["user_id"], ["section", "n"], "upto", value="words").join(base, "user_id", "left")
    kept = run.filter(F.floor((F.coalesce("base", F.lit(0)) + F.col("upto")) * 4 / 3) <= budget).select("user_id", "section", "n", "line", "words")
    every = kept.unionByName(always.select("user_id", "section", "n", "line", "words"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "n", "line"))), lambda x: x["line"]), "\n")  # a budget's lines
    of = lambda k: F.count_if(F.col("section") == k)
    return every.groupBy("user_id").agg(F.md5(joined).alias("digest"), of(2).alias("facts"), of(3).alias("sessions"), of(4).alias("details"), F.floor(F.sum("words") * 4 / 3).alias("tokens"))


def working_dump(spark: SparkSession, sf: str) -> DataFrame:
    """The working memory of every conversation as text: its last ten messages, each under the kind of its speaker."""
    c = one_per_chunk(table(spark, sf, "chunks").filter("text is not null and timestamp is not null and coalesce(conversation_id, '') <> ''"), "text", "timestamp", "conversation_id", "speaker")
    kind = F.when(F.lower(F.trim("speaker")).isin("user", "human"), "goal").when(F.lower(F.trim("speaker")).isin("assistant", "ai", "bot"), "fact").otherwise("thread")
    r = ranked(c, ["conversation_id"], [F.col("timestamp").desc(), F.col("chunk_id").desc()], "n").filter("n <= 10").withColumn("kind", kind)
    line = F.concat(F.lit("["), "kind", F.lit("] "), F.substring("text", 1, 80))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), line.alias("line")))), lambda x: x["line"]), "\n")
    return r.groupBy("conversation_id").agg(F.md5(text).alias("digest"), F.count_if(F.col("kind") == "goal").alias("goals"), F.count_if(F.col("kind") == "fact").alias("facts"), F.count_if(F.col("kind") == "thread").alias("threads"))


QUERIES = {
    "tier_compaction": tier_compaction, "tier_stats": tier_stats, "tier_eviction": tier_eviction, "tiered_search": tiered_search, "conversation_topk": conversation_topk, "entity_scoped_topk": entity_scoped_topk, "tag_scoped_topk": tag_scoped_topk,
    "lexical_rerank": lexical_rerank, "associated_chunks": associated_chunks, "retrieval_log": retrieval_log, "layer_signals": layer_signals, "budget_split": budget_split, "knowledge_context": knowledge_context, "working_dump": working_dump,
}

_T = f"""tr AS (SELECT chunk_id AS id, CASE WHEN n <= {HOT} THEN 'hot' WHEN n <= {WARM} THEN 'warm' ELSE 'cold' END AS tier FROM (
  SELECT chunk_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, chunk_id) AS n FROM (SELECT chunk_id, any_value(timestamp) AS ts, any_value(user_id) AS user_id FROM chunks WHERE chunk_id IS NOT NULL AND timestamp IS NOT NULL GROUP BY 1)))"""
_A = f"a AS (SELECT chunk_id AS id, any_value(timestamp) AS ts, any_value(confidence) AS confidence, coalesce(any_value(access_count), 0) AS access, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(any_value(timestamp))) / 8.64e10 AS d FROM chunks WHERE chunk_id IS NOT NULL AND timestamp IS NOT NULL GROUP BY 1)"
_TOPS = " UNION ALL ".join(f"SELECT *, '{t}' AS tier FROM ({_SIM_SQL(5, 0.15, 0.05, 0.05, f'''id IN (WITH {_T} SELECT id FROM tr WHERE tier = '{t}')''', 'q.grp = d.grp')})" for t in ("hot", "warm", "cold"))


def _scoped_sql(column: str, spelled: str) -> str:
    return f"""WITH {_ROWS}, o AS (SELECT chunk_id AS id, unnest(list_distinct(list_transform(any_value({column}), lambda x: {spelled}))) AS e FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1),
e AS (SELECT u.id, u.grp, u.unit, o.e FROM u JOIN o ON o.id = u.id WHERE o.e IS NOT NULL AND o.e <> ''),
pr AS (SELECT DISTINCT q.id AS query_id, d.id AS id FROM e q JOIN e d ON q.grp = d.grp AND q.e = d.e AND q.id <> d.id WHERE CAST(regexp_extract(q.id, '([0-9]+)$', 1) AS BIGINT) % 50 = 0),
sm AS (SELECT query_id, pr.id, round(list_dot_product(a.unit, b.unit), 9) AS s FROM pr JOIN u a ON a.id = query_id JOIN u b ON b.id = pr.id)
SELECT query_id, id, round(s, 6) AS similarity FROM sm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 5"""


_SIG = f"""sg AS (SELECT query_id, round(greatest(0.0, least(1.0, e)), 6) AS episodic, round(coalesce(s, 0.0), 6) AS semantic FROM (SELECT query_id, avg(score) AS e FROM ({EPISODIC_SQL['own_topk']}) GROUP BY 1) x
  JOIN (SELECT chunk_id, any_value(user_id) AS user_id FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1) c ON c.chunk_id = query_id
  LEFT JOIN (SELECT user_id, avg(confidence) AS s FROM (SELECT user_id, confidence FROM f WHERE status = 'active' AND confidence IS NOT NULL AND user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, id) <= 5) GROUP BY 1) y ON y.user_id = c.user_id)"""
_IMP = f"""round(greatest(0.1, least(1.0, (least(1.0, len({S.proper('text')}) / greatest(len({S.words('text')}), 1) * 5) * 0.6 + least(1.0, ({' + '.join(S.any_of(S.padded('text'), x) for x in L.FACT_PHRASES)}) / 3) * 0.4) * 0.35 + 0.5 * 0.30
  + least(1.0, greatest(len({S.words('text')}), 1) / 15) * 0.15 + (1 - least(1.0, ({' + '.join(S.any_of(S.padded('text'), x) for x in L.LOW_VALUE_PHRASES)}) / 2)) * 0.20)), 6)"""
_HEAD = "CASE section " + " ".join(f"WHEN {k} THEN " + "'" + v.replace("\n", "' || chr(10) || '") + "'" for k, v in HEADS.items()) + " END"
_HEADW = "CASE section " + " ".join(f"WHEN {k} THEN {v}" for k, v in HEAD_WORDS.items()) + " END"

ORACLE = {
    "tier_compaction": f"""WITH c AS (SELECT chunk_id, CAST(epoch_us(any_value(timestamp)) AS DOUBLE) AS at_, any_value(user_id) AS user_id FROM chunks WHERE chunk_id IS NOT NULL AND timestamp IS NOT NULL AND user_id IS NOT NULL GROUP BY 1),
m AS (SELECT user_id, count(*) AS n, quantile_cont(at_, 0.5) AS m FROM c GROUP BY 1) SELECT chunk_id, CASE WHEN n > {HOT} AND at_ <= m THEN 'warm' ELSE 'hot' END AS tier FROM c JOIN m USING (user_id)""",
    "tier_stats": f"WITH {_T}, {_A} SELECT tier, count(*) AS chunks, round(avg(floor(d)), 6) AS mean_age, CAST(max(floor(d)) AS BIGINT) AS most_age, round(avg(access), 6) AS mean_access, max(access) AS most_access FROM a JOIN tr USING (id) GROUP BY 1",
    "tier_eviction": f"WITH {_T}, {_A} SELECT id FROM a JOIN tr USING (id) WHERE tier = 'cold' AND least(coalesce(confidence, 1.0), exp(-0.01 * greatest(0.0, d))) < 0.05 AND d > 90 AND access <= 0",
    "tiered_search": f"""WITH g AS ({_TOPS}), st AS (SELECT query_id, count(*) FILTER (WHERE tier = 'hot') AS h, count(*) FILTER (WHERE tier = 'warm') AS w, min(score) FILTER (WHERE tier = 'hot') AS worst FROM g GROUP BY 1),
us AS (SELECT g.* FROM g JOIN st USING (query_id) WHERE tier = 'hot' OR tier = 'warm' AND (h < 5 OR worst < 0.3) OR tier = 'cold' AND h + CASE WHEN h < 5 OR worst < 0.3 THEN w ELSE 0 END < 5)
SELECT query_id, id, round(similarity, 6) AS similarity, round(score, 6) AS score, tier FROM us QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 5""",
    "conversation_topk": _topk(3, 0.15, 0.05, 0.05, on="q.conv = d.conv AND coalesce(d.conv, '') <> ''").replace("d AS (SELECT * FROM u WHERE true)", "d AS (SELECT * FROM u WHERE coalesce(conv, '') <> '')"),
    "entity_scoped_topk": _scoped_sql("entity_mentions", "x"),
    "tag_scoped_topk": _scoped_sql("topic_tags", "lower(trim(x, ' '))"),
    "lexical_rerank": rf"""WITH o AS ({EPISODIC_SQL['own_topk']}), t AS (SELECT chunk_id, any_value(text) AS text, any_value(conversation_id) AS conv FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY 1),
k AS (SELECT *, list_distinct({S.words('lower(text)')}) AS w FROM t),
q AS (SELECT chunk_id AS query_id, list_filter(w, lambda x: x NOT IN ({S.quoted(L.RERANK_STOP_WORDS)})) AS terms, list_transform(list_concat(regexp_extract_all(text, '(?i)(?:^|[^A-Za-z0-9_])(?:team|project|session|meeting|sprint|channel)\s+([A-Za-z0-9_]+)', 1),
  list_filter({S.proper('text')}, lambda n: length(n) > 2 AND lower(n) NOT IN ({S.quoted(L.ANCHOR_SKIP_WORDS)}))), lambda x: lower(regexp_replace(x, '\s+', ' ', 'g'))) AS anchors FROM k),
j AS (SELECT o.query_id, o.id, o.score AS s, len(list_intersect(q.terms, d.w)) AS overlap, len(list_filter(q.anchors, lambda a: contains(lower(d.text), a) OR contains(lower(coalesce(d.conv, '')), a))) AS anchors FROM o JOIN q ON q.query_id = o.query_id JOIN k d ON d.chunk_id = o.id),
z AS (SELECT query_id, id, overlap, anchors, round(s * (1 + overlap * 0.08) * pow(1.15, anchors), 5) AS score FROM j)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM z QUALIFY place <= 3""",
    "associated_chunks": f"WITH p AS ({EPISODIC_SQL['coretrieval_pairs']}) SELECT a AS chunk_id, b AS peer, times, row_number() OVER (PARTITION BY a ORDER BY times DESC, b) AS place FROM p QUALIFY place <= 5",
    "retrieval_log": f"WITH o AS (SELECT id, count(*) AS hits FROM ({EPISODIC_SQL['own_topk']}) GROUP BY 1), c AS (SELECT chunk_id AS id, coalesce(any_value(access_count), 0) AS a FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1) SELECT id, hits, a + hits AS access_count FROM o JOIN c USING (id)",
    "layer_signals": f"WITH {_F}, {_SIG} SELECT * FROM sg",
    "budget_split": f"""WITH {_F}, {_SIG}, c AS (SELECT chunk_id, any_value(user_id) AS user_id, coalesce(any_value(conversation_id), '') <> '' AS w FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1),
b AS (SELECT sg.*, CASE WHEN EXISTS (SELECT 1 FROM profile_signals p WHERE p.user_id = c.user_id) THEN 500 ELSE 0 END AS explicit, CASE WHEN w THEN 400 ELSE 0 END AS working FROM sg JOIN c ON c.chunk_id = query_id),
z AS (SELECT *, 4000 - 200 - explicit - working AS rest, CASE WHEN episodic + semantic > 0 THEN episodic / (episodic + semantic) ELSE 0.6 END AS share FROM b)
SELECT query_id, CAST(explicit AS BIGINT) AS explicit, CAST(working AS BIGINT) AS working, CAST(trunc(rest * (share * 0.6 + CAST(1.6 AS DOUBLE) / 7)) AS BIGINT) AS episodic, CAST(rest - CAST(trunc(rest * (share * 0.6 + CAST(1.6 AS DOUBLE) / 7)) AS BIGINT) AS BIGINT) AS semantic FROM z""",
    "knowledge_context": rf"""WITH {_F}, sv AS (SELECT user_id, dimension, CAST(round(arg_max(signal, (signal_at, signal)) * 100) AS BIGINT) AS v FROM profile_signals WHERE signal IS NOT NULL AND signal_at IS NOT NULL AND user_id IS NOT NULL AND dimension IS NOT NULL GROUP BY 1, 2),
sk AS (SELECT *, CASE WHEN dimension IN ('depth', 'verbosity') THEN 2 WHEN dimension IN ('formality', 'warmth') THEN 1 ELSE 0 END AS kind FROM sv),
pc AS (SELECT chunk_id, any_value(text) AS text, epoch_us(any_value(timestamp)) AS at_, any_value(user_id) AS user_id, any_value(conversation_id) AS conv FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL AND timestamp IS NOT NULL AND user_id IS NOT NULL AND coalesce(conversation_id, '') <> '' GROUP BY 1),
cv AS (SELECT user_id, conv, max(at_) AS fin, arg_min(substr(text, 1, 60), (at_, chunk_id)) AS head FROM pc GROUP BY 1, 2), cu AS (SELECT user_id, arg_max(conv, (fin, conv)) AS cur FROM cv GROUP BY 1),
l AS (SELECT user_id, 1 AS section, CAST(-kind AS DOUBLE) AS weight, CASE WHEN kind = 2 THEN '- [instruction] ' ELSE '- ' END || dimension || ': ' || CAST(v AS VARCHAR) AS line FROM sk
  UNION ALL SELECT user_id, 2, round(max(confidence), 6), '- ' || subject_key || ' ' || predicate || ' ' || object_key AS line FROM f WHERE status = 'active' AND confidence IS NOT NULL AND subject_key IS NOT NULL AND object_key IS NOT NULL AND user_id IS NOT NULL GROUP BY 1, 4
  UNION ALL SELECT cv.user_id, 3, CAST(fin AS DOUBLE), '- [' || conv || '] ' || head FROM cv JOIN cu ON cu.user_id = cv.user_id AND conv <> cur
  UNION ALL SELECT pc.user_id, 4, {_IMP}, '- ' || substr(text, 1, 60) FROM pc JOIN cu ON cu.user_id = pc.user_id AND conv <> cur WHERE {_IMP} > 0.3
  UNION ALL SELECT user_id, 5, 0.0, '- ' || h FROM (SELECT user_id, concat_ws(', ', CASE WHEN dp > 70 THEN 'prefers detailed technical responses' WHEN dp < 30 THEN 'prefers brief responses' END, CASE WHEN fo > 70 THEN 'formal tone' WHEN fo < 30 THEN 'casual tone' END) AS h
    FROM (SELECT user_id, max(v) FILTER (WHERE dimension = 'depth') AS dp, max(v) FILTER (WHERE dimension = 'formality') AS fo FROM sv GROUP BY 1)) WHERE h <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, section ORDER BY weight DESC, line) AS n FROM l),
w AS (SELECT user_id, section, n, CASE WHEN n = 1 THEN {_HEAD} || chr(10) || line ELSE line END AS line, len({S.words('line')}) + CASE WHEN n = 1 THEN {_HEADW} ELSE 0 END AS words FROM n),
ba AS (SELECT user_id, sum(words) AS base FROM w WHERE section IN (1, 5) GROUP BY 1),
ru AS (SELECT *, sum(words) OVER (PARTITION BY user_id ORDER BY section, n ROWS UNBOUNDED PRECEDING) AS upto FROM w WHERE section NOT IN (1, 5)),
kp AS (SELECT user_id, section, n, line, words FROM ru LEFT JOIN ba USING (user_id) WHERE floor((coalesce(base, 0) + upto) * 4 / 3.0) <= 200 UNION ALL SELECT user_id, section, n, line, words FROM w WHERE section IN (1, 5))
SELECT user_id, md5(string_agg(line, chr(10) ORDER BY section, n)) AS digest, count(*) FILTER (WHERE section = 2) AS facts, count(*) FILTER (WHERE section = 3) AS sessions, count(*) FILTER (WHERE section = 4) AS details, CAST(floor(sum(words) * 4 / 3.0) AS BIGINT) AS tokens FROM kp GROUP BY 1""",
    "working_dump": """WITH c AS (SELECT chunk_id, any_value(text) AS text, any_value(timestamp) AS ts, any_value(conversation_id) AS conversation_id, any_value(speaker) AS speaker FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL AND timestamp IS NOT NULL AND coalesce(conversation_id, '') <> '' GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY ts DESC, chunk_id DESC) AS n, CASE WHEN lower(trim(speaker, ' ')) IN ('user', 'human') THEN 'goal' WHEN lower(trim(speaker, ' ')) IN ('assistant', 'ai', 'bot') THEN 'fact' ELSE 'thread' END AS kind FROM c QUALIFY n <= 10)
SELECT conversation_id, md5(string_agg('[' || kind || '] ' || substr(text, 1, 80), chr(10) ORDER BY n DESC)) AS digest, count(*) FILTER (WHERE kind = 'goal') AS goals, count(*) FILTER (WHERE kind = 'fact') AS facts, count(*) FILTER (WHERE kind = 'thread') AS threads FROM r GROUP BY 1""",
}
