"""Queries of facts and names: contradictions with their outcomes, folded facts, the ladder of resolution, expansion of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import decay as D
from mnemospark.functions import lexicon as L
from mnemospark.functions import text as T
from mnemospark.operators.ranking import ranked
from mnemospark.plans import sqlkit as S
from mnemospark.plans.episodic import number
from mnemospark.plans.knowledge import _DAYS, _F, _P, _norm, facts, fuzzy_resolve, now, people
from mnemospark.session import materialize
from mnemospark.sources.tables import one_per_chunk, table

FACT = ["user_id", "subject_key", "predicate"]
GAP = 0.2


def contradictions_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Contradictions among active facts of exclusive predicates, in order of event time, with their outcomes.

    Facts of one time are set against the most confident of them: a gap in confidence of
    more than 0.2 decides, else the pair stays unresolved. The most confident fact of
    a time is set against that of the time before, which is what is still active then:
    the newer one wins. So each fact is in two pairs at most, however many a subject has.
    """
    f = facts(spark, sf).filter("first_seen is not null and status = 'active' and object_key is not null").filter(F.col("predicate").isin(L.EXCLUSIVE_PREDICATES))
    f = f.select("id", *FACT, "object_key", "first_seen", F.coalesce("confidence", F.lit(0.5)).alias("c"))
    top = materialize(f.groupBy(*FACT, "first_seen").agg(F.max(F.struct("c", (-F.col("id")).alias("neg"), "object_key")).alias("t")), "tops")
    top = top.select(*FACT, "first_seen", (-F.col("t.neg")).alias("top_id"), F.col("t.object_key").alias("top_object"), F.col("t.c").alias("top_c"))
    gap = F.col("top_c") - F.col("c") > GAP
    same_time = f.join(top, [*FACT, "first_seen"]).filter("id <> top_id and object_key <> top_object").select(
        *FACT, F.col("top_id").alias("fact_a"), F.col("id").alias("fact_b"), F.when(gap, "higher_confidence").otherwise("unresolved").alias("resolution"), F.when(gap, F.col("top_id")).alias("winner"), F.col("first_seen").alias("at")
    )
    line = materialize(ranked(top, FACT, ["first_seen"], "n"), "timeline")
    old = line.select(*FACT, (F.col("n") + 1).alias("n"), F.col("top_id").alias("fact_a"), F.col("top_object").alias("old"))
    newer = line.join(old, [*FACT, "n"]).filter("top_object <> old").select(*FACT, "fact_a", F.col("top_id").alias("fact_b"), F.lit("newer_wins").alias("resolution"), F.col("top_id").alias("winner"), F.col("first_seen").alias("at"))
    return same_time.unionByName(newer)


def contradictions_open(spark: SparkSession, sf: str) -> DataFrame:
    """Per subject, how many contradictions it has on either side and how many of them are unresolved."""
    c = contradictions_resolved(spark, sf)
    return c.groupBy("user_id", "subject_key").agg(F.count(F.lit(1)).alias("contradictions"), F.count_if(F.col("winner").isNull()).alias("unresolved"))


def contradictions_last(spark: SparkSession, sf: str) -> DataFrame:
    """The five contradictions of each user that came up last."""
    c = contradictions_resolved(spark, sf)
    r = ranked(c, ["user_id"], [F.col("at").desc(), F.col("fact_b").desc(), F.col("fact_a").desc()], "place").filter("place <= 5")
    return r.select("user_id", "place", "fact_a", "fact_b", "resolution")


def fact_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Facts as edges after all updates: mentions and reinforced confidence, first and last time, sources, and whether a newer object took the place of an exclusive one."""
    f = facts(spark, sf).filter("confidence is not null and first_seen is not null and last_seen is not null and object_key is not null")
    lo, hi = F.least("first_seen", "last_seen"), F.greatest("first_seen", "last_seen")
    e = f.groupBy(*FACT, "object_key").agg(F.count(F.lit(1)).alias("mentions"), F.min(F.struct(lo.alias("a"), "id", "confidence")).alias("first"), F.max(hi).alias("last_seen"), F.max(F.struct(lo.alias("a"), "id")).alias("latest"))
    src = table(spark, sf, "relations").filter("id is not null").select("id", F.explode("source_chunks").alias("chunk")).distinct()
    edge = f.select("id", *FACT, "object_key").join(src, "id").groupBy(*FACT, "object_key").agg(F.count_distinct("chunk").alias("sources"))
    newest = e.groupBy(*FACT).agg(F.max(F.struct("latest", "object_key")).alias("n")).select(*FACT, F.col("n.object_key").alias("newest"))
    j = e.join(newest, FACT)
    for c in FACT:
        edge = edge.withColumnRenamed(c, f"_{c}")
    on = (F.col("object_key") == F.col("_object")) & F.col("user_id").eqNullSafe(F.col("_user_id")) & F.col("subject_key").eqNullSafe(F.col("_subject_key")) & F.col("predicate").eqNullSafe(F.col("_predicate"))
    j = j.join(edge.withColumnRenamed("object_key", "_object"), on, "left")
    gone = F.col("predicate").isin(L.EXCLUSIVE_PREDICATES) & (F.col("object_key") != F.col("newest"))
    c = D.reinforced(F.col("first.confidence"), F.col("mentions") - 1)
    return j.select(
        *FACT, "object_key", "mentions", F.coalesce("sources", F.lit(0)).alias("sources"), F.round(F.when(gone, D.superseded(c)).otherwise(c), 6).alias("confidence"), F.when(gone, "superseded").otherwise("active").alias("status"),
        F.unix_seconds(F.col("first.a").cast("timestamp")).alias("first_at"), F.unix_seconds(F.col("last_seen").cast("timestamp")).alias("last_at"),
    )


def graph_maintenance(spark: SparkSession, sf: str) -> DataFrame:
    """Decay, pruning and removal of orphans in one pass: entities that no fact of enough confidence touches."""
    f = facts(spark, sf).filter("last_seen is not null and confidence is not null")
    left = f.filter(D.decayed(F.col("confidence"), D.days_between(F.col("last_seen"), now())) >= 0.3).filter(~F.col("status").isin("superseded", "retracted"))
    ends = left.select(F.col("subject_key").alias("entity_key")).unionByName(left.select(F.col("object_key").alias("entity_key")))
    return people(spark, sf).select("entity_key").join(ends, "entity_key", "left_anti")


def subject_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of the subjects of the query set, of any status."""
    f = facts(spark, sf).filter(F.regexp_extract("subject_key", r"(\d+)$", 1).try_cast("bigint") % 50 == 0)
    return f.select("subject_key", "id", "predicate", "object_key", "status")


def predicate_map(spark: SparkSession, sf: str) -> DataFrame:
    """Predicates of relations and of sentences brought to one form each, by how often they occur."""
    r = facts(spark, sf).select("predicate")
    said = F.regexp_extract_all(F.lower("text"), F.lit(r"(?:^|[^a-z])((?:works|working|employed|based|member|built|likes|quit|using|leading|managing) (?:on|at|by|in|of|the))(?:$|[^a-z])"), 1)
    t = one_per_chunk(table(spark, sf, "chunks").filter("text is not null"), "text").select(F.explode(said).alias("said")).select(T.predicate_form(F.col("said")).alias("predicate"))
    form = F.col("predicate")
    for a, b in L.PREDICATE_FORMS.items():
        form = F.when(F.col("predicate") == a, b).otherwise(form)
    return r.unionByName(t).groupBy("predicate", form.alias("form")).agg(F.count(F.lit(1)).alias("times"))


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    c = one_per_chunk(table(spark, sf, "chunks"), "entity_mentions", "user_id")
    m = c.select("user_id", F.explode("entity_mentions").alias("mention")).filter("mention is not null and user_id is not null")
    return m.distinct().withColumn("name", T.normalize_name(F.col("mention"))).withColumn("key", F.lower("name"))


def resolve_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions of each user resolved against the directory of all entities, whose keys are unique over users: by name, by alias, as an acronym, as a word of a name of several; the first that hits, the least key of several."""
    m = _mentions(spark, sf)
    p = people(spark, sf).withColumn("bare", F.regexp_replace(T.normalize_name(F.col("name")), r" \d+$", ""))
    words = F.filter(F.split("bare", " "), lambda w: w != "")
    best = lambda rows, how: rows.filter("key is not null and key <> ''").groupBy("key").agg(F.min("entity_key").alias(how))
    names = best(p.select(F.lower("bare").alias("key"), "entity_key"), "exact")
    aliases = best(p.select(F.explode("aliases").alias("a"), "entity_key").select(F.lower(T.normalize_name(F.col("a"))).alias("key"), "entity_key"), "alias")
    several = p.filter(F.size(words) > 1)
    acronyms = best(several.select(F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")).alias("key"), "entity_key"), "acronym").withColumnRenamed("key", "short")
    parts = best(several.select(F.explode(F.transform(words, F.lower)).alias("key"), "entity_key"), "word")
    short = F.when((F.length("name") <= 5) & (F.col("name") == F.upper("name")) & (F.col("name") != F.lower("name")), F.col("name"))
    r = m.withColumn("short", short).join(names, "key", "left").join(aliases, "key", "left").join(acronyms, "short", "left").join(parts, "key", "left")
    rungs = ("exact", "alias", "acronym", "word")
    how = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in rungs], F.lit("none"))
    return r.select("user_id", "mention", F.coalesce(*rungs).alias("entity_key"), how.alias("how"))


def learned_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions that a rule or the fuzzy comparison resolved, as aliases to be known from now on."""
    rule = resolve_ladder(spark, sf).filter(F.col("how").isin("acronym", "word")).select("user_id", "entity_key", F.lower(T.normalize_name(F.col("mention"))).alias("alias"))
    return rule.unionByName(fuzzy_resolve(spark, sf).select("user_id", "entity_key", F.col("mention").alias("alias"))).distinct()


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, user_id, entity_key) of the entities that the messages of the query set name."""
    c = one_per_chunk(table(spark, sf, "chunks").filter(number("chunk_id") % 50 == 0), "entity_mentions", "user_id")
    m = c.select(F.col("chunk_id").alias("query_id"), "user_id", F.explode("entity_mentions").alias("mention")).distinct()
    known = resolve_ladder(spark, sf).filter("entity_key is not null").select("user_id", "mention", "entity_key")
    return m.join(known, ["user_id", "mention"]).select("query_id", "user_id", "entity_key").distinct()


def expanded_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Per query up to three entities beside those it names, from the five strongest live facts that touch one of them."""
    q = materialize(_asked(spark, sf), "asked")
    f = facts(spark, sf).filter(~F.col("status").isin("superseded", "retracted")).filter("confidence is not null and subject_key is not null and object_key is not null").select("id", "subject_key", "object_key", "confidence")
    touch = f.select(F.col("subject_key").alias("entity_key"), "id", "subject_key", "object_key", "confidence").unionByName(f.select(F.col("object_key").alias("entity_key"), "id", "subject_key", "object_key", "confidence"))
    hit = q.join(touch, "entity_key").select("query_id", "id", "subject_key", "object_key", "confidence").distinct()
    five = ranked(hit, ["query_id"], [F.col("confidence").desc(), F.col("id").asc()], "n").filter("n <= 5")
    ends = five.select("query_id", F.explode(F.array("subject_key", "object_key")).alias("entity_key"), "confidence").groupBy("query_id", "entity_key").agg(F.max("confidence").alias("confidence"))
    new = ends.join(q.select("query_id", "entity_key"), ["query_id", "entity_key"], "left_anti")
    return ranked(new, ["query_id"], [F.col("confidence").desc(), F.col("entity_key").asc()], "place").filter("place <= 3").select("query_id", "entity_key", "place")


def expansion_unseen(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that an expanded entity brings to a query: the three newest of the user that mention it by name, without the query itself and those that mention an entity of the query."""
    q, x = materialize(_asked(spark, sf), "asked"), expanded_entities(spark, sf)
    known = materialize(resolve_ladder(spark, sf).filter("entity_key is not null").select("user_id", "mention", "entity_key"), "known")
    c = one_per_chunk(table(spark, sf, "chunks").filter("timestamp is not null"), "entity_mentions", "user_id", "timestamp")
    names = materialize(c.select("chunk_id", "user_id", "timestamp", F.explode("entity_mentions").alias("mention")).join(known, ["user_id", "mention"]).select("chunk_id", "user_id", "timestamp", "entity_key").distinct(), "names")
    seen = q.join(names, ["user_id", "entity_key"]).select("query_id", "chunk_id").distinct()
    users = q.select("query_id", "user_id").distinct()
    got = x.join(users, "query_id").join(names, ["user_id", "entity_key"]).filter("chunk_id <> query_id").join(seen, ["query_id", "chunk_id"], "left_anti")
    three = ranked(got, ["query_id", "entity_key"], [F.col("timestamp").desc(), F.col("chunk_id").asc()], "n").filter("n <= 3")
    return three.groupBy("query_id", "chunk_id").agg(F.min("place").alias("place"))


def relation_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of entities that three texts at least mention together become relations; confidence grows by 0.02 a text."""
    c = one_per_chunk(table(spark, sf, "chunks"), "entity_mentions")
    names = F.array_sort(F.array_distinct(F.filter(F.transform("entity_mentions", lambda x: F.lower(x)), lambda x: x.isNotNull())))
    n = c.select("chunk_id", names.alias("e")).filter("size(e) between 2 and 50")  # a text names a few entities; lists over 50 are no mentions
    pairs = n.select(F.explode(F.flatten(F.transform("e", lambda x, i: F.transform(F.slice("e", i + 2, F.size("e")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    g = pairs.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("texts")).filter("texts >= 3")
    return g.select(F.initcap("a").alias("a"), F.initcap("b").alias("b"), "texts", F.round(F.least(F.lit(1.0), F.lit(0.85) + F.col("texts") * 0.02), 6).alias("confidence"))


QUERIES = {
    "contradictions_resolved": contradictions_resolved, "contradictions_open": contradictions_open, "contradictions_last": contradictions_last, "fact_fold": fact_fold, "graph_maintenance": graph_maintenance, "subject_facts": subject_facts,
    "predicate_map": predicate_map, "resolve_ladder": resolve_ladder, "learned_aliases": learned_aliases, "expanded_entities": expanded_entities, "expansion_unseen": expansion_unseen, "relation_counts": relation_counts,
}

_C = f"""{_F}, g AS (SELECT id, user_id, subject_key, predicate, object_key, first_seen, coalesce(confidence, 0.5) AS c FROM f WHERE first_seen IS NOT NULL AND status = 'active' AND object_key IS NOT NULL AND predicate IN ({S.quoted(L.EXCLUSIVE_PREDICATES)})),
w AS (SELECT *, first_value(id) OVER k AS top_id, first_value(object_key) OVER k AS top_object, first_value(c) OVER k AS top_c FROM g WINDOW k AS (PARTITION BY user_id, subject_key, predicate, first_seen ORDER BY c DESC, id)),
tl AS (SELECT *, lag(id) OVER k AS old_id, lag(object_key) OVER k AS old_object FROM w WHERE id = top_id WINDOW k AS (PARTITION BY user_id, subject_key, predicate ORDER BY first_seen)),
r AS (SELECT user_id, subject_key, predicate, top_id AS fact_a, id AS fact_b, CASE WHEN top_c - c > {GAP} THEN 'higher_confidence' ELSE 'unresolved' END AS resolution, CASE WHEN top_c - c > {GAP} THEN top_id END AS winner, first_seen AS at FROM w WHERE id <> top_id AND object_key <> top_object
  UNION ALL SELECT user_id, subject_key, predicate, old_id, id, 'newer_wins', id, first_seen FROM tl WHERE object_key <> old_object)"""
_BARE = f"regexp_replace({_norm('name')}, ' [0-9]+$', '')"
_RES = f"""{_P}, b AS (SELECT *, {_BARE} AS bare FROM p), bw AS (SELECT *, list_filter(string_split(bare, ' '), lambda w: w <> '') AS w FROM b),
c AS (SELECT chunk_id, any_value(entity_mentions) AS m, any_value(user_id) AS user_id, any_value(timestamp) AS ts FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1),
x AS (SELECT DISTINCT user_id, mention, {_norm('mention')} AS nm FROM (SELECT user_id, unnest(m) AS mention FROM c) WHERE mention IS NOT NULL AND user_id IS NOT NULL),
n1 AS (SELECT lower(bare) AS key, min(entity_key) AS e FROM b WHERE bare <> '' GROUP BY 1),
n2 AS (SELECT lower({_norm('a')}) AS key, min(entity_key) AS e FROM (SELECT entity_key, unnest(aliases) AS a FROM b) WHERE a IS NOT NULL GROUP BY 1),
n3 AS (SELECT upper(array_to_string(list_transform(w, lambda z: z[1:1]), '')) AS key, min(entity_key) AS e FROM bw WHERE len(w) > 1 GROUP BY 1),
n4 AS (SELECT lower(z) AS key, min(entity_key) AS e FROM (SELECT entity_key, unnest(w) AS z FROM bw WHERE len(w) > 1) GROUP BY 1),
res AS (SELECT x.user_id, x.mention, x.nm, coalesce(n1.e, n2.e, n3.e, n4.e) AS entity_key, CASE WHEN n1.e IS NOT NULL THEN 'exact' WHEN n2.e IS NOT NULL THEN 'alias' WHEN n3.e IS NOT NULL THEN 'acronym' WHEN n4.e IS NOT NULL THEN 'word' ELSE 'none' END AS how
  FROM x LEFT JOIN n1 ON n1.key = lower(nm) LEFT JOIN n2 ON n2.key = lower(nm)
  LEFT JOIN n3 ON n3.key = nm AND length(nm) <= 5 AND nm = upper(nm) AND nm <> lower(nm) LEFT JOIN n4 ON n4.key = lower(nm))"""
_ASKED = """q AS (SELECT DISTINCT z.chunk_id AS query_id, z.user_id, res.entity_key FROM (SELECT chunk_id, user_id, unnest(m) AS mention FROM c WHERE CAST(regexp_extract(chunk_id, '([0-9]+)$', 1) AS BIGINT) % 50 = 0) z
  JOIN res ON res.user_id = z.user_id AND res.mention = z.mention WHERE res.entity_key IS NOT NULL)"""
_EXP = f"""{_F}, {_RES}, {_ASKED},
lf AS (SELECT id, subject_key, object_key, confidence FROM f WHERE status NOT IN ('superseded', 'retracted') AND confidence IS NOT NULL AND subject_key IS NOT NULL AND object_key IS NOT NULL),
h AS (SELECT DISTINCT query_id, id, subject_key, object_key, confidence FROM q JOIN lf ON lf.subject_key = q.entity_key OR lf.object_key = q.entity_key),
h5 AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, id) <= 5),
en AS (SELECT query_id, e AS entity_key, max(confidence) AS c FROM (SELECT query_id, subject_key AS e, confidence FROM h5 UNION ALL SELECT query_id, object_key, confidence FROM h5) GROUP BY 1, 2),
ex AS (SELECT query_id, entity_key, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, entity_key) AS place FROM en WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.query_id = en.query_id AND q.entity_key = en.entity_key) QUALIFY place <= 3)"""

ORACLE = {
    "contradictions_resolved": f"WITH {_C} SELECT * FROM r",
    "contradictions_open": f"WITH {_C} SELECT user_id, subject_key, count(*) AS contradictions, count(*) FILTER (WHERE winner IS NULL) AS unresolved FROM r GROUP BY 1, 2",
    "contradictions_last": f'WITH {_C} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY "at" DESC, fact_b DESC, fact_a DESC) AS place, fact_a, fact_b, resolution FROM r QUALIFY place <= 5',
    "fact_fold": f"""WITH {_F}, g AS (SELECT *, least(first_seen, last_seen) AS lo, greatest(first_seen, last_seen) AS hi FROM f WHERE confidence IS NOT NULL AND first_seen IS NOT NULL AND last_seen IS NOT NULL AND object_key IS NOT NULL),
s AS (SELECT id, unnest(source_chunks) AS chunk FROM (SELECT DISTINCT ON (id) id, source_chunks FROM relations WHERE id IS NOT NULL ORDER BY id)),
e AS (SELECT user_id, subject_key, predicate, object_key, count(*) AS mentions, arg_min(confidence, (lo, id)) AS c0, min(lo) AS first_at, max(hi) AS last_at, max((lo, id)) AS latest FROM g GROUP BY 1, 2, 3, 4),
src AS (SELECT user_id, subject_key, predicate, object_key, count(DISTINCT chunk) AS sources FROM g JOIN s USING (id) GROUP BY 1, 2, 3, 4),
n AS (SELECT *, first_value(object_key) OVER (PARTITION BY user_id, subject_key, predicate ORDER BY latest DESC, object_key DESC) AS newest FROM e),
z AS (SELECT n.*, coalesce(src.sources, 0) AS sources, least(1.0, 1 - (1 - c0) * pow(0.8, mentions - 1)) AS c, n.predicate IN ({S.quoted(L.EXCLUSIVE_PREDICATES)}) AND n.object_key <> newest AS gone
  FROM n LEFT JOIN src ON src.object_key = n.object_key AND src.user_id IS NOT DISTINCT FROM n.user_id AND src.subject_key IS NOT DISTINCT FROM n.subject_key AND src.predicate IS NOT DISTINCT FROM n.predicate)
SELECT user_id, subject_key, predicate, object_key, mentions, sources, round(CASE WHEN gone THEN greatest(0.01, c * 0.3) ELSE c END, 6) AS confidence, CASE WHEN gone THEN 'superseded' ELSE 'active' END AS status,
  CAST(floor(epoch(first_at)) AS BIGINT) AS first_at, CAST(floor(epoch(last_at)) AS BIGINT) AS last_at FROM z""",
    "graph_maintenance": f"""WITH {_F}, {_P}, k AS (SELECT subject_key, object_key FROM f WHERE last_seen IS NOT NULL AND confidence * exp(-0.005 * {_DAYS}) >= 0.3 AND status NOT IN ('superseded', 'retracted'))
SELECT entity_key FROM p WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.subject_key = p.entity_key OR k.object_key = p.entity_key)""",
    "subject_facts": f"WITH {_F} SELECT subject_key, id, predicate, object_key, status FROM f WHERE TRY_CAST(nullif(regexp_extract(subject_key, '([0-9]+)$', 1), '') AS BIGINT) % 50 = 0",
    "predicate_map": f"""WITH {_F}, {S.TEXTS}, s AS (SELECT unnest(regexp_extract_all(lower(text), '(?:^|[^a-z])((?:works|working|employed|based|member|built|likes|quit|using|leading|managing) (?:on|at|by|in|of|the))(?:$|[^a-z])', 1)) AS p FROM t),
a AS (SELECT predicate FROM f UNION ALL SELECT replace(p, ' ', '_') FROM s)
SELECT predicate, CASE predicate {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in L.PREDICATE_FORMS.items())} ELSE predicate END AS form, count(*) AS times FROM a GROUP BY 1, 2""",
    "resolve_ladder": f"WITH {_RES} SELECT user_id, mention, entity_key, how FROM res",
    "expanded_entities": f"WITH {_EXP} SELECT query_id, entity_key, place FROM ex",
    "expansion_unseen": f"""WITH {_EXP}, nm AS (SELECT DISTINCT z.chunk_id, z.user_id, z.ts, res.entity_key FROM (SELECT chunk_id, user_id, ts, unnest(m) AS mention FROM c WHERE ts IS NOT NULL) z JOIN res ON res.user_id = z.user_id AND res.mention = z.mention WHERE res.entity_key IS NOT NULL),
sn AS (SELECT DISTINCT q.query_id, nm.chunk_id FROM q JOIN nm ON nm.user_id = q.user_id AND nm.entity_key = q.entity_key), us AS (SELECT DISTINCT query_id, user_id FROM q),
gt AS (SELECT ex.query_id, ex.entity_key, ex.place, nm.chunk_id, nm.ts FROM ex JOIN us ON us.query_id = ex.query_id JOIN nm ON nm.user_id = us.user_id AND nm.entity_key = ex.entity_key
  WHERE nm.chunk_id <> ex.query_id AND NOT EXISTS (SELECT 1 FROM sn WHERE sn.query_id = ex.query_id AND sn.chunk_id = nm.chunk_id)
  QUALIFY row_number() OVER (PARTITION BY ex.query_id, ex.entity_key ORDER BY nm.ts DESC, nm.chunk_id) <= 3)
SELECT query_id, chunk_id, min(place) AS place FROM gt GROUP BY 1, 2""",
    "relation_counts": """WITH c AS (SELECT chunk_id, list_sort(list_distinct(list_transform(any_value(entity_mentions), lambda x: lower(x)))) AS e FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1), u AS (SELECT chunk_id, unnest(e) AS n FROM c WHERE len(e) BETWEEN 2 AND 50),
p AS (SELECT a.n AS a, b.n AS b, count(*) AS texts FROM u a JOIN u b ON a.chunk_id = b.chunk_id AND a.n < b.n GROUP BY 1, 2)
SELECT array_to_string(list_transform(string_split(a, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS a, array_to_string(list_transform(string_split(b, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS b, texts, CAST(round(least(1.0, 0.85 + texts * 0.02), 6) AS DOUBLE) AS confidence FROM p WHERE texts >= 3""",
}
