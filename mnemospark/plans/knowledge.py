"""Queries of the semantic layer: facts, contradictions, decay, graph, entities, resolution."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import decay as D
from mnemospark.functions import lexicon as L
from mnemospark.functions import text as T
from mnemospark.operators import graph as G
from mnemospark.operators.ranking import ranked
from mnemospark.plans import sqlkit as S
from mnemospark.plans.episodic import NOW, texts
from mnemospark.session import materialize
from mnemospark.sources.tables import one_per_chunk, table


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Relation updates, each id once, with one spelling of predicate and status."""
    r = table(spark, sf, "relations").filter("id is not null")
    cols = ["user_id", "subject_key", "object_key", "confidence", "first_seen", "last_seen", "mention_count", "source_chunks"]
    r = r.select("id", *cols, T.predicate_form(F.col("predicate")).alias("predicate"), T.status_form(F.col("status")).alias("status"))
    one = r.groupBy("id").agg(F.min(F.struct("user_id", "subject_key", "object_key", "predicate", "status", "confidence", "first_seen", "last_seen", "mention_count")).alias("r"))
    return one.select("id", "r.*")


def people(spark: SparkSession, sf: str) -> DataFrame:
    """Entities, each key once: the row seen last stands."""
    e = table(spark, sf, "entities").filter("entity_key is not null")
    best = F.max(F.struct("last_seen", "mention_count", "name", "entity_type", "attributes", "aliases", "user_id"))
    return e.groupBy("entity_key").agg(best.alias("r")).select("entity_key", "r.*")


def now():
    return F.lit(NOW).cast("timestamp")


def fact_decay(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf).filter("last_seen is not null and confidence is not null")
    c = D.decayed(F.col("confidence"), D.days_between(F.col("last_seen"), now()))
    return f.filter(c >= 0.05).select("id", F.round(c, 4).alias("confidence"))


def adaptive_decay(spark: SparkSession, sf: str) -> DataFrame:
    """Rates by predicate, else by the types of the ends. Joins on entity keys, which are unique."""
    f = facts(spark, sf).filter("last_seen is not null and confidence is not null")
    kind = people(spark, sf).select("entity_key", F.lower("entity_type").alias("kind"))
    s, o = kind.select(F.col("entity_key").alias("subject_key"), F.col("kind").alias("s_kind")), kind.select(F.col("entity_key").alias("object_key"), F.col("kind").alias("o_kind"))
    f = f.join(s, "subject_key", "left").join(o, "object_key", "left").withColumn("tier", D.decay_tier(F.col("predicate"), F.col("s_kind"), F.col("o_kind")))
    c = D.decayed(F.col("confidence"), D.days_between(F.col("last_seen"), now()), D.tier_rate(F.col("tier")))
    return f.select("id", "tier", F.round(c, 6).alias("confidence"), (c < 0.05).alias("pruned"))


def reinforce_fold(spark: SparkSession, sf: str) -> DataFrame:
    """A fact that is mentioned again gains 0.2 of what it lacks; in closed form from the first mention's confidence."""
    f = facts(spark, sf).filter("confidence is not null and first_seen is not null")
    g = f.groupBy("user_id", "subject_key", "predicate", "object_key").agg(F.count(F.lit(1)).alias("mentions"), F.min(F.struct("first_seen", "id", "confidence")).alias("r"))
    return g.select("user_id", "subject_key", "predicate", "object_key", "mentions", F.round(D.reinforced(F.col("r.confidence"), F.col("mentions") - 1), 6).alias("confidence"))


def _chains(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf).filter("first_seen is not null and status = 'active'").filter(F.col("predicate").isin(L.EXCLUSIVE_PREDICATES))
    return materialize(ranked(f, ["user_id", "subject_key", "predicate"], ["first_seen", "id"], "n"), "chain")


def contradictions_direct(spark: SparkSession, sf: str) -> DataFrame:
    """An active fact of an exclusive predicate against the one before it with another object: the newer one wins, and the loser keeps 0.3 of its confidence."""
    c = _chains(spark, sf)
    old = c.select("user_id", "subject_key", "predicate", (F.col("n") + 1).alias("n"), F.col("id").alias("loser"), F.col("object_key").alias("old_object"), F.col("confidence").alias("old"))
    j = c.join(old, ["user_id", "subject_key", "predicate", "n"]).filter("object_key <> old_object")
    return j.select(F.col("id").alias("winner"), "loser", "predicate", F.lit("direct").alias("kind"), F.round(D.superseded(F.col("old")), 6).alias("loser_confidence"))


EVENT_FACTS = {"signup": "works_at", "error": "left", "click": "uses", "view": "stopped_using", "purchase": "leads"}


def _stated(spark: SparkSession, sf: str) -> DataFrame:
    """(source, id, holder, predicate, at): active facts by user and subject, and events as facts of their user."""
    f = facts(spark, sf).filter("first_seen is not null and status = 'active'")
    f = f.select(F.lit("fact").alias("source"), "id", F.concat_ws("/", "user_id", "subject_key").alias("holder"), "predicate", F.unix_micros(F.col("first_seen").cast("timestamp")).alias("at"))
    kind = F.create_map(*[F.lit(x) for pair in EVENT_FACTS.items() for x in pair])
    e = table(spark, sf, "events").filter("ts is not null")
    e = e.select(F.lit("event").alias("source"), F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("holder"), F.element_at(kind, F.col("event_type")).alias("predicate"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return f.unionByName(e)


def contradictions_negation(spark: SparkSession, sf: str) -> DataFrame:
    """Facts and events whose predicate negates another, through all five pairs, each against the last one before it that it negates, whatever the object: the newer one wins.

    The state before is the number of negated facts so far: a running sum finds it
    without pairing.
    """
    positive = F.create_map(*[F.lit(x) for p, n in L.NEGATIONS.items() for x in (n, p)])
    s = _stated(spark, sf).withColumn("base", F.coalesce(F.element_at(positive, F.col("predicate")), F.when(F.col("predicate").isin(list(L.NEGATIONS)), F.col("predicate"))))
    s = s.filter("base is not null").withColumn("one", F.when(F.col("predicate") == F.col("base"), 1).otherwise(0))
    r = materialize(ranked(s, ["source", "holder", "base"], ["at", "id"], "seen", value="one"), "negation")
    held = r.filter("one = 1").select("source", "holder", "base", "seen", F.col("id").alias("negated"))
    return r.filter("one = 0").join(held, ["source", "holder", "base", "seen"]).select("source", F.col("id").alias("negation"), "negated", "base")


def facts_negated(spark: SparkSession, sf: str) -> DataFrame:
    """Active facts whose predicate negates another, against every earlier active fact of that predicate and subject, whatever the object: the newer one wins."""
    f = facts(spark, sf).filter("first_seen is not null and status = 'active'").withColumn("at", F.struct("first_seen", "id"))
    positive = F.element_at(F.create_map(*[F.lit(x) for p, n in L.NEGATIONS.items() for x in (n, p)]), F.col("predicate"))
    new = f.withColumn("predicate", positive).filter("predicate is not null").select("user_id", "subject_key", "predicate", F.col("id").alias("winner"), F.col("at").alias("new_at"))
    old = f.filter(F.col("predicate").isin(list(L.NEGATIONS))).select("user_id", "subject_key", "predicate", F.col("id").alias("loser"), "at")
    return old.join(new, ["user_id", "subject_key", "predicate"]).filter("at < new_at").select("winner", "loser", "predicate", F.lit("negation").alias("kind"))


def fact_current_state(spark: SparkSession, sf: str) -> DataFrame:
    """The update of each fact that took effect last, unless it superseded or retracted the fact; retracted facts have no confidence."""
    f = facts(spark, sf).filter("first_seen is not null and last_seen is not null")
    ended = F.col("status").isin("superseded", "retracted")
    at = F.when(ended, F.greatest("first_seen", "last_seen")).otherwise(F.least("first_seen", "last_seen"))
    best = F.max(F.struct(at.alias("at"), "id", "object_key", "status", "confidence"))
    s = f.groupBy("user_id", "subject_key", "predicate").agg(best.alias("r")).select("user_id", "subject_key", "predicate", "r.object_key", "r.status", "r.confidence")
    return s.filter(~F.col("status").isin("superseded", "retracted"))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).filter(~F.col("status").isin("superseded", "retracted")).select("subject_key", "object_key", "predicate", "confidence", "mention_count").filter("subject_key is not null and object_key is not null")


def graph_bfs2(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes within two hops of every entity whose number is divisible by 50."""
    seeds = people(spark, sf).filter(F.regexp_extract("entity_key", r"(\d+)$", 1).try_cast("bigint") % 50 == 0).select(F.col("entity_key").alias("seed"))
    return G.expand(seeds, _edges(spark, sf), "subject_key", "object_key", 2)


def graph_components(spark: SparkSession, sf: str) -> DataFrame:
    return G.components(_edges(spark, sf), "subject_key", "object_key")


def _merges(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of one first word and type become the one of least key."""
    e = people(spark, sf).select("entity_key", F.coalesce(F.lower("entity_type"), F.lit("?")).alias("k"), F.lower(F.split(T.normalize_name(F.col("name")), " ")[0]).alias("w"))
    return materialize(e.groupBy("k", "w").agg(F.min("entity_key").alias("new")).join(e, ["k", "w"]).filter("new <> entity_key").select(F.col("entity_key").alias("old"), "new"), "merges")


def entity_merge(spark: SparkSession, sf: str) -> DataFrame:
    e = _edges(spark, sf).withColumn("mentions", F.coalesce("mention_count", F.lit(0)).cast("bigint"))
    return G.merge_nodes(e, _merges(spark, sf), "subject_key", "object_key", ["predicate"], "mentions")


def alias_union(spark: SparkSession, sf: str) -> DataFrame:
    """The aliases of merged entities together, with the names of those merged away."""
    p, m = people(spark, sf), _merges(spark, sf)
    a = p.join(m, F.col("entity_key") == F.col("old"), "left").select(F.coalesce("new", "entity_key").alias("entity_key"), F.explode(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name"))).alias("alias"))
    return a.filter("alias is not null").groupBy("entity_key").agg(F.array_join(F.array_sort(F.collect_set("alias")), "|").alias("aliases"))


def orphan_prune(spark: SparkSession, sf: str) -> DataFrame:
    """Entities that no live edge touches."""
    e = _edges(spark, sf)
    ends = e.select(F.col("subject_key").alias("entity_key")).unionByName(e.select(F.col("object_key").alias("entity_key")))
    return people(spark, sf).select("entity_key").join(ends, "entity_key", "left_anti")


def endpoint_completion(spark: SparkSession, sf: str) -> DataFrame:
    """Ends of edges that aren't entities yet come in as concepts."""
    e = _edges(spark, sf)
    ends = e.select(F.col("subject_key").alias("entity_key")).unionByName(e.select(F.col("object_key").alias("entity_key"))).distinct()
    known = people(spark, sf).select("entity_key")
    return ends.join(known, "entity_key", "left_anti").withColumn("entity_type", F.lit("concept"))


def entity_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Entities in texts: proper nouns and known tools, with how often and in how many chunks."""
    t = texts(spark, sf)
    nouns = t.select("chunk_id", F.explode(T.proper_nouns(F.col("text"))).alias("n")).filter(~F.col("n").isin(L.ENTITY_STOP_WORDS) & (F.length("n") >= 2))
    found = nouns.select("chunk_id", F.lower(F.regexp_replace("n", r"\s+", " ")).alias("key"), F.when(F.col("n").contains(" "), "concept").otherwise("person").alias("kind"))
    tools = t.select("chunk_id", F.explode(F.filter(T.tokens(F.col("text")), lambda w: w.isin(L.TOOL_WORDS))).alias("key")).withColumn("kind", F.lit("tool"))
    g = found.unionByName(tools).groupBy("key").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("chunk_id").alias("chunks"), F.max("kind").alias("kind"))
    return g


def consolidation_promote(spark: SparkSession, sf: str) -> DataFrame:
    """Names in entity_mentions of three chunks at least become entities; confidence grows by 0.02 a mention."""
    c = one_per_chunk(table(spark, sf, "chunks"), "entity_mentions")
    g = c.select("chunk_id", F.explode(F.array_distinct("entity_mentions")).alias("name")).filter("name is not null").groupBy(F.lower("name").alias("name")).agg(F.count_distinct("chunk_id").alias("mentions"))
    return g.filter("mentions >= 3").select("name", "mentions", F.round(F.least(F.lit(1.0), F.lit(0.85) + F.col("mentions") * 0.02), 6).alias("confidence"))


def entity_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return people(spark, sf).select("entity_key", T.normalize_name(F.col("name")).alias("name"), F.lower(T.normalize_name(F.col("name"))).alias("canonical"))


def alias_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct mentions in chunks resolved by name, else by alias; of several entities the least key."""
    c = one_per_chunk(table(spark, sf, "chunks"), "entity_mentions")
    m = c.select(F.explode("entity_mentions").alias("mention")).filter("mention is not null").distinct().withColumn("key", F.lower(T.normalize_name(F.col("mention"))))
    p = people(spark, sf)
    bare = F.lower(F.regexp_replace(T.normalize_name(F.col("name")), r" \d+$", ""))
    names = p.select(bare.alias("key"), "entity_key").groupBy("key").agg(F.min("entity_key").alias("by_name"))
    aliases = p.select(F.explode("aliases").alias("a"), "entity_key").select(F.lower(T.normalize_name(F.col("a"))).alias("key"), "entity_key").groupBy("key").agg(F.min("entity_key").alias("by_alias"))
    r = m.join(names, "key", "left").join(aliases, "key", "left")
    how = F.when(F.col("by_name").isNotNull(), "exact").when(F.col("by_alias").isNotNull(), "alias").otherwise("none")
    return r.select("mention", F.coalesce("by_name", "by_alias").alias("entity_key"), how.alias("how"))


def acronym_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """The acronym of every name of several words, and the first entity that has it."""
    p = people(spark, sf).select("entity_key", F.filter(F.split(F.regexp_replace(T.normalize_name(F.col("name")), r" \d+$", ""), " "), lambda w: w != "").alias("w"))
    a = p.filter(F.size("w") > 1).select("entity_key", F.upper(F.array_join(F.transform("w", lambda x: F.substring(x, 1, 1)), "")).alias("acronym"))
    return a.filter(F.length("acronym") <= 5).groupBy("acronym").agg(F.min("entity_key").alias("entity_key"), F.count(F.lit(1)).alias("candidates"))


def _ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)])


FUZZY = 0.8  # the bounds of _grams and fuzzy_resolve are worked out for this ratio


def _grams(s):
    """Pairs of characters of a text with both ends marked, each numbered by how often it came before: L + 1 different values."""
    padded = F.concat(F.lit("\u0001"), s, F.lit("\u0002"))
    plain = F.transform(F.sequence(F.lit(1), F.length(s) + 1), lambda i: F.substring(padded, i, F.lit(2)))
    return F.transform(plain, lambda g, i: F.concat(g, F.size(F.filter(F.slice(plain, 1, i + 1), lambda x: x == g)).cast("string")))


def fuzzy_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions that no name equals against all names and aliases of their user; the best ratio of 0.8 at least, of equal ones the greatest key.

    No pair of that ratio is missed. With M of S = a + b characters matched in order, M >= 0.4 S,
    so lengths differ by a half at most; a deletion breaks two grams of a and an insertion one,
    which leaves 3 M - S + 1 shared grams at least, and a / 3 + 1 whatever b is. Texts that share
    so many have one in common among the rarest a + 1 - ceil(a / 3) of each, in one order of all
    grams. A pair is taken at its first common gram only. Containment is bounded alike.
    """
    c = one_per_chunk(table(spark, sf, "chunks"), "entity_mentions", "user_id")
    m = c.select("user_id", F.explode("entity_mentions").alias("mention")).filter("mention is not null").select("user_id", F.lower(T.normalize_name(F.col("mention"))).alias("key")).distinct()
    p = people(spark, sf)
    bare = lambda c: F.lower(F.regexp_replace(T.normalize_name(F.col(c)), r" \d+$", ""))
    m = m.join(p.select("user_id", bare("name").alias("key")).distinct(), ["user_id", "key"], "left_anti")
    said = p.select("user_id", "entity_key", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("said"))
    names = said.select("user_id", "entity_key", bare("said").alias("name")).filter("name <> ''").groupBy("user_id", "name").agg(F.max("entity_key").alias("entity_key"))
    names = materialize(names.withColumn("grams", _grams(F.col("name"))), "names")
    rare = names.select("user_id", F.explode("grams").alias("g")).groupBy("user_id", "g").agg(F.count(F.lit(1)).alias("df"))

    def in_order(rows: DataFrame, text: str, *more: str) -> DataFrame:
        g = rows.select("user_id", text, *more, F.explode("grams").alias("g")).join(rare, ["user_id", "g"], "left")
        o = g.groupBy("user_id", text, *more).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g"))).alias("o"))
        o = o.select("user_id", text, *more, F.col("o.g").alias(f"{text}_all"))
        first = F.length(text) + 1 - F.ceil(F.length(text) / 3).cast("int")
        return o.withColumn(f"{text}_first", F.slice(f"{text}_all", 1, first)).withColumn("g", F.explode(f"{text}_first"))

    asked = in_order(materialize(m.filter("key <> ''").withColumn("grams", _grams(F.col("key"))), "asked"), "key")
    a, b = F.length("key"), F.length("name")
    shared = 3 * F.floor((2 * (a + b) + 4) / 5) - (a + b) + 1
    near = (3 * F.least(a, b) >= 2 * F.greatest(a, b)) & (F.get(F.array_intersect("key_first", "name_first"), F.lit(0)) == F.col("g")) & (F.size(F.array_intersect("key_all", "name_all")) >= shared)
    pairs = asked.join(in_order(names, "name", "entity_key"), ["user_id", "g"]).filter(near).select("user_id", "key", "entity_key", "name")
    ratio = F.pandas_udf(_ratio, "double")
    inside = F.col("name").contains(F.col("key")) | F.col("key").contains(F.col("name"))
    score = F.when(F.col("key") == F.col("name"), 1.0).when(inside, 0.95 * F.least(a, b) / F.greatest(a, b)).otherwise(ratio("key", "name"))
    best = pairs.withColumn("score", score).filter(F.col("score") >= FUZZY).groupBy("user_id", "key").agg(F.max(F.struct("score", "entity_key")).alias("r"))
    return best.select("user_id", F.col("key").alias("mention"), "r.entity_key", F.round("r.score", 6).alias("score"))


def attribute_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Attributes of an entity over its repeated rows, later ones over earlier ones, by key."""
    e = table(spark, sf, "entities").filter("attributes is not null and entity_key is not null")
    kv = e.select("entity_key", "last_seen", F.explode(F.from_json("attributes", "map<string,string>")).alias("k", "v"))
    return kv.groupBy("entity_key", "k").agg(F.max(F.struct("last_seen", "v")).alias("r")).select("entity_key", "k", F.col("r.v").alias("v"))


def relation_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences that say who prefers or uses what: a cue in the JVM first, then subject, predicate and object by position."""
    s = texts(spark, sf).select("chunk_id", F.posexplode(T.sentences(F.col("text"))).alias("no", "s"))
    cue = F.regexp_extract(F.col("s"), r"(?:^|[^\p{L}\p{N}_])(uses?|prefers?|leads?|manages?)\s", 1)
    parts = s.withColumn("cue", cue).filter("cue <> ''").withColumn("at", F.instr("s", F.concat(F.lit(" "), F.col("cue"), F.lit(" "))))
    subject = F.regexp_replace(F.expr("left(s, at - 1)"), r"^\s+|\s+$", "")
    rest = F.expr("substring(s, at + length(cue) + 2)")
    obj = F.regexp_extract(rest, r"^([^.,]*)", 1)
    return parts.filter("at > 1").select("chunk_id", "no", subject.alias("subject"), F.regexp_replace("cue", "s$", "").alias("predicate"), F.trim(obj).alias("object")).filter("object <> ''")


RELATION_CUES = {
    "works_on": r"(?:works?\s+on|working\s+on)", "leads": r"(?:leads?|leading)", "uses": r"(?:uses?|using)", "researches": r"(?:researching|researches?)",
    "manages": r"(?:manages?|managing)", "is_a": r"(?:is\s+a|is\s+an|is\s+the)", "prefers": r"(?:prefers?|preferring)",
}
_RELATIONS = [(p, re.compile(rf"\s{c}\s", re.IGNORECASE), re.compile(rf"(\b[A-Z]\w+(?:\s+[A-Z]\w+)*)\s+{c}\s+(.+?)(?:\.|,|$)", re.IGNORECASE)) for p, c in RELATION_CUES.items()]


def relations_in(text: str) -> Iterator[tuple[str, int, str, str]]:
    """(predicate, where, subject, object) of every match of every pattern; no search goes on where no cue is left."""
    for predicate, cue, pattern in _RELATIONS:
        at = 0
        while cue.search(text, at) and (m := pattern.search(text, at)):
            yield predicate, m.start(), m.group(1).strip(), m.group(2).strip()
            at = m.end()


def relation_matches(spark: SparkSession, sf: str) -> DataFrame:
    """All relations in texts by the reference's seven patterns: a cue in the JVM first, then the patterns in Python, as Java's would overflow its stack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(c, *r) for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in relations_in(t)]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["chunk_id", "predicate", "at", "subject", "object"])

    cued = texts(spark, sf).filter(F.col("text").rlike(rf"(?iU)\s(?:{'|'.join(RELATION_CUES.values())})\s"))
    return cued.select("chunk_id", "text").mapInArrow(run, "chunk_id string, predicate string, at int, subject string, object string")


def knowledge_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """For every seed entity the three neighbours of strongest live facts, by confidence then name."""
    e = _edges(spark, sf)
    both = e.select(F.col("subject_key").alias("seed"), F.col("object_key").alias("node"), "confidence").unionByName(e.select(F.col("object_key").alias("seed"), F.col("subject_key").alias("node"), "confidence"))
    best = both.filter("seed <> node and confidence is not null").groupBy("seed", "node").agg(F.max("confidence").alias("confidence"))
    return ranked(best, ["seed"], [F.col("confidence").desc(), F.col("node").asc()], "rank_no").filter("rank_no <= 3").select("seed", "node", F.round("confidence", 6).alias("confidence"), "rank_no")


QUERIES = {
    "fact_decay": fact_decay, "adaptive_decay": adaptive_decay, "reinforce_fold": reinforce_fold, "contradictions_direct": contradictions_direct, "contradictions_negation": contradictions_negation, "facts_negated": facts_negated,
    "fact_current_state": fact_current_state, "graph_bfs2": graph_bfs2, "graph_components": graph_components, "entity_merge": entity_merge, "alias_union": alias_union, "orphan_prune": orphan_prune,
    "endpoint_completion": endpoint_completion, "entity_mentions": entity_mentions, "consolidation_promote": consolidation_promote, "entity_normalize": entity_normalize, "alias_resolve": alias_resolve,
    "acronym_resolve": acronym_resolve, "fuzzy_resolve": fuzzy_resolve, "attribute_merge": attribute_merge, "relation_sentences": relation_sentences, "relation_matches": relation_matches, "knowledge_expansion": knowledge_expansion,
}

_F = r"""f AS (SELECT DISTINCT ON (id) id, user_id, subject_key, object_key, confidence, first_seen, last_seen, mention_count,
  regexp_replace(lower(regexp_replace(predicate, '^\s+|\s+$', '', 'g')), '[\s_-]+', '_', 'g') AS predicate, coalesce(lower(regexp_replace(status, '^\s+|\s+$', '', 'g')), 'active') AS status
  FROM relations WHERE id IS NOT NULL ORDER BY id)"""
_P = "p AS (SELECT DISTINCT ON (entity_key) * FROM entities WHERE entity_key IS NOT NULL ORDER BY entity_key, last_seen DESC NULLS LAST, mention_count DESC NULLS LAST)"
_E = f"{_F}, e AS (SELECT subject_key, object_key, predicate, confidence, mention_count FROM f WHERE status NOT IN ('superseded', 'retracted') AND subject_key IS NOT NULL AND object_key IS NOT NULL)"
_DAYS = f"greatest(0.0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_seen)) / 8.64e10)"
_B = "b AS (SELECT subject_key AS u, object_key AS v FROM e UNION SELECT object_key, subject_key FROM e)"


def _norm(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '''s$', ''), '^([Tt][Hh][Ee]|[Aa]|[Aa][Nn])\s+', ''), '\s+', ' ', 'g')"


def _case(c: str, table_: dict) -> str:
    return "CASE " + " ".join(f"WHEN {c} IN ({S.quoted(v)}) THEN '{k}'" for k, v in table_.items()) + " END"


_M = f"k AS (SELECT entity_key, coalesce(lower(entity_type), '?') AS k, lower(string_split({_norm('name')}, ' ')[1]) AS w FROM p), m AS (SELECT entity_key AS old, min(entity_key) OVER (PARTITION BY k, w) AS new FROM k QUALIFY old <> new)"

ORACLE = {
    "fact_decay": f"WITH {_F} SELECT id, round(confidence * exp(-0.005 * {_DAYS}), 4) AS confidence FROM f WHERE last_seen IS NOT NULL AND confidence * exp(-0.005 * {_DAYS}) >= 0.05",
    "adaptive_decay": f"""WITH {_F}, {_P}, j AS (SELECT f.*, coalesce({_case('f.predicate', L.PREDICATE_TIERS)}, {_case('lower(s.entity_type)', L.TYPE_TIERS)}, {_case('lower(o.entity_type)', L.TYPE_TIERS)}, 'project') AS tier
  FROM f LEFT JOIN p s ON s.entity_key = f.subject_key LEFT JOIN p o ON o.entity_key = f.object_key WHERE f.last_seen IS NOT NULL AND f.confidence IS NOT NULL),
c AS (SELECT id, tier, confidence * exp(-(CASE tier {' '.join(f"WHEN '{k}' THEN {v}" for k, v in L.TIER_RATES.items())} END) * {_DAYS}) AS c FROM j)
SELECT id, tier, round(c, 6) AS confidence, c < 0.05 AS pruned FROM c""",
    "reinforce_fold": f"""WITH {_F} SELECT user_id, subject_key, predicate, object_key, count(*) AS mentions, round(least(1.0, 1 - (1 - arg_min(confidence, (first_seen, id))) * pow(0.8, count(*) - 1)), 6) AS confidence
FROM f WHERE confidence IS NOT NULL AND first_seen IS NOT NULL GROUP BY 1, 2, 3, 4""",
    "contradictions_direct": f"""WITH {_F}, c AS (SELECT *, lag(id) OVER w AS loser, lag(object_key) OVER w AS old_object, lag(confidence) OVER w AS old FROM f
  WHERE first_seen IS NOT NULL AND status = 'active' AND predicate IN ({S.quoted(L.EXCLUSIVE_PREDICATES)}) WINDOW w AS (PARTITION BY user_id, subject_key, predicate ORDER BY first_seen, id))
SELECT id AS winner, loser, predicate, 'direct' AS kind, round(greatest(0.01, old * 0.3), 6) AS loser_confidence FROM c WHERE object_key <> old_object""",
    "contradictions_negation": f"""WITH {_F}, s AS (SELECT 'fact' AS source, id, concat_ws('/', user_id, subject_key) AS holder, predicate, epoch_us(first_seen) AS at_ FROM f WHERE first_seen IS NOT NULL AND status = 'active'
  UNION ALL SELECT 'event', event_id, CAST(user_id AS VARCHAR), CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in EVENT_FACTS.items())} END, epoch_us(ts) FROM events WHERE ts IS NOT NULL),
b AS (SELECT *, CASE predicate {' '.join(f"WHEN '{x}' THEN '{p}'" for p, n in L.NEGATIONS.items() for x in (p, n))} END AS base FROM s),
l AS (SELECT *, last_value(CASE WHEN predicate = base THEN id END IGNORE NULLS) OVER (PARTITION BY source, holder, base ORDER BY at_, id ROWS UNBOUNDED PRECEDING) AS negated FROM b WHERE base IS NOT NULL)
SELECT source, id AS negation, negated, base FROM l WHERE predicate <> base AND negated IS NOT NULL""",
    "facts_negated": f"""WITH {_F}, k AS (SELECT *, CASE predicate {' '.join(f"WHEN '{n}' THEN '{p}'" for p, n in L.NEGATIONS.items())} END AS positive FROM f WHERE first_seen IS NOT NULL AND status = 'active')
SELECT n.id AS winner, o.id AS loser, n.positive AS predicate, 'negation' AS kind FROM k n JOIN k o ON o.user_id = n.user_id AND o.subject_key = n.subject_key AND o.predicate = n.positive AND (o.first_seen, o.id) < (n.first_seen, n.id)""",
    "fact_current_state": f"""WITH {_F}, a AS (SELECT *, CASE WHEN status IN ('superseded', 'retracted') THEN greatest(first_seen, last_seen) ELSE least(first_seen, last_seen) END AS eff FROM f WHERE first_seen IS NOT NULL AND last_seen IS NOT NULL),
s AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY user_id, subject_key, predicate ORDER BY eff DESC, id DESC) = 1)
SELECT user_id, subject_key, predicate, object_key, status, confidence FROM s WHERE status NOT IN ('superseded', 'retracted')""",
    "graph_bfs2": f"""WITH {_E}, {_B}, {_P}, s AS (SELECT entity_key AS seed FROM p WHERE TRY_CAST(nullif(regexp_extract(entity_key, '([0-9]+)$', 1), '') AS BIGINT) % 50 = 0),
one AS (SELECT seed, v AS node FROM s JOIN b ON u = seed), two AS (SELECT seed, v AS node FROM one JOIN b ON u = node),
al AS (SELECT seed, seed AS node, 0 AS hops FROM s UNION ALL SELECT seed, node, 1 FROM one UNION ALL SELECT seed, node, 2 FROM two)
SELECT seed, node, min(hops) AS hops FROM al GROUP BY 1, 2""",
    "graph_components": f"""WITH RECURSIVE {_E}, {_B}, r AS (SELECT u AS node, u AS root FROM b UNION SELECT b.v, r.root FROM r JOIN b ON b.u = r.node WHERE r.root <= b.v)
SELECT node, min(root) AS component FROM r GROUP BY node""",
    "entity_merge": f"""WITH {_E}, {_P}, {_M}, x AS (SELECT coalesce(a.new, subject_key) AS subject_key, coalesce(c.new, object_key) AS object_key, predicate, coalesce(mention_count, 0) AS n FROM e LEFT JOIN m a ON a.old = subject_key LEFT JOIN m c ON c.old = object_key)
SELECT subject_key, object_key, predicate, CAST(sum(n) AS BIGINT) AS mentions FROM x WHERE subject_key <> object_key GROUP BY 1, 2, 3""",
    "alias_union": f"""WITH {_P}, {_M}, x AS (SELECT coalesce(m.new, entity_key) AS entity_key, unnest(list_concat(coalesce(aliases, []), [name])) AS alias FROM p LEFT JOIN m ON m.old = entity_key)
SELECT entity_key, array_to_string(list_sort(list_distinct(list(alias))), '|') AS aliases FROM x WHERE alias IS NOT NULL GROUP BY 1""",
    "orphan_prune": f"WITH {_E}, {_P} SELECT entity_key FROM p WHERE entity_key NOT IN (SELECT subject_key FROM e UNION SELECT object_key FROM e)",
    "endpoint_completion": f"WITH {_E}, {_P} SELECT entity_key, 'concept' AS entity_type FROM (SELECT subject_key AS entity_key FROM e UNION SELECT object_key FROM e) WHERE entity_key NOT IN (SELECT entity_key FROM p)",
    "entity_mentions": f"""WITH {S.TEXTS}, n AS (SELECT chunk_id, unnest({S.proper('text')}) AS n FROM t),
x AS (SELECT chunk_id, lower(regexp_replace(n, '\\s+', ' ', 'g')) AS key, CASE WHEN contains(n, ' ') THEN 'concept' ELSE 'person' END AS kind FROM n WHERE n NOT IN ({S.quoted(L.ENTITY_STOP_WORDS)}) AND length(n) >= 2
  UNION ALL SELECT chunk_id, key, 'tool' FROM (SELECT chunk_id, unnest(list_filter({S.tokens('text')}, lambda w: w IN ({S.quoted(L.TOOL_WORDS)}))) AS key FROM t))
SELECT key, count(*) AS mentions, count(DISTINCT chunk_id) AS chunks, max(kind) AS kind FROM x GROUP BY key""",
    "consolidation_promote": """WITH c AS (SELECT chunk_id, any_value(entity_mentions) AS m FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1), x AS (SELECT chunk_id, unnest(m) AS n FROM c)
SELECT lower(n) AS name, count(DISTINCT chunk_id) AS mentions, CAST(round(least(1.0, 0.85 + count(DISTINCT chunk_id) * 0.02), 6) AS DOUBLE) AS confidence FROM x WHERE n IS NOT NULL GROUP BY 1 HAVING count(DISTINCT chunk_id) >= 3""",
    "entity_normalize": f"WITH {_P} SELECT entity_key, {_norm('name')} AS name, lower({_norm('name')}) AS canonical FROM p",
    "alias_resolve": f"""WITH {_P}, c AS (SELECT chunk_id, any_value(entity_mentions) AS m FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1), x AS (SELECT DISTINCT unnest(m) AS mention FROM c),
n AS (SELECT lower(regexp_replace({_norm('name')}, ' [0-9]+$', '')) AS key, min(entity_key) AS by_name FROM p GROUP BY 1),
a AS (SELECT lower({_norm('a')}) AS key, min(entity_key) AS by_alias FROM (SELECT unnest(aliases) AS a, entity_key FROM p) GROUP BY 1)
SELECT mention, coalesce(by_name, by_alias) AS entity_key, CASE WHEN by_name IS NOT NULL THEN 'exact' WHEN by_alias IS NOT NULL THEN 'alias' ELSE 'none' END AS how
FROM x LEFT JOIN n ON n.key = lower({_norm('mention')}) LEFT JOIN a ON a.key = lower({_norm('mention')}) WHERE mention IS NOT NULL""",
    "acronym_resolve": f"""WITH {_P}, w AS (SELECT entity_key, list_filter(string_split(regexp_replace({_norm('name')}, ' [0-9]+$', ''), ' '), lambda x: x <> '') AS w FROM p),
a AS (SELECT entity_key, upper(array_to_string(list_transform(w, lambda x: x[1:1]), '')) AS acronym FROM w WHERE len(w) > 1)
SELECT acronym, min(entity_key) AS entity_key, count(*) AS candidates FROM a WHERE length(acronym) <= 5 GROUP BY 1""",
    "attribute_merge": """WITH e AS (SELECT entity_key, last_seen, attributes FROM entities WHERE attributes IS NOT NULL AND entity_key IS NOT NULL AND json_valid(attributes)),
k AS (SELECT entity_key, last_seen, attributes, unnest(json_keys(attributes)) AS k FROM e)
SELECT entity_key, k, arg_max(json_extract_string(attributes, '$.' || k), (last_seen, json_extract_string(attributes, '$.' || k))) AS v FROM k GROUP BY 1, 2""",
    "relation_sentences": f"""WITH {S.TEXTS}, s AS (SELECT chunk_id, unnest({S.sentences('text')}) AS s, generate_subscripts({S.sentences('text')}, 1) - 1 AS no FROM t),
c AS (SELECT *, regexp_extract(s, '(?:^|[^\\p{{L}}\\p{{N}}_])(uses?|prefers?|leads?|manages?)\\s', 1) AS cue FROM s), p AS (SELECT *, instr(s, ' ' || cue || ' ') AS at_ FROM c WHERE cue <> '')
SELECT chunk_id, CAST(no AS INTEGER) AS no, regexp_replace(s[1 : at_ - 1], '^\\s+|\\s+$', '', 'g') AS subject, regexp_replace(cue, 's$', '') AS predicate, trim(regexp_extract(s[at_ + length(cue) + 2 :], '^([^.,]*)', 1), ' ') AS object
FROM p WHERE at_ > 1 AND trim(regexp_extract(s[at_ + length(cue) + 2 :], '^([^.,]*)', 1), ' ') <> ''""",
    "knowledge_expansion": f"""WITH {_E}, x AS (SELECT subject_key AS seed, object_key AS node, confidence FROM e UNION ALL SELECT object_key, subject_key, confidence FROM e),
g AS (SELECT seed, node, max(confidence) AS c FROM x WHERE seed <> node AND confidence IS NOT NULL GROUP BY 1, 2)
SELECT seed, node, round(c, 6) AS confidence, row_number() OVER (PARTITION BY seed ORDER BY c DESC, node) AS rank_no FROM g QUALIFY rank_no <= 3""",
}
