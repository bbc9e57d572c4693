"""Extraction of entities and relations: an interface, and an extractor that compares phrases and sentences with seed phrases by an embedder."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import lexicon as L
from mnemospark.sources.embedders import Embedder

# Phrases that stand for a type of entity, and sentences that stand for a relation.
TYPE_SEEDS = {
    "person": ("a person named John", "someone called Alice", "engineer named Bob", "my colleague Sarah"),
    "org": ("a company called Google", "the organization Anthropic", "a corporation named Meta", "the startup OpenAI"),
    "tool": ("a programming language like Python", "a software tool called Docker", "a framework named PyTorch", "a technology like Kubernetes"),
    "project": ("a project called Phoenix", "the initiative named Pipeline", "a codebase or repository", "a product we are building"),
    "concept": ("a technical concept like machine learning", "an idea or methodology", "a research topic or field", "an algorithm or technique"),
    "location": ("a city named San Francisco", "a country like Japan", "a geographic place or region", "an office located in New York"),
}
RELATION_SEEDS = {
    "works_at": ("works at", "is employed by", "joined"), "works_on": ("works on", "is building", "is developing"), "leads": ("leads", "manages", "is the head of"), "uses": ("uses", "works with", "relies on"),
    "is_a": ("is a", "is an", "works as a"), "researches": ("researches", "is studying", "is investigating"), "left": ("left", "quit", "departed from"), "prefers": ("prefers", "likes", "favors"),
    "located_in": ("is located in", "is based in", "lives in"),
}

_PHRASE = re.compile(r"\b(?:[A-Z][a-z]+(?: [A-Z][a-z]+)*|[A-Z][A-Z0-9]+|[A-Z][a-z]*\d+[a-zA-Z]*)\b")
_STOP = frozenset(w.lower() for w in L.ENTITY_STOP_WORDS)


class Extractor(Protocol):
    """Entities and relations of texts: (key, kind, name, type, subject, predicate, object, confidence) rows, kind being entity or relation."""

    def __call__(self, df: DataFrame, key: str, text: str) -> DataFrame: ...


OUT = "kind string, name string, type string, subject string, predicate string, object string, confidence double"


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


class EmbeddingExtractor:
    """Types of phrases by the nearest seed of at least `entity`, else concept; relations of sentences with two entities by the nearest seed of at least `relation`, between the first two in order of appearance."""

    def __init__(self, make: Callable[[], Embedder], entity: float = 0.45, relation: float = 0.55):
        self.make, self.entity, self.relation = make, entity, relation

    def __call__(self, df: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
        """Null and blank texts have no rows; repeated rows come out as often as they go in. One client per task, two requests per Arrow batch."""
        make, least_entity, least_relation = self.make, self.entity, self.relation

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            client = make()
            mean = lambda phrases: np.mean(client.embed_batch(phrases), axis=0)
            types, seeds = list(TYPE_SEEDS), _unit(np.array([mean(list(v)) for v in TYPE_SEEDS.values()]))
            kinds, rel_seeds = list(RELATION_SEEDS), _unit(np.array([mean([f"someone {p} something" for p in v]) for v in RELATION_SEEDS.values()]))
            for b in batches:
                rows: list[tuple] = []
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    names = list(dict.fromkeys(m for m in _PHRASE.findall(t) if m.lower() not in _STOP and len(m) > 1))
                    tools = [w for w in dict.fromkeys(re.findall(r"\w+", t)) if w.lower() in L.TOOL_WORDS]
                    names += [w for w in tools if w not in names]
                    if not names:
                        continue
                    sim = _unit(np.array(client.embed_batch(names))) @ seeds.T
                    for n, s in zip(names, sim):
                        best = int(s.argmax())
                        rows.append((k, "entity", n, "tool" if n.lower() in L.TOOL_WORDS else types[best] if s[best] >= least_entity else "concept", None, None, None, float(s[best])))
                    held = [(s, sorted((s.lower().find(n.lower()), n) for n in names if n.lower() in s.lower())) for s in map(str.strip, re.split(r"[.!?]+", t)) if s]
                    held = [(s, m) for s, m in held if len(m) > 1]
                    if len(names) > 1 and held:
                        for (_, m), s in zip(held, _unit(np.array(client.embed_batch([s for s, _ in held]))) @ rel_seeds.T):
                            best = int(s.argmax())
                            if s[best] >= least_relation:
                                rows.append((k, "relation", None, None, m[0][1], kinds[best], m[1][1], min(1.0, float(s[best]))))
                cols = list(zip(*rows)) if rows else [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), b.column(0).type), *(pa.array(list(c), pa.string()) for c in cols[1:7]), pa.array(list(cols[7]), pa.float64())], names=[key, *(c.split(" ")[0] for c in OUT.split(", "))])

        return df.filter(F.trim(text) != "").select(key, text).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, {OUT}")


ANSWER = "struct<entities: array<struct<name: string, type: string>>, relations: array<struct<subject: string, predicate: string, object: string, confidence: double>>>"


def parsed_answer(answer: Column) -> Column:
    """Entities and relations in a model's answer: the JSON object inside it; null where there is none. Entries that lack a name or an end are left out, a missing type is concept, a missing confidence 0.8, predicates have one form."""
    j = F.from_json(F.nullif(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), F.lit("")), ANSWER)
    form = lambda p: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in L.PREDICATE_FORMS.items() for x in kv]), F.regexp_replace(F.lower(F.trim(p)), r"\s+", "_")), F.regexp_replace(F.lower(F.trim(p)), r"\s+", "_"))
    entities = F.transform(F.filter(j["entities"], lambda e: e["name"].isNotNull()), lambda e: F.struct(e["name"].alias("name"), F.coalesce(e["type"], F.lit("concept")).alias("type")))
    whole = lambda r: r["subject"].isNotNull() & r["predicate"].isNotNull() & r["object"].isNotNull()
    relations = F.transform(F.filter(j["relations"], whole), lambda r: F.struct(r["subject"].alias("subject"), form(r["predicate"]).alias("predicate"), r["object"].alias("object"), F.coalesce(r["confidence"], F.lit(0.8)).alias("confidence")))
    return F.when(j.isNotNull(), F.struct(entities.alias("entities"), relations.alias("relations")))
