"""Roots of the hash forest with more rows than a task should hold: the same decisions by joins.

A prefix of a path is a range of a tree, so the join on (root, tree, prefix) is the
search of all ranges at once. Copies are folded to leaders first: of the rows of one
form those whose vector is near a leader's follow it, and only leaders are searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.history_dedup import DIMS, LEVEL_BITS, LEVELS, Settings, _near, form_of, paths
from mnemospark.llm.messages import same_message, words
from mnemospark.session import materialize, path_exists

SPLIT = "chunk_id string, root bigint, form bigint, text string, vec binary, paths array<bigint>"
FORM = ["root", "form"]


def sign(routed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ws = [words(t) for t in b.column(2).to_pylist()]
            form = np.array([form_of(r, w) for r, w in zip(b.column(1).to_pylist(), ws)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(form.view(np.int64)), b.column(2), b.column(3), pa.array(paths(ws).astype(np.int64).tolist(), pa.list_(pa.int64()))], names=["chunk_id", "root", "form", "text", "vec", "paths"])

    return routed.select("chunk_id", "root", "text", "vec").mapInArrow(run, SPLIT)


def _raw(column: pa.Array) -> np.ndarray:
    none = np.full(DIMS, np.nan, np.float32).tobytes()
    return np.frombuffer(b"".join(v or none for v in column.to_pylist()), np.float32).reshape(-1, DIMS)


def judged(pairs: DataFrame, least: float) -> DataFrame:
    """(b, a, near, same) of pairs with va, vb, ta, tb; equal texts aren't sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            near = _near(_raw(t.column(2)), _raw(t.column(3)), least)
            same = [x is None or same_message(x, y) for x, y in zip(t.column(4).to_pylist(), t.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(near), pa.array(same)], names=["b", "a", "near", "same"])

    return pairs.select("b", "a", "vb", "va", "tb", "ta").mapInArrow(run, "b string, a string, near boolean, same boolean")


def _as(rows: DataFrame, side: str, *more: str) -> DataFrame:
    return rows.select(F.col("chunk_id").alias(side), F.col("vec").alias(f"v{side}"), F.col("text").alias(f"t{side}"), *more)


def in_form(b: DataFrame, a: DataFrame, least: float) -> DataFrame:
    """(b, a): rows of one root and form with near vectors. The side a has few rows per form; b may be skewed."""
    none = F.lit(None).cast("string")
    j = _as(b, "b", *FORM).join(_as(a, "a", *FORM), FORM).filter("a <> b").withColumns({"ta": none, "tb": none})
    return judged(j, least).filter("near").select("b", "a")


def candidates(b: DataFrame, a: DataFrame, depth: int) -> DataFrame:
    """(b, a): rows of one root that share a prefix of `depth` digits in some tree."""
    cut = (LEVELS - depth) * LEVEL_BITS

    def ranges(rows: DataFrame, side: str) -> DataFrame:
        e = rows.select(F.col("chunk_id").alias(side), "root", "form", F.posexplode("paths").alias("tree", "path"))
        return e.select(side, F.col("form").alias(f"f{side}"), F.xxhash64("root", "tree", F.shiftright("path", cut)).alias("range")).distinct()

    return ranges(b, "b").join(ranges(a, "a"), "range").filter("fa <> fb").select("b", "a").distinct()


def links(b: DataFrame, a: DataFrame, depth: int, least: float, found: DataFrame | None = None) -> DataFrame:
    """(b, a, near) of candidates that are the same message."""
    pairs = candidates(b, a, depth)
    if found is not None:
        pairs = pairs.join(found, "b", "left_anti")
    return judged(pairs.join(_as(b, "b"), "b").join(_as(a, "a"), "a"), least).filter("same").select("b", "a", "near")


def leaders(rows: DataFrame, least: float) -> DataFrame:
    """(chunk_id, lead): each row follows the first leader of its form near to it. A pass finds one leader of every form."""
    left, out = rows.select("chunk_id", *FORM, "vec", F.lit(None).cast("string").alias("text")), None
    while True:
        lead = left.groupBy(*FORM).agg(F.min("chunk_id").alias("chunk_id"), F.min_by("vec", "chunk_id").alias("vec")).withColumn("text", F.lit(None).cast("string"))
        lead = materialize(lead, "leaders")
        if lead.isEmpty():
            return out
        got = in_form(left, lead, least).select(F.col("b").alias("chunk_id"), F.col("a").alias("lead")).unionByName(lead.select("chunk_id", F.col("chunk_id").alias("lead")))
        got = materialize(got, "followers")
        out = got if out is None else out.unionByName(got)
        left = materialize(left.join(got, "chunk_id", "left_anti"), "left")


def settle(pairs: DataFrame) -> DataFrame:
    """(b) of the rejected rows of pairs (b, a) with a < b: b is rejected if some a of its pairs is accepted.

    Each round decides every row whose earlier partners are decided, so the first
    undecided one at least. Rounds are as many as the longest chain of repeats that no
    row before it cuts.
    """
    todo, out = materialize(pairs, "open"), pairs.select("b").limit(0)
    while not todo.isEmpty():
        sure = materialize(todo.join(todo.select(F.col("b").alias("a")).distinct(), "a", "left_anti").select("b").distinct(), "rejected")
        out = out.unionByName(sure)
        todo = materialize(todo.join(sure, "b", "left_anti").join(sure.select(F.col("b").alias("a")), "a", "left_anti"), "open")
    return out


def against_store(rows: DataFrame, store: DataFrame, s: Settings) -> DataFrame:
    """(b) of the rows that repeat a stored one: by leaders, then by the other rows of the forms whose leader is too far in vector."""
    lead, rest = store.filter("lead"), store.filter("not lead")
    found = materialize(in_form(rows, lead, s.least_cosine).select("b").distinct(), "found")
    for depth in range(LEVELS, s.least_depth - 1, -1):
        got = materialize(links(rows, lead, depth, s.least_cosine, found), "links")
        found = found.unionByName(got.filter("near").select("b").distinct())
        far = got.filter("not near").select("b", "a").distinct()
        more = far.join(lead.select(F.col("chunk_id").alias("a"), *FORM), "a").join(rest.select(*FORM, F.col("chunk_id").alias("other"), F.col("vec").alias("va")), FORM).join(rows.select(F.col("chunk_id").alias("b"), F.col("vec").alias("vb")), "b")
        none = F.lit(None).cast("string")
        hit = judged(more.select("b", F.col("other").alias("a"), "vb", "va", none.alias("tb"), none.alias("ta")), s.least_cosine).filter("near")
        found = materialize(found.unionByName(hit.select("b")).distinct(), "found")
    left = rows.join(found.withColumnRenamed("b", "chunk_id"), "chunk_id", "left_anti")
    return found.unionByName(in_form(left, rest, s.least_cosine).select("b")).distinct()


def settle_hot(spark: SparkSession, path: str, routed: DataFrame, run: str, s: Settings, accept_all: bool) -> DataFrame:
    """(chunk_id) of the rejected rows of hot roots; the accepted ones are appended to the table at `path`."""
    signed = materialize(sign(routed).dropDuplicates(["chunk_id"]), "signed")
    empty = spark.createDataFrame([], "chunk_id string")
    if signed.isEmpty():
        return empty
    old = materialize(spark.read.schema(SPLIT + ", lead boolean, run string").parquet(path).withColumn("lead", F.coalesce("lead", F.lit(True))).drop("run"), "store") if path_exists(spark, path) else spark.createDataFrame([], SPLIT + ", lead boolean")
    rows = signed.join(old.select(*FORM, "chunk_id"), [*FORM, "chunk_id"], "left_anti")
    gone = empty
    if not accept_all:
        gone = materialize(against_store(rows, old, s).select(F.col("b").alias("chunk_id")), "gone")
        rows = materialize(rows.join(gone, "chunk_id", "left_anti"), "rows")
    if rows.isEmpty():
        return gone
    lead = materialize(leaders(rows, s.least_cosine), "lead")
    if accept_all:
        keep = rows.join(lead, "chunk_id").withColumn("lead", F.col("lead") == F.col("chunk_id"))
    else:
        nodes = lead.select(F.col("lead").alias("chunk_id")).distinct()
        while True:
            n = materialize(rows.join(nodes, "chunk_id", "left_semi"), "nodes")
            pairs = links(n, n, s.least_depth, s.least_cosine).filter("near and a < b").select("b", "a").unionByName(in_form(n, n, s.least_cosine).filter("a < b"))
            bad = materialize(settle(pairs.distinct()).select(F.col("b").alias("chunk_id")), "bad")
            good = n.join(bad, "chunk_id", "left_anti")
            orphan = rows.join(lead.join(bad.withColumnRenamed("chunk_id", "lead"), "lead", "left_semi").select("chunk_id").join(nodes, "chunk_id", "left_anti"), "chunk_id", "left_semi")
            hit = links(orphan, good, s.least_depth, s.least_cosine).filter("near and a < b").select("b").unionByName(in_form(orphan, good, s.least_cosine).filter("a < b").select("b"))
            rest = materialize(orphan.join(hit.select(F.col("b").alias("chunk_id")), "chunk_id", "left_anti"), "rest")
            if rest.isEmpty():
                break
            # these may be accepted: their leaders are searched as well
            again = materialize(leaders(rest, s.least_cosine), "lead")
            lead = lead.join(again.select("chunk_id"), "chunk_id", "left_anti").unionByName(again)
            nodes = materialize(nodes.unionByName(again.select(F.col("lead").alias("chunk_id"))).distinct(), "nodes")
        keep = good.withColumn("lead", F.lit(True))
        gone = materialize(gone.unionByName(rows.select("chunk_id").join(good.select("chunk_id"), "chunk_id", "left_anti")), "gone")
    keep.select(*[c.split(" ")[0] for c in SPLIT.split(", ")], "lead").withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)
    return gone
