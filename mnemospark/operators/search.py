"""Search of a stated query set against all rows: exact scores in blocks, top k by partial aggregation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.session import materialize

BLOCK_QUERIES = 2_048
PART_ROWS = 20_000  # of a group that meet its queries in one task
BLOCK_SCORES = 2_000_000
FOUND = "query_id string, id string, similarity double, score double"


@dataclass(frozen=True)
class Weights:
    """Shares of time, reinforcement and importance in a fused score; similarity has the rest."""

    temporal: float = 0.15
    reinforcement: float = 0.05
    importance: float = 0.05
    decay: float = 0.01


def _unit(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with `dims` finite values and those rows at length one, in double precision; a zero vector stays zero."""
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(length == dims)
    flat = pc.fill_null(pc.list_flatten(column.take(pa.array(at))), float("nan")).to_numpy(zero_copy_only=False)
    x = flat.astype(np.float64).reshape(-1, dims)
    ok = np.isfinite(x).all(axis=1)
    at, x = at[ok], x[ok]
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return at, np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _columns(batch: pa.RecordBatch, at: np.ndarray) -> tuple[np.ndarray, ...]:
    take = pa.array(at)
    return tuple(pc.fill_null(batch.column(k).take(take), fill).to_numpy(zero_copy_only=False).astype(np.float64) for k, fill in ((2, 0.0), (3, 0.0), (4, 1.0), (5, 0.0), (6, 0.0)))


def _fixed(w: Weights, scale: float, age: np.ndarray, access: np.ndarray, imp: np.ndarray) -> np.ndarray:
    return w.temporal * np.exp(-w.decay * age) + w.reinforcement * np.log1p(access) / scale + w.importance * imp


def _best_of(score: np.ndarray, bad: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k best of every line, and of all that are as good as the k-th: what a rounding error orders is not kept apart here."""
    s = np.where(bad, -np.inf, np.round(score, 9))
    keep = min(k, s.shape[1])
    kth = np.partition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep]
    return np.nonzero((s >= kth[:, None]) & np.isfinite(s))


def _first(ids: np.ndarray, row: np.ndarray, name: np.ndarray, sim: np.ndarray, score: np.ndarray, k: int) -> pa.Table:
    order = np.lexsort((name.astype("U"), -np.round(score, 9), row))
    row, name, sim, score = row[order], name[order], sim[order], score[order]
    m = np.arange(len(row)) - np.searchsorted(row, row) < k
    return pa.table({"query_id": pa.array(ids[row[m]].tolist(), pa.string()), "id": pa.array(name[m].tolist(), pa.string()), "similarity": pa.array(sim[m]), "score": pa.array(score[m])})


def _within_groups(asked: DataFrame, data: DataFrame, k: int, w: Weights, scale: float, dims: int, earlier: bool) -> DataFrame:
    """The k best per query and part of its group: groups are hashed into buckets of about PART_ROWS rows, larger ones are parted by a hash of the id and their queries go to every part."""
    data, asked = data.filter(F.col("grp").isNotNull()), asked.filter(F.col("grp").isNotNull())
    sizes = data.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))
    sizes = materialize(sizes, "sizes")
    n = sizes.agg(F.sum("_n")).first()[0] or 0
    buckets = max(1, -(-n // PART_ROWS))
    parts = F.broadcast(sizes.filter(F.col("_n") > PART_ROWS).select("grp", F.ceil(F.col("_n") / PART_ROWS).alias("_parts")))
    put = lambda df: df.withColumn("_bucket", F.pmod(F.xxhash64("grp", "_part"), F.lit(buckets)))
    of = F.coalesce("_parts", F.lit(1).cast("bigint"))
    data = put(data.join(parts, "grp", "left").withColumn("_part", F.pmod(F.xxhash64("id"), of)).select("id", "vector", "age", "access", "confidence", "importance", "ord", "grp", "_part"))
    asked = put(asked.join(parts, "grp", "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), of - 1))).select("query_id", *[F.col(c).alias(f"_{c}") for c in ("vector", "ord")], "grp", "_part"))

    def meet(queries: pa.Table, rows: pa.Table) -> pa.Table:
        q_in, r_in = (t.combine_chunks().to_batches() for t in (queries, rows))
        none = pa.table({c: pa.array([], t) for c, t in (("query_id", pa.string()), ("id", pa.string()), ("similarity", pa.float64()), ("score", pa.float64()))})
        if not q_in or not r_in:
            return none
        (q_in,), (r_in,) = q_in, r_in
        q_at, q = _unit(q_in.column(1), dims)
        at, x = _unit(r_in.column(1), dims)
        if not len(q_at) or not len(at):
            return none
        age, access, conf, imp, order = _columns(r_in, at)
        fixed = _fixed(w, scale, age, access, imp)
        take, q_take = pa.array(at), pa.array(q_at)
        names, ids = np.array(r_in.column(0).take(take).to_pylist(), object), np.array(q_in.column(0).take(q_take).to_pylist(), object)
        q_ord = pc.fill_null(q_in.column(2).take(q_take), float("inf")).to_numpy(zero_copy_only=False)
        code: dict = {}
        r_grp, q_grp = ([code.setdefault(g, len(code)) for g in zip(t.column(c).take(a).to_pylist(), t.column(c + 1).take(a).to_pylist())] for t, c, a in ((r_in, 7, take), (q_in, 3, q_take)))
        number: dict = {}
        r_id, q_id = (np.array([number.setdefault(v, len(number)) for v in t]) for t in (names, ids))
        r_grp, q_grp = np.array(r_grp), np.array(q_grp)
        by, q_by = np.argsort(r_grp, kind="stable"), np.argsort(q_grp, kind="stable")
        best: list[tuple[np.ndarray, ...]] = []
        for g in np.unique(q_grp):
            rs = by[slice(*np.searchsorted(r_grp[by], [g, g + 1]))]
            qs = q_by[slice(*np.searchsorted(q_grp[q_by], [g, g + 1]))]
            if not len(rs):
                continue
            step = max(1, BLOCK_SCORES // len(rs))
            for some in (qs[lo : lo + step] for lo in range(0, len(qs), step)):
                sim = q[some] @ x[rs].T
                score = (sim * (1 - w.temporal - w.reinforcement - w.importance) + fixed[rs]) * conf[rs]
                bad = r_id[rs][None, :] == q_id[some][:, None]
                if earlier:
                    bad |= order[rs][None, :] >= q_ord[some][:, None]
                row, col = _best_of(score, bad, k)
                best.append((some[row], names[rs[col]], sim[row, col], score[row, col]))
        return _first(ids, *(np.concatenate(c) for c in zip(*best)), k) if best else none

    return asked.groupBy("_bucket").cogroup(data.groupBy("_bucket")).applyInArrow(meet, FOUND)


def fused_search(queries: DataFrame, rows: DataFrame, k: int = 10, weights: Weights = Weights(), dims: int = 64, block: int = BLOCK_QUERIES, same_group: bool = False, earlier: bool = False) -> DataFrame:
    """(query_id, id, similarity, score, rank_no): the k best rows of every query by the fused score.

    score = (sim (1 - t - r - i) + t exp(-decay age) + r ln(1 + access) / ln(1 + max access) + i importance) confidence

    `queries` has query_id, vector, grp, ord; `rows` has id, vector, age, access,
    confidence, importance, grp, ord. With `same_group` a query meets rows of its group
    only, and a null group is nobody's, with `earlier` rows of smaller ord only. A query
    isn't its own answer. Queries go to the executors in blocks of at most `block`
    vectors, so what is sent is bounded; each task keeps its own k best per query, and
    only those are shuffled. Within groups queries and rows meet by a join on the group.
    Vectors of another length or with values that aren't finite don't take part. Ties
    go to the smaller id.
    """
    spark = rows.sparkSession
    top = rows.agg(F.greatest(F.coalesce(F.max("access"), F.lit(0)), F.lit(1)).alias("m")).first()["m"]
    scale = float(np.log1p(top))
    w = weights
    data = rows.select(F.col("id").cast("string"), F.col("vector"), *[F.col(c).cast("double") for c in ("age", "access", "confidence", "importance", "ord")], F.col("grp").cast("string"))
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "vector", F.col("ord").cast("double"), F.col("grp").cast("string"))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    if same_group:
        out = _within_groups(asked, data, k, w, scale, dims, earlier)
        return out.withColumn("rank_no", F.row_number().over(best)).filter(F.col("rank_no") <= k)
    n = asked.count()
    blocks = max(1, -(-n // block))
    if blocks > 1:
        asked = materialize(asked.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(2 * blocks))), "queries")
        parts = [asked.filter(F.col("_b") == b).drop("_b") for b in range(2 * blocks)]
    else:
        parts = [asked]
    out = None
    for part in parts:
        t = part.orderBy("query_id").toArrow().combine_chunks()
        if not t.num_rows:
            continue
        vec = t.column("vector").combine_chunks() if isinstance(t.column("vector"), pa.ChunkedArray) else t.column("vector")
        at, q = _unit(vec, dims)
        ids = np.array(t.column("query_id").to_pylist(), object)[at]
        q_ord = pc.fill_null(t.column("ord"), float("inf")).to_numpy()[at]
        if not len(at):
            continue

        def run(batches: Iterator[pa.RecordBatch], q=q, ids=ids, q_ord=q_ord) -> Iterator[pa.RecordBatch]:
            best: list[tuple[np.ndarray, ...]] = []
            for b in batches:
                at, x = _unit(b.column(1), dims)
                if not len(at):
                    continue
                age, access, conf, imp, order = _columns(b, at)
                names = np.array(b.column(0).take(pa.array(at)).to_pylist(), object)
                fixed = _fixed(w, scale, age, access, imp)
                s = q @ x.T
                score = (s * (1 - w.temporal - w.reinforcement - w.importance) + fixed) * conf
                bad = names[None, :] == ids[:, None]
                if earlier:
                    bad |= order[None, :] >= q_ord[:, None]
                row, col = _best_of(score, bad, k)
                best.append((row, names[col], s[row, col], score[row, col]))
            if best and sum(len(c[0]) for c in best):
                row, name, sim, score = (np.concatenate(c) for c in zip(*best))
                yield from _first(ids, row, name, sim, score, k).to_batches()

        got = data.mapInArrow(run, FOUND)
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = spark.createDataFrame([], FOUND)
    return out.withColumn("rank_no", F.row_number().over(best)).filter(F.col("rank_no") <= k)
