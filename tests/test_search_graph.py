import random

import numpy as np
from pyspark.sql import functions as F

from mnemospark.operators import graph as G
from mnemospark.operators.search import Weights, fused_search

ROW = "id string, vector array<float>, age double, access int, confidence double, importance double, grp string, ord bigint, query_id string"


def rows_of(n, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 8)).astype(np.float32)
    return [(f"r{i:03d}", v[i].tolist(), float(i % 30), i % 5, 0.5 + (i % 3) / 6, 0.5, "g" + str(i % 2), i, "clash") for i in range(n)]


def test_fused_search_against_brute_force(spark):
    rows = rows_of(120)
    extra = [("bad1", None, 0.0, 0, 1.0, 0.5, "g0", 1, None), ("bad2", [1.0] * 3, 0.0, 0, 1.0, 0.5, "g0", 1, None), ("bad3", [float("nan")] * 8, 0.0, 0, 1.0, 0.5, "g0", 1, None)]
    df = spark.createDataFrame(rows + extra, ROW)
    q = df.filter("ord % 10 = 0").select(F.col("id").alias("query_id"), "vector", "grp", "ord")
    w = Weights(0.3, 0.1, 0.1)
    for block in (2048, 3):
        got = {}
        for r in fused_search(q, df, 5, w, dims=8, block=block).collect():
            got.setdefault(r["query_id"], []).append((r["rank_no"], r["id"], r["score"]))
        x = np.array([r[1] for r in rows])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        for i in range(0, 120, 10):
            s = [((x[i] @ x[j]) * 0.5 + 0.3 * np.exp(-0.01 * r[2]) + 0.1 * np.log1p(r[3]) / np.log1p(4) + 0.05) * r[4] for j, r in enumerate(rows)]
            best = sorted((j for j in range(120) if j != i), key=lambda j: (-round(s[j], 9), rows[j][0]))[:5]
            assert [b for _, b, _ in sorted(got[f"r{i:03d}"])] == [rows[j][0] for j in best]


def test_search_of_own_group_and_earlier_rows(spark):
    df = spark.createDataFrame(rows_of(40), ROW)
    q = df.filter("ord % 10 = 0").select(F.col("id").alias("query_id"), "vector", "grp", "ord")
    for r in fused_search(q, df, 3, dims=8, same_group=True, earlier=True).collect():
        a, b = int(r["query_id"][1:]), int(r["id"][1:])
        assert b < a and a % 2 == b % 2
    empty = spark.createDataFrame([], ROW)
    assert fused_search(empty.select(F.col("id").alias("query_id"), "vector", "grp", "ord"), empty, 3, dims=8).count() == 0


def test_search_of_own_group_in_parts(spark, monkeypatch):
    """Groups that meet their queries in many tasks, ties across them, and rows of no group; no query passes through the driver."""
    from mnemospark.operators import search

    monkeypatch.setattr(search, "PART_ROWS", 7)
    monkeypatch.setattr(search, "BLOCK_SCORES", 20)
    rows = [(r[0], [float(i % 3 + 1), 1.0] + [0.0] * 6, *r[2:6], None if i % 11 == 0 else r[6] if i % 4 else f"s{i}", *r[7:]) for i, r in enumerate(rows_of(150))]
    df = spark.createDataFrame(rows, ROW)
    q = df.filter("ord % 5 = 0").select(F.col("id").alias("query_id"), "vector", "grp", "ord")
    found = fused_search(q, df, 4, Weights(0.0, 0.0, 0.0), dims=8, same_group=True, earlier=True)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank_no"], r["id"]))
    x = np.array([r[1] for r in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for i in range(0, 150, 5):
        near = sorted((j for j in range(i) if rows[i][6] is not None and rows[j][6] == rows[i][6]), key=lambda j: (-round(float(x[i] @ x[j]) * rows[j][4], 9), rows[j][0]))[:4]
        if near:
            want[rows[i][0]] = [(n + 1, rows[j][0]) for n, j in enumerate(near)]
    assert {k: sorted(v) for k, v in got.items()} == want
    assert "CoGroup" in found._jdf.queryExecution().toString()


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(80):02d}", f"n{rng.randrange(80):02d}") for _ in range(60)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)] + [("h", f"x{i}") for i in range(50)] + [(None, "q"), ("q", None), ("l", "l")]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a and b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in G.components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert got == {n: find(n) for n in list(parent)}
    assert G.components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_expand_and_merge(spark):
    e = spark.createDataFrame([("a", "b", "p", 1), ("b", "c", "p", 2), ("c", "d", "p", 1), ("a2", "b", "p", 4), ("a", "a2", "p", 1)], "s string, o string, p string, n int")
    got = {(r["node"], r["hops"]) for r in G.expand(spark.createDataFrame([("a",)], "seed string"), e, "s", "o", 2).collect()}
    assert got == {("a", 0), ("b", 1), ("a2", 1), ("c", 2)}
    m = G.merge_nodes(e, spark.createDataFrame([("a2", "a")], "old string, new string"), "s", "o", ["p"], "n")
    assert {(r["s"], r["o"], r["n"]) for r in m.collect()} == {("a", "b", 5), ("b", "c", 2), ("c", "d", 1)}


def test_smart_dedup_of_names_of_many_parts(spark, tmp_path):
    """Near pairs whose texts hold names of thousands of parts."""
    from mnemospark.plans.episodic import smart_dedup

    long, v = "run" + "_b" * 20_000 + " for Ab" + " Cd" * 20_000, [1.0] * 64
    rows = [(f"ch_{i:09d}", v, t, f"2024-01-0{i // 50} 00:00:00", "c", "user", 1.0, 0, "u") for i, t in ((50, long), (100, long), (150, "at Oslo"))]
    chunks = spark.createDataFrame(rows, "chunk_id string, vector array<float>, text string, timestamp string, conversation_id string, speaker string, confidence double, access_count int, user_id string")
    chunks.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/chunks.parquet")
    assert sorted(map(tuple, smart_dedup(spark, str(tmp_path)).collect())) == [("ch_000000100", "ch_000000050", 1.0, True), ("ch_000000150", "ch_000000050", 0.0, False)]
