import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from mnemospark.sources.embedders import Breaker, HashEmbedder, HttpEmbedder, embed, make_embedder
from mnemospark.sources.store import MemoryStore, prometheus
from mnemospark.streaming.ingest import TURN, ingest_stream, profile_stream, turns_to_chunks


def at(n):
    return dt.datetime(2024, 1, 1, 0, n)


def test_latest_wins_tombstones_and_erase(spark, tmp_path):
    s = MemoryStore(spark, str(tmp_path / "store"))
    assert s.state("explicit").count() == 0 and s.get_config("v", "none") == "none"
    sch = "user_id string, key string, value string, priority bigint, written_at timestamp, seq bigint, extra_column string"
    s.append("explicit", spark.createDataFrame([("u", "a", "1", 1, at(1), 1, "x"), ("u", "b", "2", 5, at(1), 2, "x"), ("v", "a", "9", 1, at(1), 3, "x")], sch))
    s.append("explicit", spark.createDataFrame([("u", "a", "3", 1, at(2), 4, "x")], sch))
    rows = s.explicit("u").collect()
    assert [(r["key"], r["value"], r["created"]) for r in rows] == [("b", "2", at(1)), ("a", "3", at(1))]
    s.delete("explicit", spark.createDataFrame([("u", "b", at(3))], "user_id string, key string, written_at timestamp"))
    assert [r["key"] for r in s.explicit("u").collect()] == ["a"]
    s.snapshot(str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap/explicit")).count() == 2
    assert any('layer="explicit"} 1' in r["line"] for r in prometheus(s.counts()).collect())
    s.erase("u")
    assert {r["user_id"] for r in s.state("explicit").collect()} == {"v"}


def test_access_counts_and_nodes(spark, tmp_path):
    s = MemoryStore(spark, str(tmp_path / "store"))
    s.append("chunk", spark.createDataFrame([("u", "c1", "hi", [1.0, 0.0], at(1))], "user_id string, chunk_id string, text string, vector array<float>, timestamp timestamp"))
    s.append("access", spark.createDataFrame([("u", "c1", "q1"), ("u", "c1", "q2")], "user_id string, chunk_id string, query_id string"))
    assert s.chunks("u", dims=2).first()["access_count"] == 2 and s.chunks("u", dims=3).count() == 0
    s.append("relation", spark.createDataFrame([("u", "x", "uses", "y")], "user_id string, subject_key string, predicate string, object_key string"))
    assert {(r["entity_key"], r["entity_type"]) for r in s.nodes().collect()} == {("x", "concept"), ("y", "concept")}


def test_stream_equals_batch(spark, tmp_path):
    rows = [("t1", "u", "c", "user", "Ann leads it. Bob helps. Carl left. Dora stays.", at(1)), ("t2", "u", "c", "user", "", at(2)), ("t1", "u", "c", "user", "Ann leads it. Bob helps. Carl left. Dora stays.", at(1)), ("t3", "v", None, None, "One.", at(3))]
    src = str(tmp_path / "turns")
    spark.createDataFrame(rows, TURN).coalesce(1).write.parquet(src)
    store = MemoryStore(spark, str(tmp_path / "store"))
    ingest_stream(spark.readStream.schema(TURN).parquet(src), store, str(tmp_path / "cp")).awaitTermination()
    batch = turns_to_chunks(spark.createDataFrame(rows, TURN).dropDuplicates(["turn_id"]))
    want = {(r["chunk_id"], r["text"]) for r in batch.collect()}
    assert {(r["chunk_id"], r["text"]) for r in store.state("chunk").collect()} == want and len(want) == 3


def test_profile_stream_keeps_state(spark, tmp_path):
    src = str(tmp_path / "signals")
    sch = "user_id string, dimension string, signal double, ts timestamp"
    spark.createDataFrame([("u", "d", 1.0, at(1)), ("u", "d", None, at(2)), ("u", "d", 0.0, at(3))], sch).coalesce(1).write.parquet(src)
    q = profile_stream(spark.readStream.schema(sch).parquet(src)).writeStream.format("memory").queryName("prof").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.table("prof").first()
    assert abs(r["value"] - (0.5 * 0.8 + 0.2) * 0.8) < 1e-12 and r["signals"] == 2


def test_embedders(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",)], "text string").select(embed(F.col("text"), HashEmbedder).alias("v"))
    v = [r["v"] for r in df.collect()]
    assert len(v[0]) == 64 and v[1] is None and sum(v[2]) == 0
    sent = []

    def send(r):
        sent.append(r)
        if len(sent) < 3:
            raise OSError("down")
        return json.dumps({"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}).encode()

    waits = []
    assert HttpEmbedder("http://localhost/x", "m", send=send, wait=waits.append).embed_batch(["a", "b"]) == [[1], [2]] and waits == [1.0, 2.0]
    now = [0.0]
    b = Breaker(2, 60, lambda: now[0])
    b.note(False), b.note(False)
    with pytest.raises(ConnectionError):
        b.check()
    now[0] = 61
    b.check()
    with pytest.raises(ValueError):
        make_embedder("none")
