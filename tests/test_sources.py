import datetime as dt
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.config import Config
from mnemospark.operators import extract, ivf
from mnemospark.sources import embedders as E
from mnemospark.sources import files
from mnemospark.sources.store import MemoryStore
from mnemospark.streaming.ingest import TURN, profile_stream, turn_batch_stream


def at(n):
    return dt.datetime(2024, 1, 1, 0, n)


def test_settings(tmp_path):
    assert Config.read(tmp_path / "none.json") == Config()
    (tmp_path / "c.json").write_text(json.dumps({"retrieval": {"token_budget": 100}, "data_dir": "x", "semantic": None}))
    c = Config.read(tmp_path / "c.json")
    assert c.retrieval.token_budget == 100 and c.retrieval.episodic_weight == 0.4 and c.data_dir == "x"
    with pytest.raises(ValueError):
        Config.of({"nothing": {}})
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(yaml.safe_dump({"episodic": {"chunk_overlap": 2}}))
    assert Config.read(tmp_path / "c.yaml").episodic.chunk_overlap == 2


def test_breaker_forgets_and_connectors_speak_their_forms():
    now = [0.0]
    b = E.Breaker(3, 10, lambda: now[0])
    for t in (0.0, 6.0, 12.0):  # three failures, not within ten seconds
        now[0] = t
        b.note(False)
    b.check()
    now[0] = 15.0
    b.note(False)
    with pytest.raises(ConnectionError):
        b.check()
    b.note(True)
    b.check()
    got = []
    answers = {"ollama": {"embeddings": [[1.0], [2.0]]}, "openai": {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}, "voyage": {"data": [{"embedding": [1.0]}, {"embedding": [2.0]}]}}
    for kind, form, path in (("ollama", "ollama", "/api/embed"), ("openai", "openai", "/embeddings"), ("anthropic", "voyage", "/embeddings")):
        e = E.make_embedder(kind, key="k", send=lambda r, form=form: got.append((r.full_url, json.loads(r.data))) or json.dumps(answers[form]).encode())
        assert e.embed_batch(["a", "b"]) == [[1.0], [2.0]] and got[-1][0].endswith(path)
    assert got[-1][1]["input_type"] == "document"
    assert E.detect([("ollama", lambda: (_ for _ in ()).throw(OSError())), ("local", lambda: False), ("openai", lambda: True)]) == "openai"
    with pytest.raises(RuntimeError):
        E.detect([("local", lambda: False)])
    assert E.LocalEmbedder("m", load=lambda m: type("M", (), {"encode": lambda self, x: [[len(t)] for t in x]})()).embed_batch(["ab"]) == [[2.0]]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("  ")
    t = files.read_texts(spark, str(tmp_path / "*.txt"), "u").collect()
    assert [(r["text"], r["user_id"]) for r in t] == [("one\ntwo", "u")]
    data = {"sample_id": "s", "sessions": [{"session_id": "s1", "date_time": "7 May 2023", "turns": [{"speaker": "Ann", "text": "hi"}, {"speaker": "Bob", "text": "ho"}]}], "qa": [{"question": "q", "answer": "a", "category": 2}, {"question": "x", "answer": "y", "category": 5}]}
    (tmp_path / "l.json").write_text(json.dumps(data))
    s = files.read_sessions(spark, str(tmp_path / "l.json")).orderBy("ts").collect()
    assert [(r["turn_id"], r["speaker"], str(r["ts"])) for r in s] == [("s/s1/0", "Ann", "2023-05-07 00:00:00"), ("s/s1/1", "Bob", "2023-05-07 00:01:00")]
    assert [r["question"] for r in files.read_questions(spark, str(tmp_path / "l.json")).collect()] == ["q"]


def test_migration_of_a_folder_per_user(spark, tmp_path):
    path = str(tmp_path / "store")
    old = spark.createDataFrame([("u", "a", "1", 1, at(1), 1, False), ("v", "a", "2", 1, at(1), 2, False)], "user_id string, key string, value string, priority bigint, written_at timestamp, seq bigint, deleted boolean").withColumn("entry_type", F.lit(None).cast("string"))
    old.write.partitionBy("user_id").parquet(f"{path}/explicit")
    s = MemoryStore(spark, path)
    assert s.version() == 1 and s.migrate() == [2] and s.version() == 2 and s.migrate() == []
    assert {(r["user_id"], r["value"]) for r in s.state("explicit").collect()} == {("u", "1"), ("v", "2")}
    s.erase("u")
    assert {r["user_id"] for r in s.state("explicit").collect()} == {"v"} and s.explicit("v").count() == 1
    assert MemoryStore(spark, str(tmp_path / "new")).migrate() == []


def test_extraction(spark):
    class Words:
        """A vector with a place per seed word: enough to tell seeds apart."""

        PLACES = "colleague company tool project idea city works_at leads uses lives".split()

        def embed_batch(self, texts):
            return [[float(p in t.lower().replace("works at", "works_at")) + 1e-9 for p in self.PLACES] for t in texts]

    df = spark.createDataFrame([("a", "Ann Lee works at Zorin. Nobody came."), ("b", "nothing here"), ("c", None), ("d", "I use python and Docker daily.")], "chunk_id string, text string")
    rows = extract.EmbeddingExtractor(Words)(df).collect()
    assert [(r["subject"], r["predicate"], r["object"]) for r in rows if r["kind"] == "relation" and r["chunk_id"] == "a"] == [("Ann Lee", "works_at", "Zorin")]
    assert {r["name"]: r["type"] for r in rows if r["chunk_id"] == "d"}.items() >= {"python": "tool", "Docker": "tool"}.items()
    assert not [r for r in rows if r["chunk_id"] in ("b", "c")] and extract.EmbeddingExtractor(Words)(df.limit(0)).count() == 0


def test_parsed_answers(spark):
    said = ['Sure: {"entities": [{"name": "Ann", "type": "person"}, {"type": "x"}, {"name": "Z"}], "relations": [{"subject": "Ann", "predicate": "Employed by", "object": "Z"}, {"subject": "Ann"}]} ok', "no object", None]
    r = [x["p"] for x in spark.createDataFrame([(s,) for s in said], "a string").select(extract.parsed_answer(F.col("a")).alias("p")).collect()]
    assert [(e["name"], e["type"]) for e in r[0]["entities"]] == [("Ann", "person"), ("Z", "concept")]
    assert [(x["subject"], x["predicate"], x["object"], x["confidence"]) for x in r[0]["relations"]] == [("Ann", "works_at", "Z", 0.8)] and r[1] is None and r[2] is None


def test_inverted_file(spark):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(8, 64)), 60, axis=0) + rng.normal(scale=0.4, size=(480, 64))
    df = spark.createDataFrame([(f"r{i:03d}", v.tolist()) for i, v in enumerate(x)] + [("bad", [1.0]), ("null", None)], "id string, vector array<float>")
    c = ivf.kmeans(df, k=8, iterations=10)
    assert np.allclose(np.linalg.norm(c, axis=1), 1) and len(c) == 8
    q = df.filter("id like 'r__0'").withColumnRenamed("id", "query_id")
    got = {(r["query_id"], r["id"]) for r in ivf.ivf_search(q, df, c, 5).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = set()
    for i in range(0, 480, 10):
        s = u @ u[i]
        s[i] = -2
        want |= {(f"r{i:03d}", f"r{j:03d}") for j in np.argsort(-s)[:5]}
    assert len(got & want) >= 0.9 * len(want)
    assert len(ivf.kmeans(df.limit(0))) == 0


def run(df, mode, spark, path, name):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_late_signals_take_their_place(spark, tmp_path):
    src, sch = str(tmp_path / "s"), "user_id string, dimension string, signal double, ts timestamp"
    for rows in ([("u", "d", 1.0, at(1)), ("u", "d", 0.0, at(30))], [("u", "d", 0.5, at(10))]):
        spark.createDataFrame(rows, sch).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files are taken by their time
    stream = spark.readStream.schema(sch).option("maxFilesPerTrigger", 1).parquet(src)
    last = [r["value"] for r in run(profile_stream(stream), "update", spark, str(tmp_path / "cp"), "late").collect()][-1]
    v = 0.5
    for s in (1.0, 0.5, 0.0):
        v = v * 0.8 + s * 0.2
    assert abs(last - v) < 1e-12


def test_batches_of_five_in_a_stream(spark, tmp_path):
    src = str(tmp_path / "t")
    spark.createDataFrame([(f"t{i:02d}", "u", "c", "user", f"turn number {i} of this talk" if i % 4 else "short", at(i)) for i in range(16)], TURN).coalesce(1).write.parquet(src)
    got = run(turn_batch_stream(spark.readStream.schema(TURN).parquet(src)), "append", spark, str(tmp_path / "cp"), "batches").orderBy("batch").collect()
    assert [(r["batch"], r["text"].count("\n")) for r in got] == [(0, 4), (1, 4)]
