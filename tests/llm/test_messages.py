import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import history_dedup as H
from mnemospark.llm.messages import same_message, words
from mnemospark.session import new_table_path


def test_same_message():
    a = "If Joniar Ridge agrees, copy the side letter by 2024-05-04. Done: 9389 items of the witness line are tested after two attempts."
    same = [
        a.upper(), a.replace("the side", "side"), a.replace(" ", "\xa0"), a.replace("copy", "cpoy"), "FYI: " + a, a + " sent from my phone", a.replace("2024-05", "2024‑05"),
        "Done: 9389 items of the witness line are tested after two attempts. If Joniar Ridge agrees, copy the side letter by 2024-05-04.", a.replace("9389", "9,389"), a.replace("2024-05-04", "4 May 2024"), a.replace("2024-05-04", "May 4, 2024"),
    ]
    other = [a.replace("9389", "9388"), a.replace("2024-05-04", "2024-05-05"), a.replace("2024-05-04", "4 June 2024"), a.replace("Joniar Ridge", "Hebriand Atlas"), a.replace("agrees", "never agrees"), a.replace("copy", "burn"), "Quite another text on 9389 and 2024-05-04 here."]
    assert [b for b in same if not same_message(a, b)] == []
    assert [b for b in other if same_message(a, b)] == []
    assert not same_message("We meet on Monday after the long call", "We meet on Sunday after the long call")
    assert same_message("I've sent the signed form to the desk", "I have sent the signed form to the desk")


@pytest.mark.parametrize("a,b", [("see you at 3pm in the big lobby", "see you at 3 pm in the big lobby"), ("it comes to 1,000 for the lot", "it comes to 1000 for the lot"), ("we need it by 2024-05-04 at the latest", "we need it by 4 May 2024 at the latest")])
def test_spellings_of_numbers_meet_under_one_root(spark, a, b):
    assert same_message(a, b) and words(a) == words(b)
    df = spark.createDataFrame([("a", "u", a, None), ("b", "u", b, None)], "chunk_id string, user_id string, text string, vector array<float>")
    assert H.route(df, 16).select("root").distinct().count() == 1


def greedy(rows):
    kept, out = [], set()
    for r in sorted(rows, key=lambda r: (r["batch_no"], r["chunk_id"])):
        if r["text"] is None or len(r["text"]) < 25:
            continue
        if r["batch_no"] > 0 and any(k["user_id"] == r["user_id"] and same_message(k["text"], r["text"]) for k in kept):
            out.add(r["chunk_id"])
        else:
            kept.append(r)
    return out


def make(seed=1):
    rng = random.Random(seed)
    nouns = "refund rollout invoice greenhouse metronome vaccine ledger canary sourdough printer".split()
    base = [f"Please check the {rng.choice(nouns)} for {rng.choice(['Zuhon', 'Hebriand', 'Lason'])} {rng.choice(['Quay', 'Trust'])} with {rng.randrange(1000)} items because the {rng.choice(nouns)} was late. {'Then ' * (i % 3)}ask about the {rng.choice(nouns)} again." for i in range(60)]
    rows = []
    for i in range(240):
        s = rng.choice(base)
        edit = rng.choice([lambda x: x, str.upper, lambda x: x + " thanks", lambda x: x.replace("because", "becuase"), lambda x: x.replace("the ", "", 1)])
        rows.append({"chunk_id": f"c{i:03d}", "user_id": rng.choice(["u", "u", "v", None]), "batch_no": rng.choice([0, 0, 1, 2, 3]), "text": edit(s), "vector": None})
    rows += [{"chunk_id": "x1", "user_id": "u", "batch_no": 1, "text": None, "vector": None}, {"chunk_id": "x2", "user_id": "u", "batch_no": 2, "text": "", "vector": None}, {"chunk_id": "x3", "user_id": "u", "batch_no": 2, "text": "Thanks!", "vector": None}]
    return rows


SCH = "chunk_id string, user_id string, batch_no int, text string, vector array<float>, root string"


def frame(spark, rows):
    return spark.createDataFrame([(r["chunk_id"], r["user_id"], r["batch_no"], r["text"], r["vector"], "clash") for r in rows], SCH)



def test_batches_and_brute_force_agree(spark):
    """In buckets, with runs merged on the way, and by the joins of hot roots."""
    rows = make()
    df = frame(spark, rows + rows[:3])
    want = greedy(rows)
    assert len(want) > 50
    for options in ({"most_runs": 2}, {"hot_rows": 15, "most_runs": 2}):
        assert {r[0] for r in H.by_batches(df, new_table_path(spark, "t"), **options).collect()} == want, options


def test_hot_roots_with_vectors_agree(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(90):
        base = np.zeros(64)
        base[rng.integers(3)] = 1
        v = (base + rng.normal(0, 0.05, 64)).tolist() if rng.random() < 0.9 else None
        text = ["Please look at the ledger of the old office again", "Please look at teh ledger of the old office again", "Please look at the ledger of the old office again thanks", "A wholly different message about the greenhouse vents"][rng.integers(4)]
        rows.append({"chunk_id": f"c{i:03d}", "user_id": "u", "batch_no": int(rng.integers(3)), "text": text, "vector": v})
    df = frame(spark, rows)

    def near(a, b):
        return a is None or b is None or np.dot(a, b) >= 0.9 * np.linalg.norm(a) * np.linalg.norm(b)

    kept, want = [], set()
    for r in sorted(rows, key=lambda r: (r["batch_no"], r["chunk_id"])):
        f32 = None if r["vector"] is None else np.float32(r["vector"]).astype(float)
        if r["batch_no"] > 0 and any(near(k, f32) and same_message(t, r["text"]) for k, t in kept):
            want.add(r["chunk_id"])
        else:
            kept.append((f32, r["text"]))
    for hot in (20,):
        assert {r[0] for r in H.by_batches(df, new_table_path(spark, "t"), hot_rows=hot).collect()} == want, hot


def test_copies_make_few_candidates():
    n = 1000
    t = pa.table({"chunk_id": [f"c{i:04d}" for i in range(n)], "root": pa.array([7] * n, pa.int64()), "bucket": pa.array([0] * n, pa.int32()), "text": ["the same message as before, word for word"] * n, "vec": pa.array([None] * n, pa.binary())})
    b = H.Batch(t)
    assert b.among(H.Settings(3, 0.9, 10**6)) < n and b.rejected.sum() == n - 1
    again = H.Batch(t)
    assert again.against([b.run()], H.Settings(3, 0.9, 10**6)) < n and again.closed.all() and again.rejected.sum() == n - 1


def test_a_batch_reads_its_buckets_only_and_forests_open_again(spark):
    texts = [f"message {i} about the {w} of the annexe" for i, w in enumerate(["roof", "door", "lamp", "desk"] * 60)]
    df = spark.createDataFrame([(f"c{i:03d}", f"u{i % 40}", x, None) for i, x in enumerate(texts)], "chunk_id string, user_id string, text string, vector array<float>")
    path = new_table_path(spark, "forest")
    forest = H.Forest(spark, path, buckets=64)
    first = H.materialize(H.route(df, 64))
    assert forest.ingest(first, accept_all=True).count() == 0
    forest = H.Forest(spark, path, buckets=64)
    one = H.materialize(H.route(df.filter("chunk_id = 'c005'").withColumn("chunk_id", F.lit("new")).unionByName(df.filter("chunk_id = 'c005'")), 64))
    plan = forest.plan(one, [one.first()["bucket"]])
    shown = plan._jdf.queryExecution().toString()
    assert "SelectedBucketsCount: 1 out of 8" in shown and shown.count("Exchange hashpartitioning") - shown.count("Initial") <= 3
    assert {r[0] for r in forest.ingest(one).collect()} == {"new"}
    before = forest.runs()
    forest.merge(everything=True)
    assert len(before) == 2 and len(forest.runs()) == 1
    assert forest.ingest(one).count() == 1  # "new" was rejected then and is rejected again, c005 is known
    assert {r[0] for r in forest.rejected().collect()} == {"new"}


def test_vectors_decide_and_empty_input(spark):
    text = "The ledger for Zuhon Quay is late by 12 days again"
    a, b = [1.0] * 64, [1.0] * 32 + [-1.0] * 32
    rows = [{"chunk_id": c, "user_id": "u", "batch_no": n, "text": text, "vector": v} for c, n, v in (("a", 0, a), ("b", 1, b), ("c", 1, a), ("d", None, None))]
    assert {r[0] for r in H.by_batches(frame(spark, rows), new_table_path(spark, "t")).collect()} == {"c", "d"}
    assert H.by_batches(frame(spark, rows).limit(0), new_table_path(spark, "t")).count() == 0
