import random

from pyspark.sql import functions as F

from mnemospark.operators.history import relation_history, validity_periods
from mnemospark.operators.ranking import ranked


def test_hot_groups_get_the_same_numbers(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc") if rng.random() < 0.9 else None, rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t int, id int")
    plain = {r["id"]: r["n"] for r in ranked(df, ["k"], ["t", "id"], "n").collect()}
    split = {r["id"]: r["n"] for r in ranked(df, ["k"], ["t", "id"], "n", hot_rows=200).collect()}
    assert plain == split and len(plain) == 3000
    run = {r["id"]: r["s"] for r in ranked(df, ["k"], [F.col("t").desc(), F.col("id").asc()], "s", hot_rows=200, value="t").collect()}
    for key in ("hot", "a", None):
        total = 0
        for k, t, i in sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2])):
            total += t
            assert run[i] == total


def test_ranked_of_nothing(spark):
    assert ranked(spark.createDataFrame([], "k string, t int"), ["k"], ["t"]).count() == 0


def brute(rows):
    by = {}
    for e, t, v in rows:
        by.setdefault(e, []).append((t, v))
    out = []
    for e, tv in by.items():
        tv.sort()
        runs = [(t, v) for i, (t, v) in enumerate(tv) if i == 0 or tv[i - 1][1] != v]
        out += [(e, v, t, runs[i + 1][0] if i + 1 < len(runs) else None) for i, (t, v) in enumerate(runs)]
    return sorted(out, key=str)


def test_validity_periods_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(e, t, rng.choice(["x", "y", None])) for e in ["a", "b", None] for t in rng.sample(range(10_000), 400)] + [("one", 5, "z")]
    df = spark.createDataFrame(rows, "e string, t bigint, v string").withColumn("_bits", F.lit(1)).withColumn("valid_from", F.lit("clash"))
    for hot in (10**6, 50):
        got = sorted(((r["e"], r["v"], r["valid_from"], r["valid_to"]) for r in validity_periods(df, ["e"], ["v"], "t", hot).collect()), key=str)
        assert got == brute(rows)


R = "id bigint, subject_key string, object_key string, predicate string, confidence double, first_seen timestamp_ntz, last_seen timestamp_ntz, source_chunks array<string>, mention_count int, status string, user_id string"


def test_relation_history_edges(spark):
    import datetime as dt

    t = lambda d: dt.datetime(2024, 1, d)
    rows = [
        (1, "s", "o1", " Works-At ", 1.0, t(1), t(2), None, 1, None, "u"),
        (1, "s", "o1", " Works-At ", 1.0, t(1), t(2), None, 1, None, "u"),  # repeated
        (2, "s", "o2", "works at", 1.0, t(9), t(5), [], 1, "Active ", "u"),  # exchanged times
        (3, "s", "o2", "WORKS_AT", 1.0, t(5), t(8), None, 1, "SUPERSEDED", "u"),
        (4, "s", "o3", "works_at", 1.0, None, t(8), None, 1, "active", "u"),  # no time
        (5, "s", "o9", "works_at", 1.0, t(1), t(3), None, 1, "active", "u"),  # same time as 1, larger id
        (6, None, None, "works_at", None, t(1), t(3), None, None, "active", None),
    ]
    got = {(r["subject_key"], r["object_key"], r["status"], r["valid_from"], r["valid_to"]) for r in relation_history(spark.createDataFrame(rows, R)).collect()}
    s = lambda d: int(dt.datetime(2024, 1, d, tzinfo=dt.timezone.utc).timestamp())
    assert got == {("s", "o9", "active", s(1), s(5)), ("s", "o2", "active", s(5), s(8)), ("s", "o2", "superseded", s(8), -1), (None, None, "active", s(1), -1)}
    assert relation_history(spark.createDataFrame([], R)).count() == 0
