from datetime import datetime

from mnemospark.functions import lexicon as L
from mnemospark.plans import knowledge


def test_all_five_pairs(spark, tmp_path):
    def row(i, predicate, day, user="u", status="active"):
        return i, user, "ann", f"o{i}", 0.8, datetime(2024, 1, day), datetime(2024, 1, day), 1, None, predicate, status

    rows = [r for k, (p, n) in enumerate(L.NEGATIONS.items()) for r in [row(f"p{k}", p, 1), row(f"n{k}", n.replace("_", " "), 2), row(f"later{k}", p, 3), row(f"other{k}", p, 1, "v")]]
    rows += [row("q0", "works_on", 1), row("gone", "uses", 1, status="retracted")]
    schema = "id string, user_id string, subject_key string, object_key string, confidence double, first_seen timestamp, last_seen timestamp, mention_count int, source_chunks array<string>, predicate string, status string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/relations.parquet")
    got = sorted((r["winner"], r["loser"]) for r in knowledge.facts_negated(spark, str(tmp_path)).collect())
    assert got == sorted([(f"n{k}", f"p{k}") for k in range(5)] + [("n0", "q0")])
