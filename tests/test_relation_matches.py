import re

from mnemospark.plans import knowledge


def test_all_patterns_and_all_matches(spark, tmp_path):
    texts = {
        "c1": "Ann works on Spark. Bob is the owner, and Eve leads storage.",
        "c2": "team alpha using Redis, Zoe preferring tea. Kim researches bees. Max managing Oslo",
        "c3": "Nothing here.",
        "c4": "Ann is a\nfriend of Bob",
    }
    spark.createDataFrame(list(texts.items()) + [("c3", "Nothing here."), ("c5", None)], "chunk_id string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = sorted(tuple(r)[:2] + tuple(r)[3:] for r in knowledge.relation_matches(spark, str(tmp_path)).collect())
    assert got == [
        ("c1", "is_a", "Bob", "owner"), ("c1", "leads", "and Eve", "storage"), ("c1", "works_on", "Ann", "Spark"),
        ("c2", "manages", "Max", "Oslo"), ("c2", "prefers", "Zoe", "tea"), ("c2", "researches", "Kim", "bees"), ("c2", "uses", "team alpha", "Redis"), ("c4", "is_a", "Ann", "friend of Bob"),
    ]


def test_equals_plain_search():
    text = "Ann uses Bob uses tea. we use x using y, Lee leads a\nb. The dog is a cat, is the end. " * 3
    for predicate, cue in knowledge.RELATION_CUES.items():
        plain = re.compile(rf"(\b[A-Z]\w+(?:\s+[A-Z]\w+)*)\s+{cue}\s+(.+?)(?:\.|,|$)", re.IGNORECASE)
        assert [r[1:] for r in knowledge.relations_in(text) if r[0] == predicate] == [(m.start(), m.group(1).strip(), m.group(2).strip()) for m in plain.finditer(text)]
