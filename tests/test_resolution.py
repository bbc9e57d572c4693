import difflib
import random
from datetime import datetime

from mnemospark.plans import knowledge

ENTITIES = "entity_key string, name string, entity_type string, last_seen timestamp, mention_count int, attributes string, aliases array<string>, user_id string"


def score(a, b):
    if a == b:
        return 1.0
    if a in b or b in a:
        return 0.95 * min(len(a), len(b)) / max(len(a), len(b))
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def resolve(spark, folder, entities, mentions):
    """entities: user, key, name, aliases; mentions: user, text. What the query finds, and what a comparison of all with all does."""
    day = datetime(2024, 1, 1)
    spark.createDataFrame([(k, n, "tool", day, 1, None, al, u) for u, k, n, al in entities], ENTITIES).write.parquet(f"{folder}/entities.parquet")
    spark.createDataFrame([(f"c{i}", [t], u) for i, (u, t) in enumerate(mentions)], "chunk_id string, entity_mentions array<string>, user_id string").write.parquet(f"{folder}/chunks.parquet")
    got = {(r["user_id"], r["mention"]): (r["entity_key"], r["score"]) for r in knowledge.fuzzy_resolve(spark, str(folder)).collect()}
    want = {}
    for u, t in mentions:
        mine = [e for e in entities if e[0] == u]
        if t in {n for _, _, n, _ in mine}:
            continue
        best = max(((score(t, x), k) for _, k, n, al in mine for x in [n, *al]), default=(0, ""))
        if best[0] >= 0.8:
            want[u, t] = (best[1], round(best[0], 6))
    return got, want


def test_slip_in_the_rarest_trigram_and_alias(spark, tmp_path):
    entities = [("u", "e1", "thaewis tracker", []), ("u", "e2", "grostov planner", []), ("u", "e3", "velmund quay", ["harbour office"]), ("v", "e4", "harbour offices", [])]
    got, want = resolve(spark, tmp_path, entities, [("u", "thaestov tracker"), ("u", "harbor office"), ("u", "harbour office"), ("u", "velmund quay")])
    assert got == want
    assert got["u", "thaestov tracker"][0] == "e1" and got["u", "harbor office"][0] == "e3" and len(got) == 3


def test_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abor") for _ in range(rng.randrange(1, 9)))
    entities = [(rng.choice("uv"), f"e{i}", f"{word()} {word()}"[: rng.randrange(2, 18)].strip(), [word() + word() for _ in range(rng.randrange(3))]) for i in range(150)]
    texts = [x for _, _, n, al in entities for x in [n, *al]]

    def slip(s):
        for _ in range(rng.randrange(1, 5)):
            i = rng.randrange(len(s) + 1)
            s = s[:i] + rng.choice(["", rng.choice("abor")]) + s[i + rng.randrange(2) :]
        return s.strip()

    # words that the normal form of names changes are left out: articles, spaces in a row
    mentions = sorted({(rng.choice("uv"), t) for t in map(slip, texts * 3) if t and "  " not in t and not t.startswith("a ")})
    entities = [e for e in entities if all(t and "  " not in t and not t.startswith("a ") for t in [e[2], *e[3]])]
    got, want = resolve(spark, tmp_path, entities, mentions)
    assert got == want and len(want) > 200
