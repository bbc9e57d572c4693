import random
from collections import defaultdict

from mnemospark.operators.graph import greedy_groups


def one_by_one(pairs):
    peers, seen, out = defaultdict(set), set(), set()
    for a, b in pairs:
        peers[a].add(b)
        peers[b].add(a)
    for c in sorted(peers):
        if c not in seen and len(peers[c]) >= 2:
            seen |= {c} | peers[c]
            out |= {(c, m) for m in {c} | peers[c]}
    return out


def test_groups_equal_the_greedy_loop(spark):
    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample([f"c{i:02d}" for i in range(60)], 2))) for _ in range(70)} | {("hub", f"m{i:02d}") for i in range(14)}
    got = [(r["seed"], r["node"]) for r in greedy_groups(spark.createDataFrame(sorted(pairs), "a string, b string"), "a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == one_by_one(pairs)
    assert len([x for x in got if x[0] == "hub"]) == 15  # no member is cut
    assert greedy_groups(spark.createDataFrame([("a", "b")], "a string, b string"), "a", "b").count() == 0
