import datetime as dt
import json
import random

from mnemospark.llm import conversations as C

CH = "chunk_id string, vector array<float>, text string, timestamp timestamp_ntz, conversation_id string, speaker string, extra string, user_id string, batch_no int, role string"
t = lambda n: dt.datetime(2024, 1, 1, 0, n)


def row(cid, conv, speaker, text, when, to=None, user="u", batch=0, extra=None):
    return (cid, None, text, when, conv, speaker, extra if extra is not None else json.dumps({"reply_to": to}) if to else None, user, batch, "clash")


def aliases(spark):
    return spark.createDataFrame([("user", "user"), ("ai", "assistant"), ("sys", "system"), ("tool", "tool")], "alias_text string, speaker_role string")


def test_sound_conversations(spark):
    rows = [
        row("a1", "A", "User:", "q", t(1)), row("a2", "A", " AI ", "r", t(1), "a1"), row("a3", "A", "sys", "s", t(1)), row("a4", "A", "user", " \u200b\xa0", t(2)), row("a1", "A", "User:", "q", t(1), batch=3),
        row("b1", "B", "user", "q", t(1)), row("b2", "B", "ai", "r", None),
        row("c1", "C", "user", "q", t(1)), row("c2", "C", "who", "r", t(2)),
        row("d1", "D", "user", "q", t(1)), row("d2", "D", "ai", "r", t(2), user="v"),
        row("e1", "E", "user", "q", t(1)), row("e2", "E", "ai", "r", t(2), "a1"),
        row("f1", "F", "user", "q", t(1)), row("f2", "F", "ai", "r", t(2)), row("f3", "F", "user", "q2", t(3)),
        row("g1", "G", "user", "q", t(1), extra='{"reply_to": "zz", "cl'), row("g2", "G", "ai", "r", t(2)),
        row("h1", "", "user", "q", t(1)), row("h2", None, "ai", "r", t(2)), row("i1", "I", "ai", None, t(1)),
    ]
    for hot in (10**6, 1):
        got = [(r["conversation_id"], r["turn_no"], r["chunk_id"]) for r in C.rebuild(spark.createDataFrame(rows, CH), aliases(spark), hot).orderBy("conversation_id", "turn_no").collect()]
        assert got == [("A", 1, "a3"), ("A", 2, "a1"), ("A", 3, "a2"), ("G", 1, "g1"), ("G", 2, "g2")]
    assert C.rebuild(spark.createDataFrame([], CH), aliases(spark)).count() == 0


def test_threads_by_pointer_jumping(spark):
    rng = random.Random(2)
    rows = [("L", f"l{i:03d}", f"l{i - 1:03d}" if i else None) for i in range(300)]
    rows += [("T", f"t{i}", f"t{rng.randrange(i)}" if i else None) for i in range(60)]
    rows += [("Z", "z1", "z2"), ("Z", "z2", "z3"), ("Z", "z3", "z1"), ("Z", "z4", "z1"), ("Z", "o1", "gone"), ("Z", "o2", "o1"), ("Z", "s", "s")]
    got = {(r["conversation_id"], r["chunk_id"]): r for r in C.resolve_threads(spark.createDataFrame(rows, "conversation_id string, chunk_id string, parent string")).collect()}
    assert len(got) == len(rows)
    assert all(got["L", f"l{i:03d}"]["depth"] == i and got["L", f"l{i:03d}"]["root"] == "l000" for i in range(300))
    parent = {c: p for k, c, p in rows if k == "T"}
    for c in parent:
        d, x = 0, c
        while parent[x]:
            x, d = parent[x], d + 1
        assert (got["T", c]["root"], got["T", c]["depth"]) == (x, d)
    assert all(got["Z", c]["cycle"] for c in ("z1", "z2", "z3", "z4", "s"))
    assert got["Z", "o2"]["orphan"] and got["Z", "o1"]["orphan"] and not got["T", "t5"]["orphan"]


def test_paths_from_roots_to_leaves(spark):
    rows = [
        row("a1", "A", "user", "q", t(1)), row("a2", "A", "ai", "r", t(2), "a1"), row("a3", "A", "user", "q2", t(3), "a2"), row("a4", "A", "ai", "r2", t(4), "a3"), row("a5", "A", "ai", "other", t(5), "a2"), row("a6", "A", "ai", "  ", t(6), "a5"),
        row("b1", "B", "user", "q", t(1)), row("b2", "B", "ai", "r", t(2), "gone"), row("c1", "C", "user", "q", t(1), "c2"), row("c2", "C", "ai", "r", t(2), "c1"), row("c3", "C", "ai", "alone", t(3)),
    ]
    got = {}
    for r in C.rebuild_paths(spark.createDataFrame(rows, CH), aliases(spark)).orderBy("conversation_id", "leaf", "turn_no").collect():
        got.setdefault((r["conversation_id"], r["leaf"]), []).append(r["chunk_id"])
    assert got == {("A", "a4"): ["a1", "a2", "a3", "a4"], ("A", "a6"): ["a1", "a2", "a5"], ("C", "c3"): ["c3"]}


def test_paths_of_long_chains_and_trees(spark):
    rng = random.Random(4)
    rows = [("L", f"l{i:03d}", f"l{i - 1:03d}" if i else None) for i in range(150)] + [("T", f"t{i}", f"t{rng.randrange(i)}" if i else None) for i in range(40)]
    msgs = spark.createDataFrame(rows, "conversation_id string, chunk_id string, parent string")
    threads, jumps = C.jump_tables(msgs)
    got = {(r["conversation_id"], r["leaf"], r["step"]): r["chunk_id"] for r in C.thread_paths(msgs, threads, jumps).collect()}
    parent = {(c, i): p for c, i, p in rows}
    leaves = set(parent) - {(c, p) for c, _, p in rows}
    want = {}
    for c, leaf in leaves:
        chain, x = [], leaf
        while x:
            chain.insert(0, x)
            x = parent[c, x]
        want |= {(c, leaf, k): x for k, x in enumerate(chain)}
    assert got == want
