import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemospark.llm import bpe, split

pieces = split.pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?\n#é\u0301雪\u200d", max_size=600), st.integers(5, 60), st.integers(0, 4))
def test_pieces_join_to_the_text(text, limit, overlap):
    got = pieces(text, limit, overlap)
    assert "".join(p[o:] for _, o, p in got) == text
    if len(text) > limit:
        assert all(len(p) <= limit and o <= overlap for _, o, p in got) and all(text[s : s + len(p)] == p for s, _, p in got)
        assert got[0][1] == 0


def test_cuts_at_natural_boundaries():
    text = "\n\n".join(" ".join(f"Word{i} stands in sentence {j}." for j in range(8)) for i in range(12))
    got = pieces(text, 300, 40)
    assert all(p.rstrip().endswith(".") for _, _, p in got)
    assert all(text[s - 1].isspace() for s, _, _ in got[1:])
    with pytest.raises(ValueError):
        pieces("abc", 2, 2)


def prose(n, seed=0):
    rng, out = random.Random(seed), ""
    while len(out) < n:
        out += " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(8)).capitalize() + ". "
    return out[: n - 1] + "."


def test_the_coarsest_boundary_that_fits_is_taken():
    # two paragraphs of 939 characters each: a piece each, the second with a shorter overlap
    a, b = prose(937, 1) + "\n\n", prose(939, 2)
    got = pieces(a + b)
    assert [p[o:] for _, o, p in got] == [a, b] and 0 < got[1][1] <= 61
    # units of up to the limit stay whole
    c = prose(1000, 3)
    assert [p[o:] for _, o, p in pieces(a + c + "\n\n" + b)][:2] == [a, c + "\n\n"] or pieces(a + c[:-2] + "\n\n" + b)[1][2].endswith(c[:-2] + "\n\n")
    # sections are cut at their headings
    one, two, three = (f"# Part\n{prose(n, n)}\n" for n in (390, 980, 391))
    assert [p[o:] for _, o, p in pieces(one + two + three)] == [one, two, three]
    # a section over the limit goes by paragraphs, and only its own inside is cut there
    paragraphs = [prose(420, i) + "\n\n" for i in range(5)]
    text = one + "# Long\n\n" + "".join(paragraphs) + "\n# Last\n" + prose(300, 9)
    cuts = {s + o for s, o, _ in pieces(text)[1:]}
    assert cuts <= set(split.boundaries(text)[1]) and len(one) in cuts


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["word ", "End. ", "line\n", "para\n\n", "sec\n\n\n", "x" * 30]), max_size=60))
def test_no_finer_cut_where_a_coarser_one_is_in_reach(parts):
    text = "".join(parts)
    levels = split.boundaries(text)
    got = pieces(text, 80, 10)
    for (s, o, p), (t, q, _) in zip(got, got[1:]):
        fresh, cut = s + o, t + q
        for level in levels:
            inside = [e for e in level if fresh < e <= fresh + 80 - (10 if fresh else 0)]
            if inside:
                assert cut in level
                break


def test_split_oversized_rows(spark):
    rows = [("a", "x" * 2500, 1), ("b", None, 2), ("c", "", 3), ("d", "short", 4), ("a", "x" * 2500, 5), (None, "y " * 600, 6), ("e", "z" * 1000, 7)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, piece_no int")
    out = split.split_oversized(df).collect()
    by = {}
    for r in out:
        by.setdefault(r["chunk_id"], []).append(r)
    assert set(by) == {"a", None} and len(by["a"]) == 2 * len(pieces("x" * 2500))
    assert all(len(r["text"]) <= 1000 for r in out) and min(r["piece_no"] for r in out) == 1
    assert split.split_oversized(df.limit(0)).count() == 0


PATH = bpe.DEFAULT_VOCABULARY


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_encoding_equals_the_library(reference):
    rng = random.Random(3)
    letters = " \n\t\u00a0\u3000\x1c\x85\u200b\r\x0b'sabé雪0½²9.,\u0301👍<|>\\{}$"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(4000)] + ["<|endoftext|> x", "a" * 3000, "don't they'll  I've", ""]
    units = bpe.units_of(PATH)
    import numpy as np

    for t, e in zip(texts, reference.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(bpe.encode(t, units), np.int32).tolist() == e.ids, repr(t)


def test_merge_takes_the_leftmost_lowest_rank():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259}
    assert bpe.merge(b"abcab", ranks) == [258, 256]
    assert bpe.merge(b"aaa", ranks) == [259, 97]
    assert bpe.merge(b"c", ranks) == [99]


def test_encode_corpus_edges(spark, reference):
    rows = [(1, "hello world", 5), (2, None, 5), (3, "", 5), (3, "", 5), (4, "<|endoftext|>", 5), (None, "雪", 5), (6, "x" * 40_000, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = sorted(((r["doc_id"] or 0, r["ids"]) for r in bpe.encode_corpus(df).collect()), key=lambda r: r[0])
    assert [g[0] for g in got] == [0, 1, 2, 3, 3, 4, 6] and got[2][1] == [] and got[3][1] == []
    assert got[1][1] == reference.encode("hello world").ids and got[5][1] == reference.encode("<|endoftext|>").ids
    n = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df).collect()}
    assert n[1] == 2 and n[2] == 0 and n[6] == len(got[6][1])
    assert bpe.encode_corpus(df.limit(0)).count() == 0
