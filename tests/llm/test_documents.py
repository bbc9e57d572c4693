import math

import pytest
from pyspark.sql import functions as F

from mnemospark.llm import mixing as M
from mnemospark.llm import truncation as T


def test_budgets_respect_limits_and_shares():
    sizes = {"a": 1000, "b": 100, "c": 500, "d": 0}
    got = M.budgets({"a": 1.0, "b": 1.0, "c": 2.0, "d": 5.0, "e": 1.0}, sizes, dict.fromkeys("abcde", 2), 1200)
    assert got["b"] == 200 and got["d"] == 0 and got["e"] == 0 and abs(sum(got.values()) - 1200) <= 2 and abs(got["c"] - 2 * got["a"]) <= 2
    assert sum(M.budgets({"a": 1.0}, {"a": 10}, {"a": 3}, 1000).values()) == 30
    assert M.budgets({"a": 0.0}, {"a": 10}, {"a": 3}, 1000) == {"a": 0}


def test_tempering_meets_entropy_and_repetition():
    sizes = {"a": 8000, "b": 1000, "c": 100, "d": 0}
    a, w = M.tempered(sizes, entropy=0.9)
    assert 0 < a < 1 and abs(-sum(x * math.log(x) for x in w.values() if x) - 0.9) < 1e-6 and w["d"] == 0
    a, w = M.tempered(sizes, max_repeats=4)
    assert max(w[s] * 9100 / sizes[s] for s in "abc") <= 4.0001
    assert M.tempered({}, entropy=1.0) == (1.0, {})


def test_tempering_towards_targets_is_further_than_budgets():
    """Where a repetition limit binds, tempering moves all sources, budgets only the one that is capped."""
    want, size = {"web": 0.4, "code": 0.3, "books": 0.2, "wiki": 0.1}, {"web": 10_000_000, "code": 2_000_000, "books": 500_000, "wiki": 900_000}
    most, total = dict.fromkeys(want, 3), 8_000_000
    a, w = M.towards_targets(want, size, most, total)
    got = M.budgets(want, size, most, total)
    assert 0 < a < 1 and max(w[s] * total / size[s] for s in want) == pytest.approx(3)
    far = lambda x: sum(abs(x[s] / sum(x.values()) - want[s]) for s in want) / 2
    assert far(got) < far(w) and all(got[s] <= 3 * size[s] for s in want)
    assert M.towards_targets(want, size, dict.fromkeys(want, 100), total)[0] == 0.0
    assert M.towards_targets({}, {}, {}, 1.0) == (0.0, {})


TG = "mix_name string, source string, target_weight double, max_repeats int, total_ratio double"


@pytest.mark.parametrize("block_docs", [10**6, 100])
def test_draw_is_whole_and_near_the_budget(spark, block_docs):
    docs = spark.createDataFrame([(i, "big" if i % 3 else "small", 10 + i % 7, "x") for i in range(3000)] + [(9001, None, 50, "x"), (9002, "big", 0, "x")], "doc_id bigint, source string, n_tokens bigint, repeats string").select("doc_id", "source", "n_tokens")
    size = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    out = M.draw(docs, [("m", "big", size["big"] // 3), ("m", "small", int(2.5 * size["small"])), ("m", "none", 100)], block_docs=block_docs)
    got = {r["source"]: (r["t"], r["lo"], r["hi"]) for r in out.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("t"), F.min("repeats").alias("lo"), F.max("repeats").alias("hi")).collect()}
    assert abs(got["big"][0] - size["big"] // 3) <= 20 and got["big"][1:] == (1, 1)
    assert abs(got["small"][0] - int(2.5 * size["small"])) <= 20 and got["small"][1:] == (2, 3)
    assert sorted(out.collect()) == sorted(M.draw(docs, [("m", "big", size["big"] // 3), ("m", "small", int(2.5 * size["small"]))], block_docs=block_docs).collect())


def test_mix_edges(spark):
    targets = spark.createDataFrame([("m", "a", 1.0, 1, 1.0), ("m", "b", 1.0, 1, 1.0), (None, "a", 1.0, 1, 1.0), ("n", None, 1.0, 1, 1.0)], TG)
    docs = spark.createDataFrame([(1, "a", 10), (1, "a", 10), (2, None, 5)], "doc_id bigint, source string, n_tokens bigint")
    out = M.mix(docs, targets)
    assert out.agg(F.sum("repeats")).first()[0] == 2
    s = {r["source"]: r for r in M.shares(out, targets.filter("mix_name = 'm'")).collect()}
    assert s["a"]["share"] == 1.0 and s["b"]["tokens"] == 0
    assert M.mix(docs.limit(0), targets).count() == 0


GOOD = r"""\documentclass{article}
\begin{document}
\section{One}

""" + "\n\n".join(f"The map {i} is smooth near the value $x_{{{i}}}$. We show that it holds, cf.\\ Sec.~\\ref{{s:{i}}}." for i in range(30)) + r"""

\begin{thebibliography}{9}
\bibitem{a} A. Author, \emph{Title}, J. Some 12 (2001) 14--29.

\bibitem{b} B. Author, \emph{Title}, J. Some 12 (2001) 604--630
\end{thebibliography}
\end{document}
"""
BODY = GOOD.split("\\begin{thebib")[0]


def test_truncated_texts(spark):
    cut = [
        BODY.rstrip()[:-30], BODY + "The map is sm", BODY + "The map is smooth near the", BODY + "The map is smooth ne...", BODY + "The map $x_{3", BODY + "The map is smo\n[truncated]", BODY + "The map is smo\n\\end{document}\n",
        BODY + "\\begin{equation}\n a = b + c", BODY + "The map is smooth \ufffd\ufffd", BODY + "The map is\n%% transfer aborted", GOOD.split("604")[0] + "604--63", GOOD.split("A. Author")[0] + "A. Au",
    ]
    whole = [
        GOOD, BODY, GOOD.replace("\\end{document}\n", ""), BODY + "% a comment that ends in the mid", GOOD + "% eof", GOOD.rstrip(), BODY + "We leave it there, etc...", BODY + "What then\\ldots", "Withdrawn by the authors.",
        "\\endinput\n", "", "  \n", None, BODY.replace("\n", "\r\n"),
    ]
    rows = [(i, s, "en", "a" if i % 2 else None, 1.0) for i, s in enumerate(cut + whole)] + [(100 + i, GOOD.replace("map", f"map{i}"), "EN", "a", 1.0) for i in range(30)] + [(0, cut[0], None, None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, cut double")
    out = T.truncated(df)
    got = {r["doc_id"] for r in out.filter("cut").collect()}
    assert got == set(range(len(cut)))
    assert out.count() == len(rows)
    assert sum(r["texts"] for r in T.rates(out).collect()) == len(rows)
    assert T.truncated(df.limit(0)).count() == 0


def test_other_bibliographies_are_whole(spark):
    """A style of entries that doesn't end with pages is learnt from the corpus; cut ones are found all the same."""
    books = "\n\n".join(f"\\bibitem{{k{i}}} A. Author, \\emph{{Title {i}}}, Addison-Wesley, 19{60 + i}." for i in range(12))
    text = BODY + "\\begin{thebibliography}{9}\n" + books
    rows = [(i, text.replace("map", f"map{i}") + "\n\\end{thebibliography}\n\\end{document}\n", "en", "a") for i in range(30)]
    rows += [(100, text, "en", "a"), (101, text[:-22], "en", "a"), (102, BODY.upper() + "\\BEGIN{EQUATION}\n A = B.", "en", "a"), (103, BODY + "\\begin{equation}\n\\begin{small}\n a = b.", "en", "a")]
    got = {r["doc_id"] for r in T.truncated(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).filter("cut").collect()}
    assert got == {101, 102, 103}


def test_structure_is_counted_at_all_places(spark):
    """The counts are those of judging every prefix of every text, one by one."""
    items = "".join(f"\\bibitem{{k{i}}} A. B-{i}, \\emph{{T_{i}}}, J. Longitudinal-Electrodynamics Characterization Measurement {i}4 (2001) 1{i} -- 12, {i}99--602.\n\n" for i in range(5))
    odd = "\\begin{thebibliography}{9}\n" + items + "\\end{thebibliography}\nA\\$ $x\\{_{a}$ % $ {\n\\\\[2pt] \\[ y \\] \\( z\r\n\r\n { \\\\{ 5\\% \n \n} \\begin{Align*}\\begin{small} $\n\n \\end{align*} so\n\nEnd of it.\n\nCut"
    texts = [GOOD, BODY, odd, "Nothing ends here", "\n\n"]
    want: dict[tuple[int, int], list[int]] = {}
    for s in texts:
        ends, envs = [m.start() for m in T.UNIT_END.finditer(s)], T._environments(s)
        for at, j in [(x, 0) for x in ends[:-1]] + [(x, 1) for x in range(ends[-1] if ends else 0)]:
            for what, value in zip((T.FORMULAS, T.GROUPS), T.open_parts(s[:at].rstrip(), envs)):
                want.setdefault((what, int(value)), [0, 0])[j] += 1
        starts = [m.start() for m in T.ENTRY.finditer(s)] if ends else []
        for lo, hi in zip(starts, starts[1:]):
            for at in range(lo + 8, hi + 1):
                shape = T.entry_shape(s[max(0, at - 3_000) : at].rstrip())
                if shape is not None:
                    want.setdefault((T.SHAPES, T.xxhash.xxh64_intdigest(shape) >> 1), [0, 0])[at < hi] += 1
    got = T.context_counts(spark.createDataFrame([(s, "en") for s in texts], "text string, lang string").coalesce(1), "text", "lang")
    found = {(what, int(i)): [int(e), int(n)] for what in (T.FORMULAS, T.GROUPS, T.SHAPES) for i, e, n in zip(*got[what])}
    assert {k: v for k, v in found.items() if any(v)} == want
