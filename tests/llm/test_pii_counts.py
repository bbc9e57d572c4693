import numpy as np
import pytest

from mnemospark.llm import pii


def rows(n):
    # 30 texts have a word before Quay of their own; "harbour" is written small in the same ones
    return [(f"c{i}", f"The refund for {'abcdefghij'[i // 10 % 10].upper()}{'klmnopqrst'[i % 10]}un Quay is in the harbour now." if i < 30 else f"Nothing is due on day {i}.") for i in range(n)]


def test_all_words_are_counted(spark):
    df = spark.createDataFrame([*rows(600), ("n", None), ("e", "")], "chunk_id string, text string")
    names = spark.createDataFrame([("Fenna", "given"), ("Meskind", "family"), (None, "given")], "name_text string, name_kind string")
    got = pii.train(df, names, "text").lexicon
    base = pii.fitted(pii.TRAINING_TEXTS, ()).lexicon.counts
    assert np.allclose(got.counts - base, pii.local_counts([t for _, t in rows(600)]), atol=1.01)  # counts of one half at most are dropped
    assert (got.given, got.family) == ({"fenna"}, {"meskind"})
    small, capital, second, variety = got.counts[:, pii.slot("quay")] - base[:, pii.slot("quay")]
    assert (capital, second, variety) == (30, 30, 30)


def test_counts_hold_alike_at_every_size(spark):
    def counts(times):
        df = spark.createDataFrame(rows(600) * times, "chunk_id string, text string")
        return {(r["kind"], r["at"]): (r["n"], r["variety"]) for r in pii.word_counts(df, "text", 600 * times, base=600).collect()}

    one, eight = counts(1), counts(8)
    assert eight[0, pii.slot("harbour")][0] == pytest.approx(one[0, pii.slot("harbour")][0])
    # on average 1 - (7 / 8) ** 8 of the words before it are met in an eighth of the texts
    assert eight[2, pii.slot("quay")][1] == pytest.approx(30 * (1 - (7 / 8) ** 8))
    assert one[2, pii.slot("quay")] == (30, 30)
