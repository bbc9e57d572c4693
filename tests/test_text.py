from pyspark.sql import functions as F

from mnemospark.functions import decay as D
from mnemospark.functions import temporal as TM
from mnemospark.functions import text as T


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


def test_sentences_and_windows(spark):
    c = F.col("text")
    assert one(spark, "One here. Two there! Three? four", T.sentences(c)) == ["One here.", "Two there!", "Three? four"]
    assert one(spark, "A a. B b. C c. D d.", T.windows(T.sentences(c))) == ["A a. B b. C c.", "C c. D d."]
    assert one(spark, "A a.", T.windows(T.sentences(c))) == ["A a."]
    assert one(spark, "", T.windows(T.sentences(c))) == []
    assert one(spark, None, T.sentences(c)) is None


def test_tokens_counts_and_names(spark):
    c = F.col("text")
    assert one(spark, "Hello, wörld_1! it's", T.tokens(c)) == ["hello", "wörld_1", "it", "s"]
    assert one(spark, "one two three four", T.token_count(c)) == 5
    assert one(spark, "", T.token_count(c)) == 1
    assert one(spark, "Ann Smith met Bob2 and Élise near Oslo", T.proper_nouns(c)) == ["Ann Smith", "Oslo"]
    assert one(spark, "  The  Old   Mill's ", T.normalize_name(c)) == "Old Mill"
    assert one(spark, "the build_agent at NASA runs mySql 42 on Kafka", T.distinctive_tokens(c)) == ["42", "build_agent", "kafka", "mysql", "nasa"]


def test_names_of_many_parts(spark):
    n = 20_000
    snake, camel, proper = "a" + "_b" * n, "a" + "Bc" * n, "Ab" + " Cd" * n
    assert one(spark, snake, T.distinctive_tokens(F.col("text"))) == [snake]
    assert one(spark, camel, T.distinctive_tokens(F.col("text"))) == [camel.lower()]
    assert one(spark, proper, T.proper_nouns(F.col("text"))) == [proper]
    assert one(spark, proper + " Ef2 Gh", T.proper_nouns(F.col("text"))) == [proper, "Gh"]
    assert one(spark, "Ann  Smith2 Éa Bo_ Cy\nDan Eva-Lou aXb x_y_ a_b", T.distinctive_tokens(F.col("text"))) == ["a_b", "ann", "axb", "cy dan eva", "lou"]


def test_importance_orders_texts(spark):
    rows = [("I lead our team at Oslo Labs and must remember the key 42",), ("ok thanks",)]
    got = [r["i"] for r in spark.createDataFrame(rows, "text string").select(T.importance(F.col("text"), F.lit(0.5)).alias("i")).collect()]
    assert 0.1 <= got[1] < got[0] <= 1.0


def test_intent_weights_are_shares(spark):
    rows = [("what is the current status now",), ("the exact value and specific number",), ("tell me about everything",), ("",)]
    for r in spark.createDataFrame(rows, "text string").select(*[v.alias(k) for k, v in T.intent_weights(F.col("text")).items()]).collect():
        assert abs(sum(r) - 1) < 1e-9 and min(r) >= 0


def test_decay(spark):
    df = spark.createDataFrame([(0.8, "2024-01-01 00:00:00", "2024-01-11 00:00:00")], "c double, a string, b string")
    r = df.select(D.days_between(F.col("a").cast("timestamp"), F.col("b").cast("timestamp")).alias("d"), D.reinforced(F.col("c"), F.lit(2)).alias("r"), D.superseded(F.col("c")).alias("s"), D.decay_tier(F.lit("is_a"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("t")).first()
    assert r["d"] == 10 and abs(r["r"] - 0.872) < 1e-12 and abs(r["s"] - 0.24) < 1e-12 and r["t"] == "identity"


def test_markers_drop_dates_that_are_none(spark):
    got = one(spark, "on 2024-02-30 or 2024-02-29, nowadays", TM.markers(F.col("text"), F.lit("2024-06-15").cast("date")))
    assert [m["matched"] for m in got] == ["2024-02-29"]
