from datetime import datetime

from mnemospark.plans import upkeep


def test_phrases_in_texts(spark, tmp_path):
    day = datetime(2023, 5, 30, 14)
    rows = [
        ("c1", "Yesterday I ran; 3 days ago too. See you last time", day), ("c2", "nothing of the kind", day), ("c3", "It was 2  weeks ago", day), ("c4", "no day: today", None),
        ("c5", "a few days ago, last week and lately", day), ("c1", "Yesterday I ran; 3 days ago too. See you last time", day), ("c6", "todays news", day), ("c7", None, day), ("c8", "123456789012 days ago, 99999 years ago, 1 year ago", day),
    ]
    spark.createDataFrame(rows, "chunk_id string, text string, timestamp timestamp").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {r["chunk_id"]: r["text"] for r in upkeep.text_with_dates(spark, str(tmp_path)).collect()}
    assert got == {
        "c1": "on 29 May 2023 I ran; on 27 May 2023 too. See you last time", "c3": "It was on 16 May 2023", "c5": "on 28 May 2023, on 23 May 2023 and on 27 May 2023",
        "c8": "123456789012 days ago, 99999 years ago, on 30 May 2022",
    }
