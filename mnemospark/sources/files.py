"""Sources beside the store: text files and JSON files of dated sessions, as turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.temporal import session_date

SESSIONS = "sample_id string, sessions array<struct<session_id: string, date_time: string, turns: array<struct<speaker: string, text: string>>>>, qa array<struct<question: string, answer: string, category: int>>"


def read_texts(spark: SparkSession, path: str, user_id: str) -> DataFrame:
    """(turn_id, user_id, conversation_id, speaker, text, ts): one turn per file, whole."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("conversation_id"), F.col("value").alias("text"))
    return t.select(F.md5("conversation_id").alias("turn_id"), F.lit(user_id).alias("user_id"), "conversation_id", F.lit("user").alias("speaker"), "text", F.current_timestamp().alias("ts")).filter(F.trim("text") != "")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Turns of JSON files of sessions in order, with the date that the session names; the same columns as read_texts."""
    s = spark.read.schema(SESSIONS).json(path, multiLine=True).select("sample_id", F.explode("sessions").alias("s"))
    t = s.select("sample_id", "s.session_id", session_date(F.col("s.date_time")).alias("day"), F.posexplode("s.turns").alias("no", "t"))
    at = F.col("day").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("no"))
    return t.select(F.concat_ws("/", "sample_id", "session_id", "no").alias("turn_id"), F.col("sample_id").alias("user_id"), F.col("session_id").alias("conversation_id"), "t.speaker", "t.text", at.alias("ts"))


def read_questions(spark: SparkSession, path: str, categories: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """(sample_id, question, answer, category) of the categories that are asked."""
    q = spark.read.schema(SESSIONS).json(path, multiLine=True).select("sample_id", F.explode("qa").alias("q")).select("sample_id", "q.*")
    return q.filter(F.col("category").isin(list(categories)))
