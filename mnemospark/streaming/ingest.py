"""Streaming ingest: turns to chunks, running profiles and sessions, with watermarks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemospark.functions import text as T
from mnemospark.sources.embedders import Embedder, embed
from mnemospark.sources.store import MemoryStore

TURN = "turn_id string, user_id string, conversation_id string, speaker string, text string, ts timestamp"


def turns_to_chunks(turns: DataFrame) -> DataFrame:
    """Sentence windows of every turn as rows of the chunk log; the same for a batch and for a stream. Blank turns have none."""
    w = turns.select("turn_id", "user_id", "conversation_id", "speaker", "ts", F.posexplode(T.windows(T.sentences(F.col("text")))).alias("no", "text"))
    score = F.round(T.importance(F.col("text"), F.lit(1.0)), 6)
    return w.select(F.concat_ws("/", "turn_id", "no").alias("chunk_id"), "user_id", "conversation_id", "speaker", "text", F.col("ts").alias("timestamp"), score.alias("importance"), score.alias("confidence"))


def ingest_stream(turns: DataFrame, store: MemoryStore, checkpoint: str, late: str = "1 hour", make: Callable[[], Embedder] | None = None) -> StreamingQuery:
    """Append each micro-batch's chunks to the store, with vectors if an embedder is made; a turn that is delivered again within the watermark is dropped."""
    fresh = turns.withWatermark("ts", late).dropDuplicatesWithinWatermark(["turn_id"])

    def write(df: DataFrame, _: int) -> None:
        chunks = turns_to_chunks(df)
        store.append("chunk", chunks.withColumn("vector", embed(F.col("text"), make)) if make else chunks)

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_stream(turns: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Turns per session of a conversation; a session ends after `gap`, late turns count until the watermark."""
    return turns.withWatermark("ts", late).groupBy("user_id", "conversation_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("turns"))


def _fold(weight: float) -> Callable:
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, n, times, signals = state.get if state.exists else (0.5, 0, [], [])
        rows = pd.concat(list(batches)).dropna(subset=["signal", "ts"])
        pending = sorted([*zip(times, signals), *zip(rows["ts"].astype("int64").tolist(), rows["signal"].tolist())])
        line = state.getCurrentWatermarkMs() * 10**6
        sure = [s for t, s in pending if t < line]
        for s in sure:
            value = value * (1 - weight) + s * weight
        n += len(sure)
        pending = pending[len(sure) :]
        state.update((value, n, [t for t, _ in pending], [s for _, s in pending]))
        for _, s in pending:  # what is shown counts them in the order known so far
            value = value * (1 - weight) + s * weight
        n += len(pending)
        yield pd.DataFrame({"user_id": [key[0]], "dimension": [key[1]], "value": [value], "signals": [n], "confidence": [min(1.0, min(n, 50) / 20)]})

    return update


def profile_stream(signals: DataFrame, weight: float = 0.2, late: str = "1 hour") -> DataFrame:
    """Running profile values per (user_id, dimension) of a stream with signal and ts, folded in order of time.

    State is the value of all signals before the watermark and the signals behind it, so
    one that comes late by less than `late` still takes its place; a later one counts on
    arrival.
    """
    return signals.withWatermark("ts", late).groupBy("user_id", "dimension").applyInPandasWithState(
        _fold(weight), "user_id string, dimension string, value double, signals long, confidence double", "value double, signals long, times array<long>, pending array<double>", "update", GroupStateTimeout.NoTimeout
    )


def _batches(size: int) -> Callable:
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (held, no) = state.get if state.exists else ([], 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "turn_id"])
        held = [*held, *rows["text"].tolist()]
        full = len(held) // size
        out = [(key[0], no + i, "\n".join(held[i * size : (i + 1) * size])) for i in range(full)]
        state.update((held[full * size :], no + full))
        yield pd.DataFrame(out, columns=["user_id", "batch", "text"])

    return update


def turn_batch_stream(turns: DataFrame, size: int = 5, late: str = "1 hour") -> DataFrame:
    """A text for extraction of every `size` turns of a user that have five words at least, in order of arrival; state is the turns of an unfinished batch."""
    kept = turns.withWatermark("ts", late).filter(F.size(T.words(F.col("text"))) >= 5).select("user_id", "turn_id", "text", "ts")
    return kept.groupBy("user_id").applyInPandasWithState(_batches(size), "user_id string, batch long, text string", "held array<string>, no long", "append", GroupStateTimeout.NoTimeout)
