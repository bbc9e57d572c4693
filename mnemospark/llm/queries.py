"""Queries of the problems tagged llm, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import bpe, clusters, conversations, history_dedup, knn, mixing, pii, split, truncation
from mnemospark.session import materialize, new_table_path
from mnemospark.sources.tables import one_per_chunk, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_oversized(_long(spark, sf))


def _long(spark: SparkSession, sf: str) -> DataFrame:
    # the length test comes before the shuffle that drops repeated deliveries
    chunks = table(spark, sf, "chunks").filter(F.char_length("text") > 1000)
    return one_per_chunk(chunks, "text")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_pieces(spark, sf).filter(F.col("piece_no") == 2).select("chunk_id")


def p2_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return knn.nearest(table(spark, sf, "chunks"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return knn.near_pairs(p2_neighbours(spark, sf))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Batch by batch through the forest, in order of batch_no, then chunk_id."""
    return history_dedup.by_batches(table(spark, sf, "chunks"), new_table_path(spark, "forest")).distinct()


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.neighbours_in_order(clusters.clusters(table(spark, sf, "chunks")))


def p5_clusters(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "chunks")
    return clusters.describe(clusters.clusters(chunks), chunks)


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return one_per_chunk(table(spark, sf, "chunks").filter(F.length("text") > 0), "text")


def p6_items(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find_items(_texts(spark, sf), table(spark, sf, "known_names"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """A chunk that was delivered twice has the same text each time, so items are found first and made distinct then."""
    chunks = table(spark, sf, "chunks").filter(F.col("chunk_id").isNotNull())
    return pii.find_items(chunks, table(spark, sf, "known_names")).select("chunk_id", "kind", "surface").distinct()


def p6_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.redact(_texts(spark, sf), table(spark, sf, "known_names"))


def p7_turns(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.rebuild(table(spark, sf, "chunks"), table(spark, sf, "speaker_aliases"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_turns(spark, sf).select("conversation_id", "turn_no", "chunk_id")


def p7_paths(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.rebuild_paths(table(spark, sf, "chunks"), table(spark, sf, "speaker_aliases"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf, "documents"))


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, source and n_tokens of every document, counted once and stored."""
    return materialize(bpe.count_tokens(table(spark, sf, "documents"), ["doc_id", "source"]), "sized")


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_sized(spark, sf), table(spark, sf, "mix_targets"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    targets = table(spark, sf, "mix_targets")
    return mixing.shares(mixing.mix(_sized(spark, sf), targets), targets)


def p9_distances(spark: SparkSession, sf: str) -> DataFrame:
    """How near to its targets each mix comes by tempering and by the budgets that p9_mix uses: a row per mix."""
    return spark.createDataFrame(mixing.distances(_sized(spark, sf), table(spark, sf, "mix_targets")), "mix_name string, exponent double, tempered double, budgeted double")


def p9_tempered(spark: SparkSession, sf: str) -> DataFrame:
    """The smallest exponent at which no source is used more than four times in a mix of the corpus's size."""
    return mixing.temperature_mix(_sized(spark, sf), "tempered", max_repeats=4)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated(table(spark, sf, "documents")).filter("cut").select("doc_id")


def p10_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.rates(truncation.truncated(table(spark, sf, "documents")))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p2_neighbours": p2_neighbours,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p5_clusters": p5_clusters,
    "p6_found": p6_found,
    "p6_items": p6_items,
    "p6_redacted": p6_redacted,
    "p7_found": p7_found,
    "p7_turns": p7_turns,
    "p7_paths": p7_paths,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_tempered": p9_tempered,
    "p9_distances": p9_distances,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
}
