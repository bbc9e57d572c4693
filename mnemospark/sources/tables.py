"""Readers of the stored tables, and the rules that hold for every query over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One stored table; the path stays visible in the plan so pruning and pushdown reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_per_chunk(chunks: DataFrame, *columns: str) -> DataFrame:
    """One row per chunk_id with the given columns: the delivery with the smallest batch_no stands.

    Deliveries of a chunk differ only in batch_no and ingested_at, so the columns that
    are asked for decide the cost: without those two any delivery will do and the
    aggregation needs no order. A null chunk_id names no chunk and is left out.
    """
    rows = chunks.filter(F.col("chunk_id").isNotNull())
    if not columns:
        return rows.select("chunk_id").distinct()
    if {"batch_no", "ingested_at"} & set(columns):
        best = F.min(F.struct(F.coalesce("batch_no", F.lit(2**31 - 1)).alias("_b"), *[F.col(c) for c in columns]))
        return rows.groupBy("chunk_id").agg(best.alias("_m")).select("chunk_id", *[F.col(f"_m.{c}").alias(c) for c in columns])
    return rows.select("chunk_id", *columns).dropDuplicates(["chunk_id"])
