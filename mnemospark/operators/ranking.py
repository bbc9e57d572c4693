"""Exact row numbers within groups of any size, without one task per hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.session import materialize

HOT_ROWS = 2_000_000


def ranked(df: DataFrame, keys: list[str], order: list[str | Column], out: str = "rank_no", hot_rows: int = HOT_ROWS, value: str | None = None) -> DataFrame:
    """df with `out`, 1, 2, ... within each group of `keys` in ascending `order` (nulls first).

    With `value` it is the running sum of that column instead, up to and with the row.

    Groups of up to `hot_rows` rows are numbered by a window. Larger ones are range
    partitioned on keys and order, numbered within each part and shifted by the counts
    of the parts before; the table of those counts has at most two rows per part and
    hot group. Rows equal in keys and order get different numbers in no set order.
    An empty input gives an empty result.
    """
    null_safe = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys]
    order_cols: list[Column] = [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order]

    def number(w: Window) -> Column:
        if value is None:
            return F.row_number().over(w).cast("bigint")
        return F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))

    plain = Window.partitionBy(*keys).orderBy(*order_cols)
    hot = df.groupBy(*keys).count().filter(F.col("count") > hot_rows).select(*[F.col(k).alias(f"_h_{k}") for k in keys])
    hot_keys = hot.collect()  # at most rows / hot_rows of them
    if not hot_keys:
        return df.withColumn(out, number(plain))
    hot = df.sparkSession.createDataFrame(hot_keys, hot.schema)
    cond = null_safe[0]
    for c in null_safe[1:]:
        cond = cond & c
    few = df.join(F.broadcast(hot), cond, "left_anti").withColumn(out, number(plain))
    many = df.join(F.broadcast(hot), cond, "left_semi")
    # written once, so that the part numbers are the same wherever they are read
    parts = materialize(many.repartitionByRange(*[F.col(k) for k in keys], *order_cols).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = parts.groupBy(*keys, "_part").agg((F.count(F.lit(1)) if value is None else F.sum(value)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.withColumn("_shift", F.coalesce(F.sum("_n").over(w), F.lit(0))).select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col("_part").alias("_s_part"), "_shift")
    local = number(Window.partitionBy(*keys, "_part").orderBy(*order_cols))
    on = F.col("_part") == F.col("_s_part")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    numbered = parts.withColumn("_local", local).join(F.broadcast(shift), on).withColumn(out, F.col("_local") + F.col("_shift"))
    return few.unionByName(numbered.select(*df.columns, out))
