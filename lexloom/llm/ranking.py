"""Exact global ranks and running sums without a window over a whole key.

A hot key may hold a third of all rows, so no window is partitioned by it
alone.  Rows are dealt to order-preserving buckets; per-bucket totals are small
and get their prefix sums, and only the rows of one bucket meet in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that a bucket holds on average.
BUCKET_ROWS = 20_000


def bucket_count(rows: int, least: int) -> int:
    return max(1, least, -(-rows // BUCKET_ROWS))


def rank_in_buckets(df: DataFrame, keys: list[str], bucket: str, order: list[Column], out: str, nulls: bool = False) -> DataFrame:
    """Add ``out``, the 0-based rank of each row among the rows with its ``keys``.

    ``bucket`` must not fall as ``order`` rises.  Without keys the rank is over
    all rows; the window over bucket totals then has one row per bucket.  With
    ``nulls`` keys may be null, which equal each other.
    """
    totals = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    if nulls:
        own = offsets.select(*(F.col(c).alias(f"_{c}") for c in (*keys, bucket)), "_before")
        joined = df.join(own, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, bucket)]).drop(*(f"_{c}" for c in (*keys, bucket)))
    else:
        joined = df.join(offsets, [*keys, bucket])
    return (
        joined.withColumn(out, F.col("_before") + F.row_number().over(inside) - 1)
        .drop("_before")
    )
