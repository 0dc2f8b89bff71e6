"""Row numbers within a group that stay bounded per task.

``row_number().over(partitionBy(g).orderBy(o))`` puts every row of a group in
one task; a single export file (or one hot key) holding a third of all rows
would then be sorted by one core. Instead the order is cut into buckets by a
column that never decreases along the order (a row index divided by a bucket
size, or a coarse leading sort key):

  1. count rows per (group, bucket)                 -- partial aggregation
  2. prefix-sum those counts per group              -- window over the small count table
  3. row_number within (group, bucket) + the offset -- window tasks hold one bucket

The result equals the plain window's row_number exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKET_ROWS = 1 << 16


def ordinal(df: DataFrame, by: Sequence[str], order: Sequence[Column], bucket: Column,
            out: str = "row_no", start: int = 1) -> DataFrame:
    """Attach ``out`` = position of each row within ``by`` in ``order``.

    ``bucket`` must be non-decreasing along ``order`` within a group."""
    b, n, off = "__ord_bucket", "__ord_n", "__ord_off"
    d = df.withColumn(b, bucket)
    counts = d.groupBy(*by, b).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*by).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, b, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(off))
    within = Window.partitionBy(*by, b).orderBy(*order)
    # numbered before the join: its order by (group, bucket) serves the join too, so rows are sorted once
    return (d.withColumn(n, F.row_number().over(within)).join(offsets, [*by, b])
            .withColumn(out, F.col(off) + F.col(n) + F.lit(start - 1))
            .select(*df.columns, out))


def ordinal_by_index(df: DataFrame, by: Sequence[str], index_col: str, out: str = "row_no",
                     start: int = 1, bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """Dense position of rows ordered by an existing (sparse) row index."""
    return ordinal(df, by, [F.col(index_col)], F.floor(F.col(index_col) / F.lit(bucket_rows)),
                   out=out, start=start)
