"""Order-value bins whose edges depend on the largest order value.

The edge set is computed once by a global aggregate (one row: the edges and
their label texts) and used through a single scalar subquery, so the data is
read twice (max, then bins); nothing is collected to the driver and nothing is
cross-joined. Per row the bin number is the count of edges below the value,
written as a fixed number of comparisons (at most ``MAX_EDGES``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.functions import constants as K

MAX_EDGES = len(K.VALUE_EDGES_ABOVE_500) + 1


def _arr(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def value_bucket_edges(mx: Column) -> tuple[Column, Column]:
    """(edges ARRAY<DOUBLE>, label texts ARRAY<STRING>) for maximum ``mx``.

    max <= 100: small edges; max <= 500: middle edges; otherwise the large
    edges below max+1 followed by max+1, so the edges always increase. Fixed
    edges print as integers, max+1 with two decimals."""
    top = mx.cast("double") + F.lit(1.0)
    top_txt = (mx + F.lit(1)).cast("decimal(18,2)").cast("string")
    big = _arr([float(e) for e in K.VALUE_EDGES_ABOVE_500])
    keep = F.size(F.filter(big, lambda e: e < top))
    edges = (F.when(mx <= 100, _arr([float(e) for e in K.VALUE_EDGES_UPTO_100]))
             .when(mx <= 500, _arr([float(e) for e in K.VALUE_EDGES_UPTO_500]))
             .otherwise(F.concat(F.slice(big, 1, keep), F.array(top))))
    texts = (F.when(mx <= 100, _arr([str(e) for e in K.VALUE_EDGES_UPTO_100]))
             .when(mx <= 500, _arr([str(e) for e in K.VALUE_EDGES_UPTO_500]))
             .otherwise(F.concat(F.slice(_arr([str(e) for e in K.VALUE_EDGES_ABOVE_500]), 1, keep),
                                 F.array(top_txt))))
    return edges, texts


def edge_table(df: DataFrame, col: str) -> DataFrame:
    """One row: ``edges`` and ``texts`` for the maximum of ``col``."""
    m = df.agg(F.max(col).alias("mx"))
    edges, texts = value_bucket_edges(F.col("mx"))
    return m.select(edges.alias("edges"), texts.alias("texts"))


def bin_number(x: Column, edges: Column) -> Column:
    """Count of edges strictly below ``x`` (1-based bin number of a right-closed bin)."""
    x = x.cast("double")
    return reduce(lambda a, b: a + b,
                  [F.when(F.try_element_at(edges, F.lit(k)) < x, 1).otherwise(0)
                   for k in range(1, MAX_EDGES + 1)])


def bin_label(i: Column, edges: Column, texts: Column) -> Column:
    inside = (i >= 1) & (i < F.size(edges))
    return F.when(inside, F.concat(F.lit(K.CURRENCY_SIGN), F.try_element_at(texts, i), F.lit("-"),
                                   F.try_element_at(texts, i + 1)))


def value_bins(df: DataFrame, col: str, out: str = "value_bin"):
    """Attach ``out`` = bin number of ``col`` (NULL outside all bins).

    Returns (frame, label) where ``label(bin_col)`` builds the '€a-b' text from
    the same edge subquery; apply it after aggregating, on few rows."""
    e = edge_table(df, col).select(F.struct("edges", "texts").alias("e")).scalar()
    edges = e.getField("edges")
    i = bin_number(F.col(col), edges)
    framed = df.withColumn(out, F.when((i >= 1) & (i < F.size(edges)), i))

    def label(bin_col: Column) -> Column:
        return bin_label(bin_col, e.getField("edges"), e.getField("texts"))

    return framed, label


def with_value_buckets(df: DataFrame, col: str, out_label: str = "value_range",
                       out_order: str = "value_bin") -> DataFrame:
    """Attach ``out_order`` (bin number, NULL outside) and ``out_label`` ('€a-b')."""
    framed, label = value_bins(df, col, out_order)
    return framed.withColumn(out_label, label(F.col(out_order)))


# --- one-pass distribution ---------------------------------------------------------

EDGE_SETS = {"small": K.VALUE_EDGES_UPTO_100, "mid": K.VALUE_EDGES_UPTO_500, "big": K.VALUE_EDGES_ABOVE_500}


def candidate_bins(v: Column) -> list[Column]:
    """Bin number of ``v`` in each candidate edge set (count of fixed edges below it).

    For the large set this is also the final bin number: every value is at most
    the maximum, below the data-dependent last edge max+1, so only the label of
    the last bin depends on the maximum."""
    x = v.cast("double")
    return [reduce(lambda a, b: a + b, [F.when(F.lit(float(e)) < x, 1).otherwise(0) for e in edges]).alias(f"_bin_{k}")
            for k, edges in EDGE_SETS.items()]


def chosen_bin(mx: Column) -> tuple[Column, Column]:
    """(bin number, label) from the candidate bins of a row, given the maximum ``mx``."""
    top = mx.cast("double") + F.lit(1.0)
    top_txt = (mx + F.lit(1)).cast("decimal(18,2)").cast("string")
    big = K.VALUE_EDGES_ABOVE_500
    keep = reduce(lambda a, b: a + b, [F.when(F.lit(float(e)) < top, 1).otherwise(0) for e in big])
    i = (F.when(mx <= 100, F.col("_bin_small")).when(mx <= 500, F.col("_bin_mid"))
         .otherwise(F.col("_bin_big")))
    n_edges = F.when(mx <= 100, F.lit(len(K.VALUE_EDGES_UPTO_100))).when(
        mx <= 500, F.lit(len(K.VALUE_EDGES_UPTO_500))).otherwise(keep + 1)
    lo = (F.when(mx <= 100, F.element_at(_arr([str(e) for e in K.VALUE_EDGES_UPTO_100]), i))
          .when(mx <= 500, F.element_at(_arr([str(e) for e in K.VALUE_EDGES_UPTO_500]), i))
          .otherwise(F.element_at(_arr([str(e) for e in big]), i)))
    hi = (F.when(mx <= 100, F.try_element_at(_arr([str(e) for e in K.VALUE_EDGES_UPTO_100]), i + 1))
          .when(mx <= 500, F.try_element_at(_arr([str(e) for e in K.VALUE_EDGES_UPTO_500]), i + 1))
          .when(i + 1 <= keep, F.try_element_at(_arr([str(e) for e in big]), i + 1))
          .otherwise(top_txt))
    inside = (i >= 1) & (i < n_edges)
    return F.when(inside, i), F.when(inside, F.concat(F.lit(K.CURRENCY_SIGN), lo, F.lit("-"), hi))
