"""Sinks, previews and batch statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.functions import constants as K
from kontor.session import shuffles_dropped


PERIOD = "BELEGMONAT"       # partition column: document month as yyyymm


def write_documents_snapshot(docs: DataFrame, path: str, batch_id: str, fmt: str = "parquet") -> None:
    """A10: persist a fetched batch under ``batch_id=<id>`` (appends batches).

    Documents with typed dates are laid out by document month below that, so that a date window
    (:func:`kontor.sources.filters.documents_window`) reads the months it needs."""
    layout = ["batch_id"]
    out = docs.withColumn("batch_id", F.lit(batch_id))
    if dict(docs.dtypes).get("BELEGDAT") in ("date", "timestamp", "timestamp_ntz"):
        out = out.withColumn(PERIOD, (F.year("BELEGDAT") * 100 + F.month("BELEGDAT")).cast("int"))
        layout.append(PERIOD)
    (out.write.mode("append").partitionBy(*layout).format(fmt)
     .options(**({"header": "true"} if fmt == "csv" else {})).save(path))


def write_documents_table(docs: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """A10 for matching: the documents as a catalog table in ``path``, dealt by ORDER_ID into ``buckets``
    buckets and sorted by it within each. Returns the table.

    Lookups and matches by order number (:mod:`kontor.operators.reconcile`) read it as it lies: the documents
    are grouped and joined without a shuffle, however often, and only the export rows move. Order numbers
    become text. ``buckets``: a few per executor core, so that one holds what a task should."""
    (docs.withColumn("ORDER_ID", F.col("ORDER_ID").cast("string"))
     .write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, "ORDER_ID").sortBy("ORDER_ID").saveAsTable(table))
    return docs.sparkSession.table(table)


def write_matched(matched: DataFrame, path: str, fmt: str = "csv") -> None:
    """Persist matched export rows in their original column layout."""
    w = matched.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True).option("sep", ";")
    with shuffles_dropped(matched.sparkSession):
        w.save(path)


def write_report(lines: DataFrame, path: str, fmt: str = "csv") -> None:
    """Processed report, one folder per export file, rows in report order."""
    w = (lines.repartitionByRange("file_id", "row_no").sortWithinPartitions("file_id", "row_no")
         .write.mode("overwrite").partitionBy("file_id").format(fmt))
    if fmt == "csv":
        w = w.option("header", True).option("sep", ";")
    with shuffles_dropped(lines.sparkSession):
        w.save(path)


def preview(df: DataFrame, order_by: list[str | Column], n: int = K.PREVIEW_ROWS) -> DataFrame:
    """First ``n`` rows in a stated order (top-k, not a full sort)."""
    return df.orderBy(*order_by).limit(n)


def batch_stats(docs: DataFrame) -> DataFrame:
    """Rows, columns, date range and sorted origins of a batch (one row).

    The origin list is a set of platform names, bounded by the number of
    platforms, not by the number of documents."""
    aggs = [F.count(F.lit(1)).alias("rows"), F.lit(len(docs.columns)).cast("long").alias("columns")]
    if "BELEGDAT" in docs.columns:
        aggs += [F.min("BELEGDAT").alias("date_from"), F.max("BELEGDAT").alias("date_to")]
    if "ORIGIN" in docs.columns:
        aggs.append(F.array_sort(F.collect_set("ORIGIN")).alias("origins"))
    return docs.agg(*aggs)
