"""Composite jobs (P1-P4): the public entry points of the engine.

They return lazy DataFrames; the analysis runs the aggregation of its keyed reports when called, reconciling writes the
transactions and their sums. Inputs reused by several outputs are materialized once: the transactions as a table in the
shared ``spark.checkpoint.dir``, the documents by ``persist`` (recomputed from lineage if an executor is lost). With
``checkpoint=True`` both are a reliable checkpoint in that folder that cuts the lineage.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.functions import constants as K
from kontor.operators import analytics as A
from kontor.operators import reconcile as R
from kontor.operators.prepare import MissingColumn, prepare
from kontor.session import landed, materialize
from kontor.sources import export_grid as G


def _reuse(df: DataFrame, checkpoint: bool) -> DataFrame:
    return materialize(df) if checkpoint else df.persist(StorageLevel.MEMORY_AND_DISK)


def _try(fn, *args):
    """Run a report if its columns are present (reports adapt to the input); other errors are errors."""
    try:
        return fn(*args)
    except MissingColumn:
        return None


def full_analysis(docs: DataFrame, checkpoint: bool = False) -> dict[str, dict[str, DataFrame] | DataFrame]:
    """All nine report families over one prepared document set.

    The eleven reports keyed by a low-cardinality column (platform, country,
    country x platform, day, week, month, weekday, hour, document type,
    payment method, margin bin) read the documents once: one grouping-sets
    aggregation (``keyed_measure_sets``), run and written when called, whose small result every
    such report projects. The four customer reports share one (customer, name, day)
    aggregate. The rest (KPIs, bins, quantiles, top-k orders) read the prepared
    set themselves."""
    prep = _reuse(prepare(docs), checkpoint)
    keyed = A.keyed_measure_sets(prep)
    customers = (A.customer_day_measures(prep).persist(StorageLevel.MEMORY_AND_DISK)
                 if "KUNDENNR" in prep.columns else None)

    def k(*keys):
        return keyed.get(tuple(keys))

    families = {
        "kpis": [("kpis", A.kpi_metrics)],
        "platform": [("platform_summary", lambda p: A.platform_summary(p, k("ORIGIN"))),
                     ("platform_share", lambda p: A.platform_share(p, k("ORIGIN"))),
                     ("platform_orders", lambda p: A.platform_orders(p, k("ORIGIN")))],
        "geographic": [("country_summary", lambda p: A.country_summary(p, k("ISOA2_LAND"))),
                       ("country_share", lambda p: A.country_share(p, k("ISOA2_LAND"))),
                       ("country_orders", lambda p: A.country_orders(p, k("ISOA2_LAND"))),
                       ("country_platform_matrix",
                        lambda p: A.country_platform_matrix(p, measures=k("ISOA2_LAND", "ORIGIN")))],
        "time": [("daily_trend", lambda p: A.daily_trend(p, k("Date"))),
                 ("weekly_trend", lambda p: A.weekly_trend(p, k("Week"))),
                 ("monthly_trend", lambda p: A.monthly_trend(p, k("Month"))),
                 ("day_of_week", lambda p: A.day_of_week(p, k("DayOfWeek"))),
                 ("hourly_pattern", lambda p: A.hourly_pattern(p, k("Hour")))],
        "customer": [("top_customers", lambda p: A.top_customers(p, measures=customers)),
                     ("all_customers", lambda p: A.all_customers(p, customers)),
                     ("customer_frequency", lambda p: A.customer_frequency(p, customers)),
                     ("new_vs_returning", lambda p: A.new_vs_returning(p, customers))],
        "document_type": [("document_type_summary", lambda p: A.document_type_summary(p, measures=k("BELEGART")))],
        "profitability": [("margin_distribution", lambda p: A.margin_distribution(p, k("margin_category"))),
                          ("platform_profitability", lambda p: A.platform_profitability(p, k("ORIGIN"))),
                          ("country_profitability", lambda p: A.country_profitability(p, k("ISOA2_LAND"))),
                          ("top_profitable_orders", A.top_profitable_orders),
                          ("low_margin_orders", A.low_margin_orders)],
        "payment": [("payment_summary", lambda p: A.payment_summary(p, k("ZAHLART")))],
        "order_value": [("order_value_distribution", A.order_value_distribution),
                        ("order_value_stats", A.order_value_stats)],
    }
    out: dict = {}
    for family, reports in families.items():
        got = {name: df for name, fn in reports if (df := _try(fn, prep)) is not None}
        out[family] = got.get("kpis") if family == "kpis" else got
    out["_prep"] = prep
    out["_keyed"] = keyed["_all"]
    out["_countries"] = k("ISOA2_LAND")
    out["_customers"] = customers
    return out


def dashboard_frames(docs: DataFrame, checkpoint: bool = False) -> dict[str, DataFrame]:
    """The frames behind the dashboard's charts and tables."""
    a = full_analysis(docs, checkpoint)
    prep = a["_prep"]
    countries = a["_countries"]
    frames = {
        "platform_revenue": a["platform"].get("platform_share"),
        "platform_orders": a["platform"].get("platform_orders"),
        "geographic": _try(lambda p: A.top_countries_chart(p, measures=countries), prep),
        "daily_trend": a["time"].get("daily_trend"),
        "day_of_week": a["time"].get("day_of_week"),
        "hourly": a["time"].get("hourly_pattern"),
        "customer_frequency": a["customer"].get("customer_frequency"),
        "profit_margin": a["profitability"].get("margin_distribution"),
        "platform_profitability": a["profitability"].get("platform_profitability"),
        "order_value": a["order_value"].get("order_value_distribution"),
        "payment": a["payment"].get("payment_summary"),
        "countries": _try(lambda p: A.country_table(p, measures=countries), prep),
        "top_customers": a["customer"].get("top_customers"),
    }
    return {k: v for k, v in frames.items() if v is not None}


def reconcile_rows(rows: DataFrame, docs: DataFrame, preamble: DataFrame | None = None,
                   checkpoint: bool = False, account: str = K.FEE_ACCOUNT, files: DataFrame | None = None) -> dict[str, DataFrame]:
    """Reconcile raw export rows against documents: report header, report lines,
    other-fee detail and the per-file processing summary.

    ``files`` (file_id) names the exports; those without a transaction get their report too,
    with sums of 0. Without it the exports are those of the rows."""
    tx = R.attach_lookups(R.normalize_transactions(rows), docs)
    # written compressed: cached blocks would go to disk in several times that size, beside the shuffles they came from
    tx = materialize(tx) if checkpoint else landed(tx, "transactions")
    # one aggregation feeds summaries and row numbering; a row a bucket, written once
    buckets = landed(R.bucket_summary(tx), "buckets")
    summary = R.file_summary(buckets=buckets)
    if files is not None:
        summary = R.for_all_files(summary, files)
    meta = R.preamble_metadata(preamble) if preamble is not None else \
        summary.select("file_id", F.lit(None).cast("string").alias("seller"), F.lit(None).cast("string").alias("amount"))
    header = R.report_header(summary, meta)
    lines = R.report_lines(tx, summary, buckets, account)
    return {
        "transactions": tx,
        "report_header": header,
        "header_cells": R.header_cells(header),
        "report_lines": lines,
        "report_sheet": R.report_sheet(R.header_cells(header), lines, summary),
        "other_fee_detail": R.other_fee_detail(tx, buckets, account),
        "processing_summary": R.processing_summary(summary),
        "lookup_coverage": R.lookup_coverage(tx, docs),
    }


def _export_rows(spark: SparkSession, path: str, discover: bool, export_column: str | None) -> tuple[DataFrame, G.Exports]:
    e = G.read_exports(spark, path, discover=discover, export_column=export_column)
    return (e.rows.join(e.headers, "file_id")
            .withColumn("row_idx", F.col("row_idx") - F.col("header_row")).drop("header_row")), e


def reconcile_exports(spark: SparkSession, path: str, docs: DataFrame, export_column: str | None = None,
                      discover: bool = True, checkpoint: bool = False,
                      account: str = K.FEE_ACCOUNT) -> dict[str, DataFrame]:
    """A folder of export files -> per-file reports (plus rejected files)."""
    rows, e = _export_rows(spark, path, discover, export_column)
    out = reconcile_rows(rows, docs, e.preamble, checkpoint, account, e.headers.select("file_id"))
    return out | {"rejected": e.rejected, "missing_headers": e.missing, "first_rows": e.first_rows}


def match_and_process(spark: SparkSession, path: str, docs: DataFrame, export_column: str | None = None,
                      fixed_header_for_matching: bool = False, checkpoint: bool = False,
                      account: str = K.FEE_ACCOUNT) -> dict[str, DataFrame]:
    """Matched and unmatched export rows (semi/anti join on the order number)
    and, independently, the report of the whole export (not only the matched rows).

    Both use the discovered header and one read of the files; the fixed
    row-11 layout is available for matching with ``fixed_header_for_matching``."""
    rows, e = _export_rows(spark, path, True, export_column)
    out = reconcile_rows(rows, docs, e.preamble, checkpoint, account, e.headers.select("file_id"))
    out |= {"rejected": e.rejected, "missing_headers": e.missing, "first_rows": e.first_rows}
    match_rows = _export_rows(spark, path, False, export_column)[0] if fixed_header_for_matching else rows
    out["matched"] = R.match_orders(match_rows, docs)
    out["unmatched"] = R.unmatched_orders(match_rows, docs)
    out["match_stats"] = R.match_stats(match_rows, docs)
    return out
