"""Registry entries of the composite jobs (P1-P4, B26) and of the report order.

A composite returns many frames; its query puts them into one as (report, position, key,
measure, value). ``position`` is the place of a row in its report, NULL for reports whose
order is not part of the contract or which may be large. The SQL is that of the single
reports, unpivoted the same way."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kontor.functions import constants as K
from kontor.operators import reconcile as R
from kontor.plans import composites as P
from kontor.plans.catalog import REGISTRY, register
from kontor.plans.oracle import with_views
from kontor.plans.registry_reconcile import _REPORT_LINES_SQL
from kontor.plans.registry_sources import landed_exports
from kontor.session import scratch_path
from kontor.sources import adapters as AD
from kontor.sources import export_grid as G
from kontor.sources import ledger_json as J

MONEY = ("BRUTTO_sum", "BRUTTO_mean", "BRUTTO_count", "NETTO_sum", "NETTO_mean", "ERLOES_sum", "ERLOES_mean")
LINES = (("Document_Nr", "Order_ID", "Customer", "Platform"), ("Gross_Revenue", "Profit", "Margin_%"))


def _in_list(column: str, values) -> str:
    return "list_position([" + ", ".join(f"'{v}'" for v in values) + f"], {column})"


# family, report (also the name of its own query), keys, measures, order
REPORTS = (
    ("platform", "platform_summary", ("ORIGIN",), MONEY, "ORIGIN"),
    ("platform", "platform_share", ("ORIGIN",), ("BRUTTO", "percentage"), "ORIGIN"),
    ("platform", "platform_orders", ("ORIGIN",), ("order_count", "percentage"), "ORIGIN"),
    ("geographic", "country_summary", ("ISOA2_LAND",), MONEY, "BRUTTO_sum DESC, ISOA2_LAND"),
    ("geographic", "country_share", ("ISOA2_LAND",), ("BRUTTO", "percentage"), "BRUTTO DESC, ISOA2_LAND"),
    ("geographic", "country_orders", ("ISOA2_LAND",), ("order_count", "percentage"), "order_count DESC, ISOA2_LAND"),
    ("time", "daily_trend", ("Date",), ("Gross_Revenue", "Net_Revenue", "Profit", "Order_Count"), '"Date"'),
    ("time", "weekly_trend", ("Week",), ("BRUTTO", "ERLOES", "BELEGDAT"), '"Week"'),
    ("time", "monthly_trend", ("Month",), ("BRUTTO", "ERLOES", "BELEGDAT"), '"Month"'),
    ("time", "day_of_week", ("DayOfWeek",), ("Total_Revenue", "Avg_Revenue", "Order_Count"),
     _in_list('"DayOfWeek"', ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"))),
    ("customer", "top_customers", ("Customer_ID", "Customer_Name"), ("Total_Revenue", "Total_Profit", "Order_Count"), None),
    ("customer", "all_customers", ("Customer_ID", "Customer_Name"), ("Total_Revenue", "Total_Profit", "Order_Count"), None),
    ("customer", "customer_frequency", ("Category",), ("Customer_Count", "Total_Orders"), "Category"),
    ("customer", "new_vs_returning", ("Date",), ("Returning", "New"), '"Date"'),
    ("document_type", "document_type_summary", ("Document_Type",), ("Gross_Revenue", "Net_Revenue", "Profit", "Count"), None),
    ("profitability", "margin_distribution", ("Margin_Category",), ("Order_Count", "Total_Revenue", "Total_Profit"),
     _in_list("Margin_Category", K.MARGIN_LABELS)),
    ("profitability", "platform_profitability", ("Platform",), ("Gross_Revenue", "Net_Revenue", "Total_Profit", "Avg_Margin", "Profit_Margin_Pct"), "Platform"),
    ("profitability", "country_profitability", ("Country",), ("Gross_Revenue", "Total_Profit", "Avg_Margin", "Profit_Margin_Pct"), "Total_Profit DESC, Country"),
    ("profitability", "top_profitable_orders", *LINES, "Profit DESC, Document_Nr"),
    ("profitability", "low_margin_orders", *LINES, '"Margin_%" ASC, Document_Nr'),
    ("payment", "payment_summary", ("Payment_Method",), ("Total_Revenue", "Total_Profit", "Order_Count"), "Total_Revenue DESC, Payment_Method"),
    ("order_value", "order_value_distribution", ("Value_Range",), ("Order_Count", "Total_Revenue"), None),
    ("order_value", "order_value_stats", (), ("mean", "median", "std", "min", "max", "q25", "q75"), None),
)
ROUNDED = ("Avg_Margin", "std", "median", "q25", "q75")      # as in the reports' own queries

# frame of the dashboard -> report it shows
DASHBOARD = {
    "platform_revenue": "platform_share", "platform_orders": "platform_orders", "daily_trend": "daily_trend",
    "day_of_week": "day_of_week", "customer_frequency": "customer_frequency", "profit_margin": "margin_distribution",
    "platform_profitability": "platform_profitability", "order_value": "order_value_distribution",
    "payment": "payment_summary", "top_customers": "top_customers",
    "geographic": "top_countries_chart", "countries": "country_table",
}
TABLES = {name: (keys, measures, order) for _, name, keys, measures, order in REPORTS} | {
    "top_countries_chart": (("ISOA2_LAND", "Country_Name"), ("BRUTTO", "percentage"), "BRUTTO DESC, ISOA2_LAND"),
    "country_table": (("Country",), ("BRUTTO_sum", "BRUTTO_count", "BRUTTO_mean"), "BRUTTO_sum DESC, Country"),
}


def as_rows(name: str, df: DataFrame, keys, measures, order) -> DataFrame:
    """One report as (report, position, key, measure, value)."""
    position = F.lit(None).cast("int")
    if order is not None:           # reports with an order are small: one row per day at most, or a top-k
        df = (df.withColumn("_at", F.monotonically_increasing_id())
              .withColumn("_position", F.row_number().over(Window.orderBy("_at"))))
        position = F.col("_position")
    value = [F.struct(F.lit(m).alias("measure"), (F.round(F.col(f"`{m}`"), 6) if m in ROUNDED else F.col(f"`{m}`")).cast("double").alias("value"))
             for m in measures]
    key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]) if keys else F.lit("")
    return df.select(F.lit(name).alias("report"), position.alias("position"), key.alias("key"), F.inline(F.array(*value)))


def _sql(name: str, report: str) -> str:
    keys, measures, order = TABLES[report]
    key = "concat_ws('|', " + ", ".join(f"coalesce(CAST(\"{k}\" AS VARCHAR), '')" for k in keys) + ")" if keys else "''"
    position = f"CAST(row_number() OVER (ORDER BY {order}) AS INTEGER)" if order else "CAST(NULL AS INTEGER)"
    one = " UNION ALL ".join(f"""SELECT '{name}' AS report, position, key, '{m}' AS measure, CAST("{m}" AS DOUBLE) AS value FROM numbered"""
                             for m in measures)
    return f"(WITH numbered AS (SELECT *, {position} AS position, {key} AS key FROM ({REGISTRY[report].sql})) {one})"


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _full_analysis(s: SparkSession, d: str) -> DataFrame:
    a = P.full_analysis(AD.belege_orders(s, d))
    return _union([as_rows(name, a[family][name], keys, measures, order) for family, name, keys, measures, order in REPORTS])


register("full_analysis", _full_analysis, " UNION ALL ".join(f"SELECT * FROM {_sql(r[1], r[1])}" for r in REPORTS))


def _dashboard(s: SparkSession, d: str) -> DataFrame:
    frames = P.dashboard_frames(AD.belege_orders(s, d))
    return _union([as_rows(name, frames[name], *TABLES[report]) for name, report in DASHBOARD.items()])


register("dashboard_frames", _dashboard, " UNION ALL ".join(f"SELECT * FROM {_sql(n, r)}" for n, r in DASHBOARD.items()))


# --- P2: matched and unmatched rows and the report of the whole export, from landed files ----------

def _match_and_process(s: SparkSession, d: str) -> DataFrame:
    out = P.match_and_process(s, landed_exports(s, d), AD.belege_orders(s, d), export_column="file_id")
    counts = [out[part].groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "file_id", "n")
              for part in ("matched", "unmatched", "report_lines")]
    return _union(counts)


register("match_and_process", _match_and_process, with_views(["shop_export", "belege_orders", "txl", "fs"], f"""
SELECT CASE WHEN m THEN 'matched' ELSE 'unmatched' END AS part, file_id, COUNT(*) AS n
FROM (SELECT file_id, EXISTS (SELECT 1 FROM belege_orders b WHERE b.ORDER_ID = shop_export.bestellnummer) AS m FROM shop_export)
GROUP BY ALL
UNION ALL SELECT 'report_lines', file_id, COUNT(*) FROM ({_REPORT_LINES_SQL}) GROUP BY file_id"""))


# --- B26: the whole processed sheet -----------------------------------------------------------------

SHEET_TEXT = ("C", "F", "G", "Q")


def _sheet(s: SparkSession, d: str) -> DataFrame:
    out = P.reconcile_rows(AD.shop_export(s, d), AD.belege_lookup(s, d), AD.shop_preamble(s, d))
    first = F.col("row_no") <= 4
    return out["report_sheet"].select("file_id", "row_no", F.when(first, F.col("A")).alias("A"), F.when(first, F.col("B")).alias("B"), *SHEET_TEXT)


def _sheet_sql() -> str:
    header = REGISTRY["report_header"].sql
    none = ", ".join(f"NULL AS {c}" for c in SHEET_TEXT)
    titles = dict(K.REPORT_HEADERS)
    named = ", ".join("'" + titles[c].replace("'", "''") + f"' AS {c}" for c in SHEET_TEXT)
    labels = ", ".join(f"({i}, '{label}')" for i, label in enumerate(K.HEADER_LABELS, 1))
    text = ", ".join(f"NULLIF(CAST({c} AS VARCHAR), '') AS {c}" if c == "Q" else f"CAST({c} AS VARCHAR) AS {c}" for c in SHEET_TEXT)
    body = with_views(["txl", "fs"], f"SELECT file_id, row_no, NULL AS A, NULL AS B, {text} FROM ({_REPORT_LINES_SQL})")
    return f"""SELECT file_id, CAST(no AS BIGINT) AS row_no, label AS A,
CASE no WHEN 1 THEN seller WHEN 2 THEN CAST(transactions AS VARCHAR) ELSE CAST(amount AS VARCHAR) END AS B, {none}
FROM ({header}) h CROSS JOIN (VALUES {labels}) v(no, label)
UNION ALL SELECT file_id, 4, '{titles['A']}', '{titles['B']}', {named} FROM ({header})
UNION ALL SELECT * FROM ({body})"""


register("report_sheet", _sheet, _sheet_sql())


# --- A6, A8: cells with separators, doubled quotes and line breaks -----------------------------------

def _odd_names(s: SparkSession, d: str) -> DataFrame:
    rows = AD.shop_export(s, d).withColumn("name", F.concat(F.lit('a "'), F.coalesce("name", F.lit("")), F.lit('"; b\nc')))
    path = scratch_path(s, f"odd-{uuid.uuid4().hex}")
    G.write_export_grid(rows, None, path)
    e = G.read_exports(s, path, export_column="file_id")
    return R.normalize_transactions(e.rows).select("file_id", "row_idx", "name", "betrag_abzgl")


register("src_export_quoted_cells", lambda s, d: _odd_names(s, d).withColumn("row_idx", F.col("row_idx") - 1),
         with_views(["tx"], """SELECT file_id, row_idx, 'a "' || coalesce(name, '') || '"; b' || chr(10) || 'c' AS name, betrag_abzgl FROM tx"""))


# --- A1, C3, C4: the last document wins over payload files of different size --------------------------

def _lookup_of_payloads(s: SparkSession, d: str) -> DataFrame:
    docs = AD.belege_lookup(s, d)
    # bounded payloads in the order of the documents; then small ones that hold later documents of some orders
    late = F.col("ORDER_ID").cast("long") % 64 == 0
    payload = F.when(late, F.col("api_row") % 2 + 1).otherwise(F.lit(0))
    fields = ("ORDER_ID", "KUNDENNR", "BELEGNR")
    packed = (docs.groupBy(payload.alias("p"), F.floor(F.col("ORDER_ID").cast("long") / 1000).alias("part"))
              .agg(F.array_sort(F.collect_list(F.struct("api_row", *fields))).alias("d"))
              .select(F.format_string("payload-%d-%012d", "p", "part").alias("name"),
                      F.when(F.col("p") == 1, F.transform("d", lambda x: F.struct(*[x[f].alias(f) for f in fields]))).alias("results"),
                      F.when(F.col("p") != 1, F.transform("d", lambda x: F.struct(*[x[f].alias(f) for f in fields]))).alias("data")))
    path = scratch_path(s, f"payloads-{uuid.uuid4().hex}")
    packed.write.partitionBy("name").json(path)
    return R.order_lookup(J.read_ledger_documents(s, path, multi_line=False))


register("lookup_of_payload_files", _lookup_of_payloads,
         with_views(["lookup"], "SELECT ORDER_ID, KUNDENNR, BELEGNR FROM lookup"))


def _lookup_of_stream(s: SparkSession, d: str) -> DataFrame:
    from kontor.streaming.landing import land_documents
    run = uuid.uuid4().hex
    table, ckpt = (scratch_path(s, f"{x}-{run}") for x in ("landed", "landed-ckpt"))
    docs = AD.belege_lookup(s, d)
    fields = ("ORDER_ID", "KUNDENNR", "BELEGNR")
    inbox = scratch_path(s, f"inbox-{run}")
    (docs.groupBy(F.floor(F.col("api_row") / 1000).alias("p"))
     .agg(F.array_sort(F.collect_list(F.struct("api_row", *fields))).alias("d"))
     .select(F.format_string("%012d", "p").alias("name"), F.transform("d", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("results"))
     .write.partitionBy("name").json(inbox))
    land_documents(s, inbox, table, ckpt, multi_line=False).awaitTermination()
    return R.order_lookup(s.read.parquet(table))


register("lookup_of_streamed_documents", _lookup_of_stream,
         with_views(["lookup"], "SELECT ORDER_ID, KUNDENNR, BELEGNR FROM lookup"))
