"""Registry of queries: name -> (Spark callable(spark, sf_dir), oracle SQL or None).

Every query reads the driver's tables through the adapter views, so its work
grows with the data. ``__spark_entry__`` exposes this registry."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.operators import analytics as A
from kontor.operators.prepare import prepare
from kontor.plans.catalog import REGISTRY, Query, SparkQuery, register  # noqa: F401
from kontor.plans.oracle import NUMBER_RE, STRIP, with_views
from kontor.sources import adapters as AD

# --- shared Spark inputs ---------------------------------------------------------

def prep_orders(spark: SparkSession, d: str) -> DataFrame:
    return prepare(AD.belege_orders(spark, d))


def prep_events(spark: SparkSession, d: str) -> DataFrame:
    return prepare(AD.belege_events(spark, d))


def money(c: str) -> F.Column:
    return F.col(c).cast("double").alias(c)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Six digits for the comparison: the last bits of a mean or a deviation depend on the order
    of summation. The operators themselves do not round."""
    return df.select(*[F.round(c, 6).alias(c) if c in columns else c for c in df.columns])


STATS = ("std", "median", "q25", "q75")


# --- SQL fragments ------------------------------------------------------------------

def TOTAL(c: str) -> str:
    return f"COALESCE(CAST(SUM({c}) AS DOUBLE), 0.0)"


def MEAN(c: str) -> str:
    return f"CAST(SUM({c}) AS DOUBLE) / NULLIF(COUNT({c}), 0)"


def SHARE(c: str) -> str:
    return f"CAST({c} AS DOUBLE) / NULLIF(CAST(SUM({c}) OVER () AS DOUBLE), 0) * 100.0"


MARGIN = "CAST(ERLOES AS DOUBLE) / NULLIF(CAST(BRUTTO AS DOUBLE), 0) * 100.0"
MARGIN_BUCKET = """CASE WHEN m <= 0 THEN 'Negative' WHEN m <= 10 THEN '0-10%' WHEN m <= 20 THEN '10-20%'
     WHEN m <= 30 THEN '20-30%' WHEN m <= 40 THEN '30-40%' WHEN m <= 50 THEN '40-50%'
     WHEN m IS NOT NULL THEN '50%+' END"""
CATEGORY = """CASE WHEN n = 1 THEN 'One-time' WHEN n <= 3 THEN 'Occasional (2-3)'
     WHEN n <= 10 THEN 'Regular (4-10)' ELSE 'Loyal (10+)' END"""
COUNTRY_NAME = """COALESCE(CASE {c} WHEN 'DE' THEN 'Germany' WHEN 'AT' THEN 'Austria' WHEN 'FR' THEN 'France'
     WHEN 'CH' THEN 'Switzerland' WHEN 'IT' THEN 'Italy' WHEN 'ES' THEN 'Spain' WHEN 'NL' THEN 'Netherlands'
     WHEN 'BE' THEN 'Belgium' WHEN 'PL' THEN 'Poland' WHEN 'LU' THEN 'Luxembourg' WHEN 'Unknown' THEN 'Unknown'
     END, {c})"""


def value_bins_sql(v: str, where: str = "") -> str:
    """CTEs ``pos``/``mx``/``labelled``: order-value bins over positive BRUTTO of ``v``."""
    from kontor.functions import constants as K
    w = f" AND ({where})" if where else ""
    x = "CAST(BRUTTO AS DOUBLE)"
    top = "(CAST(mx AS DOUBLE) + 1)"
    top_txt = "CAST(CAST(mx + 1 AS DECIMAL(18,2)) AS VARCHAR)"

    def cnt(conds):
        return "(" + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in conds) + ")"

    def txt(edges):
        return "[" + ", ".join(f"'{e}'" for e in edges) + "]"

    small, mid, big = K.VALUE_EDGES_UPTO_100, K.VALUE_EDGES_UPTO_500, K.VALUE_EDGES_ABOVE_500
    keep = cnt([f"{float(e)} < {top}" for e in big])
    i_big = cnt([f"{float(e)} < {top} AND {float(e)} < {x}" for e in big]) + f" + CASE WHEN {top} < {x} THEN 1 ELSE 0 END"

    def big_txt(j):
        return f"CASE WHEN {j} <= {keep} THEN {txt(big)}[{j}] WHEN {j} = {keep} + 1 THEN {top_txt} END"

    return f"""pos AS (SELECT * FROM {v} WHERE BRUTTO > 0{w}),
mx AS (SELECT MAX(BRUTTO) AS mx FROM pos),
binned AS (
  SELECT pos.*,
    CASE WHEN mx <= 100 THEN {cnt([f"{float(e)} < {x}" for e in small])}
         WHEN mx <= 500 THEN {cnt([f"{float(e)} < {x}" for e in mid])}
         ELSE {i_big} END AS bin,
    CASE WHEN mx <= 100 THEN {len(small)} WHEN mx <= 500 THEN {len(mid)} ELSE {keep} + 1 END AS n_edges,
    mx
  FROM pos, mx),
labelled AS (
  SELECT *, CASE WHEN bin >= 1 AND bin < n_edges THEN '{K.CURRENCY_SIGN}' ||
    CASE WHEN mx <= 100 THEN {txt(small)}[bin] WHEN mx <= 500 THEN {txt(mid)}[bin] ELSE {big_txt("bin")} END || '-' ||
    CASE WHEN mx <= 100 THEN {txt(small)}[bin + 1] WHEN mx <= 500 THEN {txt(mid)}[bin + 1] ELSE {big_txt("bin + 1")} END
  END AS Value_Range
  FROM binned)"""


# =====================================================================================
# B: preparation and scalar functions
# =====================================================================================

register("prep_documents",
         lambda s, d: prep_orders(s, d).select(
             "BELEGNR", "ORDER_ID", "KUNDENNR", "NAME2", F.col("BELEGDAT").cast("timestamp_ntz").alias("BELEGDAT"),
             "ORIGIN", "ISOA2_LAND", "BELEGART", "ZAHLART", money("NETTO"), money("BRUTTO"), money("ERLOES"),
             "Date", "Month", "Week", "DayOfWeek", "Hour"),
         with_views(["po"], """SELECT BELEGNR, ORDER_ID, KUNDENNR, NAME2, BELEGDAT, ORIGIN, ISOA2_LAND, BELEGART,
ZAHLART, CAST(NETTO AS DOUBLE) AS NETTO, CAST(BRUTTO AS DOUBLE) AS BRUTTO, CAST(ERLOES AS DOUBLE) AS ERLOES,
"Date", "Month", "Week", "DayOfWeek", "Hour" FROM po"""))

register("prep_dates",
         lambda s, d: prepare(AD.belege_raw(s, d)).select(
             "BELEGNR", F.col("BELEGDAT").cast("timestamp_ntz").alias("BELEGDAT")),
         with_views(["belege_raw"], f"""SELECT BELEGNR,
COALESCE(TRY_CAST({STRIP.format(c='BELEGDAT')} AS TIMESTAMP),
         try_strptime({STRIP.format(c='BELEGDAT')}, '%d.%m.%Y')) AS BELEGDAT FROM belege_raw"""))

register("prep_numerics",
         lambda s, d: prepare(AD.belege_raw(s, d)).select("BELEGNR", "BRUTTO"),
         with_views(["belege_raw"], f"""SELECT BELEGNR,
CASE WHEN regexp_matches({STRIP.format(c='BRUTTO')}, '{NUMBER_RE}')
     THEN TRY_CAST({STRIP.format(c='BRUTTO')} AS DOUBLE) END AS BRUTTO FROM belege_raw"""))

register("prep_origin",
         lambda s, d: prep_orders(s, d).select("BELEGNR", "ORIGIN"),
         with_views(["po"], "SELECT BELEGNR, ORIGIN FROM po"))

register("prep_country",
         lambda s, d: prep_orders(s, d).select("BELEGNR", "ISOA2_LAND"),
         with_views(["po"], "SELECT BELEGNR, ISOA2_LAND FROM po"))

register("calendar_labels",
         lambda s, d: A.with_calendar(prep_events(s, d)),
         with_views(["pe"], """SELECT BELEGNR, "Date", "Month", "Week", "DayOfWeek", "Hour",
CAST(isodow(BELEGDAT) - 1 AS INTEGER) AS Weekday_Index FROM pe"""))

register("profit_margin",
         lambda s, d: A.with_margin(prep_orders(s, d)).select("BELEGNR", "profit_margin"),
         with_views(["po"], f"SELECT BELEGNR, {MARGIN} AS profit_margin FROM po"))

register("margin_bucket",
         lambda s, d: A.with_margin(prep_events(s, d)).select("BELEGNR", "profit_margin", "margin_category"),
         with_views(["pe"], f"""SELECT BELEGNR, m AS profit_margin, {MARGIN_BUCKET} AS margin_category
FROM (SELECT BELEGNR, {MARGIN} AS m FROM pe)"""))

register("positive_orders",
         lambda s, d: A.positive_orders(prep_orders(s, d)).select("BELEGNR", money("BRUTTO")),
         with_views(["po"], "SELECT BELEGNR, CAST(BRUTTO AS DOUBLE) AS BRUTTO FROM po WHERE BRUTTO > 0"))

register("customer_category",
         lambda s, d: (prep_orders(s, d).filter("KUNDENNR IS NOT NULL").groupBy("KUNDENNR")
                       .agg(F.count(F.lit(1)).alias("n"))
                       .withColumn("Category", A.lb.customer_category(F.col("n")))),
         with_views(["po"], f"""SELECT KUNDENNR, n, {CATEGORY} AS Category
FROM (SELECT KUNDENNR, COUNT(*) AS n FROM po WHERE KUNDENNR IS NOT NULL GROUP BY KUNDENNR)"""))


def _value_bucket_rows(s, d):
    from kontor.functions.buckets import with_value_buckets
    p = A.positive_orders(prep_events(s, d))
    return with_value_buckets(p, "BRUTTO", "Value_Range").select("BELEGNR", money("BRUTTO"), "Value_Range")


register("order_value_bucket", _value_bucket_rows,
         with_views(["pe"], "SELECT BELEGNR, CAST(BRUTTO AS DOUBLE) AS BRUTTO, Value_Range FROM labelled",
                    value_bins_sql("pe")))

register("document_type_name",
         lambda s, d: prep_orders(s, d).select(
             "BELEGNR", "BELEGART", A.lb.document_type_name(F.col("BELEGART")).alias("Document_Type_Name")),
         with_views(["po"], """SELECT BELEGNR, BELEGART, COALESCE(CASE BELEGART WHEN 'RE' THEN 'Invoice (Rechnung)'
WHEN 'GU' THEN 'Credit Note (Gutschrift)' WHEN 'V' THEN 'Sale (Verkauf)' END, BELEGART) AS Document_Type_Name FROM po"""))

register("country_name",
         lambda s, d: prep_orders(s, d).select("BELEGNR", "ISOA2_LAND",
                                              A.lb.country_name(F.col("ISOA2_LAND")).alias("Country_Name")),
         with_views(["po"], f"SELECT BELEGNR, ISOA2_LAND, {COUNTRY_NAME.format(c='ISOA2_LAND')} AS Country_Name FROM po"))

# =====================================================================================
# D / T / W: analytics
# =====================================================================================


def _kpi_sql(v: str, measures: list[str], extra_dims: list[str]) -> str:
    parts = []
    if "BRUTTO" in measures:
        parts += [f"{TOTAL('BRUTTO')} AS total_gross_revenue", f"{MEAN('BRUTTO')} AS avg_order_value_gross",
                  "CAST(MAX(BRUTTO) AS DOUBLE) AS max_order_gross", "CAST(MIN(BRUTTO) AS DOUBLE) AS min_order_gross"]
    if "NETTO" in measures:
        parts += [f"{TOTAL('NETTO')} AS total_net_revenue", f"{MEAN('NETTO')} AS avg_order_value_net"]
    if "ERLOES" in measures:
        parts += [f"{TOTAL('ERLOES')} AS total_profit", f"{MEAN('ERLOES')} AS avg_profit_per_order"]
    parts += ["COUNT(*) AS total_orders", "COUNT(DISTINCT KUNDENNR) AS unique_customers",
              "COUNT(DISTINCT ORIGIN) AS platforms"]
    if "ISOA2_LAND" in extra_dims:
        parts.append("COUNT(DISTINCT ISOA2_LAND) AS countries")
    parts += ["COUNT(*) / GREATEST(COUNT(DISTINCT KUNDENNR), 1) AS orders_per_customer",
              "MIN(BELEGDAT) AS date_range_start", "MAX(BELEGDAT) AS date_range_end",
              "CAST(floor((epoch_us(MAX(BELEGDAT)) - epoch_us(MIN(BELEGDAT))) / 86400000000) + 1 AS BIGINT) AS days_span",
              "COUNT(*) / GREATEST(CAST(floor((epoch_us(MAX(BELEGDAT)) - epoch_us(MIN(BELEGDAT))) / 86400000000) + 1 AS BIGINT), 1) AS avg_orders_per_day",
              "CASE WHEN SUM(BRUTTO) > 0 THEN CAST(SUM(ERLOES) AS DOUBLE) / CAST(SUM(BRUTTO) AS DOUBLE) * 100.0 END AS profit_margin_pct"]
    return with_views([v], "SELECT " + ",\n  ".join(parts) + f" FROM {v}")


register("kpi_metrics", lambda s, d: A.kpi_metrics(prep_orders(s, d)),
         _kpi_sql("po", ["BRUTTO", "NETTO", "ERLOES"], ["ISOA2_LAND"]))
register("kpi_metrics_events", lambda s, d: A.kpi_metrics(prep_events(s, d)),
         _kpi_sql("pe", ["BRUTTO", "ERLOES"], []))


# The same report over documents with only some columns adapts its output
register("kpi_metrics_partial_columns",
         lambda s, d: A.kpi_metrics(prepare(AD.belege_orders(s, d).select("BELEGNR", "ORIGIN", "BELEGDAT", "BRUTTO"))),
         with_views(["po"], f"""SELECT {TOTAL('BRUTTO')} AS total_gross_revenue, {MEAN('BRUTTO')} AS avg_order_value_gross,
CAST(MAX(BRUTTO) AS DOUBLE) AS max_order_gross, CAST(MIN(BRUTTO) AS DOUBLE) AS min_order_gross,
COUNT(*) AS total_orders, COUNT(DISTINCT ORIGIN) AS platforms,
MIN(BELEGDAT) AS date_range_start, MAX(BELEGDAT) AS date_range_end,
CAST(floor((epoch_us(MAX(BELEGDAT)) - epoch_us(MIN(BELEGDAT))) / 86400000000) + 1 AS BIGINT) AS days_span,
COUNT(*) / GREATEST(CAST(floor((epoch_us(MAX(BELEGDAT)) - epoch_us(MIN(BELEGDAT))) / 86400000000) + 1 AS BIGINT), 1)
  AS avg_orders_per_day FROM po"""))


def _summary_sql(v: str, key: str, measures: list[str], order: str = "") -> str:
    parts = [key]
    if "BRUTTO" in measures:
        parts += [f"{TOTAL('BRUTTO')} AS BRUTTO_sum", f"{MEAN('BRUTTO')} AS BRUTTO_mean", "COUNT(BRUTTO) AS BRUTTO_count"]
    if "NETTO" in measures:
        parts += [f"{TOTAL('NETTO')} AS NETTO_sum", f"{MEAN('NETTO')} AS NETTO_mean"]
    if "ERLOES" in measures:
        parts += [f"{TOTAL('ERLOES')} AS ERLOES_sum", f"{MEAN('ERLOES')} AS ERLOES_mean"]
    return with_views([v], f"SELECT {', '.join(parts)} FROM {v} WHERE {key} IS NOT NULL GROUP BY {key}")


ALL3 = ["BRUTTO", "NETTO", "ERLOES"]
register("platform_summary", lambda s, d: A.platform_summary(prep_orders(s, d)), _summary_sql("po", "ORIGIN", ALL3))
register("platform_summary_events", lambda s, d: A.platform_summary(prep_events(s, d)),
         _summary_sql("pe", "ORIGIN", ["BRUTTO", "ERLOES"]))
register("country_summary", lambda s, d: A.country_summary(prep_orders(s, d)), _summary_sql("po", "ISOA2_LAND", ALL3))


def _amount_share_sql(key: str) -> str:
    return with_views(["po"], f"""SELECT {key}, COALESCE(CAST(s AS DOUBLE), 0.0) AS BRUTTO, {SHARE('s')} AS percentage
FROM (SELECT {key}, SUM(BRUTTO) AS s FROM po WHERE {key} IS NOT NULL GROUP BY {key})""")


def _count_share_sql(key: str) -> str:
    return with_views(["po"], f"""SELECT {key}, order_count, {SHARE('order_count')} AS percentage
FROM (SELECT {key}, COUNT(*) AS order_count FROM po WHERE {key} IS NOT NULL GROUP BY {key})""")


register("platform_share", lambda s, d: A.platform_share(prep_orders(s, d)), _amount_share_sql("ORIGIN"))
register("platform_orders", lambda s, d: A.platform_orders(prep_orders(s, d)), _count_share_sql("ORIGIN"))
register("country_share", lambda s, d: A.country_share(prep_orders(s, d)), _amount_share_sql("ISOA2_LAND"))
register("country_orders", lambda s, d: A.country_orders(prep_orders(s, d)), _count_share_sql("ISOA2_LAND"))

PLATFORMS = ["Amazon", "Ebay", "Kaufland", "Unknown"]
register("country_platform_matrix",
         lambda s, d: A.country_platform_matrix(prep_orders(s, d), PLATFORMS),
         with_views(["po"], "SELECT ISOA2_LAND, " + ", ".join(
             f"COALESCE(CAST(SUM(BRUTTO) FILTER (WHERE ORIGIN = '{p}') AS DOUBLE), 0.0) AS \"{p}\"" for p in PLATFORMS)
             + " FROM po WHERE ISOA2_LAND IS NOT NULL AND ORIGIN IS NOT NULL GROUP BY ISOA2_LAND"))
register("country_platform_matrix_dynamic",
         lambda s, d: A.country_platform_matrix(prep_orders(s, d)),
         REGISTRY["country_platform_matrix"].sql)
register("country_platform_map",
         lambda s, d: A.country_platform_map(prep_orders(s, d)).select("ISOA2_LAND", F.explode("platforms").alias("ORIGIN", "BRUTTO")),
         with_views(["po"], """SELECT c.ISOA2_LAND, p.ORIGIN, COALESCE(s.BRUTTO, 0.0) AS BRUTTO
FROM (SELECT DISTINCT ISOA2_LAND FROM po) c CROSS JOIN (SELECT DISTINCT ORIGIN FROM po) p
LEFT JOIN (SELECT ISOA2_LAND, ORIGIN, CAST(SUM(BRUTTO) AS DOUBLE) AS BRUTTO FROM po GROUP BY ALL) s
ON s.ISOA2_LAND = c.ISOA2_LAND AND s.ORIGIN = p.ORIGIN"""))
register("country_platform_long", lambda s, d: A.country_platform_long(prep_orders(s, d)),
         with_views(["po"], f"""SELECT ISOA2_LAND, ORIGIN, {TOTAL('BRUTTO')} AS BRUTTO FROM po
WHERE ISOA2_LAND IS NOT NULL AND ORIGIN IS NOT NULL GROUP BY ISOA2_LAND, ORIGIN"""))

register("daily_trend", lambda s, d: A.daily_trend(prep_orders(s, d)),
         with_views(["po"], f"""SELECT "Date", {TOTAL('BRUTTO')} AS Gross_Revenue, {TOTAL('NETTO')} AS Net_Revenue,
{TOTAL('ERLOES')} AS Profit, COUNT(BELEGDAT) AS Order_Count FROM po WHERE "Date" IS NOT NULL GROUP BY "Date" """))
register("daily_trend_events", lambda s, d: A.daily_trend(prep_events(s, d)),
         with_views(["pe"], f"""SELECT "Date", {TOTAL('BRUTTO')} AS BRUTTO, {TOTAL('ERLOES')} AS ERLOES,
COUNT(BELEGDAT) AS BELEGDAT FROM pe WHERE "Date" IS NOT NULL GROUP BY "Date" """))


def _period_sql(key: str) -> str:
    return with_views(["po"], f"""SELECT "{key}", {TOTAL('BRUTTO')} AS BRUTTO, {TOTAL('ERLOES')} AS ERLOES,
COUNT(BELEGDAT) AS BELEGDAT FROM po WHERE "{key}" IS NOT NULL GROUP BY "{key}" """)


register("weekly_trend", lambda s, d: A.weekly_trend(prep_orders(s, d)), _period_sql("Week"))
register("monthly_trend", lambda s, d: A.monthly_trend(prep_orders(s, d)), _period_sql("Month"))
register("day_of_week", lambda s, d: A.day_of_week(prep_orders(s, d)),
         with_views(["po"], f"""SELECT "DayOfWeek", {TOTAL('BRUTTO')} AS Total_Revenue, {MEAN('BRUTTO')} AS Avg_Revenue,
COUNT(BRUTTO) AS Order_Count FROM po WHERE "DayOfWeek" IS NOT NULL GROUP BY "DayOfWeek" """))


def _hourly_sql(v: str) -> str:
    return with_views([v], f"""SELECT "Hour", {TOTAL('BRUTTO')} AS Total_Revenue, COUNT(BRUTTO) AS Order_Count
FROM {v} WHERE "Hour" IS NOT NULL GROUP BY "Hour" """)


register("hourly_pattern", lambda s, d: A.hourly_pattern(prep_events(s, d)), _hourly_sql("pe"))
register("hourly_pattern_orders", lambda s, d: A.hourly_pattern(prep_orders(s, d)), _hourly_sql("po"))

_ALL_CUSTOMERS_SQL = f"""SELECT KUNDENNR AS Customer_ID, NAME2 AS Customer_Name, {TOTAL('BRUTTO')} AS Total_Revenue,
{TOTAL('ERLOES')} AS Total_Profit, COUNT(BELEGNR) AS Order_Count
FROM po WHERE KUNDENNR IS NOT NULL AND NAME2 IS NOT NULL GROUP BY KUNDENNR, NAME2"""
register("all_customers", lambda s, d: A.all_customers(prep_orders(s, d)), with_views(["po"], _ALL_CUSTOMERS_SQL))
register("top_customers", lambda s, d: A.top_customers(prep_orders(s, d)),
         with_views(["po"], f"""SELECT * FROM ({_ALL_CUSTOMERS_SQL})
ORDER BY Total_Revenue DESC, Customer_ID, Customer_Name LIMIT 20"""))
register("customer_frequency", lambda s, d: A.customer_frequency(prep_orders(s, d)),
         with_views(["po"], f"""SELECT {CATEGORY} AS Category, COUNT(KUNDENNR) AS Customer_Count,
CAST(SUM(n) AS BIGINT) AS Total_Orders
FROM (SELECT KUNDENNR, COUNT(*) AS n FROM po WHERE KUNDENNR IS NOT NULL GROUP BY KUNDENNR) GROUP BY 1"""))
register("first_order_date", lambda s, d: A.first_order_date(prep_orders(s, d)),
         with_views(["po"], """SELECT KUNDENNR, MIN("Date") AS first_order_date FROM po
WHERE KUNDENNR IS NOT NULL AND "Date" IS NOT NULL GROUP BY KUNDENNR"""))
register("tag_new_customer_orders",
         lambda s, d: A.tag_new_customer_orders(prep_orders(s, d)).select(
             "BELEGNR", "KUNDENNR", "Date", "first_order_date", "is_new_customer"),
         with_views(["po"], """SELECT BELEGNR, po.KUNDENNR, "Date", f.first_order_date, "Date" = f.first_order_date AS is_new_customer
FROM po JOIN (SELECT KUNDENNR, MIN("Date") AS first_order_date FROM po
              WHERE KUNDENNR IS NOT NULL AND "Date" IS NOT NULL GROUP BY KUNDENNR) f ON po.KUNDENNR = f.KUNDENNR
WHERE "Date" IS NOT NULL"""))
register("new_vs_returning", lambda s, d: A.new_vs_returning(prep_orders(s, d)),
         with_views(["po"], """SELECT "Date",
CAST(COUNT(*) FILTER (WHERE "Date" <> f) AS BIGINT) AS Returning, CAST(COUNT(*) FILTER (WHERE "Date" = f) AS BIGINT) AS New
FROM (SELECT "Date", MIN("Date") OVER (PARTITION BY KUNDENNR) AS f FROM po
      WHERE KUNDENNR IS NOT NULL AND "Date" IS NOT NULL) GROUP BY "Date" """))
register("new_vs_returning_events", lambda s, d: A.new_vs_returning(prep_events(s, d)),
         with_views(["pe"], """SELECT "Date",
CAST(COUNT(*) FILTER (WHERE "Date" <> f) AS BIGINT) AS Returning, CAST(COUNT(*) FILTER (WHERE "Date" = f) AS BIGINT) AS New
FROM (SELECT "Date", MIN("Date") OVER (PARTITION BY KUNDENNR) AS f FROM pe
      WHERE KUNDENNR IS NOT NULL AND "Date" IS NOT NULL) GROUP BY "Date" """))

register("document_type_summary", lambda s, d: A.document_type_summary(prep_orders(s, d)),
         with_views(["po"], f"""SELECT BELEGART AS Document_Type, {TOTAL('BRUTTO')} AS Gross_Revenue,
{TOTAL('NETTO')} AS Net_Revenue, {TOTAL('ERLOES')} AS Profit, COUNT(BELEGNR) AS Count
FROM po WHERE BELEGART IS NOT NULL GROUP BY BELEGART"""))


register("document_type_summary_named", lambda s, d: A.document_type_summary(prep_orders(s, d), with_names=True),
         with_views(["po"], f"""SELECT BELEGART AS Document_Type, {TOTAL('BRUTTO')} AS Gross_Revenue,
{TOTAL('NETTO')} AS Net_Revenue, {TOTAL('ERLOES')} AS Profit, COUNT(BELEGNR) AS Count,
COALESCE(CASE BELEGART WHEN 'RE' THEN 'Invoice (Rechnung)' WHEN 'GU' THEN 'Credit Note (Gutschrift)'
              WHEN 'V' THEN 'Sale (Verkauf)' END, BELEGART) AS Document_Type_Name
FROM po WHERE BELEGART IS NOT NULL GROUP BY BELEGART"""))


def _margin_dist_sql(v: str) -> str:
    return with_views([v], f"""SELECT Margin_Category, COUNT(BELEGNR) AS Order_Count, {TOTAL('BRUTTO')} AS Total_Revenue,
{TOTAL('ERLOES')} AS Total_Profit
FROM (SELECT *, {MARGIN_BUCKET} AS Margin_Category FROM (SELECT *, {MARGIN} AS m FROM {v}))
WHERE Margin_Category IS NOT NULL GROUP BY Margin_Category""")


register("margin_distribution", lambda s, d: A.margin_distribution(prep_orders(s, d)), _margin_dist_sql("po"))
register("margin_distribution_events", lambda s, d: A.margin_distribution(prep_events(s, d)), _margin_dist_sql("pe"))
register("platform_profitability", lambda s, d: rounded(A.platform_profitability(prep_orders(s, d)), "Avg_Margin"),
         with_views(["po"], f"""SELECT ORIGIN AS Platform, COALESCE(CAST(SUM(BRUTTO) AS DOUBLE), 0.0) AS Gross_Revenue,
{TOTAL('NETTO')} AS Net_Revenue, COALESCE(CAST(SUM(ERLOES) AS DOUBLE), 0.0) AS Total_Profit, round(AVG(m), 6) AS Avg_Margin,
COALESCE(CAST(SUM(ERLOES) AS DOUBLE), 0.0) / NULLIF(COALESCE(CAST(SUM(BRUTTO) AS DOUBLE), 0.0), 0) * 100.0 AS Profit_Margin_Pct
FROM (SELECT *, {MARGIN} AS m FROM po) WHERE ORIGIN IS NOT NULL GROUP BY ORIGIN"""))
register("country_profitability", lambda s, d: rounded(A.country_profitability(prep_orders(s, d)), "Avg_Margin"),
         with_views(["po"], f"""SELECT ISOA2_LAND AS Country, COALESCE(CAST(SUM(BRUTTO) AS DOUBLE), 0.0) AS Gross_Revenue,
COALESCE(CAST(SUM(ERLOES) AS DOUBLE), 0.0) AS Total_Profit, round(AVG(m), 6) AS Avg_Margin,
COALESCE(CAST(SUM(ERLOES) AS DOUBLE), 0.0) / NULLIF(COALESCE(CAST(SUM(BRUTTO) AS DOUBLE), 0.0), 0) * 100.0 AS Profit_Margin_Pct
FROM (SELECT *, {MARGIN} AS m FROM po) WHERE ISOA2_LAND IS NOT NULL GROUP BY ISOA2_LAND"""))

_ORDER_LINE_SQL = """SELECT BELEGNR AS Document_Nr, ORDER_ID AS Order_ID, NAME2 AS Customer, ORIGIN AS Platform,
CAST(BRUTTO AS DOUBLE) AS Gross_Revenue, CAST(ERLOES AS DOUBLE) AS Profit, m AS "Margin_%"
FROM (SELECT *, {margin} AS m FROM po) ORDER BY {order} LIMIT 20"""
register("top_profitable_orders", lambda s, d: A.top_profitable_orders(prep_orders(s, d)),
         with_views(["po"], _ORDER_LINE_SQL.format(margin=MARGIN, order="ERLOES DESC NULLS LAST, BELEGNR")))
register("low_margin_orders", lambda s, d: A.low_margin_orders(prep_orders(s, d)),
         with_views(["po"], _ORDER_LINE_SQL.format(margin=MARGIN, order="m ASC NULLS LAST, BELEGNR")))

register("payment_summary", lambda s, d: A.payment_summary(prep_orders(s, d)),
         with_views(["po"], f"""SELECT ZAHLART AS Payment_Method, {TOTAL('BRUTTO')} AS Total_Revenue,
{TOTAL('ERLOES')} AS Total_Profit, COUNT(BELEGNR) AS Order_Count FROM po WHERE ZAHLART IS NOT NULL GROUP BY ZAHLART"""))


def _value_dist_sql(v: str, where: str = "") -> str:
    return with_views([v], f"""SELECT Value_Range, COUNT(BRUTTO) AS Order_Count, {TOTAL('BRUTTO')} AS Total_Revenue
FROM labelled WHERE Value_Range IS NOT NULL GROUP BY Value_Range""", value_bins_sql(v, where))


register("order_value_distribution", lambda s, d: A.order_value_distribution(prep_orders(s, d)),
         _value_dist_sql("po"))
register("order_value_distribution_events", lambda s, d: A.order_value_distribution(prep_events(s, d)),
         _value_dist_sql("pe"))
register("order_value_distribution_small_orders",
         lambda s, d: A.order_value_distribution(prep_events(s, d).withColumn("BRUTTO", F.col("BRUTTO") * F.lit(Decimal("0.1")))),
         _value_dist_sql("pe_tenth"))


def _value_stats_sql(v: str) -> str:
    x = "CAST(BRUTTO AS DOUBLE)"
    return with_views([v], f"""SELECT {MEAN('BRUTTO')} AS mean, round(quantile_cont({x}, 0.5), 6) AS median,
round(stddev_samp({x}), 6) AS std, CAST(MIN(BRUTTO) AS DOUBLE) AS min, CAST(MAX(BRUTTO) AS DOUBLE) AS max,
round(quantile_cont({x}, 0.25), 6) AS q25, round(quantile_cont({x}, 0.75), 6) AS q75
FROM {v} WHERE BRUTTO > 0""")


register("order_value_stats", lambda s, d: rounded(A.order_value_stats(prep_orders(s, d)), *STATS), _value_stats_sql("po"))
register("order_value_stats_events", lambda s, d: rounded(A.order_value_stats(prep_events(s, d)), *STATS), _value_stats_sql("pe"))

register("top_countries_chart", lambda s, d: A.top_countries_chart(prep_orders(s, d)),
         with_views(["po"], f"""SELECT ISOA2_LAND, BRUTTO, percentage, {COUNTRY_NAME.format(c='ISOA2_LAND')} AS Country_Name
FROM (SELECT ISOA2_LAND, COALESCE(CAST(s AS DOUBLE), 0.0) AS BRUTTO, {SHARE('s')} AS percentage
      FROM (SELECT ISOA2_LAND, SUM(BRUTTO) AS s FROM po WHERE ISOA2_LAND IS NOT NULL GROUP BY ISOA2_LAND))
ORDER BY BRUTTO DESC, ISOA2_LAND LIMIT 10"""))
register("country_table", lambda s, d: A.country_table(prep_orders(s, d)),
         with_views(["po"], f"""SELECT {COUNTRY_NAME.format(c='ISOA2_LAND')} AS Country, BRUTTO_sum, BRUTTO_count, BRUTTO_mean
FROM (SELECT ISOA2_LAND, {TOTAL('BRUTTO')} AS BRUTTO_sum, COUNT(BRUTTO) AS BRUTTO_count, {MEAN('BRUTTO')} AS BRUTTO_mean
      FROM po WHERE ISOA2_LAND IS NOT NULL GROUP BY ISOA2_LAND)
ORDER BY BRUTTO_sum DESC, ISOA2_LAND LIMIT 10"""))


def queries() -> dict[str, SparkQuery]:
    return {k: q.run for k, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q.sql for k, q in REGISTRY.items() if q.sql is not None}


# reconciliation entries live in their own module; importing it registers them
from kontor.plans import registry_reconcile  # noqa: E402,F401
from kontor.plans import registry_sources  # noqa: E402,F401

# W1 on its own: share of each platform in the number of event documents (D3/D4/D6/D7 use the same window)
register("share_of_total",
         lambda s, d: A.with_share(A.keyed_measures(prep_events(s, d), ("ORIGIN",)), "n").select("ORIGIN", "n", "percentage"),
         with_views(["pe"], f"""SELECT ORIGIN, n, {SHARE('n')} AS percentage
FROM (SELECT ORIGIN, COUNT(*) AS n FROM pe WHERE ORIGIN IS NOT NULL GROUP BY ORIGIN)"""))

from kontor.plans import registry_composites  # noqa: E402,F401
