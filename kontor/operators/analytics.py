"""Report families over prepared ledger documents.

Conventions (these reproduce the semantics of grouped reports on a data frame
library): group keys that are NULL are dropped; a sum over only NULLs is 0;
a mean ignores NULLs; ``count`` counts non-NULL values.

Money columns may be DECIMAL (exact) or DOUBLE. Sums are taken in the input
type and cast to DOUBLE only in the final projection; means are sum/count,
so results do not depend on how partial aggregates are combined.

Scale notes: every report is one ``groupBy`` (map-side partial aggregation,
one shuffle on the group key; a hot platform or country shrinks to one
partial row per task before the shuffle). Shares of the total are windows
over the *aggregated* rows only. The new-vs-returning split aggregates to
(customer, day) before looking for each customer's first day, so a customer
with a third of all documents contributes at most one row per day to that
window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.functions import buckets as bk
from kontor.functions import calendar as cal
from kontor.functions import constants as K
from kontor.functions import labels as lb
from kontor.operators.prepare import MissingColumn, require
from kontor.session import landed


# --- aggregate helpers --------------------------------------------------------

def total(c: str | Column) -> Column:
    """Sum as DOUBLE; 0 when there is nothing to add."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(c).cast("double"), F.lit(0.0))


def mean(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))


def with_share(g: DataFrame, c: str, out: str = "percentage") -> DataFrame:
    """``out`` = percent of ``c`` in the grand total of the aggregated rows.

    The total is a window over the *aggregated* rows (one per platform or
    country), so the single window partition holds one row per group, not the
    documents. A scalar-subquery total was measured as well: AQE reuses the
    input exchanges but re-runs the join and final aggregation, which costs
    more at scale than this window."""
    total = F.sum(c).over(Window.partitionBy())
    return g.withColumn(out, F.try_divide(F.col(c).cast("double"), total.cast("double")) * F.lit(100.0))


def profit_margin(erloes: str = "ERLOES", brutto: str = "BRUTTO") -> Column:
    """ERLOES / BRUTTO * 100 per document; BRUTTO 0 -> NULL."""
    return F.try_divide(F.col(erloes).cast("double"), F.col(brutto).cast("double")) * F.lit(100.0)


def _has(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


def _keyed(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull())


# --- D1 ---------------------------------------------------------------------

def kpi_metrics(prep: DataFrame) -> DataFrame:
    """One row of KPIs; columns appear only when their inputs exist.

    The documents are first reduced to one row per (customer, platform, country); distinct values are
    counted on those rows, so no document is expanded once per distinct count."""
    amounts = [c for c in ("BRUTTO", "NETTO", "ERLOES") if c in prep.columns]
    keys = [c for c in ("KUNDENNR", "ORIGIN", "ISOA2_LAND") if c in prep.columns]
    parts = [F.count(F.lit(1)).alias("_n")]
    for c in amounts:
        parts += [F.sum(c).alias(f"_s_{c}"), F.count(c).alias(f"_c_{c}")]
    if "BRUTTO" in amounts:
        parts += [F.max("BRUTTO").alias("_max"), F.min("BRUTTO").alias("_min")]
    if _has(prep, "BELEGDAT"):
        parts += [F.min("BELEGDAT").alias("_from"), F.max("BELEGDAT").alias("_to")]
    small = prep.groupBy(*keys).agg(*parts)

    def all_of(c: str) -> Column:
        return F.coalesce(F.sum(f"_s_{c}").cast("double"), F.lit(0.0))

    def mean_of(c: str) -> Column:
        return F.try_divide(F.sum(f"_s_{c}").cast("double"), F.sum(f"_c_{c}").cast("double"))

    aggs = []
    if "BRUTTO" in amounts:
        aggs += [all_of("BRUTTO").alias("total_gross_revenue"), mean_of("BRUTTO").alias("avg_order_value_gross"),
                 F.max("_max").cast("double").alias("max_order_gross"), F.min("_min").cast("double").alias("min_order_gross")]
    if "NETTO" in amounts:
        aggs += [all_of("NETTO").alias("total_net_revenue"), mean_of("NETTO").alias("avg_order_value_net")]
    if "ERLOES" in amounts:
        aggs += [all_of("ERLOES").alias("total_profit"), mean_of("ERLOES").alias("avg_profit_per_order")]
    aggs.append(F.coalesce(F.sum("_n"), F.lit(0)).alias("total_orders"))
    aggs += [F.count_distinct(c).alias(name) for c, name in (
        ("KUNDENNR", "unique_customers"), ("ORIGIN", "platforms"), ("ISOA2_LAND", "countries")) if c in keys]
    if _has(prep, "BELEGDAT"):
        aggs += [F.min("_from").alias("date_range_start"), F.max("_to").alias("date_range_end")]
    if _has(prep, "BRUTTO", "ERLOES"):
        aggs += [F.sum("_s_BRUTTO").alias("_sb"), F.sum("_s_ERLOES").alias("_se")]
    k = small.agg(*aggs)
    out = [c for c in k.columns if not c.startswith("_") and not c.startswith("date_range")]
    cols = [F.col(c) for c in out]
    if "unique_customers" in k.columns:
        cols.append((F.col("total_orders") / F.greatest(F.col("unique_customers"), F.lit(1)))
                    .alias("orders_per_customer"))
    if "date_range_start" in k.columns:
        span = (F.floor((F.unix_micros("date_range_end") - F.unix_micros("date_range_start"))
                        / F.lit(86_400_000_000)) + F.lit(1)).cast("long")
        cols += [F.col("date_range_start").cast("timestamp_ntz").alias("date_range_start"),
                 F.col("date_range_end").cast("timestamp_ntz").alias("date_range_end"),
                 span.alias("days_span"),
                 (F.col("total_orders") / F.greatest(span, F.lit(1))).alias("avg_orders_per_day")]
    if "_sb" in k.columns:
        cols.append(F.when(F.col("_sb") > 0, F.col("_se").cast("double") / F.col("_sb").cast("double")
                           * F.lit(100.0)).alias("profit_margin_pct"))
    return k.select(*cols)


# --- keyed measures: what every keyed report needs, per key --------------------

# keys of the reports that are plain aggregations over one (or two) columns
KEYED_SETS = [("ORIGIN",), ("ISOA2_LAND",), ("ISOA2_LAND", "ORIGIN"), ("Date",), ("Week",), ("Month",),
              ("DayOfWeek",), ("Hour",), ("BELEGART",), ("ZAHLART",), ("margin_category",)]


def _measures(df: DataFrame) -> list[Column]:
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.count(c).alias(f"cnt_{c}") for c in ("BELEGNR", "BELEGDAT") if c in df.columns]
    for m in ("BRUTTO", "NETTO", "ERLOES", "profit_margin"):
        if m in df.columns:
            aggs += [F.sum(m).alias(f"sum_{m}"), F.count(m).alias(f"cnt_{m}")]
    return aggs


def _measure_input(prep: DataFrame) -> DataFrame:
    return with_margin(prep) if _has(prep, "ERLOES", "BRUTTO") else prep


def keyed_measures(prep: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Counts and exact sums per non-NULL ``keys`` (one ``groupBy``)."""
    d = _measure_input(prep)
    for k in keys:
        d = _keyed(d, k)
    return d.groupBy(*keys).agg(*_measures(d))


def keyed_measure_sets(prep: DataFrame) -> dict:
    """The measures of every keyed report from ONE pass over the documents:
    a ``groupingSets`` aggregation (partial aggregation per set, one shuffle),
    written once -- it has one row per key value -- and sliced per key.

    Written, not persisted: where one query unites several slices, Spark numbers the
    columns of the later ones anew, no longer finds the persisted aggregation in them and
    runs it again for each.

    Returns {keys tuple: slice}, plus "_all" (the whole frame)."""
    d = _measure_input(prep)
    sets = [st for st in KEYED_SETS if all(k in d.columns for k in st)]
    keys = list(dict.fromkeys(k for st in sets for k in st))
    g = landed(d.groupingSets([[F.col(k) for k in st] for st in sets], *[F.col(k) for k in keys])
               .agg(*_measures(d), F.grouping_id().alias("_gid")), "keyed")
    measure_cols = [c for c in g.columns if c not in keys and c != "_gid"]
    out: dict = {"_all": g}
    for st in sets:
        gid = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in st)
        sl = g.filter(F.col("_gid") == gid)
        for k in st:
            sl = sl.filter(F.col(k).isNotNull())
        out[st] = sl.select(*st, *measure_cols)
    return out


def _tot(m: str) -> Column:
    return F.coalesce(F.col(f"sum_{m}").cast("double"), F.lit(0.0))


def _avg(m: str) -> Column:
    return F.try_divide(F.col(f"sum_{m}").cast("double"), F.col(f"cnt_{m}").cast("double"))


def _present(sl: DataFrame, *ms: str) -> list[str]:
    return [m for m in ms if f"sum_{m}" in sl.columns]


# --- D2-D8: platform and geography -------------------------------------------

def _measure_summary(sl: DataFrame, key: str) -> DataFrame:
    cols = [F.col(key)]
    for m in _present(sl, "BRUTTO", "NETTO", "ERLOES"):
        cols += [_tot(m).alias(f"{m}_sum"), _avg(m).alias(f"{m}_mean")]
        if m == "BRUTTO":
            cols.append(F.col("cnt_BRUTTO").alias("BRUTTO_count"))
    if len(cols) == 1:
        raise MissingColumn(f"summary by {key} needs one of BRUTTO, NETTO, ERLOES")
    order = ["BRUTTO_sum", "BRUTTO_mean", "BRUTTO_count", "NETTO_sum", "NETTO_mean", "ERLOES_sum", "ERLOES_mean"]
    out = sl.select(*cols)
    return out.select(key, *[c for c in order if c in out.columns])


def platform_summary(prep: DataFrame, measures: DataFrame | None = None) -> DataFrame:
    require(prep, "ORIGIN", report="platform_summary")
    sl = measures if measures is not None else keyed_measures(prep, ("ORIGIN",))
    return _measure_summary(sl, "ORIGIN").orderBy("ORIGIN")


def _amount_share(sl: DataFrame, key: str) -> DataFrame:
    return with_share(sl, "sum_BRUTTO").select(key, _tot("BRUTTO").alias("BRUTTO"), "percentage")


def _count_share(sl: DataFrame, key: str) -> DataFrame:
    return with_share(sl.withColumnRenamed("n", "order_count"), "order_count").select(key, "order_count", "percentage")


def platform_share(prep: DataFrame, measures: DataFrame | None = None) -> DataFrame:
    require(prep, "ORIGIN", "BRUTTO", report="platform_share")
    sl = measures if measures is not None else keyed_measures(prep, ("ORIGIN",))
    return _amount_share(sl, "ORIGIN").orderBy("ORIGIN")


def platform_orders(prep: DataFrame, measures: DataFrame | None = None) -> DataFrame:
    require(prep, "ORIGIN", report="platform_orders")
    sl = measures if measures is not None else keyed_measures(prep, ("ORIGIN",))
    return _count_share(sl, "ORIGIN").orderBy("ORIGIN")


def country_summary(prep: DataFrame, measures: DataFrame | None = None) -> DataFrame:
    require(prep, "ISOA2_LAND", report="country_summary")
    sl = measures if measures is not None else keyed_measures(prep, ("ISOA2_LAND",))
    s = _measure_summary(sl, "ISOA2_LAND")
    return s.orderBy(F.desc("BRUTTO_sum"), "ISOA2_LAND") if "BRUTTO_sum" in s.columns else s


def country_share(prep: DataFrame, measures: DataFrame | None = None) -> DataFrame:
    require(prep, "ISOA2_LAND", "BRUTTO", report="country_share")
    sl = measures if measures is not None else keyed_measures(prep, ("ISOA2_LAND",))
    return _amount_share(sl, "ISOA2_LAND").orderBy(F.desc("BRUTTO"), "ISOA2_LAND")


def country_orders(prep: DataFrame, measures: DataFrame | None = None) -> DataFrame:
    require(prep, "ISOA2_LAND", report="country_orders")
    sl = measures if measures is not None else keyed_measures(prep, ("ISOA2_LAND",))
    return _count_share(sl, "ISOA2_LAND").orderBy(F.desc("order_count"), "ISOA2_LAND")


def country_platform_matrix(prep: DataFrame, platforms: list[str] | None = None,
                            measures: DataFrame | None = None) -> DataFrame:
    """Country x platform gross revenue, one column per platform, gaps 0.

    The pivot runs on the (country, platform) measures, one row per pair.
    Pass ``platforms`` when known; otherwise Spark first finds the distinct
    platforms (a small distinct job, bounded by spark.sql.pivotMaxValues)."""
    require(prep, "ISOA2_LAND", "ORIGIN", "BRUTTO", report="country_platform_matrix")
    sl = measures if measures is not None else keyed_measures(prep, ("ISOA2_LAND", "ORIGIN"))
    g = sl.groupBy("ISOA2_LAND")
    p = g.pivot("ORIGIN", platforms) if platforms is not None else g.pivot("ORIGIN")
    m = p.agg(F.sum("sum_BRUTTO"))
    vals = [c for c in m.columns if c != "ISOA2_LAND"]
    quoted = {v: "`" + v.replace("`", "``") + "`" for v in vals}
    return m.select("ISOA2_LAND", *[F.coalesce(F.col(quoted[v]).cast("double"), F.lit(0.0)).alias(v)
                                    for v in vals]).orderBy("ISOA2_LAND")


def country_platform_long(prep: DataFrame, measures: DataFrame | None = None) -> DataFrame:
    """Long form of the matrix: (ISOA2_LAND, ORIGIN, BRUTTO)."""
    require(prep, "ISOA2_LAND", "ORIGIN", "BRUTTO", report="country_platform_long")
    sl = measures if measures is not None else keyed_measures(prep, ("ISOA2_LAND", "ORIGIN"))
    return sl.select("ISOA2_LAND", "ORIGIN", _tot("BRUTTO").alias("BRUTTO"))


def country_platform_map(prep: DataFrame, measures: DataFrame | None = None) -> DataFrame:
    """The matrix for any number of platforms: (ISOA2_LAND, platforms), a map from every platform, in order, to the
    gross revenue of the country there, gaps 0.

    Columns have to be known when a query is planned, keys of a map have not: the platforms do not go through
    the driver. A row is as wide as there are platforms, not documents."""
    require(prep, "ISOA2_LAND", "ORIGIN", "BRUTTO", report="country_platform_map")
    sl = measures if measures is not None else keyed_measures(prep, ("ISOA2_LAND", "ORIGIN"))
    # every cell of the matrix once, then what there is for it
    cells = (sl.select("ISOA2_LAND").distinct()
             .withColumn("_every", sl.agg(F.collect_set("ORIGIN").alias("p")).scalar())
             .select("ISOA2_LAND", F.explode("_every").alias("ORIGIN")))
    filled = cells.join(sl.select("ISOA2_LAND", "ORIGIN", _tot("BRUTTO").alias("_v")), ["ISOA2_LAND", "ORIGIN"], "left")
    entry = F.struct("ORIGIN", F.coalesce("_v", F.lit(0.0)).alias("_v"))
    return (filled.groupBy("ISOA2_LAND").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("platforms"))
            .orderBy("ISOA2_LAND"))


# --- D9-D13: time ---------------------------------------------------------------

def daily_trend(prep: DataFrame, measures: DataFrame | None = None) -> DataFrame:
    require(prep, "BELEGDAT", report="daily_trend")
    present = [m for m in ("BRUTTO", "NETTO", "ERLOES") if m in prep.columns]
    if not present:
        raise MissingColumn("daily_trend needs at least one of BRUTTO, NETTO, ERLOES")
    sl = measures if measures is not None else keyed_measures(prep, ("Date",))
    named = len(present) == 3
    names = {"BRUTTO": "Gross_Revenue", "NETTO": "Net_Revenue", "ERLOES": "Profit"}
    cols = [_tot(m).alias(names[m] if named else m) for m in present]
    cols.append(F.col("cnt_BELEGDAT").alias("Order_Count" if named else "BELEGDAT"))
    return sl.select("Date", *cols).orderBy("Date")


def _period_trend(prep: DataFrame, key: str, measures: DataFrame | None) -> DataFrame:
    present = [m for m in ("BRUTTO", "ERLOES") if m in prep.columns]
    if not present:
        raise MissingColumn(f"{key} trend needs BRUTTO or ERLOES")
    sl = measures if measures is not None else keyed_measures(prep, (key,))
    cols = [_tot(m).alias(m) for m in present] + [F.col("cnt_BELEGDAT").alias("BELEGDAT")]
    return sl.select(key, *cols).orderBy(key)


def weekly_trend(prep: DataFrame, measures: DataFrame | None = None) -> DataFrame:
    require(prep, "BELEGDAT", report="weekly_trend")
    return _period_trend(prep, "Week", measures)


def monthly_trend(prep: DataFrame, measures: DataFrame | None = None) -> DataFrame:
    require(prep, "BELEGDAT", report="monthly_trend")
    return _period_trend(prep, "Month", measures)


def day_of_week(prep: DataFrame, measures: DataFrame | None = None) -> DataFrame:
    require(prep, "BELEGDAT", "BRUTTO", report="day_of_week")
    sl = measures if measures is not None else keyed_measures(prep, ("DayOfWeek",))
    order = F.array_position(F.array(*[F.lit(d) for d in K.WEEKDAYS]), F.col("DayOfWeek"))
    return (sl.select("DayOfWeek", _tot("BRUTTO").alias("Total_Revenue"), _avg("BRUTTO").alias("Avg_Revenue"),
                      F.col("cnt_BRUTTO").alias("Order_Count"))
            .orderBy(order))


def hourly_pattern(prep: DataFrame, measures: DataFrame | None = None) -> DataFrame:
    require(prep, "BELEGDAT", "BRUTTO", report="hourly_pattern")
    sl = measures if measures is not None else keyed_measures(prep, ("Hour",))
    return (sl.select("Hour", _tot("BRUTTO").alias("Total_Revenue"), F.col("cnt_BRUTTO").alias("Order_Count"))
            .orderBy("Hour"))


# --- D14-D16, C5, W2: customers -----------------------------------------------------

def _customer_name_col(prep: DataFrame) -> str | None:
    return "NAME2" if "NAME2" in prep.columns else ("NAME1" if "NAME1" in prep.columns else None)


def customer_day_measures(prep: DataFrame) -> DataFrame:
    """Per (customer, name, day): row count, document count and exact sums.

    One aggregation (partial, then a shuffle on the customer) shared by every
    customer report of the full analysis; a customer with a third of all
    documents is reduced map-side to one row per (name, day)."""
    require(prep, "KUNDENNR", report="customer reports")
    name = _customer_name_col(prep)
    keys = ["KUNDENNR"] + ([name] if name else []) + (["Date"] if "Date" in prep.columns else [])
    d = _keyed(prep, "KUNDENNR")
    return d.groupBy(*keys).agg(*_measures(d))


def all_customers(prep: DataFrame, measures: DataFrame | None = None) -> DataFrame:
    require(prep, "KUNDENNR", "BELEGNR", report="all_customers")
    present = [m for m in ("BRUTTO", "ERLOES") if m in prep.columns]
    if "ERLOES" in present:
        require(prep, "BRUTTO", report="all_customers")
    if not present:
        raise MissingColumn("all_customers needs BRUTTO")
    name = _customer_name_col(prep)
    keys = ["KUNDENNR"] + ([name] if name else [])
    if measures is not None:
        d = measures
        for k in keys:
            d = _keyed(d, k)
        sl = d.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in d.columns if c.startswith(("sum_", "cnt_"))])
    else:
        d = prep
        for k in keys:
            d = _keyed(d, k)
        sl = d.groupBy(*keys).agg(*_measures(d))
    cols = [F.col("KUNDENNR").alias("Customer_ID")] + ([F.col(name).alias("Customer_Name")] if name else [])
    cols.append(_tot("BRUTTO").alias("Total_Revenue"))
    if "ERLOES" in present:
        cols.append(_tot("ERLOES").alias("Total_Profit"))
    cols.append(F.col("cnt_BELEGNR").alias("Order_Count"))
    tie = ["Customer_ID"] + (["Customer_Name"] if name else [])
    return sl.select(*cols).orderBy(F.desc("Total_Revenue"), *tie)


def top_customers(prep: DataFrame, n: int = K.TOP_CUSTOMERS, measures: DataFrame | None = None) -> DataFrame:
    """The first ``n`` of :func:`all_customers` (top-k, no full sort)."""
    return all_customers(prep, measures).limit(n)


def customer_frequency(prep: DataFrame, measures: DataFrame | None = None) -> DataFrame:
    require(prep, "KUNDENNR", report="customer_frequency")
    if measures is not None:
        per_customer = measures.groupBy("KUNDENNR").agg(F.sum("n").alias("n"))
    else:
        per_customer = _keyed(prep, "KUNDENNR").groupBy("KUNDENNR").agg(F.count(F.lit(1)).alias("n"))
    return (per_customer.groupBy(lb.customer_category(F.col("n")).alias("Category"))
            .agg(F.count("KUNDENNR").alias("Customer_Count"), F.sum("n").cast("long").alias("Total_Orders"))
            .orderBy("Category"))


def first_order_date(prep: DataFrame) -> DataFrame:
    """First day with a dated document per customer."""
    require(prep, "KUNDENNR", "BELEGDAT", report="first_order_date")
    return (_keyed(_keyed(prep, "KUNDENNR"), "Date").groupBy("KUNDENNR")
            .agg(F.min("Date").alias("first_order_date")))


def tag_new_customer_orders(prep: DataFrame) -> DataFrame:
    """Documents with a customer and a date, flagged when on the customer's first day.

    The first days are one row per customer, joined back by key; AQE splits a
    hot customer's partition (skew join) or broadcasts the table when small."""
    first = first_order_date(prep)
    d = _keyed(_keyed(prep, "KUNDENNR"), "Date")
    return (d.join(first, "KUNDENNR")
            .withColumn("is_new_customer", F.col("Date") == F.col("first_order_date")))


def new_vs_returning(prep: DataFrame, measures: DataFrame | None = None) -> DataFrame:
    """Per day, documents of returning and of new customers."""
    require(prep, "KUNDENNR", "BELEGDAT", report="new_vs_returning")
    if measures is not None:
        per_day = _keyed(measures, "Date").groupBy("KUNDENNR", "Date").agg(F.sum("n").alias("n"))
    else:
        per_day = (_keyed(_keyed(prep, "KUNDENNR"), "Date").groupBy("KUNDENNR", "Date")
                   .agg(F.count(F.lit(1)).alias("n")))
    first = F.min("Date").over(Window.partitionBy("KUNDENNR"))
    tagged = per_day.withColumn("is_new", F.col("Date") == first)
    return (tagged.groupBy("Date")
            .agg(F.coalesce(F.sum(F.when(~F.col("is_new"), F.col("n"))), F.lit(0)).cast("long").alias("Returning"),
                 F.coalesce(F.sum(F.when(F.col("is_new"), F.col("n"))), F.lit(0)).cast("long").alias("New"))
            .orderBy("Date"))


# --- D17: document types ---------------------------------------------------------

def document_type_summary(prep: DataFrame, with_names: bool = False,
                          measures: DataFrame | None = None) -> DataFrame:
    require(prep, "BELEGART", "BELEGNR", report="document_type_summary")
    present = [m for m in ("BRUTTO", "NETTO", "ERLOES") if m in prep.columns]
    if not present:
        raise MissingColumn("document_type_summary needs a measure")
    sl = measures if measures is not None else keyed_measures(prep, ("BELEGART",))
    named = len(present) == 3
    names = {"BRUTTO": "Gross_Revenue", "NETTO": "Net_Revenue", "ERLOES": "Profit"}
    key = "Document_Type" if named else "BELEGART"
    cols = [F.col("BELEGART").alias(key)] + [_tot(m).alias(names[m] if named else m) for m in present]
    cols.append(F.col("cnt_BELEGNR").alias("Count" if named else "BELEGNR"))
    g = sl.select(*cols)
    if with_names:
        g = g.withColumn("Document_Type_Name", lb.document_type_name(F.col(key)))
    return g.orderBy(key)


# --- D18-D20, T2, T3: profitability -------------------------------------------------

def with_margin(prep: DataFrame) -> DataFrame:
    """B19 + B22: per-document margin and its bin."""
    require(prep, "ERLOES", "BRUTTO", report="profitability")
    return (prep.withColumn("profit_margin", profit_margin())
            .withColumn("margin_category", lb.margin_bucket(F.col("profit_margin"))))


def margin_distribution(prep: DataFrame, measures: DataFrame | None = None) -> DataFrame:
    require(prep, "BELEGNR", "ERLOES", "BRUTTO", report="margin_distribution")
    sl = measures if measures is not None else keyed_measures(prep, ("margin_category",))
    return (sl.select(F.col("margin_category").alias("Margin_Category"), F.col("cnt_BELEGNR").alias("Order_Count"),
                      _tot("BRUTTO").alias("Total_Revenue"), _tot("ERLOES").alias("Total_Profit"))
            .orderBy(lb.margin_bucket_order(F.col("Margin_Category"))))


def _profitability(prep: DataFrame, key: str, out_key: str, with_net: bool,
                   measures: DataFrame | None) -> DataFrame:
    require(prep, "ERLOES", "BRUTTO", report="profitability")
    if with_net:
        require(prep, "NETTO", report="platform_profitability")
    sl = measures if measures is not None else keyed_measures(prep, (key,))
    gross, profit = _tot("BRUTTO"), _tot("ERLOES")
    cols = [F.col(key).alias(out_key), gross.alias("Gross_Revenue")]
    if with_net:
        cols.append(_tot("NETTO").alias("Net_Revenue"))
    cols += [profit.alias("Total_Profit"), _avg("profit_margin").alias("Avg_Margin"),
             (F.try_divide(profit, gross) * F.lit(100.0)).alias("Profit_Margin_Pct")]
    return sl.select(*cols)


def platform_profitability(prep: DataFrame, measures: DataFrame | None = None) -> DataFrame:
    require(prep, "ORIGIN", report="platform_profitability")
    return _profitability(prep, "ORIGIN", "Platform", True, measures).orderBy("Platform")


def country_profitability(prep: DataFrame, measures: DataFrame | None = None) -> DataFrame:
    require(prep, "ISOA2_LAND", report="country_profitability")
    return (_profitability(prep, "ISOA2_LAND", "Country", False, measures)
            .orderBy(F.desc("Total_Profit"), "Country"))


def _order_lines(m: DataFrame) -> DataFrame:
    return m.select(F.col("BELEGNR").alias("Document_Nr"), F.col("ORDER_ID").alias("Order_ID"),
                    F.col("NAME2").alias("Customer"), F.col("ORIGIN").alias("Platform"),
                    F.col("BRUTTO").cast("double").alias("Gross_Revenue"),
                    F.col("ERLOES").cast("double").alias("Profit"),
                    F.col("profit_margin").alias("Margin_%"))


def top_profitable_orders(prep: DataFrame, n: int = K.TOP_ORDERS) -> DataFrame:
    require(prep, "BELEGNR", "ORDER_ID", "NAME2", "ORIGIN", report="top_profitable_orders")
    m = with_margin(prep)
    return _order_lines(m.orderBy(F.col("ERLOES").desc_nulls_last(), F.col("BELEGNR")).limit(n))


def low_margin_orders(prep: DataFrame, n: int = K.TOP_ORDERS) -> DataFrame:
    require(prep, "BELEGNR", "ORDER_ID", "NAME2", "ORIGIN", report="low_margin_orders")
    m = with_margin(prep)
    return _order_lines(m.orderBy(F.col("profit_margin").asc_nulls_last(), F.col("BELEGNR")).limit(n))


# --- D21: payment -------------------------------------------------------------------

def payment_summary(prep: DataFrame, measures: DataFrame | None = None) -> DataFrame:
    require(prep, "ZAHLART", "BELEGNR", "BRUTTO", report="payment_summary")
    sl = measures if measures is not None else keyed_measures(prep, ("ZAHLART",))
    cols = [F.col("ZAHLART").alias("Payment_Method"), _tot("BRUTTO").alias("Total_Revenue")]
    if "ERLOES" in prep.columns:
        cols.append(_tot("ERLOES").alias("Total_Profit"))
    cols.append(F.col("cnt_BELEGNR").alias("Order_Count"))
    return sl.select(*cols).orderBy(F.desc("Total_Revenue"), "Payment_Method")


# --- D22, D23: order values -----------------------------------------------------------

def positive_orders(prep: DataFrame) -> DataFrame:
    """Documents with a positive gross amount."""
    require(prep, "BRUTTO", report="positive_orders")
    return prep.filter(F.col("BRUTTO") > 0)


def order_value_distribution(prep: DataFrame) -> DataFrame:
    """Order count and revenue per value bin of positive orders, in bin order.

    One pass over the documents: rows are aggregated by their bin number in
    each of the three candidate edge sets (a handful of groups) together with
    the maximum; the edge set, bin and label are then chosen on that tiny
    result (the global maximum is a window over it)."""
    pos = positive_orders(prep)
    g = (pos.groupBy(*bk.candidate_bins(F.col("BRUTTO")))
         .agg(F.count("BRUTTO").alias("_n"), F.sum("BRUTTO").alias("_s"), F.max("BRUTTO").alias("_mx")))
    g = g.withColumn("_max", F.max("_mx").over(Window.partitionBy()))
    i, label = bk.chosen_bin(F.col("_max"))
    return (g.select(i.alias("value_bin"), label.alias("Value_Range"), "_n", "_s")
            .filter(F.col("value_bin").isNotNull())
            .groupBy("value_bin", "Value_Range")
            .agg(F.sum("_n").alias("Order_Count"), F.coalesce(F.sum("_s").cast("double"), F.lit(0.0)).alias("Total_Revenue"))
            .orderBy("value_bin")
            .select("Value_Range", "Order_Count", "Total_Revenue"))


def order_value_stats(prep: DataFrame, exact: bool = True) -> DataFrame:
    """mean, median, std (n-1), min, max, q25, q75 of positive gross amounts.

    Quantiles are exact (linear interpolation) by radix selection
    (:mod:`kontor.operators.quantiles`), never one task holding every value;
    ``exact=False`` uses ``percentile_approx`` and stays fully lazy."""
    v = F.col("BRUTTO").cast("double")
    pos = positive_orders(prep)
    s = pos.agg(mean("BRUTTO").alias("mean"), F.stddev_samp(v).alias("std"),
                F.min("BRUTTO").cast("double").alias("min"), F.max("BRUTTO").cast("double").alias("max"))
    if exact:
        from kontor.operators.quantiles import exact_quantiles
        q = exact_quantiles(pos, "BRUTTO", [0.25, 0.5, 0.75])
        qs = [F.lit(q[p]).cast("double") for p in (0.25, 0.5, 0.75)]
    else:
        approx = F.percentile_approx(v, [0.25, 0.5, 0.75], 10000)
        s = pos.agg(mean("BRUTTO").alias("mean"), F.stddev_samp(v).alias("std"),
                    F.min("BRUTTO").cast("double").alias("min"), F.max("BRUTTO").cast("double").alias("max"),
                    approx.alias("_q"))
        qs = [F.col("_q")[i] for i in range(3)]
    return s.select("mean", qs[1].alias("median"), "std", "min", "max", qs[0].alias("q25"), qs[2].alias("q75"))


# --- T4, T5: dashboard tables --------------------------------------------------------

def top_countries_chart(prep: DataFrame, n: int = K.TOP_COUNTRIES, measures: DataFrame | None = None) -> DataFrame:
    s = country_share(prep, measures).limit(n)
    return s.withColumn("Country_Name", lb.country_name(F.col("ISOA2_LAND")))


def country_table(prep: DataFrame, n: int = K.TOP_COUNTRIES, measures: DataFrame | None = None) -> DataFrame:
    require(prep, "ISOA2_LAND", "BRUTTO", report="country_table")
    s = country_summary(prep, measures).limit(n)
    return s.select(lb.country_name(F.col("ISOA2_LAND")).alias("Country"),
                    "BRUTTO_sum", "BRUTTO_count", "BRUTTO_mean")


def with_calendar(prep: DataFrame) -> DataFrame:
    """B5-B9 alone: (BELEGNR, Date, Month, Week, DayOfWeek, Hour, weekday index)."""
    return prep.select("BELEGNR", "Date", "Month", "Week", "DayOfWeek", "Hour",
                       cal.weekday_index(F.col("BELEGDAT")).alias("Weekday_Index"))
