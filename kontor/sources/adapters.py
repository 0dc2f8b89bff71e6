"""Adapter views over the driver's TPC-H-like tables.

They present the tables as the two inputs this engine works on:
  * ledger documents (one row per accounting document), and
  * marketplace export rows (one row per export line, per export file).

Money is carried as exact DECIMAL (price DECIMAL(12,2), discount/tax
DECIMAL(4,2), quantity DECIMAL(6,2), retail price DECIMAL(10,2)) so sums do
not depend on the order in which partitions are combined.

Scale notes: the only large inputs are lineitem and orders. Lines are
aggregated per order before meeting orders (partial aggregation map-side,
then one shuffle on the order key, which the join reuses). Customer and part
are joined by key and left to Catalyst/AQE, which broadcasts them only when
their measured size is under ``spark.sql.autoBroadcastJoinThreshold``; nation
has 25 rows by definition and is broadcast explicitly.
"""

from __future__ import annotations

import os
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.operators.ordinal import ordinal


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# test-data shaping of the adapter (not values of the ledger application)
_PRIORITY_TO_ORIGIN = [("1-URGENT", "Amazon"), ("2-HIGH", "Ebay"), ("3-MEDIUM", "Kaufland"),
                       ("5-LOW", " Amazon ")]          # 4-NOT SPECIFIED -> NULL
_NATION_TO_ISO = ["DE", "AT", "FR", "CH", "IT", "ES", "NL", "BE", "PL", "LU"]  # keys 0..9
_STATUS_TO_TYPE = [("F", "RE"), ("P", "GU"), ("O", "V")]


def _case(col, pairs):
    expr = None
    for k, v in pairs:
        expr = F.when(col == k, v) if expr is None else expr.when(col == k, v)
    return expr


def cents(c: str) -> F.Column:
    """A 2-decimal money/rate column as exact integer hundredths (BIGINT)."""
    return F.round(F.col(c) * F.lit(100)).cast("long")


def from_fixed(c: F.Column, scale: int, precision: int = 18) -> F.Column:
    """Integer count of 10^-scale units -> exact DECIMAL(precision, scale)."""
    unit = Decimal(1).scaleb(-scale)
    return (c.cast("decimal(20,0)") * F.lit(unit)).cast(f"decimal({precision},{scale})")


def order_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: NETTO, BRUTTO and cost of goods, from lineitem ⋈ part.

    Line amounts are exact fixed-point integers (price in cents times discount
    and tax in hundredths), summed as 64-bit integers and turned into DECIMAL
    once per order: the same values as DECIMAL arithmetic without the cost of
    wide-decimal (BigDecimal) sums over every line."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    net_1e4 = cents("l_extendedprice") * (F.lit(100) - cents("l_discount"))            # 10^-4
    gross_1e6 = net_1e4 * (F.lit(100) + cents("l_tax"))                                  # 10^-6
    cost_1e4 = cents("l_quantity") * cents("p_retailprice")                              # 10^-4
    return (li.join(part, li.l_partkey == part.p_partkey)
            .groupBy("l_orderkey")
            .agg(F.sum(net_1e4).alias("net_1e4"), F.sum(gross_1e6).alias("gross_1e6"),
                 F.sum(cost_1e4).alias("cost_1e4"))
            .select("l_orderkey",
                    from_fixed(F.col("net_1e4"), 4).alias("net"),
                    from_fixed(F.col("gross_1e6"), 6).alias("gross"),
                    from_fixed(F.col("cost_1e4"), 4).alias("cost")))


def belege_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger documents from orders: two documents per ORDER_ID (last wins)."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    amounts = order_amounts(spark, sf_dir)
    iso = (F.when(F.col("n_nationkey") < 10,
                  F.element_at(F.array(*[F.lit(x) for x in _NATION_TO_ISO]), F.col("n_nationkey") + 1))
           .when(F.col("n_nationkey") < 20, F.col("n_name")))
    zero = F.lit(0).cast("decimal(38,6)")
    docs = (o.join(c, o.o_custkey == c.c_custkey)
            .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))   # 25 rows
            .join(amounts, o.o_orderkey == amounts.l_orderkey, "left"))
    return docs.select(
        F.col("o_orderkey").cast("string").alias("BELEGNR"),
        (F.col("o_orderkey") - F.col("o_orderkey") % 2).cast("string").alias("ORDER_ID"),
        F.col("o_custkey").cast("string").alias("KUNDENNR"),
        F.col("c_name").alias("NAME2"),
        F.col("o_orderdate").alias("BELEGDAT"),
        _case(F.col("o_orderpriority"), _PRIORITY_TO_ORIGIN).alias("ORIGIN"),
        iso.alias("ISOA2_LAND"),
        _case(F.col("o_orderstatus"), _STATUS_TO_TYPE).alias("BELEGART"),
        F.col("c_mktsegment").alias("ZAHLART"),
        F.coalesce(F.col("net"), zero).cast("decimal(18,4)").alias("NETTO"),
        F.coalesce(F.col("gross"), zero).cast("decimal(18,6)").alias("BRUTTO"),
        (F.coalesce(F.col("net"), zero) - F.coalesce(F.col("cost"), zero)).cast("decimal(18,4)").alias("ERLOES"),
        F.col("o_orderkey").alias("api_row"),
    )


def belege_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for the export lookups, with gaps so that the customer and the
    invoice number of one order can come from different documents: orders of
    unspecified priority carry no customer number, pending orders no invoice number."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return o.select(
        F.col("o_orderkey").cast("string").alias("BELEGNR_raw"),
        (F.col("o_orderkey") - F.col("o_orderkey") % 2).cast("string").alias("ORDER_ID"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_custkey").cast("string")).alias("KUNDENNR"),
        F.col("o_orderstatus"),
        F.col("o_orderkey").alias("api_row"),
    ).select("ORDER_ID", "KUNDENNR",
             F.when(F.col("o_orderstatus") != "P", F.col("BELEGNR_raw")).alias("BELEGNR"),
             "api_row")


def belege_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger documents from events: sub-second timestamps, no net/name/country."""
    e = table(spark, sf_dir, "events")
    gross = F.col("value").cast("decimal(12,2)")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").cast("string").alias("BELEGNR"),
        F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("ORDER_ID"),
        F.col("user_id").cast("string").alias("KUNDENNR"),
        F.col("ts").alias("BELEGDAT"),
        F.col("event_type").alias("ORIGIN"),
        gross.alias("BRUTTO"),
        (gross * (k - F.lit(30)) * F.lit(0.01).cast("decimal(2,2)")).alias("ERLOES"),
        F.col("event_id").alias("api_row"),
    )


def belege_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text, the way a JSON payload delivers them: dates in ISO,
    ISO date-only, DD.MM.YYYY or junk; amounts padded, comma-decimal or junk."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    p = F.col("o_orderpriority")
    d = F.col("o_orderdate")
    amt = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    belegdat = (F.when(p == "1-URGENT", F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
                .when(p == "2-HIGH", F.date_format(d, "dd.MM.yyyy"))
                .when(p == "3-MEDIUM", F.date_format(d, "yyyy-MM-dd"))
                .when(p == "4-NOT SPECIFIED", F.lit("n/a"))
                .otherwise(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")))
    brutto = (F.when(p == "1-URGENT", amt)
              .when(p == "2-HIGH", F.concat(F.lit("  "), amt, F.lit("\t")))
              .when(p == "3-MEDIUM", F.regexp_replace(amt, r"\.", ","))
              .when(p == "4-NOT SPECIFIED", F.lit(""))
              .otherwise(F.concat(amt, F.lit("e0"))))
    return o.select(F.col("o_orderkey").cast("string").alias("BELEGNR"),
                    belegdat.alias("BELEGDAT"), brutto.alias("BRUTTO"),
                    F.col("o_orderkey").alias("api_row"))


# --- marketplace export ------------------------------------------------------

EXPORT_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
EXPORT_FILES = 10


def shop_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export rows from lineitem, spread over 10 export files by supplier.

    ``row_idx`` numbers each file's rows in line order; it is computed with the
    bucketed ordinal (bounded window tasks plus a prefix sum over per-bucket
    counts), so one huge file does not end up in a single task."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    li = li.withColumn("file_id", (F.col("l_suppkey") % EXPORT_FILES).cast("string"))
    li = ordinal(li, ["file_id"], [F.col(c) for c in EXPORT_ORDER],
                 bucket=F.floor(F.col("l_orderkey") / F.lit(1 << 16)), out="row_idx")
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    qty = F.col("l_quantity").cast("decimal(6,2)")
    tax = F.col("l_tax").cast("decimal(4,2)")
    rf, ls, ln = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    typ = (F.when((rf == "A") & (ln == 7), F.lit("Andere Gebühr"))
           .when((rf == "N") & (ln == 6), F.lit(None).cast("string"))
           .when(rf == "R", F.lit("Rückerstattung"))
           .otherwise(F.lit("Bestellung")))
    ship = F.to_date(F.col("l_shipdate"))
    return li.select(
        "file_id", F.col("row_idx").cast("long").alias("row_idx"),
        ship.alias("datum"),
        typ.alias("typ"),
        F.col("l_orderkey").cast("string").alias("bestellnummer"),
        F.lit(None).cast("string").alias("alte_bestellnummer"),
        F.lit(None).cast("string").alias("nutzername"),
        F.lit(None).cast("string").alias("name"),
        (price * (F.lit(1) + tax)).cast("string").alias("transaktionsbetrag_raw"),
        price.cast("string").alias("zwischensumme_raw"),
        F.when(ls == "O", F.lit("4.99")).otherwise(F.lit("--")).alias("verpackung_raw"),
        F.when(typ == "Bestellung", F.lit("-0.35")).otherwise(F.lit("--")).alias("fixer_anteil_raw"),
        (qty * F.lit(-0.25).cast("decimal(3,2)")).cast("string").alias("variabler_anteil_raw"),
        F.when((rf == "A") & (ls == "F"), F.lit("-1.00")).otherwise(F.lit("—")).alias("gebuehr_hohe_quote_raw"),
        F.when(F.col("l_discount") >= 0.09, F.lit("-0.50")).alias("gebuehr_servicestatus_raw"),
        (tax * F.lit(-10)).cast("string").alias("internationale_gebuehr_raw"),
        (price - qty).cast("string").alias("betrag_abzgl_raw"),
        F.when(ls == "F", F.concat(F.lit("P"), F.date_format(ship, "yyyyMM"))).alias("auszahlungsnr"),
        F.when(ls == "F", F.date_format(ship, "yyyy-MM-dd")).otherwise(F.lit("")).alias("auszahlungsdatum"),
    )


def shop_preamble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows above each export's header: seller name and amount lines per
    supplier of the file, in supplier order (the last one wins)."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    s = s.withColumn("file_id", (F.col("s_suppkey") % EXPORT_FILES).cast("string"))
    seller = s.select("file_id", (F.col("s_suppkey") * 2).alias("row_idx"),
                      F.lit("Verkäufer").alias("c0"), F.col("s_name").alias("c1"))
    amount = s.select("file_id", (F.col("s_suppkey") * 2 + 1).alias("row_idx"),
                      F.lit("Betrag").alias("c0"),
                      F.col("s_acctbal").cast("decimal(12,2)").cast("string").alias("c1"))
    return seller.unionByName(amount)
