"""Column functions on hand-made micro frames (edge cases of the ledger semantics)."""

import datetime as dt

from pyspark.sql import functions as F

from kontor.functions import buckets as bk
from kontor.functions import calendar as cal
from kontor.functions import cleaning as cl
from kontor.functions import labels as lb


def one_col(spark, values, dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {dtype}")


def test_clean_amount(spark):
    vals = ["--", "—", None, " 1.5 ", "1_000", "1,23", "abc", "-0.35", "2e3", "1d", ""]
    got = [r[0] for r in one_col(spark, vals).select(cl.clean_amount(F.col("v"))).collect()]
    assert got == [0.0, 0.0, 0.0, 1.5, 1000.0, 0.0, 0.0, -0.35, 2000.0, 0.0, 0.0]


def test_parse_number_rejects_java_suffixes(spark):
    got = [r[0] for r in one_col(spark, ["1d", "1f", "12.5", " 7 ", "1,5", "NaN", "-3e-1"])
           .select(cl.parse_number(F.col("v"))).collect()]
    assert got == [None, None, 12.5, 7.0, None, None, -0.3]


def test_parse_timestamp_per_value(spark):
    got = [r[0] for r in one_col(spark, ["2025-10-28T14:05:00", "28.10.2025", "31.02.2025", "junk", None])
           .select(cl.parse_timestamp(F.col("v")).cast("timestamp_ntz")).collect()]
    assert got == [dt.datetime(2025, 10, 28, 14, 5), dt.datetime(2025, 10, 28), None, None, None]


def test_yyyymm(spark):
    got = [r[0] for r in one_col(spark, ["2025-10-28 10:00", "2025-1", None, "28.10.2025", "2025-1-5", "2025-13-01"])
           .select(cl.yyyymm(F.col("v"))).collect()]
    assert got == ["202510", "", "", "", "202501", ""]
    d = spark.createDataFrame([(dt.date(2024, 2, 29),), (None,)], "v date")
    assert [r[0] for r in d.select(cl.yyyymm(F.col("v"), d.schema["v"].dataType)).collect()] == ["202402", ""]


def test_date_validity(spark):
    got = [r[0] for r in one_col(spark, ["", None, "2025-10-01", "31.02.2025", "28.10.2025"])
           .select(cl.date_validity(F.col("v"))).collect()]
    assert got == ["Date empty", "Date empty", "Use DD.MM.YYYY format", "Invalid date", None]


def test_strip_keeps_empty_and_strips_tabs(spark):
    vals = ["\tAmazon ", "", " ", "\u00a0Ebay\u3000", "\x1cOtto\x85"]
    got = [r[0] for r in one_col(spark, vals).select(cl.strip_ws(F.col("v"))).collect()]
    assert got == [v.strip() for v in vals] == ["Amazon", "", "", "Ebay", "Otto"]


def test_week_label_sunday_and_monday(spark):
    d = spark.createDataFrame([(dt.datetime(2025, 10, 26, 23, 0),), (dt.datetime(2025, 10, 27, 0, 0),)], "t timestamp")
    got = [tuple(r) for r in d.select(cal.week_label(F.col("t")), cal.day_name(F.col("t")),
                                      cal.weekday_index(F.col("t"))).collect()]
    assert got == [("2025-10-20/2025-10-26", "Sunday", 6), ("2025-10-27/2025-11-02", "Monday", 0)]


def test_margin_bucket_edges(spark):
    got = [r[0] for r in one_col(spark, [-5.0, 0.0, 0.001, 10.0, 10.5, 50.0, 50.01, None], "double")
           .select(lb.margin_bucket(F.col("v"))).collect()]
    assert got == ["Negative", "Negative", "0-10%", "0-10%", "10-20%", "40-50%", "50%+", None]


def test_customer_category(spark):
    got = [r[0] for r in one_col(spark, [1, 2, 3, 4, 10, 11], "int").select(lb.customer_category(F.col("v"))).collect()]
    assert got == ["One-time", "Occasional (2-3)", "Occasional (2-3)", "Regular (4-10)", "Regular (4-10)", "Loyal (10+)"]


def test_country_and_document_names(spark):
    d = spark.createDataFrame([("DE", "RE"), ("XX", "ZZ"), ("Unknown", "V")], "c string, t string")
    got = [tuple(r) for r in d.select(lb.country_name(F.col("c")), lb.document_type_name(F.col("t"))).collect()]
    assert got == [("Germany", "Invoice (Rechnung)"), ("XX", "ZZ"), ("Unknown", "Sale (Verkauf)")]


def _bins(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "BRUTTO double")
    return [tuple(r) for r in bk.with_value_buckets(df, "BRUTTO", "label", "bin").select("BRUTTO", "bin", "label").collect()]


def test_value_bins_small_and_middle(spark):
    assert _bins(spark, [5, 10, 10.01, 100]) == [(5.0, 1, "€0-10"), (10.0, 1, "€0-10"), (10.01, 2, "€10-20"),
                                                 (100.0, 6, "€75-100")]
    assert _bins(spark, [1, 500])[1] == (500.0, 7, "€300-500")


def test_value_bins_zone_500_to_999(spark):
    # max in (500, 999]: fixed edges below max+1, then max+1 -- edges always increase
    assert _bins(spark, [600, 40]) == [(600.0, 6, "€500-601.00"), (40.0, 1, "€0-50")]
    assert _bins(spark, [999, 999])[0] == (999.0, 7, "€750-1000.00")
    got = _bins(spark, [1000.5, 1000, 20])
    assert got == [(1000.5, 8, "€1000-1001.50"), (1000.0, 7, "€750-1000"), (20.0, 1, "€0-50")]


def test_amount_cells_that_are_no_plain_number_are_still_cleaned(spark):
    cells = ["1.5", "1.5\n", " 1.5\t", "1.5 ", " -2e1　", "1_000.5", "1d", "Infinity", "--", "—", "", None, "+.5", "5."]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = [r.v for r in df.select("i", cl.clean_amount(F.col("c")).alias("v")).orderBy("i").collect()]
    assert got == [1.5, 1.5, 1.5, 1.5, -20.0, 1000.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5, 5.0]


def test_no_generated_method_is_too_long_to_be_compiled(spark):
    from kontor.session import configure
    configure(spark)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
