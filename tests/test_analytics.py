"""Report semantics on micro frames, and invariants on the adapter data."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kontor.operators import analytics as A
from kontor.operators.prepare import prepare
from kontor.plans import registry as REG
from tests.conftest import SF_SMALL

DOC_SCHEMA = "BELEGNR string, ORDER_ID string, KUNDENNR string, NAME2 string, BELEGDAT string, ORIGIN string, " \
             "ISOA2_LAND string, BELEGART string, ZAHLART string, NETTO string, BRUTTO string, ERLOES string"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC_SCHEMA)


def test_days_span_counts_elapsed_days(spark):
    d = docs(spark, [("1", "o1", "k1", "n", "2025-10-27 23:00:00", "Amazon", "DE", "RE", "p", "1", "2", "1"),
                     ("2", "o2", "k1", "n", "2025-10-28 01:00:00", "Ebay", None, "RE", "p", "1", "2", "1")])
    k = A.kpi_metrics(prepare(d)).collect()[0]
    assert k.days_span == 1 and k.total_orders == 2 and k.countries == 2 and k.platforms == 2
    assert k.profit_margin_pct == pytest.approx(50.0)


def test_null_sums_are_zero_and_null_keys_dropped(spark):
    d = docs(spark, [("1", "o", "k", "n", "2025-01-01", " Amazon ", "DE", "RE", "p", None, None, None),
                     ("2", "o", "k", "n", "2025-01-01", None, "DE", "RE", "p", "x", "1,5", None)])
    p = A.platform_summary(prepare(d)).collect()
    by = {r.ORIGIN: r for r in p}
    assert set(by) == {"Amazon", "Unknown"}
    assert by["Amazon"].BRUTTO_sum == 0.0 and by["Amazon"].BRUTTO_mean is None and by["Amazon"].BRUTTO_count == 0
    t = A.all_customers(prepare(d.withColumn("KUNDENNR", F.lit(None).cast("string"))))
    assert t.count() == 0


def test_new_vs_returning_single_class(spark):
    d = docs(spark, [("1", "o", "k1", "n", "2025-01-01", "A", "DE", "RE", "p", "1", "1", "1"),
                     ("2", "o", "k2", "n", "2025-01-01", "A", "DE", "RE", "p", "1", "1", "1")])
    r = A.new_vs_returning(prepare(d)).collect()
    assert [(x.Date, x.Returning, x.New) for x in r] == [(dt.date(2025, 1, 1), 0, 2)]


def test_zero_gross_gives_null_margin(spark):
    d = docs(spark, [("1", "o", "k", "n", "2025-01-01", "A", "DE", "RE", "p", "0", "0", "5"),
                     ("2", "o", "k", "n", "2025-01-01", "A", "DE", "RE", "p", "10", "10", "0")])
    m = A.with_margin(prepare(d)).orderBy("BELEGNR").select("profit_margin", "margin_category").collect()
    assert [tuple(x) for x in m] == [(None, None), (0.0, "Negative")]


def test_missing_column_raises(spark):
    d = spark.createDataFrame([("1", 2.0)], "BELEGNR string, BRUTTO double")
    with pytest.raises(ValueError):
        A.payment_summary(prepare(d))
    assert A.kpi_metrics(prepare(d)).columns[:1] == ["total_gross_revenue"]


def test_invariants_on_adapter_data(spark):
    prep = REG.prep_orders(spark, SF_SMALL)
    n = prep.count()
    share = A.platform_share(prep).agg(F.sum("percentage")).collect()[0][0]
    assert share == pytest.approx(100.0)
    bins = A.margin_distribution(prep).agg(F.sum("Order_Count")).collect()[0][0]
    null_margins = A.with_margin(prep).filter(F.col("profit_margin").isNull()).count()
    assert bins + null_margins == n
    nvr = A.new_vs_returning(prep).agg(F.sum(F.col("New") + F.col("Returning"))).collect()[0][0]
    assert nvr == prep.filter("KUNDENNR IS NOT NULL AND Date IS NOT NULL").count()
    freq = A.customer_frequency(prep).agg(F.sum("Total_Orders")).collect()[0][0]
    assert freq == n


def test_exact_quantiles_digit_by_digit(spark):
    import random

    import numpy as np

    from kontor.operators.quantiles import exact_quantiles
    rnd = random.Random(5)
    wide = [rnd.choice([-1, 1]) * rnd.uniform(1, 2) * 2.0 ** rnd.randint(-1070, 1020) for _ in range(500)]
    cases = ([round(rnd.uniform(0, 500), 2) for _ in range(4000)] + [77.7] * 2000, wide + [0.0, -0.0, 5e-324, 1.7e308],
             [1.0, np.nextafter(1.0, 2), np.nextafter(1.0, 0), 1.0, 2.0 ** 52, 2.0 ** 52 + 1], [-3.0, -3.0, -2.5, 0.0], [4.25])
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    for vals in cases:
        df = spark.createDataFrame([(float(v),) for v in [*vals, float("nan")]] + [(None,)], "x double")
        order = sorted(float(v) for v in vals)
        for bits in (13, 4):
            got = exact_quantiles(df, "x", probs, bits=bits)
            for p in probs:
                at = p * (len(order) - 1)
                lo, hi = order[int(at)], order[min(int(at) + 1, len(order) - 1)]
                assert got[p] == (lo if at == int(at) else lo + (hi - lo) * (at - int(at)))
    assert exact_quantiles(df.limit(0), "x", [0.5]) == {0.5: None}


@pytest.mark.parametrize("mx", [100.0, 500.0, 600.0, 999.0, 1000.5, 1234.56])
def test_one_pass_distribution_matches_row_bins(spark, mx):
    from kontor.functions.buckets import with_value_buckets
    vals = [0.5, 10.0, 10.01, 49.99, 50.0, 99.0, 100.0, 250.0, 500.0, 750.0, 999.0, 1000.0, mx]
    vals = [v for v in vals if v <= mx]
    d = spark.createDataFrame([(str(i), str(v)) for i, v in enumerate(vals)] + [("z", "0"), ("y", "-3")],
                              "BELEGNR string, BRUTTO string")
    got = [tuple(r) for r in A.order_value_distribution(prepare(d)).collect()]
    rows = with_value_buckets(prepare(d).filter("BRUTTO > 0"), "BRUTTO", "label", "bin").filter("bin IS NOT NULL")
    want = [(r.label, r.n, r.s) for r in rows.groupBy("bin", "label").agg(
        F.count("BRUTTO").alias("n"), F.sum("BRUTTO").alias("s")).orderBy("bin").collect()]
    assert got == want and sum(n for _, n, _ in got) == len(vals)
