"""The adapter views reproduce the counts stated for them at sf0.01."""

import pytest
from pyspark.sql import functions as F

from kontor.operators import reconcile as R
from kontor.sources import adapters as AD

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def orders(spark):
    return AD.belege_orders(spark, SF)


def test_documents(orders):
    assert orders.count() == 15000
    assert orders.select("ORDER_ID").distinct().count() == 7500
    assert orders.filter(F.col("BRUTTO") == 0).count() == 257


def test_customer_categories(spark, orders):
    from kontor.operators.analytics import customer_frequency
    from kontor.operators.prepare import prepare
    got = {r.Category: r.Customer_Count for r in customer_frequency(prepare(orders)).collect()}
    assert got == {"One-time": 2, "Occasional (2-3)": 18, "Regular (4-10)": 856, "Loyal (10+)": 624}


def test_export_rows(spark, orders):
    shop = AD.shop_export(spark, SF)
    assert shop.count() == 60000
    typ = {r.typ: r["count"] for r in shop.groupBy("typ").count().collect()}
    assert typ["Andere Gebühr"] == 2876 and typ[None] == 2843
    assert R.match_orders(shop, orders).count() == 30178
    assert shop.select("file_id", "row_idx").distinct().count() == 60000


def test_margin_bins(orders):
    from kontor.operators.analytics import margin_distribution, with_margin
    from kontor.operators.prepare import prepare
    prep = prepare(orders)
    got = [r.Order_Count for r in margin_distribution(prep).collect()]
    assert got == [1092, 358, 607, 1000, 1666, 2609, 7411]
    assert with_margin(prep).filter(F.col("profit_margin").isNull()).count() == 257
