"""Hot keys: one order number / customer / export file holding a large share of rows.

Broadcasts are switched off and the skew thresholds lowered so that the
sort-merge join and AQE's skew split actually run; results must not change."""

import datetime as dt
from contextlib import contextmanager

from pyspark.sql import functions as F

from kontor.operators import analytics as A
from kontor.operators import reconcile as R
from kontor.operators.prepare import prepare


@contextmanager
def conf(spark, **kv):
    old = {k: spark.conf.get(k, None) for k in kv}
    for k, v in kv.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


SKEW = {"spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}


def test_hot_order_number_lookup(spark):
    n_hot, n_cold = 6000, 3000
    rows = ([("f", i, "2025-10-01", "Bestellung", "HOT", "1.00") for i in range(n_hot)]
            + [("f", n_hot + i, "2025-10-01", "Bestellung", f"o{i}", "1.00") for i in range(n_cold)])
    shop = spark.createDataFrame(rows, "file_id string, row_idx long, datum string, typ string, "
                                       "bestellnummer string, zwischensumme_raw string")
    for c in ["alte_bestellnummer", "nutzername", "name", "auszahlungsnr", "auszahlungsdatum"]:
        shop = shop.withColumn(c, F.lit(None).cast("string"))
    docs = spark.createDataFrame([("HOT", "K-old", "R-old", 1), ("HOT", "K-new", None, 2)]
                                 + [(f"o{i}", f"K{i}", f"R{i}", 10 + i) for i in range(n_cold)],
                                 "ORDER_ID string, KUNDENNR string, BELEGNR string, api_row long")
    with conf(spark, **SKEW):
        tx = R.attach_lookups(R.normalize_transactions(shop), docs)
        got = tx.groupBy("kdnr", "rgnr").count().filter("kdnr IN ('K-new', 'K1')").collect()
        m = {(r.kdnr, r.rgnr): r["count"] for r in got}
        assert m == {("K-new", "R-old"): n_hot, ("K1", "R1"): 1}
        assert tx.filter(F.col("kdnr").isNull()).count() == 0
        s = R.match_stats(shop, docs).collect()[0]
        assert (s.matched, s.total) == (n_hot + n_cold, n_hot + n_cold)


def test_hot_customer_new_vs_returning(spark):
    day = dt.datetime(2025, 1, 1)
    rows = [(str(i), "HOT", (day + dt.timedelta(days=i % 40)).isoformat(" "), "1") for i in range(3000)]
    rows += [(str(10000 + i), f"c{i}", (day + dt.timedelta(days=i % 40)).isoformat(" "), "1") for i in range(6000)]
    docs = spark.createDataFrame(rows, "BELEGNR string, KUNDENNR string, BELEGDAT string, BRUTTO string")
    with conf(spark, **SKEW):
        r = {x.Date: (x.New, x.Returning) for x in A.new_vs_returning(prepare(docs)).collect()}
    # day 0: the hot customer's first day (75 docs) + 150 first-time customers
    assert r[dt.date(2025, 1, 1)] == (75 + 150, 0)
    assert r[dt.date(2025, 1, 2)] == (150, 75)
    assert sum(n + ret for n, ret in r.values()) == 9000
