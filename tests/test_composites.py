"""Composite jobs P1-P3 and the streaming landing."""

import json
import os

from pyspark.sql import functions as F

from kontor.operators import analytics as A
from kontor.operators.prepare import prepare
from kontor.plans import composites as P
from kontor.sources import adapters as AD
from kontor.streaming import landing as L
from tests.conftest import SF_SMALL
from tests.test_sources import write_exports


def test_full_analysis_and_dashboard(spark):
    docs = AD.belege_orders(spark, SF_SMALL)
    a = P.full_analysis(docs)
    assert set(a) >= {"kpis", "platform", "geographic", "time", "customer", "document_type", "profitability",
                      "payment", "order_value"}
    assert a["kpis"].collect()[0].total_orders == docs.count()
    assert a["customer"]["top_customers"].count() == 20
    a["_prep"].unpersist()
    d = P.dashboard_frames(docs)
    assert {"platform_revenue", "countries", "top_customers", "order_value"} <= set(d)
    assert d["countries"].count() == 10


def test_full_analysis_adapts_to_columns(spark):
    ev = AD.belege_events(spark, SF_SMALL)
    a = P.full_analysis(ev)
    assert "geographic" in a and a["geographic"] == {}          # no country column
    assert "payment_summary" not in a["payment"]
    assert a["time"]["hourly_pattern"].count() > 0


def test_match_and_process(spark, tmp_dir):
    root = write_exports(tmp_dir, {"a.csv": (11, False)})
    docs = spark.createDataFrame([("100", "K1", "R1", 1)], "ORDER_ID string, KUNDENNR string, BELEGNR string, api_row long")
    out = P.match_and_process(spark, root, docs, account="4711")
    assert out["matched"].count() == 1
    s = out["match_stats"].collect()[0]
    assert (s.matched, s.total) == (1, 4)
    assert out["report_lines"].filter("section = 'totals'").count() == 1
    assert {r.G for r in out["report_lines"].filter("section = 'gebuehr'").collect()} == {"4711"}
    fixed = P.match_and_process(spark, root, docs, fixed_header_for_matching=True)
    assert fixed["match_stats"].collect()[0].total == 4


def test_streaming_landing(spark, tmp_dir):
    inbox = os.path.join(tmp_dir, "inbox")
    os.makedirs(inbox)
    payload = {"data": [{"BELEGNR": "1", "ORDER_ID": "o1", "BELEGDAT": "28.10.2025", "ORIGIN": " Ebay ",
                         "BRUTTO": "12.50"},
                        {"BELEGNR": "2", "ORDER_ID": "o2", "BELEGDAT": "2025-10-29", "BRUTTO": "x"}]}
    with open(os.path.join(inbox, "p1.json"), "w") as f:
        json.dump(payload, f)
    table, ckpt = os.path.join(tmp_dir, "table"), os.path.join(tmp_dir, "ckpt")
    q = L.land_documents(spark, inbox, table, ckpt)
    q.awaitTermination(120)
    got = spark.read.parquet(table).orderBy("BELEGNR").collect()
    assert [(r.BELEGNR, r.ORIGIN, r.BRUTTO, r.DayOfWeek) for r in got] == [("1", "Ebay", 12.5, "Tuesday"),
                                                                          ("2", "Unknown", None, "Wednesday")]
    q2 = L.land_documents(spark, inbox, table, ckpt)       # restart: nothing new is landed twice
    q2.awaitTermination(120)
    assert spark.read.parquet(table).count() == 2


def test_streamed_documents_lose_nothing_and_can_be_looked_up(spark, tmp_dir):
    from kontor.operators.reconcile import order_lookup
    inbox = os.path.join(tmp_dir, "inbox2")
    os.makedirs(inbox)
    for name, payload in (("a.json", {"results": [{"BELEGNR": "1", "ORDER_ID": "o", "KUNDENNR": "K1", "Filiale": "Nord"}]}),
                          ("b.json", [{"BELEGNR": "2", "ORDER_ID": "o", "KUNDENNR": "K2"}])):
        with open(os.path.join(inbox, name), "w") as f:
            json.dump(payload, f)
    table = os.path.join(tmp_dir, "table2")
    L.land_documents(spark, inbox, table, os.path.join(tmp_dir, "ckpt2"), fields=("Filiale",)).awaitTermination(120)
    got = spark.read.parquet(table)
    assert sorted((r.BELEGNR, r.Filiale, "Filiale" in r.document) for r in got.collect()) == [("1", "Nord", True), ("2", None, False)]
    assert [tuple(r) for r in order_lookup(got).collect()] == [("o", "K2", "2")]


def test_reliable_checkpoint_cuts_lineage(spark, tmp_dir):
    from kontor.session import checkpoint_dir
    docs = AD.belege_events(spark, SF_SMALL)
    a = P.full_analysis(docs, checkpoint=True)
    plan = a["_prep"]._jdf.queryExecution().logical().toString()
    assert "LogicalRDD" in plan and "Join" not in plan          # the prepared set is read back, not recomputed
    assert a["kpis"].collect()[0].total_orders == docs.count()
    folder = checkpoint_dir(spark).replace("file:", "")
    assert os.path.isdir(folder) and any(os.scandir(folder))

    root = write_exports(tmp_dir, {"a.csv": (3, False)})
    lk = spark.createDataFrame([("100", "K1", "R1", 1)], "ORDER_ID string, KUNDENNR string, BELEGNR string, api_row long")
    out = P.reconcile_exports(spark, root, lk, checkpoint=True)
    assert out["report_lines"].count() == 5


def test_full_analysis_with_few_columns(spark):
    docs = spark.createDataFrame([("1", "Amazon", "2025-10-01 10:00:00"), ("2", None, "bad")],
                                 "BELEGNR string, ORIGIN string, BELEGDAT string")
    a = P.full_analysis(docs)
    k = a["kpis"].collect()[0]
    assert k.total_orders == 2 and k.platforms == 2 and "total_gross_revenue" not in a["kpis"].columns
    assert set(a["platform"]) == {"platform_orders"}
    assert a["time"] == {} and a["profitability"] == {} and a["order_value"] == {}


def test_grouping_sets_reports_equal_standalone(spark):
    docs = AD.belege_orders(spark, SF_SMALL)
    a = P.full_analysis(docs)
    prep = prepare(docs)
    standalone = {
        ("platform", "platform_summary"): A.platform_summary, ("platform", "platform_share"): A.platform_share,
        ("platform", "platform_orders"): A.platform_orders, ("geographic", "country_summary"): A.country_summary,
        ("geographic", "country_share"): A.country_share, ("geographic", "country_orders"): A.country_orders,
        ("geographic", "country_platform_matrix"): A.country_platform_matrix, ("time", "daily_trend"): A.daily_trend,
        ("time", "weekly_trend"): A.weekly_trend, ("time", "monthly_trend"): A.monthly_trend,
        ("time", "day_of_week"): A.day_of_week, ("time", "hourly_pattern"): A.hourly_pattern,
        ("document_type", "document_type_summary"): A.document_type_summary,
        ("profitability", "margin_distribution"): A.margin_distribution,
        ("profitability", "platform_profitability"): A.platform_profitability,
        ("profitability", "country_profitability"): A.country_profitability,
        ("payment", "payment_summary"): A.payment_summary,
        ("customer", "all_customers"): A.all_customers, ("customer", "top_customers"): A.top_customers,
        ("customer", "customer_frequency"): A.customer_frequency,
        ("customer", "new_vs_returning"): A.new_vs_returning,
    }
    for (family, name), fn in standalone.items():
        got, want = a[family][name], fn(prep)
        assert got.columns == want.columns, name
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()], name
    a["_keyed"].unpersist()
    a["_prep"].unpersist()


def test_united_reports_read_one_keyed_aggregation(spark):
    """In a union Spark numbers the columns of each report anew; none may run the aggregation again."""
    docs = AD.belege_orders(spark, SF_SMALL)
    a = P.full_analysis(docs)
    reports = [a["time"]["monthly_trend"], a["time"]["weekly_trend"].withColumnRenamed("Week", "Month"), a["time"]["monthly_trend"]]
    both = reports[0].unionByName(reports[1]).unionByName(reports[2])
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "lineitem" not in plan
    assert sorted(map(tuple, both.collect())) == sorted(tuple(r) for df in reports for r in df.collect())
    a["_prep"].unpersist()


def test_dashboards_adapt_to_amount_columns(spark):
    """Country and net amounts without gross ones: frames that need gross amounts are left out."""
    docs = spark.createDataFrame([("1", "Amazon", "DE", "2025-10-01 10:00:00", 5.0)],
                                 "BELEGNR string, ORIGIN string, ISOA2_LAND string, BELEGDAT string, NETTO double")
    d = P.dashboard_frames(docs)
    assert "countries" not in d and "geographic" not in d
    assert d["platform_orders"].count() == 1 and d["daily_trend"].count() == 1


def test_other_errors_are_not_swallowed(spark, monkeypatch):
    import pytest


    def broken(*_):
        raise ValueError("no missing column")
    monkeypatch.setattr(A, "platform_share", broken)
    with pytest.raises(ValueError, match="no missing column"):
        P.full_analysis(AD.belege_events(spark, SF_SMALL))


def test_platform_names_with_quotes(spark):
    docs = spark.createDataFrame([("1", "a`b", "DE", 5.0), ("2", "c.d", "DE", 2.0)], "BELEGNR string, ORIGIN string, ISOA2_LAND string, BRUTTO double")
    r = A.country_platform_matrix(prepare(docs)).first()
    assert (r["a`b"], r["c.d"]) == (5.0, 2.0)


def test_a_cluster_names_the_shared_folder(monkeypatch):
    import pytest

    from kontor import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_matrix_of_any_number_of_platforms(spark):
    docs = spark.range(40_000).select(F.col("id").cast("string").alias("BELEGNR"), F.concat(F.lit("p"), F.col("id") % 20_000).alias("ORIGIN"),
                                      F.element_at(F.array(F.lit("DE"), F.lit("FR"), F.lit("IT")), (F.col("id") % 3 + 1).cast("int")).alias("ISOA2_LAND"),
                                      F.lit("1.5").alias("BRUTTO"))
    got = A.country_platform_map(prepare(docs)).select("ISOA2_LAND", F.size("platforms").alias("n"), F.aggregate(
        F.map_values("platforms"), F.lit(0.0), lambda a, x: a + x).alias("s")).collect()
    assert [(r.ISOA2_LAND, r.n) for r in got] == [("DE", 20_000), ("FR", 20_000), ("IT", 20_000)]
    assert sum(r.s for r in got) == 60_000.0
