"""Physical-plan properties that matter at scale (checked with explain)."""

import io
import os
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from kontor.operators import analytics as A
from kontor.plans import registry as REG
from kontor.sources import adapters as AD
from kontor.sources import export_grid as G
from kontor.sources import filters as FL
from kontor.sources import sinks as S
from tests.conftest import SF_SMALL
from tests.test_sources import write_exports


def plan(df, mode="formatted"):
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_window_filters_reach_the_scan(spark, tmp_dir):
    docs = AD.belege_orders(spark, SF_SMALL).withColumn("BELEGDAT", F.col("BELEGDAT").cast("timestamp"))
    path = os.path.join(tmp_dir, "docs")
    S.write_documents_snapshot(docs, path, "b1")
    p = plan(FL.documents_window(spark, path, "01.01.1995", "31.12.1995", ["Amazon"]).select("BELEGNR"))
    assert "GreaterThanOrEqual(BELEGDAT" in p and "LessThan(BELEGDAT" in p and "EqualTo(ORIGIN,Amazon)" in p
    assert "ReadSchema: struct<BELEGNR:string,BELEGDAT:timestamp,ORIGIN:string>" in p
    assert "BELEGMONAT" in p.split("PartitionFilters:")[1].splitlines()[0]       # other months are not read


def test_reports_read_only_needed_columns(spark):
    p = plan(A.platform_summary(REG.prep_orders(spark, SF_SMALL)))
    orders_schema = [line for line in p.splitlines() if "ReadSchema: struct<o_orderkey" in line]
    assert orders_schema and "o_totalprice" not in orders_schema[0]
    assert "BroadcastExchange" in p      # nation/customer/part at this size


def test_grid_numbering_does_not_shuffle_lines(spark, tmp_dir):
    root = write_exports(tmp_dir, {"a.csv": (3, False)})
    p = plan(G.read_export_grid(spark, root))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_quantiles_do_not_buffer_the_column(spark):
    stats = A.order_value_stats(REG.prep_events(spark, SF_SMALL))
    p = plan(stats, "extended")
    assert "percentile(" not in p.lower().replace("percentile_approx", "")


def test_ordinal_windows_are_bucketed(spark):
    p = plan(AD.shop_export(spark, SF_SMALL))
    assert "__ord_bucket" in p


def test_no_python_evaluation_in_any_registered_query(spark):
    python_nodes = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                    "FlatMapCoGroupsInPandas", "PythonUDF")
    offenders = []
    for name, fn in sorted(REG.queries().items()):
        p = plan(fn(spark, SF_SMALL), "extended")
        if any(n in p for n in python_nodes):
            offenders.append(name)
    assert offenders == []


def test_matching_does_not_shuffle_landed_documents(spark, tmp_dir):
    from kontor.operators import reconcile as R
    docs = AD.belege_lookup(spark, SF_SMALL)
    table = S.write_documents_table(docs, "documents_plan_test", os.path.join(tmp_dir, "docs"), 8)
    shop = AD.shop_export(spark, SF_SMALL)
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan(R.order_lookup(table), "simple")
        for out in (R.match_orders(shop, table), R.attach_lookups(R.normalize_transactions(shop), table)):
            p = plan(out, "simple")
            scan = next(i for i, line in enumerate(p.splitlines()) if "documents_plan_test" in line or "/docs" in line)
            lines = p.splitlines()
            depth = len(lines[scan]) - len(lines[scan].lstrip(" :+-*()0123456789"))
            up = []         # the operators above the scan
            for line in reversed(lines[:scan]):
                own = len(line) - len(line.lstrip(" :+-*()0123456789"))
                if own < depth:
                    up.append(line)
                    depth = own
                if "Join" in line and up and up[-1] is line:
                    break
            assert up and not any("Exchange" in line for line in up)
        same = R.match_stats(shop, table).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
    assert same == R.match_stats(shop, docs).collect()


def test_exports_are_read_three_times(spark, tmp_dir):
    """Split table (once, when the reader is made), first rows and transactions."""
    root = write_exports(tmp_dir, {"a.csv": (3, False)})
    e = G.read_exports(spark, root)
    p = plan(e.rows, "simple")        # the first rows are cached and shown wherever they are used
    assert p.count("FileScan text") - p.count("InMemoryRelation") == 1 and plan(e.first_rows, "simple").count("FileScan text") == 1
    assert plan(G.read_export_grid(spark, root), "simple").count("FileScan text") == 1
