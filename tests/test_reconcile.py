"""Reconciliation semantics on micro frames."""

import pytest
from pyspark.sql import functions as F

from kontor.operators import reconcile as R

RAW = ("file_id string, row_idx long, datum string, typ string, bestellnummer string, alte_bestellnummer string, "
       "nutzername string, name string, zwischensumme_raw string, verpackung_raw string, fixer_anteil_raw string, "
       "betrag_abzgl_raw string, auszahlungsnr string, auszahlungsdatum string")


def rows(spark):
    data = [
        ("f", 1, "2025-10-01", "Bestellung", "100", None, "u", "A", "10.00", "4.99", "-0.35", "9.65", "P1", "2025-10-05"),
        ("f", 2, "2025-10-02", "Andere Gebühr", None, None, None, None, "--", "--", "--", "-3.00", "", ""),
        ("f", 3, "2025-10-03", "", "101", None, None, None, "99", "--", "--", "99", None, None),
        ("f", 4, "", "Bestellung", "102", None, None, None, "20.00", "—", "-0.35", "19.65", None, ""),
        ("f", 5, "2025-10-06", "Andere Gebühr", None, None, None, None, "--", "--", "--", "-1.50", None, None),
        ("g", 1, "2025-11-01", "Bestellung", "100", None, None, None, "5", None, None, "5", None, None),
    ]
    return spark.createDataFrame(data, RAW)


def docs(spark):
    return spark.createDataFrame(
        [("100", "K1", "R1", 1), ("100", None, "R2", 2), ("100", "0", "", 3), ("102", "K9", None, 4)],
        "ORDER_ID string, KUNDENNR string, BELEGNR string, api_row long")


def test_lookups_last_wins_independently(spark):
    lk = {r.ORDER_ID: (r.KUNDENNR, r.BELEGNR) for r in R.order_lookup(docs(spark)).collect()}
    assert lk == {"100": ("K1", "R2"), "102": ("K9", None)}


def test_normalize_and_split(spark):
    tx = R.normalize_transactions(rows(spark))
    got = {(r.file_id, r.row_idx): r for r in tx.collect()}
    assert (("f", 3) not in got) and len(got) == 5
    assert got[("f", 1)].zwischensumme == pytest.approx(14.99)
    assert got[("f", 2)].is_other_fee and not got[("f", 1)].is_other_fee
    assert got[("f", 4)].zwischensumme == 20.0 and got[("g", 1)].fixer_anteil == 0.0


def test_report_lines_per_file(spark):
    tx = R.attach_lookups(R.normalize_transactions(rows(spark)), docs(spark))
    lines = R.report_lines(tx).filter("file_id = 'f'").orderBy("row_no").collect()
    assert [(r.section, r.row_no) for r in lines] == [("data", 5), ("data", 6), ("gebuehr", 7),
                                                      ("andere_gebuehr", 8), ("totals", 9)]
    d1, d2, fee, oth, tot = lines
    assert (d1.G, d1.H, d2.G) == ("K1", "R2", "K9")
    assert d1.U == 0.0 and d1.T == d1.J
    assert fee.A == "2025-10-01" and fee.H == "202510" and fee.K == pytest.approx(-0.70) and fee.J == fee.K
    assert fee.Q == "P1" and fee.R == "2025-10-05" and fee.P == 0.0
    assert oth.A == "2025-10-02" and oth.J == pytest.approx(-4.5) and oth.P == oth.J
    assert tot.J == pytest.approx(d1.J + d2.J + fee.J + oth.J)
    assert tot.P == pytest.approx(d1.P + d2.P + oth.P)


def test_file_without_other_fees_still_has_line(spark):
    tx = R.normalize_transactions(rows(spark))
    lines = {r.section: r for r in R.report_lines(tx).filter("file_id = 'g'").collect()}
    assert lines["andere_gebuehr"].J == 0.0 and lines["andere_gebuehr"].A == "2025-11-01"
    assert R.other_fee_detail(tx).filter("file_id = 'g'").count() == 0


def test_other_fee_detail_and_totals(spark):
    tx = R.normalize_transactions(rows(spark))
    det = R.other_fee_detail(tx).filter("file_id = 'f'").orderBy("row_no").collect()
    assert [(r.section, r.row_no) for r in det] == [("detail", 1), ("detail", 2), ("detail_total", 4)]
    assert det[0].G == "7400700" and det[0].H == "202510" and det[0].I == det[0].J == det[0].P == -3.0
    assert det[2].J == pytest.approx(-4.5)


def test_matching_and_stats(spark):
    shop = rows(spark)
    d = docs(spark)
    assert sorted(r.row_idx for r in R.match_orders(shop, d).filter("file_id='f'").collect()) == [1, 4]
    assert R.unmatched_orders(shop, d).count() == 3        # NULL order numbers are unmatched
    s = R.match_stats(shop, d).collect()[0]
    assert (s.unique_order_ids, s.matched, s.total, s.unmatched) == (2, 3, 6, 3)
    assert s.match_pct == pytest.approx(50.0)


def test_preamble_last_wins(spark):
    p = spark.createDataFrame([("f", 1, "Verkäufer:", "A"), ("f", 2, "Verkäufer", None), ("f", 3, "Betrag", "9")],
                              "file_id string, row_idx long, c0 string, c1 string")
    r = R.preamble_metadata(p).collect()[0]
    assert (r.seller, r.amount) == (None, "9")


def test_header_cells(spark):
    h = spark.createDataFrame([("f", "Shop", 3, "1.234,00")], "file_id string, seller string, transactions long, amount string")
    got = [(r.row_no, r.A, r.B) for r in R.header_cells(h).orderBy("row_no").collect()]
    assert got == [(1, "Verkäufer", "Shop"), (2, "Transaktionen", "3"), (3, "Betrag", "1.234,00")]


def test_report_sheet_layout(spark):
    tx = R.normalize_transactions(rows(spark))
    summary = R.file_summary(tx)
    header = R.report_header(summary, summary.select("file_id", F.lit("Shop").alias("seller"),
                                                      F.lit("9").alias("amount")))
    sheet = R.report_sheet(R.header_cells(header), R.report_lines(tx, summary)).filter("file_id = 'f'")
    got = {r.row_no: r for r in sheet.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert (got[1].A, got[1].B, got[2].B) == ("Verkäufer", "Shop", "4")
    assert got[4].A == "Datum der Transaktionserstellung" and got[4].R == "Auszahlungsdatum" and got[4].T is None
    assert got[7].F == "Gebuehr" and got[9].J is not None


def test_sums_are_exact_and_unrounded(spark):
    def export(fee, n):
        data = [("f", i, "2025-10-01", "Bestellung", "1", None, None, None, "0.1", "0.2", fee, "1", None, None) for i in range(n)]
        data += [("f", n + i, "2025-10-01", "Andere Gebühr", None, None, None, None, None, None, None, "-0.1", None, None) for i in range(3)]
        return R.normalize_transactions(spark.createDataFrame(data, RAW).repartition(7))
    s = R.file_summary(export("0.004", 1000))
    fee, total = R.fee_summary(s).first(), R.report_totals(s).first()
    assert (fee.K, fee.J) == (4.0, 4.0) and R.other_fee_summary(s).first().J == -0.3
    assert total.J == 303.7 and total.P == 999.7
    assert R.fee_summary(R.file_summary(export("0.0049", 1))).first().K == 0.0049
    # what is no money any more neither fails nor wraps around
    assert R.fee_summary(R.file_summary(export("1e300", 2))).first().K == 2e300


def test_report_lines_compute_the_transactions_once(spark, tmp_path):
    from kontor.plans.registry_reconcile import txl
    lines = R.report_lines(txl(spark, "/root/testdata/sf0.001"))
    assert not any("lineitem" in f or "orders" in f for f in lines.inputFiles())      # only what was written


def test_numbering_sorts_rows_once(spark):
    from kontor.operators.ordinal import ordinal
    df = spark.range(1000).selectExpr("cast(id % 3 as string) AS g", "id AS o")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ordinal(df, ["g"], [F.col("o")], F.floor(F.col("o") / 64), out="n")
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = out.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(" Sort [g#" in line and "o#" in line for line in plan.splitlines()) == 1
    assert plan.split("SortMergeJoin", 1)[1].count("Window [row_number()") == 1       # below the join
    assert all(r.n == r.o // 3 + 1 for r in rows)
