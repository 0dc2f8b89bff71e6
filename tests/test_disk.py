"""What a query leaves on disk while it runs: shuffles of steps whose result is written go with them."""

import time

from kontor.operators import reconcile as R
from kontor.session import landed
from kontor.sources import sinks as S
from tests.conftest import SF_SMALL


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}


def left_by(spark, job) -> set[str]:
    """Shuffle files that a job leaves; they are deleted in the background."""
    before = shuffle_files(spark)
    kept = job()        # alive, so that nothing is collected with it
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    del kept
    return left


def rows_by_key(spark):
    return spark.range(2000).selectExpr("cast(id % 3 as string) AS file_id", "id AS row_no").repartition(5, "row_no")


def test_a_written_table_keeps_no_shuffle(spark):
    assert not left_by(spark, lambda: landed(rows_by_key(spark), "rows"))


def test_a_written_report_keeps_no_shuffle(spark, tmp_path):
    rows = rows_by_key(spark)
    assert not left_by(spark, lambda: (rows, S.write_report(rows, str(tmp_path / "report"))))
    # a plan that ran inside is whole: run again it makes its shuffle again
    assert rows.count() == 2000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_report_lines_are_numbered_where_the_transactions_are_written(spark):
    from kontor.plans.registry_reconcile import txl
    lines = R.report_lines(txl(spark, SF_SMALL))
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number()" not in plan and plan.count("Window ") == 1        # the offsets of the buckets
    tx = R.normalize_transactions(txl_rows(spark))
    buckets = R.bucket_summary(tx, 4)
    for kind in ("regular_count", "other_fee_count"):
        rows = tx.filter("is_other_fee" if kind == "other_fee_count" else "not is_other_fee")
        of = R.placed_transactions(tx, 4).filter("is_other_fee" if kind == "other_fee_count" else "not is_other_fee")
        got, want = (sorted((r.file_id, r.row_idx, r._n) for r in R._numbered(x, R._offsets(buckets, kind), 5, 4).collect()) for x in (of, rows))
        assert got == want and [n for _, _, n in got] == list(range(5, 5 + len(got)))


def txl_rows(spark):
    fields = R.TEXT_FIELDS + ["auszahlungsnr", "auszahlungsdatum"]
    return spark.range(1, 31).selectExpr("'f' AS file_id", "id AS row_idx", *[
        "CASE WHEN id % 7 = 0 THEN '' WHEN id % 3 = 0 THEN 'Andere Gebühr' ELSE 'Bestellung' END AS typ" if f == "typ" else f"cast(id AS string) AS {f}"
        for f in fields], "cast(id AS string) AS betrag_abzgl_raw")


def exports(spark, tmp_path):
    from kontor.sources import export_grid as G
    rows = txl_rows(spark).selectExpr("'1' AS file_id", "row_idx", "datum", "typ", "bestellnummer", "alte_bestellnummer", "nutzername", "name",
                                      "betrag_abzgl_raw", "auszahlungsnr", "auszahlungsdatum",
                                      *[f"cast(null AS string) AS {f}_raw" for f in G.K.AMOUNT_FIELDS if f != "betrag_abzgl"])
    return rows.repartition(3, "row_idx"), str(tmp_path / "exports")


def test_written_exports_keep_no_shuffle(spark, tmp_path):
    from kontor.sources import export_grid as G
    rows, path = exports(spark, tmp_path)
    assert not left_by(spark, lambda: (rows, G.write_export_grid(rows, None, path)))


def test_reconciled_transactions_are_written_not_cached(spark, tmp_path):
    """One table serves all outputs; nothing of them is a cached block, in memory or spilled to disk."""
    from kontor.plans import composites as P
    from kontor.sources import export_grid as G
    rows, path = exports(spark, tmp_path)
    G.write_export_grid(rows, None, path)
    docs = spark.createDataFrame([("4", "K1", "R1", 1)], "ORDER_ID string, KUNDENNR string, BELEGNR string, api_row long")
    for run in (P.reconcile_exports, P.match_and_process):
        out = run(spark, path, docs, export_column="file_id")
        assert "InMemoryRelation" not in out["report_lines"]._jdf.queryExecution().executedPlan().toString()
        assert out["transactions"].inputFiles() and not any(path in f for f in out["transactions"].inputFiles())
        assert out["transactions"].count() == 26 and out["report_lines"].filter("G = 'K1'").count() == 1


def test_joined_records_keep_no_shuffle_of_lines(spark, tmp_path):
    from kontor.sources import export_grid as G
    folder = tmp_path / "odd" / "file_id=1"
    folder.mkdir(parents=True)
    (folder / "part-0").write_text("".join(f'{i};"a\n{hash(str(i))}{hash(str(-i))}";z\n' for i in range(20000)), encoding="utf-8")
    sizes = {}

    def job():
        text = G.export_text(spark, str(tmp_path / "odd"), export_column="file_id")
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        time.sleep(2)       # deleted in the background
        sizes.update({f.getName(): f.length() for f in (files.apply(i) for i in range(files.size()))})
        return text

    left = left_by(spark, job)
    assert sum(sizes.get(f, 0) for f in left) < 20000       # of the small tables, not of 900,000 bytes of lines


def test_pieces_of_a_payload_do_not_move_to_meet_small_tables(spark, tmp_path, monkeypatch):
    """Offsets of the splits, places of the arrays and flags are a row a split or a payload, written before they are joined."""
    import json

    from kontor.sources import json_split
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps({"data": [{"n": k * 3 + i, "t": str(hash(str(k)))} for k in range(4000)]}))
    plans = []

    def recorded(df, name="table"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return landed(df, name)

    monkeypatch.setattr(json_split, "landed", recorded)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        docs = json_split.split_documents(spark, str(tmp_path))
        plans.append(docs._jdf.queryExecution().executedPlan().toString())
        rows = docs.selectExpr("try_variant_get(document, '$.n', 'int') AS n").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    # only the two sides of the places of the arrays, a row a payload each, may be shuffled to each other
    assert [p.count("SortMergeJoin") for p in plans if "raise_error" in p] == [0] * sum("raise_error" in p for p in plans)
    assert sorted(r.n for r in rows) == list(range(12000))


def test_a_large_payload_is_whole_in_one_file(spark, monkeypatch):
    """Its first and last document are found in the task that writes it, also when numbers of documents repeat."""
    from kontor.plans import registry_sources as RS
    docs = RS.AD.belege_orders(spark, SF_SMALL)
    twice = docs.unionAll(docs)
    monkeypatch.setattr(RS.AD, "belege_orders", lambda s, d: twice)
    monkeypatch.setattr(RS, "LARGE_DOCS", 100)
    got = RS._large_payloads(spark, SF_SMALL)
    assert sorted(r.BELEGNR for r in got.select("BELEGNR").collect()) == sorted(r.BELEGNR for r in twice.select("BELEGNR").collect())
