"""Sources from files written by the test: JSON payload shapes, CSV export grids."""

import csv
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from kontor.functions import constants as K
from kontor.operators.reconcile import order_lookup
from kontor.plans import composites as P
from kontor.sources import export_grid as G
from kontor.sources import filters as FL
from kontor.sources import ledger_json as J
from kontor.sources import sinks as S

DOCS = [{"ORDER_ID": "1", "BRUTTO": 10.5, "ORIGIN": "Amazon"},
        {"ORDER_ID": "2", "BRUTTO": 20.0, "ORIGIN": "Ebay"}]


def write_json(d, name, obj):
    p = os.path.join(d, name)
    os.makedirs(p, exist_ok=True)
    with open(os.path.join(p, "payload.json"), "w") as f:
        json.dump(obj, f)
    return p


@pytest.mark.parametrize("shape", ["data", "results", "rows", "columns", "list"])
def test_envelopes(spark, tmp_dir, shape):
    if shape == "columns":
        obj = {"ORDER_ID": ["1", "2"], "BRUTTO": [10.5, 20.0], "ORIGIN": ["Amazon", "Ebay"]}
    elif shape == "list":
        obj = DOCS
    else:
        obj = {shape: DOCS, "meta": {"n": 2}}
    got = J.read_ledger_documents(spark, write_json(tmp_dir, shape, obj))
    rows = sorted((r.ORDER_ID, r.BRUTTO, r.ORIGIN) for r in got.collect())
    assert rows == [("1", 10.5, "Amazon"), ("2", 20.0, "Ebay")]
    assert "api_row" in got.columns


def test_first_envelope_key_wins(spark, tmp_dir):
    obj = {"rows": [{"ORDER_ID": "x"}], "data": DOCS}
    got = J.read_ledger_documents(spark, write_json(tmp_dir, "both", obj))
    assert sorted(r.ORDER_ID for r in got.collect()) == ["1", "2"]


@pytest.mark.parametrize("entries", ["object", "array"])
def test_entries_expand_and_flatten(spark, tmp_dir, entries):
    doc = {"ORDER_ID": "1", "Kunde": {"KUNDENNR": "K", "Adresse": {"Land": "DE"}}, "Tags": ["a", "b"]}
    if entries == "object":
        obj = {"data": [{"Entries": doc, "other": 1}, {"Entries": dict(doc, ORDER_ID="2"), "other": 2}]}
    else:
        obj = {"data": [{"Entries": [doc, dict(doc, ORDER_ID="2")]}, {"Entries": [dict(doc, ORDER_ID="3")]}]}
    got = J.read_ledger_documents(spark, write_json(tmp_dir, entries, obj))
    assert "other" not in got.columns
    assert {"ORDER_ID", "Kunde.KUNDENNR", "Kunde.Adresse.Land", "Tags"} <= set(got.columns)
    r = got.orderBy("ORDER_ID").first()
    assert r["Kunde.Adresse.Land"] == "DE" and list(r["Tags"]) == ["a", "b"]
    if entries == "array":
        assert [x.ORDER_ID for x in got.orderBy("api_row").collect()] == ["1", "2", "3"]


def write_payloads(d, payloads):
    os.makedirs(d, exist_ok=True)
    for name, obj in payloads.items():
        with open(os.path.join(d, name), "w") as f:
            f.write(obj if isinstance(obj, str) else json.dumps(obj))
    return d


def test_each_payload_has_its_own_envelope(spark, tmp_dir):
    folder = write_payloads(os.path.join(tmp_dir, "mixed"), {
        "a.json": {"data": [{"ORDER_ID": "1"}], "meta": 1}, "b.json": {"results": [{"ORDER_ID": "2", "BRUTTO": 5.0}, {"ORDER_ID": "3"}]},
        "c.json": [{"ORDER_ID": "4"}, {"ORDER_ID": "5"}], "d.json": {"rows": [{"ORDER_ID": "6"}], "results": None}})
    got = J.read_ledger_documents(spark, folder)
    assert [r.ORDER_ID for r in got.orderBy("api_row").collect()] == ["1", "2", "3", "4", "5", "6"]
    lines = write_payloads(os.path.join(tmp_dir, "lines"), {
        "a.jsonl": "\n".join(json.dumps(x) for x in ({"data": [{"ORDER_ID": "1"}, {"ORDER_ID": "2"}]}, {"rows": [{"ORDER_ID": "3"}]}))})
    got = J.read_ledger_documents(spark, lines, multi_line=False)
    assert [r.ORDER_ID for r in got.orderBy("api_row").collect()] == ["1", "2", "3"]


def test_an_unreadable_payload_is_an_error(spark, tmp_dir):
    folder = write_payloads(os.path.join(tmp_dir, "cut"), {"a.json": {"data": DOCS}, "b.json": '{"data": [{"ORDER_ID": "9"}, {"ORD'})
    raw = J.read_payloads(spark, folder)
    assert [os.path.basename(r.payload) for r in J.rejected_payloads(raw).collect()] == ["b.json"]
    with pytest.raises(Exception, match="unreadable payload"):
        J.read_ledger_documents(spark, folder).collect()


def test_the_last_payload_wins_whatever_its_size(spark, tmp_dir):
    big = [{"ORDER_ID": "100", "KUNDENNR": "new", "BELEGNR": "R2", "pad": "x" * 50}] + [{"ORDER_ID": str(i), "KUNDENNR": "k", "BELEGNR": "r"} for i in range(500)]
    for first, second in ((("a", [{"ORDER_ID": "100", "KUNDENNR": "old", "BELEGNR": "R1"}]), ("b", big)), (("a", big), ("b", [{"ORDER_ID": "100", "KUNDENNR": "old", "BELEGNR": "R1"}]))):
        folder = write_payloads(os.path.join(tmp_dir, f"order-{len(first[1])}"), {f"{n}.json": {"data": x} for n, x in (first, second)})
        r = order_lookup(J.read_ledger_documents(spark, folder)).filter("ORDER_ID = '100'").first()
        want = second[1][0] if second[1] is not big else big[0]
        if second[1] is big:            # the big payload has the number twice; its last one counts
            want = big[101]
        assert (r.KUNDENNR, r.BELEGNR) == (want["KUNDENNR"], want["BELEGNR"])


def test_entries_of_mixed_kinds(spark, tmp_dir):
    folder = write_payloads(os.path.join(tmp_dir, "entries"), {"a.json": {"data": [
        {"Entries": {"ORDER_ID": "1", "Kunde": {"KUNDENNR": "K1"}}}, {"Entries": [{"ORDER_ID": "2"}, {"ORDER_ID": "3", "BRUTTO": 2.5}]}, {"Entries": None}]}})
    got = J.read_ledger_documents(spark, folder).orderBy("api_row").collect()
    assert [(r.ORDER_ID, r["Kunde.KUNDENNR"], r.BRUTTO is not None) for r in got] == [("1", "K1", False), ("2", None, False), ("3", None, True)]


SHAPES = {
    "data": lambda d: {"meta": {"a": [{"b": 1}]}, "data": d, "other": [{"x": 1}, {"y": "}"}]}, "results": lambda d: {"results": d},
    "rows": lambda d: {"data": None, "rows": d}, "list": lambda d: d,
}
NESTED = [{"BELEGNR": f"R{i}", "ORDER_ID": str(i), "BRUTTO": i + 0.5, "NAME1": 'a "quoted" } ] \\ { [ \u00e9\n"data":[',
           "Kunde": {"KUNDENNR": f"K{i}", "data": [{"z": []}, [1, 2]]}} for i in range(25)]


def kinds_of_entries(docs):
    return {"plain": docs, "object": [{"Entries": d, "n": 1} for d in docs],
            "array": [{"Entries": docs[i: i + 4]} for i in range(0, len(docs), 4)],
            "mixed": [{"Entries": docs[0]}, {"Entries": docs[1:20]}, {"Entries": None}, {"other": 1}, {"Entries": docs[20:]}]}


def test_every_shape_gives_the_same_documents_in_batch_and_stream(spark, tmp_dir):
    from kontor.streaming import landing as L
    inbox, want = os.path.join(tmp_dir, "shapes"), []
    payloads = {}
    for shape, wrap in SHAPES.items():
        for kind, docs in kinds_of_entries(NESTED).items():
            payloads[f"{shape}-{kind}.json"] = wrap(docs)
    names = list(NESTED[0])
    payloads["columns.json"] = {n: [d[n] for d in NESTED] for n in names}
    payloads["one.json"] = NESTED[0]
    payloads["blank.json"] = " \n"
    write_payloads(inbox, {f: p if isinstance(p, str) else json.dumps(p, indent=[None, 2][len(f) % 2]) for f, p in payloads.items()})
    for f, p in payloads.items():
        want += [(f, d["BELEGNR"], d["BRUTTO"], d["NAME1"], d["Kunde"]["KUNDENNR"]) for d in (NESTED if f not in ("one.json", "blank.json") else NESTED[:1] if f == "one.json" else [])]

    def rows(df, kunde):
        cols = [F.element_at(F.split("api_row.payload", "/"), -1).alias("f"), "BELEGNR", F.col("BRUTTO").cast("double").alias("BRUTTO"), "NAME1", F.col(kunde)]
        return [tuple(r) for r in df.orderBy("api_row").select(*cols).collect()]
    batch = J.read_ledger_documents(spark, inbox)
    assert rows(batch, "`Kunde.KUNDENNR`") == sorted(want, key=lambda x: x[0])
    L.land_documents(spark, inbox, f"{tmp_dir}/shapes-table", f"{tmp_dir}/shapes-ckpt", fields=("Kunde.KUNDENNR",)).awaitTermination(120)
    assert rows(spark.read.parquet(f"{tmp_dir}/shapes-table"), "`Kunde.KUNDENNR`") == rows(batch, "`Kunde.KUNDENNR`")
    # one payload a line
    lines = write_payloads(os.path.join(tmp_dir, "shape-lines"), {"all.jsonl": "\n".join(json.dumps(p) for p in payloads.values() if not isinstance(p, str))})
    got = J.read_ledger_documents(spark, lines, multi_line=False)
    assert [r.BELEGNR for r in got.orderBy("api_row").collect()] == [x[1] for f in payloads for x in want if x[0] == f]
    L.land_documents(spark, lines, f"{tmp_dir}/lines-table", f"{tmp_dir}/lines-ckpt", multi_line=False).awaitTermination(120)
    assert [r.BELEGNR for r in spark.read.parquet(f"{tmp_dir}/lines-table").orderBy("api_row").collect()] == [r.BELEGNR for r in got.orderBy("api_row").collect()]


def test_streamed_entries_and_columns_are_not_lost(spark, tmp_dir):
    from kontor.streaming import landing as L
    inbox = write_payloads(os.path.join(tmp_dir, "in"), {
        "a.json": {"data": [{"Entries": [{"BELEGNR": "R1"}, {"BELEGNR": "R2"}]}]}, "b.json": {"data": [{"Entries": [{"BELEGNR": "R3"}]}]},
        "c.json": {"BELEGNR": ["R1", "R2"], "ORDER_ID": ["1"]}})
    L.land_documents(spark, inbox, f"{tmp_dir}/t", f"{tmp_dir}/c").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_dir}/t").orderBy("api_row").collect()
    assert [(r.BELEGNR, r.ORDER_ID) for r in got] == [("R1", None), ("R2", None), ("R3", None), ("R1", "1"), ("R2", None)]


def test_a_payload_spans_several_tasks(spark, tmp_dir):
    """The same documents as the whole-file read, with splits of 200 bytes anywhere in the file."""
    payloads = {}
    for shape, wrap in SHAPES.items():
        for kind, docs in kinds_of_entries(NESTED).items():
            for indent in (None, 1):
                payloads[f"{shape}-{kind}-{indent}.json"] = json.dumps(wrap(docs), indent=indent) + ("\n" if indent else "")
    payloads |= {"columns.json": {n: [d[n] for d in NESTED] for n in NESTED[0]}, "empty.json": {"data": [], "rows": NESTED}, "none.json": [], "blank.json": "\n"}
    folder = write_payloads(os.path.join(tmp_dir, "large"), payloads)
    want = J.read_ledger_documents(spark, folder)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = J.read_ledger_documents(spark, folder, split=True)
        columns = ["api_row.payload", "api_row.pos", "api_row.entry", *[f"`{c}`" for c in want.columns if c not in ("api_row", "other", "value")]]
        rows = got.select(*columns).orderBy("api_row").collect()
        parts = spark.read.text(f"{folder}/data-plain-None.json", lineSep="}").rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0])
        spark.conf.set("spark.sql.files.openCostInBytes", kept[1])
    assert parts > 5
    assert rows == want.select(*columns).orderBy("api_row").collect() and len(rows) == 25 * 33
    cut = write_payloads(os.path.join(tmp_dir, "cut2"), {"a.json": '{"data": [{"a": 1}, {"a": "x}]}'})
    with pytest.raises(Exception, match="unreadable payload"):
        J.read_ledger_documents(spark, cut, split=True).collect()


HEADER = [h for h, _, _ in K.EXPORT_FIELDS]


def export_lines(header_row, seller="Shop GmbH", reorder=False, extra=None, rows=None, more_columns=()):
    """An export as Python's csv module writes it."""
    pre = [["Verkäufer", seller], ["Betrag", "1.234,00"], ["Verkäufer", "Last Seller"]]
    lines = (pre + [[]] * (header_row - 1 - len(pre)))[: header_row - 1]
    hdr = list(HEADER) + list(more_columns)
    if reorder:
        hdr[0], hdr[1] = hdr[1], hdr[0]
    lines.append(hdr)
    if rows is None:
        rows = [
            {"Typ": "Bestellung", "Bestellnummer": "100", "Zwischensumme Artikel": "10.00",
             "Verpackung und Versand": "4.99", "Datum der Transaktionserstellung": "2025-10-01"},
            {"Typ": "Andere Gebühr", "Betrag abzügl. Kosten": "-3.00", "Datum der Transaktionserstellung": "2025-10-02"},
            {"Typ": "", "Bestellnummer": "999"},
            {"Typ": "Bestellung", "Bestellnummer": "a;b", "Zwischensumme Artikel": "--"},
        ]
    out = io.StringIO()
    w = csv.writer(out, delimiter=";", lineterminator="\n")
    w.writerows(lines + [[r.get(h, "") for h in hdr] for r in rows + (extra or [])])
    return out.getvalue()


def write_exports(d, layout):
    root = os.path.join(d, "exports")
    os.makedirs(root, exist_ok=True)
    for name, (row, reorder) in layout.items():
        with open(os.path.join(root, name), "w") as f:
            f.write(export_lines(row, reorder=reorder))
    return root


def test_header_discovery_rows_and_rejects(spark, tmp_dir):
    root = write_exports(tmp_dir, {"a.csv": (1, False), "b.csv": (11, True), "c.csv": (19, False), "d.csv": (20, False)})
    grid = G.read_export_grid(spark, root)
    hdr = {os.path.basename(r.file_id): r.header_row for r in G.discover_headers(grid).collect()}
    assert hdr == {"a.csv": 1, "b.csv": 11, "c.csv": 19}
    rej = [os.path.basename(r.file_id) for r in G.rejected_exports(grid, G.discover_headers(grid)).collect()]
    assert rej == ["d.csv"]


def test_grid_fields_by_header_and_preamble(spark, tmp_dir):
    root = write_exports(tmp_dir, {"a.csv": (11, False), "b.csv": (11, True)})
    e = G.read_exports(spark, root)
    rows, pre = e.rows, e.preamble
    got = {(os.path.basename(r.file_id), r.row_idx): r for r in rows.collect()}
    for f in ("a.csv", "b.csv"):
        r = got[(f, 12)]
        assert (r.typ, r.bestellnummer, r.zwischensumme_raw, r.datum) == ("Bestellung", "100", "10.00", "2025-10-01")
        assert got[(f, 15)].bestellnummer == "a;b"
    from kontor.operators.reconcile import preamble_metadata
    meta = {os.path.basename(r.file_id): (r.seller, r.amount) for r in preamble_metadata(pre).collect()}
    assert meta["a.csv"] == ("Last Seller", "1.234,00")


def test_quotes_line_breaks_and_many_columns(spark, tmp_dir):
    """Files as Python's csv module writes them: 40 columns, doubled quotes, a line break and a
    separator in a cell. Every cell comes back as it went in."""
    fee = next(h for h in HEADER if '"' in h)
    who = next(h for h, field, _ in K.EXPORT_FIELDS if field == "name")
    more = [f"Spalte {i}" for i in range(40 - len(HEADER))]
    rows = [{"Typ": "Bestellung", "Bestellnummer": "1", who: 'Anna "A"; B\nzweite Zeile\n', fee: "-7.50", "Spalte 3": "x"},
            {"Typ": "Bestellung", "Bestellnummer": "2", who: '""', "Zwischensumme Artikel": "5"}]
    root = os.path.join(tmp_dir, "odd")
    os.makedirs(root)
    for name, kw in (("a.csv", {"rows": rows, "more_columns": more}), ("b.csv", {})):
        with open(os.path.join(root, name), "w", newline="") as f:
            f.write(export_lines(3, **kw))
    with open(os.path.join(root, "c.csv"), "w", newline="") as f:
        f.write(export_lines(3) + 'Bestellung;"never closed;\n')
    grid = {(os.path.basename(r.file_id), r.row_idx): list(r.cells) for r in G.read_export_grid(spark, root).collect()}
    want = list(csv.reader(io.StringIO(export_lines(3, rows=rows, more_columns=more)), delimiter=";"))
    for i, row in enumerate(want, 1):
        got = ["" if c is None else c for c in grid["a.csv", i]]
        assert got[: len(row)] == row and not any(got[len(row):])
    assert max(i for f, i in grid if f == "a.csv") == len(want) and len(want[2]) == 40
    out = P.reconcile_exports(spark, root, spark.createDataFrame([], "ORDER_ID string, KUNDENNR string, BELEGNR string, api_row long"))
    data = {(os.path.basename(r.file_id), r.C): r for r in out["report_lines"].filter("section = 'data'").collect()}
    assert set(data) == {("a.csv", "1"), ("a.csv", "2"), ("b.csv", "100"), ("b.csv", "a;b")}
    assert data["a.csv", "1"].M == -7.5 and data["a.csv", "1"].F == rows[0][who]
    assert [(os.path.basename(r.file_id), r.reason) for r in out["rejected"].collect() if r.reason != "no header row"] == [
        ("c.csv", "a quoted cell is not closed")]
    assert out["missing_headers"].count() == 0


def test_an_export_without_transactions_gets_its_report(spark, tmp_dir):
    root = os.path.join(tmp_dir, "none")
    os.makedirs(root)
    with open(os.path.join(root, "a.csv"), "w") as f:
        f.write(export_lines(3, rows=[]))
    with open(os.path.join(root, "b.csv"), "w") as f:
        f.write("Verkäufer;X\n" + ";".join(h for h in HEADER if h != "Zwischensumme Artikel" and '"' not in h) + "\n")
    docs = spark.createDataFrame([("100", "K1", "R1", 1)], "ORDER_ID string, KUNDENNR string, BELEGNR string, api_row long")
    out = P.reconcile_exports(spark, root, docs)
    lines = sorted((os.path.basename(r.file_id), r.row_no, r.section, r.J, r.P) for r in out["report_lines"].collect())
    assert lines == [(f, n, s, 0.0, 0.0) for f in ("a.csv", "b.csv") for n, s in ((5, "gebuehr"), (6, "andere_gebuehr"), (7, "totals"))]
    assert {(os.path.basename(r.file_id), r.transactions) for r in out["report_header"].collect()} == {("a.csv", 0), ("b.csv", 0)}
    assert [r.other_fee_total for r in out["processing_summary"].collect()] == [0.0, 0.0]
    assert out["report_sheet"].filter(F.col("file_id").endswith("a.csv")).count() == 7 and out["rejected"].count() == 0
    assert {(os.path.basename(r.file_id), "Zwischensumme" in r.header or '"' in r.header) for r in out["missing_headers"].collect()} == {("b.csv", True)}


def test_fixed_header_layout(spark, tmp_dir):
    root = write_exports(tmp_dir, {"a.csv": (11, False)})
    e = G.read_exports(spark, root, discover=False)
    assert [r.header_row for r in e.headers.collect()] == [11]
    assert e.rows.count() == 4


def test_reconcile_exports_end_to_end(spark, tmp_dir):
    root = write_exports(tmp_dir, {"a.csv": (3, False), "b.csv": (5, True)})
    docs = spark.createDataFrame([("100", "K1", "R1", 1)], "ORDER_ID string, KUNDENNR string, BELEGNR string, api_row long")
    out = P.reconcile_exports(spark, root, docs)
    lines = out["report_lines"].collect()
    assert len(lines) == 2 * (2 + 3)           # two regular rows + 3 summary lines per file
    data = [r for r in lines if r.section == "data" and r.C == "100"]
    assert all(r.G == "K1" and r.J == pytest.approx(14.99) for r in data)
    hdr = {os.path.basename(r.file_id): r for r in out["report_header"].collect()}
    assert hdr["a.csv"].transactions == 3 and hdr["a.csv"].seller == "Shop GmbH"


def test_sinks_filters_preview_stats(spark, tmp_dir):
    docs = spark.createDataFrame(
        [("1", "Amazon", "2025-10-01 10:00:00"), ("2", "Ebay", "2025-10-31 23:59:59"), ("3", "Otto", "2025-11-01 00:00:00")],
        "BELEGNR string, ORIGIN string, BELEGDAT string").withColumn("BELEGDAT", F.col("BELEGDAT").cast("timestamp"))
    path = os.path.join(tmp_dir, "landed")
    S.write_documents_snapshot(docs, path, "b1")
    got = FL.documents_window(spark, path, "01.10.2025", "31.10.2025", FL.build_origins(True, True, " Otto , "))
    assert sorted(r.BELEGNR for r in got.collect()) == ["1", "2"]
    with pytest.raises(ValueError):
        FL.build_origins(False, False, " , ")
    with pytest.raises(ValueError):
        FL.filter_date_range(docs, "31.02.2025", "01.03.2025")
    st = S.batch_stats(docs).collect()[0]
    assert st.rows == 3 and st.columns == 3 and list(st.origins) == ["Amazon", "Ebay", "Otto"]
    assert [r.BELEGNR for r in S.preview(docs, ["BELEGNR"], 2).collect()] == ["1", "2"]
    S.write_report(spark.createDataFrame([("f", 5, 1.0)], "file_id string, row_no long, J double"),
                   os.path.join(tmp_dir, "report"))
    assert os.path.isdir(os.path.join(tmp_dir, "report", "file_id=f"))


def test_report_sheet_written_in_row_order(spark, tmp_dir):
    root = write_exports(tmp_dir, {"a.csv": (3, False)})
    docs = spark.createDataFrame([("100", "K1", "R1", 1)], "ORDER_ID string, KUNDENNR string, BELEGNR string, api_row long")
    out = P.reconcile_exports(spark, root, docs)
    path = os.path.join(tmp_dir, "sheets")
    S.write_report(out["report_sheet"], path)
    text = "".join(open(os.path.join(dp, f), encoding="utf-8").read()
                   for dp, _, fs in sorted(os.walk(path)) for f in sorted(fs) if f.endswith(".csv"))
    rows = [line.split(";") for line in text.splitlines() if not line.startswith("row_no")]
    assert [r[0] for r in rows] == ["1", "2", "3", "4", "5", "6", "7", "8", "9"]
    assert rows[0][1:3] == ["Verkäufer", "Shop GmbH"] and rows[3][1] == "Datum der Transaktionserstellung"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_reading_a_grid_moves_no_rows(spark, tmp_path):
    path = str(tmp_path / "grid")
    for i in range(3):
        (tmp_path / "grid" / f"file_id={i}").mkdir(parents=True)
        (tmp_path / "grid" / f"file_id={i}" / "part-0").write_text(
            "Verkäufer;S\nDatum der Transaktionserstellung;Typ;Bestellnummer;;;;;;\n2024-01-01;Bestellung;7;;;;;;\n", encoding="utf-8")
    e = G.read_exports(spark, path, export_column="file_id")
    assert "SortMergeJoin" not in _plan(e.rows.join(e.headers, "file_id"))       # which would deal the grid by export
    assert sorted((r.file_id, r.bestellnummer) for r in e.rows.collect()) == [("0", "7"), ("1", "7"), ("2", "7")]


def test_joined_records_are_written_once_and_cross_splits(spark, tmp_path):
    path = tmp_path / "odd"
    (path / "file_id=1").mkdir(parents=True)
    cells = [f'{i};"a\n{"x" * (i % 7)}\n""b"" {i}";z' for i in range(400)]
    (path / "file_id=1" / "part-0").write_text("\n".join(cells) + "\n", encoding="utf-8")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        text = G.export_text(spark, str(path), export_column="file_id")
        got = sorted((r.row_idx, r.cells) for r in text.records(cells=True).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == [(i + 1, [str(i), f'a\n{"x" * (i % 7)}\n"b" {i}', "z"]) for i in range(400)]
    assert "Scan text" not in _plan(text.joined)


def _payload_files(path, n):
    for i in range(n):
        os.makedirs(f"{path}/p={i:03d}", exist_ok=True)
        with open(f"{path}/p={i:03d}/one.json", "w") as f:
            f.write(json.dumps({"data": [{"BELEGNR": str(i), "NETTO": 1.0 if i % 2 else 2, "Kunde": {"KUNDENNR": i}}]}))


def test_a_split_payload_is_read_once(spark, tmp_dir):
    """The pieces are counted and put together once; what is built on them reads neither the files nor the counts again."""
    from kontor.sources.json_split import split_documents
    _payload_files(f"{tmp_dir}/split", 3)
    docs = split_documents(spark, f"{tmp_dir}/split")
    assert docs.count() == 3
    assert not [f for f in docs.inputFiles() if f"{tmp_dir}/split" in f]


def test_one_read_finds_the_schema(spark, tmp_dir, monkeypatch):
    from kontor.sources import ledger_json as J
    _payload_files(f"{tmp_dir}/schema", 4)
    kind, calls = type(spark.range(1)), []
    first = kind.first
    monkeypatch.setattr(kind, "first", lambda self: calls.append(1) or first(self))
    docs = J.read_ledger_documents(spark, f"{tmp_dir}/schema")
    assert len(calls) == 1
    assert dict(docs.drop("api_row").dtypes) == {"BELEGNR": "string", "NETTO": "double", "Kunde": "struct<KUNDENNR:bigint>"}
    assert sorted((r.BELEGNR, r.NETTO, r.Kunde.KUNDENNR) for r in docs.collect()) == [("0", 2.0, 0), ("1", 1.0, 1), ("2", 2.0, 2), ("3", 1.0, 3)]


def test_many_small_payload_files_land_in_one_step(spark, tmp_dir):
    from kontor.streaming import landing as L
    _payload_files(f"{tmp_dir}/inbox", 120)
    q = L.land_documents(spark, f"{tmp_dir}/inbox", f"{tmp_dir}/small", f"{tmp_dir}/small-ckpt")
    q.awaitTermination(120)
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 1
    assert spark.read.parquet(f"{tmp_dir}/small").count() == 120
