"""Registry entries for sources (A1-A9): data derived from the driver's tables
is landed as export files / JSON payloads in the scratch folder, then read
back through the readers; the oracle computes the same rows from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.functions import constants as K
from kontor.operators import reconcile as R
from kontor.operators.prepare import prepare
from kontor.plans.oracle import with_views
from kontor.plans.catalog import register
from kontor.session import scratch_path, shuffles_dropped
from kontor.sources import adapters as AD
from kontor.sources import export_grid as G
from kontor.sources import ledger_json as J

PAYLOAD_DOCS = 1000      # documents per landed JSON payload
ENTRY_DOCS = 100         # documents per Entries array


def compact_preamble(s: SparkSession, d: str) -> DataFrame:
    """Seller (last supplier of the file) and total supplier balance per export."""
    sup = AD.table(s, d, "supplier").withColumn("file_id", (F.col("s_suppkey") % AD.EXPORT_FILES).cast("string"))
    agg = sup.groupBy("file_id").agg(F.max_by("s_name", "s_suppkey").alias("seller"),
                                     F.sum(F.col("s_acctbal").cast("decimal(12,2)")).alias("amount"))
    return (agg.select("file_id", F.lit(1).alias("row_idx"), F.lit(K.SELLER_MARKER).alias("c0"),
                       F.col("seller").alias("c1"))
            .unionByName(agg.select("file_id", F.lit(2).alias("row_idx"), F.lit(K.AMOUNT_MARKER).alias("c0"),
                                    F.col("amount").cast("decimal(14,2)").cast("string").alias("c1"))))


def landed_exports(s: SparkSession, d: str, header_row: int | None = None) -> str:
    path = scratch_path(s, f"exports-{uuid.uuid4().hex}")
    G.write_export_grid(AD.shop_export(s, d), compact_preamble(s, d), path, header_row=header_row)
    return path


def grid_transactions(s: SparkSession, d: str, discover: bool = True) -> DataFrame:
    path = landed_exports(s, d, None if discover else K.FIXED_HEADER_ROW)
    e = G.read_exports(s, path, discover=discover, export_column="file_id")
    tx = R.normalize_transactions(e.rows.join(e.headers, "file_id")
                                  .withColumn("row_idx", F.col("row_idx") - F.col("header_row")))
    return tx.select(*GRID_COLS)


GRID_COLS = ["file_id", "row_idx", "datum", "typ", "bestellnummer", "transaktionsbetrag", "zwischensumme",
             "fixer_anteil", "variabler_anteil", "gebuehr_hohe_quote", "gebuehr_servicestatus",
             "internationale_gebuehr", "betrag_abzgl", "auszahlungsnr", "auszahlungsdatum", "is_other_fee"]
_GRID_SQL = with_views(["tx"], """SELECT file_id, row_idx, strftime(datum, '%Y-%m-%d') AS datum, typ, bestellnummer,
transaktionsbetrag, zwischensumme, fixer_anteil, variabler_anteil, gebuehr_hohe_quote, gebuehr_servicestatus,
internationale_gebuehr, betrag_abzgl, NULLIF(auszahlungsnr, '') AS auszahlungsnr,
NULLIF(auszahlungsdatum, '') AS auszahlungsdatum, is_other_fee FROM tx""")

register("src_export_grid", lambda s, d: grid_transactions(s, d, True), _GRID_SQL)
register("src_export_fixed_header", lambda s, d: grid_transactions(s, d, False), _GRID_SQL)


def _headers(s, d):
    grid = G.read_export_grid(s, landed_exports(s, d), export_column="file_id")
    return G.discover_headers(grid)


register("header_discovery", _headers,
         with_views(["shop_export"], "SELECT DISTINCT file_id, CAST(3 AS BIGINT) AS header_row FROM shop_export"))


def _mapping(s, d):
    grid = G.read_export_grid(s, landed_exports(s, d), export_column="file_id")
    m = G.header_mapping(grid, G.discover_headers(grid))
    return m.select("file_id", F.explode("columns").alias("name", "col"))


def _mapping_values() -> str:
    rows = []
    for variant in (0, 1):
        for pos, (h, _) in enumerate(G.export_header(variant), start=1):
            rows.append(f"({variant}, '{h.replace(chr(39), chr(39) * 2)}', {pos})")
    return ", ".join(rows)


register("header_mapping", _mapping,
         with_views(["shop_export"], f"""SELECT f.file_id, v.name, v.col FROM
(SELECT DISTINCT file_id, CAST(file_id AS INTEGER) % 2 AS variant FROM shop_export) f
JOIN (VALUES {_mapping_values()}) v(variant, name, col) ON f.variant = v.variant"""))


def _preamble(s, d):
    grid = G.read_export_grid(s, landed_exports(s, d), export_column="file_id")
    return R.preamble_metadata(G.preamble_rows(grid, G.discover_headers(grid)))


register("preamble_metadata_grid", _preamble, """SELECT CAST(s_suppkey % 10 AS VARCHAR) AS file_id,
max_by(s_name, s_suppkey) AS seller,
CAST(CAST(SUM(CAST(s_acctbal AS DECIMAL(12,2))) AS DECIMAL(14,2)) AS VARCHAR) AS amount
FROM supplier GROUP BY 1""")


# --- JSON payloads ------------------------------------------------------------------------

def landed_payloads(s: SparkSession, d: str, entries: bool) -> str:
    """Land documents as JSON payload files of at most PAYLOAD_DOCS documents:
    {"data": [doc, ...]} or, with ``entries``, {"results": [{"Entries": [doc, ...]}, ...]}
    where each doc nests the customer as {"Kunde": {"KUNDENNR", "NAME2"}}."""
    docs = AD.belege_orders(s, d)
    doc = F.struct("BELEGNR", "ORDER_ID", F.col("BELEGDAT").cast("string").alias("BELEGDAT"), "ORIGIN",
                   "ISOA2_LAND", "BELEGART", "ZAHLART", "NETTO", "BRUTTO", "ERLOES",
                   F.struct("KUNDENNR", "NAME2").alias("Kunde"))
    docs = docs.select(F.floor(F.col("api_row") / PAYLOAD_DOCS).alias("payload"), "api_row", doc.alias("doc"))
    if entries:
        docs = (docs.groupBy("payload", F.floor(F.col("api_row") / ENTRY_DOCS).alias("chunk"))
                .agg(F.sort_array(F.collect_list(F.struct("api_row", "doc"))).alias("e"))
                .select("payload", F.col("chunk").alias("api_row"),
                        F.struct(F.col("e.doc").alias("Entries")).alias("doc")))
    key = "results" if entries else "data"
    payloads = (docs.groupBy("payload")
                .agg(F.sort_array(F.collect_list(F.struct("api_row", "doc"))).alias("p"))
                .select("payload", F.col("p.doc").alias(key)))
    path = scratch_path(s, f"payloads-{uuid.uuid4().hex}")
    payloads.write.mode("overwrite").partitionBy("payload").json(path)
    return path


def _json_docs(s, d):
    docs = J.read_ledger_documents(s, landed_payloads(s, d, entries=False))
    p = prepare(docs.select("*", F.col("Kunde.KUNDENNR").alias("KUNDENNR"), F.col("Kunde.NAME2").alias("NAME2")))
    return p.select("BELEGNR", "ORDER_ID", "KUNDENNR", "NAME2", F.col("BELEGDAT").cast("timestamp_ntz").alias("BELEGDAT"),
                    "ORIGIN", "ISOA2_LAND", "BELEGART", "ZAHLART", "NETTO", "BRUTTO", "ERLOES",
                    "Date", "Month", "Week", "DayOfWeek", "Hour")


_PREP_SQL = with_views(["po"], """SELECT BELEGNR, ORDER_ID, KUNDENNR, NAME2, BELEGDAT, ORIGIN, ISOA2_LAND, BELEGART,
ZAHLART, CAST(NETTO AS DOUBLE) AS NETTO, CAST(BRUTTO AS DOUBLE) AS BRUTTO, CAST(ERLOES AS DOUBLE) AS ERLOES,
"Date", "Month", "Week", "DayOfWeek", "Hour" FROM po""")
register("src_json_envelope", _json_docs, _PREP_SQL)


def _entries_docs(s, d):
    docs = J.read_ledger_documents(s, landed_payloads(s, d, entries=True))
    return docs.select("BELEGNR", "ORDER_ID", "BELEGDAT", "BRUTTO", "`Kunde.KUNDENNR`", "`Kunde.NAME2`")


register("src_entries_expand", _entries_docs,
         with_views(["belege_orders"], """SELECT BELEGNR, ORDER_ID, strftime(BELEGDAT, '%Y-%m-%d %H:%M:%S') AS BELEGDAT,
CAST(BRUTTO AS DOUBLE) AS BRUTTO, KUNDENNR AS "Kunde.KUNDENNR", NAME2 AS "Kunde.NAME2" FROM belege_orders"""))


# --- A3: nested objects flattened to dotted columns ------------------------------------------------

def _flattened(s, d):
    rows = J.unwrap_envelope(J.read_payloads(s, landed_payloads(s, d, entries=False)))
    return J.flatten_structs(rows.select("BELEGNR", "Kunde"))


register("src_struct_flatten", _flattened,
         with_views(["belege_orders"], """SELECT BELEGNR, KUNDENNR AS "Kunde.KUNDENNR", NAME2 AS "Kunde.NAME2"
FROM belege_orders"""))

# --- A10, A4: landed snapshot, read back through the date/platform window -------------------------
from kontor.sources import filters as FL  # noqa: E402
from kontor.sources import sinks as S  # noqa: E402

SNAPSHOT_COLS = ["BELEGNR", "ORDER_ID", "KUNDENNR", "NAME2", "BELEGDAT", "ORIGIN", "ISOA2_LAND", "BELEGART",
                 "ZAHLART", "NETTO", "BRUTTO", "ERLOES", "api_row"]


def landed_snapshot(s: SparkSession, d: str) -> str:
    path = scratch_path(s, f"documents-{uuid.uuid4().hex}")
    docs = AD.belege_orders(s, d).withColumn("BELEGDAT", F.col("BELEGDAT").cast("timestamp"))
    S.write_documents_snapshot(docs, path, "b1")
    return path


def _snapshot(s, d):
    got = s.read.parquet(landed_snapshot(s, d)).filter(F.col("batch_id") == "b1")
    return got.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c == "BELEGDAT"
                        else (F.col(c).cast("double").alias(c) if c in ("NETTO", "BRUTTO", "ERLOES") else c)
                        for c in SNAPSHOT_COLS])


_SNAP_SQL = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in ("NETTO", "BRUTTO", "ERLOES") else c for c in SNAPSHOT_COLS)
register("sink_documents_snapshot", _snapshot, with_views(["belege_orders"], f"SELECT {_SNAP_SQL} FROM belege_orders"))

WINDOW = ("01.01.1995", "31.12.1996")


def _window(s, d):
    got = FL.documents_window(s, landed_snapshot(s, d), *WINDOW, FL.build_origins(True, True, "Kaufland"))
    return got.select("BELEGNR", "ORIGIN", F.col("BELEGDAT").cast("timestamp_ntz").alias("BELEGDAT"))


register("src_documents_window", _window,
         with_views(["belege_orders"], """SELECT BELEGNR, ORIGIN, BELEGDAT FROM belege_orders
WHERE ORIGIN IN ('Amazon', 'Ebay', 'Kaufland')
  AND CAST(BELEGDAT AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'"""))

# --- B10-B12 ---------------------------------------------------------------------------------------
register("filter_origins",
         lambda s, d: FL.filter_origins(prepare(AD.belege_orders(s, d)), FL.build_origins(True, False, " Kaufland ,,"))
         .select("BELEGNR", "ORIGIN"),
         with_views(["po"], "SELECT BELEGNR, ORIGIN FROM po WHERE ORIGIN IN ('Amazon', 'Kaufland')"))
register("filter_date_range",
         lambda s, d: FL.filter_date_range(prepare(AD.belege_events(s, d)), "03.01.2024", "05.01.2024")
         .select("BELEGNR", F.col("BELEGDAT").cast("timestamp_ntz").alias("BELEGDAT")),
         with_views(["pe"], """SELECT BELEGNR, BELEGDAT FROM pe
WHERE CAST(BELEGDAT AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-05'"""))
register("date_validity",
         lambda s, d: FL.date_validity(AD.belege_raw(s, d), "BELEGDAT").select("BELEGNR", "BELEGDAT", "BELEGDAT_validity"),
         with_views(["belege_raw"], """SELECT BELEGNR, BELEGDAT,
CASE WHEN BELEGDAT IS NULL OR BELEGDAT = '' THEN 'Date empty'
     WHEN NOT regexp_matches(BELEGDAT, '^\\d{2}\\.\\d{2}\\.\\d{4}$') THEN 'Use DD.MM.YYYY format'
     WHEN try_strptime(BELEGDAT, '%d.%m.%Y') IS NULL THEN 'Invalid date' END AS BELEGDAT_validity
FROM belege_raw"""))

# --- A11, A12: sinks read back ------------------------------------------------------------------------


def _sink_matched(s, d):
    path = scratch_path(s, f"matched-{uuid.uuid4().hex}")
    from kontor.plans.registry_reconcile import SHOP_COLS
    m = R.match_orders(AD.shop_export(s, d), AD.belege_orders(s, d)).select(*SHOP_COLS)
    S.write_matched(m, path)
    return s.read.schema(m.schema).option("header", True).option("sep", ";").csv(path)


def _sink_matched_sql():
    from kontor.plans.registry_reconcile import SHOP_COLS
    cols = ", ".join(f"NULLIF({c}, '') AS {c}" if c in ("auszahlungsdatum",) else c for c in SHOP_COLS)
    return with_views(["shop_export", "belege_orders"], f"""SELECT {cols} FROM shop_export
WHERE EXISTS (SELECT 1 FROM belege_orders b WHERE b.ORDER_ID = shop_export.bestellnummer)""")


register("sink_matched", _sink_matched, _sink_matched_sql())


def _sink_report(s, d):
    from kontor.plans.registry_reconcile import txl
    lines = R.report_lines(txl(s, d))
    path = scratch_path(s, f"report-{uuid.uuid4().hex}")
    S.write_report(lines, path)
    schema = lines.drop("file_id").schema
    back = s.read.schema(schema).option("header", True).option("sep", ";").csv(path)
    return back.withColumn("file_id", F.col("file_id").cast("string")).select(*lines.columns) \
        if "file_id" in back.columns else back


def _sink_report_sql():
    from kontor.plans.registry_reconcile import _REPORT_LINES_SQL
    cols = ", ".join(f"NULLIF(\"{c}\", '') AS \"{c}\"" if c in "BCDEFGHQR" else f"\"{c}\""
                     for c in [x for x, _ in K.REPORT_HEADERS] + ["T", "U"])
    return with_views(["txl", "fs"], f"SELECT file_id, section, row_no, {cols} FROM ({_REPORT_LINES_SQL})")


register("sink_report", _sink_report, _sink_report_sql())

# --- A13, A14 ---------------------------------------------------------------------------------------------
register("preview",
         lambda s, d: S.preview(AD.belege_orders(s, d).select("BELEGNR", "ORDER_ID", "ORIGIN"), ["BELEGNR"]),
         with_views(["belege_orders"], "SELECT BELEGNR, ORDER_ID, ORIGIN FROM belege_orders ORDER BY BELEGNR LIMIT 50"))
register("batch_stats",
         lambda s, d: S.batch_stats(AD.belege_events(s, d)).select(
             "rows", "columns", F.col("date_from").cast("timestamp_ntz").alias("date_from"),
             F.col("date_to").cast("timestamp_ntz").alias("date_to"), "origins"),
         with_views(["belege_events"], """SELECT COUNT(*) AS rows, CAST(8 AS BIGINT) AS columns,
MIN(BELEGDAT) AS date_from, MAX(BELEGDAT) AS date_to, list_sort(list(DISTINCT ORIGIN)) AS origins FROM belege_events"""))


# --- every payload shape, in batch and streamed (A1, A2, A10) ---------------------------------------

PAYLOAD_FIELDS = ["BELEGNR", "ORDER_ID", "KUNDENNR", "NAME2", "BELEGDAT", "ORIGIN", "ISOA2_LAND", "BELEGART", "ZAHLART",
                  "NETTO", "BRUTTO", "ERLOES"]


def _payload_documents(s: SparkSession, d: str) -> DataFrame:
    """(payload, api_row, one): a document as JSON, PAYLOAD_DOCS of them a payload."""
    docs = AD.belege_orders(s, d).withColumn("BELEGDAT", F.col("BELEGDAT").cast("string"))
    return docs.select(F.floor(F.col("api_row") / PAYLOAD_DOCS).alias("payload"), "api_row", F.struct(*PAYLOAD_FIELDS).alias("doc"))


def landed_shapes(s: SparkSession, d: str) -> str:
    """A folder of payload files that take turns in eight shapes: the three envelopes, a bare list, columns, and
    entries as objects, as arrays and mixed."""
    packed = (_payload_documents(s, d).groupBy("payload")
              .agg(F.array_sort(F.collect_list(F.struct("api_row", "doc"))).alias("d"))
              .select("payload", F.col("d.doc").alias("d"))
              .withColumn("j", F.transform("d", lambda x: F.to_json(x, {"ignoreNullFields": "false"}))))
    every = F.array_join("j", ",")
    entry = F.transform("j", lambda x: F.concat(F.lit('{"Entries":'), x, F.lit("}")))
    rest = F.array_join(F.slice("j", F.lit(2), F.size("j")), ",")

    def text(*parts) -> F.Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    shapes = [text('{"data":[', every, '],"count":1}'), text('{"results":[', every, "]}"), text('{"rows":[', every, "]}"), text("[", every, "]"),
              F.to_json(F.struct(*[F.col(f"d.{f}").alias(f) for f in PAYLOAD_FIELDS])),
              text('{"data":[', F.array_join(entry, ","), "]}"), text('{"results":[{"Entries":[', every, "]}]}"),
              text('{"rows":[', F.get(entry, 0), ',{"Entries":[', rest, ']},{"Entries":null}]}')]
    value = F.element_at(F.array(*shapes), (F.col("payload") % len(shapes) + 1).cast("int"))
    path = scratch_path(s, f"shapes-{uuid.uuid4().hex}")
    packed.select(F.format_string("%012d", "payload").alias("payload"), value.alias("value")).write.partitionBy("payload").text(path)
    return path


def _prepared_columns(p: DataFrame) -> DataFrame:
    return p.select("BELEGNR", "ORDER_ID", "KUNDENNR", "NAME2", F.col("BELEGDAT").cast("timestamp_ntz").alias("BELEGDAT"),
                    "ORIGIN", "ISOA2_LAND", "BELEGART", "ZAHLART", "NETTO", "BRUTTO", "ERLOES", "Date", "Month", "Week", "DayOfWeek", "Hour")


def _streamed(s: SparkSession, inbox: str, multi_line: bool) -> DataFrame:
    from kontor.streaming.landing import land_documents
    run = uuid.uuid4().hex
    table, ckpt = (scratch_path(s, f"{x}-{run}") for x in ("landed", "landed-ckpt"))
    land_documents(s, inbox, table, ckpt, multi_line=multi_line).awaitTermination()
    return _prepared_columns(s.read.parquet(table))


register("src_json_all_shapes", lambda s, d: _prepared_columns(prepare(J.read_ledger_documents(s, landed_shapes(s, d)))), _PREP_SQL)
register("stream_landed_shapes", lambda s, d: _streamed(s, landed_shapes(s, d), multi_line=True), _PREP_SQL)


def _streamed_documents(s, d):
    """One payload a line, a bounded number of documents a file."""
    packed = (_payload_documents(s, d).groupBy("payload").agg(F.array_sort(F.collect_list(F.struct("api_row", "doc"))).alias("p"))
              .select(F.format_string("%012d", "payload").alias("payload"), F.col("p.doc").alias("data")))
    inbox = scratch_path(s, f"inbox-{uuid.uuid4().hex}")
    packed.write.partitionBy("payload").json(inbox)
    return _streamed(s, inbox, multi_line=False)


register("stream_landed_documents", _streamed_documents, _PREP_SQL)


# --- A1: payloads larger than a task ------------------------------------------------------------------

LARGE_DOCS = 20_000      # documents of a large payload: one file, read in as many tasks as it has splits


def _large_payloads(s, d):
    docs = AD.belege_orders(s, d).withColumn("BELEGDAT", F.col("BELEGDAT").cast("string"))
    docs = docs.select(F.floor(F.col("api_row") / LARGE_DOCS).alias("payload"), "api_row", F.to_json(F.struct(*PAYLOAD_FIELDS)).alias("one"))
    # a payload is whole in one window task, which is what writes it; a join to its first and last row could leave its rows
    # in several (the planner may drop the repartitioning of a join's result, and then the shuffle below it)
    own = Window.partitionBy("payload").orderBy("api_row")
    lines = docs.select("payload", "api_row", F.concat(
        F.when(F.lag("api_row").over(own).isNull(), F.lit('{"data": [')).otherwise(F.lit("")), F.col("one"),
        F.when(F.lead("api_row").over(own).isNull(), F.lit("]}")).otherwise(F.lit(","))).alias("value"))
    path = scratch_path(s, f"large-{uuid.uuid4().hex}")
    with shuffles_dropped(s):
        lines.sortWithinPartitions("payload", "api_row").select("payload", "value").write.partitionBy("payload").text(path)
    schema = T.StructType([T.StructField(f, T.StringType()) for f in PAYLOAD_FIELDS])      # known, so nothing is read to find it
    return _prepared_columns(prepare(J.read_ledger_documents(s, path, schema=schema, split=True)))


register("src_json_split_payloads", _large_payloads, _PREP_SQL)
