"""Registry entries for export reconciliation (C, D24-D31, S, W3-W5, B13-B17, B26, A9)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.functions import cleaning as cl
from kontor.functions import constants as K
from kontor.operators import reconcile as R
from kontor.plans.oracle import CLEAN, with_views
from kontor.plans.catalog import REGISTRY, register
from kontor.session import scratch_path
from kontor.sources import adapters as AD
from kontor.sources.sinks import write_documents_table


def shop(s: SparkSession, d: str) -> DataFrame:
    return AD.shop_export(s, d)


def tx(s: SparkSession, d: str) -> DataFrame:
    return R.normalize_transactions(shop(s, d))


def txl(s: SparkSession, d: str) -> DataFrame:
    return R.attach_lookups(tx(s, d), AD.belege_lookup(s, d))


def summary(s: SparkSession, d: str) -> DataFrame:
    return R.file_summary(txl(s, d))


SHOP_COLS = ["file_id", "row_idx", "datum", "typ", "bestellnummer", "alte_bestellnummer", "nutzername", "name",
             "transaktionsbetrag_raw", "zwischensumme_raw", "verpackung_raw", "fixer_anteil_raw",
             "variabler_anteil_raw", "gebuehr_hohe_quote_raw", "gebuehr_servicestatus_raw",
             "internationale_gebuehr_raw", "betrag_abzgl_raw", "auszahlungsnr", "auszahlungsdatum"]
TX_COLS = ["file_id", "row_idx", "datum", "typ", "bestellnummer", "alte_bestellnummer", "nutzername", "name",
           "transaktionsbetrag", "zwischensumme", "fixer_anteil", "variabler_anteil", "gebuehr_hohe_quote",
           "gebuehr_servicestatus", "internationale_gebuehr", "betrag_abzgl", "auszahlungsnr",
           "auszahlungsdatum", "is_other_fee"]
AMOUNTS = ["transaktionsbetrag", "zwischensumme", "verpackung", "fixer_anteil", "variabler_anteil",
           "gebuehr_hohe_quote", "gebuehr_servicestatus", "internationale_gebuehr", "betrag_abzgl"]

# --- B13-B17, S1 ---------------------------------------------------------------------
register("clean_amount",
         lambda s, d: shop(s, d).select("file_id", "row_idx",
                                        *[cl.clean_amount(F.col(f"{a}_raw")).alias(a) for a in AMOUNTS]),
         with_views(["shop_export"], "SELECT file_id, row_idx, " + ", ".join(
             f"{CLEAN(a + '_raw')} AS {a}" for a in AMOUNTS) + " FROM shop_export"))
def _yyyymm(s, d):
    e = shop(s, d)
    dt = e.schema["datum"].dataType
    return e.select("file_id", "row_idx", cl.yyyymm(F.col("datum"), dt).alias("datum_yyyymm"),
                    cl.yyyymm(F.col("auszahlungsdatum")).alias("auszahlungsdatum_yyyymm"))


register("yyyymm", _yyyymm,
         with_views(["shop_export"], """SELECT file_id, row_idx, COALESCE(strftime(datum, '%Y%m'), '') AS datum_yyyymm,
COALESCE(strftime(try_strptime(substr(auszahlungsdatum, 1, 10), '%Y-%m-%d'), '%Y%m'), '') AS auszahlungsdatum_yyyymm
FROM shop_export"""))


register("drop_blank_type", lambda s, d: tx(s, d).select("file_id", "row_idx", "typ"),
         with_views(["tx"], "SELECT file_id, row_idx, typ FROM tx"))
register("subtotal_with_shipping", lambda s, d: tx(s, d).select("file_id", "row_idx", "zwischensumme"),
         with_views(["tx"], "SELECT file_id, row_idx, zwischensumme FROM tx"))
register("normalize_transaction", lambda s, d: txl(s, d).select(*TX_COLS, "kdnr", "rgnr"),
         with_views(["txl"], f"SELECT {', '.join(TX_COLS)}, kdnr, rgnr FROM txl"))
register("split_other_fees", lambda s, d: tx(s, d).select("file_id", "row_idx", "typ", "is_other_fee"),
         with_views(["tx"], "SELECT file_id, row_idx, typ, is_other_fee FROM tx"))

# --- S4, C1, C2, D24 ---------------------------------------------------------------------
register("distinct_order_ids", lambda s, d: R.distinct_order_ids(AD.belege_orders(s, d)),
         with_views(["belege_orders"], "SELECT DISTINCT ORDER_ID FROM belege_orders WHERE ORDER_ID IS NOT NULL"))
register("match_orders", lambda s, d: R.match_orders(shop(s, d), AD.belege_orders(s, d)).select(*SHOP_COLS),
         with_views(["shop_export", "belege_orders"], f"""SELECT {', '.join(SHOP_COLS)} FROM shop_export
WHERE EXISTS (SELECT 1 FROM belege_orders b WHERE b.ORDER_ID = shop_export.bestellnummer)"""))
register("unmatched_orders", lambda s, d: R.unmatched_orders(shop(s, d), AD.belege_orders(s, d)).select(*SHOP_COLS),
         with_views(["shop_export", "belege_orders"], f"""SELECT {', '.join(SHOP_COLS)} FROM shop_export
WHERE NOT EXISTS (SELECT 1 FROM belege_orders b WHERE b.ORDER_ID = shop_export.bestellnummer)"""))
register("match_stats", lambda s, d: R.match_stats(shop(s, d), AD.belege_orders(s, d)),
         with_views(["shop_export", "belege_orders"], """SELECT
(SELECT COUNT(DISTINCT ORDER_ID) FROM belege_orders) AS unique_order_ids,
COUNT(*) FILTER (WHERE hit) AS matched, COUNT(*) AS total,
(COUNT(*) FILTER (WHERE hit)) * 100.0 / NULLIF(CAST(COUNT(*) AS DOUBLE), 0) AS match_pct,
COUNT(*) - COUNT(*) FILTER (WHERE hit) AS unmatched
FROM (SELECT EXISTS (SELECT 1 FROM belege_orders b WHERE b.ORDER_ID = shop_export.bestellnummer) AS hit
      FROM shop_export)"""))

# --- C3, C4, D25 ---------------------------------------------------------------------------
register("order_lookup", lambda s, d: R.order_lookup(AD.belege_lookup(s, d)),
         with_views(["lookup"], "SELECT ORDER_ID, KUNDENNR, BELEGNR FROM lookup"))
register("map_customer_no", lambda s, d: txl(s, d).select("file_id", "row_idx", "bestellnummer", "kdnr"),
         with_views(["txl"], "SELECT file_id, row_idx, bestellnummer, kdnr FROM txl"))
register("map_invoice_no", lambda s, d: txl(s, d).select("file_id", "row_idx", "bestellnummer", "rgnr"),
         with_views(["txl"], "SELECT file_id, row_idx, bestellnummer, rgnr FROM txl"))
register("lookup_coverage", lambda s, d: R.lookup_coverage(txl(s, d), AD.belege_lookup(s, d)),
         with_views(["txl", "lookup"], """SELECT file_id, COUNT(*) AS regular_rows, COUNT(kdnr) AS kdnr_matched,
COUNT(rgnr) AS rgnr_matched, (SELECT COUNT(KUNDENNR) FROM lookup) AS kdnr_map_size,
(SELECT COUNT(BELEGNR) FROM lookup) AS rgnr_map_size
FROM txl WHERE NOT is_other_fee GROUP BY file_id"""))

# --- W3, W4, W5 ------------------------------------------------------------------------------
register("last_nonblank_per_file",
         lambda s, d: summary(s, d).select("file_id", "last_datum", "last_auszahlungsnr", "last_auszahlungsdatum"),
         with_views(["fs"], "SELECT file_id, last_datum, last_auszahlungsnr, last_auszahlungsdatum FROM fs"))
register("first_other_fee_date", lambda s, d: summary(s, d).select("file_id", "andere_datum"),
         with_views(["fs"], "SELECT file_id, andere_datum FROM fs"))
register("report_row_numbers",
         lambda s, d: R.ordinal_by_index(tx(s, d).filter(~F.col("is_other_fee")), ["file_id"], "row_idx", out="row_no")
         .select("file_id", "row_idx", (F.col("row_no") + F.lit(K.REPORT_FIRST_DATA_ROW - 1)).alias("row_no")),
         with_views(["tx"], """SELECT file_id, row_idx,
row_number() OVER (PARTITION BY file_id ORDER BY row_idx) + 4 AS row_no FROM tx WHERE NOT is_other_fee"""))

# --- D26-D31 -----------------------------------------------------------------------------------
def _sum(*columns: str) -> str:
    """Exact sums, turned into a number once."""
    return f"CAST({' + '.join(f'COALESCE({c}, 0)' for c in columns)} AS DOUBLE)"


_FEES = [_sum(f"sum_{x}") for x in "KLMNO"]
_J_FEE = _sum(*[f"sum_{x}" for x in "KLMNO"])
_OTHER = _sum("other_fee_total")
_J_TOTAL = _sum("sum_J", *[f"sum_{x}" for x in "KLMNO"], "other_fee_total")
_P_TOTAL = _sum("sum_P", "other_fee_total")
_YM = "COALESCE(strftime({c}, '%Y%m'), '')"

register("fee_summary", lambda s, d: R.fee_summary(summary(s, d)),
         with_views(["fs"], f"""SELECT file_id, last_datum AS A, 'Gebuehr' AS F, '7400700' AS G,
{_YM.format(c='last_datum')} AS H, {_J_FEE} AS I, {_J_FEE} AS J, """
                    + ", ".join(f"{f} AS {x}" for f, x in zip(_FEES, "KLMNO"))
                    + ", 0.0 AS P, last_auszahlungsnr AS Q, last_auszahlungsdatum AS R FROM fs"))
register("other_fee_summary",
         lambda s, d: R.other_fee_summary(summary(s, d)),
         with_views(["fs"], f"""SELECT file_id, andere_datum AS A, 'Andere Gebuehr' AS F, '7400700' AS G,
{_YM.format(c='andere_datum')} AS H, {_OTHER} AS I, {_OTHER} AS J, {_OTHER} AS P,
last_auszahlungsnr AS Q, last_auszahlungsdatum AS R FROM fs"""))
register("report_totals", lambda s, d: R.report_totals(summary(s, d)),
         with_views(["fs"], f"SELECT file_id, {_J_TOTAL} AS J, {_P_TOTAL} AS P FROM fs"))
register("processing_summary", lambda s, d: R.processing_summary(summary(s, d)),
         with_views(["fs"], f"SELECT file_id, regular_count, other_fee_count, {_OTHER} AS other_fee_total FROM fs"))
register("preamble_metadata", lambda s, d: R.preamble_metadata(AD.shop_preamble(s, d)),
         with_views(["shop_preamble"], """SELECT file_id,
(max_by(struct_pack(v := c1), row_idx) FILTER (WHERE contains(c0, 'Verkäufer'))).v AS seller,
(max_by(struct_pack(v := c1), row_idx) FILTER (WHERE contains(c0, 'Betrag'))).v AS amount
FROM shop_preamble GROUP BY file_id"""))
register("report_header",
         lambda s, d: R.report_header(summary(s, d), R.preamble_metadata(AD.shop_preamble(s, d))),
         with_views(["fs", "shop_preamble"], """SELECT fs.file_id, p.seller, regular_count + other_fee_count AS transactions,
p.amount FROM fs LEFT JOIN (SELECT file_id,
(max_by(struct_pack(v := c1), row_idx) FILTER (WHERE contains(c0, 'Verkäufer'))).v AS seller,
(max_by(struct_pack(v := c1), row_idx) FILTER (WHERE contains(c0, 'Betrag'))).v AS amount
FROM shop_preamble GROUP BY file_id) p ON fs.file_id = p.file_id"""))

# --- S2, S3, D31, B26: report lines ------------------------------------------------------------
LETTERS = [c for c, _ in K.REPORT_HEADERS] + ["T", "U"]
_TYPES = {x: "VARCHAR" for x in LETTERS}
_TYPES.update({"A": "DATE"})
_TYPES.update({x: "DOUBLE" for x in "IJKLMNOPTU"})


def _line(section: str, row_no: str, vals: dict[str, str], src: str, where: str = "") -> str:
    cols = [f"file_id", f"'{section}' AS section", f"CAST({row_no} AS BIGINT) AS row_no"]
    cols += [f"CAST({vals.get(x, 'NULL')} AS {_TYPES[x]}) AS \"{x}\"" for x in LETTERS]
    return f"SELECT {', '.join(cols)} FROM {src}" + (f" WHERE {where}" if where else "")


_DATA_VALS = {"A": "datum", "B": "typ", "C": "bestellnummer", "D": "alte_bestellnummer", "E": "nutzername",
              "F": "name", "G": "kdnr", "H": "rgnr", "I": "transaktionsbetrag", "J": "zwischensumme",
              "K": "fixer_anteil", "L": "variabler_anteil", "M": "gebuehr_hohe_quote", "N": "gebuehr_servicestatus",
              "O": "internationale_gebuehr", "P": "betrag_abzgl", "Q": "auszahlungsnr", "R": "auszahlungsdatum",
              "T": "zwischensumme", "U": "zwischensumme - zwischensumme"}
_REPORT_LINES_SQL = " UNION ALL ".join([
    _line("data", "row_number() OVER (PARTITION BY file_id ORDER BY row_idx) + 4", _DATA_VALS, "txl", "NOT is_other_fee"),
    _line("gebuehr", "regular_count + 5", {"A": "last_datum", "F": "'Gebuehr'", "G": "'7400700'",
                                           "H": _YM.format(c="last_datum"), "I": _J_FEE, "J": _J_FEE,
                                           **{x: f for f, x in zip(_FEES, "KLMNO")}, "P": "0.0",
                                           "Q": "last_auszahlungsnr", "R": "last_auszahlungsdatum"}, "fs"),
    _line("andere_gebuehr", "regular_count + 6", {"A": "andere_datum", "F": "'Andere Gebuehr'", "G": "'7400700'",
                                                  "H": _YM.format(c="andere_datum"), "I": _OTHER, "J": _OTHER,
                                                  "P": _OTHER, "Q": "last_auszahlungsnr",
                                                  "R": "last_auszahlungsdatum"}, "fs"),
    _line("totals", "regular_count + 7", {
        "J": _J_TOTAL, "P": _P_TOTAL}, "fs"),
])
register("report_lines", lambda s, d: R.report_lines(txl(s, d)), with_views(["txl", "fs"], _REPORT_LINES_SQL))

_DETAIL_VALS = {"A": "datum", "B": "typ", "C": "bestellnummer", "D": "alte_bestellnummer", "E": "nutzername",
                "F": "name", "G": "'7400700'", "H": _YM.format(c="datum"), "I": "betrag_abzgl", "J": "betrag_abzgl",
                "K": "0.0", "L": "0.0", "M": "0.0", "N": "0.0", "O": "0.0", "P": "betrag_abzgl",
                "Q": "auszahlungsnr", "R": "auszahlungsdatum"}
_DETAIL_TOTALS_SQL = _line("detail_total", "n + 2", {"J": "s", "P": "s"},
                           "(SELECT file_id, COUNT(*) AS n, CAST(SUM(CAST(betrag_abzgl AS DECIMAL(18,6))) AS DOUBLE) AS s FROM tx WHERE is_other_fee GROUP BY file_id)")
register("other_fee_detail", lambda s, d: R.other_fee_detail(tx(s, d)),
         with_views(["tx"], _line("detail", "row_number() OVER (PARTITION BY file_id ORDER BY row_idx)", _DETAIL_VALS,
                                  "tx", "is_other_fee") + " UNION ALL " + _DETAIL_TOTALS_SQL))
register("other_fee_detail_totals", lambda s, d: R.other_fee_detail_totals(tx(s, d)),
         with_views(["tx"], _DETAIL_TOTALS_SQL))


def _quote(h: str) -> str:
    return '"' + h.replace('"', '""') + '"'


register("output_layout", lambda s, d: R.output_layout(R.report_lines(txl(s, d))),
         with_views(["txl", "fs"], "SELECT file_id, section, row_no, " + ", ".join(
             f"\"{x}\" AS {_quote(h)}" for x, h in K.REPORT_HEADERS) + f", T, U FROM ({_REPORT_LINES_SQL})"))


# --- P4: whole pipeline from landed export files ----------------------------------------------
from kontor.plans.oracle import VIEWS, view  # noqa: E402

view("txg", ["txl"], """SELECT * REPLACE (strftime(datum, '%Y-%m-%d') AS datum,
NULLIF(auszahlungsnr, '') AS auszahlungsnr, NULLIF(auszahlungsdatum, '') AS auszahlungsdatum) FROM txl""")
view("fsg", ["txg"], VIEWS["fs"][1].replace("FROM txl", "FROM txg"))
_YM_TXT = "COALESCE(strftime(try_strptime(substr({c}, 1, 10), '%Y-%m-%d'), '%Y%m'), '')"
_GRID_LINES_SQL = (_REPORT_LINES_SQL.replace("FROM txl", "FROM txg").replace("FROM fs", "FROM fsg")
                   .replace("AS DATE) AS \"A\"", "AS VARCHAR) AS \"A\"")
                   .replace(_YM.format(c="last_datum"), _YM_TXT.format(c="last_datum"))
                   .replace(_YM.format(c="andere_datum"), _YM_TXT.format(c="andere_datum")))


def _reconcile_exports(s, d):
    from kontor.plans.composites import reconcile_exports
    from kontor.plans.registry_sources import landed_exports
    out = reconcile_exports(s, landed_exports(s, d), AD.belege_lookup(s, d), export_column="file_id")
    return out["report_lines"]


register("reconcile_exports", _reconcile_exports, with_views(["txg", "fsg"], _GRID_LINES_SQL))


# --- C1-C4, D24 against documents landed by order number --------------------------------------

BUCKETS = 16


def landed_table(docs: DataFrame) -> DataFrame:
    """Documents as a table in buckets of order numbers."""
    name = f"documents_{uuid.uuid4().hex}"
    return write_documents_table(docs, name, scratch_path(docs.sparkSession, name), BUCKETS)


register("match_stats_landed", lambda s, d: R.match_stats(AD.shop_export(s, d), landed_table(AD.belege_orders(s, d))),
         REGISTRY["match_stats"].sql)
register("order_lookup_landed", lambda s, d: R.order_lookup(landed_table(AD.belege_lookup(s, d))), REGISTRY["order_lookup"].sql)
