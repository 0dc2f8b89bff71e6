"""Reference SQL (DuckDB dialect) for the differential check of every query.

Each query's SQL is ``WITH <the views it needs> <body>``; the views repeat the
adapter definitions of :mod:`kontor.sources.adapters` in plain SQL."""

from __future__ import annotations

VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, deps: list[str], body: str) -> None:
    VIEWS[name] = (deps, body)


def with_views(needed: list[str], body: str, ctes: str = "") -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in needed:
        visit(n)
    parts = [f"{n} AS (\n{VIEWS[n][1]}\n)" for n in order] + ([ctes.strip()] if ctes.strip() else [])
    return "WITH " + ",\n".join(parts) + "\n" + body


STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
NUMBER_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

view("order_amounts", [], """
SELECT l_orderkey,
       SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS net,
       SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
           * (1 + CAST(l_tax AS DECIMAL(4,2)))) AS gross,
       SUM(CAST(l_quantity AS DECIMAL(6,2)) * CAST(p_retailprice AS DECIMAL(10,2))) AS cost
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY l_orderkey""")

view("belege_orders", ["order_amounts"], """
SELECT CAST(o_orderkey AS VARCHAR) AS BELEGNR,
       CAST(o_orderkey - o_orderkey % 2 AS VARCHAR) AS ORDER_ID,
       CAST(o_custkey AS VARCHAR) AS KUNDENNR,
       c_name AS NAME2,
       o_orderdate AS BELEGDAT,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Amazon' WHEN '2-HIGH' THEN 'Ebay'
            WHEN '3-MEDIUM' THEN 'Kaufland' WHEN '5-LOW' THEN ' Amazon ' END AS ORIGIN,
       CASE WHEN n_nationkey < 10 THEN ['DE','AT','FR','CH','IT','ES','NL','BE','PL','LU'][n_nationkey + 1]
            WHEN n_nationkey < 20 THEN n_name END AS ISOA2_LAND,
       CASE o_orderstatus WHEN 'F' THEN 'RE' WHEN 'P' THEN 'GU' WHEN 'O' THEN 'V' END AS BELEGART,
       c_mktsegment AS ZAHLART,
       CAST(COALESCE(net, 0) AS DECIMAL(18,4)) AS NETTO,
       CAST(COALESCE(gross, 0) AS DECIMAL(18,6)) AS BRUTTO,
       CAST(COALESCE(net, 0) - COALESCE(cost, 0) AS DECIMAL(18,4)) AS ERLOES,
       o_orderkey AS api_row
FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN order_amounts ON o_orderkey = l_orderkey""")

view("belege_events", [], """
SELECT CAST(event_id AS VARCHAR) AS BELEGNR,
       'E' || CAST(event_id AS VARCHAR) AS ORDER_ID,
       CAST(user_id AS VARCHAR) AS KUNDENNR,
       ts AS BELEGDAT,
       event_type AS ORIGIN,
       CAST(value AS DECIMAL(12,2)) AS BRUTTO,
       CAST(value AS DECIMAL(12,2)) * (CAST(json_extract_string(props, '$.k') AS INTEGER) - 30)
           * CAST(0.01 AS DECIMAL(2,2)) AS ERLOES,
       event_id AS api_row
FROM events""")

view("belege_lookup", [], """
SELECT CAST(o_orderkey - o_orderkey % 2 AS VARCHAR) AS ORDER_ID,
       CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN CAST(o_custkey AS VARCHAR) END AS KUNDENNR,
       CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey AS VARCHAR) END AS BELEGNR,
       o_orderkey AS api_row
FROM orders""")

view("belege_raw", [], """
SELECT CAST(o_orderkey AS VARCHAR) AS BELEGNR,
       CASE o_orderpriority
            WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
            WHEN '2-HIGH' THEN strftime(o_orderdate, '%d.%m.%Y')
            WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%Y-%m-%d')
            WHEN '4-NOT SPECIFIED' THEN 'n/a'
            ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS BELEGDAT,
       CASE o_orderpriority
            WHEN '1-URGENT' THEN CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR)
            WHEN '2-HIGH' THEN '  ' || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) || chr(9)
            WHEN '3-MEDIUM' THEN replace(CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR), '.', ',')
            WHEN '4-NOT SPECIFIED' THEN ''
            ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) || 'e0' END AS BRUTTO,
       o_orderkey AS api_row
FROM orders""")

_PREP_COLS = """
       CAST(BELEGDAT AS DATE) AS "Date",
       strftime(BELEGDAT, '%Y-%m') AS "Month",
       strftime(date_trunc('week', BELEGDAT), '%Y-%m-%d') || '/'
           || strftime(date_trunc('week', BELEGDAT) + INTERVAL 6 DAY, '%Y-%m-%d') AS "Week",
       dayname(BELEGDAT) AS "DayOfWeek",
       CAST(hour(BELEGDAT) AS INTEGER) AS "Hour\""""

view("po", ["belege_orders"], f"""
SELECT BELEGNR, ORDER_ID, KUNDENNR, NAME2, BELEGDAT,
       {STRIP.format(c="COALESCE(ORIGIN, 'Unknown')")} AS ORIGIN,
       {STRIP.format(c="COALESCE(ISOA2_LAND, 'Unknown')")} AS ISOA2_LAND,
       BELEGART, ZAHLART, NETTO, BRUTTO, ERLOES, api_row,{_PREP_COLS}
FROM belege_orders""")

view("pe", ["belege_events"], f"""
SELECT BELEGNR, ORDER_ID, KUNDENNR, BELEGDAT,
       {STRIP.format(c="COALESCE(ORIGIN, 'Unknown')")} AS ORIGIN,
       BRUTTO, ERLOES, api_row,{_PREP_COLS}
FROM belege_events""")

# the same events in a smaller currency: all amounts below 100
view("pe_tenth", ["pe"], "SELECT * REPLACE (BRUTTO * CAST(0.1 AS DECIMAL(2,1)) AS BRUTTO) FROM pe")

# --- marketplace export -----------------------------------------------------------

_TYP = """CASE WHEN l_returnflag = 'A' AND l_linenumber = 7 THEN 'Andere Gebühr'
            WHEN l_returnflag = 'N' AND l_linenumber = 6 THEN NULL
            WHEN l_returnflag = 'R' THEN 'Rückerstattung' ELSE 'Bestellung' END"""

view("shop_export", [], f"""
SELECT CAST(l_suppkey % 10 AS VARCHAR) AS file_id,
       row_number() OVER (PARTITION BY l_suppkey % 10 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
                          l_shipdate, l_extendedprice) AS row_idx,
       CAST(l_shipdate AS DATE) AS datum,
       {_TYP} AS typ,
       CAST(l_orderkey AS VARCHAR) AS bestellnummer,
       CAST(NULL AS VARCHAR) AS alte_bestellnummer,
       CAST(NULL AS VARCHAR) AS nutzername,
       CAST(NULL AS VARCHAR) AS name,
       CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 + CAST(l_tax AS DECIMAL(4,2))) AS VARCHAR) AS transaktionsbetrag_raw,
       CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) AS zwischensumme_raw,
       CASE WHEN l_linestatus = 'O' THEN '4.99' ELSE '--' END AS verpackung_raw,
       CASE WHEN ({_TYP}) = 'Bestellung' THEN '-0.35' ELSE '--' END AS fixer_anteil_raw,
       CAST(CAST(l_quantity AS DECIMAL(6,2)) * CAST(-0.25 AS DECIMAL(3,2)) AS VARCHAR) AS variabler_anteil_raw,
       CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN '-1.00' ELSE '—' END AS gebuehr_hohe_quote_raw,
       CASE WHEN l_discount >= 0.09 THEN '-0.50' END AS gebuehr_servicestatus_raw,
       CAST(CAST(l_tax AS DECIMAL(4,2)) * -10 AS VARCHAR) AS internationale_gebuehr_raw,
       CAST(CAST(l_extendedprice AS DECIMAL(12,2)) - CAST(l_quantity AS DECIMAL(6,2)) AS VARCHAR) AS betrag_abzgl_raw,
       CASE WHEN l_linestatus = 'F' THEN 'P' || strftime(l_shipdate, '%Y%m') END AS auszahlungsnr,
       CASE WHEN l_linestatus = 'F' THEN strftime(l_shipdate, '%Y-%m-%d') ELSE '' END AS auszahlungsdatum
FROM lineitem""")

view("shop_preamble", [], """
SELECT CAST(s_suppkey % 10 AS VARCHAR) AS file_id, s_suppkey * 2 AS row_idx, 'Verkäufer' AS c0, s_name AS c1 FROM supplier
UNION ALL
SELECT CAST(s_suppkey % 10 AS VARCHAR), s_suppkey * 2 + 1, 'Betrag', CAST(CAST(s_acctbal AS DECIMAL(12,2)) AS VARCHAR)
FROM supplier""")


def CLEAN(c: str) -> str:
    s = f"regexp_replace({STRIP.format(c=c)}, '([0-9])_([0-9])', '\\1\\2', 'g')"
    return (f"CASE WHEN {c} IN ('--', '—') THEN 0.0 ELSE COALESCE(CASE WHEN regexp_matches({s}, '{NUMBER_RE}') "
            f"THEN TRY_CAST({s} AS DOUBLE) END, 0.0) END")


view("tx", ["shop_export"], f"""
SELECT file_id, row_idx, datum, typ, bestellnummer, alte_bestellnummer, nutzername, name,
       {CLEAN('transaktionsbetrag_raw')} AS transaktionsbetrag,
       {CLEAN('zwischensumme_raw')} + {CLEAN('verpackung_raw')} AS zwischensumme,
       {CLEAN('fixer_anteil_raw')} AS fixer_anteil,
       {CLEAN('variabler_anteil_raw')} AS variabler_anteil,
       {CLEAN('gebuehr_hohe_quote_raw')} AS gebuehr_hohe_quote,
       {CLEAN('gebuehr_servicestatus_raw')} AS gebuehr_servicestatus,
       {CLEAN('internationale_gebuehr_raw')} AS internationale_gebuehr,
       {CLEAN('betrag_abzgl_raw')} AS betrag_abzgl,
       auszahlungsnr, auszahlungsdatum,
       contains(typ, 'Andere Geb') AS is_other_fee
FROM shop_export WHERE typ IS NOT NULL AND typ <> ''""")

_VALID = "{c} IS NOT NULL AND {c} <> '' AND {c} <> '0'"
view("lookup", ["belege_lookup"], f"""
SELECT * FROM (
  SELECT ORDER_ID,
         max_by(KUNDENNR, api_row) FILTER (WHERE {_VALID.format(c='KUNDENNR')}) AS KUNDENNR,
         max_by(BELEGNR, api_row) FILTER (WHERE {_VALID.format(c='BELEGNR')}) AS BELEGNR
  FROM belege_lookup WHERE ORDER_ID IS NOT NULL AND ORDER_ID <> '' GROUP BY ORDER_ID)
WHERE KUNDENNR IS NOT NULL OR BELEGNR IS NOT NULL""")

view("txl", ["tx", "lookup"], """
SELECT tx.*, lookup.KUNDENNR AS kdnr, lookup.BELEGNR AS rgnr
FROM tx LEFT JOIN lookup ON tx.bestellnummer = lookup.ORDER_ID""")

_NB = "{c} IS NOT NULL AND CAST({c} AS VARCHAR) <> ''"
view("fs", ["txl"], f"""
SELECT file_id,
       COUNT(*) FILTER (WHERE NOT is_other_fee) AS regular_count,
       COUNT(*) FILTER (WHERE is_other_fee) AS other_fee_count,
       SUM(CAST(fixer_anteil AS DECIMAL(18,6))) FILTER (WHERE NOT is_other_fee) AS sum_K,
       SUM(CAST(variabler_anteil AS DECIMAL(18,6))) FILTER (WHERE NOT is_other_fee) AS sum_L,
       SUM(CAST(gebuehr_hohe_quote AS DECIMAL(18,6))) FILTER (WHERE NOT is_other_fee) AS sum_M,
       SUM(CAST(gebuehr_servicestatus AS DECIMAL(18,6))) FILTER (WHERE NOT is_other_fee) AS sum_N,
       SUM(CAST(internationale_gebuehr AS DECIMAL(18,6))) FILTER (WHERE NOT is_other_fee) AS sum_O,
       SUM(CAST(zwischensumme AS DECIMAL(18,6))) FILTER (WHERE NOT is_other_fee) AS sum_J,
       SUM(CAST(betrag_abzgl AS DECIMAL(18,6))) FILTER (WHERE NOT is_other_fee) AS sum_P,
       SUM(CAST(betrag_abzgl AS DECIMAL(18,6))) FILTER (WHERE is_other_fee) AS other_fee_total,
       max_by(datum, row_idx) FILTER (WHERE NOT is_other_fee AND {_NB.format(c='datum')}) AS last_datum,
       max_by(auszahlungsnr, row_idx) FILTER (WHERE NOT is_other_fee AND {_NB.format(c='auszahlungsnr')}) AS last_auszahlungsnr,
       max_by(auszahlungsdatum, row_idx) FILTER (WHERE NOT is_other_fee AND {_NB.format(c='auszahlungsdatum')}) AS last_auszahlungsdatum,
       CASE WHEN COUNT(*) FILTER (WHERE is_other_fee) > 0
            THEN (min_by(struct_pack(d := datum), row_idx) FILTER (WHERE is_other_fee)).d
            ELSE max_by(datum, row_idx) FILTER (WHERE NOT is_other_fee AND {_NB.format(c='datum')}) END AS andere_datum
FROM txl GROUP BY file_id""")
