"""Marketplace-export reconciliation.

Input is a frame of export rows with the raw cells of each normalized field:
``file_id``, ``row_idx`` (position in the export file), ``datum``, ``typ``,
``bestellnummer``, ``alte_bestellnummer``, ``nutzername``, ``name``, the
amount cells ``<field>_raw`` and ``auszahlungsnr``/``auszahlungsdatum``.
Both the CSV grid reader and the adapter view produce that frame.

Everything per export file comes from one aggregation per (file, bucket of
2^16 rows) with conditional and order-aware aggregates (``max_by``/``min_by``
on ``row_idx``): the result does not depend on partition order, a hot file is
reduced map-side before the shuffle, the file summaries are a roll-up of the
small bucket table, and row numbers are the bucket's offset plus a row number
inside the bucket -- never a whole-file window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.functions import cleaning as cl
from kontor.functions import constants as K
from kontor.operators.ordinal import DEFAULT_BUCKET_ROWS, ordinal_by_index  # noqa: F401
from kontor.session import landed

TEXT_FIELDS = ["datum", "typ", "bestellnummer", "alte_bestellnummer", "nutzername", "name"]
LETTERS = [c for c, _ in K.REPORT_HEADERS]
MONEY = {"I": "transaktionsbetrag", "J": "zwischensumme", "K": "fixer_anteil", "L": "variabler_anteil",
         "M": "gebuehr_hohe_quote", "N": "gebuehr_servicestatus", "O": "internationale_gebuehr",
         "P": "betrag_abzgl"}
FEE_LETTERS = ["K", "L", "M", "N", "O"]


#: sums of amounts are taken in whole millionths, so that they do not depend on the order of the rows
MILLIONTHS = 1e6
#: larger amounts (no money any more) are summed as they are
WIDE = 1e12


def _sums(amount: Column, name: str) -> list[Column]:
    """Aggregates of an amount: ``sum_<name>`` in millionths, ``wide_<name>`` of what is too large for that."""
    fits = F.abs(amount) < F.lit(WIDE)
    return [F.sum(F.when(fits, F.round(amount * F.lit(MILLIONTHS)).cast("long"))).alias(f"sum_{name}"),
            F.sum(F.when(~fits, amount)).alias(f"wide_{name}")]


def _total(*names: str) -> Column:
    """The sum of the named sums as a number, converted once; 0 without rows."""
    def plus(prefix: str, zero: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.coalesce(F.col(f"{prefix}_{x}"), zero) for x in names])
    return plus("sum", F.lit(0).cast("long")) / F.lit(MILLIONTHS) + plus("wide", F.lit(0.0))


# --- B13-B17, S1: normalized transactions ------------------------------------------

def normalize_transactions(rows: DataFrame) -> DataFrame:
    """Typed transactions of all non-blank rows, with the other-fee flag.

    Amount cells: '--', '—', blank or unparsable -> 0. The item subtotal
    includes packaging and shipping. Rows whose type is NULL or '' are skipped."""
    cols = [F.col("file_id"), F.col("row_idx")] + [F.col(c) for c in TEXT_FIELDS]
    for f in K.AMOUNT_FIELDS:
        raw = f"{f}_raw"
        v = cl.clean_amount(F.col(raw)) if raw in rows.columns else F.lit(0.0)
        cols.append(v.alias(f))
    cols += [F.col("auszahlungsnr").cast("string"), F.col("auszahlungsdatum").cast("string")]
    t = rows.filter(~cl.is_blank(F.col("typ"))).select(*cols)
    return (t.withColumn("zwischensumme", F.col("zwischensumme") + F.col("verpackung"))
            .drop("verpackung")
            .withColumn("is_other_fee", F.col("typ").contains(K.OTHER_FEE_MARKER)))


# --- S4, C1, C2, D24: matching -------------------------------------------------------

def distinct_order_ids(docs: DataFrame) -> DataFrame:
    return docs.select("ORDER_ID").dropna().distinct()


def _order_key(rows: DataFrame) -> Column:
    """The order number as a join key. Rows without one (fee lines; NULL or blank) match nothing and
    would all meet in one partition of an outer join, so they get a key of their own instead."""
    none = F.concat(F.lit("\u0000"), F.xxhash64(*rows.columns).cast("string"))
    return F.when(cl.is_blank(F.col("bestellnummer")), none).otherwise(F.col("bestellnummer"))


def match_orders(shop: DataFrame, docs: DataFrame) -> DataFrame:
    """Export rows whose order number is a document ORDER_ID (semi join; left duplicates kept)."""
    ids = distinct_order_ids(docs)
    return shop.join(ids, shop["bestellnummer"] == ids["ORDER_ID"], "left_semi")


def unmatched_orders(shop: DataFrame, docs: DataFrame) -> DataFrame:
    ids = distinct_order_ids(docs)
    return (shop.withColumn("_key", _order_key(shop)).join(ids, F.col("_key") == ids["ORDER_ID"], "left_anti")
            .drop("_key"))


def match_stats(shop: DataFrame, docs: DataFrame) -> DataFrame:
    """unique_order_ids, matched, total, match_pct, unmatched -- one row."""
    ids = distinct_order_ids(docs).withColumn("_hit", F.lit(True))
    n_ids = ids.select(F.count(F.lit(1))).scalar()
    marked = shop.select(_order_key(shop).alias("_key")).join(ids, F.col("_key") == ids["ORDER_ID"], "left")
    agg = marked.agg(F.count_if(F.col("_hit").isNotNull()).alias("matched"), F.count(F.lit(1)).alias("total"))
    return agg.select(
        n_ids.alias("unique_order_ids"), "matched", "total",
        F.try_divide(F.col("matched") * F.lit(100.0), F.col("total").cast("double")).alias("match_pct"),
        (F.col("total") - F.col("matched")).alias("unmatched"))


# --- C3, C4: last-wins lookups --------------------------------------------------------

def _valid_value(c: Column) -> Column:
    return c.isNotNull() & (c != "") & (c != "0")


def order_lookup(docs: DataFrame) -> DataFrame:
    """ORDER_ID -> (KUNDENNR, BELEGNR), each from the last document (by ``api_row``)
    that has a usable value, chosen independently of each other."""
    d = docs.filter(F.col("ORDER_ID").isNotNull() & (F.col("ORDER_ID").cast("string") != ""))
    key = F.col("ORDER_ID").cast("string").alias("ORDER_ID")
    kd, rg = F.col("KUNDENNR").cast("string"), F.col("BELEGNR").cast("string")
    return (d.groupBy(key)
            .agg(F.max_by(kd, F.when(_valid_value(kd), F.col("api_row"))).alias("KUNDENNR"),
                 F.max_by(rg, F.when(_valid_value(rg), F.col("api_row"))).alias("BELEGNR"))
            .filter(F.col("KUNDENNR").isNotNull() | F.col("BELEGNR").isNotNull()))


def attach_lookups(tx: DataFrame, docs: DataFrame) -> DataFrame:
    """Add ``kdnr``/``rgnr`` to transactions by order number (left join)."""
    lk = order_lookup(docs).select(F.col("ORDER_ID").alias("_oid"), F.col("KUNDENNR").alias("kdnr"),
                                   F.col("BELEGNR").alias("rgnr"))
    return tx.withColumn("_key", _order_key(tx)).join(lk, F.col("_key") == lk["_oid"], "left").drop("_oid", "_key")


def lookup_coverage(tx: DataFrame, docs: DataFrame) -> DataFrame:
    """Per file: regular rows, rows with a customer / invoice number, and map sizes."""
    lk = order_lookup(docs)
    sizes = lk.agg(F.count("KUNDENNR").alias("kdnr_map_size"),
                   F.count("BELEGNR").alias("rgnr_map_size")).select(F.struct("*").alias("s")).scalar()
    reg = tx.filter(~F.col("is_other_fee"))
    return (reg.groupBy("file_id")
            .agg(F.count(F.lit(1)).alias("regular_rows"), F.count("kdnr").alias("kdnr_matched"),
                 F.count("rgnr").alias("rgnr_matched"))
            .withColumn("kdnr_map_size", sizes.getField("kdnr_map_size"))
            .withColumn("rgnr_map_size", sizes.getField("rgnr_map_size")))


# --- W3, W4, D26, D27, D30: one aggregate per (file, bucket) feeds everything -------------

BUCKET_ROWS = DEFAULT_BUCKET_ROWS
LAST_FIELDS = ["datum", "auszahlungsnr", "auszahlungsdatum"]


def _bucket(bucket_rows: int = BUCKET_ROWS) -> Column:
    return F.floor(F.col("row_idx") / F.lit(bucket_rows))


def bucket_summary(tx: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One aggregation of the transactions per (file_id, bucket of 2^16 rows).

    Holds row counts (for numbering), fee/J/P sums, the other-fee total and,
    for every "last non-blank" and "first other-fee" value, the value with the
    row it came from, so files can be rolled up without another pass."""
    reg = ~F.col("is_other_fee")
    oth = F.col("is_other_fee")
    aggs = [F.count_if(reg).alias("regular_count"), F.count_if(oth).alias("other_fee_count")]
    for letter in FEE_LETTERS + ["J", "P"]:
        aggs += _sums(F.when(reg, F.col(MONEY[letter])), letter)
    aggs += _sums(F.when(oth, F.col("betrag_abzgl")), "other_fee")
    for c in LAST_FIELDS:
        v = F.col(c)
        at = F.when(v.isNotNull() & (v.cast("string") != "") & reg, F.col("row_idx"))
        aggs += [F.max_by(v, at).alias(f"last_{c}"), F.max(at).alias(f"last_{c}_row")]
    first_at = F.when(oth, F.col("row_idx"))
    aggs += [F.min_by(F.struct(F.col("datum").alias("d")), first_at).alias("first_other"),
             F.min(first_at).alias("first_other_row")]
    return tx.groupBy("file_id", _bucket(bucket_rows).alias("bucket")).agg(*aggs)


def file_summary(tx: DataFrame | None = None, buckets: DataFrame | None = None) -> DataFrame:
    """Per export file (rolled up from :func:`bucket_summary`):

    regular_count, other_fee_count, fee sums K..O and J/P sums of regular rows,
    other_fee_total, last non-blank date / payout no. / payout date of regular
    rows (W3), and the date of the first other-fee row (W4)."""
    b = buckets if buckets is not None else bucket_summary(tx)
    aggs = [F.sum("regular_count").alias("regular_count"), F.sum("other_fee_count").alias("other_fee_count")]
    aggs += [F.sum(f"{kind}_{x}").alias(f"{kind}_{x}") for x in FEE_LETTERS + ["J", "P", "other_fee"] for kind in ("sum", "wide")]
    aggs += [F.max_by(f"last_{c}", f"last_{c}_row").alias(f"last_{c}") for c in LAST_FIELDS]
    aggs.append(F.min_by("first_other", "first_other_row").alias("_first_other"))
    s = b.groupBy("file_id").agg(*aggs)
    return (s.withColumn("andere_datum", F.when(F.col("other_fee_count") > 0, F.col("_first_other.d"))
                         .otherwise(F.col("last_datum")))
            .drop("_first_other"))


def for_all_files(summary: DataFrame, files: DataFrame) -> DataFrame:
    """The summary with a row for every export of ``files`` (file_id): an export without a
    transaction has counts of 0, no dates and no sums (reported as 0)."""
    return (files.join(summary, "file_id", "left")
            .withColumn("regular_count", F.coalesce("regular_count", F.lit(0)))
            .withColumn("other_fee_count", F.coalesce("other_fee_count", F.lit(0))))


def _offsets(buckets: DataFrame, count_col: str) -> DataFrame:
    """Rows of ``count_col`` kind in earlier buckets of the same file."""
    before = Window.partitionBy("file_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return buckets.select("file_id", "bucket", F.coalesce(F.sum(count_col).over(before), F.lit(0)).alias("_off"))


def placed_transactions(tx: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``tx`` with ``_n``: the position of a row among the regular rows, or among the other fees, of its bucket.

    One bounded window numbers both kinds; transactions written with it are numbered by the offsets of the buckets
    alone (:func:`_numbered`), so they do not move again, whatever else moves them."""
    upto = Window.partitionBy("file_id", "bucket").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    other = F.count_if(F.col("is_other_fee")).over(upto)
    regular = F.count_if(~F.col("is_other_fee")).over(upto)
    return (tx.withColumn("bucket", _bucket(bucket_rows))
            .withColumn("_n", F.when(F.col("is_other_fee"), other).otherwise(regular)).drop("bucket"))


def _numbered(rows: DataFrame, offsets: DataFrame, first: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Position of each row among ``rows`` of its file, starting at ``first``:
    offset of its bucket + row_number inside the bucket (bounded window task, unless the rows bring it)."""
    placed = rows.withColumn("bucket", _bucket(bucket_rows))
    if "_n" not in rows.columns:
        within = Window.partitionBy("file_id", "bucket").orderBy("row_idx")
        # numbered before the join: its order by (file, bucket) serves the join too, so rows are sorted once
        placed = placed.withColumn("_n", F.row_number().over(within))
    return (placed.join(offsets, ["file_id", "bucket"])
            .withColumn("_n", F.col("_off") + F.col("_n") + F.lit(first - 1))
            .drop("bucket", "_off"))


def fee_line(datum_type, account: str = K.FEE_ACCOUNT) -> dict[str, Column]:
    """D26 values over the per-file summary: A last date, F 'Gebuehr', G fee
    account, H YYYYMM(A), K..O fee sums, J = K+..+O, I = J, P = 0, Q/R last payout."""
    j = _total(*FEE_LETTERS)
    v = {"A": F.col("last_datum"), "F": F.lit(K.FEE_LINE_LABEL), "G": F.lit(account),
         "H": cl.yyyymm(F.col("last_datum"), datum_type), "I": j, "J": j, "P": F.lit(0.0),
         "Q": F.col("last_auszahlungsnr"), "R": F.col("last_auszahlungsdatum")}
    v.update({x: _total(x) for x in FEE_LETTERS})
    return v


def other_fee_line(datum_type, account: str = K.FEE_ACCOUNT) -> dict[str, Column]:
    """D27 values: A first other-fee date, F 'Andere Gebuehr', I = J = P = other-fee total."""
    total = _total("other_fee")
    return {"A": F.col("andere_datum"), "F": F.lit(K.OTHER_FEE_LINE_LABEL), "G": F.lit(account),
            "H": cl.yyyymm(F.col("andere_datum"), datum_type), "I": total, "J": total, "P": total,
            "Q": F.col("last_auszahlungsnr"), "R": F.col("last_auszahlungsdatum")}


def totals_line() -> dict[str, Column]:
    """D28 values: J = sum J(data) + J(Gebuehr) + J(Andere); P likewise (Gebuehr P is 0)."""
    return {"J": _total("J", *FEE_LETTERS, "other_fee"), "P": _total("P", "other_fee")}


def fee_summary(summary: DataFrame, datum_type=None, account: str = K.FEE_ACCOUNT) -> DataFrame:
    """The 'Gebuehr' line per file."""
    v = fee_line(datum_type or summary.schema["last_datum"].dataType, account)
    return summary.select("file_id", *[v[x].alias(x) for x in "AFGHIJKLMNOPQR"])


def other_fee_summary(summary: DataFrame, datum_type=None, account: str = K.FEE_ACCOUNT) -> DataFrame:
    """The 'Andere Gebuehr' line per file (emitted even with no other fees)."""
    v = other_fee_line(datum_type or summary.schema["andere_datum"].dataType, account)
    return summary.select("file_id", *[v[x].alias(x) for x in "AFGHIJPQR"])


def report_totals(summary: DataFrame) -> DataFrame:
    v = totals_line()
    return summary.select("file_id", v["J"].alias("J"), v["P"].alias("P"))


def processing_summary(summary: DataFrame) -> DataFrame:
    """Regular count, other-fee count and other-fee total per file."""
    return summary.select("file_id", "regular_count", "other_fee_count",
                          _total("other_fee").alias("other_fee_total"))


# --- D29, A9 --------------------------------------------------------------------------

def preamble_metadata(preamble: DataFrame, header_rows: DataFrame | None = None) -> DataFrame:
    """Per file, seller and amount from the rows above the header
    (column A contains the marker, value in column B; the last matching row wins)."""
    p = preamble
    if header_rows is not None:
        p = p.join(header_rows, "file_id").filter(F.col("row_idx") < F.col("header_row"))
    a = F.col("c0").cast("string")
    seller = F.max_by(F.struct(F.col("c1").alias("v")), F.when(a.contains(K.SELLER_MARKER), F.col("row_idx")))
    amount = F.max_by(F.struct(F.col("c1").alias("v")), F.when(a.contains(K.AMOUNT_MARKER), F.col("row_idx")))
    return (p.groupBy("file_id").agg(seller.alias("_s"), amount.alias("_a"))
            .select("file_id", F.col("_s.v").alias("seller"), F.col("_a.v").alias("amount")))


def report_header(summary: DataFrame, preamble_meta: DataFrame) -> DataFrame:
    """Seller, transactions (regular + other-fee rows), amount per file."""
    return (summary.select("file_id", (F.col("regular_count") + F.col("other_fee_count")).alias("transactions"))
            .join(preamble_meta, "file_id", "left")
            .select("file_id", "seller", "transactions", "amount"))


def header_cells(header: DataFrame) -> DataFrame:
    """Rows 1-3 of the processed report per file: label in A, value in B
    (seller, number of transactions, amount)."""
    seller_l, count_l, amount_l = K.HEADER_LABELS

    def row(no: int, label: str, value: Column) -> Column:
        return F.struct(F.lit(no).cast("long").alias("row_no"), F.lit(label).alias("A"),
                        value.cast("string").alias("B"))

    return header.select("file_id", F.inline(F.array(row(1, seller_l, F.col("seller")),
                                                     row(2, count_l, F.col("transactions")),
                                                     row(3, amount_l, F.col("amount")))))


# --- W5, S2, S3, B26: report lines ----------------------------------------------------------

def _line_cols(section: str, row_no: Column, values: dict[str, Column], types: dict[str, str]) -> list[Column]:
    out = [F.col("file_id"), F.lit(section).alias("section"), row_no.cast("long").alias("row_no")]
    for letter in LETTERS + ["T", "U"]:
        v = values.get(letter)
        out.append((v if v is not None else F.lit(None)).cast(types[letter]).alias(letter))
    return out


def _types(tx: DataFrame) -> dict[str, str]:
    datum_t = dict(tx.dtypes)["datum"]
    t = {x: "string" for x in LETTERS}
    t["A"] = datum_t
    for x in list(MONEY) + ["T", "U"]:
        t[x] = "double"
    return t


def data_lines(tx: DataFrame, buckets: DataFrame | None = None) -> DataFrame:
    """Regular rows numbered from 5 in file order (W5), laid out A..R, T = J, U = J - T."""
    b = buckets if buckets is not None else bucket_summary(tx)
    reg = _numbered(tx.filter(~F.col("is_other_fee")), _offsets(b, "regular_count"), K.REPORT_FIRST_DATA_ROW)
    vals = {"A": F.col("datum"), "B": F.col("typ"), "C": F.col("bestellnummer"), "D": F.col("alte_bestellnummer"),
            "E": F.col("nutzername"), "F": F.col("name"),
            "G": F.col("kdnr") if "kdnr" in tx.columns else None,
            "H": F.col("rgnr") if "rgnr" in tx.columns else None,
            "Q": F.col("auszahlungsnr"), "R": F.col("auszahlungsdatum"),
            "T": F.col("zwischensumme"), "U": F.col("zwischensumme") - F.col("zwischensumme")}
    vals.update({x: F.col(f) for x, f in MONEY.items()})
    return reg.select(*_line_cols("data", F.col("_n"), vals, _types(tx)))


def summary_lines(summary: DataFrame, datum_type, types: dict[str, str],
                  account: str = K.FEE_ACCOUNT) -> DataFrame:
    """The 'Gebuehr', 'Andere Gebuehr' and totals lines of every file, from one
    pass over the per-file summary (three structs, inlined; no joins)."""
    base = F.col("regular_count") + F.lit(K.REPORT_FIRST_DATA_ROW)

    def struct(section: str, row_no: Column, vals: dict[str, Column]) -> Column:
        fields = [F.lit(section).alias("section"), row_no.cast("long").alias("row_no")]
        for letter in LETTERS + ["T", "U"]:
            v = vals.get(letter)
            fields.append((v if v is not None else F.lit(None)).cast(types[letter]).alias(letter))
        return F.struct(*fields)

    lines = F.array(struct("gebuehr", base, fee_line(datum_type, account)),
                    struct("andere_gebuehr", base + 1, other_fee_line(datum_type, account)),
                    struct("totals", base + 2, totals_line()))
    return summary.select("file_id", F.inline(lines))


def report_lines(tx: DataFrame, summary: DataFrame | None = None,
                 buckets: DataFrame | None = None, account: str = K.FEE_ACCOUNT) -> DataFrame:
    """Data rows ++ 'Gebuehr' ++ 'Andere Gebuehr' ++ totals, per file (UNION ALL).

    The transactions are read for the per-bucket aggregate (which gives both the file summary
    and the row-number offsets) and for the rows. Without ``buckets`` they are written first, so
    that what they are made of runs once, and so is the aggregate, a row a bucket. They are written with their
    place in the bucket: no shuffle for numbers stands beside that of a sink."""
    if buckets is None:
        tx = landed(placed_transactions(tx), "transactions")
        buckets = landed(bucket_summary(tx), "buckets")
    b = buckets
    summary = summary if summary is not None else file_summary(buckets=b)
    return data_lines(tx, b).unionByName(summary_lines(summary, tx.schema["datum"].dataType, _types(tx), account))


def other_fee_detail(tx: DataFrame, buckets: DataFrame | None = None, account: str = K.FEE_ACCOUNT) -> DataFrame:
    """S3 + D31: other-fee rows numbered from 1, laid out A..R (G = fee account,
    H = YYYYMM, I = J = P = amount, K..O = 0), then the sum line at row n + 2."""
    b = buckets if buckets is not None else _other_fee_buckets(tx)
    dt = tx.schema["datum"].dataType
    oth = _numbered(tx.filter(F.col("is_other_fee")), _offsets(b, "other_fee_count"), 1)
    amt = F.col("betrag_abzgl")
    vals = {"A": F.col("datum"), "B": F.col("typ"), "C": F.col("bestellnummer"), "D": F.col("alte_bestellnummer"),
            "E": F.col("nutzername"), "F": F.col("name"), "G": F.lit(account), "H": cl.yyyymm(F.col("datum"), dt),
            "I": amt, "J": amt, "P": amt, "Q": F.col("auszahlungsnr"), "R": F.col("auszahlungsdatum")}
    vals.update({x: F.lit(0.0) for x in FEE_LETTERS})
    types = _types(tx)
    rows = oth.select(*_line_cols("detail", F.col("_n"), vals, types))
    return rows.unionByName(other_fee_detail_totals(tx, _other_fee_files(b)))


def _other_fee_buckets(tx: DataFrame) -> DataFrame:
    """Counts and totals of other-fee rows per (file, bucket): all the detail sheet
    needs when no shared :func:`bucket_summary` is at hand."""
    return (tx.filter(F.col("is_other_fee")).groupBy("file_id", _bucket().alias("bucket"))
            .agg(F.count(F.lit(1)).alias("other_fee_count"), *_sums(F.col("betrag_abzgl"), "other_fee")))


def _other_fee_files(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy("file_id").agg(*[F.sum(c).alias(c) for c in ("other_fee_count", "sum_other_fee", "wide_other_fee")])


def other_fee_detail_totals(tx: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Sum line of the detail sheet (row n + 2), for files with other-fee rows."""
    types = _types(tx)
    if summary is None:
        summary = _other_fee_files(_other_fee_buckets(tx))
    s = summary.filter(F.col("other_fee_count") > 0)
    total = _total("other_fee")
    return s.select(*_line_cols("detail_total", F.col("other_fee_count") + 2, {"J": total, "P": total}, types))


def output_layout(lines: DataFrame) -> DataFrame:
    """Columns A..R under their report header texts (T, U kept as verification)."""
    return lines.select("file_id", "section", "row_no",
                        *[F.col(x).alias(h) for x, h in K.REPORT_HEADERS], "T", "U")


def report_sheet(header_cells_df: DataFrame, lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The processed report as one sheet per file, all cells as text:
    rows 1-3 header cells, row 4 the A..R header texts (T, U blank), rows 5..
    the report lines. Ready for a row-ordered sink. ``files`` (one row per file_id, such as the
    file summary) saves looking for the files in the lines."""
    cols = LETTERS + ["T", "U"]
    head = header_cells_df.select("file_id", "row_no", "A", "B",
                                  *[F.lit(None).cast("string").alias(c) for c in cols if c not in ("A", "B")])
    titles = dict(K.REPORT_HEADERS)
    files = files.select("file_id") if files is not None else lines.select("file_id").distinct()
    row4 = files.select("file_id", F.lit(4).cast("long").alias("row_no"),
                        *[F.lit(titles.get(c)).cast("string").alias(c) for c in cols])
    body = lines.select("file_id", "row_no", *[F.col(c).cast("string").alias(c) for c in cols])
    return head.select("file_id", "row_no", *cols).unionByName(row4).unionByName(body)
