"""Marketplace exports as cell grids.

An export is a ';'-separated text file (or a directory of part files written
in order) whose rows are spreadsheet rows: a preamble, a header row, then one
transaction per row. Cells follow the usual CSV quoting: a cell in double quotes may
hold separators, doubled quotes and line breaks. There is no limit on columns.

Row numbers are computed without putting a file into one task: text is read
line-split (splittable), every line keeps ``monotonically_increasing_id`` from
the scan, and the position of a line inside its export is

    (lines of the export's earlier splits) + (its position inside its split)

where the first term is a prefix sum over a small per-split count table. A line with an
odd number of quotes opens or closes a cell that spans lines; in exports that have such
lines, lines are put together to records by the running parity, per split, with the
parity that the earlier splits left. An export whose quotes do not close is rejected.

The header is found per export (A7), header names are mapped to column positions
per export (A8) -- exports in one directory may order columns differently --
and the preamble gives seller and amount (A9). All of that looks at the first rows
only; the transactions are parsed once, in the scan that delivers them.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kontor.functions import cleaning as cl
from kontor.functions import constants as K
from kontor.session import landed, shuffles_dropped

CSV = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def cells_schema(n: int) -> str:
    return ", ".join(f"c{i} STRING" for i in range(n))


def _count(c: Column, what: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))


def parse_cells(line: Column, sep: str, n_columns: int) -> Column:
    parsed = F.from_csv(line, cells_schema(n_columns), CSV | {"sep": sep})
    return F.array(*[parsed.getField(f"c{i}") for i in range(n_columns)])


class ExportText(NamedTuple):
    """The text of a folder of exports, and what one light pass over it tells."""
    spark: SparkSession
    path: str
    sep: str
    export_column: str | None
    n_columns: int              # cells of the widest record
    broken: bool                # some cell spans lines
    table: DataFrame            # one row per input split: number, lines, first row id, lines with an odd number of quotes, widest line
    joined: DataFrame | None = None     # (file_id, row_idx, line): records of the exports in which a cell spans lines

    def lines(self, cells: bool = False) -> DataFrame:
        """(file_id, _file, _block, _mid, line or cells) of every line.

        Catalyst does not push filters through the projection that takes the row id, so a
        line is parsed once however many cells later filters look at."""
        file_id = (F.col(self.export_column).cast("string") if self.export_column else F.col("_metadata.file_path"))
        value = parse_cells(F.col("value"), self.sep, self.n_columns).alias("cells") if cells else F.col("value").alias("line")
        return self.spark.read.text(self.path).select(
            file_id.alias("file_id"), F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_mid"), value)

    def splits(self) -> DataFrame:
        """One row per input split: first row id, lines before it in its export, parity of the
        quotes before it, and of the whole export."""
        before = Window.partitionBy("file_id").orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy("file_id")
        return self.table.select("file_id", "_file", "_block", "_first",
                                 F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
                                 (F.coalesce(F.sum("_odd").over(before), F.lit(0)) % 2).alias("_open"),
                                 (F.sum("_odd").over(whole) > 0).alias("_broken"), (F.sum("_odd").over(whole) % 2).alias("_unclosed"))

    def records(self, cells: bool = False, first: int | None = None) -> DataFrame:
        """(file_id, row_idx 1-based, line or cells) of every record, or of the ``first`` ones of each export
        at least: other splits than those they start in are dropped before their lines are looked at."""
        splits = self.splits() if self.broken else self.splits().drop("_open", "_broken", "_unclosed")
        if first is not None and not self.broken:
            splits = splits.filter(F.col("_offset") < first)
        what = "cells" if cells else "line"
        lines = self.lines(cells).join(splits, ["file_id", "_file", "_block"])
        if self.broken:
            lines = lines.filter(~F.col("_broken"))
        plain = lines.select("file_id", (F.col("_offset") + (F.col("_mid") - F.col("_first")) + F.lit(1)).alias("row_idx"), what)
        if not self.broken:
            return plain
        joined = self.joined
        if cells:
            joined = joined.select("file_id", "row_idx", parse_cells(F.col("line"), self.sep, self.n_columns).alias("cells"))
        return plain.unionByName(joined)

    def _joined_lines(self) -> DataFrame:
        """Records of the exports in which a cell spans lines; written once.

        Lines move once, to window tasks that hold one split each, and under the number of the split instead of its
        name. There they become pieces of records; only the first and last piece of a split, which may belong to the
        record of another split, move again."""
        splits = self.splits().join(self.table.select("file_id", "_file", "_block", "_split"), ["file_id", "_file", "_block"])
        splits = splits.filter("_broken and _unclosed = 0")
        lines = (self.lines().join(splits.select("file_id", "_file", "_block", "_split", "_open"), ["file_id", "_file", "_block"])
                 .select("_split", "_open", "_mid", "line"))
        upto = Window.partitionBy("_split").orderBy("_mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        odd = _count(F.col("line"), '"') % 2
        pieces = (lines.withColumn("_starts", ((F.col("_open") + F.sum(odd).over(upto) - odd) % 2 == 0).cast("long"))
                  .withColumn("_record", F.sum("_starts").over(upto))
                  .groupBy("_split", "_record")
                  .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_mid", "line"))), lambda x: x["line"]), "\n").alias("line")))
        pieces = landed(pieces, "pieces")
        before = Window.partitionBy("file_id").orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
        # a split whose first line continues a record has a piece 0: its records end at the last number it started
        starts = landed(pieces.groupBy("_split").agg(F.max("_record").alias("_last"))
                        .join(splits.select("file_id", "_file", "_block", "_split"), "_split")
                        .select("_split", "file_id", "_file", "_block", "_last", F.coalesce(F.sum("_last").over(before), F.lit(0)).alias("_earlier")),
                        "starts")
        pieces = pieces.join(starts, "_split").withColumn("row_idx", F.col("_earlier") + F.col("_record"))
        edge = (F.col("_record") == 0) | (F.col("_record") == F.col("_last"))
        edges = (pieces.filter(edge).groupBy("file_id", "row_idx")
                 .agg(F.array_sort(F.collect_list(F.struct("_file", "_block", "line"))).alias("_l"))
                 .select("file_id", "row_idx", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("line")))
        return pieces.filter(~edge).select("file_id", "row_idx", "line").unionByName(landed(edges, "edges"))

    def unclosed(self) -> DataFrame:
        """(file_id): exports whose quotes do not close."""
        return self.splits().filter("_unclosed = 1").select("file_id").distinct()


def export_text(spark: SparkSession, path: str, sep: str = ";", export_column: str | None = None) -> ExportText:
    """Look at the text once for lines, quotes and widest line of each input split (a job that counts
    characters; nothing is parsed). The table of splits is written, so nothing reads the text for it again."""
    text = ExportText(spark, path, sep, export_column, 1, False, None)
    v = F.col("line")
    table = text.lines().groupBy("file_id", "_file", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"), F.sum(_count(v, '"') % 2).alias("_odd"),
        F.max(_count(v, sep) + 1).alias("_wide"))
    table = landed(table.withColumn("_split", F.monotonically_increasing_id()), "splits")
    row = table.agg(F.max("_wide").alias("n"), F.max("_odd").alias("odd")).first()
    text = text._replace(n_columns=row["n"] or 1, broken=bool(row["odd"]), table=table)
    if text.broken:         # a record may be wider than any of its lines
        text = text._replace(joined=text._joined_lines())
        widest = text.joined.agg(F.max(_count(F.col("line"), sep) + 1)).first()[0]
        text = text._replace(n_columns=max(text.n_columns, widest or 1))
    return text


def read_export_grid(spark: SparkSession, path: str, sep: str = ";", export_column: str | None = None) -> DataFrame:
    """(file_id, row_idx 1-based, cells ARRAY<STRING>) for every record.

    ``export_column``: a partition column naming the export (a directory of
    part files per export); default: each file is one export."""
    return export_text(spark, path, sep, export_column).records(cells=True)


def cell(i: int) -> Column:
    """1-based cell of the grid row."""
    return F.col("cells")[i - 1]


def discover_headers(grid: DataFrame) -> DataFrame:
    """First row (rows 1..19) with the header marker in columns 1..9 -> (file_id, header_row).

    The table is written (a row an export): what joins it knows its size and does not move the grid."""
    # plain OR over the searched cells (a lambda would run interpreted and
    # re-parse the line for every cell once Catalyst inlines ``cells``)
    hit = reduce(lambda a, b: a | b, [F.coalesce(cell(i).contains(K.HEADER_MARKER), F.lit(False))
                                      for i in range(1, K.HEADER_SEARCH_COLS + 1)])
    return landed(grid.filter((F.col("row_idx") <= K.HEADER_SEARCH_ROWS) & hit)
                  .groupBy("file_id").agg(F.min("row_idx").alias("header_row")), "headers")


def fixed_headers(grid: DataFrame, row: int = K.FIXED_HEADER_ROW) -> DataFrame:
    """A5: the fixed layout -- header in row 11 for every export."""
    return landed(grid.select("file_id").distinct().withColumn("header_row", F.lit(row).cast("long")), "headers")


def rejected_exports(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """(file_id, reason): exports without a discoverable header."""
    return (grid.select("file_id").distinct().join(headers, "file_id", "left_anti")
            .withColumn("reason", F.lit("no header row")))


def missing_headers(headers: DataFrame, mapping: DataFrame) -> DataFrame:
    """(file_id, header): amount columns that an export does not have; their amounts are 0."""
    wanted = F.array(*[F.lit(h) for h, field, fallback in K.EXPORT_FIELDS if field in K.AMOUNT_FIELDS and fallback is None])
    have = F.coalesce(F.map_keys("columns"), F.array().cast("array<string>"))
    return (headers.join(mapping, "file_id", "left")
            .select("file_id", F.explode(F.array_except(wanted, have)).alias("header")))


def header_mapping(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """Per export, header text (stripped) -> 1-based column; duplicates: last wins;
    blank headers skipped. One row per export holding a MAP<STRING, INT>."""
    h = (grid.join(headers, "file_id").filter(F.col("row_idx") == F.col("header_row"))
         .select("file_id", F.posexplode("cells").alias("pos", "name"))
         .filter(F.col("name").isNotNull() & (F.col("name") != ""))
         .select("file_id", cl.strip_ws(F.col("name")).alias("name"),
                 (F.col("pos") + 1).alias("col")))
    last = h.groupBy("file_id", "name").agg(F.max("col").alias("col"))
    return (last.groupBy("file_id")
            .agg(F.map_from_entries(F.collect_list(F.struct("name", "col"))).alias("columns")))


def field_positions(headers: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row per export: header row and the 1-based column of every field
    (first six fall back to columns 1..6; other missing fields -> NULL)."""
    cols = [F.col("file_id"), F.col("header_row")]
    for header, field, fallback in K.EXPORT_FIELDS:
        pos = F.element_at(F.col("columns"), F.lit(header))
        if fallback is not None:
            pos = F.coalesce(pos, F.lit(fallback))
        cols.append(pos.cast("int").alias(f"pos_{field}"))
    return landed(headers.join(mapping, "file_id", "left").select(*cols), "positions")


def normalize_grid(grid: DataFrame, headers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows below the header as raw export rows (input of the reconciliation).

    Field = cell at the column its header names in that export. The positions hold one
    row per export; whether they are small enough to be broadcast is left to the planner."""
    rows = (grid.join(field_positions(headers, mapping), "file_id")
            .filter(F.col("row_idx") > F.col("header_row")))
    out = [F.col("file_id"), F.col("row_idx")]
    for _, field, _ in K.EXPORT_FIELDS:
        pos = F.col(f"pos_{field}")
        value = F.when(pos.isNotNull(), F.try_element_at(F.col("cells"), pos))
        out.append(value.alias(f"{field}_raw" if field in K.AMOUNT_FIELDS else field))
    return rows.select(*out)


def preamble_rows(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows above the header as (file_id, row_idx, c0, c1) for :func:`preamble_metadata`."""
    return (grid.join(headers, "file_id").filter(F.col("row_idx") < F.col("header_row"))
            .select("file_id", "row_idx", cell(1).alias("c0"), cell(2).alias("c1")))


class Exports(NamedTuple):
    """What a folder of exports holds. ``first_rows`` (at most HEADER_SEARCH_ROWS records of each
    export) are read again where they are used; the other frames take them from a table written once."""
    rows: DataFrame             # raw export rows (input of the reconciliation)
    preamble: DataFrame
    headers: DataFrame          # (file_id, header_row)
    rejected: DataFrame         # (file_id, reason)
    missing: DataFrame          # (file_id, header)
    first_rows: DataFrame


def read_exports(spark: SparkSession, path: str, discover: bool = True, sep: str = ";",
                 export_column: str | None = None) -> Exports:
    """A5-A9 from three reads of the text: one that counts, one for the first rows and one that parses the transactions."""
    text = export_text(spark, path, sep, export_column)
    most = max(K.HEADER_SEARCH_ROWS, K.FIXED_HEADER_ROW)
    first = (text.records(first=most).filter(F.col("row_idx") <= most)
             .select("file_id", "row_idx", parse_cells(F.col("line"), sep, text.n_columns).alias("cells")))
    table = landed(first, "first_rows")
    headers = discover_headers(table) if discover else fixed_headers(table)
    mapping = header_mapping(table, headers)
    rejected = rejected_exports(table, headers)
    if text.broken:
        rejected = rejected.unionByName(text.unclosed().withColumn("reason", F.lit("a quoted cell is not closed")))
    return Exports(normalize_grid(text.records(cells=True), headers, mapping), preamble_rows(table, headers), headers,
                   rejected, missing_headers(headers, mapping), first)


# --- writing exports (used to land derived data as export files) -------------------------

def export_header(variant: int = 0) -> list[tuple[str, str]]:
    """(header text, raw field) in file column order.

    Variant 1 swaps the first two columns and reverses the amount columns, so
    exports in one folder differ in layout while the header marker stays in
    the searched columns."""
    fields = [(h, f"{f}_raw" if f in K.AMOUNT_FIELDS else f) for h, f, _ in K.EXPORT_FIELDS]
    if variant % 2 == 0:
        return fields
    head, amounts, tail = fields[:6], fields[6:15], fields[15:]
    return [head[1], head[0]] + head[2:] + amounts[::-1] + tail


def write_export_grid(rows: DataFrame, preamble: DataFrame | None, path: str, sep: str = ";",
                      header_row: int | None = None, rotate_odd: bool = True) -> None:
    """Land raw export rows as export files: ``path/file_id=<id>/part-*``.

    Each export gets its preamble lines, blank lines up to ``header_row`` (if
    given), the header line and the data lines in ``row_idx`` order. Odd
    exports use a rotated column order. Lines are range-partitioned on
    (file_id, part, line_no), so an export spans several ordered part files rather
    than one task."""
    def csv_line(values: list[Column]) -> Column:
        return F.to_csv(F.struct(*[v.cast("string").alias(f"f{i}") for i, v in enumerate(values)]), CSV | {"sep": sep})

    odd = F.col("file_id").cast("long") % 2 == 1
    rot = F.when(odd, F.lit(1)).otherwise(F.lit(0)) if rotate_odd else F.lit(0)
    plain, rotated = export_header(0), export_header(1)

    def by_rotation(pick) -> list[Column]:
        return [F.when(rot == 1, pick(r).cast("string")).otherwise(pick(p).cast("string"))
                for p, r in zip(plain, rotated)]

    # Lines are ordered by (export, part of it, place in the part), so that the data need not know how long the
    # preamble is: no join moves them, least of all by export.
    files = rows.select("file_id").distinct()
    parts = []

    def add(df: DataFrame, part: int, place: Column) -> None:
        parts.append(df.select("file_id", F.lit(part).alias("part"), place.cast("long").alias("line_no"), "line"))

    if preamble is not None:
        pre = preamble.select("file_id", "row_idx", csv_line([F.col("c0"), F.col("c1")]).alias("line"))
        add(pre, 0, F.col("row_idx"))
    if header_row:
        # blank lines between the preamble and a fixed header row (none if the preamble reaches it)
        n_pre = F.lit(0)
        padded = files
        if preamble is not None:
            padded = files.join(pre.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_pre")), "file_id", "left")
            n_pre = F.coalesce(F.col("n_pre"), F.lit(0))
        gap = F.when(n_pre + 1 <= F.lit(header_row) - 1, F.sequence(n_pre.cast("long") + 1, F.lit(header_row - 1).cast("long")))
        add(padded.select("file_id", F.explode(gap).alias("gap"), F.lit("").alias("line")), 1, F.col("gap"))
    add(files.select("file_id", csv_line(by_rotation(lambda hf: F.lit(hf[0]))).alias("line")), 2, F.lit(0))
    add(rows.select("file_id", "row_idx", csv_line(by_rotation(lambda hf: F.col(hf[1]))).alias("line")), 3, F.col("row_idx"))
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    order = ("file_id", "part", "line_no")
    with shuffles_dropped(rows.sparkSession):
        (lines.repartitionByRange(*order).sortWithinPartitions(*order)
         .select("line", "file_id").write.mode("overwrite").partitionBy("file_id").text(path))
