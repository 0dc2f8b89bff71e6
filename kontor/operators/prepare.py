"""Preparation of ledger documents.

Every step applies only to the columns that are present, so documents with
any subset of the known columns can be prepared and reported on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.functions import calendar as cal
from kontor.functions import cleaning as cl
from kontor.functions import constants as K

DATE_COLUMNS = ["BELEGDAT", "LIEFERDAT"]
MEASURES = ["NETTO", "BRUTTO", "ERLOES"]
DIMENSIONS = ["ORIGIN", "ISOA2_LAND"]
DERIVED = ["Date", "Month", "Week", "DayOfWeek", "Hour"]


def prepare(docs: DataFrame) -> DataFrame:
    """Typed documents plus the derived calendar columns.

    * BELEGDAT/LIEFERDAT -> TIMESTAMP (text parsed per value; bad -> NULL)
    * NETTO/BRUTTO/ERLOES -> number (text parsed; bad -> NULL; NaN -> NULL;
      DECIMAL input stays DECIMAL)
    * ORIGIN/ISOA2_LAND -> text, NULL -> 'Unknown', whitespace stripped
    * Date, Month 'YYYY-MM', Week 'Mon/Sun', DayOfWeek, Hour from BELEGDAT
    """
    types = dict((f.name, f.dataType) for f in docs.schema.fields)
    cols = []
    for name in docs.columns:
        c = F.col(f"`{name}`")
        if name in DATE_COLUMNS:
            c = cl.parse_timestamp(c, types[name])
        elif name in MEASURES:
            c = cl.parse_number(c, types[name])
        elif name in DIMENSIONS:
            c = cl.strip_ws(F.coalesce(c.cast("string"), F.lit(K.UNKNOWN)))
        cols.append(c.alias(name))
    out = docs.select(*cols)
    if "BELEGDAT" in out.columns:
        ts = F.col("BELEGDAT")
        out = out.select("*",
                         cal.date_part(ts).alias("Date"),
                         cal.month_label(ts).alias("Month"),
                         cal.week_label(ts).alias("Week"),
                         cal.day_name(ts).alias("DayOfWeek"),
                         cal.hour_of_day(ts).alias("Hour"))
    return out


class MissingColumn(ValueError):
    """A report needs a column that the documents do not have."""


def require(df: DataFrame, *columns: str, report: str = "") -> None:
    """Raise :class:`MissingColumn` naming the first missing column of a report."""
    for c in columns:
        if c not in df.columns:
            raise MissingColumn(f"{report or 'report'} needs column {c!r}")
