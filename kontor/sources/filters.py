"""Source parameters: origin list, date window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.functions import cleaning as cl
from kontor.functions import constants as K
from kontor.sources.sinks import PERIOD


def build_origins(use_amazon: bool, use_ebay: bool, custom_origins: str = "") -> list[str]:
    """Platform flags plus a comma list (trimmed, empties dropped); none -> ValueError."""
    origins = ([K.AMAZON] if use_amazon else []) + ([K.EBAY] if use_ebay else [])
    origins += [o.strip() for o in (custom_origins or "").split(",") if o.strip()]
    if not origins:
        raise ValueError("no platform chosen")
    return origins


def filter_origins(docs: DataFrame, origins: list[str]) -> DataFrame:
    """Keep documents of the given platforms (values are passed as literals, not spliced)."""
    if not origins:
        raise ValueError("empty origin list")
    return docs.filter(F.col("ORIGIN").isin(origins))


def filter_date_range(docs: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """DD.MM.YYYY bounds, inclusive, on the document day."""
    for d in (date_from, date_to):
        reason = _validity(d)
        if reason:
            raise ValueError(f"{d!r}: {reason}")
    # a half-open range on the column itself (not on to_date(column)), so the
    # bounds fold to literals and reach the parquet scan as pushed filters
    lo = F.to_timestamp(F.lit(date_from), "dd.MM.yyyy")
    hi = F.to_timestamp(F.lit(date_to), "dd.MM.yyyy") + F.expr("INTERVAL 1 DAY")
    c = F.col("BELEGDAT")
    dtype = docs.schema["BELEGDAT"].dataType
    if not isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        c = cl.parse_timestamp(c, dtype)          # text from a payload: parse per value first
    return docs.filter((c >= lo) & (c < hi))


def _validity(s: str | None) -> str | None:
    import re
    from datetime import datetime
    if not s:
        return K.DATE_EMPTY
    if not re.match(K.FILTER_DATE_PATTERN, s):
        return K.DATE_BAD_FORMAT
    try:
        datetime.strptime(s, "%d.%m.%Y")
    except ValueError:
        return K.DATE_INVALID
    return None


def date_validity(df: DataFrame, col: str) -> DataFrame:
    """B12 as a column over data: NULL when ``col`` is a valid DD.MM.YYYY date, else the reason."""
    return df.withColumn(f"{col}_validity", cl.date_validity(F.col(col)))


def documents_window(spark: SparkSession, path: str, date_from: str, date_to: str,
                     origins: list[str]) -> DataFrame:
    """A4: landed documents of a date window and platform list. Both filters reach the parquet
    scan; a landing by document month is read for the months of the window only."""
    docs = spark.read.parquet(path)
    found = filter_origins(filter_date_range(docs, date_from, date_to), origins)
    if PERIOD in docs.columns:      # the bounds are valid dates by now
        first, last = (int(d[6:10]) * 100 + int(d[3:5]) for d in (date_from, date_to))
        found = found.filter(F.col(PERIOD).between(first, last)).drop(PERIOD)
    return found
