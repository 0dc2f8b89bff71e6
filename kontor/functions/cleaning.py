"""Value cleaning: timestamps, numbers, amounts, YYYYMM, date validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.functions import constants as K

# a plain decimal number, optional sign and exponent -- what a float parser
# accepts; Spark's cast alone would also take '1d', '1f' or 'Infinity'
_NUMBER_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


# the same to the very end: '$' lets a line break follow
_PLAIN_RE = _NUMBER_RE.removesuffix("$") + r"\z"

# every character Python's str.strip() removes (all of them lie below U+3001)
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def strip_ws(c: Column) -> Column:
    """Strip leading/trailing whitespace (tabs and newlines too, unlike trim)."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    """NULL or empty string (a whitespace-only value is not blank)."""
    return c.isNull() | (c == F.lit(""))


def parse_number(c: Column, dtype: T.DataType | None = None) -> Column:
    """Text or number -> DOUBLE; unparsable text -> NULL; NaN -> NULL.

    Numeric input keeps its type (DECIMAL stays exact)."""
    if dtype is None or isinstance(dtype, T.StringType):
        s = strip_ws(c.cast("string"))
        return F.when(s.rlike(_NUMBER_RE), s.try_cast("double"))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c.cast("double"))
    if isinstance(dtype, T.DecimalType):
        return c
    return c.cast("double")


def parse_timestamp(c: Column, dtype: T.DataType | None = None) -> Column:
    """Text or temporal -> TIMESTAMP (session time zone, UTC); bad text -> NULL.

    Each value is parsed on its own: ISO first, then DD.MM.YYYY."""
    if isinstance(dtype, (T.TimestampType,)):
        return c
    if isinstance(dtype, (T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    s = strip_ws(c.cast("string"))
    return F.coalesce(s.try_cast("timestamp"), F.try_to_timestamp(s, F.lit("dd.MM.yyyy")))


def clean_amount(c: Column) -> Column:
    """Export amount cell -> DOUBLE: '--', '—', NULL or unparsable -> 0.

    Surrounding whitespace is ignored and '_' between digits is allowed. A cell that is a plain
    number, as nearly all are, is cast as it stands; only the others are stripped."""
    raw = c.cast("string")
    s = strip_ws(raw)
    s = F.when(s.contains("_"), F.regexp_replace(s, r"(?<=[0-9])_(?=[0-9])", "")).otherwise(s)
    parsed = F.when(s.rlike(_NUMBER_RE), s.try_cast("double"))
    return (F.when(raw.isNull() | raw.isin(*K.EMPTY_AMOUNTS), F.lit(0.0))
            .when(raw.rlike(_PLAIN_RE), F.coalesce(raw.try_cast("double"), F.lit(0.0)))
            .otherwise(F.coalesce(parsed, F.lit(0.0))))


def to_money(c: Column) -> Column:
    """Report money as DOUBLE, rounded to cents."""
    return F.round(c.cast("double"), 2)


def yyyymm(c: Column, dtype: T.DataType | None = None) -> Column:
    """Date/timestamp -> 'YYYYMM'; text with an ISO date in its first ten
    characters -> 'YYYYMM'; anything else -> ''."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(F.date_format(c, "yyyyMM"), F.lit(""))
    s = F.substring(c.cast("string"), 1, 10)
    # 'M'/'d' take one or two digits, like a %Y-%m-%d parse of the first ten characters
    return F.coalesce(F.date_format(F.try_to_timestamp(s, F.lit("yyyy-M-d")), "yyyyMM"), F.lit(""))


def date_validity(c: Column) -> Column:
    """DD.MM.YYYY check of a filter date: NULL when valid, else the reason."""
    return (F.when(is_blank(c), F.lit(K.DATE_EMPTY))
            .when(~c.rlike(K.FILTER_DATE_PATTERN), F.lit(K.DATE_BAD_FORMAT))
            .when(F.try_to_timestamp(c, F.lit("dd.MM.yyyy")).isNull(), F.lit(K.DATE_INVALID)))
