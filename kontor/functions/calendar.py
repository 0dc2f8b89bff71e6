"""Calendar labels derived from the document timestamp."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_part(ts: Column) -> Column:
    return F.to_date(ts)


def month_label(ts: Column) -> Column:
    """'YYYY-MM'."""
    return F.date_format(ts, "yyyy-MM")


def week_label(ts: Column) -> Column:
    """Monday-to-Sunday week as 'YYYY-MM-DD/YYYY-MM-DD'."""
    monday = F.to_date(F.date_trunc("week", ts))
    return F.concat(F.date_format(monday, "yyyy-MM-dd"), F.lit("/"),
                    F.date_format(F.date_add(monday, 6), "yyyy-MM-dd"))


def day_name(ts: Column) -> Column:
    """English weekday name."""
    return F.date_format(ts, "EEEE")


def weekday_index(ts: Column) -> Column:
    """0 = Monday .. 6 = Sunday (calendar order for sorting)."""
    return F.weekday(ts)


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts).cast("int")
