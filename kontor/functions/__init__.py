"""Column expressions: cleaning, calendar labels, bins, lookups.

Everything here returns a ``pyspark.sql.Column`` built from built-in functions,
so it stays inside whole-stage codegen; there is no Python UDF in the library."""

from kontor.functions.cleaning import (  # noqa: F401
    clean_amount, date_validity, is_blank, parse_number, parse_timestamp,
    strip_ws, to_money, yyyymm,
)
from kontor.functions.calendar import (  # noqa: F401
    date_part, day_name, hour_of_day, month_label, week_label, weekday_index,
)
from kontor.functions.labels import (  # noqa: F401
    country_name, customer_category, document_type_name, margin_bucket,
    margin_bucket_order,
)
from kontor.functions.buckets import edge_table, value_bins, with_value_buckets  # noqa: F401
