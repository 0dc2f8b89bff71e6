"""Lookups and categorical labels as built-in expressions (no UDF)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from kontor.functions import constants as K


def _map_literal(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def country_name(code: Column) -> Column:
    """ISO-2 -> English name for the known codes; other codes pass through."""
    return F.coalesce(F.element_at(_map_literal(K.COUNTRY_NAMES), code), code)


def document_type_name(code: Column) -> Column:
    return F.coalesce(F.element_at(_map_literal(K.DOCUMENT_TYPE_NAMES), code), code)


def customer_category(n_orders: Column) -> Column:
    one, occasional, regular, loyal = K.CUSTOMER_CATEGORIES
    return (F.when(n_orders == 1, one).when(n_orders <= 3, occasional)
            .when(n_orders <= 10, regular).otherwise(loyal))


def margin_bucket(margin: Column) -> Column:
    """Right-closed margin bins; NULL margin -> no bin (NULL)."""
    expr = None
    for edge, label in zip(K.MARGIN_EDGES, K.MARGIN_LABELS):
        cond = margin <= F.lit(edge)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.when(margin.isNotNull(), K.MARGIN_LABELS[-1])


def margin_bucket_order(label: Column) -> Column:
    """Position of a margin label in bin order."""
    return F.array_position(F.array(*[F.lit(x) for x in K.MARGIN_LABELS]), label).cast("int")
