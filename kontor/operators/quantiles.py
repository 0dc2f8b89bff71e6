"""Exact quantiles (linear interpolation) by radix selection, for any number of rows.

``percentile`` buffers every value of the column in one aggregation buffer; for a global
quantile that is one task holding the whole column. Here the order statistics that all wanted
quantiles need are found together, digit by digit of the number as it is stored: sign and
exponent first, then BITS bits of the mantissa at a time. A job counts the rows by the next
digit among those that share the digits found so far with a wanted rank; its counts tell the digit
of each rank. A rank is done as soon as all rows with its digits have one value, so money
in cents takes about three jobs, and no column takes more than 1 + 52 / BITS.

There is no window, no sort and no bound on rows or ties: a value shared by a third of all rows is one
count, and the driver gets at most 2 ** BITS counts for each wanted rank."""

from __future__ import annotations

import math
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 13


def _digits(v: Column) -> tuple[Column, Column, Column]:
    """(sign, exponent code, mantissa in [0, 1)) of a double; larger numbers have a larger (sign * code,
    sign * mantissa). Each step is exact."""
    a = F.abs(v)
    inf = F.lit(float("inf"))
    guess = F.floor(F.log2(F.when((a > 0) & (a < inf), a).otherwise(F.lit(1.0)))).cast("int")
    # the logarithm may round up to the next whole number
    e = F.when(F.pow(F.lit(2.0), guess) > a, guess - 1).otherwise(guess)
    e = F.when(a == inf, F.lit(1024)).otherwise(e)
    normal = (a > 0) & (a < inf)
    # numbers so small that 2 ** -e is infinite are scaled in two steps
    mantissa = F.when(normal, a * F.pow(F.lit(2.0), F.floor(-e / 2)) * F.pow(F.lit(2.0), -e - F.floor(-e / 2)) - 1.0).otherwise(F.lit(0.0))
    code = F.when(a == 0, F.lit(0)).otherwise(e + 1100)
    return F.when(v < 0, F.lit(-1)).otherwise(F.lit(1)), code, mantissa


def _counts(digits: DataFrame, level: int, bits: int, wanted: set[tuple[int, int]]) -> list:
    """(x, q, n, least, most) by the digits up to ``level``, among rows whose digits before are in ``wanted``."""
    def upto(k: int) -> Column:
        return (F.col("s") * F.floor(F.col("m") * F.lit(2.0 ** (bits * k)))).cast("long")

    if level:
        digits = digits.filter(reduce(lambda a, b: a | b, [(F.col("x") == x) & (upto(level - 1) == q) for x, q in sorted(wanted)]))
    return sorted(digits.groupBy("x", upto(level).alias("q"))
                  .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).collect())


def exact_quantiles(df: DataFrame, col: str, probs: list[float], bits: int = BITS) -> dict[float, float | None]:
    """{p: quantile} with linear interpolation between order statistics (the definition of
    ``percentile`` / ``quantile_cont``). NULL and NaN do not count; without values every quantile is None."""
    v = F.col("v")
    sign, code, mantissa = _digits(v)
    base = df.select(F.col(col).cast("double").alias("v")).filter(v.isNotNull() & ~F.isnan(v))
    # one column, read once a digit; lost blocks are computed again
    digits = base.select("v", sign.alias("s"), (sign * code).cast("int").alias("x"), mantissa.alias("m")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _select(digits, probs, bits)
    finally:
        digits.unpersist()


def _select(digits: DataFrame, probs: list[float], bits: int) -> dict[float, float | None]:
    rows = _counts(digits, 0, bits, set())
    n = sum(r["n"] for r in rows)
    if not n:
        return {p: None for p in probs}
    places = {p: p * (n - 1) for p in probs}
    # rank -> (its digits so far, rows below those digits)
    open_: dict[int, tuple[tuple[int, int] | None, int]] = {
        k: (None, 0) for at in places.values() for k in (math.floor(at), min(math.floor(at) + 1, n - 1))}
    value: dict[int, float] = {}
    level = 0
    while True:
        found = {}
        for k, (prefix, below) in open_.items():
            for r in rows:
                # the digits before are those of the wanted prefix: the last ones cut off, towards zero
                mine = prefix is None or (r["x"] == prefix[0] and _cut(r["q"], bits) == prefix[1])
                if not mine:
                    continue
                if k < below + r["n"]:
                    if r["least"] == r["most"]:
                        value[k] = r["least"]
                    else:
                        found[k] = ((r["x"], r["q"]), below)
                    break
                below += r["n"]
        open_ = found
        if not open_:
            break
        level += 1
        rows = _counts(digits, level, bits, {prefix for prefix, _ in open_.values()})
    out: dict[float, float | None] = {}
    for p, at in places.items():
        k = math.floor(at)
        lo, hi = value[k], value[min(k + 1, n - 1)]
        out[p] = lo if at == k else lo + (hi - lo) * (at - k)
    return out


def _cut(q: int, bits: int) -> int:
    return (abs(q) >> bits) * (1 if q >= 0 else -1)
