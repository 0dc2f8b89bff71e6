"""Rendezvous hashing of record keys over weighted shards, in DataFrame operations only.

Every shard draws a number for a key: exponential with the shard's weight as its rate,
from a hash of (key, shard). The smallest draw takes the key, so a shard gets keys in
proportion to its weight, and the draws of the other shards do not change when one is
added or taken away: with one more shard, keys move into the new one alone; without one,
only its own keys move. No table of keys or ranges is kept anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.llm.frames import landed
from kontor.operators.ordinal import ordinal

SHARDS = 24
#: bytes of a record besides its text
RECORD = 8


def shard_of(key: Sequence[Column], weights: Sequence[float]) -> Column:
    """The shard (0, 1, ..) that takes a key. A NULL is a key like others; of equal draws,
    the first shard's counts; a shard of weight 0 takes nothing."""
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must be 0 or more, and one of them above 0")
    draws = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            # 53 bits of the hash as a number strictly between 0 and 1
            u = (F.shiftrightunsigned(F.xxhash64(F.lit(shard), *key), 11) + F.lit(0.5)) * F.lit(2.0 ** -53)
            draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("draw"), F.lit(shard).alias("shard")))
    first = F.least(*draws) if len(draws) > 1 else draws[0]
    return first["shard"]


def assign(df: DataFrame, key: Sequence[str], weights: Sequence[float], out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row in ``out``; a column of that name is replaced.

    Rows with one key share a shard, whatever their other columns hold; an empty table
    gives an empty table."""
    return df.withColumn(out, shard_of([F.col(f"`{k}`") for k in key], weights))


def place(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, new_weight: float = 1.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    ``law`` is 'key': doc_id and the shards alone decide. ``size``: UTF-8 bytes of the text
    and RECORD; a NULL text has none and the checksum of no bytes. ``grown_shard`` is the shard
    with one more of ``new_weight``. ``slot`` numbers the rows of a shard from 0 without gaps, in
    the order of the table: rows are counted by shard and input split, and a row's place is that
    within its split after the counts before it, so no task holds a shard. Repeated rows and
    rows with a NULL id get a slot each; other columns are ignored; an empty table gives an
    empty table."""
    text = F.coalesce(docs["text"], F.lit(""))
    key = [docs["doc_id"]]
    rows = landed(docs.select(
        "doc_id", (F.octet_length(text) + F.lit(RECORD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(key, weights).alias("shard"), shard_of(key, [*weights, new_weight]).alias("grown_shard"),
        F.monotonically_increasing_id().alias("at")))
    # the upper bits of ``at`` are the input split, which the written table has fixed
    numbered = ordinal(rows, ["shard"], [F.col("at")], F.shiftright("at", 33), out="slot", start=0)
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
