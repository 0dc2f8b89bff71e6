"""Exact dedup by progressive refinement, in DataFrame operations only.

Rows are grouped by normalised length, then by a hash of their first characters,
then by the SHA-256 of the whole normalised text. Each step looks only at rows whose
group of the step before has two members or more; whole texts are hashed for the
last survivors only. The survivors reach the last scan as a bitmap of fixed size, so
no text is shuffled: a false hit hashes one text too many and is sorted out by the
last grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.llm.frames import SPACES, has_bit, landed, native_bitmap, survivors

PREFIX = 256


def normalised(text: Column) -> Column:
    """The text without white space; NULL counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def groups(docs: DataFrame, prefix: int = PREFIX, carry: dict[str, Column] | None = None) -> DataFrame:
    """(row, doc_id, size, key, keep_row, keep_id, group_size, kept), one row per row, and
    the columns ``carry`` (expressions over ``docs``' text) that a caller wants besides.

    ``key`` is the SHA-256 of the normalised text, NULL where an earlier step has
    shown the text to be unique. Of equal texts the row with the most code points
    stays, then the smallest doc_id (NULL last), then the first row: of repeated rows
    exactly one. Empty and NULL texts are equal to each other. ``docs`` may have any
    other columns; an empty table gives an empty table."""
    spark = docs.sparkSession
    text = docs.select("doc_id", F.col("text")).withColumn("norm", normalised(F.col("text")))
    slim = text.select(F.length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, prefix)).alias("prefix"))
    by_prefix = landed(slim.groupBy("len", "prefix").agg(F.count("*").alias("n")))
    lengths = by_prefix.groupBy("len").agg(F.sum("n").alias("of_len")).filter("of_len > 1")
    alive = by_prefix.join(lengths, "len").filter("n > 1").select(F.xxhash64("len", "prefix").alias("k"))
    bits = landed(native_bitmap(alive, "k"))
    step = F.xxhash64(F.length("norm"), F.xxhash64(F.substring("norm", 1, prefix)))
    rows = landed(text.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.length(F.coalesce("text", F.lit(""))).alias("size"),
        F.when(has_bit(bits.scalar(), step), F.sha2(F.col("norm").cast("binary"), 256)).alias("key"),
        *(c.alias(name) for name, c in (carry or {}).items())))
    best = (rows.filter("key is not null").groupBy("key")
            .agg(F.count("*").alias("group_size"),
                 F.min(F.struct((-F.col("size")).alias("a"), F.col("doc_id").isNull().alias("b"),
                                F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"))).alias("best"))
            .select("key", "group_size", "best.keep_id", "best.keep_row"))
    same = rows.filter("key is not null").join(best, "key")
    alone = (rows.filter("key is null")
             .select("*", F.lit(1).cast("long").alias("group_size"), F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row")))
    return same.unionByName(alone).withColumn("kept", F.col("row") == F.col("keep_row"))


def dedup(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """(doc_id, keep_id, group_size, kept) for every row of ``docs``; see :func:`groups`."""
    return groups(docs, prefix).select("doc_id", "keep_id", "group_size", "kept")


def keep_first(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """``docs`` without the rows whose text a kept row has. All columns stay, whatever their names.

    Rows are told apart by 128 bits over (doc_id, text), so rows with one id and different
    texts each get their own decision; of wholly equal (id, text) rows one stays."""
    own = [F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.xxhash64(F.coalesce("text", F.lit("")), "doc_id", F.lit(1))]
    found = groups(docs, prefix, carry={"k0": own[0], "k1": own[1]}).filter("key is not null")
    decided = landed(found.groupBy("k0", "k1").agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
                     .filter("not stays or n > 1").drop("n"))
    return survivors(docs, own, decided)
