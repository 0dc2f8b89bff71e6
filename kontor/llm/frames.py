"""Spark helpers shared by the operators: tables in the shared folder, row keys,
folds, bounded survivor bitmaps and connected components."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.session import checkpoint_dir

#: characters the contracts call white space, as they are
SPACES = " \t\n\x0b\f\r"


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of few rows: rows here are whole documents."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def landed(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder of the cluster, read it back.

    A lost executor loses nothing, and a plan that uses the table several times
    computes it once."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/kontor-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(id_column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a NULL id is in no fold (-1)."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % n, F.lit(-1)).cast("int")


def id_and_text(docs: DataFrame, *extra: Column) -> DataFrame:
    """doc_id, text (NULL counts as empty) and what is asked for besides."""
    return docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"), *extra)


# --- survivor bitmaps: fixed-size filters, whatever the size of the key set -------------

BITMAP_BITS = 1 << 24


def bitmap(keys: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """Bit set over the low bits of 64-bit keys: ``bits / 8`` bytes, no more.

    The executors OR the bits together; the driver gets at most ``bits / 64``
    numbers. A set bit may be a false hit, so whoever uses the bitmap still
    groups or joins on the key itself; a clear bit is proof."""
    low = F.col(column).bitwiseAND(F.lit(bits - 1))
    got = (keys.select(F.shiftright(low, 6).cast("int").alias("w"),
                       F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b"))
           .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
    out = np.zeros(bits // 64, np.uint64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = keys & np.uint64(len(bits) * 64 - 1)
    return (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) != 0


def native_bitmap(keys: DataFrame, column: str, bits: int = 1 << 22) -> DataFrame:
    """The same as a one-row frame (array of longs), for plans without Python."""
    low = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = (keys.select(F.shiftright(low, 6).cast("int").alias("w"),
                         F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")))
    return _dense(words, bits)


def _dense(words: DataFrame, bits: int) -> DataFrame:
    spark = words.sparkSession
    slots = spark.range(bits // 64).select(F.col("id").cast("int").alias("w"))
    full = slots.join(words, "w", "left").select("w", F.coalesce("b", F.lit(0)).cast("long").alias("b"))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("bits"))


def has_bit(array: Column, key: Column, bits: int = 1 << 22) -> Column:
    low = key.bitwiseAND(F.lit(bits - 1))
    word = F.get(array, F.shiftright(low, 6).cast("int"))
    return F.call_function("bit_get", word, low.bitwiseAND(F.lit(63)).cast("int")) == 1


def survivors(docs: DataFrame, keys: list[Column], decided: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    """``docs`` after decisions on row keys; all columns stay.

    ``decided`` (written before): one row (k0, k1, .., stays) for each key that is dropped (not stays) or
    kept by several equal rows, of which one stays; other rows pass. Texts are shuffled only where the bitmap of the decided keys has
    their bit, so what moves follows what is decided, not the corpus; a false hit moves one row too many."""
    own = [f"key_{uuid.uuid4().hex}" for _ in keys]
    array = landed(native_bitmap(decided, "k0", bits)).scalar()
    keyed = docs.withColumns(dict(zip(own, keys, strict=True)))
    found = has_bit(array, F.col(own[0]), bits)

    def on(which: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, (F.col(mine) == which[f"k{i}"] for i, mine in enumerate(own)))

    drop, again = decided.filter("not stays"), decided.filter("stays")
    hit = keyed.filter(found)
    hit = hit.join(drop, on(drop), "left_anti")
    if not again.isEmpty():
        once = hit.join(again, on(again), "left_semi").dropDuplicates(own)
        hit = hit.join(again, on(again), "left_anti").unionByName(once)
    return keyed.filter(~found).unionByName(hit).drop(*own)


# --- connected components -------------------------------------------------------------

def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over the undirected ``edges``.

    Union-find as rounds of hooking (each node takes the smallest label around
    it) and pointer jumping, each one aggregation and joins on the label table;
    a hot node is pre-aggregated per task and its joins are plain shuffle joins,
    which AQE splits. Every round is landed, so a lost executor costs one round."""
    both = landed(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
                  .union(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).filter("u <> v").distinct())
    labels = landed(both.groupBy("u").agg(F.min("v").alias("m"))
                    .select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    while True:
        near = (both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("m")))
        hooked = (labels.join(near, labels["node"] == near["u"])
                  .select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")))
        # the root of each old label takes the smallest label any of its members saw
        roots = hooked.groupBy("old").agg(F.min("label").alias("root_label"))
        jumped = (hooked.join(roots, "old").select("node", "old", F.least("label", "root_label").alias("label")))
        new = landed(jumped)
        changed = new.filter("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
