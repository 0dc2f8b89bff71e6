"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed 60-bit hash of its id. A source that has to give less
than all of its words (or more than a whole number of rounds) takes the documents
whose hash lies under a threshold. The threshold is found digit by digit: words are
summed by source and the next 12 bits of the hash, the bucket in which the budget
runs out is the boundary, and only the boundary's documents are counted again. No
document is sorted, and reruns take the same documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kontor.llm.frames import landed

WEIGHTS = (5, 2, 1)
MOST = 3            # times a document or a source may be repeated
DIGIT, DIGITS = 12, 5
WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def id_hash(doc_id: Column) -> Column:
    """First 60 bits of the MD5 of the id as text; a NULL id counts as ''."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    The sources in code-point order (NULL last) weigh ``weights``, repeating. They share
    the sum of all sizes by weight; a target stops at ``most`` times the source's size
    and the excess goes to the others by weight, until none is above. That fixed point
    is found at once: in the order of most * size / weight the capped sources come
    first, and the level of the rest follows from running sums over the sources."""
    n = len(weights)
    # windows over one row per source: a table of names, not of documents
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % n + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    t = t.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the level of the first source that its cap does not stop
    t = t.withColumn("share", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(
        (F.col("cap") / F.col("weight")).alias("at"), F.col("level")))).over(every)["level"])
    target = F.when(F.col("share").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("share") * F.col("weight")))
    return t.select("source", F.col("source_size").cast("long").alias("source_size"), target.cast("double").alias("target"))


def thresholds(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, rounds, below): documents are taken ``rounds`` times, and once more if
    their hash is less than ``below``. ``slim``: (source, size, h); ``plan``: :func:`targets`."""
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = landed(plan.withColumn("rounds", rounds)
                   .select("source", "rounds", (F.col("target") - F.col("rounds") * F.col("source_size")).alias("budget"),
                           F.lit(0).cast("long").alias("prefix")))
    inside = slim
    for digit in range(DIGITS):
        shift = DIGIT * (DIGITS - 1 - digit)
        if digit:       # only documents of the boundary bucket go on
            s = state.select(F.col("source").alias("s"), F.col("prefix").alias("p"))
            inside = landed(inside.join(s, inside["source"].eqNullSafe(s["s"])).filter(
                F.shiftright("h", shift + DIGIT) == F.col("p")).select("source", "size", "h"))
        histogram = (inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
                     .withColumnRenamed("source", "s"))
        # at most 2 ** DIGIT buckets a source
        upto = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
        run = (state.join(histogram, state["source"].eqNullSafe(histogram["s"]), "left")
               .withColumn("upto", F.coalesce(F.sum("words").over(upto), F.lit(0))))
        fits = F.col("upto") <= F.col("budget")
        step = run.groupBy("source", "rounds", "budget", "prefix").agg(
            F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("spent"),
            F.min(F.when(~fits, F.struct("bucket", F.col("words")))).alias("edge"))
        last = digit == DIGITS - 1
        # past every bucket: the budget takes them all
        beyond = F.shiftleft(F.col("prefix") + 1, DIGIT)
        edge = F.coalesce(F.col("edge.bucket"), beyond if not last else beyond)
        left = F.col("budget") - F.col("spent")
        if last:        # one hash value: take it if that comes nearer to the target
            edge = edge + F.when(F.col("edge.words").isNotNull() & (F.col("edge.words") - left < left), 1).otherwise(0)
        state = landed(step.select("source", "rounds", left.alias("budget"), edge.cast("long").alias("prefix")))
    return state.select("source", "rounds", F.col("prefix").alias("below"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` with size, source_size, target and taken, one row per row.

    ``taken`` is a whole multiple (0 to ``most``) of the document's words. NULL text has
    no words; NULL is a source of its own; rows with one doc_id share their hash and
    are taken together; columns of ``docs`` with these names are replaced; an empty
    table gives an empty table."""
    own = {"size", "source_size", "target", "taken"}
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in own])
    # names that no column of docs can have
    h, s, rounds, below = (f"{c}_{uuid.uuid4().hex}" for c in ("h", "s", "rounds", "below"))
    d = base.withColumn("size", n_words(F.col("text"))).withColumn(h, id_hash(F.col("doc_id")))
    slim = landed(d.select("source", "size", F.col(h).alias("h")))
    plan = landed(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    found = thresholds(slim, plan).withColumnRenamed("source", "s")
    cut = landed(plan.join(found, plan["source"].eqNullSafe(found["s"]))
                 .select(F.col("s").alias(s), "source_size", "target", F.col("rounds").alias(rounds), F.col("below").alias(below)))
    times = F.col(rounds) + F.when(F.col(h) < F.col(below), 1).otherwise(0)
    return (d.join(cut, d["source"].eqNullSafe(cut[s]))
            .withColumn("taken", (F.col("size") * times).cast("long")).drop(s, rounds, below, h))
