"""A training corpus from raw documents: five stages, each one of the llm operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again as the docs of the next one. All but the last return the columns of
``documents``. Rows with NULL or empty texts are documents like others: they are not toxic,
equal to each other, near nothing, clean, and of size 0 in the mix."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.llm import exact, mixing, superminhash, tiling, toxicity
from kontor.session import checkpoint_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below a half. The model learns outside the held-out fold."""
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    score = f"score_{uuid.uuid4().hex}"        # no column of docs has this name
    return toxicity.with_score(docs, model, score).filter(F.col(score) < 0.5).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    return exact.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies: five words, a similarity of 0.8 or more."""
    return superminhash.keep_first(docs, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not contain most of a benchmark item."""
    return tiling.clean(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, with ``repeats`` (1 to 3) and the sizes it was decided by. Documents without
    words add nothing to any source and are not taken."""
    mixed = mixing.mix(docs).filter("taken > 0")
    return mixed.withColumn("repeats", (F.col("taken") / F.col("size")).cast("int"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: near dedup and a trained model are not expressible in SQL
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark).rstrip('/')}/kontor-pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{i}-{name}")
    return docs
