"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, held_out: int, rows_per_class: int, max_chars: int,
           most_classes: int = 32) -> DataFrame:
    """(doc_id, text, y) of at most ``rows_per_class`` labelled documents of each class
    outside the held-out fold, the first ones by a hash of the id.

    Longer texts than ``max_chars`` are no training examples (they are scored whole like all
    others), so that the sample is bounded in bytes too. NULL labels and ids are left out;
    of several labels of one id the largest counts. More than ``most_classes`` classes are an error: the
    sample would have no bound."""
    from kontor.llm.frames import fold
    known = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", held_out) != 0))
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("__y")))
    order = F.xxhash64("doc_id", F.lit(11))
    classes = [r[0] for r in known.select("__y").distinct().orderBy("__y").limit(most_classes + 1).collect()]
    if len(classes) > most_classes:
        raise ValueError(f"more than {most_classes} classes in {label!r}")
    picked = None
    for c in classes:
        some = known.filter(F.col("__y") == c).orderBy(order, "doc_id").limit(rows_per_class)
        picked = some if picked is None else picked.unionByName(some)
    if picked is None:
        return docs.select("doc_id", "text", F.lit(0).alias("y")).limit(0)
    # at most most_classes * rows_per_class ids: a size that the parameters bound
    return (docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
            .filter(F.col("text").isNotNull() & (F.length("text") <= max_chars))
            .select("doc_id", "text", F.col("__y").alias("y")).dropDuplicates(["doc_id"]))


Model = TypeVar("Model")


def fit_in_task(examples: DataFrame, train: Callable[[list[tuple[str, int]]], Model]) -> Model:
    """Train on a bounded :func:`sample` in one task of an executor; the driver gets the model only."""
    def run(batches):
        rows = []
        for batch in batches:
            rows += zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
        model = train([(text, y) for _, text, y in sorted(rows)])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])
    got = examples.select("doc_id", "text", "y").repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0].model) if got else train([])
