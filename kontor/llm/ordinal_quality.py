"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(f(text) - threshold_k): one weight vector over hashed byte
n-grams for all grades, and thresholds that are ordered by construction (the first one and
positive steps). Expected grade and tail probabilities follow; a document is selected
if the probability of at least the wanted grade is a half or more."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm import textkit as K
from kontor.llm.frames import fold, id_and_text, small_batches
from kontor.llm.labelled import fit_in_task, sample
from kontor.llm.ngrams import BUCKET_BITS, byte_grams


@dataclass
class Model:
    weight: np.ndarray
    thresholds: np.ndarray      # one less than grades
    grades: np.ndarray          # the grades met, ascending


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(examples: list[tuple[str, int]], epochs: int = 80, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Fit on (text, grade); any integer grades, at least two of them to learn anything."""
    grades, y = np.unique(np.array([g for _, g in examples], np.int64), return_inverse=True)
    weight = np.zeros(1 << BUCKET_BITS, np.float32)
    if len(grades) < 2:
        return Model(weight, np.empty(0), grades if len(grades) else np.zeros(1, np.int64))
    raw = [t.encode() for t, _ in examples]
    n = len(raw)
    keys, counts = [], []
    for i in range(0, n, 100):                  # counts of one part of the texts at a time
        part = raw[i: i + 100]
        for b, r in byte_grams(np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)])):
            k, c = np.unique((r + i) * (1 << BUCKET_BITS) + b, return_counts=True)
            keys.append(k)
            counts.append(c)
    key, which = np.unique(np.concatenate(keys) if keys else np.empty(0, np.int64), return_inverse=True)
    count = np.bincount(which, np.concatenate(counts) if counts else None, len(key))
    del keys, counts, which
    row, bucket = key >> BUCKET_BITS, key & ((1 << BUCKET_BITS) - 1)
    used, col = np.unique(bucket, return_inverse=True)
    tf = count / np.maximum(np.bincount(row, count, n), 1)[row]
    scale = 1 / np.sqrt(np.bincount(col, tf * tf, len(used)) / n + 1e-12)      # columns of equal size
    x = (tf * scale[col] / np.sqrt(len(used))).astype(np.float32)
    k = len(grades) - 1
    w, cut = np.zeros(len(used)), np.concatenate(([-1.0], np.zeros(k - 1)))      # first threshold, log steps
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(cut), np.zeros_like(cut)]
    balance = (n / len(grades) / np.bincount(y))[y] / n
    above = (y[:, None] > np.arange(k)[None, :]).astype(float)

    def links(cut):
        return np.concatenate((cut[:1], cut[0] + np.cumsum(np.exp(cut[1:]))))
    for step in range(1, epochs + 1):
        f = np.bincount(row, x * w[col], n)
        err = (_sigmoid(f[:, None] - links(cut)[None, :]) - above) * balance[:, None]
        gw = np.bincount(col, x * err.sum(1)[row], len(used)) + decay * w / n
        gt = -err.sum(0)
        gc = np.concatenate(([gt.sum()], [gt[j:].sum() * np.exp(cut[j]) for j in range(1, k)]))
        for p, g, i in ((w, gw, 0), (cut, gc, 2)):
            state[i] = 0.9 * state[i] + 0.1 * g
            state[i + 1] = 0.99 * state[i + 1] + 0.01 * g * g
            p -= rate * (1 if i == 0 else 2) * (state[i] / (1 - 0.9**step)) / (np.sqrt(state[i + 1] / (1 - 0.99**step)) + 1e-9)
    weight[used] = w * scale / np.sqrt(len(used))
    return Model(weight, links(cut), grades)


def tails(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """P(grade >= each grade but the lowest) of each row. An empty text has no n-grams: f = 0."""
    rows = len(offsets) - 1
    total, number = np.zeros(rows), np.zeros(rows)
    for bucket, row in byte_grams(data, offsets):
        total += np.bincount(row, model.weight[bucket], rows)
        number += np.bincount(row, minlength=rows)
    return _sigmoid((total / np.maximum(number, 1))[:, None] - model.thresholds[None, :])


def quality(docs: DataFrame, labels: DataFrame, grade: str = "grade", wanted: int | None = None, held_out: int = 5,
            rows_per_class: int = 800, max_chars: int = 20_000) -> DataFrame:
    """(doc_id, held_out, expected_grade, score, predicted) for every row of ``docs``.

    ``labels`` has doc_id and integer grades; rows whose crc32(doc_id as text) mod
    ``held_out`` is 0 teach nothing. score = P(grade >= ``wanted``) (default: the second lowest
    grade); predicted = 1 from a half on: selected. With fewer than two grades known every
    score is 1. NULL text counts as empty; repeated rows score alike; NULL ids are not held out."""
    small_batches(docs.sparkSession)
    model = fit_in_task(sample(docs, labels, grade, held_out, rows_per_class, max_chars), train)
    at = 0 if wanted is None else int(np.searchsorted(model.grades[1:], wanted))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = id_and_text(docs)
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in K.pieces(batch):
                p = tails(m, *K.buffer_of(part.column(1)))
                expected = m.grades[0] + p @ np.diff(m.grades).astype(float) if p.shape[1] else np.full(len(p), float(m.grades[0]))
                score = p[:, at] if p.shape[1] > at else np.ones(len(p))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(expected), pa.array(score)], names=["doc_id", "expected_grade", "score"])
    return (base.mapInArrow(run, f"doc_id {kind}, expected_grade double, score double")
            .select("doc_id", (fold("doc_id", held_out) == 0).alias("held_out"), "expected_grade", "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))
