"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly.

A word is the average of the embeddings of its character n-grams (hashed, with word
borders), a passage the average of its words, and a linear softmax over the average gives
the passage's logit; training begins with passages of four words and ends with single ones,
so that several slightly suspicious words do not count like one insult. Misspelt and unseen words share n-grams with the
words they come from. A document's logit pools its passages by attention (softmax of
their logits), so one insult in a long text is not averaged away. Embeddings, softmax and
attention are trained together by gradient descent in numpy.

The two classes make the softmax a function of the difference of the class weights, so
scoring needs one number per n-gram bucket: the trained table is 1 MB, whatever the
input, and is all that the tasks get."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm import textkit as K
from kontor.llm.frames import fold, small_batches
from kontor.llm.labelled import fit_in_task, sample
from kontor.llm.ngrams import BUCKET_BITS, Words

#: (words in a passage, epochs) of the stages of training; scoring uses the last
STAGES = ((4, 60), (1, 60))


@dataclass
class Model:
    weight: np.ndarray      # logit of each n-gram bucket
    bias: float
    passage: int = 1        # words in a passage


def _mean(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Mean of each segment; segments are not empty."""
    return np.add.reduceat(values, edges[:-1], axis=0) / np.diff(edges)[:, None].astype(np.float32)


def _means_of(values: np.ndarray, at: np.ndarray, edges: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """Mean of ``values[at]`` over each segment of ``at``, some segments at a time."""
    return np.concatenate([_mean(values[at[e[0]: e[-1]]], e - e[0]) for e in
                           (edges[i: i + step + 1] for i in range(0, len(edges) - 1, step))])


def _passages(per_row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(passage of each word, row of each passage) of passages of ``size`` words."""
    per = -(-per_row // size)
    base, first = np.cumsum(per) - per, np.cumsum(per_row) - per_row
    row = np.repeat(np.arange(len(per_row)), per_row)
    place = np.arange(len(row))
    place -= first[row]
    place //= size
    place += base[row]
    return place, np.repeat(np.arange(len(per_row)), per)


def _lexicon(raw: list[bytes], step: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, kind of each word, bucket and kind of the n-grams of every kind of word).
    The n-grams of a kind are taken from the first piece that has it; others are not kept."""
    per_row, names, fresh, buckets, owners = [], [], [], [], []
    kinds = np.empty(0, np.uint64)
    for i in range(0, len(raw), step):
        words = Words(*_buffer(raw[i: i + step]))
        name = words.identity()
        own, example = np.unique(name, return_index=True)
        at = np.searchsorted(kinds, own)
        new = at == len(kinds)
        new[~new] = kinds[at[~new]] != own[~new]
        own, example = own[new], example[new]
        place = np.full(words.count, -1, np.int32)          # of the words that are the example of a new kind
        place[example] = np.arange(len(own)) + sum(map(len, fresh))
        for b, w in words.grams():
            keep = place[w] >= 0
            buckets.append(b[keep].astype(np.int32))
            owners.append(place[w[keep]])
        fresh.append(own)
        kinds = np.union1d(kinds, own)
        names.append(name)
        per_row.append(words.per_row)
    which = np.searchsorted(kinds, np.concatenate(fresh)).astype(np.int32)
    return (np.concatenate(per_row), np.concatenate([np.searchsorted(kinds, n).astype(np.int32) for n in names]),
            np.concatenate(buckets), which[np.concatenate(owners)])


def _pool(z: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(pooled logit of each row, attention of each passage); rows without passages: 0."""
    top = np.full(rows, -np.inf)
    np.maximum.at(top, row, z)
    e = np.exp(z - top[row])
    a = e / np.bincount(row, e, rows)[row]
    return np.bincount(row, a * z, rows), a


def train(examples: list[tuple[str, int]], prior: float, dim: int = 4, stages: tuple[tuple[int, int], ...] = STAGES, rate: float = 0.15, seed: int = 1) -> Model:
    """Fit on (text, 0/1); ``prior``: share of ones among all labels. Every fifth example is kept
    back, and the logit is shifted so that the cut between the classes there is 0."""
    examples = [x for x in examples if x[0].strip()]
    model = _fit([x for i, x in enumerate(examples) if i % 5], dim, stages, rate, seed)
    kept = examples[::5]
    y = np.array([t for _, t in kept], np.float64)
    if not model.weight.any() or len(set(y.tolist())) < 2:
        return model
    raw = [t.encode() for t, _ in kept]
    z = np.concatenate([logits(model, *_buffer(raw[i: i + 200])) for i in range(0, len(raw), 200)])
    # of all cuts the one with the smallest error, weighted by the prior; the middle of its gap
    order = np.argsort(z)
    z, y = z[order], y[order]
    share = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean())) / len(y)
    wrong = np.concatenate(([0.0], np.cumsum(np.where(y == 1, share, 0)))) + np.concatenate((np.cumsum(np.where(y == 0, share, 0)[::-1])[::-1], [0.0]))
    best = int(np.argmin(wrong[1:-1])) + 1
    low = max(z[best - 1], -1e3)
    return Model(model.weight, model.bias - float((low + z[best]) / 2), model.passage)


def _buffer(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def _fit(examples: list[tuple[str, int]], dim: int, stages: tuple[tuple[int, int], ...], rate: float, seed: int) -> Model:
    y = np.array([t for _, t in examples], np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), 30.0 if len(y) and y[0] == 1 else -30.0)
    per_row, kind, bucket, of = _lexicon([t.encode() for t, _ in examples])
    order = np.argsort(of, kind="stable")
    bucket, of = bucket[order], of[order]
    del order
    is_used = np.zeros(1 << BUCKET_BITS, bool)
    is_used[bucket] = True
    used, bucket = np.flatnonzero(is_used), (np.cumsum(is_used) - 1)[bucket]
    types = int(of[-1]) + 1
    type_edges = np.searchsorted(of, np.arange(types + 1))
    per_type = 1.0 / np.diff(type_edges)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (len(used), dim)).astype(np.float32), rng.normal(0, 1, dim).astype(np.float32), np.zeros(1, np.float32)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    sizes = [size for size, epochs in stages for _ in range(epochs)]
    for step, size in enumerate(sizes, 1):
        if step == 1 or size != sizes[step - 2]:
            passage, row = _passages(per_row, size)
            passage_edges = np.searchsorted(passage, np.arange(len(row) + 1))
            per_passage = 1.0 / np.diff(passage_edges)
        emb, w, b = params
        p = _means_of(_means_of(emb, bucket, type_edges), kind, passage_edges)
        z = 20.0 * (p @ w) + b[0]
        doc, a = _pool(z, row, len(y))
        err = (1 / (1 + np.exp(-doc)) - y) * share
        dz = (err[row] * a * (1 + z - doc[row])).astype(np.float32)
        dw = 20.0 * (dz @ p)
        # back through the two averages, one dimension at a time
        back = np.bincount(kind, (dz * per_passage)[passage], types) * per_type
        demb = np.bincount(bucket, back[of], len(used)).astype(np.float32)[:, None] * (20.0 * w)[None, :]
        for i, g in enumerate((demb, dw.astype(np.float32), np.array([dz.sum()], np.float32))):
            g = g + 1e-7 * params[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            params[i] = (params[i] - (rate if i == 2 else 0.2 * rate) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-9)).astype(np.float32)
    emb, w, b = params
    weight = np.zeros(1 << BUCKET_BITS, np.float32)
    weight[used] = 20.0 * (emb @ w)
    return Model(weight, float(b[0]), sizes[-1])


def logits(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Pooled logit of each row; a text without words has no evidence: -inf."""
    rows = len(offsets) - 1
    words = Words(data, offsets)
    if not words.count:
        return np.full(rows, -np.inf)
    total, number = np.zeros(words.count), np.zeros(words.count)
    for bucket, word in words.grams():
        total += np.bincount(word, model.weight[bucket], words.count)
        number += np.bincount(word, minlength=words.count)
    passage, row = _passages(words.per_row, model.passage)
    z = np.bincount(passage, total / number) / np.bincount(passage) + model.bias
    return np.where(words.per_row > 0, _pool(z, row, rows)[0], -np.inf)


def score_buffer(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of toxicity of each row; a text without words: 0."""
    return 1 / (1 + np.exp(-np.clip(logits(model, data, offsets), -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = 1800, max_chars: int = 20_000, held_out: int = 5) -> Model:
    """Train on at most ``rows_per_class`` labelled texts of each class of at most ``max_chars``
    characters, outside the held-out fold."""
    got = labels.filter(fold("doc_id", held_out) != 0).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    prior = 0.0 if got is None else got
    return fit_in_task(sample(docs, labels, "toxic", held_out, rows_per_class, max_chars), lambda x: train(x, prior))


def with_score(docs: DataFrame, model: Model, column: str = "score", text: str = "text") -> DataFrame:
    """``docs`` and the score of every whole text; NULL counts as empty. A column of that name is replaced."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c.lower() != column.lower()]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*rest, F.lit(0.0).alias(column)).schema

    def run(batches):
        for batch in batches:
            for part in K.pieces(batch, text=text):
                own = score_buffer(shared.value, *K.buffer_of(part.column(part.schema.get_field_index(text))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own)], names=[*part.schema.names, column])
    return docs.select(*rest).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Learns from rows of ``labels`` (doc_id, toxic) whose crc32(doc_id as text) mod 5 is not 0;
    without two classes there every score is 0 or 1 by the only class. Empty and NULL texts score 0;
    repeated rows score alike; NULL ids are not held out; an empty table gives an empty table."""
    model = fit(docs, labels, **bounds)
    return (with_score(docs.select("doc_id", "text"), model)
            .select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))
