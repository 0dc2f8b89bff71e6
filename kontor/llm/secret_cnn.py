"""Secret scan: a character convolutional network over every candidate and its context.

Base findings come from three patterns. Every other run of 12 or more token characters is
a candidate, letters alone included. The network sees the candidate in passages of 48 characters
with 24 characters on either side: character embeddings, a convolution, maximum over the
positions, a logistic output. It is trained in numpy on labelled findings (base findings
are secrets, other candidates are not; the context is hidden in half of the examples, so that
the value itself has to tell; the key of an assignment is cut out, as candidates have none), on all
distinct ones of the corpus: tasks train on buckets of them, and their networks are averaged.
On a part kept back, presented as candidates are scored, the logits are calibrated by a slope and
an offset, and the threshold is the highest one that still finds the wanted share of the
known secrets there, by a standard error. A candidate above it is an added finding of kind ``cnn``."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm import textkit as K
from kontor.llm.frames import id_and_text, landed, small_batches

# The base patterns, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KEY_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
VALUE_LEAST, ACCESS_LEAST, HEX_LEAST, CANDIDATE_LEAST = 12, 18, 16, 12

SIDE, BODY = 24, 48
WINDOW = SIDE + BODY + SIDE
RECALL = 0.95
#: rounds of training; passages that all of them go over whole; least examples of the rarer class in a bucket
ROUNDS, LEARNT, RARE = 6, 20_000, 64
#: bins of the logits of kept-back passages, for 1; units of averaged parameters, for 1
BINS, FIXED = 1024, 2.0**40
_HEX, _TOKEN = (np.zeros(256, bool) for _ in range(2))
_HEX[list(b"0123456789abcdef")] = True
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
#: character codes of the network: 0 outside, 1 white space, 2 beyond ASCII, else the character
_CODE = np.full(256, 2, np.uint8)
_CODE[:128] = np.arange(128) - 29
_CODE[:33] = 1
CODES = 99


def _runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal runs of at least ``least``; no run crosses a row."""
    if not len(mask):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.zeros(len(mask) + 1, bool)
    edge[offsets] = True
    before, after = np.concatenate(([False], mask[:-1])), np.concatenate((mask[1:], [False]))
    start = np.flatnonzero(mask & (~before | edge[:-1]))
    end = np.flatnonzero(mask & (~after | edge[1:])) + 1
    long = end - start >= least
    return start[long], end[long]


def base_findings(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) in byte positions of the buffer, in no order."""
    out = [(int(s), int(e), 2) for s, e in zip(*_runs(_HEX[data], offsets, HEX_LEAST), strict=True)]
    raw = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if raw.find(b"AKIA", a, b) >= 0:
            out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(raw, a, b) if m.end() - m.start() >= ACCESS_LEAST]
    low = raw.lower()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if any(low.find(k, a, b) >= 0 for k in KEY_WORDS):
            out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(raw, a, b) if m.end(2) - m.start(2) >= VALUE_LEAST]
    return out


def candidates(data: np.ndarray, offsets: np.ndarray, base: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, is a base finding) of all candidates; others do not touch a base finding."""
    s, e = _runs(_TOKEN[data], offsets, CANDIDATE_LEAST)
    taken = np.zeros(len(data) + 1, np.int64)
    if base:
        at = np.array(base)
        np.add.at(taken, at[:, 0], 1)
        np.add.at(taken, at[:, 1], -1)
    covered = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.cumsum(taken[:-1]) > 0)))
    keep = covered[e] == covered[s]
    s, e = s[keep], e[keep]
    bs, be = (np.array([b[k] for b in base], np.int64) for k in (0, 1))
    return np.concatenate((s, bs)), np.concatenate((e, be)), np.concatenate((np.zeros(len(s), bool), np.ones(len(bs), bool)))


def unkeyed(data: np.ndarray, base: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, length of the key before it) of the values of base findings. Findings within
    an assignment are left out: their value is that of the assignment."""
    out, until = [], -1
    for s, e, k in sorted(base, key=lambda b: (b[0], b[2])):
        if k == 0:
            m = ASSIGN.match(data[s:e].tobytes())
            out.append((s + m.start(2), e, m.start(2)))
            until = max(until, e)
        elif e > until:
            out.append((s, e, 0))
    start, end, key = (np.array([x[i] for x in out], np.int64) for i in range(3))
    return start, end, key


def windows(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray,
            key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(character codes of each passage, index of its candidate); a long candidate has several.
    ``key``: so many bytes before each candidate are skipped, as if they were not in the text."""
    parts = -(-(end - start) // BODY)
    of = np.repeat(np.arange(len(start)), parts)
    begin = start[of] + (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * BODY
    row = np.searchsorted(offsets, start, side="right") - 1
    lo, hi = offsets[row][of], offsets[row + 1][of]
    at = begin[:, None] + np.arange(-SIDE, BODY + SIDE)[None, :]
    if key is not None:
        at = np.where(at < start[of][:, None], at - key[of][:, None], at)
    inside = (at >= lo[:, None]) & (at < hi[:, None])
    codes = _CODE[data[np.clip(at, 0, max(0, len(data) - 1))]] if len(data) else np.zeros(at.shape, np.uint8)
    return np.where(inside, codes, 0).astype(np.uint8), of


@dataclass
class Network:
    emb: np.ndarray
    conv: np.ndarray
    conv_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 2.0      # above every probability: adds nothing


KERNEL = 5


def _forward(net: Network, codes: np.ndarray):
    x = net.emb[codes]
    n, length, dim = x.shape
    cols = np.lib.stride_tricks.sliding_window_view(x, KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(n, length - KERNEL + 1, KERNEL * dim)
    act = cols @ net.conv + net.conv_bias
    best = act.argmax(axis=1)
    top = np.take_along_axis(act, best[:, None, :], axis=1)[:, 0, :]
    hidden = np.maximum(top, 0)
    return cols, best, top, hidden, hidden @ net.out + net.out_bias


def logits(net: Network, codes: np.ndarray, step: int = 1024) -> np.ndarray:
    return np.concatenate([_forward(net, codes[i: i + step])[-1] for i in range(0, len(codes), step)] or [np.empty(0, np.float32)])


def _hidden_context(codes: np.ndarray) -> np.ndarray:
    codes = codes.copy()
    codes[:, :SIDE] = 0
    codes[:, SIDE + BODY:] = 0
    return codes


@dataclass
class State:
    """A network in training, with the two moments of its gradients."""
    net: Network
    m: dict[str, np.ndarray]
    v: dict[str, np.ndarray]
    steps: float = 0.0


PARAMETERS = ("emb", "conv", "conv_bias", "out", "out_bias")


def _start(filters: int, dim: int, seed: int) -> State:
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.3, (CODES, dim)).astype(np.float32), rng.normal(0, 0.2, (KERNEL * dim, filters)).astype(np.float32),
                  np.zeros(filters, np.float32), rng.normal(0, 0.3, filters).astype(np.float32), 0.0)
    return State(net, *({k: np.zeros(np.shape(getattr(net, k))) for k in PARAMETERS} for _ in range(2)))


def _batches(y: np.ndarray, rng: np.random.Generator, size: int = 128):
    """Each passage at least once, in batches with a quarter at least of either class: the rarer one is repeated."""
    rare, usual = sorted((np.flatnonzero(y == k) for k in (0, 1)), key=len)
    rare, usual = rng.permutation(rare), rng.permutation(usual)
    own = max(size // 4, round(size * len(rare) / len(y)))
    for i in range(-(-len(usual) // (size - own))):
        yield np.concatenate((usual[i * (size - own): (i + 1) * (size - own)], rare[np.arange(i * own, (i + 1) * own) % len(rare)]))


def _learn(state: State, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
    """One pass over passages of both classes, each class weighing a half."""
    net, m, v = state.net, state.m, state.v
    for pick in _batches(y, rng):
        t = y[pick].astype(np.float32)
        weight = np.where(t == 1, 0.5 / t.mean(), 0.5 / (1 - t.mean()))
        c = np.where((rng.random(len(pick)) < 0.5)[:, None], _hidden_context(x[pick]), x[pick])
        cols, best, top, hidden, z = _forward(net, c)
        dz = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - t) * weight / len(pick)).astype(np.float32)
        dh = dz[:, None] * net.out[None, :] * (top > 0)
        met = np.take_along_axis(cols, best[:, :, None], axis=1)                 # the columns that won, per filter
        dconv = np.einsum("nf,nfk->kf", dh, met)
        dcols = (dh[:, :, None] * net.conv.T[None, :, :]).reshape(-1, KERNEL, net.emb.shape[1])
        where = (best[:, :, None] + np.arange(KERNEL)).reshape(len(pick), -1)
        demb = np.zeros_like(net.emb)
        np.add.at(demb, np.take_along_axis(c, where, axis=1).ravel(), dcols.reshape(-1, net.emb.shape[1]))
        grads = {"emb": demb, "conv": dconv, "conv_bias": dh.sum(0), "out": hidden.T @ dz, "out_bias": dz.sum()}
        state.steps += 1
        for k, g in grads.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            change = 0.01 * (m[k] / (1 - 0.9**state.steps)) / (np.sqrt(v[k] / (1 - 0.99**state.steps)) + 1e-8)
            own = getattr(net, k) - change
            setattr(net, k, float(own) if k == "out_bias" else own.astype(np.float32))


def _binned(z: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(z, -40, 40) * BINS).astype(np.int32)


def _calibrate(net: Network, bins: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float) -> None:
    """Slope, offset and threshold from how many passages (``n``) of a class have a logit in a bin."""
    z = (bins + 0.5) / BINS
    ones = n[y == 1].sum()
    wanted = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (n.sum() - ones + 2))     # so that the slope stays finite
    a, b = 1.0, 0.0
    for _ in range(50):                     # slope and offset of the probabilities, by Newton's method
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        err, w = (p - wanted) * n, p * (1 - p) * n + 1e-12
        ga, gb, haa, hab, hbb = (err * z).sum(), err.sum(), (w * z * z).sum(), (w * z).sum(), w.sum()
        da = -np.clip((hbb * ga - hab * gb) / max(haa * hbb - hab * hab, 1e-12), -1, 1)
        da = max(0.05, a + da) - a
        a, b = float(a + da), float(b - np.clip((gb + hab * da) / hbb, -2, 2))
    net.slope, net.offset = a, b
    known = np.argsort(bins[y == 1], kind="stable")
    upto = np.cumsum(n[y == 1][known])
    # a standard error below the quantile: of few secrets the quantile itself is missed by luck as often as not
    missed = (1 - recall) * upto[-1]
    at = int(np.searchsorted(upto, np.floor(max(0.0, missed - np.sqrt(missed * recall))), side="right"))
    # the lower edge of the bin: what is in it is found
    net.threshold = float(probability(net, np.float64(bins[y == 1][known][at] / BINS)))


def train(codes: np.ndarray, labels: np.ndarray, recall: float = RECALL, epochs: int = 6, filters: int = 24, dim: int = 8, seed: int = 3) -> Network:
    """Fit on passages and 0/1 in one process; every fifth passage is kept back for calibration and threshold."""
    state = _start(filters, dim, seed)
    held = np.arange(len(labels)) % 5 == 0
    if any(len(set(labels[part].tolist())) < 2 for part in (held, ~held)):
        return state.net
    for epoch in range(epochs):
        _learn(state, codes[~held], labels[~held], np.random.default_rng([seed, epoch]))
    # what is kept back is judged as findings() judges candidates: with the context given
    cells, n = np.unique(np.stack((_binned(logits(state.net, codes[held])), labels[held])), axis=1, return_counts=True)
    _calibrate(state.net, *cells, n, recall)
    return state.net


def probability(net: Network, z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(net.slope * np.asarray(z, np.float64) + net.offset, -40, 40)))


_EXAMPLE = np.dtype([("h", "<i8"), ("codes", f"S{WINDOW}")])


def _examples(batches):
    """Passages of each label, distinct within a batch."""
    for batch in batches:
        for part in K.pieces(batch):
            data, offsets = K.buffer_of(part.column(1))
            base = base_findings(data, offsets)
            s, e, known = candidates(data, offsets, base)
            for label, at in enumerate(((s[~known], e[~known], None), unkeyed(data, base))):
                codes, _ = windows(data, offsets, *at)
                if not len(codes):
                    continue
                h = np.zeros(len(codes), np.uint64)
                for j in range(0, WINDOW, 8):
                    h = K.mix(h * np.uint64(0x9E3779B97F4A7C15) + np.ascontiguousarray(codes[:, j: j + 8]).view(np.uint64)[:, 0])
                rows = np.empty(len(codes), _EXAMPLE)
                rows["h"], rows["codes"] = h.view(np.int64), np.ascontiguousarray(codes).view(f"S{WINDOW}")[:, 0]
                rows = np.unique(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c.ljust(WINDOW, b"\0") for c in rows["codes"].tolist()], pa.binary()), pa.array([bool(label)] * len(rows)),
                     pa.array(rows["h"])], names=["codes", "known", "h"])


def _codes_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), WINDOW)


def _pack(state: State) -> np.ndarray:
    parts = [np.ravel(x[k]) for x in ({k: getattr(state.net, k) for k in PARAMETERS}, state.m, state.v) for k in PARAMETERS]
    return np.concatenate([*parts, [state.steps]]).astype(np.float64)


def _unpack(values: np.ndarray, like: State) -> State:
    out, at = [], 0
    for _ in range(3):
        own = {}
        for k in PARAMETERS:
            shape = np.shape(getattr(like.net, k))
            size = int(np.prod(shape))
            own[k], at = values[at: at + size].reshape(shape), at + size
        out.append(own)
    net = Network(*(out[0][k].astype(np.float32) for k in PARAMETERS[:-1]), float(out[0]["out_bias"]))
    return State(net, out[1], out[2], float(values[-1]))


def _learn_buckets(state: State, seed: int):
    """The state after a pass over each bucket from ``state`` on, in fixed point: sums of it do not depend on any order."""
    def run(batches):
        buckets: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            which = batch.column(0).to_numpy()
            for b in np.unique(which).tolist():
                buckets.setdefault(b, []).append(batch.filter(pa.array(which == b)))
        for b in sorted(buckets):
            table = pa.Table.from_batches(buckets.pop(b)).sort_by([("h", "ascending"), ("known", "ascending"), ("codes", "ascending")])
            y = table.column("known").to_numpy().astype(np.int64)
            if y.min() == y.max():
                continue
            own = _unpack(_pack(state), state)
            _learn(own, _codes_of(table.column("codes")), y, np.random.default_rng([seed, b]))
            values = np.round(np.clip(_pack(own), -1e4, 1e4) * FIXED).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["i", "value"])
    return run


def _bins_of(net: Network):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_binned(logits(net, _codes_of(batch.column(0))))), batch.column(1)], names=["bin", "known"])
    return run


def fit(docs: DataFrame, recall: float = RECALL, per_bucket: int = 25_000, filters: int = 24, dim: int = 8, seed: int = 3) -> Network:
    """Train on all distinct labelled passages; a fifth by hash is kept back for calibration and threshold.

    The passages are dealt by hash to buckets of about ``per_bucket``, over which ``ROUNDS`` rounds go: in each
    one every bucket trains on from the same state, and the states are averaged. A few passages are all gone over in
    each round; of many, a round takes a share, so that each is learnt from once at least. A rare class
    is copied to as many buckets as it takes for each to have some of it. The driver gets the averages
    and the numbers of kept-back passages by logit, to 1 / BINS: both of a fixed size."""
    spark = docs.sparkSession
    rows = landed(id_and_text(docs).mapInArrow(_examples, "codes binary, known boolean, h long").distinct())
    held = F.pmod("h", F.lit(5)) == 0
    number = {(r.held, r.known): r["count"] for r in rows.groupBy(held.alias("held"), "known").count().collect()}
    state = _start(filters, dim, seed)
    if len(number) < 4:
        return state.net
    learnt, rare = sum(number[False, k] for k in (False, True)), min(number[False, k] for k in (False, True))
    shares = next(n for n in (1, 2, 3, ROUNDS) if learnt <= n * LEARNT or n == ROUNDS)
    buckets = max(1, -(-learnt // per_bucket))
    copies = min(buckets, -(-RARE * shares * buckets // rare))
    rarer = F.lit(number[False, True] <= number[False, False]) == F.col("known")
    first = F.pmod(F.shiftrightunsigned("h", 8), F.lit(buckets))
    dealt = rows.filter(~held).withColumn("share", F.pmod(F.shiftrightunsigned("h", 36), F.lit(shares))).withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.when(rarer, copies - 1).otherwise(0))))
    dealt = dealt.select(((first + F.col("copy")) % buckets).cast("int").alias("bucket"), "codes", "known", "h", "share")
    small_batches(spark, 10_000)
    for i in range(ROUNDS):
        # a class too rare to be cut in shares is in each of them
        part = dealt.filter((F.col("share") == i % shares) | (rarer & F.lit(rare < RARE * shares)))
        sums = (part.drop("share").repartition(buckets, "bucket").mapInArrow(_learn_buckets(state, seed + i), "i int, value long")
                .groupBy("i").agg(F.sum("value").alias("value"), F.count("*").alias("n")).orderBy("i").toArrow())
        if sums.num_rows:
            state = _unpack(sums.column("value").to_numpy() / (sums.column("n").to_numpy() * FIXED), state)
    # what is kept back is judged as findings() judges candidates: with the context given
    bins = (rows.filter(held).select("codes", "known").mapInArrow(_bins_of(state.net), "bin int, known boolean")
            .groupBy("bin", "known").count().orderBy("bin", "known").toArrow())
    small_batches(spark)
    _calibrate(state.net, bins.column("bin").to_numpy(), bins.column("known").to_numpy().astype(np.int64), bins.column("count").to_numpy(), recall)
    return state.net


def findings(net: Network, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
    """Per row: (start, kind, end, score) in code points of the row, sorted; base findings score 1."""
    base = base_findings(data, offsets)
    all_ = [(s, k, e, 1.0) for s, e, k in base]
    if net.threshold <= 1:
        s, e, known = candidates(data, offsets, base)
        s, e = s[~known], e[~known]
        if len(s):
            codes, of = windows(data, offsets, s, e)
            p = np.zeros(len(s))
            np.maximum.at(p, of, probability(net, logits(net, codes)))
            all_ += [(int(s[i]), 3, int(e[i]), float(p[i])) for i in np.flatnonzero(p >= net.threshold)]
    points = np.concatenate((np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)))
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in range(len(offsets) - 1)]
    for s, k, e, p in sorted(all_):
        r = int(np.searchsorted(offsets, s, side="right")) - 1
        first = points[offsets[r]]
        out[r].append((int(points[s] - first), k, int(points[e] - first), p))
    return out


def find_secrets(docs: DataFrame, **bounds) -> DataFrame:
    """(doc_id, findings) for every row of ``docs``: findings is a list of (kind, start, end, score)
    by start, then kind (assign, access, hex, cnn); positions in code points, end exclusive.

    NULL text counts as empty; without secrets or without other candidates to learn from, nothing is
    added to the base findings; repeated rows give repeated rows; NULL ids stay; other columns
    are ignored; an empty table gives an empty table."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, **bounds))
    base = id_and_text(docs)
    schema = f"doc_id {base.schema['doc_id'].dataType.simpleString()}, findings array<struct<kind:string,start:long,end:long,score:double>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            for part in K.pieces(batch):
                rows = findings(shared.value, *K.buffer_of(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([[{"kind": KINDS[k], "start": s, "end": e, "score": p} for s, k, e, p in r] for r in rows], kind)],
                    names=["doc_id", "findings"])
    return base.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of :func:`find_secrets`."""
    def joined(x):
        return F.array_join(F.transform(x, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    base = F.filter("findings", lambda f: f["kind"] != "cnn")

    def n(kind):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("findings")).alias("spans"))


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
