import math
import random

import numpy as np

from kontor.llm import registry as R
from kontor.llm import whitening
from tests.conftest import SF_SMALL

SCHEMA = "vec_id long, embedding array<float>, n int, x string"


def brute(vectors):
    """The same from a dense eigen-decomposition: (rows by id, n, variances, trace)."""
    grid = [(i, [math.floor(256 * c) for c in v]) for i, v in vectors]
    fit = np.array(sorted({tuple(x) for _, x in grid}), object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums).astype(float) / n
    value, turn = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-value)
    return grid, n, sums, value[order], turn[:, order]


def compare(out, vectors, components=4, tol=1e-9):
    grid, n, sums, value, turn = brute(vectors)
    rank = min(components, int((value > 1e-12 * value[0]).sum()))
    want_dev = sorted((str(i), sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True))) for i, x in grid for _ in range(rank))
    assert sorted((str(r.vec_id), int(r.deviation)) for r in out) == want_dev
    assert all(r.n == n and r.identity_error <= 1e-9 for r in out)
    for k in range(rank):
        own = sorted((str(r.vec_id), r.whitened) for r in out if r.component == k + 1)
        want = sorted((str(i), float((np.array(x, float) - (sums / n).astype(float)) @ turn[:, k] / math.sqrt(value[k]))) for i, x in grid)
        a, b = np.array([w for _, w in own]), np.array([w for _, w in want])
        assert np.abs(a - b).max() < tol or np.abs(a + b).max() < tol
        assert all(abs(r.explained / (value[k] / value.sum()) - 1) < 1e-12 for r in out if r.component == k + 1)


def test_query_against_dense(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()
    out = R.QUERIES["op11_whitening"](spark, SF_SMALL).collect()
    compare(out, [(r.vec_id, r.embedding) for r in rows])
    assert len(out) == 4 * len(rows)


def test_random_spectra(spark):
    rng = np.random.default_rng(3)
    for dim, rows in ((3, 40), (9, 200), (40, 300)):
        scale = rng.uniform(0.01, 3, dim)
        vectors = [(i, (rng.standard_normal(dim) * scale).astype(np.float32).tolist()) for i in range(rows)]
        vectors += [(1000 + i, v) for i, v in vectors[:20]]
        df = spark.createDataFrame([(i, v, 5, "y") for i, v in vectors], SCHEMA)
        for block in (1, 2, 8):
            model = whitening.fit_whitening(df, block=block)
            compare(whitening.whiten(df, model).collect(), vectors)


def test_repeated_eigenvalues_and_low_rank(spark):
    ring = [(i, [1.0 if i // 2 == j else 0.0 for j in range(12)]) for i in range(12)]       # six equal lengths
    ring = [(i, [c if i % 2 else -c for c in v]) for i, v in ring]
    df = spark.createDataFrame([(i, v, 1, "") for i, v in ring], SCHEMA)
    model = whitening.fit_whitening(df)
    assert len(model.variance) == 4 and np.allclose(model.variance, 2 * 256 ** 2 / 12, rtol=1e-12) and model.identity_error < 1e-12
    line = [(i, [float(i), 2.0 * i, 0.0, 1.0]) for i in range(30)]
    out = whitening.whiten(spark.createDataFrame([(i, v, 1, "") for i, v in line], SCHEMA),
                           whitening.fit_whitening(spark.createDataFrame([(i, v, 1, "") for i, v in line], SCHEMA))).collect()
    compare(out, line)
    assert {r.component for r in out} == {1} and abs(out[0].explained - 1) < 1e-12


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, -0.25]), (2, [0.1, 0.2]), (2, [0.1, 0.2]), (None, [-1.0, 3.0]), (4, [0.0, -0.0])]
    bad = [(9, None), (9, [1.0, None]), (9, [nan, 1.0]), (9, [1.0, inf]), (9, [-inf, 0.0])]
    df = spark.createDataFrame([(i, v, 3, "z") for i, v in good + bad], SCHEMA)
    compare(whitening.whiten(df, whitening.fit_whitening(df)).collect(), good)
    for few in (df.limit(0), df.filter("vec_id = 9"), df.filter("vec_id = 1")):
        assert whitening.whiten(few, whitening.fit_whitening(few)).collect() == []
    # shorter vectors count as followed by zeros
    short = [(1, [0.5, 0.0, 0.0]), (2, [0.5]), (3, []), (4, [1.0, 2.0, 3.0]), (5, [-1.0, 0.3])]
    df = spark.createDataFrame([(i, v, 3, "z") for i, v in short], SCHEMA)
    padded = [(i, [*v, 0.0, 0.0, 0.0][:3]) for i, v in short]
    compare(whitening.whiten(df, whitening.fit_whitening(df)).collect(), padded)
    # entries so large that the exact sums leave 64 bits
    random.seed(2)
    wide = [(i, [random.uniform(-1, 1) * 2.0 ** 40 for _ in range(3)]) for i in range(20)]
    df = spark.createDataFrame(wide, "vec_id long, embedding array<double>")
    compare(whitening.whiten(df, whitening.fit_whitening(df)).collect(), wide, tol=1e-7)
