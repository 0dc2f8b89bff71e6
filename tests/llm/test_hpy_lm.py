import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kontor.llm import hpy_lm as L


def toks(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")), None]


def corpus(seed=1, n=160):
    """Two languages: the word before tells which words may follow."""
    rnd = random.Random(seed)
    langs = [["".join(rnd.choice(a) for _ in range(rnd.randint(1, 6))) + e for _ in range(300)]
             for a, e in (("abcdeé", "ung"), ("uvwxyz", "tion"))]
    rows = []
    for i in range(n):
        words = langs[i % 2]
        rows.append((i, rnd.choice([" ", "\n", "\t "]).join(rnd.choice(words[: 20 if rnd.random() < 0.6 else 300]).title()
                                                             for _ in range(rnd.randint(0, 120)))))
    return [*rows, (900, None), (901, ""), (902, " \n"), (None, "Abc abc"), (3, rows[3][1]), (903, "new words only " * 400)]


@pytest.mark.parametrize("head", [0, 50, 8192])
def test_counts_and_base_score(spark, head):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1.0, "x") for d, t in rows], "doc_id long, text string, score double, train string")
    def train(d):
        return d is None or zlib.crc32(str(d).encode()) % 7 != 2
    c = Counter(w for d, t in rows if train(d) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), d is not None and not train(d), len(toks(t)), sum(c[w] > 0 for w in toks(t)), n,
                   sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(t))) for d, t in rows)
    out = L.corpus_scores(df, L.Setting(head=head)).collect()
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in out)


def test_predictions_sum_to_one_and_follow_the_definition():
    s = L.Setting(endings=3, named=0)
    rng = np.random.default_rng(0)
    words = 40
    count = rng.poisson(0.7, words * 3).astype(np.int64)
    word, context = np.divmod(np.arange(words * 3), 3)
    least = np.bincount(context, np.minimum(count, 1), 3)
    g = {"least": least, "known": [], "d1": 0.4, "d2": 0.6}
    got = L.sample_tables(word, context, count, words, g, rng, s)
    assert len(got) == s.samples
    for t in got:
        assert ((t >= np.minimum(count, 1)) & (t <= count)).all()
    root = [np.bincount(word, t, words) for t in got]
    g |= {"tables": [np.bincount(context, t, 3) for t in got], "customers": np.bincount(context, count, 3), "V": int((root[0] > 0).sum())}
    p = L.mean_probability(count, got, [r[word] for r in root], context, g)
    unseen = L.mean_probability(np.zeros(3, np.int64), [np.zeros(3)] * s.samples, [np.zeros(3)] * s.samples, np.arange(3), g)
    seen = np.bincount(context, np.where(root[0][word] > 0, p, 0), 3)
    assert seen + unseen == pytest.approx(np.ones(3))
    cell = np.flatnonzero(count)
    table = L.head_probability(cell, count[cell], [t[cell] for t in got], words, g, s)
    assert table.reshape(-1) == pytest.approx(p)


def test_contexts_of_tokens():
    """A frequent word is a context itself, others by their ending, the start of a text by itself."""
    data = np.frombuffer("the unknownung the otherung".encode() + b"the", np.uint8)
    offsets = np.array([0, 27, 27, 30])
    word, _, _ = L.tokens(data, offsets, 32, np.empty(0, np.uint64))
    named = np.unique(word[:1])
    h, u, row = L.tokens(data, offsets, 32, named)
    assert row.tolist() == [0] * 5 + [1] + [2] * 2 and (h == word).all()
    assert u[[0, 5, 6]].tolist() == [0, 0, 0] and u[[1, 3, 7]].tolist() == [32] * 3
    assert 0 < u[2] < 32 and u[2] == u[4]


def test_words_as_contexts_tell_more_than_endings(spark):
    """Texts that walk a ring of words whose endings are all alike: only the word before tells the next."""
    rnd = random.Random(3)
    ring = [f"{i}ung" for i in range(200)]
    rows = []
    for i in range(300):
        at = rnd.randrange(200)
        rows.append((i, " ".join(ring[(at + k) % 200] for k in range(60))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    def held_out(s):
        out = [r for r in L.corpus_scores(df, s).collect() if r.held_out]
        return sum(r.score for r in out) / sum(r.n_tokens for r in out)
    words, few = held_out(L.Setting()), held_out(L.Setting(named=0))
    assert few < -2 and words > -0.5


def test_every_word_is_a_context(spark):
    """The ring again: how many contexts have a number only decides which way they take, none are put together."""
    rnd = random.Random(3)
    ring = [f"{i}ung" for i in range(200)]
    rows = [(i, " ".join(ring[(at + k) % 200] for k in range(60))) for i, at in enumerate(rnd.randrange(200) for _ in range(300))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for setting in (L.Setting(named=5), L.Setting(named=5, head=20)):
        held = [r for r in L.corpus_scores(df, setting).collect() if r.held_out]
        assert sum(r.score for r in held) / sum(r.n_tokens for r in held) > -0.5


@pytest.mark.parametrize("named,head", [(3, 0), (3, 40), (60, 15), (992, 8192)])
def test_scores_by_the_definition(spark, named, head):
    """No pair of words occurs twice in training, so nothing is drawn: each cell has one table."""
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(90)]
    met, rows = set(), []
    for i in range(60):
        text = [f"first{i}"]
        for _ in range(rnd.randint(3, 40)):
            nxt = [w for w in rnd.sample(words, 12) if (text[-1], w) not in met and text[-1] != w]
            if nxt:
                text.append(nxt[0])
                met.add((text[-2], text[-1]))
        rows.append((i, " ".join([*text, f"last{i}"])))
    rows.append((100, "w1 w2 never w3"))
    def train(d):
        return d < 100
    cell = {}
    for d, t in rows:
        if train(d):
            w = toks(t)
            for pair in zip([0, *w[:-1]], w, strict=True):
                assert pair not in cell
                cell[pair] = 1
    customers, root = Counter(u for u, _ in cell), Counter(w for _, w in cell)
    ones = sum(n == 1 for n in root.values())
    d1, d2, theta = L.discount(ones, sum(n == 2 for n in root.values())), L.discount(len(cell), 0), L.THETA
    def p(u, w):
        base = (root[w] - d1 if root[w] else L.THETA_ROOT + d1 * len(root)) / (L.THETA_ROOT + len(cell))
        return ((1 - d2) * ((u, w) in cell) + (theta + d2 * customers[u]) * base) / (theta + customers[u])
    want = {d: sum(math.log10(p(u, w)) for u, w in zip([0, *toks(t)[:-1]], toks(t), strict=True)) for d, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in L.score_texts(df, L.F.col("doc_id") < 100, L.Setting(named=named, head=head)).collect()}
    assert got == pytest.approx(want, rel=1e-5)


def test_seating_matches_a_restaurant_customer_by_customer():
    """Mean tables of the vectorised seating and of a plain simulation agree."""
    rng = np.random.default_rng(5)
    many = 4000
    got = L.seat(np.full(many, 30), np.full(many, 0.05), np.full(many, 10), 0.5, 2.0, rng)
    plain = []
    for _ in range(1500):
        sizes = [1]
        for i in range(1, 30):
            new = (2.0 + 0.5 * (10 + len(sizes))) * 0.05
            if rng.random() < new / (new + i - 0.5 * len(sizes)):
                sizes.append(1)
            else:
                w = np.array(sizes) - 0.5
                sizes[rng.choice(len(sizes), p=w / w.sum())] += 1
        plain.append(len(sizes))
    assert got.mean() == pytest.approx(np.mean(plain), rel=0.03)
    big = L.seat(np.array([100000, 5, 1]), np.array([0.5, 0.5, 0.5]), np.array([5, 5, 5]), 0.5, 1.0, rng)
    assert big[2] == 1 and 5 < big[0] < 2000


def test_empty_table_and_reruns(spark):
    assert L.corpus_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame(corpus(2, 40), "doc_id long, text string")
    one = sorted((str(r.doc_id), round(r.score, 4)) for r in L.corpus_scores(df).collect())
    two = sorted((str(r.doc_id), round(r.score, 4)) for r in L.corpus_scores(df.repartition(5)).collect())
    assert one == two


def test_each_bucket_is_sampled_once(spark, tmp_path, monkeypatch):
    from pyspark import cloudpickle
    log, whole = str(tmp_path / "calls"), L.sample_tables

    def counted(*args):
        with open(log, "a") as f:
            f.write("x\n")
        return whole(*args)

    monkeypatch.setattr(L, "sample_tables", counted)
    cloudpickle.register_pickle_by_value(L)          # the tasks get the module as it is here
    try:
        df = spark.createDataFrame(corpus(), "doc_id long, text string")
        L.corpus_scores(df, L.Setting(head=50, named=20)).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(L)
    with open(log) as f:
        assert len(f.readlines()) <= 1 + L.LEAST_BUCKETS          # the head, and each bucket


def test_places_and_hashes_do_not_depend_on_how_they_are_looked_up(monkeypatch):
    rng = np.random.default_rng(3)
    h = np.append(rng.integers(0, 1 << 63, 5000, dtype=np.uint64), rng.integers(0, 40, 5000, dtype=np.uint64))
    for head in (np.empty(0, np.uint64), np.unique(h[:1]), np.unique(h[::3]), np.append(np.unique(h[::7]), np.uint64(2**64 - 1))):
        at = {int(x): i for i, x in enumerate(head)}
        assert L._place(head, np.append(h, np.uint64(2**64 - 1))).tolist() == [at.get(int(x), -1) for x in [*h, 2**64 - 1]]
    data = rng.choice(np.frombuffer(b"abc \n", np.uint8), 3000)
    start, end, _ = L.K.words(data, np.array([0, 1000, 3000]))
    want = L.K.RangeHash(data)(start, end)
    for block in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(L, "HASH_BYTES", block)
        assert (L._hashes(data, start, end) == want).all()
