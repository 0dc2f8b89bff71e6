import random
import zlib

import numpy as np

from kontor.llm import ordinal_quality as Q
from kontor.llm import toxicity as T
from kontor.llm.ngrams import Words


def test_words_and_grams():
    texts = ["Straße, the IDIOT's 12 ab", "", "...", "é"]
    raw = [t.encode() for t in texts]
    w = Words(*T._buffer(raw))
    assert w.per_row.tolist() == [6, 0, 0, 1]
    a, b = (Words(*T._buffer([t.encode()])).identity() for t in ("the cat THE", "cat"))
    assert a[0] == a[2] != a[1] == b[0]
    sizes = [np.bincount(word, minlength=w.count).tolist() for _, word in w.grams()]
    # with its two borders a word of n letters has n, n - 1, n - 2 n-grams of 3, 4, 5
    assert sizes[0] == [6, 3, 5, 1, 2, 2, 1] and sizes[1] == [5, 2, 4, 0, 1, 1, 0] and sizes[2] == [4, 1, 3, 0, 0, 0, 0]


def texts(rnd, n, toxic):
    vocab = ["".join(rnd.choice("aeioubdgklmnrst") for _ in range(rnd.randint(2, 8))) for _ in range(1500)]
    out = []
    for i in range(n):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(5, 300))]
        y = int(rnd.random() < 0.3)
        for _ in range(y * rnd.randint(1, 3)):
            w.insert(rnd.randint(0, len(w)), rnd.choice(toxic))
        out.append((i, " ".join(w), y))
    return out


def test_toxicity_on_held_out_rows_and_misspellings(spark):
    rnd = random.Random(4)
    rows = texts(rnd, 900, ["zwackelfrizz", "Grumpfhexe", "quojjobin"])
    odd = [(5000, None), (5001, ""), (5002, "!!! ..."), (None, "a b c"), (3, rows[3][1]), (5003, "plain " * 30000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows] + [(i, t, 1) for i, t in odd], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows] + [(None, 1, "x"), (7, None, "x")], "doc_id long, toxic int, text string")
    got = {r.doc_id: r for r in T.toxicity(docs, labels).collect() if r.doc_id is not None}
    assert len(got) == 904 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(y, got[i].predicted) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert np.mean([a == b for a, b in held]) > 0.95
    assert not any(got[i].predicted for i in (5000, 5001, 5002, 5003))
    model = T.train([(t, y) for _, t, y in rows], 0.3)
    def one(t):
        return T.score_buffer(model, *T._buffer([t.encode()]))[0]
    assert one("mit zwackelfriz und alles") > one("mit wackeln und alles") and one("das grumpfhexen wort") > 0.5 > one("das helle wort")


def test_without_labels_or_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    assert [r.predicted for r in T.toxicity(docs, labels).collect()] == [0, 0]
    assert T.toxicity(docs.limit(0), labels).count() == 0
    grades = spark.createDataFrame([], "doc_id long, grade int")
    assert [r.score for r in Q.quality(docs, grades).collect()] == [1.0, 1.0]
    assert Q.quality(docs.limit(0), grades).count() == 0


def test_ordered_grades(spark):
    """Four grades by the share of junk: order is kept, thresholds ascend, held-out rows are told apart."""
    rnd = random.Random(8)
    vocab = ["".join(rnd.choice("aeioubdgklmnrst") for _ in range(rnd.randint(2, 8))) for _ in range(500)]
    rows = []
    for i in range(1000):
        g = rnd.randrange(4)
        rows.append((i, " ".join(rnd.choice(vocab) + ("%%" if rnd.random() < (3 - g) * 0.3 else "") for _ in range(rnd.randint(60, 160))), g))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9001, None, "x"), (9002, "", "x")], "doc_id long, text string, grade string")
    got = {r.doc_id: r for r in Q.quality(docs, spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, grade int"), wanted=2).collect()}
    model = Q.train([(t, g) for _, t, g in rows])
    assert (np.diff(model.thresholds) > 0).all() and model.grades.tolist() == [0, 1, 2, 3]
    held = [(g, got[i]) for i, _, g in rows if got[i].held_out]
    assert len(held) > 150
    means = [np.mean([r.expected_grade for g, r in held if g == k]) for k in range(4)]
    assert all(b - a > 0.3 for a, b in zip(means, means[1:], strict=False))
    assert np.mean([(g >= 2) == r.predicted for g, r in held]) > 0.9
    assert 0 <= got[9001].score <= 1 and got[9001].score == got[9002].score


def test_training_memory_does_not_hold_the_n_grams_of_every_word():
    """Words that come again cost nothing: only the n-grams of kinds that are new are kept."""
    import tracemalloc
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(6000)]
    raw = [" ".join(rnd.choice(vocab) for _ in range(300)).encode() for _ in range(1500)]
    tracemalloc.start()
    per_row, kind, bucket, of = T._lexicon(raw)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert per_row.sum() == len(kind) == 450_000 and len(set(kind.tolist())) == 6000
    assert (np.bincount(of) == np.bincount(of)[0]).all() and bucket.max() < 1 << T.BUCKET_BITS
    assert peak < 40e6
