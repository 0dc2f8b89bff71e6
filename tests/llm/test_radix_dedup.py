import hashlib
import random
from collections import Counter

import pytest

from kontor.llm import radix_dedup as R
from kontor.llm.radix_dedup import remove_repeats


def brute(rows, width):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p: p + width] for _, b in texts for p in range(len(b) - width + 1))
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for p in range(len(b) - width + 1):
            if seen[b[p: p + width]] > 1:
                gone[p: p + width] = [True] * width
        kept = bytes(c for c, x in zip(b, gone, strict=True) if not x)
        spans = sum(x and not (k and gone[k - 1]) for k, x in enumerate(gone))
        out.append((-1 if i is None else i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows_of(seed):
    rnd = random.Random(seed)
    def word():
        return "".join(rnd.choice("abé ç") for _ in range(rnd.randint(1, 8)))
    base = [" ".join(word() for _ in range(rnd.randint(0, 60))) for _ in range(20)]
    rows = []
    for i in range(80):
        a, b = rnd.choice(base), rnd.choice(base)
        x = rnd.randint(0, len(a))
        rows.append((i, a[:x] + rnd.choice(["", "x", word(), b]) + a[x + rnd.randint(0, 3):]))
    # NULL and empty texts, a NULL id, a repeated row, a text that repeats itself
    return [*rows, (200, None), (201, ""), (202, "a" * 200), (203, "a" * 100), (None, base[0]), (1, rows[1][1])]


@pytest.mark.parametrize("width", [7, 20, 50])
def test_against_every_window(spark, width):
    rows = rows_of(width)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, row_key int")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                 for r in remove_repeats(df, width=width, kmer=min(8, width)).collect())
    assert got == brute(rows, width)


def test_production_width_long_text_cut_in_chunks(spark):
    rnd = random.Random(3)
    a = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    b = "".join(rnd.choice("abcdefgh ") for _ in range(2500))
    rows = [(1, a + b), (2, b[:450] + "#" + a[1000:1399] + "#" + a[500:900]), (3, a[2700:] + b[:500]), (4, b[:399])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, chunk=700).collect())
    assert got == brute(rows, 400)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(df).count() == 0


def test_repeated_rows_hold_each_place_once(spark, monkeypatch):
    """Rows with one id and text share a key; the lists that reach the cut do not grow with the rows."""
    held = []

    def noted(df):
        out = df.cache()
        if "places" in out.columns:
            held.extend(out.collect())
        return out
    monkeypatch.setattr(R, "landed", noted)
    rnd = random.Random(3)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(900))
    rows = [(1, text)] * 30 + [(None, text)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_removed for r in remove_repeats(df).collect()} == {900}
    assert held and all(len(r.places) == len(set(r.places)) for r in held)


def test_patterned_texts_are_not_repeats(spark):
    """A Thue-Morse text and its complement have one hash modulo 2**64; only the real repeats go."""
    order = "a"
    for _ in range(10):
        order += order.translate(str.maketrans("ab", "ba"))
    rows = [(1, order), (2, order.translate(str.maketrans("ab", "ba")))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, 1024, 32).collect())
    assert got == brute(rows, 1024)
