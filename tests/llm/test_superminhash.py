import random
import re

import numpy as np
import pytest

from kontor.llm import superminhash as S
from kontor.llm import textkit as K


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return set()
    return {tuple(w[i: i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in groups[find(i)] if x is not None]
        c = min(ids) if ids else None
        out.append((str(d), len(sets[i]), str(c), d == c))
    return sorted(out)


def got(df, **kw):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in S.near_duplicates(df, **kw).collect())


def near_copies(seed, groups=6, members=12):
    """Copies of copies: most pairs of a group are below the threshold, chains hold it together."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(1, 9))) for _ in range(400)]
    rows, k = [], 0
    for _ in range(groups):
        text = [rnd.choice(vocab) for _ in range(rnd.randint(20, 300))]
        for _ in range(members):
            rows.append((k * 7 % 1009, " ".join(text) if rnd.random() < 0.7 else "\t".join(text).upper().replace("É", "é")))
            k += 1
            for _ in range(rnd.randint(0, max(1, len(text) // 60))):
                text = list(text)
                text[rnd.randrange(len(text))] = rnd.choice(vocab)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_all_pairs(spark, seed):
    rows = near_copies(seed) + [(5000, None), (5001, ""), (5002, " \n"), (5003, "one two"), (5004, "ONE two"), (5005, "one two three"),
                                (None, "one\ttwo"), (5006, "x " * 4000), (5007, "x " * 9000)]
    rnd = random.Random(seed)
    rnd.shuffle(rows)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, component_id int")
    assert got(df) == brute(rows)


def test_a_hub_that_no_leader_is(spark):
    """Spokes are linked to the hub only; the hub is not the smallest id of any bucket."""
    rnd = random.Random(9)
    hub = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
    rows = [(999, " ".join(hub))]
    for i in range(40):
        spoke = list(hub)
        for _ in range(2):
            spoke[rnd.randrange(150)] = f"z{rnd.randrange(10**6)}"
        rows.append((i, " ".join(spoke)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)


def test_empty_table_and_repeated_rows(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (4, "A b c d e f")], "doc_id long, text string")
    assert got(df) == [("3", 2, "3", True), ("3", 2, "3", True), ("4", 2, "3", False)]


def test_signature_estimates_similarity():
    rnd = np.random.default_rng(4)
    pool = rnd.integers(0, 2**63, 4000, dtype=np.uint64)
    for size, share in ((300, 0.85), (1000, 0.5), (40, 0.9)):
        both = int(size * share)
        a, b = np.sort(pool[:size]), np.sort(np.concatenate((pool[:both], pool[2000: 2000 + size - both])))
        sig = S.signatures(np.concatenate((a, b)), np.array([0, size, 2 * size]), 256)
        true = both / (2 * size - both)
        assert abs((sig[0] == sig[1]).mean() - true) < 0.12
        assert (sig[0] >> np.uint64(32)).max() <= 60


def test_every_slot_is_offered_by_a_single_element():
    sig = S.signatures(np.array([12345], np.uint64), np.array([0, 1, 1]), 64)
    assert sorted(sig[0] >> np.uint64(32)) == list(range(64)) and (sig[1] == np.iinfo(np.uint64).max).all()


def test_sets_equal_python_sets():
    rows = near_copies(3, 2, 4)
    data = [t.encode() for _, t in rows]
    offsets = np.cumsum([0, *map(len, data)])
    _, first = S.shingle_sets(np.frombuffer(b"".join(data), np.uint8), offsets)
    assert np.diff(first).tolist() == [len(shingles(t)) for _, t in rows]
    assert K.pieces is not None


def test_keep_first_decides_row_by_row(spark):
    """NULL and repeated ids: only near copies go, and one row of each group stays."""
    rnd = random.Random(6)

    def prose():
        return " ".join(f"w{rnd.randrange(10**6)}" for _ in range(90))
    a, b, c, alone, also = (prose() for _ in range(5))
    rows = [(1, a), (None, a + " end"), (None, alone), (None, also),            # one of three NULL ids is near a row with an id
            (None, b), (None, b + " end"), (None, "begin " + b),                # a group of NULL ids only
            (7, c), (7, c + " end"), (7, prose()), (3, "begin " + c),           # an id that near copies and a clean text share
            (20, "x y z p q r"), (20, "x y z p q r"), (None, None), (None, "")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, __gone int")
    left = S.keep_first(df)
    assert left.columns == df.columns
    got = sorted(r["__gone"] for r in left.collect())
    assert len([i for i in got if i in (4, 5, 6)]) == 1 and len([i for i in got if i in (11, 12)]) == 1
    assert [i for i in got if i not in (4, 5, 6, 11, 12)] == [0, 2, 3, 9, 10, 13, 14]


def test_limits_follow_the_threshold():
    assert [f(85) for f in (S.band_of, S.sketch_most, S.equal_least)] == [5, 25, 88]
    assert [f(80) for f in (S.band_of, S.sketch_most, S.equal_least)] == [4, 30, 79]
