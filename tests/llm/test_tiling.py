import random
import time
from collections import Counter

from kontor.llm.tiling import clean, contaminated, tiles


def check(found, a, b, n):
    used_a, used_b = set(), set()
    for i, j, k in found:
        assert a[i: i + k] == b[j: j + k] and k >= n and 0 not in a[i: i + k]
        for x in range(k):
            assert i + x not in used_a and j + x not in used_b
            used_a.add(i + x)
            used_b.add(j + x)
    free = {tuple(b[j: j + n]) for j in range(len(b) - n + 1) if not used_b & set(range(j, j + n))}
    for i in range(len(a) - n + 1):         # nothing of seed length is left unmarked on both sides
        assert used_a & set(range(i, i + n)) or 0 in a[i: i + n] or tuple(a[i: i + n]) not in free
    return len(used_a)


def test_tiles_are_disjoint_equal_and_maximal():
    rnd = random.Random(1)
    for t in range(300):
        top = 4 if t % 2 else 60
        a = [rnd.randint(1, top) for _ in range(rnd.randint(1, 80))]
        b = [rnd.randint(0, top) for _ in range(rnd.randint(0, 100))]
        x = rnd.randint(0, len(a))
        n = min(5, len(a))
        check(tiles(a, b + a[x:] + [0] + a[:x], n), a, b + a[x:] + [0] + a[:x], n)


def test_longest_first():
    a = list(range(1, 41))
    assert tiles(a, a[10:] + [0] + a[:14], 5) == [(10, 0, 30), (0, 31, 10)]


def plain_tiles(a, b, least):
    """The definition: of all pairs of equal free runs the longest, then the first in a, then in b, until none is left."""
    free_a, free_b, out = [w != 0 for w in a], [w != 0 for w in b], []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                    k += 1
                if k >= least and (best is None or k > best[2]):
                    best = (i, j, k)
        if best is None:
            return out
        i, j, k = best
        free_a[i: i + k] = free_b[j: j + k] = [False] * k
        out.append(best)


def test_tiles_equal_the_definition():
    rnd = random.Random(7)
    for t in range(150):
        top = (1, 2, 3, 30)[t % 4]
        a = [rnd.randint(1, top) for _ in range(rnd.randint(1, 30))]
        b = [rnd.choice([0, *range(1, top + 1), *range(1, top + 1)]) for _ in range(rnd.randint(0, 30))] + a[rnd.randint(0, len(a)):]
        n = min(rnd.choice((2, 5)), len(a))
        assert tiles(a, b, n) == plain_tiles(a, b, n)


def test_repeated_words_take_a_pass_over_the_texts():
    t0 = time.perf_counter()
    assert tiles([7] * 100, [7] * 100_000, 5) == [(0, 0, 100)]
    assert tiles([7] * 20_000, [7] * 300, 5) == [(0, 0, 300)]
    got = tiles([7] * 5_000, ([7] * 50 + [0]) * 2_000, 5)
    assert len(got) == 100 and {k for _, _, k in got} == {50}
    check(tiles([1, 2] * 3_000, [2, 1, 1] * 20_000, 2), [1, 2] * 3_000, [2, 1, 1] * 20_000, 2)
    assert time.perf_counter() - t0 < 10


def rows_of(seed):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    def prose(n):
        return [rnd.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(prose(rnd.randint(20, 60)))) for i in range(20)]
    items += [(30, "three short words"), (31, ""), (32, None), (33, items[0][1])]
    docs, want = [], set()
    for d in range(60):
        words = prose(rnd.randint(0, 400))
        kind = d % 4
        if kind:
            i, text = items[rnd.randrange(20)]
            w = text.split()
            if kind == 2:               # sentences in another order
                x = len(w) // 2
                w = [*w[x:], "break", *w[:x]]
            if kind == 3:               # a third of it: not enough
                w = w[: len(w) // 3]
            x = rnd.randint(0, len(words))
            words[x:x] = [z.upper() for z in w]
            if kind < 3:
                want |= {(d, i)} | ({(d, 33)} if i == 0 else set())
        docs.append((d, "\n".join(words)))
    docs += [(100, None), (101, ""), (102, "it has Three  short words"), (102, "other text")]
    return docs, items, want | {(102, 30)}


def test_against_planted_items(spark):
    docs, items, want = rows_of(4)
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, coverage int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    found = contaminated(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert len(clean(d, b).collect()) == len(docs) - len({x for x, _ in want})
    assert clean(d, b).columns == d.columns


def test_against_tiling_of_all_pairs(spark):
    """Every pair by the definition, from the whole texts: repeated words and seeds, ties, copies, short items."""
    rnd = random.Random(11)
    def text(top, n):
        return " ".join(f"w{rnd.randint(1, top)}" for _ in range(n))
    items = [(i, text((2, 6, 40)[i % 3], rnd.randint(1, 14))) for i in range(12)] + [(50, "la " * 12), (51, None), (52, "W1 w2")]
    docs = [(d, text((2, 6, 40)[d % 3], rnd.randint(0, 25))) for d in range(24)]
    docs += [(30, "la " * 40), (31, items[2][1] + " x " + items[5][1]), (31, items[2][1] + " x " + items[5][1]), (32, items[8][1][::-1]), (None, "la " * 9), (33, None)]
    code = {}
    def words(t):
        return [code.setdefault(w, len(code) + 1) for w in (t or "").lower().split()]
    want = Counter()
    for d, t in docs:
        for i, u in items:
            a = words(u)
            got = plain_tiles(a, words(t), min(5, len(a))) if a else []
            if a and sum(k for *_, k in got) / len(a) >= 0.6:
                want[d, i, round(sum(k for *_, k in got) / len(a), 9), len(got), max(k for *_, k in got)] += 1
    found = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter((r.doc_id, r.item_id, round(r.coverage, 9), r.n_tiles, r.longest_tile) for r in found.collect()) == want
    assert len(want) > 20


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(d, b).count() == 0 and clean(d, b).count() == 1
    assert contaminated(d.limit(0), b).count() == 0
