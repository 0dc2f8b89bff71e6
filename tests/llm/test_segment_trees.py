import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kontor.llm import registry as R
from kontor.llm import segment_trees as S
from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int"


def brute(rows, min_docs, top):
    """rows: (text, lang, source)."""
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), a or "", s or "") for t, a, s in rows]
    out = []
    for lang in {a for _, a, _ in docs}:
        own = [(t, s) for t, a, s in docs if a == lang]
        seen = Counter(w for t, _ in own for w in set(t))
        kept = sorted(w for w, c in seen.items() if c >= min_docs)
        count = defaultdict(Counter)
        for t, s in own:
            count[s].update(w for w in t if seen[w] >= min_docs)
        whole = sum(count.values(), Counter())
        p = {s: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept} for s, c in [*count.items(), (None, whole)]}
        for s in count:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in count if o != s]
            terms = [(p[s][w] - p[None][w], w) for w in kept if count[s][w] and p[s][w] > p[None][w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(items[:most], 1)]
    return sorted(out)


def sample(seed, n, sources=9, vocabulary=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abÄé漢Z") for _ in range(rnd.randint(1, 4))) for _ in range(vocabulary)]
    rows = []
    for _ in range(n):
        s = rnd.randrange(sources)
        text = rnd.choice([" ", "1", "_-", "\n"]).join(rnd.choices(words[: 5 + 6 * s], k=rnd.randint(0, 30)))
        rows.append((text, rnd.choice(["en", "en", "de", None]), rnd.choice([f"s{s}", f"s{s}", "s0", None])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, a, s, "x", 1) for i, (t, a, s) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("entries,tile", [(S.ENTRIES, S.TILE), (40, 3), (7, 1)])
def test_audit_against_python(spark, entries, tile):
    rows = sample(1, 300) + [(None, "en", "empty"), ("", "fr", "a"), ("12", "fr", "b"), ("x", "fr", "b"), (None, None, None)] + [("same words here", "xx", "one")] * 40
    got = S.audit(frame(spark, rows), min_docs=8, top=5, entries=entries, tile=tile).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 8, 5)


def test_query_against_sql_and_python(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    out = R.QUERIES["op13_segment_trees"](spark, SF_SMALL)
    got = sorted(tuple(r) for r in out.select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute([(r.text, r.lang, r.source) for r in docs], 30, 50)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    assert got == sorted(tuple(r) for r in con.execute(f"SELECT lang, source, part, item, value, rank FROM ({R.ORACLE_SQL['op13_segment_trees']})").fetchall())


def test_edges(spark):
    assert S.audit(frame(spark, [("a", "en", "s")]).limit(0)).collect() == []
    assert S.audit(frame(spark, [("a", "en", "s")])).collect() == []
    two = S.audit(frame(spark, [(None, "en", "s"), ("a b", "en", "t")])).collect()          # nothing is kept: V = 0
    assert sorted(tuple(r) for r in two) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
    long = [("Ab c " * 200_000, "en", "s")] * 2 + [("c", "en", "t")] * 2
    assert sorted(tuple(r) for r in S.audit(frame(spark, long), min_docs=2).collect()) == brute(long, 2, 50)


def test_trees_share_and_price_once():
    rng = np.random.default_rng(4)
    leaves = rng.integers(0, 3, (6, 64)) * (rng.random((6, 64)) < 0.2)
    values, levels, roots = S.hash_cons(leaves)
    # as many nodes a level as there are distinct subtrees
    for k, (left, _) in enumerate(levels, 1):
        assert len(left) == len({tuple(row[i: i + 2**k]) for row in leaves.tolist() for i in range(0, 64, 2**k)})
    assert len(set(roots)) == len({tuple(r) for r in leaves.tolist()})
    size = np.array([500, 500, 900, 7000, 10**15, 12])
    a, b = np.triu_indices(6, 1)
    got = S.distances((values, levels, roots), size, a, b)
    p = [[1 + 10**9 * (int(c) + 5) // int(s) for c in row] for row, s in zip(leaves, size, strict=True)]
    assert got.tolist() == [sum(abs(x - y) for x, y in zip(p[i], p[j], strict=True)) for i, j in zip(a, b, strict=True)]


def test_share_is_exact(spark):
    rnd = random.Random(5)
    rows = [(rnd.randrange(10 ** rnd.randint(1, 15)), rnd.randrange(1, 9 * 10 ** rnd.randint(1, 15))) for _ in range(500)]
    want = [1 + 10**9 * (c + 5) // s for c, s in rows if c + 5 <= s]
    rows = [(c, s) for c, s in rows if c + 5 <= s]
    assert S.share(np.array([c for c, _ in rows]), np.array([s for _, s in rows])).tolist() == want
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, c long, s long").select("i", F.expr(S._share_sql("c", "s")).alias("p")).orderBy("i")
    assert [r.p for r in got.collect()] == want
