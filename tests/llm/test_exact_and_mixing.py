import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest

from kontor.llm import exact, mixing
from kontor.llm import registry as R
from tests.conftest import SF_SMALL


def rows_for_exact():
    rnd = random.Random(1)
    base = ["".join(rnd.choice("ab é\n\t") for _ in range(rnd.randint(0, 400))) for _ in range(15)]
    rows = []
    for i in range(90):
        t = rnd.choice(base)
        x = rnd.randint(0, len(t))
        rows.append((i, t[:x] + rnd.choice(["", " ", "\n\n", "b", " "]) + t[x:]))
    return [*rows, (500, None), (501, ""), (502, " \n"), (None, base[0]), (7, rows[7][1]), (7, "other text")]


def test_exact_against_python(spark):
    rows = rows_for_exact()
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, key string, row int")
    out = exact.dedup(df).collect()
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d if d is not None else 0))
    want = []
    for g in groups.values():
        best = min(g)
        keep = None if best[1] else best[2]
        want += [(str(None if x[1] else x[2]), str(keep), len(g)) for x in g]
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in out) == sorted(want)
    assert sum(r.kept for r in out) == len(groups)


def test_exact_keeps_one_of_each(spark):
    rows = rows_for_exact()
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, key string")
    left = exact.keep_first(df)
    assert left.columns == df.columns
    norm = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in left.collect()]
    assert len(norm) == len(set(norm)) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows})


def test_exact_plan_has_no_python(spark):
    plan = exact.dedup(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def water_fill(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            break
        level = (total - sum(most * sizes[s] for s in capped)) / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > most * sizes[s] + 1e-9}
        if not over:
            break
        capped |= over
    return {s: most * sizes[s] if s in capped else w[s] * level for s in names}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_against_python(spark, seed):
    rnd = random.Random(seed)
    sources = [None, "", "a", "b", "é", "z", "Z", "tiny", "empty"]
    rows = [(i, rnd.choice([None, "", "x " * rnd.randint(0, 50)]) if s != "empty" else "  ", s)
            for i, s in enumerate(rnd.choices(sources, [3, 1, 30, 5, 5, 5, 60, 0.5, 1], k=800))]
    rows += [(None, "one two", "a"), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame([(d, t, s, "old", 1) for d, t, s in rows], "doc_id long, text string, source string, size string, h int")
    out = mixing.mix(df).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    goal, taken = water_fill(dict(sizes)), defaultdict(int)
    assert len(out) == len(rows)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 50        # within half of the largest document
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted((str(r.doc_id), r.taken) for r in again) == sorted((str(r.doc_id), r.taken) for r in out)


def test_mix_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


@pytest.mark.parametrize("name", sorted(R.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    res = con.execute(R.ORACLE_SQL[name])
    cols = [c[0] for c in res.description]
    order = sorted(cols)
    want = sorted(tuple(r[cols.index(c)] for c in order) for r in res.fetchall())
    df = R.QUERIES[name](spark, SF_SMALL)
    assert sorted(df.columns) == order
    assert sorted(tuple(r[c] for c in order) for r in df.collect()) == want


def test_digest_is_of_the_normalised_text(spark):
    r = R.op5_exact_dedup(spark, SF_SMALL).orderBy("doc_id").first()
    text = spark.read.parquet(f"{SF_SMALL}/documents.parquet").filter(f"doc_id = {r.doc_id}").first().text
    assert r.text_sha256 == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text).encode()).hexdigest()
