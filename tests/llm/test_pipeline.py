import random

import pytest

import corpus_pipeline as P
from tests.llm.test_superminhash import brute as near_brute

INSULTS = "grumbol zwackel plonk"


def write_tables(spark, folder, rows, bench, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def tables(seed=1):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefghilmnorstué") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]

    def prose(n):
        return [rnd.choice(vocab) for _ in range(n)]
    rows, labels, fate = [], [], {}
    bench = [(i, " ".join(prose(30))) for i in range(5)] + [(9, None)]

    def add(words, what, sep=" "):
        i = len(rows)
        rows.append((i, sep.join(words), "en", rnd.choice(["a", "b", "c", "a", "a"]), 0))
        labels.append((i, 1, int(what == "toxic")))
        fate[i] = what
        return i
    for _ in range(150):
        add(prose(rnd.randint(40, 200)), "clean")
    for _ in range(60):
        w = prose(rnd.randint(40, 120))
        for _ in range(3):
            w.insert(rnd.randrange(len(w)), rnd.choice(INSULTS.split()))
        add(w, "toxic")
    originals = [add(prose(120), "clean") for _ in range(10)]
    for o in originals:
        w = rows[o][1].split()
        add(w, "copy", "\n")
        near = list(w)
        near[60] = "changed"
        add(near, "near")
    for i in range(5):
        w = prose(100)
        w[50:50] = bench[i][1].split()
        add(w, "leak")
    return rows, bench, labels, fate


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    rows, bench, labels, fate = tables()
    write_tables(spark, folder, rows, bench, labels)
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/stage{i}")
        docs = spark.read.parquet(f"{folder}/stage{i}")
        kept.append(docs)
    return rows, fate, kept, folder


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_planted_documents_go_at_their_stage(run):
    rows, fate, kept, _ = run
    before = set(fate)
    clean = {i for i, f in fate.items() if f == "clean"}
    for df, what in zip(kept, ("toxic", "copy", "near", "leak"), strict=False):
        gone = before - ids(df)
        bad = {i for i, f in fate.items() if f == what}
        assert len(gone & clean) <= (6 if what == "toxic" else 0)
        assert len(bad & before - gone) <= (6 if what == "toxic" else 0)
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        before = ids(df)


def test_near_stage_against_all_pairs(run):
    _, _, kept, _ = run
    given = [(r.doc_id, r.text) for r in kept[1].collect()]
    assert ids(kept[2]) == {int(d) for d, _, _, stays in near_brute(given) if stays}


def test_mix_of_what_is_left(run):
    _, _, kept, _ = run
    text = {r.doc_id: r.text for r in kept[3].collect()}
    for r in kept[4].collect():
        assert r.text == text[r.doc_id] and r.taken == r.repeats * len(r.text.split()) and 1 <= r.repeats <= 3


def test_edge_cases_and_empty_tables(spark, tmp_path):
    rows, bench, labels, _ = tables(2)
    extra = [(None, "a text without an id", None, None, None), (7001, None, "en", "a", 0), (7002, "", "en", None, 0), rows[0], rows[0],
             (7003, "x " * 30000, "en", "b", 1)]
    odd = [(*r, 1, "s", 2, 3, 4, 5, 6, 7, 8, True) for r in rows + extra]
    schema = ("doc_id long, text string, lang string, source string, n_chars long, score int, row_key string, "
              "rounds int, below int, s int, __h int, __k int, __key int, k0 int, stays boolean")
    write_tables(spark, f"{tmp_path}/a", rows, bench, [*labels, (None, None, None)])
    docs = spark.createDataFrame(odd, schema)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, f"{tmp_path}/a")
        assert out.columns == docs.columns and 0 < out.count() <= len(odd)
    mixed = P.STAGES[-1][1](spark, docs, f"{tmp_path}/a")
    assert mixed.count() > 0 and set(docs.columns) <= set(mixed.columns)
    write_tables(spark, f"{tmp_path}/b", [], [], [])
    assert P.run(spark, f"{tmp_path}/b").count() == 0


def test_near_stage_takes_similarities_of_080_to_085(spark, tmp_path):
    rnd = random.Random(8)
    rows = []
    for _ in range(60):                 # one changed word of 50 to 60: 0.80 to 0.84; of 45: 0.78
        for n in (45, 50, 55, 60):
            w = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
            near = list(w)
            near[n // 2] = "changed"
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(near))]
    want = {int(d) for d, _, _, stays in near_brute(rows, 80) if stays}
    assert len(want) == 300 and len([1 for *_, stays in near_brute(rows) if stays]) == 480
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ids(P.drop_near_copies(spark, docs, str(tmp_path))) == want
