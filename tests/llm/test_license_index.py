import random
import re

from kontor.llm import license_index as L

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
PHRASES = {"apache": ["apache", "license"], "gpl": ["general", "public", "license"], "mit": ["mit", "license"]}


def brute(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at = sorted((i, k) for k, p in PHRASES.items() for i in range(len(w)) if w[i: i + len(p)] == p)
    base = sorted({k for _, k in at})
    found, share = set(base), 1.0 if at else 0.0
    for label, notice, key in L.TEMPLATES:
        n, k = notice.split(), key.split()
        s = next(p for p in range(len(n)) if n[p: p + len(k)] == k)
        for i in range(-len(n), len(w)):
            same = [0 <= i + j < len(w) and w[i + j] == x for j, x in enumerate(n)]
            if all(same[s: s + len(k)]) and sum(same) / len(n) >= L.ENOUGH:
                found.add(label)
                share = max(share, sum(same) / len(n))
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(base), ",".join(sorted(found)), share


def test_against_every_position(spark):
    rnd = random.Random(2)
    filler = "the of is under version to a work Straße überall 漢字 license apache public mit general x-y 3.0 this".split()
    rows = []
    for i in range(150):
        words = [rnd.choice(filler) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 2)):
            notice = rnd.choice(L.TEMPLATES)[1].split()
            if rnd.random() < 0.4:
                notice[rnd.randrange(len(notice))] = "zzz"
            x = rnd.randint(0, len(words))
            words[x:x] = [rnd.choice((str.upper, str.title, str))(z) for z in notice]
        rows.append((i, rnd.choice([" ", "\n", ", "]).join(words)))
    rows += [(900, None), (901, ""), (902, "..."), (None, "MIT License"), (1, rows[1][1]), (903, "mit license " * 3000)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, words int, found string")
    key = lambda r: tuple(str(x) for x in r)
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in L.licenses(df).collect()), key=key)
    want = sorted(((d, *brute(t)[:6], round(brute(t)[6], 9)) for d, t in rows), key=key)
    assert got == want


def test_no_python_in_the_plan_and_empty_table(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    plan = L.licenses(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert L.licenses(df.limit(0)).count() == 0
    assert [tuple(r)[5:] for r in L.licenses(df).collect()] == [("mit", "mit", 1.0)]


def test_many_notices_and_stray_rare_words(spark):
    """Three to six notices in one text, with rare words in prose around them."""
    rnd = random.Random(5)
    stray = "mozilla commons binary redistribution attribution gnu person obtaining released granted the of under".split()
    rows = []
    for i in range(80):
        words = [rnd.choice(stray) for _ in range(rnd.randint(0, 40))]
        for _, notice, _ in rnd.sample(L.TEMPLATES, rnd.randint(3, 6)):
            x = rnd.randint(0, len(words))
            words[x:x] = ["plain", *notice.split(), "plain"]
        rows.append((i, " ".join(words)))
    rows.append((500, " ".join(["mozilla commons binary redistribution gnu"] * 4000 + [L.TEMPLATES[4][1]])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in L.licenses(df).collect()}
    assert got == {d: brute(t) for d, t in rows}


def test_index_words_missing(spark):
    """A notice is found with any of the words gone that it may lack, its rarest ones too."""
    rows, i = [], 0
    for label, notice, key in L.TEMPLATES:
        words, (a, b) = notice.split(), L._key_span(i)
        i += 1
        free = [p for p in range(len(words)) if not a <= p < b]
        for seed in range(6):
            gone = set(random.Random(seed).sample(free, min(len(free), L._spare(len(words)))))
            rows.append((len(rows), label, "x " + " ".join("zzz" if p in gone else w for p, w in enumerate(words))))
    rows += [(len(rows) + k, None, w) for k, w in enumerate(["permission granted charge", "of the license is in a", ""] * 40)]
    got = {r.doc_id: r.labels.split(",") for r in L.licenses(spark.createDataFrame([(d, t) for d, _, t in rows], "doc_id long, text string")).collect()}
    assert len(L.TEMPLATES) > 16 and all(label is None or label in got[d] for d, label, _ in rows)
