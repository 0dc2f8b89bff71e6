import random
import re

import numpy as np

from kontor.llm import secret_cnn as S

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 16]
    return [(S.KINDS[k], s, e) for s, k, e in sorted(out)]


def rows_of(seed, n=120):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 12)):
            value = "".join(rnd.choice("0123456789abcdef") for _ in range(rnd.randint(8, 30)))
            parts.append(rnd.choice([
                "straße", "ſecret=abcdefghijklmnop", "plain words", "漢字", "10.20.30.40.50.60", "ACME2000-2001-2002", "version-1.2.3-beta4",
                f"Token{rnd.choice(['', chr(34)])}{rnd.choice(['=', ' : ', '= '])}{value}", f"API_KEY='{value}x'", f"password={value[:9]}",
                f"token=token:{value}", f"secret=token={value}", "AKIA" + value.upper(), "AKIAAKIA" + value[:9].upper(), value, value + "g" + value]))
        rows.append((i, rnd.choice([" ", "\n", "", "é"]).join(parts)))
    return [*rows, (900, None), (901, ""), (None, "token=abcdefabcdef1"), (5, rows[5][1])]


def test_base_findings_against_re(spark):
    rows = rows_of(1)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, findings int")
    found = S.find_secrets(df)
    got = sorted((str(r.doc_id), [(f.kind, f.start, f.end) for f in r.findings if f.kind != "cnn"]) for r in found.collect())
    assert got == sorted((str(d), brute(t or "")) for d, t in rows)
    for r in S.digest(found).collect():
        assert r.base_sha256 in {S.sha256_of(brute(t or "")) for d, t in rows if d == r.doc_id}
        kept = [x for x in r.spans.split(",") if x and not x.startswith("cnn")]
        assert len(kept) == r.n_assign + r.n_access + r.n_hex


def test_network_tells_secrets_from_other_tokens():
    rnd = np.random.default_rng(1)
    def make(n):
        texts, y = [], []
        for i in range(n):
            if i % 2:
                v = "".join(rnd.choice(list("0123456789abcdef"), 24))
            else:
                v = "-".join(str(rnd.integers(1, 99)) for _ in range(7)) + ".build"
            texts.append(f"some words before {v} and after".encode())
            y.append(i % 2)
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        start, end = S._runs(S._TOKEN[data], offsets, 12)
        codes, of = S.windows(data, offsets, start, end)
        assert len(of) == n
        return codes, np.array(y)
    net = S.train(*make(800))
    codes, y = make(200)
    p = S.probability(net, S.logits(net, S._hidden_context(codes)))
    assert ((p >= 0.5) == y).mean() > 0.97
    assert (p[y == 1] >= net.threshold).mean() >= 0.85      # the wanted recall, but for sampling


def test_every_passage_of_a_long_candidate():
    text = b"x" * 30 + b" " + b"a1" * 100
    codes, of = S.windows(np.frombuffer(text, np.uint8), np.array([0, len(text)]), np.array([31]), np.array([231]))
    assert len(codes) == 5 and set(of) == {0}
    assert codes[4, S.SIDE: S.SIDE + 8].all() and not codes[4, S.SIDE + 8:].any()


def test_empty_table(spark):
    assert S.find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_unkeyed_and_letters_only_secrets_are_found(spark):
    rnd = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    vocab = ["international", "representative", "administration", "self-contained", "straightforward", "and", "the", "plain", "of"]

    def secret():
        return "".join(rnd.choice(letters) for _ in range(24))

    def prose(n):
        return " ".join(rnd.choice(vocab) for _ in range(n))
    rows = [(i, f"{prose(rnd.randint(3, 9))} token={secret()} {prose(rnd.randint(3, 9))}") for i in range(400)]
    planted = {1000 + i: f"{prose(6)} {secret()} {prose(6)}" for i in range(100)}
    df = spark.createDataFrame([*rows, *planted.items()], "doc_id long, text string")
    hits = 0
    for r in S.find_secrets(df).filter("doc_id >= 1000").collect():
        at = next(m for m in re.finditer("[A-Za-z]{24}", planted[r.doc_id]))
        hits += ("cnn", at.start(), at.end()) in {(f.kind, f.start, f.end) for f in r.findings}
    assert hits >= 85


def test_the_threshold_is_the_recall_quantile():
    rng = np.random.default_rng(2)          # passages that say nothing: probabilities of about the share of secrets
    codes, y = rng.integers(1, 90, (600, S.WINDOW)).astype(np.uint8), (rng.random(600) < 0.2).astype(np.int64)
    net = S.train(codes, y, epochs=1)
    held = np.arange(600) % 5 == 0
    p = S.probability(net, S.logits(net, codes[held & (y == 1)]))
    assert (p >= net.threshold - 1e-9).mean() >= S.RECALL and net.threshold < 0.5


def test_the_key_is_cut_out_of_examples():
    text = b"words before token = abcdefabcdef0123 after"
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    start, end, key = S.unkeyed(data, S.base_findings(data, offsets))
    bare = np.frombuffer(b"words before abcdefabcdef0123 after", np.uint8)
    assert (S.windows(data, offsets, start, end, key)[0] == S.windows(bare, np.array([0, len(bare)]), np.array([13]), np.array([29]))[0]).all()


def test_the_network_learns_from_all_passages(spark):
    """Any passage changes the model, also one whose hash is the largest of 3,500: no sample is taken."""
    rnd = random.Random(6)
    def word(n):
        return "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    docs = [(i, f"{word(5)} {word(14)}-{word(6)} {word(4)}") for i in range(3500)] + [(5000 + i, f"token={word(20)}9") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = S.id_and_text(df).mapInArrow(S._examples, "codes binary, known boolean, h long").filter("not known").collect()
    assert len({bytes(r.codes) for r in rows}) == 3500
    last = max((r for r in rows if r.h % 5), key=lambda r: r.h % 2**64)
    with_, without = S.fit(df), None
    for i, text in docs:
        data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
        s, e, known = S.candidates(data, offsets, S.base_findings(data, offsets))
        if not known.any() and S.windows(data, offsets, s, e)[0][0].tobytes() == bytes(last.codes):
            without = S.fit(df.filter(f"doc_id <> {i}"))
    assert without is not None and (with_.emb != without.emb).any()
    again = S.fit(df.repartition(7))
    assert (with_.emb == again.emb).all() and with_.threshold == again.threshold


def test_buckets_with_a_rare_class(spark):
    """Many buckets and few secrets: each bucket has some, and the recall on those kept back holds."""
    rnd = random.Random(7)
    def value(letters, n):
        return "".join(rnd.choice(letters) for _ in range(n))
    docs = [(i, f"see {value('ghijklmnop', 12)}-{value('qrstuvwxyz', 8)} there") for i in range(3000)]
    docs += [(5000 + i, f"set token={value('ABCDEFGHIJ0123456789', 24)} there") for i in range(40)]
    net = S.fit(spark.createDataFrame(docs, "doc_id long, text string"), per_bucket=500)
    texts = [f"set {value('ABCDEFGHIJ0123456789', 24)} there" for _ in range(50)] + [f"see {value('ghijklmnop', 12)}-{value('qrstuvwxyz', 8)} there" for _ in range(50)]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    got = [bool(r) for r in S.findings(net, data, offsets)]
    assert sum(got[:50]) >= 40 and sum(got[50:]) <= 5


def test_calibrated_probabilities_have_the_share_of_secrets():
    rng = np.random.default_rng(3)
    z = rng.normal(0, 2, 20000)
    y = (rng.random(20000) < 1 / (1 + np.exp(-(0.5 * z - 4)))).astype(np.int64)
    cells, n = np.unique(np.stack((S._binned(z), y)), axis=1, return_counts=True)
    net = S._start(4, 2, 1).net
    S._calibrate(net, *cells, n, 0.95)
    p = S.probability(net, z)
    assert abs(p.mean() - y.mean()) < 1e-3 and abs(net.slope - 0.5) < 0.1
    assert (p[y == 1] >= net.threshold).mean() >= 0.95
