import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hornbeam.llm import langid, lm, toxicity
from hornbeam.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
TEXTS = [(1, "the end", "en", "s", 7), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "123 !!", "en", "s", 6), (4, "123 !!", "en", "s", 6), (None, "the end", "en", "s", 7), (5, "über " * 30_000, "de", "s", 0)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def held(i, k):
    return zlib.crc32(str(i).encode()) % k


def test_language_held_out_accuracy(spark):
    got = QUERIES["op3_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (held(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in test) / len(test) > 0.97


def test_language_odd_rows(spark):
    df = spark.createDataFrame(TEXTS, DOCS).withColumn("score", F.lit("clash"))
    net = langid.train(df.select("doc_id", "text", "lang"))
    got = sorted((tuple(r)[:2] for r in langid.predict(df, net).collect()), key=repr)
    assert got == sorted([(1, "en"), (2, "und"), (3, "und"), (4, "und"), (4, "und"), (None, "en"), (5, "de")], key=repr)
    assert langid.train(df.filter("lang IS NULL").select("doc_id", "text", "lang")) is None
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}
    assert langid.predict(df.limit(0), net).count() == 0


def slow_shares(net, window):
    """The network's shares of one window, number by number."""
    e = [net.embed[b].astype(float) for b in window]
    hidden, f = [], 0
    for width in langid.WIDTHS:
        for _ in range(langid.FILTERS):
            at = [sum(float(net.filters[k * langid.EMBED + d, f]) * e[p + k][d] for k in range(width) for d in range(langid.EMBED)) for p in range(langid.WINDOW - langid.WIDE + 1)]
            hidden.append(max(max(at) + float(net.bias[f]), 0.0))
            f += 1
    z = [sum(h * float(net.dense[k, c]) for k, h in enumerate(hidden)) + float(net.out[c]) for c in range(len(net.names))]
    top = [math.exp(x - max(z)) for x in z]
    return [x / sum(top) for x in top]


def test_network_equals_a_plain_convolution(spark):
    texts = [("en", "the quick brown fox and the lazy dog " * 20), ("de", "über den schnellen Fuchs und den faulen Hund " * 20)]
    x = np.concatenate([langid.windows(t.encode()) for _, t in texts])
    y = np.concatenate([np.full(len(langid.windows(t.encode())), k) for k, (_, t) in enumerate(texts)])
    net = langid.fit(x, y, ["en", "de"])
    assert np.allclose(net.shares(x[:3]), [slow_shares(net, w) for w in x[:3]], atol=1e-5)
    # a text's shares are the mean over its windows by their bytes
    w = langid.windows(texts[0][1].encode())
    heavy = np.count_nonzero(w, axis=1)
    want = (net.shares(w) * heavy[:, None]).sum(0) / heavy.sum()
    got = langid.predict(spark.createDataFrame([(1, texts[0][1])], "doc_id long, text string"), net).first()
    assert got.lang_pred == "en" and got.score == pytest.approx(want.max(), abs=1e-5)


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    w, y = rng.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 0, 2, 1])
    many = langid.FILTERS * len(langid.WIDTHS)
    mask = np.ones((langid.WIDE * langid.EMBED, many))
    net = langid.Network(["a", "b", "c"], rng.normal(0, 1, (256, langid.EMBED)), rng.normal(0, 0.2, mask.shape), rng.normal(0, 0.1, many), rng.normal(0, 0.2, (many, 3)), np.zeros(3))
    loss = lambda: -float(np.mean(np.log(net.shares(w)[np.arange(5), y])))
    g = langid.gradients(net, w, y, mask)
    for part in ("embed", "filters", "bias", "dense", "out"):
        a = getattr(net, part)
        for _ in range(6):
            place = tuple(int(rng.integers(0, n)) for n in a.shape) if part != "embed" else (int(w[0, rng.integers(0, 200)]), int(rng.integers(0, langid.EMBED)))
            old = a[place]
            a[place] = old + 1e-6
            up = loss()
            a[place] = old - 1e-6
            down = loss()
            a[place] = old
            assert g[part][place] == pytest.approx((up - down) / 2e-6, abs=2e-5), part


def test_language_trains_on_whole_texts(spark):
    """What tells the languages apart comes at the end of long texts only."""
    r = np.random.default_rng(3)
    noise = lambda: "".join(r.choice(list("mnopqr "), 6000))
    df = spark.createDataFrame([(k, noise() + (" abcabc" if k % 2 else " xyzxyz") * 600, "en" if k % 2 else "de") for k in range(24)], "doc_id long, text string, lang string")
    net = langid.train(df)
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, net).collect()}
    assert all(v == ("en" if k % 2 else "de") for k, v in got.items())


def test_language_of_rows_without_ids(spark):
    """Rows without an id are drawn one by one, not all or none."""
    df = spark.createDataFrame([(None, f"the river number {k} runs", "en") for k in range(400)], "doc_id long, text string, lang string")
    drawn = []
    fit = langid.fit
    try:
        langid.fit = lambda x, y, names: drawn.append(len(x)) or fit(x, y, names)
        langid.train(df, sample=100)
    finally:
        langid.fit = fit
    assert 50 < drawn[0] < 200


def test_windows_cover_every_byte():
    for n in (0, 1, 3, 255, 256, 257, 508, 509, 510, 5000):
        w = langid.windows(bytes(range(1, 251)) * (n // 250 + 1))
        raw = (bytes(range(1, 251)) * (n // 250 + 1))[:n]
        w = langid.windows(raw)
        step = langid.WINDOW - langid.WIDE + 1
        assert b"".join(x[:step].tobytes() for x in w[:-1]) + w[-1].tobytes().rstrip(b"\0") == raw


def test_toxicity_held_out_accuracy(spark):
    got = QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (held(r.doc_id, 5) == 0) and r.predicted == (r.score >= 0.5) for r in got)
    test = [r for r in got if r.held_out]
    assert sum(r.predicted == r.toxic for r in test) / len(test) > 0.95
    assert sum(r.predicted for r in test if r.toxic == 0) <= 0.01 * len(test)


def ngrams(text):
    """The distinct n-grams of characters of a text, as they are."""
    plain = " ".join((text or "").lower().split())
    padded = f" {plain} " if plain else ""
    return {padded[k : k + n] for n in toxicity.ORDERS for k in range(len(padded) - n + 1)}


def test_places_are_those_of_the_ngrams():
    for text in ("", "a", "The  RIVER\nruns é🙂", "\ud800x", "x" * 3000 + " y"):
        seen = {g: None for g in ngrams(text)}
        assert len(np.unique(toxicity.places(text))) == len(seen)
    a = np.unique(toxicity.places("ab cd é🙂 " * 50))
    old, toxicity.PIECE = toxicity.PIECE, 37
    try:
        assert np.array_equal(np.unique(toxicity.places("ab cd é🙂 " * 50)), a)
    finally:
        toxicity.PIECE = old


def test_toxicity_equals_brute_force():
    """The same problem over the n-grams themselves, scaled one by one and solved by plain Newton steps of the primal."""
    docs = [r for r in __import__("pyarrow.parquet", fromlist=["x"]).read_table("/root/testdata/sf0.001/documents.parquet").to_pylist() if r["text"]]
    texts = [" ".join(r["text"].split()[:60]) for r in docs][:160]
    nasty = ["you fool", "nasty liar", "worst idiot", "go away fool"]
    y = np.array([int(k % 3 == 0) for k in range(len(texts))])
    texts = [t + " " + nasty[k % 4] if y[k] else t for k, t in enumerate(texts)]
    names = sorted(set().union(*map(ngrams, texts)))
    index = {g: k for k, g in enumerate(names)}
    x = np.zeros((len(texts), len(names)))
    for k, t in enumerate(texts):
        x[k, [index[g] for g in ngrams(t)]] = 1
    n1, n0, s1, s0 = x[y == 1].sum(0), x[y == 0].sum(0), (y == 1).sum(), (y == 0).sum()
    scale = []
    for a, b in zip(n1, n0):
        table = [[a, b], [s1 - a, s0 - b]]
        g = 2 * sum(o * math.log(o / (sum(row) * (s1, s0)[j] / (s1 + s0))) for row in table for j, o in enumerate(row) if o)
        scale.append(min(g / toxicity.SURE, 1) ** 2)
    every = 1 << toxicity.BITS  # places that no text has are smoothed too
    z1, z0 = n1.sum() + every, n0.sum() + every
    r = (np.log((n1 + 1) / z1) - np.log((n0 + 1) / z0)) * np.clip(scale, 0, None)
    f = np.column_stack([x * r, np.ones(len(y))])
    kernel, sign = f @ f.T, np.where(y == 1, 1.0, -1.0)  # the minimum lies in the span of the texts
    c = np.zeros(len(y))
    for _ in range(100):
        m = kernel @ c
        p = 1 / (1 + np.exp(sign * m))
        step = np.linalg.solve(np.diag(p * (1 - p) * toxicity.COST) @ kernel + np.eye(len(y)), c - toxicity.COST * sign * p)
        c -= step
    weights, intercept = toxicity.fit([toxicity.features(t) for t in texts], y)
    model = toxicity.Model(weights, intercept)
    want = 1 / (1 + np.exp(-(kernel @ c)))
    got = np.array([model.score(t) for t in texts])
    assert np.allclose(got, want, atol=0.01) and ((got >= 0.5) == (want >= 0.5)).all()


def test_toxicity_bounds_and_clashing_columns(spark):
    df = spark.createDataFrame([(k, ("you nasty fool " if k % 2 else "the quiet sea ") * 40, 9) for k in range(200)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    model = toxicity.train(df.withColumn("text", F.concat("text", F.col("doc_id").cast("string"))), labels, chars=20_000)
    got = toxicity.score(df, model)
    assert got.columns == ["doc_id", "score", "predicted"] and all(r.predicted == r.doc_id % 2 for r in got.collect())
    assert toxicity.accepted(df, model).columns == df.columns and toxicity.accepted(df, model).count() == 100
    assert toxicity.score(df.limit(0), model).count() == 0


def test_toxicity_odd_rows(spark):
    words = [(k, "you are a nasty fool and worse" if k % 2 else "the river runs to the quiet sea", "en", "s", 1) for k in range(10, 60)]
    df = spark.createDataFrame(TEXTS + words, DOCS)
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(10, 60)] + [(11, 0, 1), (None, 1, 1), (12, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, labels)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert all(0 <= r.score <= 1 for r in got.values()) and got[2].score == got[3].score
    kept = toxicity.accepted(df, model)
    assert kept.columns == df.columns and kept.count() == df.count() - sum(r.predicted for r in toxicity.score(df, model).collect())
    one = toxicity.train(df, labels.filter("toxic = 0"))
    assert toxicity.score(df, one).filter("predicted = 1").count() == 0
    none = toxicity.train(df.limit(0), labels.limit(0))
    assert toxicity.score(df, none).agg(F.max("score")).first()[0] < 1e-6 and toxicity.accepted(df.limit(0), none).count() == 0


def brute(rows):
    texts = [(i, (t or "").encode().lower().split() + [lm.END]) for i, t in rows]
    trains = [i is None or held(i, 7) != 2 for i, _ in texts]
    one, two, context = collections.Counter(), collections.Counter(), collections.Counter()
    for (_, t), use in zip(texts, trains):
        if use:
            one.update(t)
            for a, b in zip([lm.START, *t], t):
                two[a, b] += 1
                context[a] += 1
    n, v = sum(one.values()), len(one)
    table = lambda t: np.array([(one[b], context[a], two[a, b]) for a, b in zip([lm.START, *t], t)], float)
    seen = np.concatenate([table(t) for (_, t), use in zip(texts, trains) if use] or [np.zeros((0, 3))]) - 1
    e2, e1, e0 = lm._estimates(seen[:, 0], seen[:, 1], seen[:, 2], n - 1, v)
    cells, m = np.unique(lm._bucket(seen[:, 1]) << 18 | lm._step(e2 / e0) << 9 | lm._step(e1 / e0), return_counts=True)
    w = lm.learn(cells, m)
    for (i, t), use in zip(texts, trains):
        x = table(t)
        e2, e1, e0 = lm._estimates(x[:, 0], x[:, 1], x[:, 2], n, v)
        k = w[lm._bucket(x[:, 1])]
        base = sum(math.log10((one[b] + 1) / (n + (v + 1))) for b in t)
        yield i, not use, len(t), sum(one[b] > 0 for b in t), n, base, float(np.log10(k[:, 0] * e2 + k[:, 1] * e1 + k[:, 2] * e0).sum())


@pytest.mark.parametrize("batch", [1 << 23, 3000])
def test_language_model_equals_brute_force(spark, monkeypatch, batch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(r[0] if r[0] is None else r[0] + 900_000, r[1]) for r in TEXTS], "doc_id long, text string"))
    monkeypatch.setattr(lm, "BATCH", batch)
    got = sorted(map(tuple, lm.score_folds(df.repartition(3)).collect()), key=repr)
    want = sorted(brute([tuple(r) for r in df.collect()]), key=repr)
    assert [g[:5] for g in got] == [x[:5] for x in want]
    assert np.allclose([g[5:] for g in got], [x[5:] for x in want], rtol=1e-9)
    test = [g for g in got if g[1]]
    assert sum(g[6] for g in test) > sum(g[5] for g in test)  # better than the base on texts it has not seen


def test_language_model_of_long_texts_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b " * 200_000, 5, "x"), (3, "a", 5, "x"), (3, "a", 5, "x")], "doc_id long, text string, held_out int, payload string")
    got = lm.score_folds(df).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(1, 400_001), (3, 2), (3, 2)] and all(np.isfinite(r.score) for r in got)


def test_language_model_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_folds(df).count() == 0
    i = next(i for i in range(100) if held(i, 7) == 2)
    r = lm.score_folds(spark.createDataFrame([(i, "a b")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)
