import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hornbeam.llm import bpe, importance, queries, vectorcodes
from tests.conftest import rows
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "\n\n  x", "a<|endoftext|> b  <|endoftext|>", "I'll we've 's ''s", "x1½²三 ٣", "日本語🙂 é" * 2000, "z" * 20_000, "-=" * 700, "a\0b\x1c\x85　c", "՘₏\U0001246f a", " " * 5000 + "a"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.model_path())


def want_of(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


@pytest.fixture(scope="module")
def own():
    return bpe.ByteBPE(bpe.model_path())


def assert_equal(own, library, texts):
    ids, n = own.encode(texts)
    ends = np.cumsum(n)
    for text, a, b in zip(texts, ends - n, ends):
        want, back = want_of(library, text)
        assert ids[a:b].tolist() == want and own.decode(ids[a:b]) == back == (text or ""), repr(text)[:80]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab the'sldre \t\n　\x85 12½三é…🙂<|endoftext|>՘"), max_size=60) | st.text(max_size=20), max_size=5))
def test_bpe_equals_the_library(own, library, texts):
    assert_equal(own, library, texts)


def test_bpe_of_every_character(own, library):
    codes = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    for x in ("a", "1", "!"):
        some = ["".join(f"{x}{c}{x} " for c in codes[k : k + 4000]) for k in range(0, 200_000, 4000)]
        ids, n = own.encode(some)
        assert n.tolist() == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]
        own.forget()


def test_bpe_pieces_and_long_words(own, library, monkeypatch):
    rnd = random.Random(5)
    letters = "".join(rnd.choice("etaoinshrdlu") for _ in range(30_000))
    assert_equal(own, library, [letters, letters[:300] * 5, *ODD])
    monkeypatch.setattr(bpe, "CHUNK", 7)
    monkeypatch.setattr(bpe, "LONG", 5)
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    monkeypatch.setattr(bpe, "TOKENS", 3)
    for k in range(3):
        assert_equal(own, library, [letters[k * 50 : k * 50 + 500], "the other day's  work \n is done " * 30, *ODD[:7]])


def test_bpe_query_and_odd_rows(spark, library):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1 - k, t) for k, t in enumerate(ODD)], "doc_id long, text string"))
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in df.collect():
        ids, back = want_of(library, r.text)
        want[r.doc_id] = (len(ids), hexed(",".join(map(str, ids))), hexed(back))
    assert {r.doc_id: tuple(r)[1:] for r in bpe.digests(bpe.encode(df)).collect()} == want
    assert queries.QUERIES["op11_bpe_round_trip"](spark, SF).schema.simpleString() == "struct<doc_id:bigint,n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"
    odd = spark.createDataFrame([(None, "the end", 1), (1, "the end", 1), (1, "the end", 1), (2, None, 1)], "doc_id long, text string, ids int")
    got = bpe.encode(odd)
    assert rows(bpe.decode(got)) == rows(odd.select("doc_id", F.coalesce("text", F.lit(""))))
    assert rows(bpe.encode(odd.limit(0))) == [] == rows(bpe.decode(got.limit(0)))
    strange = spark.createDataFrame([(1, [50256, None, 999_999, -1, 64]), (2, None), (3, [160])], "doc_id long, ids array<int>")
    assert rows(bpe.decode(strange)) == sorted([(1, "<|endoftext|>a"), (2, None), (3, "�")], key=repr)


def test_bpe_refuses_other_models():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.ByteBPE(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 70), st.integers(1, 4), st.integers(0, 6), st.integers(0, 10_000))
def test_kd_tree_equals_all_distances(n, width, spread, seed):
    rng = np.random.default_rng(seed)
    entries, x = rng.integers(-spread, spread + 1, (n, width)), rng.integers(-spread - 1, spread + 2, (200, width))
    apart = ((x[:, None] - entries[None]) ** 2).sum(2)
    number, best = vectorcodes.KDTree(entries).nearest(x)
    assert (number == apart.argmin(1)).all() and (best == apart.min(1)).all()


def test_vector_code_query(spark):
    assert compare(spark, connect(SF), queries.QUERIES["op12_vector_codes"], queries.ORACLES["op12_vector_codes"], SF) > 0


def brute_codes(vectors, parts, entries, rounds):
    """vectors: (id, integers) in order -> codes, errors, books."""
    w = len(vectors[0]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for v in vectors]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        got = [[near(p, c[p])[1] for p in range(parts)] for c in cut]
        new = [list(b) for b in books]
        for p in range(parts):
            for k in range(len(books[p])):
                if mine := [c[p] for c, g in zip(cut, got) if g[p] == k]:
                    new[p][k] = [sum(col) // len(mine) for col in zip(*mine)]
        books = new
    last = [[near(p, c[p]) for p in range(parts)] for c in cut]
    return ["".join(f"{k:02x}" for _, k in x) for x in last], [sum(d for d, _ in x) for x in last], books


@pytest.mark.parametrize("labels", [100_000, 0])
def test_vector_codes_equal_brute_force(spark, monkeypatch, labels):
    monkeypatch.setattr(vectorcodes, "LABELS", labels)  # 0: joined by shuffle
    rng = np.random.default_rng(3)
    data = [(i, (rng.integers(-9, 9, 8) / 2).tolist(), [None, "a", "b"][i % 3]) for i in range(60)]
    data[20:30] = [(i, data[0][1], "a") for i in range(20, 30)]  # ties
    whole = [[math.floor(256 * x) for x in v] for _, v, _ in data]
    codes, errors, books = brute_codes(whole, 4, 16, 2)
    bad = [(100, None, "a"), (101, [1.0] * 7 + [None], "a"), (102, [float("nan")] + [0.0] * 7, None), (103, [float("inf")] * 8, "z")]
    df = spark.createDataFrame(random.Random(1).sample(data + bad, len(data) + len(bad)), "vec_id long, embedding array<double>, label string").withColumn("code", F.lit("clash"))
    got = {r.vec_id: r for r in vectorcodes.compress(df.repartition(3), 4, 16).collect()}
    total = Counter()
    for (_, _, label), e in zip(data, errors):
        total[label] += e
    assert len(got) == 60
    for (i, _, label), code, error in zip(data, codes, errors):
        assert (got[i].code, got[i].error, got[i].label_error) == (code, error, total[label])
    flat = ",".join(str(x) for b in books for e in b for x in e)
    assert {r.codebooks_sha256 for r in got.values()} == {hashlib.sha256(flat.encode()).hexdigest()}
    v = vectorcodes.kept(df)
    back = {r.vec_id: r.vector for r in vectorcodes.decoded(vectorcodes.encoded(v, vectorcodes.codebooks(v, 4, 16)), np.array(books)).collect()}
    for (i, *_), code, error, q in zip(data, codes, errors, whole):
        assert sum((256 * a - b) ** 2 for a, b in zip(back[i], q)) == error


def test_vector_codes_of_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    df = spark.createDataFrame([(1, [1.0] * 16, None), (1, [1.0] * 16, None), (None, [0.0] * 16, 2), (3, [-0.001] * 16, None)], schema)
    got = sorted(vectorcodes.compress(df).collect(), key=repr)
    assert [r.error for r in got] == [0] * 4 and sorted((r.vec_id or 0, r.code[:2]) for r in got) == [(0, "03"), (1, "00"), (1, "00"), (3, "02")]
    assert vectorcodes.compress(df.limit(0)).count() == 0 == vectorcodes.compress(df.filter("vec_id > 5")).count()
    for odd in ([1.0] * 15, [1e30] * 16):
        with pytest.raises(Exception):
            vectorcodes.compress(spark.createDataFrame([(1, odd, 1)], schema)).collect()
    with pytest.raises(Exception, match="components"):
        vectorcodes.compress(spark.createDataFrame([(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)], schema)).collect()


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("abZ9é日 _-\n\0"), max_size=200) | st.text(max_size=40), st.integers(1, 9))
def test_features_are_checksums_of_word_runs(text, together):
    own = importance.Features()
    importance.TOGETHER, kept = together, importance.TOGETHER
    try:
        got = [pair for a, b in own.of([text, None, text[:9], "a b"]) for pair in zip(a.tolist(), b.tolist())]
    finally:
        importance.TOGETHER = kept
    assert sorted(got) == sorted((k, b) for k, t in enumerate([text, None, text[:9], "a b"]) for b in plain_features(t)[1])


def test_features_of_long_words_and_texts(monkeypatch):
    text = " ".join(["x" * n for n in (1, 63, 64, 65, 128, 129, 5000)] * 3 + ["é" * 40])
    for chunk, remembered in ((1 << 20, 500_000), (50, 1)):
        monkeypatch.setattr(importance, "CHUNK", chunk)
        monkeypatch.setattr(importance, "REMEMBERED", remembered)
        own = importance.Features()
        for _ in range(2):
            assert sorted(np.concatenate([b for _, b in own.of([text])]).tolist()) == sorted(plain_features(text)[1])


def brute_resample(docs, target):
    s, t = Counter(), Counter()
    for d in docs:
        s.update(plain_features(d[1])[1])
    for x in target:
        t.update(plain_features(x)[1])
    ns, nt, out = sum(s.values()), sum(t.values()), []
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (ns + 10_000.0) / ((s[b] + 1.0) * (nt + 10_000.0)))) for b in range(10_000)]
    for i, text in docs:
        words, features = plain_features(text)
        weight = sum(gain[b] for b in features)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def test_resampling_equals_brute_force(spark):
    rnd = random.Random(9)
    docs = [(i, " ".join(rnd.choice("red green blue stone river éa 7 x_y A-b".split()) for _ in range(rnd.choice([3, 15, 20, 25, 200])))) for i in range(400)]
    docs += [(500, None), (501, ""), (502, "!" * 100), (None, docs[0][1] * 3), (503, "long " * 50_000)]
    target = ["red river stone", None, "blue blue river 7", ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("n", F.lit(1))
    got = rows(importance.resample(df.repartition(3), spark.createDataFrame([(x,) for x in target], "text string")))
    assert got == brute_resample(docs, target)
    assert rows(importance.resample(df.limit(0), df)) == []
    assert rows(importance.resample(df, df.limit(0))) == brute_resample(docs, [])


@pytest.mark.parametrize("bins,block", [(1024, 1 << 20), (1, 1), (3, 7), (10**9, 4)])
def test_ranks_of_ties(spark, bins, block):
    rnd = random.Random(4)
    data = [(rnd.choice([None, *range(200)]), rnd.choice([5, 20, 30]), rnd.choice([-(10**9), 0, 0, 1, 1, 1, 2, 10**9])) for _ in range(600)]
    got = importance.ranked(spark.createDataFrame(data, "doc_id long, n_words long, score long"), percent=50, bins=bins, block=block).collect()
    able = sorted(((-s, i is None, i or 0) for i, n, s in data if n >= 20))
    taken = able[: len(able) // 2]
    mine = sorted((r.rank, -r.score, r.doc_id is None, r.doc_id or 0) for r in got if r.rank is not None)
    assert [r[0] for r in mine] == list(range(1, len(taken) + 1)) and [r[1:] for r in mine] == taken and len(got) == 600


def test_resampling_query(spark):
    assert compare(spark, connect(SF), queries.QUERIES["op13_importance_resampling"], queries.ORACLES["op13_importance_resampling"], SF) > 0
