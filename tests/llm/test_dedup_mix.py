import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from hornbeam.llm import decontaminate, graphs, mixing, simhash, substring
from hornbeam.llm.queries import ORACLES, QUERIES
from tests.conftest import rows
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids or range(1, len(texts) + 1), texts)], DOCS)


@pytest.mark.parametrize("name", ["op2_mix_sources", "op7_decontaminate"])
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF) > 0


def test_mix_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (None, "c", None), (3, "", "empty"), (4, "d " * 5000, "y")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None)], "doc_id long, quality int")
    got = mixing.mix_documents(df.withColumn("size", F.lit("clash")), labels).collect()
    assert len(got) == 6 and sum({r.source: r.target for r in got}.values()) == pytest.approx(1.5 * sum(r.size for r in got))
    assert all(0 <= r.taken <= 2 * r.size for r in got) and {r.source_size for r in got if r.source == "empty"} == {0}
    assert mixing.mix_documents(df.limit(0), labels.limit(0)).count() == 0


def test_mix_comes_near_its_targets(spark):
    r = random.Random(5)
    data = [(k, "w " * r.randint(1, 40), f"s{k % 7}" if k % 3 else "hot") for k in range(4000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 4000, 3)], "doc_id long, quality int")
    one, two = (rows(mixing.mix_documents(df.repartition(n), labels)) for n in (2, 5))
    assert one == two
    by = {}
    for _, _, _, target, taken, source in one:
        by.setdefault(source, [target, 0])[1] += taken
    assert all(abs(a - b) <= 40 for a, b in by.values())


def test_mix_of_odd_weights(spark):
    data = [(k, "s", 1, w) for k, w in enumerate([0.0, -3.0, float("nan"), None, 2.0, 0.01] * 50)]
    df = spark.createDataFrame(data, "doc_id long, source string, size long, weight double")
    got = {r.doc_id: r.taken for r in mixing.mix(df, share=0.5, most=1.0).collect()}
    assert sum(got.values()) == 150  # half of all sizes
    taken = lambda *ws: sum(got[k] for k, _, _, w in data if w in ws or (w != w and "nan" in ws))
    assert taken(0.0, -3.0) == 0 and taken(2.0) > taken(0.01)


def test_mix_ranges_part_small_weights_too(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("size"), F.when(F.col("id") % 2 == 0, 0.01).otherwise(1.0).alias("weight"))
    key = mixing.key_of(F.col("doc_id"), F.col("weight"), "mix")
    ranges = df.select(F.floor(F.log2(key) * mixing.OCTAVE).alias("r")).groupBy("r").count()
    assert ranges.agg(F.max("count")).first()[0] < 60
    assert sum(r.taken for r in mixing.mix(df, share=0.3, most=1.0).collect()) == 6000


def test_targets_stop_at_their_limits(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10), (None, 500)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 20 and got["c"] == 20 and sum(got.values()) == pytest.approx(1.5 * 1520) and got[None] == 1000 and got["b"] == pytest.approx(1240)


def classes_by_force(pairs):
    fp = {i: simhash.fingerprint(t) for i, t in pairs}
    root = {i: i for i in fp}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(fp):
        for b in sorted(fp):
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (fp[i], top(i)) for i in fp}


@pytest.mark.parametrize("shard", [4096, 2])
def test_simhash_equals_brute_force(spark, shard):
    base = words(400, 1)
    texts = [" ".join(base)] * 3 + [" ".join([*base[:k], "X", *base[k + 1 :]]) for k in range(0, 400, 25)] + ["", None, " \n", "one", "ONE", "one two"] + [" ".join(words(40, s)) for s in range(30)]
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.classes(docs(spark, texts), shard=shard).collect()}
    assert got == classes_by_force(list(enumerate(texts, 1)))
    assert len({c for _, c in got.values()}) < len(texts)


def test_simhash_fingerprint_by_its_definition():
    from xxhash import xxh64_intdigest

    text = "A b\tC d\x0be é\n" * 7
    w = text.encode().lower().split()
    hs = [xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(len(w) - 3)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=60), st.integers(0, 20))
def test_bk_tree(values, radius):
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:5]:
        assert sorted(tree.near(q, radius)) == sorted({v for v in values if (v ^ q).bit_count() <= radius})


def test_block_choices_miss_nothing():
    r = random.Random(3)
    for n in (10, 1 << 20, 1 << 30):
        masks = simhash._choices(n, 4)
        for _ in range(300):
            x = r.getrandbits(64)
            y = x ^ sum(1 << b for b in r.sample(range(64), 4))
            assert any(x & m == y & m for m in masks)


def test_keep_one(spark):
    df = docs(spark, ["same text"] * 3 + ["other"] + ["alone"] * 2 + [None, "same text"], [5, 3, 9, 4, 7, 7, 8, None])
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([3, 4, 7, 8, None], key=repr)
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_keep_one_tells_texts_of_one_id_apart(spark):
    copies, alone = " ".join(words(50, 1)), " ".join(words(50, 2))
    df = docs(spark, [copies, copies, alone, alone], [3, 7, 7, 7]).withColumn("mark", F.lit("kept")).withColumn("fp", F.lit("kept")).withColumn("component_id", F.lit(0))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(3, copies), (7, alone)])
    long_ = " ".join(words(200_000, 3))
    assert simhash.keep_one(docs(spark, [long_, long_ + " x", None], [1, 2, 3])).count() == 2


def test_skewed_join(spark, monkeypatch):
    from hornbeam.llm import common

    monkeypatch.setattr(common, "FREQUENT", 10)
    big = spark.range(3000).select((F.when(F.col("id") < 2000, 1).otherwise(F.col("id"))).alias("k"), "id")
    small = big.groupBy("k").agg(F.count("*").alias("n")).withColumn("x", F.col("k") * 2)
    got = common.skewed_join(big, small, "k", "n")
    assert got.count() == 3000 and got.filter("x <> 2 * k").count() == 0
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_only_local_sessions_make_their_own_folder(spark):
    from hornbeam.llm import common

    assert [common.is_local(m) for m in ("local", "local[4]", "local[*]", "local-cluster[2,1,1024]", "spark://x:7077", "yarn")] == [True, True, True, False, False, False]


def jaccard(a, b):
    one, two = ({tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in (a, b))
    return len(one & two) / len(one | two)


@pytest.mark.parametrize("shard", [4096, 3])
def test_keep_alike_finds_near_copies_and_leaves_others(spark, shard):
    r = random.Random(8)
    texts, pairs = [], []
    for k in range(80):
        w = words(r.randint(120, 400), 3000 + k)
        v = list(w)
        for place in r.sample(range(len(w)), max(1, round(len(w) * r.uniform(0.002, 0.022)))):
            v[place] = words(1, 50_000 + 500 * k + place)[0]
        if jaccard(" ".join(w), " ".join(v)) >= simhash.ALIKE:
            pairs.append((len(texts) + 1, len(texts) + 2))
        texts += [" ".join(w), " ".join(v)]
    alone = [" ".join(words(200, 9000 + k)) for k in range(100)] + ["one", "one two", "a b c d", "a b c e"]
    half = words(300, 7)  # half alike is not alike
    alone += [" ".join(half), " ".join(half[:150] + words(150, 8))]
    copies = ["Same TEXT here and there again", "same text here and there again", None, "", " "]
    df = docs(spark, texts + alone + copies)
    kept = {x.doc_id for x in simhash.keep_alike(df, shard=shard).collect()}
    n, m = len(texts), len(texts) + len(alone)
    assert len(pairs) > 40 and sum(b not in kept for _, b in pairs) >= 0.9 * len(pairs)
    assert kept >= set(range(n + 1, m + 1)) and kept & set(range(m + 1, m + 6)) == {m + 1, m + 3}
    assert all(a in kept or a - 1 in kept for a in range(1, n + 1))
    assert simhash.keep_alike(df.limit(0)).count() == 0 and simhash.keep_alike(df).columns == df.columns


@pytest.mark.parametrize("shard", [1, 16])
def test_large_shards_lose_no_more_pairs_than_small_ones(spark, shard):
    """300 pairs at a similarity of 0.80 to 0.82, and every shard over the limit."""
    r, texts = random.Random(8), []
    vocabulary = [f"w{k}" for k in range(5000)]
    while len(texts) < 600:
        w = [r.choice(vocabulary) for _ in range(300)]
        v = list(w)
        for place in r.sample(range(300), 7):
            v[place] = r.choice(vocabulary)
        if 0.8 <= jaccard(" ".join(w), " ".join(v)) <= 0.82:
            texts += [" ".join(w), " ".join(v)]
    kept = {x.doc_id for x in simhash.keep_alike(docs(spark, texts), shard=shard).collect()}
    assert sum(k not in kept for k in range(2, 601, 2)) >= 0.93 * 300 and kept >= set(range(1, 601, 2))


def test_wide_fingerprints_are_as_far_apart_as_the_sets():
    base = words(3000, 1)
    for share in (0.005, 0.02):
        r = random.Random(3)
        other = list(base)
        for place in r.sample(range(3000), round(3000 * share)):
            other[place] = words(1, 10_000 + place)[0]
        j = jaccard(" ".join(base), " ".join(other))
        a, b = (int.from_bytes(simhash.wide_fingerprint(" ".join(t)), "little") for t in (base, other))
        assert abs((a ^ b).bit_count() - 256 * simhash.share_of_bits(j)) < 20
    assert simhash.wide_fingerprint(None) == simhash.wide_fingerprint(" ") == bytes(32) != simhash.wide_fingerprint("a")


def test_components(spark):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(60)] + [(100 + k, 100) for k in range(1, 20)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    got = dict(map(tuple, graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: top(x) for x in root if top(x) != x}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=70), st.integers(1, 12))
def test_compact_windows_partition_all_subsequences(values, least):
    h = np.array(values, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    j, left, c, right, _ = substring.compact_windows(h, least, 2)
    for f in (0, 1):
        ranked = [(int(x * substring._MULTIPLIERS[f]) & 0xFFFFFFFF00000000, k) for k, x in enumerate(h)]
        for a in range(len(h)):
            for b in range(a + least - 1, len(h)):
                low = min(ranked[a : b + 1])[1]
                holds = [(int(x), int(y), int(z)) for g, x, y, z in zip(j, left, c, right) if g == f and x <= a <= y <= b <= z]
                assert len(holds) == 1 and holds[0][1] == low


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=40), max_size=6), st.integers(1, 9), st.integers(0, 30))
def test_windows_within_reach(lists, least, more):
    """Of texts side by side, each for itself, and as far as they are followed."""
    h = np.array([x for t in lists for x in t], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    edges, reach = np.cumsum([0, *map(len, lists)]), least + more
    got = sorted(zip(*(x.tolist() for x in substring.compact_windows(h, least, 2, edges, reach)[:4])))
    every = []
    for t, at in zip(lists, edges.tolist()):
        own = substring.compact_windows(np.array(t, np.uint64) * np.uint64(0x9E3779B97F4A7C15), least, 2)
        every += [(j, max(a, c - reach) + at, c + at, min(b, c + reach) + at) for j, a, c, b in zip(*(x.tolist() for x in own[:4]))]
    assert got == sorted(every)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab \n", max_size=30)), max_size=12), st.integers(1, 60))
def test_texts_side_by_side_have_their_own_shingles(texts, most):
    old, substring.TOGETHER = substring.TOGETHER, most
    try:
        got = {}
        for ids, h, edges, at in substring._stretches(enumerate(texts), 1):
            assert edges[0] == 0 and edges[-1] == len(h) and len(edges) == len(ids) + 1
            for i, a, b in zip(ids.tolist(), edges, edges[1:]):
                got[i] = h[a:b].tolist()
        assert got == {i: substring.shingles(t).tolist() for i, t in enumerate(texts)}
    finally:
        substring.TOGETHER = old


def test_repeated_passages(spark):
    p, q = words(60, 1), words(70, 2)
    edited = [*q[:30], "changed", *q[31:]]
    short = words(45, 3)
    texts = [
        " ".join(words(200, 10) + p + words(100, 11)), " ".join(words(30, 12) + p + q), " ".join(edited + words(300, 13)), " ".join(words(80, 14) + short), " ".join(short + words(80, 15)),
        " ".join(words(500, 16)), None, "", "few words", " ".join(["again"] * 500), " ".join(p).upper(), " ".join(words(90, 17)) + " " + " ".join(words(90, 17)),
    ]
    got = substring.find(docs(spark, texts).withColumn("match_doc_id", F.lit("clash"))).collect()
    pairs = {(r.match_doc_id, r.doc_id) for r in got}
    assert {(1, 2), (1, 11), (2, 3)} <= pairs and pairs <= {(1, 2), (1, 11), (2, 3), (2, 11)}
    one = next(r for r in got if (r.match_doc_id, r.doc_id) == (1, 2))
    assert (one.start_word, one.end_word, one.match_start, one.match_end, one.similarity) == (30, 90, 200, 260, 1.0)
    assert next(r for r in got if r.doc_id == 3).similarity >= 0.8
    kept = {r.doc_id: r for r in substring.remove(docs(spark, texts)).collect()}
    assert set(kept) == set(range(1, 13)) - {11}
    assert kept[2].text.split() == words(30, 12) + q and kept[2].n_chars == len(kept[2].text) and kept[1].text == texts[0] and kept[7].text is None
    assert kept[3].text.split()[-300:] == words(300, 13) and len(kept[3].text.split()) < 310


def test_passages_of_copies_and_empty_tables(spark, monkeypatch):
    text = " ".join(words(300, 5))
    monkeypatch.setattr(substring, "BATCH", 1)
    df = docs(spark, [text] * 40, [k // 2 for k in range(40)])  # repeated rows too
    got = substring.find(df)
    assert {r.doc_id for r in got.collect()} == set(range(1, 20)) and got.count() < 200
    assert sorted(r.doc_id for r in substring.remove(df).collect()) == [0, 0]
    assert substring.find(df.limit(0)).count() == 0 and substring.remove(df.limit(0)).count() == 0
    kept = rows(substring.remove(df))
    monkeypatch.setattr(substring, "BROADCAST", -1)  # spans by shuffle
    monkeypatch.setattr(substring, "HUB", 3)  # regions of a document in several rows
    assert rows(substring.find(df)) == rows(got) and rows(substring.remove(df)) == kept


def test_passages_of_rows_without_ids_and_of_long_texts(spark):
    p = " ".join(words(60, 1))
    long_ = " ".join(words(80_000, 2))  # over a piece of shingles
    df = docs(spark, [long_ + " " + p, p, p, long_], [1, 2, None, 4]).withColumn("_of", F.lit("clash"))
    got = {(r.match_doc_id, r.doc_id, r.start_word, r.end_word) for r in substring.find(df).collect()}
    assert (1, 2, 0, 60) in got and {k for a, b, x, y in got if b == 4 for k in range(x, y)} == set(range(80_000))
    kept = substring.remove(df.drop("_of"))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1]


def near_copies(share, n=60):
    """Pairs of documents with a passage of 150 words of which `share` of the words are other ones in the second."""
    r = random.Random(int(share * 1000))
    texts = []
    for k in range(n):
        p = words(150, 5000 + k)
        q = list(p)
        for place in r.sample(range(150), round(150 * share)):
            q[place] = words(1, 90_000 + 200 * k + place)[0]
        texts += [" ".join(words(60, 6000 + k) + p + words(60, 7000 + k)), " ".join(words(60, 8000 + k) + q + words(60, 9000 + k))]
    return texts


def similar_runs(a, b):
    """Words of b in a run of 50 or more that is alike (ALIKE of all shingles) to one of a, by trying all runs of words at
    the same distance, which is where the edits of near_copies leave them."""
    w, v = a.split()[60:210], b.split()[60:210]
    one, two = ([tuple(x[k : k + 5]) for k in range(146)] for x in (w, v))
    same, found = [s == t for s, t in zip(one, two)], set()
    for i in range(146):
        for j in range(i + 45, 146):
            n, m = j - i + 1, sum(same[i : j + 1])
            if m / (2 * n - m) >= substring.ALIKE and same[i] and same[j]:
                found |= set(range(60 + i, 60 + j + 5))
    return found


@pytest.mark.parametrize("share", [0.02, 0.04, 0.06])
def test_recall_of_near_passages(spark, share):
    """Of the words in passages that are alike by brute force; more edits than these leave no passage of 50 words alike."""
    texts = near_copies(share)
    got = covered(substring.find(docs(spark, texts)))
    want = {(2 * k + 2, x) for k in range(60) for x in similar_runs(texts[2 * k], texts[2 * k + 1])}
    assert len(want) > 200 and len(want & got) >= 0.9 * len(want)


def covered(df):
    """(doc, word) of every word of a passage."""
    return {(r.doc_id, k) for r in df.collect() for k in range(r.start_word, r.end_word)}


def equal_elsewhere(texts, n=50):
    """(doc, word) of every word in a run of n words that an earlier document has too."""
    first, found = {}, set()
    for i, t in enumerate(texts, 1):
        w = t.split()
        for k in range(len(w) - n + 1):
            if first.setdefault(tuple(w[k : k + n]), i) != i:
                found |= {(i, x) for x in range(k, k + n)}
    return found


def frequent_sentences(seed):
    """Documents of sentences of 30 words that many hold, in chance orders: two in the same order are 60 equal words."""
    r = random.Random(seed)
    known = [words(30, 1000 + k) for k in range(8)]
    texts = []
    for i in range(120):
        parts = []
        for k in range(4):
            parts += [*words(r.randint(5, 40), seed * 10_000 + i * 10 + k), *r.choice(known), *(r.choice(known) if r.random() < 0.3 else [])]
        texts.append(" ".join(parts))
    return texts


@pytest.mark.parametrize("frequent", [False, True])
def test_passages_of_frequent_sentences(spark, monkeypatch, frequent):
    if frequent:  # all signatures that two contexts hold
        monkeypatch.setattr(substring, "SAMPLE", 1)
        monkeypatch.setattr(substring, "RARE", 2)
    a, b = words(30, 1), words(30, 2)
    alone = [" ".join(words(40, 100 + k) + (a if k % 2 else b) + words(40, 200 + k)) for k in range(20)]
    both = [" ".join(words(40, 300 + k) + a + b + words(40, 400 + k)) for k in range(3)]
    assert {(r.match_doc_id, r.doc_id) for r in substring.find(docs(spark, alone + both)).collect()} >= {(21, 22), (21, 23)}
    texts = frequent_sentences(7)
    want = equal_elsewhere(texts)
    assert len(want) > 1000 and want <= covered(substring.find(docs(spark, texts)))


def test_passages_do_not_follow_the_batches(spark, monkeypatch):
    """Neither shared text is in the first document of its batch that holds its sentences, nor at their first place."""
    a, b = words(30, 1), words(30, 2)
    x = [" ".join(words(40, 500 + k) + (a if k % 2 else b) + words(40, 600 + k)) for k in range(12)]
    both = [" ".join(words(20, 700 + k) + a + words(40, 800 + k) + b + words(20, 900 + k) + a + b + words(40, 1100 + k)) for k in range(2)]
    texts = [*x[:6], both[0], *x[6:], both[1], *frequent_sentences(8)[:60]]
    found = []
    for size in (1, 2000, 1 << 30):
        monkeypatch.setattr(substring, "BATCH", size)
        found.append(covered(substring.find(docs(spark, texts).coalesce(1))))
    assert found[0] == found[1] == found[2] and equal_elsewhere(texts) <= found[0]
    assert {k for i, k in found[0] if i == 14} >= set(range(140, 200))


def test_without():
    assert substring.without("  a b\nc  d e", [(1, 3), (2, 4)]) == "  a e" and substring.without("a b", [(0, 9)]) == "" and substring.without("é b", []) == "é b"


def test_exact_passages_of_the_tables_are_found(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first, repeated = {}, set()
    for i, t in sorted((r.doc_id, r.text) for r in table.collect()):
        w = t.lower().encode().split()
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) != i:
                repeated.add(i)
    assert repeated and repeated <= {r.doc_id for r in substring.find(table).collect()}


def test_contained_items(spark, monkeypatch):
    item, long_ = words(30, 1), words(3000, 2)
    items = spark.createDataFrame([(1, " ".join(item)), (2, "two words"), (3, None), (4, "  "), (5, " ".join(words(40, 3)))], "item_id long, text string")
    near = [*item[:10], "other", *item[11:]]
    texts = [" ".join(long_[:1500] + item + long_[1500:]), " ".join(near).upper(), " ".join(item[:20]), "has Two  words here", "two other words", None, "", " ".join(item), "two"]
    df = docs(spark, texts, [1, 2, 3, 4, 5, 6, 7, 8, 9])
    want = [(1, 1, 26, 26), (2, 1, 26, 21), (4, 2, 1, 1), (8, 1, 26, 26)]
    assert [g[:4] for g in rows(decontaminate.contained(df, items))] == want
    monkeypatch.setattr(decontaminate, "BROADCAST", -1)
    assert [g[:4] for g in rows(decontaminate.contained(df, items))] == want
    assert {r.doc_id for r in decontaminate.clean(df, items).collect()} == {3, 5, 6, 7, 9}
    assert decontaminate.contained(df, items.limit(0)).count() == 0 and decontaminate.contained(df.limit(0), items).count() == 0
    assert decontaminate.clean(df, items.limit(0)).count() == 9


def test_documents_without_ids_are_judged_one_by_one(spark):
    item = words(30, 1)
    items = spark.createDataFrame([(1, " ".join(item)), (1, None)], "item_id long, text string").filter("text IS NOT NULL")
    texts = [" ".join(item[:18]), " ".join(item[12:]), " ".join([*words(5, 2), *item]), " ".join([*words(5, 2), *item])]
    df = docs(spark, texts, [None, None, None, None]).withColumn("of", F.lit("clash")).withColumn("words", F.lit("clash"))
    assert [tuple(r) for r in decontaminate.contained(df, items).collect()] == [(None, 1, 26, 26, 1.0)]
    assert sorted(r.text for r in decontaminate.clean(df, items).collect()) == sorted(texts[:2])
    halves = docs(spark, [*texts[:2], " ".join(words(100_000, 4) + item)], [5, 5, 6])  # rows of one id are one document
    assert [tuple(r)[:4] for r in decontaminate.contained(halves, items).orderBy("doc_id").collect()] == [(5, 1, 26, 26), (6, 1, 26, 26)]


def test_template_that_items_share_makes_no_candidates(spark):
    template = words(12, 50)
    items = [(k, " ".join(template + words(25, 100 + k))) for k in range(60)]
    wanted = decontaminate.item_shingles(spark.createDataFrame(items, "item_id long, text string"))
    shared = wanted.groupBy("shingle").agg(F.count("*").alias("n"), F.max(F.col("probe").cast("int")).alias("probe")).filter("n > 1")
    assert shared.count() == 8 and shared.filter("probe = 1").count() == 0
    df = docs(spark, [" ".join(template + words(25, 100 + k)) for k in (3, 9)] + [" ".join(template + words(50, 1))])
    assert {(r.doc_id, r.item_id) for r in decontaminate.contained(df, spark.createDataFrame(items, "item_id long, text string")).collect()} == {(1, 3), (2, 9)}


def test_query_sql_of_odd_rows(spark, tmp_path):
    """The SQL of op7 and op2 beside the queries on rows without ids, repeated rows, blanks and clashing names."""
    p = words(30, 1)
    texts = [" ".join(p[:20]), " ".join(p[10:]), " ".join(p), " ".join(p), None, "", " ", "two words", "Two\tWORDS x"]
    docs(spark, texts, [None, None, None, 7, 8, 9, 9, 9, 10]).withColumn("k", F.lit("clash")).toPandas().astype({"doc_id": "Int64"}).to_parquet(tmp_path / "documents.parquet")
    spark.createDataFrame([(1, " ".join(p)), (2, "two words"), (3, None), (4, "")], "item_id long, text string").toPandas().to_parquet(tmp_path / "benchmark.parquet")
    spark.createDataFrame([(7, 1, 0), (7, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").toPandas().astype({"doc_id": "Int64"}).to_parquet(tmp_path / "labels.parquet")
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    for name in ("op7_decontaminate", "op2_mix_sources"):
        assert compare(spark, con, QUERIES[name], ORACLES[name], str(tmp_path)) > 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    df = docs(spark, ["the quiet sea " * 20, "the quiet sea " * 20, None, "", "x", "the river " * 30], [1, None, None, 4, 4, 6]).withColumn("_text", F.lit("kept"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {1, 4, 6, None}


def test_pipeline_stages(spark):
    at = spark.read.parquet(f"{SF}/documents.parquet")
    before, left = at.columns, at
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, left, SF)
        after = spark.createDataFrame(after.collect(), after.schema)
        assert after.columns == before and 0 < after.count() <= left.count(), name
        assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in left.collect()}
        left = after
    own = classes_by_force([(r.doc_id, r.text) for r in at.collect()])
    assert len(own) > len({c for _, c in own.values()}) and simhash.keep_one(at).count() == len({c for _, c in own.values()})
    mixed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in left.collect()}
    empty = at.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


@pytest.mark.parametrize("options,least", [({}, 0.9), ({"exact": True}, 1.0)])
def test_passages_behind_frequent_pieces(spark, options, least):
    """Ten pairs of passages of 150 words with an edit about every 30 words; each piece of 35 of their words is in 64
    earlier documents as well."""
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(20_000)]
    noise = lambda n: [r.choice(vocabulary) for _ in range(n)]
    pairs = []
    for _ in range(10):
        one = noise(150)
        two = list(one)
        for place in range(15 + r.randrange(5), 150, 30):
            two[place] = r.choice(vocabulary)
        pairs.append((one, two))
    quoted = [" ".join(noise(30) + one[at : at + 35] + noise(30)) for one, _ in pairs for at in range(0, 150, 35) for _ in range(64)]
    texts = quoted + [" ".join(noise(40) + x + noise(40)) for pair in pairs for x in pair]
    df = docs(spark, texts).repartition(4)

    def found(df, **options):
        out = set()
        for p in substring.find(df, **options).collect():
            out |= {(p.doc_id, k) for k in range(p.start_word, p.end_word)}
        return out

    want = found(df.filter(F.col("doc_id") > len(quoted)))
    assert len(want) > 1000 and len(found(df, **options) & want) >= least * len(want)


@pytest.mark.parametrize("contexts,copies", [(7, 1), (8, 1), (7, 3)])
def test_holders_of_a_key_are_counted_where_they_meet(contexts, copies):
    """With 8 contexts, all that there are, a signature and what comes before it are frequent: holders link to the first,
    and all are told. Copies of a context do not count."""
    n = contexts * copies
    doc, c = np.arange(n), np.full(n, 20)
    pack = substring._pack(1, c - 20, c, c + 26)
    sides, tag = (5 << 32) + np.arange(n) % contexts, (np.arange(n) % contexts + 1) << 32
    got = list(substring._links(8)([substring._table(np.full(n, 3), doc, pack, sides, tag)]))
    a, pa_, b, _ = (np.concatenate([t.column(k).to_numpy() for t in got]) for k in range(4))
    links, lost = a != b, pa_.view(np.uint64) >> np.uint64(substring.LOST)
    if contexts < 8:
        assert not lost.any() and links.all() and len(a) == contexts * (contexts - 1) // 2 + n - contexts
    else:
        assert sorted(b[links]) == list(range(1, n)) and (a == 0).all() and (lost[links] == 1).all() and list(b[~links]) == [0]


def test_runs_that_are_found_are_not_looked_up_again():
    """All windows of a text are lost to their sides; shingles 20 to 119 of it have been found, as two stretches."""
    text = " ".join(words(204, 1))
    h, edges = substring.shingles(text), np.array([0, 200])
    pack = substring._windows_of(h, edges, 46, 6, substring._powers(200))[4]
    marks = np.concatenate([substring._marks(pack, k) for k in (1, 2)])

    def looked_up(*spans):
        row = [pa.array([x]) for x in (7, text, marks.tolist(), [a for a, _ in spans], [b + 5 for _, b in spans])]
        row[3:] = [x.cast(pa.list_(pa.int64())) for x in row[3:]]
        got = substring._behind(46, 6, 2)([pa.RecordBatch.from_arrays(row, ["doc_id", "text", "marks", "first", "last"])])
        packs = np.concatenate([t.column("pb").to_numpy() * 0 + t.column("pa").to_numpy() for t in got])
        return {int(c) - 23 for m, _, c, _ in zip(*substring._unpack(packs)) if m == 63}

    assert looked_up() == set(range(155))
    assert looked_up((20, 119), (20, 90), (0, 44)) == set(range(155)) - set(range(20, 75))
    marked = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([marks.tolist()]), pa.array([[0]]), pa.array([[205]])], substring.LEFT_NAMES)
    left = [m >> 10 for b in substring._left(46, 6, 2)([marked]) for m in b.column("marks").to_pylist()[0]]
    assert set(left) <= set(range(155, 200))  # where the text ends is not known there
    x, parts = np.arange(300, dtype=np.uint32), []
    y = np.where(x == 100, 999, x).astype(np.uint32)
    assert [p[:4] for p in substring.compare(x, y, parts=parts)] == [(0, 299, 0, 299)] and [p[2:] for p in parts] == [(0, 99), (101, 299)]
