import hashlib
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hornbeam.llm import media_ogg, queries, tokens, urlfilter
from tests.conftest import rows
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "a", "x" * 64, "y" * 65, "日本語🙂" * 3000, "z" * 300_000, "OggS" * 500, "a\0b"]


def slow_crc(data):
    r = 0
    for c in data:
        r ^= c << 24
        for _ in range(8):
            r = (r << 1 ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
    return r


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 4), st.sampled_from([1, 254, 255, 510, 1000]))
def test_ogg_round_trip(data, streams, packet):
    media = media_ogg.write(data, streams, packet)
    got = media_ogg.read(media)
    assert media_ogg.samples(got)[0] == data and media_ogg.samples(got)[2]
    assert len(got.packets) == streams == len(got.ended) and slow_crc(data[:99]) == media_ogg.page_crc(data[:99])


def test_ogg_damage():
    data = bytes(range(256)) * 700
    media = bytearray(media_ogg.write(data))
    media[len(media) // 2] ^= 1
    got = media_ogg.read(bytes(media))
    assert got.bad_pages == 1 and got.lost_packets >= 1 and not media_ogg.samples(got)[2]
    assert media_ogg.read(b"nothing").pages == 0
    assert not media_ogg.samples(media_ogg.read(bytes(media[:-10])))[2]


def split_pages(media):
    """Pages by their headers alone."""
    out, at = [], 0
    while at < len(media):
        n = media[at + 26]
        end = at + 27 + n + sum(media[at + 27 : at + 27 + n])
        out.append(media[at:end])
        at = end
    return out


def test_ogg_pages_that_are_missing():
    whole = split_pages(media_ogg.write(bytes(range(256)) * 8000, 2, 100))
    assert media_ogg.read(b"".join(whole)).whole and len(whole) > 20
    for gone in (5, 12, 0, 1, len(whole) - 1, len(whole) - 2):
        got = media_ogg.read(b"".join(p for k, p in enumerate(whole) if k != gone))
        assert not got.whole and got.missing_pages + got.open_streams == 1 and not media_ogg.samples(got)[2], gone
    cut = media_ogg.read(b"".join(whole[:-4]))
    assert not cut.whole and cut.open_streams == 2 and not cut.bad_pages
    twice = media_ogg.read(b"".join([*whole[:7], whole[6], *whole[7:]]))
    assert not twice.whole and twice.missing_pages


def test_ogg_feature_by_hand(spark):
    text = "The river é\n" * 300
    raw = text.encode()
    data = raw + bytes(-len(raw) % 64)
    media = media_ogg.write(data)
    got = media_ogg.digests(media_ogg.encode_texts(spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string"))).collect()
    packets = 2 + -(-len(data) // media_ogg.PACKET)
    longest = max(sum(len(data[at : at + media_ogg.PACKET]) for at in range(k * media_ogg.PACKET, len(data), 2 * media_ogg.PACKET)) for k in (0, 1))
    mean = sum(data) / len(data)
    spread = (sum((b - mean) ** 2 for b in data) / len(data)) ** 0.5
    crossings = sum((a < 128) != (b < 128) for a, b in zip(data, data[1:]))
    want = f"streams=2;pages={len(split_pages(media))};packets={packets};bad=0;seconds={longest / 8000:.6f};mean={mean:.6f};deviation={spread:.6f};crossings={crossings}"
    assert {r.feature for r in got} == {want} and len(got) == 3 and {r.media_bytes for r in got} == {len(media)}


def test_ogg_query_digests(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    got = {r.doc_id: r for r in media_ogg.digests(media_ogg.encode_texts(df.withColumn("media", F.lit("clash")).withColumn("n_bytes", F.lit("clash")))).collect()}
    for k, t in enumerate(ODD):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (got[k].n_bytes, got[k].payload_bytes, got[k].payload_sha256, got[k].tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert got[0].media_sha256 == got[1].media_sha256 and got[0].feature == got[1].feature
    assert media_ogg.digests(media_ogg.encode_texts(df.limit(0))).count() == 0


def test_ogg_packets(spark):
    media = media_ogg.write(b"a" * 9000, 2, 4000)
    got = media_ogg.packets(spark.createDataFrame([(1, bytearray(media)), (2, None), (3, bytearray(b"junk"))], "id long, media binary"))
    by = {i: [r for r in got.collect() if r.id == i] for i in (1, 2, 3)}
    assert len(by[1]) == 5 and max(r.end for r in by[1]) == 5000 / 8000 and all(r.ok for r in by[1])
    assert by[2][0].ok is None and by[3][0].ok is False


def test_url_query(spark):
    assert compare(spark, connect(SF), queries.QUERIES["op8_url_filter"], queries.ORACLES["op8_url_filter"], SF) > 0


def test_url_cases(spark):
    urls = {None: ("", "", None, "allow"), "nothing": ("", "", None, "allow"), "http://Example.ORG/en/12?q#f": ("example.org", "/en/12", "example.org/en/1", "block"), "http://a.example.org/es/x": ("a.example.org", "/es/x", "example.org/es/", "block"), "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"), "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"), "http://x.org": ("x.org", "", None, "allow"), "http://evil.net/x.org/": ("evil.net", "/x.org/", None, "allow"), "x://é.org/\n/": ("é.org", "/\n/", "org/", "allow"), "a://" + "b" * 70_000 + ".org/": ("b" * 70_000 + ".org", "/", "org/", "allow")}
    df = spark.createDataFrame([(k, u, "kept") for k, u in enumerate(urls)], "page_id long, url string, host string")
    assert [tuple(r)[1:] for r in urlfilter.filter_urls(df).orderBy("page_id").collect()] == list(urls.values())
    assert urlfilter.filter_urls(df, []).filter("verdict = 'allow' AND rule IS NULL").count() == len(urls)
    assert urlfilter.filter_urls(df.limit(0)).count() == 0
    again = spark.createDataFrame([(None, "http://x.org/a", 1), (None, "http://x.org/a", 1), (7, "http://x.org/a", 1), (7, None, 1), (8, "http://x.org/" + "p" * 300_000, 1)], "page_id long, url string, verdict int")
    assert [r.rule for r in urlfilter.filter_urls(again).orderBy("page_id", F.col("rule").asc_nulls_first()).collect()] == ["org/", "org/", None, "org/", "org/"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab/*?", max_size=6), min_size=1, max_size=30), st.lists(st.text("ab/", max_size=8), min_size=1, max_size=10))
def test_globs_equal_regular_expressions(globs, texts):
    def regex(g):
        return "".join({"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}.get(t, re.escape(t)) for t in re.findall(r"\*\*|.", g))

    got = urlfilter.GlobSet([g.encode() for g in globs]).match([t.encode() for t in texts])
    assert got.tolist() == [[bool(re.fullmatch(regex(g), t)) for g in globs] for t in texts]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokens.tokenizer_path())


def test_token_counts_equal_the_library(spark, library):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1 - k, t) for k, t in enumerate(ODD)], "doc_id long, text string"))
    want = {r.doc_id: (len((r.text or "").encode()), len(library.encode(r.text or "")), len(library.encode(r.text or "")) > 4096) for r in df.collect()}
    assert {r.doc_id: tuple(r)[1:] for r in tokens.count_tokens(df).collect()} == want
    assert rows(tokens.count_tokens(df.limit(0))) == []


def test_token_counts_of_odd_rows(spark, library, tmp_path):
    n = len(library.encode("the end"))
    df = spark.createDataFrame([(None, "the end", "x"), (1, "the end", "x"), (1, "the end", "x"), (2, None, "x")], "doc_id long, text string, n_tokens string")
    assert rows(tokens.count_tokens(df, limit=1)) == sorted([(None, 7, n, n > 1), (1, 7, n, n > 1), (1, 7, n, n > 1), (2, 0, 0, False)], key=repr)
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(tokens.tokenizer_path(), "rb") as f:
        model.ParseFromString(f.read())
    model.pieces.add(piece="mine", score=0.0, type=4)
    (tmp_path / "odd.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        tokens.PieceCounter(str(tmp_path / "odd.model"))


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab the<s>▁\n\t é1…🙂"), max_size=40))
def test_token_counts_of_any_text(library, text):
    counter = tokens.PieceCounter(tokens.tokenizer_path()) if not hasattr(test_token_counts_of_any_text, "c") else test_token_counts_of_any_text.c
    test_token_counts_of_any_text.c = counter
    assert counter.count(text) == len(library.encode(text))
