import itertools

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hornbeam.functions import names
from hornbeam.functions.formula import evaluate, parse, satisfied
from hornbeam.functions.syscalls import CATEGORIES, category, parse_trace, split_arguments
from tests.conftest import rows


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "x string").select(build(F.col("x"))).first()[0]


def test_names(spark):
    assert one(spark, "@a/b c", names.file_name) == "..a..b..c"
    assert one(spark, "@a/b", names.container_name) == "a..b"
    assert one(spark, "_x", names.container_name) == "san.._x"
    assert one(spark, "v1.10.0b", names.version_array) == [1, 10, 0]
    assert one(spark, "1..2", names.version_array) == [1, 0, 2]
    assert [one(spark, v, names.is_plain_version) for v in ("v1.2.3", "1.0b1", "...", "1.")] == [True, False, False, True]
    assert tuple(one(spark, "a..b..1.0..job-sudo", names.split_container)) == ("a..b", "1.0", True)
    assert tuple(one(spark, "a..None..job", names.split_container)) == ("a", None, False)
    assert one(spark, "abc", names.split_container) is None
    assert one(spark, "..bad_host..www.example.org..x.y", names.first_hostname) == "www.example.org"
    assert one(spark, "{u'overall': 3, 'last_day': None}", names.literal_map) == {"overall": 3, "last_day": None}
    assert one(spark, "x", names.literal_map) is None
    assert one(spark, "a@b.c, <d-e@f.org> a@b.c", names.emails) == ["a@b.c", "d-e@f.org"]
    assert one(spark, "10.1.2.3", lambda c: names.in_network(c, "10.0.0.0/8")) and not one(spark, "11.1.2.3", lambda c: names.in_network(c, "10.0.0.0/8"))
    assert one(spark, "/org/example/lib/", names.maven_coordinate) == "org.example/lib"
    assert one(spark, "1.2.3.4", names.reversed_octets) == "4.3.2.1"


def test_hostnames(spark):
    cases = {"a": False, "a.b": True, "a.b.": True, "-a.b": False, "a-.b": False, "x" * 63 + ".b": True, "x" * 64 + ".b": False, "a." * 128: False, None: False, "a..b": False}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "h string, want boolean")
    assert df.filter(names.is_hostname(F.col("h")) != F.col("want")).count() == 0


def test_edit_distance_counts_bytes(spark):
    df = spark.createDataFrame([("héllo", "hello"), ("", ""), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(names.edit_distance(F.col("a"), F.col("b"))).collect()] == [2, 0, None]
    assert [r[0] for r in df.select(names.edit_distance(F.col("a"), F.col("b"), "chars")).collect()] == [1, 0, None]
    assert [r[0] for r in df.select(names.edit_distance(F.col("a"), F.col("b"), "normalized")).collect()][:2] == [2 / 6, 0.0]


def formulas():
    leaf = st.one_of(st.integers(1, 4).map(str), st.just("()"))
    return st.recursive(leaf, lambda x: st.tuples(x, st.sampled_from(["&", "|"]), x).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), max_leaves=8)


@settings(max_examples=15, deadline=None)
@given(st.lists(formulas(), min_size=1, max_size=6))
def test_formula_equals_its_truth_table(spark, texts):
    sets = [list(s) for n in range(5) for s in itertools.combinations(range(1, 5), n)]
    df = spark.createDataFrame([(s,) for s in sets], "ids array<int>")
    got = df.select("ids", *[satisfied(t, F.col("ids")).alias(f"f{k}") for k, t in enumerate(texts)]).collect()
    for r in got:
        assert list(r)[1:] == [evaluate(t, set(r.ids)) for t in texts]


def test_formula_grammar():
    assert parse("1 & 2 | 3") == ("or", ("and", ("id", 1), ("id", 2)), ("id", 3))
    for bad in ("1 &", "(1", "1 2", "__import__('os')", "1 + 2"):
        try:
            parse(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_traces(spark):
    assert split_arguments(r'"/etc/a, b", {a=1, b=[2, 3]}, "x\"," ...') == [r'"/etc/a, b"', "{a=1, b=[2, 3]}", r'"x\"," ...']
    got = parse_trace(spark.createDataFrame([('12 1.5 openat(AT_FDCWD, "/etc/passwd", O_RDONLY) = 3',), ("nonsense",), ("7 setuid(0) = 0",)], "value string"))
    assert rows(got)[0][:4] == (12, 1.5, "openat", ["AT_FDCWD", '"/etc/passwd"', "O_RDONLY"]) and {r.category for r in got.collect()} == {"file", None, "process"}


def test_ranges_and_urls(spark):
    df = spark.createDataFrame([("ab\ncdef\nghi", {"b": "x y", "a": "1"})], "t string, m map<string,string>")
    place = lambda *x: names.source_range(F.col("t"), *map(F.lit, x))
    r = df.select(place(1, 1, 3, 2), place(2, 1, 2, 3), names.query_string(F.col("m")), names.url_join(F.lit("http://a/"), F.lit("/b"))).first()
    assert tuple(r) == ("b\ncdef\ngh", "de", "a=1&b=x+y", "http://a/b")


def test_every_listed_call_has_its_category(spark):
    df = spark.createDataFrame([(c.lower(), k) for k, calls in CATEGORIES.items() for c in calls] + [("sched_nonsense", None), ("", None), (None, None)], "call string, want string")
    assert df.filter(~category(F.col("call")).eqNullSafe(F.col("want"))).count() == 0
    assert df.filter(category(F.col("call"), {"mine": ["OPEN"]}) == "mine").count() == 1


def test_arguments_keep_quotes_of_both_kinds():
    assert split_arguments("'a, b', \"c's, d\", {x='}', y=[1, 2]}") == ["'a, b'", "\"c's, d\"", "{x='}', y=[1, 2]}"]
    assert split_arguments('"ab"..., 3', quotes=False, ellipsis=False) == ["ab", "3"] and split_arguments('"ab"..., 3', ellipsis=False) == ['"ab"', "3"]
    assert split_arguments("") == [] and split_arguments(None) is None and split_arguments("a, ") == ["a", ""] and split_arguments("'open") == ["'open"]


def test_long_version_parts_keep_their_order(spark):
    assert [int(x) for x in one(spark, "1.20190101123456", names.version_array)] == [1, 20190101123456]
    df = spark.createDataFrame([("1.20190101123456",), ("1.3",), ("1.20190101123455",)], "x string")
    assert [r.x for r in df.orderBy(names.version_array(F.col("x")).desc()).collect()] == ["1.20190101123456", "1.20190101123455", "1.3"]


def test_private_networks(spark):
    private = ["0.1.2.3", "10.255.0.1", "100.64.0.1", "100.127.255.255", "127.0.0.1", "169.254.1.1", "172.31.9.9", "192.0.0.8", "192.0.2.9", "192.88.99.1", "192.168.0.1", "198.19.255.1", "198.51.100.7", "203.0.113.1", "224.0.0.1", "239.1.1.1", "240.0.0.1", "255.255.255.255"]
    public = ["1.1.1.1", "100.63.255.255", "100.128.0.0", "169.253.1.1", "172.15.0.1", "172.32.0.1", "192.0.1.1", "192.169.0.1", "198.20.0.1", "203.0.114.1", "223.255.255.255", "x", "", None, "1.2.3"]
    df = spark.createDataFrame([(x, True) for x in private] + [(x, False) for x in public], "x string, want boolean")
    assert df.filter(names.is_private_ip(F.col("x")) != F.col("want")).count() == 0


def test_small_builders(spark):
    assert one(spark, "a.b/c", lambda c: names.result_key(c, F.lit(None).cast("string"), F.lit("dep.json"))) == "a.b..c:latest.dep.json"
    keys = one(spark, "p", lambda c: names.result_keys(c, F.lit("1.0"), F.lit(True)))
    assert keys["metadata"] == "p:1.0:sudo.metadata.json" and keys["versions"] == "p.versions.json" and len(keys) == 16
    assert one(spark, "abc", names.md5_number) == int(__import__("hashlib").md5(b"abc").hexdigest()[:16], 16)
    assert one(spark, "a/b/c.txt", names.dir_name) == "a/b" and one(spark, "c.txt", names.dir_name) == ""
    assert [one(spark, x, names.is_npm_name) for x in ("@a/b", "a@b", "a b", "", None)] == [True, False, False, False, False]
    assert str(one(spark, "2020-03-01", lambda c: names.months_ago(c.cast("date"), 12))) == "2019-03-02"
    assert one(spark, "x y.z", names.has_domain) and not one(spark, "x. y", names.has_domain)
    cell = """{u'a': 'it\\'s "x"', "b": None, 'c': [True, False, 1.5], 'd': {'e': u'None'}}"""
    assert __import__("json").loads(one(spark, cell, names.literal_json)) == {"a": "it's \"x\"", "b": None, "c": [True, False, 1.5], "d": {"e": "None"}}
