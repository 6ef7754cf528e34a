import datetime as dt
import hashlib
import itertools
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hornbeam.operators import authors, behavior, catalogue, dispatch, extract, findings, flows, graph, rules, similarity, usage, versions
from tests.conftest import rows


def distance(a, b):
    a, b = a.encode(), b.encode()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=8, deadline=None)
@given(st.sets(st.text("abé", max_size=7), max_size=25), st.integers(0, 3))
def test_banded_join_equals_all_pairs(spark, words, limit):
    got = rows(similarity.edit_distance_pairs(spark.createDataFrame([(w,) for w in words], "name string"), limit=limit))
    assert got == sorted(((a, b, d) for a in words for b in words if a < b and (d := distance(a, b)) <= limit), key=repr)


def test_combo_squats(spark):
    df = spark.createDataFrame([(x,) for x in ("requests", "requests2", "python-requests", "tests", "abcdef", "xabcdefx", None)], "name string")
    assert rows(similarity.combo_squats(df)) == [("abcdef", "xabcdefx"), ("requests", "python-requests"), ("requests", "requests2")]


def reach(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = set()
    for a in out:
        todo, seen = list(out[a]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        found |= {(a, x) for x in seen}
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_components_and_cycles(spark, seed):
    r = random.Random(seed)
    edges = {(r.randrange(12), r.randrange(12)) for _ in range(16)}
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    want = reach(edges)
    assert set(map(tuple, graph.closure(df).collect())) == want
    parts = {}
    for a, b in want:
        if (b, a) in want and a != b:
            parts[a] = min(parts.get(a, a), b)
    assert dict(map(tuple, graph.strong_components(df).collect())) == parts
    kept = set(map(tuple, graph.break_cycles(df).collect()))
    assert kept <= edges and not any(a == b for a, b in reach(kept))
    assert graph.is_dag(spark.createDataFrame(sorted(kept), "src long, dst long"))
    level = dict(map(tuple, graph.levels(spark.createDataFrame(sorted(kept), "src long, dst long")).collect()))
    assert all(level[a] > level[b] for a, b in kept)


def test_graph_edges_cases(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert graph.closure(none).count() == graph.strong_components(none).count() == graph.break_cycles(none).count() == 0
    with pytest.raises(ValueError):
        graph.levels(spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"))
    toy = spark.createDataFrame([(a, b) for a, bs in {"A": "BCD", "B": "EF", "D": "F", "F": "G"}.items() for b in bs], "src string, dst string")
    assert {r.dst for r in graph.descendants(toy, spark.createDataFrame([("A",)], "id string")).collect()} == set("BCDEFG")
    assert abs(graph.pagerank(toy).agg(F.sum("rank")).first()[0] - 1) < 1e-9
    assert {r.slice for r in graph.split(toy, 3).collect()} <= {0, 1, 2}
    assert dict(map(tuple, graph.component_labels(spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "src long, dst long")).collect())) == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}


def test_alert_values(spark):
    def a(rule, container, **fields):
        return rule, {"container.name": container} | {k.replace("__", "."): v for k, v in fields.items()}

    df = spark.createDataFrame([
        a("outgoing_domain", "p..1.0..job", evt__arg__data="x..bad..www.a.org..b.c"), a("outgoing_ip", "p..None..x-sudo", fd__sip="1.2.3.4"), a("outgoing_ip", "host", fd__sip="1.1.1.1"),
        a("outgoing_ip", "p..1.0..job"), a("unknown", "p..1.0..job"), a("spawn_process", "p..1.0..job", user__name="u", proc__name="n", proc__cmdline="n -x"), a("read_file", "p..1.0..job", fd__name="/etc/x"), a("outgoing_domain", "p..1.0..job", evt__arg__data="nothing"),
    ], "rule string, output_fields map<string,string>")
    assert rows(behavior.alert_values(df)) == sorted([("p", "1.0", False, "outgoing_domain", "www.a.org"), ("p", None, True, "outgoing_ip", "1.2.3.4"), ("p", "1.0", False, "spawn_process", "u:n -x"), ("p", "1.0", False, "read_file", "/etc/x:r")], key=repr)
    assert behavior.dynamic_results(behavior.alert_values(df)).count() == 2


def test_version_thinning(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    many = [("m", f"1.{k}", day(10 * k)) for k in range(20)] + [("m", "1.0b1", day(400))]
    few = [("f", "1.0b1", day(1)), ("f", "dev", day(2))]
    got = rows(versions.thin(spark.createDataFrame(many + few, "pkg string, version string, ts timestamp"), 5, 30))
    assert [g[1] for g in got if g[0] == "f"] == ["1.0b1", "dev"]
    assert sorted((g[1] for g in got if g[0] == "m"), key=lambda v: -int(v[2:])) == ["1.19", "1.16", "1.13", "1.10", "1.7"]


def test_comparison_scopes(spark):
    df = spark.createDataFrame([("a", "1", "x"), ("a", "2", "x"), ("a", "2", "y"), ("b", "1", "y")], "pkg string, version string, key string")
    assert rows(versions.compare(df)) == [("a", "1", "x", 1, True, False), ("a", "2", "x", 1, True, False), ("a", "2", "y", 1, False, True), ("b", "1", "y", 1, True, False)] or {r.key: r.is_common for r in versions.compare(df).filter("pkg = 'a'").collect()} == {"x": True, "y": False}
    assert all(r.is_unique for r in versions.compare(df, "global").collect())


def test_python_calls():
    code = "from base64 import b64decode as d, b64encode\nimport os as o\nd(1)\nb64encode(x, *a, k=2)\no.system('ls')\nf().g(h[0].i())\n"
    assert [(b, n) for b, n, *_ in extract.python_calls(code)] == [("base64", "b64decode"), ("base64", "b64encode"), ("o", "system"), ("f()", "g"), (None, "f"), ("h[0]", "i")]
    assert ("os", "system") in [(b, n) for b, n, *_ in extract.python_calls(code, "resolved")]
    assert next(c for c in extract.python_calls(code) if c[1] == "b64encode")[2] == ["x", "*a", "k=2"]


def test_other_languages_and_errors(spark):
    samples = [
        ("one", "1.0", "python", "setup.py", "from base64 import b64decode as d\nimport os\nexec(d('x'))\nos.system('ls', **opts)\n"),
        ("one", "1.0", "python", "bad.py", "def broken(:\n"),
        ("two", "2.1", "javascript", "index.js", "const cp = require('child_process');\ncp.exec('ls', function () {});\nnew Buffer('eval(1)');\n// eval(no)\neval(x);\n"),
        ("three", "0.3", "ruby", "lib.rb", "eval(params)\nx = `ls -l`\nKernel.system 'a', 'b'\n"),
        ("four", "1.1", "php", "a.php", "<?php\n$o->run($x);\nA::go(1, 2);\necho `id`;\neval($_GET['c']);\n"),
        ("x", "1", "cobol", "a.cob", "CALL 'X'."), ("x", "1", "python", "n.py", None),
    ]
    got = extract.api_calls(spark.createDataFrame(samples, "pkg string, version string, language string, path string, content string"))
    names = {(r.language, r.full_name) for r in got.filter("error IS NULL").collect()}
    assert {("javascript", "cp.exec"), ("javascript", "eval"), ("ruby", "eval"), ("ruby", "builtin_xstring"), ("ruby", "Kernel.system"), ("php", "$o.run"), ("php", "A.go"), ("php", "shell_exec"), ("php", "eval"), ("python", "base64.b64decode")} <= names
    assert got.filter("language = 'javascript' AND full_name = 'eval'").count() == 1  # not the ones in a string and a comment
    assert {r.file for r in got.filter("error IS NOT NULL").collect()} == {"bad.py", "a.cob", "n.py"}
    known = spark.createDataFrame([("A::go",), ("base64.b64decode",)], "full_name string")
    assert extract.known_calls(got, known).count() == 2
    assert {r.name for r in extract.known_calls(got, spark.createDataFrame([("x.exec",)], "full_name string"), True).collect()} == {"exec"}


def test_flows_and_summaries(spark):
    edges = spark.createDataFrame([("s", "a"), ("a", "b"), ("b", "a"), ("b", "t"), ("s", "clean"), ("clean", "t2")], "src string, dst string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert rows(flows.flows(edges, ids("s"), ids("t", "t2"), ids("clean"))) == [("s", "t", ["s", "a", "b", "t"])]
    code = "def get():\n    return input()\ndef put(v):\n    run(v)\n"
    e = flows.def_use_edges(spark.createDataFrame([("p", "a.py", code), ("p", "b.py", "def (")], "pkg string, path string, content string"))
    names = lambda *x: spark.createDataFrame([(i,) for i in x], "name string")
    got = flows.summaries(e, flows.calls(e, names("input")), flows.calls(e, names("run")))
    assert rows(got) == [("p", "get", "SOURCE"), ("p", "put", "SINK")]
    tree = e.unionByName(flows.def_use_edges(spark.createDataFrame([("q", "c.py", "def main():\n    x = get()\n    put(x)\n")], "pkg string, path string, content string")))
    found = flows.taint_tree(spark.createDataFrame([("q", "p")], "src string, dst string"), tree.select("pkg", "src", "dst"), names("input"), names("run"))
    assert [(r.pkg, r.source, r.sink) for r in found.collect()] == [("q", "c.py|main:get()", "c.py|main:put()")]
    assert rows(flows.flow_packages(found)) == [("get() -> put()", 1)]
    assert found.select(flows.finding_id("source", "sink", "pkg").alias("x")).first().x == hashlib.sha256(b"c.py|main:get()-c.py|main:put()-q").hexdigest()


def test_flows_stay_in_their_package_and_file(spark):
    """Names are the same everywhere: what one package or function reads must not reach what another runs."""
    reads, runs = "def f():\n    x = input()\n", "def f():\n    x = 1\n    run(x)\n"
    both = "class A:\n    def f(self):\n        x = input()\nclass B:\n    def f(self, x):\n        run(x)\n"
    files = [("p", "a.py", reads), ("q", "a.py", runs), ("r", "a.py", reads), ("r", "b.py", runs), ("s", "a.py", both), ("t", "a.py", reads + "    run(x)\n")]
    e = flows.def_use_edges(spark.createDataFrame(files, "pkg string, path string, content string"))
    names = lambda x: spark.createDataFrame([(x,)], "name string")
    assert [r.pkg for r in flows.flows(e, flows.calls(e, names("input")), flows.calls(e, names("run"))).collect()] == ["t"]


def test_flows_of_scripts(spark):
    js = "function get(u) { var x = read(u);\n  return x; }\nfunction put(a, b) { run(b); }\nvar y = get(1);\nconst s = `v ${y}`;\nput(0, s);\nlet z = clean(y)\nput(z, 1)\n"
    php = "<?php\nfunction get($u) { $x = read($u); return $x; }\n$y = 'a' . get(1);\n$o->run($y);\nrun('$y');\n"
    for language, path, code, sink in (("javascript", "a.js", js, "run"), ("php", "a.php", php, "$o->run")):
        e = flows.def_use_edges(spark.createDataFrame([("p", path, code)], "pkg string, path string, content string"), language)
        names = lambda x: spark.createDataFrame([(x,)], "name string")
        found = flows.flows(e, flows.calls(e, names("read")), flows.calls(e, names(sink)), flows.calls(e, names("clean"))).collect()
        assert len(found) == 1 and found[0].hops[-1].endswith(f":{sink}()"), language
    harmless = spark.createDataFrame([("put", 0), ("other", None)], "name string, parameter int")
    e = flows.def_use_edges(spark.createDataFrame([("p", "a.js", js)], "pkg string, path string, content string"), "javascript")
    at = lambda e: {r.place for r in e.filter("kind = 'argument' AND dst LIKE '%:put()'").collect()}
    assert at(e) == {0, 1} and at(flows.only_at(e, harmless)) == {0}


def test_script_tokens():
    code = "var r = /eval(x)['\"]/g.test(s);\nvar q = a / b(1) / c;\nlet t = `x ${ f({a: `in ${g(1, 2)}`}) } eval(no)`;\na?.b(3);\na?.b?.c(4);\nif (/h(1)/.test(y)) k?.(5); // l(6)\n"
    assert [(b, n, a) for b, n, a, *_ in extract.token_calls(code, "javascript")] == [
        (None, "test", ["s"]), (None, "b", ["1"]), (None, "f", ["{a: `in ${g(1, 2)}`}"]), (None, "g", ["1", "2"]), ("a", "b", ["3"]), ("a?.b", "c", ["4"]), (None, "test", ["y"]), (None, "k", ["5"]),
    ]
    for language in ("javascript", "ruby", "php"):
        for odd in (code, "`", "`${", "'", '"\\', "/*", "//", "/", "f(", "f(,)", "}", "`${`${`"):
            assert len(extract.masked(odd, language)) == len(odd)
            list(extract.token_calls(odd, language))
    began = time.perf_counter()
    assert sum(1 for _ in extract.token_calls("f(g(1), [2]);\n" * 100_000, "javascript")) == 200_000
    assert time.perf_counter() - began < 20


def test_flows_of_many_hops(spark):
    edges = spark.createDataFrame([(f"n{k:03}", f"n{k + 1:03}") for k in range(110)], "src string, dst string").coalesce(1)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert [(r.source, r.sink, len(r.hops)) for r in flows.flows(edges, ids("n000"), ids("n110")).collect()] == [("n000", "n110", 111)]
    assert flows.flows(edges, ids("n000"), ids("n110"), most_hops=20).count() == 0


def test_reaching_definitions_and_centroids(spark):
    blocks = spark.createDataFrame([("f", 1, ["x1"], ["x2"]), ("f", 2, ["x2"], ["x1"]), ("f", 3, [], [])], "function string, block int, generates array<string>, kills array<string>")
    e = spark.createDataFrame([("f", 1, 2), ("f", 2, 3), ("f", 3, 2)], "function string, src int, dst int")
    assert rows(flows.reaching_definitions(blocks, e)) == [("f", 2, "x1"), ("f", 2, "x2"), ("f", 3, "x2")]
    b = spark.createDataFrame([("m", 0, 1, 0, 2), ("m", 1, 0, 1, 4)], "method string, seq int, out_degree int, loop_depth int, stmt_count int")
    assert rows(flows.centroids(b, spark.createDataFrame([("m", 0, 1)], "method string, src int, dst int"))) == [("m", 4 / 6, 2 / 6, 4 / 6, 6)]


def test_catalogue(spark):
    t = spark.createDataFrame([(" a.b:0:2", "T", "c::d:1", "S", None, None), ("a.b:1", "T", None, None, "eval", "D")], "Sources string, SourceType string, Sinks string, SinkType string, Dangers string, DangerType string")
    c = catalogue.from_sensitive_apis(t)
    assert [(r.id, r.full_name, r.base_type, r.functionality, r.arg_ids) for r in c.orderBy("id").collect()] == [(1, "eval", None, "DANGER", []), (2, "c.d", "c", "SINK", [1]), (3, "a.b", "a", "SOURCE", [0, 1, 2])]
    assert catalogue.formula_of(c) == "((3) & (2)) | (1)"
    more = catalogue.extended(c, spark.createDataFrame([("p.q", "SINK", "S"), ("c.d", "SINK", "S")], "full_name string, functionality string, type string"))
    assert more.count() == 4 and more.filter("full_name = 'p.q'").first().id == 4
    assert catalogue.sink_parameters(c).count() == 2 and catalogue.trigger_words(c).count() == 2


def test_rules_language(spark):
    df = spark.createDataFrame([("open", "/etc/shadow", "8.8.8.8"), ("connect", "/tmp/.x", "10.2.3.4"), (None, None, None)], "evt_type string, fd_name string, fd_sip string")
    r = rules.Rules({"secret": ["/etc/shadow"]}, {"opens": "evt.type in (open, openat)"}, {"a": "opens and fd.name in (secret)", "b": "fd.sip in (10.0.0.0/8) or fd.name glob '/etc/*'", "c": "not fd.name exists"})
    assert sorted((x.evt_type or "", x.rule) for x in r.alerts(df).collect()) == [("", "c"), ("connect", "b"), ("open", "a"), ("open", "b")]
    for bad in ("nope", "a and", "fd.name in (x", "opens opens"):
        with pytest.raises(ValueError):
            r.column(bad)
    with pytest.raises(ValueError):
        rules.Rules(macros={"m": "m"}).column("m")


def test_usage_by_function_name(spark):
    used = spark.createDataFrame([("p", "a.run"), ("q", "run")], "pkg string, full_name string")
    known = spark.createDataFrame([(1, "b.run"), (2, "c.run"), (3, "run")], "id int, full_name string")
    assert rows(usage.api_ids(used, known, True)) == [("p", 1), ("p", 2), ("q", 3)]
    nobody = usage.formula_verdicts(spark.createDataFrame([("z",)], "pkg string"), used, known, "1 | 3")
    assert [(r.pkg, list(r.ids), r.satisfied) for r in nobody.collect()] == [("z", [], False)]


def test_control_flow(spark):
    from hornbeam.operators import control

    # 0 -> 1 -> 2 -> 1, 2 -> 3 -> 2, 1 -> 4: the loop at 2 lies in the loop at 1
    graph_ = {0: [1], 1: [2, 4], 2: [1, 3], 3: [2], 4: []}
    assert control.loop_depths(graph_, 0) == {0: 0, 1: 1, 4: 0, 2: 2, 3: 2}
    blocks = [{"block": k, "stmt_count": 1, "successors": v} for k, v in graph_.items()]
    df = spark.createDataFrame([("m", blocks), ("empty", [])], "method string, blocks array<struct<block:int,stmt_count:int,successors:array<int>>>")
    got = {r.block: (r.seq, r.out_degree, r.loop_depth) for r in control.block_features(df).collect()}
    assert got == {0: (0, 1, 0), 1: (1, 2, 1), 2: (2, 2, 2), 3: (3, 1, 2), 4: (4, 0, 0)}
    # two branches join in 4, which comes after both; the branch with more statements, then the larger digest, comes first
    split = {0: [1, 2], 1: [4], 2: [3], 3: [4], 4: []}
    assert control.joins(split) == {0: 4, 1: 4, 2: 3, 3: 4, 4: None} and control.joins({0: [1], 1: [0]}) == {0: None, 1: None}
    assert control.number_blocks(split, 0, {1: ["x", "y"], 2: ["x"]}) == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4}
    assert control.number_blocks(split, 0, {1: ["x"], 2: ["x", "y"]}) == {0: 0, 2: 1, 3: 2, 1: 3, 4: 4}
    texts = [{"block": k, "stmt_count": 1, "successors": v, "statements": [f"s{k}"]} for k, v in split.items()]
    df = spark.createDataFrame([("m", texts)], "method string, blocks array<struct<block:int,stmt_count:int,successors:array<int>,statements:array<string>>>")
    assert control.block_features(df).count() == 5


def test_break_cycles_leaves_no_cycle_and_drops_what_it_says(spark):
    # two components: 1 -> 2 -> 3 -> 1 with a chord 2 -> 1, and 7 -> 8 -> 7; 9 -> 1 is in none
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 1), (7, 8), (8, 7), (9, 1), (5, 5)], "src long, dst long")
    scores = spark.createDataFrame([(1, 1.0), (2, 5.0), (3, 3.0), (7, 1.0), (8, 1.0), (9, 9.0)], "id long, rank double")
    got = graph.break_cycles(edges, scores)
    # the dearest is 2 -> 3 (8), which leaves 1 <-> 2, where 2 -> 1 and 1 -> 2 cost the same and the larger source goes
    assert rows(got) == [(1, 2), (3, 1), (7, 8), (9, 1)] and graph.is_dag(got)
    with pytest.raises(ValueError):
        graph.break_cycles(edges, scores.filter("id <> 9"))


def test_marks_travel_up(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    marks = spark.createDataFrame([("c", 1), ("z", 2)], "id string, mark int")
    assert rows(graph.inherited(edges, marks)) == [("a", 1), ("b", 1), ("c", 1), ("d", 1), ("z", 2)]
    found, unknown = graph.high_impact(spark.createDataFrame([("c",), ("q",)], "id string"), edges)
    assert {r.dependent for r in found.collect()} == {"a", "b", "d"} and rows(unknown) == [("q",)]
    assert rows(graph.attractors(edges.union(spark.createDataFrame([("a", "e")], "src string, dst string")))) == [("e", "e", 1)]


def test_dispatch(spark):
    rows_ = spark.createDataFrame([("p", "a.b", "x.py"), ("q", "a.b", "y.py")], "pkg string, full_name string, file string")
    assert rows(dispatch.statistics("api", rows_)) == [("a.b", 2), ("analyzed", 2)]
    known = spark.createDataFrame([("a.b", "SINK", None, "EXEC")], "full_name string, functionality string, source_type string, sink_type string")
    assert rows(dispatch.statistics("permission", rows_, known)) == [("EXEC", 2), ("analyzed", 2)]
    with pytest.raises(ValueError):
        dispatch.statistics("weather", rows_)


def test_authors_and_values_without_a_name(spark):
    p = spark.createDataFrame([(None, "a"), (None, "b"), ("x", "c"), ("x", "d"), ("y", "e")], "author string, pkg string")
    assert rows(authors.same_author(p)) == [("x", ["c", "d"])] and rows(authors.author_packages(p)) == [("x", "c"), ("x", "d")]
    cell = spark.createDataFrame([("{'owners': [{'email': 'a@b.c', 'web': 'd@e.f'}]}",)], "x string")
    assert cell.select(authors.author_emails("x", "ruby")).first()[0] == ["a@b.c"] and cell.select(authors.author_emails("x", "python")).first()[0] == ["a@b.c", "d@e.f"]
    v = spark.createDataFrame([("p", "r", "1"), ("q", "r", "1"), ("p", "r", "2")], "pkg string, rule string, value string")
    assert rows(behavior.value_counts(v, most=1, detail=True)) == [("r", "2", 1, ["p"])]


def test_names_of_one_scope_do_not_all_meet(spark, monkeypatch):
    monkeypatch.setattr(similarity, "HOT", 20)
    r = random.Random(4)
    names = ["scope-" + "".join(r.choice("abcdefgh") for _ in range(8)) for _ in range(400)]
    names += [n[:9] + "x" + n[9:] for n in names[:40]] + [n[:7] + n[8:] for n in names[40:80]] + ["sc" + n[3:] for n in names[80:120]] + ["a", "", "scope-"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(x.a, x.b): x.distance for x in similarity.edit_distance_pairs(df, limit=2).collect()}
    every = sorted(set(names))
    want = {(a, b): d for i, a in enumerate(every) for b in every[i + 1 :] if abs(len(a) - len(b)) <= 2 and (d := distance(a, b)) <= 2}
    assert got == want and len(want) > 120


def test_near_names_of_a_group(spark):
    r = random.Random(8)
    some = [(k % 3, k, "n" + "".join(r.choice("ab1") for _ in range(r.randrange(7)))) for k in range(90)] + [(None, 90, "n"), (1, 91, None), (1, 92, "é1")]
    got = rows(similarity.near_in_groups(spark.createDataFrame(some, "g int, k int, n string"), "g", "k", "n", 2))
    text = lambda x: x.encode().decode("latin-1")
    want = [(a, b, d) for g, a, x in some for h, b, y in some if g is not None and g == h and x is not None and y is not None and (d := distance(text(x), text(y))) <= 2]
    assert got == sorted(want, key=repr)


def test_numbered_names_meet_by_a_third_key(spark, monkeypatch):
    monkeypatch.setattr(similarity, "HOT", 20)
    monkeypatch.setattr(similarity, "SECOND", 5)
    for limit in (1, 2):
        every = sorted({f"Supplier#{k * 7 % 3000:09d}" for k in range(150)} | {"Supplier#00000001", "Supplier#0000000212", "upplier#000000021"})
        got = {(x.a, x.b): x.distance for x in similarity.edit_distance_pairs(spark.createDataFrame([(n,) for n in every], "name string"), limit=limit).collect()}
        want = {(a, b): d for i, a in enumerate(every) for b in every[i + 1 :] if abs(len(a) - len(b)) <= limit and (d := distance(a, b)) <= limit}
        assert got == want and len(want) > 50


@pytest.mark.parametrize("least", [0.15, 0.5, 0.8])
def test_neighbour_similarity_equals_all_pairs(spark, least):
    r = random.Random(6)
    sets = {k: {r.randrange(30) if r.random() < 0.7 else 99 for _ in range(r.randint(1, 12))} for k in range(60)}
    sets |= {100 + k: set(list(sets[k])[:-1]) or {1} for k in range(20)}
    df = spark.createDataFrame([(a, b) for a, s in sets.items() for b in s], "src long, dst long")
    got = {(x.a, x.b): x.jaccard for x in graph.neighbour_similarity(df, least).collect()}
    want = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) / len(x | y) >= least}
    assert got == pytest.approx(want)


def test_findings_and_lists_of_engines(spark):
    import json

    ruby = json.dumps({"warnings": [{"warning_type": "SQL", "fingerprint": "f1", "file": "a.rb", "line": 3, "code": "q(x)", "user_input": "params"}] * 2})
    python = json.dumps({"vulnerabilities": [{"source": {"label": "l", "line_number": 1, "path": "a.py"}, "sink": {"label": "m", "line_number": 9, "path": "a.py"}, "source_trigger_word": "input(", "sink_trigger_word": "run("}]})
    reports = lambda x: spark.createDataFrame([("p", x), ("q", "no json"), ("r", None)], "pkg string, value string")
    assert [(r.pkg, r.source, r.sink_line, r.finding) for r in findings.parsed(reports(ruby), "ruby").collect()] == [("p", "params", 3, "f1")]
    got = findings.parsed(reports(python), "python").first()
    assert (got.source, got.sink, got.source_line, got.sink_line) == ("input(", "run(", 1, 9) and len(got.finding) == 64
    known = spark.createDataFrame([("a.b", "b", "a", "SINK", [0]), ("c", "c", None, "SOURCE", []), ("d", "d", None, "DANGER", [])], "full_name string, name string, base_type string, functionality string, arg_ids array<int>")
    assert json.loads(findings.report_of(known, "python").first().json) == {"sources": ["c", "d"], "sinks": {"a.b": {}}}
    assert json.loads(findings.report_of(known, "php").first().json) == {"sources": [{"name": "c"}], "sinks": [{"name": "b", "instanceof": "a", "parameters": ["1"]}]}
    with pytest.raises(ValueError):
        findings.report_of(known, "cobol")


def test_parts_of_names_of_one_scope(spark, monkeypatch):
    monkeypatch.setattr(similarity, "HOT", 10)
    r = random.Random(9)
    names = ["react-native-" + "".join(r.choice("ab") for _ in range(k % 14)) for k in range(150)] + ["x-react-native-ab", "react-", "react-n", "native", "other-name", "my-other-name", "short"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    every = sorted(set(names))
    assert rows(similarity.combo_squats(df)) == sorted((a, b) for a in every for b in every if a != b and len(a) > 5 and len(b) > 5 and a in b)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_neighbour_similarity_of_sets_that_mostly_meet_shuffles_no_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(graph, "BLOCK", 64)
    monkeypatch.setattr(graph, "COLUMNS", 16)
    rng = random.Random(7)
    sets = {k: frozenset(rng.sample(range(100), rng.randint(20, 40)) + [1000 + k % 90]) for k in range(250)}
    df = spark.createDataFrame([(k, d) for k, v in sets.items() for d in v], "src long, dst long").select(F.col("src").cast(kind), F.col("dst").cast(kind))
    found = graph.neighbour_similarity(df, 0.3)
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    name = int if kind == "long" else str
    want = {}
    for a, b in itertools.combinations(sets, 2):
        if (s := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= 0.3:
            want[tuple(sorted((name(a), name(b))))] = s
    got = {(x.a, x.b): x.jaccard for x in found.collect()}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_rounds_of_graph_loops_broadcast_nothing(spark):
    """What each round joins is small here, so a join without more said would be broadcast by adaptive execution."""
    edges = spark.createDataFrame([(k, k // 2) for k in range(1, 200)], "src long, dst long")
    marks = spark.createDataFrame([(k, k % 3) for k in range(0, 200, 5)], "id long, mark int")
    seen, sc = [], spark.sparkContext._jsc.sc()
    store = spark._jsparkSession.sharedState().statusStore()
    for run in (lambda: graph.dependency_counts(edges), lambda: graph.use_counts(marks.select("id"), edges), lambda: graph.high_impact(marks.limit(2).select("id"), edges)[0], lambda: graph.inherited(edges, marks), lambda: graph.levels(edges)):
        before = store.executionsCount()
        run().collect()
        sc.listenerBus().waitUntilEmpty(30_000)
        ran = store.executionsList(before, 10_000)
        seen.append([k for k in range(ran.size()) if "BroadcastExchange" in ran.apply(k).physicalPlanDescription()])
    assert seen == [[]] * 5


def test_tasks_are_cut_by_rows_and_not_by_the_number_of_shuffle_partitions(spark, monkeypatch):
    from hornbeam.functions import storage

    monkeypatch.setattr(storage, "TASK_ROWS", 100)
    items = spark.range(2000).select((F.col("id") % 50).alias("pkg"), (F.col("id") % 7).alias("version"), F.concat(F.lit("k"), (F.col("id") % 11).cast("string")).alias("key"))
    for cut, whole in (
        (versions.compare(items, rows=2000), versions.compare(items)), (versions.compare(items, "global", 2000), versions.compare(items, "global")), (versions.common_keys(items, 2000), versions.common_keys(items)),
        (behavior.containers_by_pair(items.select(F.col("pkg").alias("src"), F.col("version").alias("dst"), F.col("key").alias("container")), 2000), behavior.containers_by_pair(items.select(F.col("pkg").alias("src"), F.col("version").alias("dst"), F.col("key").alias("container")))),
    ):
        assert rows(cut) == rows(whole)
        assert ", 20), REPARTITION_BY_NUM" in cut._jdf.queryExecution().toString()


@pytest.mark.parametrize("large", [0, 40, flows.LARGE])
def test_reaching_definitions_of_any_graph(spark, monkeypatch, large):
    """Functions with cycles, doubled edges, kills of what nobody makes and empty lists, against a plain fixpoint; the same
    whether functions are worked on in a task or in rounds."""
    r = random.Random(5)
    blocks, edges, want = [], [], set()
    for f in range(6):
        n = r.randrange(1, 9)
        made = {b: r.sample("abcdef", r.randrange(3)) for b in range(n)}
        killed = {b: r.sample("abcdefg", r.randrange(4)) for b in range(n)}
        flow = [(r.randrange(n), r.randrange(n + 1)) for _ in range(2 * n)]
        blocks += [(f"f{f}", b, made[b], killed[b]) for b in range(n)]
        edges += [(f"f{f}", a, b) for a, b in flow + flow[:2]]
        holds: dict[int, set] = {b: set() for b in range(n + 1)}
        for _ in range(20):
            for a, b in flow:
                holds[b] |= set(made[a]) | holds[a] - set(killed[a])
        want |= {(f"f{f}", b, d) for b, some in holds.items() for d in some}
    monkeypatch.setattr(flows, "LARGE", large)
    b = spark.createDataFrame(blocks, "function string, block int, generates array<string>, kills array<string>")
    got = rows(flows.reaching_definitions(b, spark.createDataFrame(edges, "function string, src int, dst int")))
    assert len(got) == len(want) and set(got) == want and rows(flows.reaching_definitions(b.limit(0), spark.createDataFrame([], "function string, src int, dst int"))) == []


def test_reaching_definitions_take_no_round_a_block(spark):
    n, sc = 30, spark.sparkContext
    b = spark.createDataFrame([("f", k, [f"x{k}"], []) for k in range(n)], "function string, block int, generates array<string>, kills array<string>")
    e = spark.createDataFrame([("f", k, k + 1) for k in range(n - 1)], "function string, src int, dst int")
    sc.setJobGroup("reaching", "")
    try:
        assert flows.reaching_definitions(b, e).count() == n * (n - 1) // 2
        assert len(sc.statusTracker().getJobIdsForGroup("reaching")) < n
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
