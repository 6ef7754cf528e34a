"""Matched calls, conditions of sinks, summaries by package, checks of calls, budgets of time."""

import random
import time

import pytest

from hornbeam.functions.deadline import within
from hornbeam.operators import checks, extract, flows, graph, paths
from hornbeam.plans import analysis
from tests.conftest import rows


def files(spark, *content, pkg="p"):
    return spark.createDataFrame([(pkg, f"f{k}", c) for k, c in enumerate(content)], "pkg string, path string, content string")


def names(spark, *x):
    return spark.createDataFrame([(i,) for i in x], "name string")


def lines(found):
    """The lines of the sinks."""
    return sorted(int(r.sink.rsplit("@", 1)[1].split(".")[0]) for r in found.collect())


def matched(spark, code, clean=()):
    e = flows.def_use_edges(files(spark, code), sites=True)
    return paths.realizable(e, flows.calls(e, names(spark, "read")), flows.calls(e, names(spark, "run")), flows.calls(e, names(spark, *clean)) if clean else None)


def test_only_the_tainted_call_reaches_the_sink(spark):
    code = "def same(x):\n    return x\na = same(read())\nb = same(1)\nrun(b)\nrun(a)\n"
    assert lines(matched(spark, code)) == [6]
    assert matched(spark, code, ["same"]).count() == 0
    e = flows.def_use_edges(files(spark, code))  # without call sites both calls are one
    assert flows.flows(e, flows.calls(e, names(spark, "read")), flows.calls(e, names(spark, "run"))).count() == 1


def test_calls_within_calls_and_recursion(spark):
    code = "def one(x):\n    return two(x)\ndef two(y):\n    return y\ndef back():\n    z = read()\n    return z\ndef down(v, n):\n    run(n)\n    down(n, v)\nrun(one(read()))\nrun(two(1))\nrun(back())\ndown(read(), 1)\n"
    assert lines(matched(spark, code)) == [9, 11, 13]  # line 9: only after the arguments have changed places
    assert matched(spark, "def f(x):\n    return f(x)\nrun(f(read()))\n").count() == 0
    assert matched(spark, "run(unknown(read()))\n").count() == 1 and matched(spark, "run(1)\n").count() == 0


def brute(edges, source):
    """Nodes reached by walks whose returns match, with the sites they are in as a stack."""
    seen, todo = {(source, ())}, [(source, ())]
    while todo:
        node, stack = todo.pop()
        for s, d, kind, site in edges:
            if s != node or kind == "result" and stack and stack[-1] != site:
                continue
            new = (d, stack + (site,) if kind == "call" else stack[:-1] if kind == "result" else stack)
            if len(new[1]) < 7 and new not in seen:
                seen.add(new)
                todo.append(new)
    return {n for n, _ in seen} - {source}


def test_realizable_equals_walks_with_stacks(spark):
    rnd, edges, want = random.Random(3), [], set()
    for pkg in range(12):
        own = set()
        for site in range(7):  # function a calls b; nodes: in, out, two inside
            a, b = rnd.randrange(4), rnd.randrange(4)
            own |= {(f"{a}.{rnd.choice('in')}", f"{b}.i", "call", f"s{site}"), (f"{b}.o", f"{a}.{rnd.choice('no')}", "result", f"s{site}")}
        for f in range(4):
            own |= {(f"{f}.{rnd.choice('in')}", f"{f}.{rnd.choice('no')}", "inner", None) for _ in range(2)}
        own = {e for e in own if e[0] != e[1]}
        edges += [(pkg, *e) for e in own]
        want |= {(pkg, f"{f}.n", n) for f in range(4) for n in brute(own, f"{f}.n")}
    e = spark.createDataFrame(edges, "pkg int, src string, dst string, kind string, site string")
    ends = e.selectExpr("pkg", "explode(array(src, dst)) AS id").distinct()
    got = {(r.pkg, r.source, r.sink) for r in paths.realizable(e, ends.filter("id LIKE '%.n'"), ends).collect() if r.source != r.sink}
    assert got == want and len(want) > 50


def test_packages_are_walked_by_tasks_as_in_rounds(spark, monkeypatch):
    """With rows that repeat, nulls, ends named for all packages, and packages that are walked in rounds."""
    rnd, edges, kinds = random.Random(5), [], ["call", "result", "argument", "parameter", "return", "assign", None]
    for pkg in [*"abcdefghijkl", None]:
        size = rnd.choice([15, 40])
        for _ in range(size):
            node = lambda: rnd.choice([*range(size // 3), None]) if rnd.random() < 0.1 else rnd.randrange(size // 3)
            src, dst, kind = node(), node(), rnd.choices(kinds, [5, 5, 3, 2, 2, 4, 1])[0]
            edges.append((pkg, None if src is None else f"n{src}", None if dst is None else f"n{dst}", kind, rnd.choice(["s0", "s1", "s2", None])))
    e = spark.createDataFrame(edges + edges[::7], "pkg string, src string, dst string, kind string, site string")
    of = lambda *ids: spark.createDataFrame([(p, i) for p in "abcdefghijklm" for i in ids], "pkg string, id string")
    for_all = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    ends = e.selectExpr("pkg", "dst AS id").distinct()
    for tables, large, least in [((ends, ends, for_all("n4")), 25, 500), ((for_all("n0", "n1", None, "none"), for_all("n2", "n3", None), of("n1", None)), paths.LARGE, 5)]:
        monkeypatch.setattr(paths, "LARGE", large)
        want = rows(paths._realizable(e, *tables))
        assert rows(paths.realizable(e, *tables)) == want and len(want) > least
    assert rows(paths.realizable(e.limit(0), ends, ends)) == []


def test_matched_calls_store_nothing(spark, monkeypatch):
    made, kind = [], type(spark.range(0))
    store = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a: made.append(1) or store(self, *a))
    assert analysis.matched_calls(spark, "/root/testdata/sf0.001").count() > 0 and not made
    plan = analysis.matched_calls(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # orders by customer


def test_accepted_paths(spark):
    e = spark.createDataFrame([("a", "b", "x"), ("b", "c", "y"), ("b", "c", "x"), ("c", "a", "x"), ("c", "d", "z")], "src string, dst string, label string")
    steps = spark.createDataFrame([(0, "x", 0), (0, "y", 1), (1, "x", 1), (1, "z", 2)], "state int, label string, to int")
    start = spark.createDataFrame([("a", 0)], "id string, state int")
    ends = spark.createDataFrame([("c",), ("d",)], "id string")
    assert rows(paths.accepted_paths(e, steps, start, ends)) == [("a", "c", 0, ["a", "b", "c"]), ("a", "c", 1, ["a", "b", "c"]), ("a", "d", 2, ["a", "b", "c", "d"])]
    assert paths.accepted_paths(e.limit(0), steps, start, ends).count() == 0


def test_harm_by_condition():
    p = paths
    assert p.harms(0, None) and p.harms(p.IN_QUOTES, "QUOTES") and not p.harms(p.CLEAN, None)
    assert p.harms(p.CLEAN, "QUOTES") and p.harms(p.CLEAN | p.IN_QUOTES, "QUOTES") and not p.harms(p.CLEAN | p.IN_QUOTES | p.NO_QUOTES, "QUOTES") and not p.harms(p.ALL_CLEAN, "QUOTES")
    assert p.harms(p.ARRAY, "array_tainted") and not p.harms(p.ARRAY, "QUOTES") and p.harms(p.OBJECT, "object_tainted") and not p.harms(p.OBJECT, "array_tainted")
    assert p.after(p.ARRAY, flows.ELEMENT, [], "sql") == 0 and p.after(0, flows.CAST, [], "sql") is None and p.after(0, "valid", [], "sql") is None
    assert p.after(0, flows.PLAIN, ["sql"], "sql") == p.CLEAN and p.after(0, flows.PLAIN, ["xss"], "sql") == 0


def test_labels_of_php(spark):
    code = """<?php
$a = "x '" . $q . "'"; $b = (int) $c; $d = $e['k']; $f = $g->h; $i = [1, $j]; $k = array($l);
$m = "it is '$n' and $o";
if (ok($p)) { $r = $p; } else { $s = $p; }
if (!ok($t)) { $u = $t; } else { $v = $t; }
if (ok($w . 'x')) { $y = $w; }
"""
    got = {(r.src.split(":")[1], r.dst.split(":")[1]): r.label for r in flows.def_use_edges(files(spark, code), "php", sites=True).filter("kind = 'assign'").collect()}
    assert got == {("$q", "$a"): "quoted", ("$c", "$b"): "cast", ("$e", "$d"): "element", ("$g", "$f"): "field", ("$j", "$i"): "collect", ("$l", "$k"): "collect", ("$n", "$m"): "quoted", ("$o", "$m"): "plain", ("$p", "$r"): "valid:ok", ("$p", "$s"): "plain", ("$t", "$u"): "plain", ("$t", "$v"): "valid:ok", ("$w", "$y"): "plain"}


def test_summaries_stay_with_those_who_depend(spark):
    code = {"a": "def get():\n    return input()\n", "b": "def mid():\n    return get()\n", "c": "def get():\n    return 1\n", "d": "run(get())\n", "x": "run(mid())\n", "n": "run(input())\n"}
    df = spark.createDataFrame([(p, f"{p}.py", c) for p, c in code.items()], "pkg string, path string, content string")
    needs = spark.createDataFrame([("b", "a"), ("d", "c"), ("x", "b"), ("x", None)], "src string, dst string")
    found = flows.taint_tree(needs, flows.def_use_edges(df).select("pkg", "src", "dst"), names(spark, "input"), names(spark, "run"))
    assert sorted(r.pkg for r in found.collect()) == ["n", "x"]  # n is in no dependency; d's get() is c's
    assert flows.taint_tree(needs.limit(0), flows.def_use_edges(df.limit(0)).select("pkg", "src", "dst"), names(spark, "input"), names(spark, "run")).count() == 0


def test_chains_and_checks(spark):
    code = "User.where(a: 1).joins(:b).order(\"x #{y}\")\nq.order(\"x #{y}\")\nraw(params[:x]).strip()\nUser.order(\"#{y.to_i}\")\n"
    df = spark.createDataFrame([("p", None, "ruby", "a.rb", code)], "pkg string, version string, language string, path string, content string")
    i = checks.index(extract.api_calls(df))
    got = {(r.method, r.start_row): (r.target, r.root, r.chain, r.nested) for r in i.collect()}
    assert got["order", 1] == (None, "User", ["where", "joins", "order"], False) and got["joins", 1] == (None, "User", ["where", "joins"], True)
    assert got["where", 1] == ("User", "User", ["where"], True) and got["order", 2] == ("q", "q", ["order"], False) and got["raw", 3] == ("", "", ["raw"], True)
    found = checks.find(i, checks.ruby_checks(spark))
    assert rows(found.select("check", "method", "start_row")) == [("sql", "order", 1)]
    loose = checks.ruby_checks(spark).filter("check = 'unescaped'").withColumn("nested_ok", checks.F.lit(True))
    assert rows(checks.find(i, loose).select("method", "start_row")) == [("raw", 3)]
    any_order = spark.createDataFrame([("mine", None, "^ord", None, None, False, None, None, None, None, "m", "low")], checks.CHECK)
    assert rows(checks.find(i, any_order).select("start_row")) == [(1,), (2,), (4,)]
    assert len({c[0] for c in checks.RUBY}) >= 8


def test_a_slow_file_costs_itself_only(spark, monkeypatch):
    def slow(source, mode):
        if source == "slow":
            while True:
                time.sleep(0.01)
        yield None, "f", [], source, 1, 0, 1, 1

    monkeypatch.setitem(extract.EXTRACTORS, "python", slow)
    began = time.time()
    assert extract.file_calls("python", "slow", seconds=0.3)[1] == "TimeoutError: not done in 0.3 s" and time.time() - began < 5
    assert extract.file_calls("python", "quick", seconds=0.3)[0][0][3] == "quick"
    with within(5):
        with pytest.raises(TimeoutError), within(0.05):
            time.sleep(1)
        assert 0 < within.__wrapped__.__globals__["signal"].getitimer(0)[0] < 5
    df = spark.createDataFrame([("p", "1", "python", "a.py", "f(" * 50_000 + ")" * 50_000), ("p", "1", "python", "b.py", "g()")], "pkg string, version string, language string, path string, content string")
    monkeypatch.undo()
    got = rows(extract.api_calls(df, seconds=20).selectExpr("file", "name", "error IS NOT NULL"))
    assert got == [("a.py", None, True), ("b.py", "g", False)]


@pytest.mark.parametrize("language,text", [("javascript", "function f%d(a) {\n  var x = g(a, h(a));\n  return x.y(%d);\n}\n"), ("php", "function f%d($a) {\n  $x = g($a, h($a));\n  return $x->y(%d);\n}\n"), ("python", "def f%d(a):\n    x = g(a, h(a))\n    return x.y(%d)\n")])
def test_work_follows_the_length(language, text):
    def seconds(n):
        code = "".join(text % (k, k) for k in range(n))
        began = time.process_time()
        assert sum(1 for _ in flows.EDGE_READERS[language](code, True)) > 5 * n and len(extract.file_calls(language, code)[0]) >= 3 * n
        return time.process_time() - began

    seconds(300)
    assert min(seconds(4000) for _ in range(2)) < 2.8 * min(seconds(2000) for _ in range(2))


def test_statement_ends_and_scopes():
    js = "var a = f(1,\n  b) + c\nvar d = function e() { return g; }\nfor (i = 0; i < h; i++) { j = k }\nl = m"
    got = {(s.split(":")[1], d.split(":")[1], s.split(":")[0]) for s, d, kind, *_ in flows.script_edges(js, "javascript") if kind == "assign"}
    assert {("f()", "a", "|<module>"), ("c", "a", "|<module>"), ("k", "j", "|<module>"), ("m", "l", "|<module>")} <= got and not any(d == "i" for _, d, _ in got)


def test_the_table_function(spark):
    extract.register(spark)
    df = spark.createDataFrame([(1, "python", "f(1)"), (2, "python", "f("), (3, "cobol", "x"), (4, None, None)], "k int, l string, s string")
    got = spark.sql("SELECT k, name, error IS NOT NULL FROM {df}, LATERAL api_calls_of(l, s)", df=df)
    assert rows(got) == [(1, "f", False), (2, None, True), (3, None, True), (4, None, True)]


def one_by_one(edges, rank):
    """Edges that are left when the highest one of every strong component goes, again and again."""
    left = {(a, b) for a, b in edges if a != b}
    while True:
        reach = {}
        for a in {x for e in left for x in e}:
            seen, todo = set(), [a]
            while todo:
                x = todo.pop()
                for s, d in left:
                    if s == x and d not in seen:
                        seen.add(d)
                        todo.append(d)
            reach[a] = seen
        parts = {}
        for a, b in left:
            if a in reach[b]:
                parts.setdefault(min(x for x in reach[a] if a in reach[x]), []).append((rank[a] + rank[b], a, b))
        if not parts:
            return left
        for own in parts.values():
            left.remove(max(own)[1:])


def test_cycles_are_broken_as_one_by_one(spark):
    rnd, edges, rank = random.Random(6), set(), {}
    for part in range(2):
        nodes = [f"{part}.{k}" for k in range(5)]
        rank |= {n: rnd.choice([0.5, 1.0, 2.0, 3.0]) for n in nodes}
        edges |= {(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(9)}
    e, scores = spark.createDataFrame(sorted(edges), "src string, dst string"), spark.createDataFrame(sorted(rank.items()), "id string, rank double")
    want = one_by_one(edges, rank)
    assert set(rows(graph.break_cycles(e, scores, rounds=0))) == want and len(want) < len(edges)


def test_packages_that_are_alike_are_walked_once(spark):
    rows_of = lambda p, *more: [(p, "a", "b"), (p, "b", "c"), *((p, *m) for m in more)]
    e = spark.createDataFrame(rows_of("p") + rows_of("q") + rows_of("r") + rows_of("s", ("c", "d")) + rows_of("t", ("c", "d")) + rows_of("u"), "pkg string, src string, dst string")
    s, t = spark.createDataFrame([(x, "a") for x in "pqrstu"], "pkg string, id string"), spark.createDataFrame([(x, "c") for x in "pqrst"], "pkg string, id string")
    members = flows.alike(e, s, t)
    assert rows(members) == [("p", "p"), ("q", "p"), ("r", "p"), ("s", "s"), ("t", "s"), ("u", "u")]
    assert {x.pkg for x in flows.flows(e, s, t).collect()} == set("pqrst")
    assert flows.alike(e.filter("pkg IN ('p', 's')")) is None
