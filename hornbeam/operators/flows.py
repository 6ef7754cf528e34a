"""Source-to-sink reachability on code graphs, with summaries of dependencies and measures of control flow.

Nodes of def-use edges are texts: `path|scope:name` for a name in a function (or <module>, or Class.method) of a file,
`path|scope:call()` for a call's value, and `function#k` and `function#return` for what goes into and comes out of a
function, which the whole package shares, so that flows cross its files. Flows never leave a package.
"""

from __future__ import annotations

import ast
import bisect
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hornbeam.functions.deadline import within
from hornbeam.functions.storage import Parts, cut, in_arrow, spread
from hornbeam.operators.extract import NOT_CALLS, brackets, masked, parts_of
from hornbeam.operators.graph import levels

EDGES = "pkg string, path string, src string, dst string, kind string, place int"
#: What def_use_edges() adds: the call that an edge goes into or comes out of, and what happens to the value on its way.
DETAILS = ", site string, label string"
Edge = tuple[str, str, str, int | None, str | None, str]
#: The name in a call's node, with or without its site.
CALLED = r"^[^|]*[|][^:]*:(.*)\(\)(?:@[\d.]+)?$"


def python_edges(source: str, sites: bool = False) -> Iterator[Edge]:
    def called(node, scope):
        return f"|{scope}:{ast.unparse(node.func)}()" + (f"@{node.lineno}.{node.col_offset}" if sites else "")

    def inputs(node, scope):
        """Names and calls that a value is made of; what a call takes goes into the call only."""
        if isinstance(node, ast.Call):
            yield called(node, scope)
            return
        if isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load):
            yield f"|{scope}:{node.id}"
        for child in ast.iter_child_nodes(node):
            yield from inputs(child, scope)

    def visit(node, scope, owner):
        for child in ast.iter_child_nodes(node):
            inner, within = scope, owner
            if isinstance(child, ast.ClassDef):
                within = f"{owner}{child.name}."
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                inner, within = f"{owner}{child.name}", ""
                for k, a in enumerate(child.args.args):
                    yield f"{inner}#{k}", f"|{inner}:{a.arg}", "parameter", k, None, PLAIN
            elif isinstance(child, (ast.Assign, ast.AnnAssign, ast.AugAssign)) and child.value is not None:
                for t in child.targets if isinstance(child, ast.Assign) else [child.target]:
                    for n in ast.walk(t):
                        if isinstance(n, ast.Name):
                            for i in inputs(child.value, scope):
                                yield i, f"|{scope}:{n.id}", "assign", None, None, PLAIN
            elif isinstance(child, ast.Return) and child.value is not None:
                for i in inputs(child.value, scope):
                    yield i, f"{scope}#return", "return", None, None, PLAIN
            elif isinstance(child, ast.Call):
                call, site = called(child, scope), f"{child.lineno}.{child.col_offset}"
                if isinstance(child.func, ast.Attribute):
                    for i in inputs(child.func.value, scope):
                        yield i, call, "receiver", None, None, PLAIN
                for k, a in enumerate([*child.args, *(w.value for w in child.keywords)]):
                    for i in inputs(a, scope):
                        yield i, call, "argument", k, site, PLAIN
                        if isinstance(child.func, ast.Name):
                            yield i, f"{child.func.id}#{k}", "call", k, site, PLAIN
                if isinstance(child.func, ast.Name):
                    yield f"{child.func.id}#return", call, "result", None, site, PLAIN
            yield from visit(child, inner, within)

    yield from visit(ast.parse(source), "<module>", "")


#: Per language: a name, a function's head (name, or the name it is assigned to, and parameters), an assignment's left side.
_IDENTIFIER = {"javascript": r"[A-Za-z_$][\w$]*", "php": r"\$[A-Za-z_]\w*"}
_FUNCTION = {
    "javascript": r"(?:\bfunction\s*\*?\s*([\w$]+)?|([\w$]+)\s*[:=]\s*(?:async\s+)?function\s*\*?|([\w$]+)\s*=\s*(?:async\s*)?(?=\([\w$,\s]*\)\s*=>))\s*\(([^()]*)\)\s*(?:=>\s*)?\{",
    "php": r"\bfunction\s+&?(\w+)()()\s*\(([^()]*)\)[^{;]*\{",
}
_ASSIGN = {
    "javascript": r"(?<![\w$.])([A-Za-z_$][\w$]*)(?:\s*(?:\.[\w$]+|\[[^\]\n]*\]))*\s*(?:[+\-*/%|&^]|\|\||&&|\?\?)?=(?![=>])",
    "php": r"(\$[A-Za-z_]\w*)(?:\s*(?:->\w+|\[[^\]\n]*\]))*\s*(?:[+\-*/%|&^.]|\?\?)?=(?![=>])",
}
_CALL = {
    "javascript": r"((?<![\w$])(?:[A-Za-z_$][\w$]*\s*(?:\?\.|\.)\s*)*[A-Za-z_$][\w$]*)\s*\(",
    "php": r"((?<![\w\\])(?:\$?[A-Za-z_\\][\w\\]*\s*(?:->|::)\s*)*[A-Za-z_\\][\w\\]*)\s*\(",
}
_RESERVED = {"javascript": {"var", "let", "const", "new", "this", "true", "false", "null", "undefined", "function", "return", "typeof", "in", "of", "async", "await"}, "php": {"$this"}}
#: What happens to a value on its way: nothing that is known, between single quotes in a longer text, made a number, an
#: array's element or an object's field is read, it becomes an array's element.
PLAIN, QUOTED, CAST, ELEMENT, FIELD, COLLECT = "plain", "quoted", "cast", "element", "field", "collect"
#: PHP: a text that ends in a quote and goes on, a cast to a number, texts with names in them, tests of a name.
_AFTER_QUOTE = re.compile(r"'\s*\"\s*\.\s*$|\\'\s*'\s*\.\s*$")
_AFTER_CAST = re.compile(r"\(\s*(?:int|integer|float|double|bool|boolean)\s*\)\s*$")
_TEXT = re.compile(r"\"(?:\\.|[^\"\\])*\"", re.S)
_TEST = re.compile(r"\bif\s*\(\s*(!?)\s*([A-Za-z_\\][\w\\]*)\s*\(")
_ELSE = re.compile(r"\s*else\s*\{")


class _Script:
    """What stands where in a script: found once, looked up by bisection, so that the work follows the script's length."""

    def __init__(self, source: str, language: str):
        self.source, self.language = source, language
        self.plain = plain = masked(source, language)
        self.closed = brackets(plain)
        self.functions = []  # (bracket, name, parameters)
        for m in re.finditer(_FUNCTION[language], plain):
            if name := m[1] or m[2] or m[3]:
                self.functions.append((m.end() - 1, name, re.findall(_IDENTIFIER[language], m[4])))
        self.calls = []  # (from, bracket, to, name)
        for m in re.finditer(_CALL[language], plain):
            name = re.sub(r"\s", "", m[1])
            if name.split(".")[0] not in NOT_CALLS[language] and not re.search(r"\bfunction\s*&?$", plain[max(0, m.start() - 20) : m.start()]):
                self.calls.append((m.start(), m.end() - 1, self.closed[m.end() - 1], name))
        self.call_starts = [c[0] for c in self.calls]
        found = [(m.start(), m[0], False) for m in re.finditer(rf"(?<![\w$.>:]){_IDENTIFIER[language]}(?![\w$])(?!\s*\()", plain) if m[0] not in _RESERVED[language]]
        if language == "php":
            found += self._in_texts()
            found.sort()
        self.names, self.name_starts = found, [x[0] for x in found]
        self._scopes()
        self._statements()
        self.guards = self._guards() if language == "php" else {}

    def _in_texts(self) -> list[tuple[int, str, bool]]:
        """Names in texts between double quotes; whether single quotes stand around them."""
        out = []
        for t in _TEXT.finditer(self.source):
            if self.plain[t.start()] == '"' == self.plain[t.end() - 1] and "$" in t[0]:
                for m in re.finditer(_IDENTIFIER["php"], t[0]):
                    before = t[0][: m.start()].rstrip("{")
                    if m[0] not in _RESERVED["php"] and not before.endswith("\\"):
                        out.append((t.start() + m.start(), m[0], before.endswith("'")))
        return out

    def _scopes(self) -> None:
        self.scope_starts, self.scope_names, inside = [0], ["<module>"], []

        def leave(until: int) -> None:
            while inside and inside[-1][0] < until:
                end, _ = inside.pop()
                self.scope_starts.append(end + 1)
                self.scope_names.append(inside[-1][1] if inside else "<module>")

        for a, name, _ in sorted(self.functions):
            leave(a)
            inside.append((self.closed[a], name))
            self.scope_starts.append(a + 1)
            self.scope_names.append(name)
        leave(len(self.plain) + 1)

    def scope(self, k: int) -> str:
        return self.scope_names[bisect.bisect_right(self.scope_starts, k) - 1]

    def _statements(self) -> None:
        """Between which brackets each place is, and where statements between the same brackets end."""
        self.level_starts, self.levels, inside = [0], [0], [0]
        self.level_ends, self.stops, self.lines = [len(self.plain)], [[]], [[]]
        for m in re.finditer(r"[()\[\]{};\n]", self.plain):
            k, c = m.start(), m[0]
            if c in "([{":
                inside.append(len(self.level_ends))
                self.level_ends.append(len(self.plain))
                self.stops.append([])
                self.lines.append([])
            elif c in ")]}":
                if len(inside) == 1:
                    self.stops[0].append(k)
                    continue
                self.level_ends[inside.pop()] = k
            else:
                if c == ";":
                    self.stops[inside[-1]].append(k)
                elif self.language == "javascript" and self.plain[k - 1 : k] not in ("=", "+", ","):
                    self.lines[inside[-1]].append(k)
                continue
            self.level_starts.append(k + 1)
            self.levels.append(inside[-1])

    def statement_end(self, k: int) -> int:
        level = self.levels[bisect.bisect_right(self.level_starts, k) - 1]
        end, stops, lines = self.level_ends[level], self.stops[level], self.lines[level]
        if (i := bisect.bisect_left(stops, k)) < len(stops):
            end = min(end, stops[i])
        if lines and (m := _SOLID.search(self.plain, k)) and (i := bisect.bisect_right(lines, m.start())) < len(lines):
            end = min(end, lines[i])
        return end

    def _guards(self) -> dict[str, list[tuple[int, int, str]]]:
        """Name -> (from, to, function): where a test by that function has said yes to the name as it is."""
        out: dict[str, list[tuple[int, int, str]]] = {}
        for m in _TEST.finditer(self.plain):
            outer, end = self.plain.find("(", m.start()), self.closed[m.end() - 1]
            if self.plain[end + 1 : self.closed[outer]].strip():
                continue
            block = re.compile(r"\s*\{").match(self.plain, self.closed[outer] + 1)
            if block and m[1]:
                block = _ELSE.match(self.plain, self.closed[block.end() - 1] + 1)
            if block:
                for part in parts_of(self.plain, self.plain, m.end(), end):
                    if re.fullmatch(_IDENTIFIER["php"], part):
                        out.setdefault(part, []).append((block.end() - 1, self.closed[block.end() - 1], m[2]))
        return out

    def label(self, k: int, end: int, name: str = "", quoted: bool = False) -> str:
        """What happens to the value of the name, or call, from k to end."""
        for a, b, test in self.guards.get(name, ()):
            if a < k < b:
                return f"valid:{test}"
        if self.language != "php":
            return PLAIN
        if quoted:
            return QUOTED
        before, after = self.source[max(0, k - 40) : k], self.plain[end : end + 40].lstrip()
        if _AFTER_CAST.search(before):
            return CAST
        if _AFTER_QUOTE.search(before):
            return QUOTED
        if after.startswith("["):
            return ELEMENT
        if after.startswith("->"):
            return FIELD
        level = self.levels[bisect.bisect_right(self.level_starts, k) - 1]
        if level:
            opened = self.openings[level]
            if self.plain[opened] == "[" and not re.search(r"[\w\])$]\s*$", self.plain[max(0, opened - 20) : opened]) or re.search(r"\barray\s*$", self.plain[max(0, opened - 20) : opened]):
                return COLLECT
        return PLAIN

    @functools.cached_property
    def openings(self) -> list[int]:
        """Where each pair of brackets, numbered as in levels, begins."""
        return [-1, *(m.start() for m in re.finditer(r"[(\[{]", self.plain))]

    def inputs(self, a: int, b: int, scope: str, sites: bool) -> Iterator[tuple[str, str]]:
        """(node, label) of names and calls between two places; what a call takes, and whose it is, goes into the call
        only."""
        i, at = bisect.bisect_left(self.call_starts, a), a
        while at < b:
            call = self.calls[i] if i < len(self.calls) and self.calls[i][0] < b else None
            end = call[0] if call else b
            for n in range(bisect.bisect_left(self.name_starts, at), bisect.bisect_left(self.name_starts, end)):
                k, name, quoted = self.names[n]
                yield f"|{scope}:{name}", self.label(k, k + len(name), name, quoted)
            if call is None:
                return
            yield self.node(call, scope, sites), self.label(call[0], call[2] + 1)
            at = call[2]
            i = bisect.bisect_left(self.call_starts, at, i + 1)

    def node(self, call: tuple[int, int, int, str], scope: str, sites: bool) -> str:
        return f"|{scope}:{call[3]}()" + (f"@{call[0]}" if sites else "")


_SOLID = re.compile(r"\S")


def script_edges(source: str, language: str, sites: bool = False) -> Iterator[Edge]:
    """Edges of a script, found by tokens: a statement's value goes from all names and calls in it to what is assigned,
    returned, or called with it. Functions without a name share the scope that holds them."""
    s = _Script(source, language)
    for _, name, parameters in s.functions:
        for k, p in enumerate(parameters):
            yield f"{name}#{k}", f"|{name}:{p}", "parameter", k, None, PLAIN
    for m in re.finditer(_ASSIGN[language], s.plain):
        if m[1] not in _RESERVED[language]:
            scope = s.scope(m.start())
            for i, label in s.inputs(m.end(), s.statement_end(m.end()), scope, sites):
                yield i, f"|{scope}:{m[1]}", "assign", None, None, label
    for m in re.finditer(r"\breturn\b", s.plain):
        scope = s.scope(m.start())
        for i, label in s.inputs(m.end(), s.statement_end(m.end()), scope, sites):
            yield i, f"{scope}#return", "return", None, None, label
    for call in s.calls:
        start, bracket, end, name = call
        scope, node, site = s.scope(start), s.node(call, s.scope(start), sites), str(start)
        base = re.match(_IDENTIFIER[language], name)
        if base and base[0] != name and base[0] not in _RESERVED[language]:
            yield f"|{scope}:{base[0]}", node, "receiver", None, None, PLAIN
        at = bracket + 1
        for k, part in enumerate(parts_of(s.plain, s.plain, bracket + 1, end, strip=False)):
            for i, label in s.inputs(at, at + len(part), scope, sites):
                yield i, node, "argument", k, site, label
                yield i, f"{name}#{k}", "call", k, site, label
            at += len(part) + 1
        yield f"{name}#return", node, "result", None, site, PLAIN


EDGE_READERS = {"python": python_edges} | {x: (lambda source, sites=False, x=x: script_edges(source, x, sites)) for x in ("javascript", "php")}
#: Seconds that one file may take.
SECONDS = 60.0
#: A task keeps the edges of so many contents of so few characters: many packages have the same small files.
KEPT, SHORT = 200, 4000


def def_use_edges(files: DataFrame, language: str = "python", sites: bool = False, seconds: float = SECONDS) -> DataFrame:
    """Rows of EDGES of files (pkg, path, content) in a language of EDGE_READERS: values flow from names and calls into
    what is assigned, passed or returned; place is the argument's number. sites: each call is a node of its own, named by
    its place in the file, and the columns of DETAILS are added. Files that do not parse, or not in so many seconds, have
    no edges."""
    schema = EDGES + (DETAILS if sites else "")

    def work(batches):
        read = functools.lru_cache(KEPT)(lambda text: [*EDGE_READERS[language](text, sites)])
        for b in batches:
            rows = []
            for pkg, path, content in zip(*(c.to_pylist() for c in b.columns)):
                full = lambda node: f"{path}{node}" if node[0] == "|" else node  # noqa: B023, E731
                try:
                    with within(seconds):
                        found = {(full(s), full(d), k, p, f"{path}@{site}" if site else None, label) for s, d, k, p, site, label in (read if len(content or "") <= SHORT else read.__wrapped__)(content or "")}
                except (SyntaxError, ValueError, RecursionError, TimeoutError):
                    found = set()
                rows += [(pkg, path, *e) for e in sorted(found if sites else {e[:4] for e in found}, key=str)]
            kinds = [pa.string()] * 5 + [pa.int32()] + [pa.string()] * 2 * sites
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], [x.split()[0] for x in schema.split(", ")])

    return files.select("pkg", "path", F.col("content").cast("string")).transform(spread).transform(in_arrow, work, schema)


def alike(*tables: DataFrame) -> DataFrame | None:
    """(pkg, of): every package and the first of those that have the same rows in all tables (pkg, ...), by two hashes of
    64 bits of the sets of rows; null unless there are at least two packages for each such set. What is found in one
    package, and names no package, is found in its copies too."""
    rows = None
    for k, t in enumerate(tables):
        fields = [x for c in sorted(t.columns) if c != "pkg" for x in (F.col(c).isNull(), F.col(c))]
        own = t.distinct().select("pkg", *[F.xxhash64(F.lit(f"{seed}/{k}"), *fields).alias(f"h{seed}") for seed in range(2)])
        rows = own if rows is None else rows.unionByName(own)
    same = ["n", "h0", "h1"]
    sets = cut(rows.groupBy("pkg").agg(F.count("*").alias("n"), F.bit_xor("h0").alias("h0"), F.bit_xor("h1").alias("h1")))
    first = cut(sets.groupBy(*same).agg(F.min("pkg").alias("of")))
    if 2 * first.count() > sets.count():
        return None
    return cut(sets.join(first, same).select("pkg", "of"))


def only_first(table: DataFrame, members: DataFrame | None) -> DataFrame:
    """The rows of the first package of each kind."""
    return table if members is None or "pkg" not in table.columns else table.join(members.filter("pkg = of").select("pkg"), "pkg", "left_semi")


def for_all(found: DataFrame, members: DataFrame | None) -> DataFrame:
    """What was found in the first package of each kind, for all of the kind."""
    return found if members is None else found.withColumnRenamed("pkg", "of").join(members, "of").select(*found.columns)


def calls(edges: DataFrame, names: DataFrame) -> DataFrame:
    """([pkg,] id): the nodes of calls to the names (column name, and pkg where a name counts in one package only),
    whatever the file and function."""
    ends = edges.select("pkg", F.explode(F.array("src", "dst")).alias("id")).distinct()
    by = [c for c in ("pkg", "name") if c in names.columns]
    return ends.withColumn("name", F.regexp_extract("id", CALLED, 1)).join(names.select(*by).distinct(), by, "left_semi").select("pkg", "id")


def only_at(edges: DataFrame, sinks: DataFrame) -> DataFrame:
    """edges without arguments at places that do not matter: sinks (name, parameter) are calls that do harm by these
    arguments only; a name with a null parameter does by any."""
    named = F.regexp_extract("dst", CALLED, 1)
    some = sinks.groupBy("name").agg(F.collect_set("parameter").alias("_places"), F.max(F.col("parameter").isNull()).alias("_any")).filter(~F.col("_any"))
    joined = edges.join(some.withColumnRenamed("name", "_name"), named == F.col("_name"), "left")
    return joined.filter((F.col("kind") != "argument") | F.col("_places").isNull() | F.array_contains("_places", F.col("place"))).select(*edges.columns)


def flows(edges: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame | None = None, most_hops: int | None = None) -> DataFrame:
    """([pkg,] source, sink, hops): for each source and sink (column id) that it reaches, a shortest path, the first by
    text. Edges with a column pkg are walked within each package; sources, sinks and sanitizers may have it too, else
    they count in all. Edges out of sanitizers do not count. Every (source, node) is visited once, so cycles end;
    most_hops, if given, ends the search after so many edges. Packages that are alike are walked once."""
    if "pkg" not in edges.columns:
        return _flows(edges, sources, sinks, sanitizers, most_hops)
    edges = cut(edges.select("pkg", "src", "dst").distinct())
    members = alike(edges, *[t.select("pkg", "id") for t in (sources, sinks, sanitizers) if t is not None and "pkg" in t.columns])
    mine = [t if t is None else only_first(t, members) for t in (edges, sources, sinks, sanitizers)]
    return for_all(_flows(*mine, most_hops), members)


def _flows(edges: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame | None = None, most_hops: int | None = None) -> DataFrame:
    by = ["pkg"] if "pkg" in edges.columns else []
    here = lambda df: [c for c in by if c in df.columns]
    e = edges.select(*by, "src", "dst").distinct()
    if sanitizers is not None:
        e = e.join(sanitizers.select(*here(sanitizers), F.col("id").alias("src")), [*here(sanitizers), "src"], "left_anti")
    e = cut(e)
    start = sources.select(*here(sources), F.col("id").alias("source")).distinct()
    if here(sources) != by:
        start = start.join(e.select(*by, F.col("src").alias("source")).distinct(), "source")
    found = Parts(start.select(*by, "source", F.col("source").alias("at"), F.array("source").alias("hops")))
    frontier, hops = found.all(), 0
    while hops != most_hops and not frontier.isEmpty():
        hops += 1
        step = frontier.join(e.withColumnRenamed("src", "at"), [*by, "at"]).select(*by, "source", F.col("dst").alias("at"), F.concat("hops", F.array("dst")).alias("hops"))
        frontier = found.add(step.groupBy(*by, "source", "at").agg(F.min("hops").alias("hops")).join(found.all().select(*by, "source", "at"), [*by, "source", "at"], "left_anti"))
    ends = sinks.select(*here(sinks), F.col("id").alias("at")).distinct()
    return found.all().join(ends, [*here(sinks), "at"], "left_semi").filter("size(hops) > 1").select(*by, "source", F.col("at").alias("sink"), "hops")


def finding_id(path, sink, file):
    return F.sha2(F.concat_ws("-", path, sink, file), 256)


def summaries(edges: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """([pkg,] function, functionality): functions whose return a source reaches are new sources; those whose parameters
    reach a sink are new sinks."""
    by = ["pkg"] if "pkg" in edges.columns else []
    ends = edges.select(*by, F.explode(F.array("src", "dst")).alias("id")).distinct()
    returns = _flows(edges, sources, ends.filter(F.col("id").endswith("#return"))).select(*by, F.split("sink", "#")[0].alias("function"), F.lit("SOURCE").alias("functionality"))
    parameters = _flows(edges, ends.filter(F.col("id").rlike(r"#\d+$")), sinks).select(*by, F.split("source", "#")[0].alias("function"), F.lit("SINK").alias("functionality"))
    return returns.union(parameters).distinct()


def taint_tree(dependencies: DataFrame, edges: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """(pkg, source, sink, hops) level by level: packages without dependencies first. What their summaries say counts as
    sources and sinks in the packages that depend on them, directly or through others, and nowhere else. dependencies
    (src, dst) must have no cycle; edges (pkg, src, dst); sources and sinks: call names (column name)."""
    edges = cut(edges.select("pkg", "src", "dst").distinct())
    needs = cut(dependencies.select(F.col("src").alias("pkg"), F.col("dst").alias("of")).filter("pkg IS NOT NULL AND of IS NOT NULL").distinct())
    done = levels(dependencies)
    alone = edges.select(F.col("pkg").alias("id")).distinct().join(done.select("id"), "id", "left_anti").withColumn("level", F.lit(0))
    done = cut(done.unionByName(alone))
    top = done.agg(F.max("level")).first()[0]
    given = {"SOURCE": cut(sources.select("name")), "SINK": cut(sinks.select("name"))}
    seen = Parts(edges.sparkSession.createDataFrame([], "pkg string, name string, functionality string"))  # names that count in a package and in those above
    out = None
    for level in range((top if top is not None else -1) + 1):
        mine = done.filter(F.col("level") == level).select(F.col("id").alias("pkg"))
        own = cut(edges.join(mine, "pkg", "left_semi").select("pkg", "src", "dst"))
        came = needs.join(mine, "pkg", "left_semi").join(seen.all().withColumnRenamed("pkg", "of"), "of").select("pkg", "name", "functionality").distinct()
        came = seen.add(came)
        here = {k: cut(calls(own, v).unionByName(calls(own, came.filter(F.col("functionality") == k))).distinct()) for k, v in given.items()}
        members = alike(own, here["SOURCE"], here["SINK"])  # packages that are alike are walked once
        first = cut(only_first(own, members))
        here = {k: cut(only_first(v, members)) for k, v in here.items()}
        got = for_all(_flows(first, here["SOURCE"], here["SINK"]), members)
        out = got if out is None else out.unionByName(got)
        new = for_all(summaries(first, here["SOURCE"], here["SINK"]), members).select("pkg", F.col("function").alias("name"), "functionality").filter("name NOT LIKE '<%'").distinct()
        seen.add(new.join(came, ["pkg", "name", "functionality"], "left_anti"))
    return edges.select("pkg", F.col("src").alias("source"), F.col("dst").alias("sink"), F.array("src").alias("hops")).limit(0) if out is None else out


def flow_packages(found: DataFrame) -> DataFrame:
    """(flow, packages): of each kind of flow, named by the calls at its ends, how many packages have it."""
    end = lambda c: F.regexp_replace(F.regexp_replace(F.col(c), r"^[^|]*[|][^:]*:", ""), r"@[\d.]+$", "")
    rows = found.select(F.concat(end("source"), F.lit(" -> "), end("sink")).alias("flow"), "pkg").distinct()
    return rows.groupBy("flow").agg(F.count("*").alias("packages"))


#: A function of more blocks, edges and definitions, generated or killed, or a package of more rows in paths, is worked on
#: by all tasks, in rounds of joins.
LARGE = 2000
#: Rows of whole functions or packages that a task works on together.
TOGETHER = 20_000


def reaching_definitions(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(function, block, definition) that hold on entry: the fixpoint of out = generated or (in and not killed). blocks:
    (function, block, generates array, kills array); edges: (function, src, dst). What is known of a function is brought
    together once; where that is at most LARGE rows, a task finds its fixpoint."""
    block = blocks.select("block").union(edges.select("src")).union(edges.select("dst")).schema[0].dataType
    lists = blocks.schema["generates"].dataType
    own = blocks.select("function", F.col("block").cast(block).alias("block"), F.lit(None).cast(block).alias("dst"), F.lit(False).alias("edge"), "generates", F.col("kills").cast(lists).alias("kills"))
    to = edges.select("function", F.col("src").cast(block).alias("block"), F.col("dst").cast(block).alias("dst"), F.lit(True).alias("edge"), F.lit(None).cast(lists).alias("generates"), F.lit(None).cast(lists).alias("kills"))
    rows = own.unionByName(to).filter("function IS NOT NULL AND block IS NOT NULL")
    size = F.sum(1 + F.greatest(F.size("generates"), F.lit(0)) + F.greatest(F.size("kills"), F.lit(0)))
    rows = cut(spread(rows, "function").withColumn("n", size.over(Window.partitionBy("function"))))
    out = rows.select("function", "block", F.element_at("generates", 1).alias("definition")).limit(0)
    found = rows.filter(F.col("n") <= LARGE).drop("n").transform(in_arrow, _reaching, out.schema)
    if (rows.agg(F.max("n")).first()[0] or 0) <= LARGE:
        return found
    return found.unionByName(_reaching_in_rounds(rows.filter(F.col("n") > LARGE)))


def _reaching_in_rounds(rows: DataFrame) -> DataFrame:
    made = cut(rows.select("function", "block", F.explode("generates").alias("definition")))
    killed = cut(rows.select("function", "block", F.explode("kills").alias("definition")))
    flow = cut(rows.filter("edge").select("function", "block", "dst").distinct())
    entering, frontier = Parts(made.limit(0)), made
    while not frontier.isEmpty():
        arrived = frontier.join(flow, ["function", "block"]).select("function", F.col("dst").alias("block"), "definition").distinct()
        new = entering.add(arrived.join(entering.all(), ["function", "block", "definition"], "left_anti"))
        frontier = new.join(killed, ["function", "block", "definition"], "left_anti")
    return entering.all()


def whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows, which are sorted by the key, in tables of TOGETHER or more as far as there are, each with all rows of its keys."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= TOGETHER:
            t = pa.Table.from_batches(held)
            other = np.flatnonzero(pc.not_equal(t[key], t[key][-1]).to_numpy())
            if len(other):
                yield t.slice(0, end := int(other[-1]) + 1)
                held = t.slice(end).to_batches()
                n -= end
    if n:
        yield pa.Table.from_batches(held)


def _encoded(*arrays: pa.Array) -> tuple[pa.Array, list[np.ndarray]]:
    """The values of arrays, nulls too, and their numbers in each."""
    d = pa.concat_arrays(arrays).dictionary_encode(null_encoding="encode")
    return d.dictionary, np.split(d.indices.to_numpy().astype(np.int64), np.cumsum([len(a) for a in arrays])[:-1])


def _reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fixpoints of whole functions, side by side: a table of nodes times definitions for each says what is found."""
    for t in whole(batches, "function"):
        function, block, dst, edge, generates, kills = (t[k].combine_chunks() for k in ("function", "block", "dst", "edge", "generates", "kills"))
        functions, (f,) = _encoded(function)
        values, (one, two) = _encoded(block, dst)
        names, (made, killed) = _encoded(generates.flatten(), kills.flatten())
        edge = edge.to_numpy(zero_copy_only=False)
        made_at, killed_at = (np.repeat(np.arange(len(t)), pc.fill_null(pc.list_value_length(x), 0).to_numpy()) for x in (generates, kills))
        # nodes and definitions by function; row: where a node's definitions begin in the tables
        nodes, number = np.unique(np.concatenate((f * len(values) + one, (f * len(values) + two)[edge])), return_inverse=True)
        here, to = number[: len(t)], number[len(t) :]
        made = f[made_at] * len(names) + made
        some = np.ones(len(killed), bool) if not names.null_count else killed != names.is_null().to_numpy(zero_copy_only=False).argmax()
        killed, killed_at = (f[killed_at] * len(names) + killed)[some], killed_at[some]  # nothing kills a null
        definitions, made = np.unique(made, return_inverse=True)
        first = np.searchsorted(definitions, np.arange(len(functions) + 1) * len(names))
        of = nodes // len(values)
        ends = np.cumsum(np.diff(first)[of])
        row = np.append(0, ends[:-1])
        found, stop = np.zeros(ends[-1], bool), np.zeros(ends[-1], bool)
        k = np.minimum(np.searchsorted(definitions, killed), max(len(definitions) - 1, 0))
        some = definitions[k] == killed if len(definitions) else np.zeros(len(k), bool)
        stop[(row[here[killed_at]] + k - first[f[killed_at]])[some]] = True
        order = np.argsort(src := here[edge], kind="stable")
        src, to = src[order], to[order]
        begin, end = (np.searchsorted(src, np.arange(len(nodes)), side) for side in ("left", "right"))
        node, d = here[made_at], made - first[f[made_at]]
        while len(node):
            n = (end - begin)[node]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[node], n)
            node, d = to[step], np.repeat(d, n)
            at, k = np.unique(row[node] + d, return_index=True)
            k = k[~found[at]]
            at = row[node[k]] + d[k]
            found[at] = True
            k = k[~stop[at]]
            node, d = node[k], d[k]
        at = np.flatnonzero(found)
        node = np.searchsorted(row, at, "right") - 1
        d = definitions[at - row[node] + first[of[node]]] % max(len(names), 1)
        for k in range(0, len(at), TOGETHER):
            part = slice(k, k + TOGETHER)
            cols = [functions.take(pa.array(of[node[part]])), values.take(pa.array(nodes[node[part]] % len(values))), names.take(pa.array(d[part]))]
            yield pa.RecordBatch.from_arrays(cols, ["function", "block", "definition"])


def centroids(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(method, x, y, z, w): means of sequence, out-degree and loop depth over the ends of edges, weighted by the
    blocks' statements, and the sum of weights. blocks: (method, seq, out_degree, loop_depth, stmt_count)."""
    side = lambda s: blocks.select("method", *[F.col(c).alias(f"{s}_{c}") for c in ("seq", "out_degree", "loop_depth", "stmt_count")])
    both = edges.join(side("src").withColumnRenamed("src_seq", "src"), ["method", "src"]).join(side("dst").withColumnRenamed("dst_seq", "dst"), ["method", "dst"])
    a, b = F.col("src_stmt_count"), F.col("dst_stmt_count")
    mean = lambda x, y: F.sum(a * F.col(x) + b * F.col(y)) / F.sum(a + b)
    return both.groupBy("method").agg(mean("src", "dst").alias("x"), mean("src_out_degree", "dst_out_degree").alias("y"), mean("src_loop_depth", "dst_loop_depth").alias("z"), F.sum(a + b).alias("w"))


def method_centroids(blocks: DataFrame, edges: DataFrame, invokes: bool = False) -> DataFrame:
    """centroids(), and of methods of one block the block itself. invokes: a block weighs its statements and the calls in
    it (column invokes) together."""
    weight = F.col("stmt_count") + (F.coalesce("invokes", F.lit(0)) if invokes else F.lit(0))
    weighed = blocks.withColumn("stmt_count", weight)
    one = weighed.groupBy("method").agg(F.count("*").alias("n"), *[F.first(c).cast("double").alias(x) for c, x in (("seq", "x"), ("out_degree", "y"), ("loop_depth", "z"))], F.first("stmt_count").alias("w"))
    return centroids(weighed, edges).unionByName(one.filter("n = 1").select("method", "x", "y", "z", "w"))


def relation_counts(relations: DataFrame) -> DataFrame:
    return relations.groupBy("class1", "class2", "relation").agg(F.count("*").alias("n"))
