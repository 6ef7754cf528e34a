"""Reachability with a memory: paths that an automaton accepts, and paths whose calls and returns match.

Both walk (node, state) in semi-naive rounds, each joining only what the last one found, within each package. A state is
what a path has done so far: what a value went through on its way (conditions of sinks), or whether it has gone down into
a call that it must not leave at another place. The automata are small tables, made from the labels that occur and joined
as rows, so the work is that of plain reachability times the states that are met. Where calls and returns must match,
a package of few rows is brought together and walked by one task instead, so that only its rows are shuffled, once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hornbeam.functions.storage import Parts, cut, in_arrow, sized
from hornbeam.operators.flows import CALLED, CAST, COLLECT, ELEMENT, FIELD, LARGE, PLAIN, QUOTED, TOGETHER, alike, for_all, only_first, whole

#: Rows of an automaton that are broadcast.
BROADCAST = 100_000


def accepted_paths(edges: DataFrame, transitions: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """([pkg,] source, sink, state, hops): for each source, sink and state in which it is reached, a shortest path, the
    first by text. edges ([pkg,] src, dst, label); transitions (state, label, to): a path goes on where its state has a
    row for the label; starts ([pkg,] id, state); ends ([pkg,] id). Every (source, node, state) is visited once."""
    by = [c for c in ("pkg",) if c in edges.columns]
    small = transitions.select("state", "label", "to").distinct()
    small = F.broadcast(small) if small.count() <= BROADCAST else small
    e = cut(edges.select(*by, F.col("src").alias("at"), "dst", "label").distinct())
    found = Parts(starts.select(*by, F.col("id").alias("source"), F.col("id").alias("at"), "state", F.array("id").alias("hops")).distinct())
    frontier, key = found.all(), [*by, "source", "at", "state"]
    while not frontier.isEmpty():
        step = frontier.join(e, [*by, "at"]).join(small, ["state", "label"]).select(*by, "source", F.col("dst").alias("at"), F.col("to").alias("state"), F.concat("hops", F.array("dst")).alias("hops"))
        frontier = found.add(step.groupBy(*key).agg(F.min(F.struct(F.size("hops").alias("n"), "hops")).alias("m")).select(*key, "m.hops").join(found.all().select(*key), key, "left_anti"))
    last = ends.select(*[c for c in by if c in ends.columns], F.col("id").alias("at")).distinct()
    return found.all().filter("size(hops) > 1").join(last, [c for c in last.columns], "left_semi").select(*by, "source", F.col("at").alias("sink"), "state", "hops")


# Calls and returns that match


def summary_edges(edges: DataFrame) -> DataFrame:
    """([pkg,] src, dst): from what is passed to a call to the call's value, where the function lets it through, itself or
    by calls of its own. edges ([pkg,] src, dst, kind, site): kind `call` goes into a function at a site, kind `result`
    comes out of one at a site, others stay inside. Pairs (entry of a function, node that it reaches inside) and
    summaries grow in turn, each round from what is new in the last; recursion ends because pairs are found once."""
    by = [c for c in ("pkg",) if c in edges.columns]
    inner = cut(edges.filter(~F.col("kind").isin("call", "result")).select(*by, F.col("src").alias("at"), F.col("dst").alias("to")).distinct())
    down = edges.filter("kind = 'call'").select(*by, F.col("src").alias("passed"), F.col("dst").alias("entry"), "site").distinct()
    up = edges.filter("kind = 'result'").select(*by, F.col("src").alias("at"), F.col("dst").alias("value"), "site").distinct()
    through = cut(down.join(up, [*by, "site"]).select(*by, "entry", "at", "passed", "value").distinct())
    key, pair = [*by, "entry", "at"], [*by, "at", "to"]
    reached = Parts(through.select(*by, "entry", F.col("entry").alias("at")).distinct())
    made = Parts(inner.limit(0))
    fresh = reached.all()
    while not fresh.isEmpty():
        arrived = fresh.join(through, key).select(*by, F.col("passed").alias("at"), F.col("value").alias("to")).distinct()
        summaries = made.add(arrived.join(made.all(), pair, "left_anti"))
        onward = fresh.join(inner.unionByName(made.all()), [*by, "at"]).unionByName(reached.all().join(summaries, [*by, "at"]))
        fresh = reached.add(onward.select(*by, "entry", F.col("to").alias("at")).distinct().join(reached.all(), key, "left_anti"))
    return made.all().select(*by, F.col("at").alias("src"), F.col("to").alias("dst"))


def realizable(edges: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame | None = None, copies: bool = True) -> DataFrame:
    """([pkg,] source, sink, hops): as flows.flows(), along paths only that come back from a function to where they went
    in; a path may leave the function it began in to any caller, and end in a function that it has not left. A call that
    it passes through is one hop. edges: as for summary_edges(), each call a node of its own (def_use_edges with sites);
    what is passed to a call of a function that the package defines is not the call's value by itself. Packages that are
    alike are walked once."""
    if "pkg" not in edges.columns:
        return _realizable(edges, sources, sinks, sanitizers)
    edges = cut(edges.select("pkg", "src", "dst", "kind", "site").distinct())
    members = alike(edges, *[t.select("pkg", "id") for t in (sources, sinks, sanitizers) if t is not None and "pkg" in t.columns])
    edges, *ends = [t if t is None else only_first(t, members) for t in (edges, sources, sinks, sanitizers)]
    rows = edges.withColumn("role", F.lit("edge"))
    for role, t, c in zip(ENDS, ends, ("src", "dst", "src")):
        if t is not None:
            ids = t.select("pkg", "id") if "pkg" in t.columns else t.select("id").distinct().join(edges.select("pkg", F.col(c).alias("id")).distinct(), "id")
            rows = rows.unionByName(ids.select("pkg", F.col("id").alias("src"), F.lit(role).alias("role")), allowMissingColumns=True)
    return for_all(realizable_of(rows, lambda df: df), members)


#: Roles of rows that name a node (src) and are no edges.
ENDS = ("source", "sink", "sanitizer")


def realizable_of(base: DataFrame, rows_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """realizable() of what rows_of() makes of each row of base (pkg, ...) by itself: (pkg, src, dst, kind, site, role);
    role: `edge`, or one of ENDS for a node src. Rows of base are shuffled, once, and a task walks the packages whose rows
    it has; packages of over LARGE rows are walked by all tasks, in rounds of joins."""
    base = base.filter("pkg IS NOT NULL")
    sizes = base.groupBy("pkg").count()
    n, most = sizes.agg(F.sum("count"), F.max("count")).first()
    many = cut(sizes.filter(F.col("count") > LARGE).select("pkg")) if (most or 0) > LARGE else None
    few = base if many is None else base.join(many, "pkg", "left_anti")
    rows = rows_of(sized(few, n or 0, "pkg").sortWithinPartitions("pkg")).select("pkg", "src", "dst", "kind", "site", "role")
    node = rows.schema["src"].dataType
    found = in_arrow(rows, _walked, T.StructType([rows.schema["pkg"], T.StructField("source", node), T.StructField("sink", node), T.StructField("hops", T.ArrayType(node))]))
    if many is None:
        return found
    rows = cut(rows_of(base.join(many, "pkg", "left_semi")))
    ends = [rows.filter(F.col("role") == role).select("pkg", F.col("src").alias("id")) for role in ENDS]
    return found.unionByName(_realizable(rows.filter("role = 'edge'"), *ends))


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is found in the packages of rows that are sorted by package, in batches of about TOGETHER hops."""
    for t in whole(batches, "pkg"):
        pkg, *columns = (t[k].combine_chunks() for k in ("pkg", "src", "dst", "kind", "site", "role"))
        rows = list(zip(*[c.to_pylist() for c in columns]))
        begins = [0, *(np.flatnonzero(pc.not_equal(pkg[1:], pkg[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist()]
        found, hops = [], 0
        for begin, end in zip(begins, [*begins[1:], len(rows)]):
            for one in _walk(rows[begin:end]):
                found.append((begin, *one))
                hops += len(one[2])
                if hops >= TOGETHER:
                    yield _batch(pkg, t, found)
                    found, hops = [], 0
        if found:
            yield _batch(pkg, t, found)


def _batch(pkg: pa.Array, t: pa.Table, found: list[tuple]) -> pa.RecordBatch:
    at, source, sink, hops = zip(*found)
    node = t.schema.field("src").type
    return pa.RecordBatch.from_arrays([pkg.take(pa.array(at, pa.int64())), pa.array(source, node), pa.array(sink, node), pa.array(hops, pa.list_(node))], ["pkg", "source", "sink", "hops"])


def _walk(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(source, sink, hops) of one package, of rows (src, dst, kind, site, role): what _realizable() finds in rounds."""
    edges, named = set(), {role: set() for role in ENDS}
    for src, dst, kind, site, role in rows:
        if role == "edge":
            edges.add((src, dst, kind, site))
        elif src is not None:
            named[role].add(src)
    sources, sinks, cleaners = (named[role] for role in ENDS)
    if not sources or not sinks:
        return
    inner, down, back, passed = (defaultdict(set) for _ in range(4))
    calls, results = defaultdict(set), defaultdict(set)
    defined = set()
    for src, dst, kind, site in edges:
        if src in cleaners or kind is None:
            continue
        if kind == "call":
            down[src].add(dst)
            calls[site].add((src, dst))
        elif kind == "result":
            back[src].add(dst)
            results[site].add((src, dst))
        elif kind == "argument":
            passed[site].add((src, dst))
        else:
            inner[src].add(dst)
            if kind == "parameter":
                defined.add(src)
            elif kind == "return":
                defined.add(dst)
    defined.discard(None)
    for site, pairs in passed.items():
        known = site is not None and (any(dst in defined for _, dst in calls.get(site, ())) or any(src in defined for src, _ in results.get(site, ())))
        for src, dst in pairs:
            if not known or dst in sinks:
                inner[src].add(dst)
    _summarize(inner, calls, results)
    for nodes in (inner, down, back):
        nodes.pop(None, None)
        for to in nodes.values():
            to.discard(None)
    for source in sources:
        yield from _shortest(source, sinks, inner, down, back)


def _summarize(inner: dict, calls: dict, results: dict) -> None:
    """Adds to inner what summary_edges() makes, of the calls and results (src, dst) by site."""
    through = defaultdict(set)
    for site, pairs in calls.items():
        if site is not None:
            for at, value in results.get(site, ()):
                for src, entry in pairs:
                    if entry is not None and at is not None:
                        through[entry, at].add((src, value))
    reached = {entry: {entry} for entry, _ in through}  # nodes by the entry of the function in which they are
    entries = defaultdict(set, {entry: {entry} for entry in reached})
    todo = [(entry, entry) for entry in reached]

    def reach(entry, node):
        if node is not None and node not in reached[entry]:
            reached[entry].add(node)
            entries[node].add(entry)
            todo.append((entry, node))

    while todo:
        entry, at = todo.pop()
        for src, value in through.get((entry, at), ()):
            if src is not None and value not in inner[src]:
                inner[src].add(value)
                for other in list(entries.get(src, ())):
                    reach(other, value)
        for node in inner.get(at, ()):
            reach(entry, node)


def _shortest(source, sinks: set, inner: dict, down: dict, back: dict) -> Iterator[tuple]:
    """(source, sink, hops): a shortest path to each sink, the first by text. State 1: it is in a call and must not leave it."""
    came, hit = {(source, 0): None}, set()
    level = [(0, source, 0)]  # in the order of their paths; equal ones have equal numbers
    while level:
        new = []
        for rank, node, state in level:
            for to, moves in ((state, inner), (1, down)) if state else ((0, inner), (0, back), (1, down)):
                for dst in moves.get(node, ()):
                    if (dst, to) not in came:
                        came[dst, to] = (node, state)
                        new.append((rank, dst, to))
        new.sort()
        level, rank, last = [], -1, None
        for before, node, state in new:
            if (before, node) != last:
                rank, last = rank + 1, (before, node)
            level.append((rank, node, state))
            if node in sinks and node not in hit:
                hit.add(node)
                hops, at = [], (node, state)
                while at:
                    hops.append(at[0])
                    at = came[at]
                yield source, node, hops[::-1]
        if len(hit) == len(sinks):
            return


def _realizable(edges: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame | None = None) -> DataFrame:
    by = [c for c in ("pkg",) if c in edges.columns]
    here = lambda df: [c for c in by if c in df.columns]
    e = edges.select(*by, "src", "dst", "kind", "site").distinct()
    if sanitizers is not None:
        e = e.join(sanitizers.select(*here(sanitizers), F.col("id").alias("src")), [*here(sanitizers), "src"], "left_anti")
    e = cut(e)
    ends = sinks.select(*here(sinks), F.col("id").alias("dst")).distinct()
    defined = e.filter("kind = 'parameter'").select(*by, F.col("src").alias("end")).union(e.filter("kind = 'return'").select(*by, "dst")).distinct()
    known = e.filter("kind = 'call'").select(*by, "site", F.col("dst").alias("end")).union(e.filter("kind = 'result'").select(*by, "site", "src")).join(defined, [*by, "end"], "left_semi").select(*by, "site").distinct()
    passed = e.filter("kind = 'argument'")
    kept = passed.join(known, [*by, "site"], "left_anti").select(*e.columns).unionByName(passed.join(known, [*by, "site"], "left_semi").join(ends, [*here(sinks), "dst"], "left_semi").select(*e.columns))
    e = cut(e.filter("kind <> 'argument'").unionByName(kept))
    label = F.when(F.col("kind") == "call", "down").when(F.col("kind") == "result", "back").otherwise("inner")
    all_ = e.select(*by, "src", "dst", label.alias("label")).unionByName(summary_edges(e).withColumn("label", F.lit("inner")))
    steps = e.sparkSession.createDataFrame([(0, "inner", 0), (0, "back", 0), (0, "down", 1), (1, "inner", 1), (1, "down", 1)], "state int, label string, to int")
    start = sources.select(*here(sources), "id").distinct()
    if here(sources) != by:
        start = start.join(e.select(*by, F.col("src").alias("id")).distinct(), "id")
    got = accepted_paths(all_, steps, start.withColumn("state", F.lit(0)), sinks)
    return got.groupBy(*by, "source", "sink").agg(F.min(F.struct(F.size("hops").alias("n"), "hops")).alias("m")).select(*by, "source", "sink", "m.hops")


# Conditions of sinks

#: What a value has gone through, as bits: cleaned of the attack, of quotes, of everything; put between quotes; it is an
#: array or an object of which every part is tainted.
CLEAN, NO_QUOTES, ALL_CLEAN, IN_QUOTES, ARRAY, OBJECT = 1, 2, 4, 8, 16, 32
_KINDS = {"variable": 0, "array": ARRAY, "object": OBJECT}


def after(bits: int, label: str, prevents: list[str], attack: str) -> int | None:
    """The bits of a value after an edge; None where it does no harm any more."""
    if label in (CAST, "valid"):
        return None
    bits |= CLEAN * (attack in prevents) | NO_QUOTES * ("QUOTES" in prevents) | ALL_CLEAN * ("ALL" in prevents)
    if label == QUOTED:
        return bits | IN_QUOTES
    if label == COLLECT:
        return bits | ARRAY
    return bits & ~ARRAY if label == ELEMENT else bits & ~OBJECT if label == FIELD else bits


def harms(bits: int, condition: str | None) -> bool:
    """Whether a value does harm where a sink has that condition: wholly tainted arrays and objects only where it asks for
    them; what is cleaned only under QUOTES, where it is not between quotes, or is with quotes left in it."""
    if bits & (ARRAY | OBJECT):
        return bool(bits & ARRAY and condition == "array_tainted" or bits & OBJECT and condition == "object_tainted")
    if not bits & (CLEAN | ALL_CLEAN):
        return True
    return condition == "QUOTES" and not bits & ALL_CLEAN and not (bits & IN_QUOTES and bits & NO_QUOTES)


def conditional_flows(edges: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame, validators: DataFrame) -> DataFrame:
    """(pkg, source, sink, place, attack, hops) of flows that do harm. edges: def_use_edges() with sites. sources (name,
    kind): calls whose value is a tainted variable, array or object. sinks (name, parameter, condition, attack):
    parameter: the place that does harm, null for any; condition: QUOTES, array_tainted, object_tainted or null.
    sanitizers (name, prevents array<string>): what they clean a value of: attacks, QUOTES, ALL. validators (name): tests
    that make a name harmless where they have said yes.

    The tables of names are catalogues: they, and the automaton made from them, go through the driver. Packages that are
    alike are walked once."""
    edges = cut(edges.select("pkg", "src", "dst", "kind", "place", "label").distinct())
    members = alike(edges)
    return for_all(_conditional_flows(only_first(edges, members), sources, sinks, sanitizers, validators), members)


def _conditional_flows(edges: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame, validators: DataFrame) -> DataFrame:
    spark = edges.sparkSession
    cleaners = {r.name: list(r.prevents or []) for r in sanitizers.collect()}
    listed = [(r.name, r.parameter, r.condition, r.attack) for r in sinks.collect()]
    attacks = sorted({x[3] for x in listed})
    tests, clean = spark.createDataFrame([(r.name,) for r in validators.collect()], "test string"), spark.createDataFrame([(n,) for n in cleaners], "cleaner string")
    called = lambda c: F.regexp_extract(c, CALLED, 1)
    e = edges.withColumn("test", F.regexp_extract("label", "^valid:(.*)$", 1)).join(F.broadcast(tests.withColumn("known", F.lit(True))), "test", "left")
    e = e.withColumn("label", F.when(F.col("known"), "valid").when(F.col("test") != "", PLAIN).otherwise(F.col("label"))).withColumn("name", called("src"))
    e = cut(e.join(F.broadcast(clean), F.col("name") == F.col("cleaner"), "left").withColumn("label", F.concat_ws("|", "label", "cleaner")).select("pkg", "src", "dst", "kind", "place", "label"))
    ends = cut(e.filter("kind = 'argument'").withColumn("name", called("dst")).join(F.broadcast(spark.createDataFrame([(x,) for x in sorted({s[0] for s in listed})], "name string")), "name", "left_semi"))
    at = F.concat("dst", F.lit("#"), F.col("place").cast("string"))
    walked = e.select("pkg", "src", "dst", "label").unionByName(ends.select("pkg", "src", at.alias("dst"), "label"))
    steps, bits = [], range(2 * OBJECT)
    for (label,) in e.select("label").distinct().collect():  # as many as ways to handle a value times sanitizers
        how, _, by = label.partition("|")
        for k, attack in enumerate(attacks):
            steps += [(k * 2 * OBJECT + b, label, k * 2 * OBJECT + to) for b in bits if (to := after(b, how, cleaners.get(by, []), attack)) is not None]
    begin = F.broadcast(spark.createDataFrame([(r.name, k * 2 * OBJECT + _KINDS[r.kind]) for r in sources.collect() for k in range(len(attacks))], "name string, state int"))
    starts = e.select("pkg", F.col("src").alias("id")).distinct().withColumn("name", called("id")).join(begin, "name").select("pkg", "id", "state")
    targets = ends.select("pkg", at.alias("id"), F.col("dst").alias("called"), "name", "place").distinct()
    got = accepted_paths(walked, spark.createDataFrame(steps, "state int, label string, to int"), starts, targets)
    bad = [(n, p, attacks.index(a) * 2 * OBJECT + b, a) for n, p, c, a in listed for b in bits if harms(b, c)]
    bad = F.broadcast(spark.createDataFrame(bad, "name string, parameter int, state int, attack string"))
    hit = got.join(targets.withColumnRenamed("id", "sink"), ["pkg", "sink"]).join(bad, ["name", "state"]).filter(F.col("parameter").isNull() | (F.col("parameter") == F.col("place")))
    best = hit.groupBy("pkg", "source", "called", "place", "attack").agg(F.min(F.struct(F.size("hops").alias("n"), "hops")).alias("m"))
    return best.select("pkg", "source", F.col("called").alias("sink"), "place", "attack", F.slice("m.hops", 1, F.col("m.n") - 1).alias("hops"))
