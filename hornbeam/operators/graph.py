"""Dependency graphs as edge tables (src, dst). Loops keep no lineage: each round is checkpointed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hornbeam.functions.names import draw
from hornbeam.functions.storage import Parts, cut, groups, in_arrow, spread


def _clean(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").filter(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct()


def _met(rows: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """rows joined with other by shuffle: what a round finds may be few bytes, but a broadcast in each of them goes through
    the driver."""
    return rows.join(other.hint("merge"), on, how)


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("src") != F.col("dst"))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def closure(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(src, dst) for every dst that can be reached from src (from the seeds' ids only, if given), cycles included.

    Semi-naive: each round joins only the pairs that the last one found. Rounds: the longest shortest path."""
    e = cut(_clean(edges))
    step = e if seeds is None else _met(e, seeds.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    found = Parts(step)
    frontier = found.all()
    on = e.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    while not frontier.isEmpty():
        new = _met(frontier, on, "dst").select("src", F.col("next").alias("dst")).distinct()
        frontier = found.add(_met(new, found.all(), ["src", "dst"], "left_anti"))
    return found.all()


def inherited(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """(id, mark): the marks of each node and of all it depends on. Marks travel up along edges, round by round, so the
    work follows what is found and not the number of pairs of nodes."""
    e = cut(_clean(edges).select("src", F.col("dst").alias("id")))
    found = Parts(marks.select("id", "mark").distinct())
    frontier = found.all()
    while not frontier.isEmpty():
        new = _met(frontier, e, "id").select(F.col("src").alias("id"), "mark").distinct()
        frontier = found.add(_met(new, found.all(), ["id", "mark"], "left_anti"))
    return found.all()


def descendants(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """All (flattened) dependencies; a node is not its own, even on a cycle."""
    return closure(edges, seeds).filter(F.col("src") != F.col("dst"))


def ancestors(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(src, dst): dst depends, perhaps through others, on src."""
    return descendants(reverse(edges), seeds)


def dependency_counts(edges: DataFrame) -> DataFrame:
    """(id, dep_count, flatten_dep_count) of every node."""
    direct = degrees(edges).select("id", F.col("out_degree").alias("dep_count"))
    flat = descendants(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("flatten_dep_count"))
    return _met(direct, flat, "id", "left").fillna(0, ["flatten_dep_count"])


def use_counts(packages: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """packages with use_count: how many depend on each; 0 where the graph does not know it."""
    used = ancestors(edges, packages.select(F.col(key).alias("id"))).groupBy(F.col("src").alias(key)).agg(F.count("*").alias("use_count"))
    return _met(packages, used, key, "left").fillna(0, ["use_count"])


def high_impact(packages: DataFrame, edges: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(key, dependent) of all packages that depend on the given ones, and the given ones that the graph does not know."""
    wanted = packages.select(F.col(key).alias("id")).distinct()
    known = cut(_met(wanted, nodes(edges), "id", "left_semi"))
    found = ancestors(edges, known).select(F.col("src").alias(key), F.col("dst").alias("dependent"))
    return found, wanted.join(known, "id", "left_anti").select(F.col("id").alias(key))


def attractors(edges: DataFrame) -> DataFrame:
    """(id, component, size): the strong components that no edge leaves, nodes on no cycle being their own."""
    e = cut(without_loops(_clean(edges)))
    own = cut(nodes(e).join(strong_components(e), "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    ends = e.join(own.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(own.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst")
    left = ends.filter("a <> b").select(F.col("a").alias("component")).distinct()
    last = own.join(left, "component", "left_anti")
    return last.join(last.groupBy("component").agg(F.count("*").alias("size")), "component").select("id", "component", "size")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) from one aggregation over both ends."""
    e = _clean(edges)
    ends = e.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def without_dependencies(packages: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    return packages.join(edges.select(F.col("src").alias(key)), key, "left_anti")


def induced(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The edges among the seeds and all they depend on."""
    kept = cut(closure(edges, seeds).select(F.col("dst").alias("id")).union(seeds.select("id")).distinct())
    e = _clean(edges)
    return e.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def split(edges: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(slice, src, dst): n subgraphs, each a slice of the nodes with all they depend on. A slice's mark travels down its
    nodes' edges, so the work is that of n marks for each node at most and not of all pairs of nodes."""
    part = nodes(edges).withColumn("mark", (draw(F.col("id"), seed) % n).cast("int"))
    kept = cut(inherited(reverse(edges), part).select(F.col("mark").alias("slice"), "id"))
    one = _clean(edges).join(kept.withColumnRenamed("id", "src"), "src")
    return one.join(kept.withColumnRenamed("id", "dst"), ["slice", "dst"], "left_semi").select("slice", "src", "dst")


def cyclic_core(edges: DataFrame) -> DataFrame:
    """The edges left when nodes without incoming or without outgoing edges are peeled off until none is left."""
    e = cut(_clean(edges))
    n = e.count()
    while n:
        kept = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        e = cut(kept.select("src", "dst"))
        n, before = e.count(), n
        if n == before:
            break
    return e


def is_dag(edges: DataFrame) -> bool:
    return cyclic_core(edges).isEmpty()


def levels(edges: DataFrame) -> DataFrame:
    """(id, level): the longest path to a node without dependencies; every dependency is on a lower level. The graph
    must have no cycles: nodes on or above one would never be done, which raises."""
    e = cut(_clean(edges))
    out = Parts(_met(nodes(e), e.select(F.col("src").alias("id")), "id", "left_anti").withColumn("level", F.lit(0)))
    level, left, k = out.all(), e, 0
    while not left.isEmpty():
        k += 1
        rest = cut(_met(left, level.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"))
        ready = _met(left.select(F.col("src").alias("id")).distinct(), rest.select(F.col("src").alias("id")), "id", "left_anti")
        level, left = out.add(ready.withColumn("level", F.lit(k))), rest
        if level.isEmpty():
            raise ValueError("the graph has a cycle")
    return out.all()


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) for nodes on cycles: component is the smallest id of those that reach each other.

    Colouring: the smallest id that reaches a node is its colour; what reaches the id back within its colour is its
    component. Rounds repeat on what is left. Works on the cyclic core only."""
    core, out = cyclic_core(edges), None
    while not core.isEmpty():
        colour = cut(nodes(core).withColumn("c", F.col("id")))
        while True:
            came = core.join(colour.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
            new = cut(colour.join(came, "id", "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") < F.col("c")).alias("moved")))
            done = new.filter("moved").isEmpty()
            colour = new.select("id", "c")
            if done:
                break
        ends = core.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst")
        within = cut(ends.filter("cs = cd").select("src", "dst", F.col("cs").alias("c")))
        reached = Parts(colour.filter("id = c"))
        frontier = reached.all()
        while not frontier.isEmpty():
            more = within.join(frontier.select(F.col("id").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("id"), "c").distinct()
            frontier = reached.add(more.join(reached.all(), ["id", "c"], "left_anti"))
        back = reached.all()
        part = back.select("id", F.col("c").alias("component"))
        out = part if out is None else cut(out.unionByName(part))
        rest = core.join(back.select(F.col("id").alias("src")), "src", "left_anti").join(back.select(F.col("id").alias("dst")), "dst", "left_anti")
        core = cyclic_core(rest.select("src", "dst"))
    if out is None:
        return nodes(edges).withColumn("component", F.col("id")).limit(0)
    large = out.groupBy("component").count().filter("count > 1").select("component")
    return out.join(large, "component", "left_semi").select("id", "component")


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 30) -> DataFrame:
    """(id, rank) after so many rounds; nodes without outgoing edges give to all."""
    e = cut(_clean(edges))
    n = nodes(e).count()
    if not n:
        return nodes(e).withColumn("rank", F.lit(0.0))
    out = e.groupBy("src").agg(F.count("*").alias("out"))
    weighed = cut(e.join(out, "src").select("src", "dst", "out"))
    rank = cut(nodes(e).join(out.withColumnRenamed("src", "id"), "id", "left").withColumn("rank", F.lit(1.0 / n)))
    for _ in range(rounds):
        loose = rank.filter("out IS NULL").agg(F.sum("rank")).first()[0] or 0.0
        given = weighed.join(rank.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        rank = cut(rank.join(given, "id", "left").select("id", "out", (F.lit((1 - alpha + alpha * loose) / n) + alpha * F.coalesce("got", F.lit(0.0))).alias("rank")))
    return rank.select("id", "rank")


#: Rounds in which every component loses one edge, before what is left is settled by halves.
ROUNDS = 2


def break_cycles(edges: DataFrame, scores: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(src, dst) of an acyclic graph: loops go, then from every strong component its edge with the highest score, the
    sum of both ends' ranks, ties by src and dst; again until none is left. Only edges within components are worked
    on: those that no component holds any more are put aside, and come back at the end. So many rounds go edge by edge;
    what they leave is settled by halves, in as many rounds as its number of edges has binary digits."""
    e = cut(without_loops(_clean(edges)))
    rank = (pagerank(e) if scores is None else scores).select("id", "rank")
    ends = e.join(rank.select(F.col("id").alias("src"), F.col("rank").alias("a")), "src").join(rank.select(F.col("id").alias("dst"), F.col("rank").alias("b")), "dst")
    scored = cut(ends.select("src", "dst", (F.col("a") + F.col("b")).alias("score")))
    unscored = e.join(scored, ["src", "dst"], "left_anti")
    if not unscored.isEmpty():
        raise ValueError("a node has no score")
    safe, last = Parts(scored.limit(0)), Window.partitionBy("component").orderBy(F.col("score").desc(), F.col("src").desc(), F.col("dst").desc())
    done = 0
    while not scored.isEmpty():
        parts = cut(strong_components(scored.select("src", "dst")))
        inner = scored.join(parts.select(F.col("id").alias("src"), "component"), "src").join(parts.select(F.col("id").alias("dst"), "component"), ["dst", "component"])
        inner = cut(inner.withColumn("n", F.row_number().over(last)))
        safe.add(scored.join(inner, ["src", "dst"], "left_anti"))
        if done >= rounds and not inner.isEmpty():
            gone = _dropped_by_halves(inner)
            safe.add(inner.select("src", "dst", "score").join(gone, ["src", "dst"], "left_anti"))
            break
        scored = cut(inner.filter("n > 1").select("src", "dst", "score"))
        done += 1
    return safe.all().select("src", "dst")


def _dropped_by_halves(inner: DataFrame) -> DataFrame:
    """(src, dst) of the edges that go, of strong components' edges (component, src, dst, n: their place from the highest
    score down).

    If edges came back from the lowest score up, those that go are the ones whose ends are strongly connected as soon as
    they are there: an edge that is kept is on no cycle when all higher ones have been decided, so a cycle through an edge
    that goes has only lower ones. When the ends of an edge become connected is found by halves, for all edges together: the
    strong components of each part's lower half say in which half it is. The lower half goes on by itself, the upper half
    with the components as its nodes; every edge is in one part at a time."""
    size = F.max("n").over(Window.partitionBy("component"))
    rows = inner.withColumn("t", (size - F.col("n") + 1).cast("long")).withColumn("hi", F.col("t") + F.col("n") - 1)
    rows = cut(rows.select(F.col("component").cast("string").alias("part"), F.col("src").alias("u"), F.col("dst").alias("v"), "t", F.lit(0).cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "src", "dst", F.lit(True).alias("open")))
    gone = Parts(rows.limit(0).select("src", "dst"))
    while True:
        gone.add(rows.filter("open AND hi - lo = 1").select("src", "dst"))
        rows = rows.filter("hi - lo > 1").withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2))
        alive = rows.filter("open").select("part").distinct()
        rows = cut(rows.join(alive, "part", "left_semi"))
        if rows.isEmpty():
            return gone.all()
        at = lambda c: F.struct(F.col("part"), F.col(c).alias("node"))
        found = cut(strong_components(rows.filter("t <= mid").select(at("u").alias("src"), at("v").alias("dst"))))
        end = lambda c: found.select(F.col("id.part").alias("part"), F.col("id.node").alias(c), F.col("component.node").alias(f"{c}c"))
        rows = rows.join(end("u"), ["part", "u"], "left").join(end("v"), ["part", "v"], "left")
        rows = rows.withColumn("uc", F.coalesce("uc", "u")).withColumn("vc", F.coalesce("vc", "v"))
        rows = cut(rows.withColumn("met", F.col("uc") == F.col("vc")))
        gone.add(rows.filter("met AND open AND t > mid").select("src", "dst"))
        low = rows.filter("met AND t <= mid").select(F.concat("part", F.lit("/0")).alias("part"), "u", "v", "t", "lo", F.col("mid").alias("hi"), "src", "dst", "open")
        high = rows.filter("NOT met").select(F.concat("part", F.lit("/1")).alias("part"), F.col("uc").alias("u"), F.col("vc").alias("v"), "t", F.col("mid").alias("lo"), "hi", "src", "dst", (F.col("open") & (F.col("t") > F.col("mid"))).alias("open"))
        rows = low.unionByName(high)


#: Sets, and their elements, that are about as many in a block where all sets are compared with all.
BLOCK, ELEMENTS = 4096, 1 << 20


def neighbour_similarity(edges: DataFrame, least: float = 0.5) -> DataFrame:
    """(a, b, jaccard) of nodes whose sets of dependencies are at least so similar.

    Sets are in an order in which rare dependencies come first. Similar sets share one of those in front, when of n all
    but the last ceil(least * n) - 1 count; only these meet in the join, so what everybody depends on makes no pairs. Of
    pairs that meet, sizes and what can still follow the last dependency in common must be enough for the similarity;
    only for those that are left are whole sets compared. Where most sets share much, that join has more rows than the
    sets have elements once for each block of them; blocks are then compared with each other, and no pair is shuffled."""
    e = _clean(edges)
    common = cut(e.groupBy("dst").agg(F.count("*").alias("f"))).withColumn("code", F.monotonically_increasing_id())
    sets = e.join(common, "dst").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("f", "code"))).alias("s"))
    sets = cut(sets.select("src", F.transform("s", lambda x: x["code"]).alias("s"), F.size("s").alias("n")))
    front = F.least(F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1, F.col("n"))
    short = sets.select("src", "n", F.posexplode(F.slice("s", 1, front)).alias("place", "dst"))
    count, size = sets.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(-(-count // BLOCK), -(-size // ELEMENTS), 1)
    meet = short.groupBy("dst").count().agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2)).first()[0] or 0
    if meet > size * (blocks + 1):
        return _similar_by_blocks(sets, blocks, least)
    side = lambda x: short.select(F.col("src").alias(x), F.col("n").alias(f"n{x}"), F.col("place").alias(f"p{x}"), "dst")
    sizes = F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9
    met = side("a").join(side("b"), "dst").filter((F.col("a") < F.col("b")) & sizes).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("m"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    room = F.col("m") + F.least(F.col("na") - 1 - F.col("pa"), F.col("nb") - 1 - F.col("pb"))
    pairs = met.filter(room >= least / (1 + least) * (F.col("na") + F.col("nb")) - 1e-9).select("a", "b")
    full = pairs.join(sets.select(F.col("src").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("src").alias("b"), F.col("s").alias("sb")), "b")
    m = F.size(F.array_intersect("sa", "sb"))
    return full.select("a", "b", (m / (F.size("sa") + F.size("sb") - m)).alias("jaccard")).filter(F.col("jaccard") >= least - 1e-9)


def _similar_by_blocks(sets: DataFrame, blocks: int, least: float) -> DataFrame:
    """The same of (src, s, n), s without repeats: sets are dealt into blocks by a hash, and each two blocks, and each
    with itself, come together in a task, which holds one such pair at a time."""
    kind = sets.schema["src"].dataType
    out = T.StructType([T.StructField("x", kind), T.StructField("y", kind), T.StructField("m", T.LongType()), T.StructField("sum", T.LongType())])

    def work(batches):
        for pair in groups(batches, "pair"):
            i, j = divmod(pair.column("pair")[0].as_py(), blocks)
            one = pair.filter(pc.equal(pair.column("block"), i))
            two = one if i == j else pair.filter(pc.equal(pair.column("block"), j))
            for x, y, m, total in similar_sets(*(part for t in (one, two) for part in _flat(t)), least, i == j):
                yield from pa.Table.from_arrays([one.column("src").take(pa.array(x)), two.column("src").take(pa.array(y)), pa.array(m), pa.array(total)], ["x", "y", "m", "sum"]).combine_chunks().to_batches()

    dealt = sets.select(F.pmod(F.xxhash64("src"), F.lit(blocks)).cast("long").alias("block"), "src", "s")
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = other.select((F.least("block", "other") * F.lit(blocks) + F.greatest("block", "other")).alias("pair"), "block", "src", "s")
    met = spread(rows, "pair").sortWithinPartitions("pair").transform(in_arrow, work, out)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("m") / (F.col("sum") - F.col("m"))).alias("jaccard"))


def _flat(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The elements of column s one after another, and where each set's begin, and the end."""
    s = t.column("s")
    return pc.list_flatten(s).to_numpy(), np.cumsum(np.concatenate(([0], pc.list_value_length(s).to_numpy()))).astype(np.int64)


#: Columns of a product, and rows of it that are looked through at a time. Elements that fewer than one in RARE of all
#: pairs share are counted pair by pair.
COLUMNS, LOOK, RARE = 1024, 256, 128


def similar_sets(one: np.ndarray, one_at: np.ndarray, two: np.ndarray, two_at: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(x, y, shared, both sizes together) of the sets x of one and y of two, given by their elements and where each
    begins, that are at least so similar; with same, of x < y only."""
    na, nb = np.diff(one_at), np.diff(two_at)
    values, code = np.unique(np.concatenate((one, two)), return_inverse=True)
    a, b = code[: len(one)], code[len(one) :]
    ra, rb = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    fa, fb = np.bincount(a, minlength=len(values)), np.bincount(b, minlength=len(values))
    shared = np.zeros((len(na), len(nb)), np.float32)
    many = fa * fb > len(na) * len(nb) / RARE
    place = np.full(len(values), -1)
    place[many] = np.arange(many.sum())
    for at in range(0, int(many.sum()), COLUMNS):
        parts = []
        for c, r, n in ((a, ra, len(na)), (b, rb, len(nb))):
            some = (place[c] >= at) & (place[c] < at + COLUMNS)
            part = np.zeros((n, min(COLUMNS, int(many.sum()) - at)), np.float32)
            part[r[some], place[c[some]] - at] = 1
            parts.append(part)
        shared += parts[0] @ parts[1].T
    few = (fa > 0) & (fb > 0) & ~many
    ka, kb = few[a], few[b]
    a, ra, b, rb = a[ka], ra[ka], b[kb], rb[kb]
    order = np.argsort(b, kind="stable")
    b, rb = b[order], rb[order]
    for at in range(0, len(a), 1 << 11):
        some = slice(at, at + (1 << 11))
        low, high = np.searchsorted(b, a[some]), np.searchsorted(b, a[some], "right")
        n = high - low
        x = np.repeat(ra[some], n)
        y = rb[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        np.add.at(shared, (x, y), 1)
    for at in range(0, len(na), LOOK):
        m = shared[at : at + LOOK].astype(np.int64)
        total = na[at : at + LOOK, None] + nb[None]
        found = (m > 0) & (m >= least * (total - m) - 1e-9 * (total - m))
        if same:
            found &= np.arange(at, at + len(m))[:, None] < np.arange(len(nb))[None]
        x, y = np.nonzero(found)
        if len(x):
            yield x + at, y, m[x, y], total[x, y]


def component_labels(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id that is connected, by least labels with shortcuts."""
    e = _clean(edges)
    both = cut(e.unionByName(reverse(e)).distinct())
    label = cut(nodes(e).withColumn("label", F.col("id")))
    while True:
        near = both.join(label.select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("m"))
        new = label.join(near, "id", "left").select("id", "label", F.least("label", F.coalesce("m", "label")).alias("to"))
        far = new.select(F.col("id").alias("to"), F.col("to").alias("further"))
        new = cut(new.join(far, "to").select("id", F.least("to", "further").alias("label"), (F.least("to", "further") < F.col("label")).alias("moved")))
        if new.filter("moved").isEmpty():
            return new.select("id", "label")
        label = new.select("id", "label")


def with_root(edges: DataFrame, packages: DataFrame, root: str = "ROOT") -> DataFrame:
    """edges and one from a root to every package (column id)."""
    return edges.select("src", "dst").unionByName(packages.select(F.lit(root).alias("src"), F.col("id").alias("dst")))


def plain_versions(edges: DataFrame, version: str = "dst_version") -> DataFrame:
    """Versioned edges whose version is no URL."""
    return edges.filter(~F.coalesce(F.col(version).rlike(r"^[a-z+]+:|/"), F.lit(False)))
