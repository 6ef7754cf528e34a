"""Control flow of methods: numbering of blocks and depth of loops, one small Python function a method."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornbeam.functions.storage import in_arrow

OUT = "method string, block int, seq int, out_degree int, loop_depth int"


def joins(successors: dict[int, list[int]]) -> dict[int, int | None]:
    """The block that every way from a block to an exit meets first (its immediate post-dominator), or None."""
    every = set(successors)
    on_all = {b: ({b} if not s else set(every)) for b, s in successors.items()}
    changed = True
    while changed:
        changed = False
        for b, s in successors.items():
            if s and (new := {b} | set.intersection(*(on_all[x] for x in s))) != on_all[b]:
                on_all[b], changed = new, True
    ended = {b for b, s in successors.items() if not s}
    while more := {b for b, s in successors.items() if b not in ended and ended.intersection(s)}:
        ended |= more
    # of those behind a block the nearest has most behind itself
    return {b: max(on_all[b] - {b}, key=lambda x: len(on_all[x]), default=None) if b in ended else None for b in successors}


def number_blocks(successors: dict[int, list[int]], entry: int, statements: dict[int, list[str]] | None = None) -> dict[int, int]:
    """Places 0, 1, ... of the blocks that the entry reaches. Of several branches first comes the one with more
    successors, then more predecessors, then more statements, then the statements whose digests are larger, then the
    larger number, so that equal methods number alike; each is followed as far as the block where all of them join, and
    that block comes after them."""
    before: dict[int, int] = {b: 0 for b in successors}
    for s in successors.values():
        for x in s:
            before[x] = before.get(x, 0) + 1
    own = statements or {}
    rank = {b: (len(s), before[b], len(own.get(b, ())), [hashlib.md5(t.encode()).hexdigest() for t in own.get(b, ())], b) for b, s in successors.items()}
    join, place = joins(successors), {}
    todo: list[tuple[int, frozenset[int]]] = [(entry, frozenset())]
    while todo:
        b, stop = todo.pop()
        if b in place or b in stop:
            continue
        place[b] = len(place)
        ways = sorted({x for x in successors.get(b, ()) if x not in place and x not in stop}, key=lambda x: rank[x])
        if len(ways) < 2:
            todo += [(x, stop) for x in ways]
        elif (end := join[b]) is None:
            todo += [(x, stop) for x in ways]
        else:
            todo.append((end, stop))
            todo += [(x, stop | {end}) for x in ways]
    return place


def loop_depths(successors: dict[int, list[int]], entry: int) -> dict[int, int]:
    """How many natural loops hold each block that the entry reaches: edges back to a dominator make them."""
    order = list(number_blocks(successors, entry))
    before: dict[int, list[int]] = {b: [] for b in order}
    for b in order:
        for s in successors.get(b, ()):
            before[s].append(b)
    above = {b: set(order) for b in order}
    above[entry] = {entry}
    changed = True
    while changed:
        changed = False
        for b in order:
            if b != entry:
                new = {b} | set.intersection(*(above[p] for p in before[b]))
                changed |= new != above[b]
                above[b] = new
    loops: dict[int, set[int]] = {}
    for b in order:
        for head in successors.get(b, ()):
            if head in above[b]:
                body, todo = loops.setdefault(head, {head}), [b]
                while todo:
                    x = todo.pop()
                    if x not in body:
                        body.add(x)
                        todo += before[x]
    return {b: sum(b in body for body in loops.values()) for b in order}


def block_features(methods: DataFrame) -> DataFrame:
    """Rows of OUT from (method, blocks array<struct<block, stmt_count, successors>>), optionally with `statements` in the
    structs; the first block is the entry, and blocks that it does not reach are left out. One row a method in, so
    methods of any number spread over tasks."""
    texts = "statements" in {f.name for f in methods.schema["blocks"].dataType.elementType.fields}

    def work(batches):
        for b in batches:
            rows = []
            for method, blocks in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if blocks:
                    next_ = {x["block"]: [s for s in x["successors"] or [] if any(s == y["block"] for y in blocks)] for x in blocks}
                    entry = blocks[0]["block"]
                    depth = loop_depths(next_, entry)
                    for k, seq in number_blocks(next_, entry, {x["block"]: (x["statements"] or [] if texts else [""] * (x["stmt_count"] or 0)) for x in blocks}).items():
                        rows.append((method, k, seq, len(set(next_[k])), depth[k]))
            kinds = [pa.string()] + [pa.int32()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], [x.split()[0] for x in OUT.split(", ")])

    return methods.select("method", F.transform("blocks", lambda x: F.struct(*[x[c].cast(t).alias(c) for c, t in (("block", "int"), ("stmt_count", "int"), ("successors", "array<int>"), *((("statements", "array<string>"),) if texts else ()))])).alias("blocks")).transform(in_arrow, work, OUT)
