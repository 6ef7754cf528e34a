"""SimHash near-duplicate classes, searched with BK-trees over shards of fingerprints.

A fingerprint has 64 bits: bit i is set if it is set in more than half of the XXH64 hashes (seed 42) of a text's
word shingles. Two fingerprints link if at most RADIUS bits differ. Equal fingerprints meet once, with a count of
nothing but their smallest id, so copies cost no pairs. The distinct fingerprints are sharded: 64 bits in m blocks,
and two that differ in RADIUS bits agree on some m - RADIUS whole blocks, so each is sent to the shard of every choice
of m - RADIUS blocks. m grows with the number of fingerprints so that shards stay small; any m finds every link.
In a shard a BK-tree keeps children by their integer Hamming distance to the parent and a search follows only
edges within the radius of the distance at hand. Shards go to tasks by shuffle, not by way of the driver, which never
has all fingerprints. A shard of over SHARD fingerprints is sharded again by the bits it does not agree on, of which
some whole block agrees too; one that is still larger is cut into chunks: each pair of chunks is a task's work, with
the tree of one sent to it and the other as queries, so none outgrows a task. Only links that join two groups of a
shard are given out, so a group of n near copies gives n - 1 links, not all pairs.

Near copies by similarity (keep_alike): 64 bits do not tell a similarity of 0.8, at which about 10 of them differ, from
chance. Wide fingerprints of WORDS times 64 bits over distinct shingles of ALIKE_SHINGLE words do: as many bits differ as
the angle between the sets says. Blocks that must agree would be too short here, so a fingerprint is sharded by many
choices of bits, so many that two of the wanted similarity agree on all bits of some choice with probability SURE. A
shard over the limit takes more bits of its choice. In each shard a BK-tree links what is within the radius.

Null and blank texts have fingerprint zero, linked like any other. Null ids are kept; a class's id is its smallest
id that is not null (null if it has none). Repeated rows stay; extra columns are left out, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornbeam.llm.common import bounds, buckets, cut, in_arrow, runs, skewed_join
from hornbeam.llm.graphs import components
from hornbeam.llm.substring import shingles

SHINGLE, SEED, RADIUS = 4, 42, 4
SHARD = 4096
#: Keys of large shards are broadcast while there are at most this many (12 bytes each).
LARGE = 100_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    counts, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 1 << 15):
        part = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)])], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def mark_of(text: Column) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(text.cast("string"))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, fp): the text's mark, and fp as a signed long of the same bits."""

    def work(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], ["doc_id", "mark", "fp"])

    wanted = docs.select(docs[id_col].cast("long"), mark_of(docs[text_col]), docs[text_col].cast("string"))
    return wanted.transform(in_arrow, work, "doc_id long, mark long, fp long")


class BKTree:
    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        """A value that is there already is not added again."""
        at = 0
        while self.values:
            d = (self.values[at] ^ value).bit_count()
            if d == 0:
                return
            if (down := self.children[at].get(d)) is None:
                self.children[at][d] = len(self.values)
                break
            at = down
        self.values.append(value)
        self.children.append({})

    def near(self, value: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(self.values[at])
            todo += [c for e, c in self.children[at].items() if d - radius <= e <= d + radius]
        return found


def _blocks(bits: list[int], m: int) -> list[int]:
    """Masks of m even blocks of so many bits (by their places)."""
    edges = [len(bits) * k // m for k in range(m + 1)]
    return [sum(1 << b for b in bits[i:j]) for i, j in zip(edges, edges[1:])]


def _choices(n: int, radius: int) -> list[int]:
    """Masks: a block choice each. Shards hold about n / 2^(bits of a mask) fingerprints if those are spread evenly."""
    m = radius + 1 + (n > 1 << 18) + (n > 1 << 26)
    return [sum(c) for c in combinations(_blocks(list(range(64)), m), m - radius)]


def _keyed(fps: DataFrame, choice: Column, masks: dict[int, list[int]]) -> DataFrame:
    """fps once for each mask of its choice: key the bits of the mask. masks: choice -> (number, mask)."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = lambda of: F.array(*[F.struct(F.lit(k).alias("c"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for k, m in of])
    one, *more = masks.items()
    every = F.when(choice == one[0], keys(one[1]))
    for k, of in more:
        every = every.when(choice == k, keys(of))
    return fps.select("fp", F.explode(every).alias("k")).select("fp", "k.c", "k.key")


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): links that join all fingerprints (fp, distinct) that are connected within the radius."""
    spark = fps.sparkSession
    masks = _choices(fps.count(), radius)
    keyed = _keyed(fps, F.lit(0), {0: list(enumerate(masks))})
    over = lambda of: of.groupBy("c", "key").count().filter(F.col("count") > shard)
    large = over(keyed).select("c", "key")
    n = large.count()
    if n:
        large = F.broadcast(large) if n <= LARGE else large
        again = {c: [(len(masks) + c * (radius + 1) + k, m | x) for k, x in enumerate(_blocks([b for b in range(64) if not m >> b & 1], radius + 1))] for c, m in enumerate(masks)}
        inner = keyed.join(large, ["c", "key"], "left_semi")
        keyed = keyed.join(large, ["c", "key"], "left_anti").unionByName(_keyed(inner.select("fp", "c"), F.col("c"), again))
        sizes = over(keyed)
        n = sizes.count()
    if n:
        sizes = sizes.select("c", "key", F.ceil(F.col("count") / shard).cast("int").alias("chunks"))
        keyed = keyed.join(F.broadcast(sizes) if n <= LARGE else sizes, ["c", "key"], "left")
        own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        cells = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
        keyed = keyed.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", F.explode(cells))
        keyed = keyed.select("fp", "c", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    else:
        keyed = keyed.select("fp", "c", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"))
    shards = ["c", "key", "i", "j"]

    def join(fps: list[int], tree_too: np.ndarray, whole: bool, out: list[tuple[int, int]]) -> None:
        tree, top = BKTree(), {f: f for f in fps}

        def root(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        if not whole:
            for f, own in zip(fps, tree_too):
                if own:
                    tree.add(f)
        for f, own in zip(fps, tree_too):
            if whole or not own:
                for g in tree.near(f, radius):
                    if (a := root(f)) != (b := root(g)):
                        top[max(a, b)] = min(a, b)
                        out.append((f, g))
                if whole:
                    tree.add(f)

    def work(batches):
        for t in runs(batches, shards, 10 * SHARD):
            cols = {k: t.column(k).to_numpy() for k in ("fp", *shards, "own")}
            at, out = bounds(*(cols[k] for k in shards)), []
            raw = cols["fp"].view(np.uint64)
            for k in np.flatnonzero(np.diff(at) > 1):
                a, b = at[k], at[k + 1]
                i, j = cols["i"][a], cols["j"][a]
                join(raw[a:b].tolist(), cols["own"][a:b] == i, i == j, out)
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return keyed.repartition(buckets(spark), *shards).sortWithinPartitions(*shards, "fp").transform(in_arrow, work, "a long, b long")


def _named(own: DataFrame, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (doc_id, mark, fp) with component_id, and first: the id and mark of the class's one row that stays. link: the
    distinct fp, with whatever else own has of them -> (a, b)."""
    own = cut(own)
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))
    more = [F.min(c).alias(c) for c in own.columns if c not in ("doc_id", "mark", "fp")]
    fps = cut(own.groupBy("fp").agg(F.min(row).alias("first"), F.count("*").alias("n"), *more))
    found = components(link(fps))
    named = fps.join(found, fps.fp == found.node, "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root"))
    linked = named.join(found.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("first").alias("least"))
    by_fp = cut(named.join(linked, "root", "left").select("fp", "n", F.coalesce("least", "first").alias("first")))
    joined = skewed_join(own.select("doc_id", "mark", "fp"), by_fp, "fp", "n")
    return joined.select("doc_id", "mark", "fp", F.col("first.doc_id").alias("component_id"), "first")


def classes(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id that links reach from each document, its own included."""
    return _named(fingerprints(docs, shingle), lambda fps: links(fps, radius, shard)).select("doc_id", "fp", "component_id")


#: Ids of documents to leave out are broadcast while there are at most this many (16 bytes each).
BROADCAST = 500_000


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """docs with one row of each class, the one with the smallest id, with all its columns. Rows without an id stay. A
    row is told by its id and its text: of rows that share an id, those with texts of other classes stay where they are
    the first of their class; of rows equal in both, one stays."""
    return _first_of_each(docs, _named(fingerprints(docs, shingle), lambda fps: links(fps, radius, shard)))


def _first_of_each(docs: DataFrame, named: DataFrame) -> DataFrame:
    found = cut(named.filter("doc_id IS NOT NULL"))
    me = F.struct("doc_id", "mark")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST else df
    names = [F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")]
    gone = small(found.filter(me != F.col("first")).select(*names).distinct())
    again = found.filter(me == F.col("first")).groupBy("doc_id", "mark").count().filter("count > 1").select(*names)
    same = (docs["doc_id"].cast("long") == F.col("_id")) & (mark_of(docs["text"]) == F.col("_mark"))
    kept = docs.join(gone, same, "left_anti")
    if again.isEmpty():
        return kept
    again = small(again)
    repeated = kept.join(again, same, "inner").dropDuplicates(["_id", "_mark"]).select(*kept.columns)
    return kept.join(again, same, "left_anti").unionByName(repeated)


#: Wide fingerprints: words of 64 bits, words of a shingle, similarity that is wanted, and how sure it is found in a shard.
WORDS, ALIKE_SHINGLE, ALIKE, SURE = 4, 5, 0.8, 0.95
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIXERS = np.random.default_rng(17).integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def wide_fingerprint(text: str | None) -> bytes:
    """64 * WORDS bits: each set if it is in over half the hashes of the distinct shingles (fewer words: the whole text's;
    none: zero)."""
    h = np.unique(shingles(text))
    if not len(h):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return bytes(8 * WORDS)
        from xxhash import xxh64_intdigest

        h = np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    counts = np.zeros((WORDS, 64), np.int64)
    for at in range(0, len(h), 1 << 14):
        x = h[None, at : at + (1 << 14)] * _MIXERS[:, None]
        x ^= x >> np.uint64(32)
        x *= _MIXERS[::-1, None]
        x ^= x >> np.uint64(29)
        counts += np.unpackbits(x.view(np.uint8).reshape(WORDS, -1, 8), axis=2, bitorder="little").sum(1, dtype=np.int64)
    return np.packbits(counts.reshape(-1) * 2 > len(h), bitorder="little").tobytes()


def wide_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, wide, fp): the wide fingerprint and a hash of it."""

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([wide_fingerprint(t) for t in b.column(2).to_pylist()], pa.binary())], ["doc_id", "mark", "wide"])

    wanted = docs.select(docs[id_col].cast("long"), mark_of(docs[text_col]), docs[text_col].cast("string"))
    return wanted.transform(in_arrow, work, "doc_id long, mark long, wide binary").withColumn("fp", F.xxhash64("wide"))


def share_of_bits(similarity: float) -> float:
    """The share of bits that differ between sets of one size with a Jaccard similarity: their angle over a half turn."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def wide_radius(similarity: float = ALIKE) -> int:
    """Bits within which 99 of 100 pairs of that similarity differ, if bits were drawn one by one."""
    n, p = 64 * WORDS, share_of_bits(similarity)
    return round(n * p + 2.326 * (n * p * (1 - p)) ** 0.5)


def bit_choices(n: int, similarity: float = ALIKE, sure: float = SURE) -> tuple[int, np.ndarray]:
    """(bits, choices): how many bits of each choice, an order of all bits, must agree: about 8 of n fingerprints do."""
    bits = min(max(8, int(np.ceil(np.log2(max(n, 2)))) - 3), 48)
    agree = (1 - share_of_bits(similarity)) ** bits
    many = int(np.ceil(np.log(1 - sure) / np.log(1 - agree)))
    rng = np.random.default_rng(19)
    return bits, np.stack([rng.permutation(64 * WORDS) for _ in range(many)])


#: How sure a pair in a shard over the limit meets again in a finer one; how often what is still over it is cut; bits that
#: a cut takes beyond those that the size asks for.
AGAIN, CUTS, FINER = 0.95, 4, 4
#: Values of a shard from which it is looked for one that many are near to.
CROWD = 64


def _many(bits: int, similarity: float, sure: float) -> int:
    """Choices of so many bits of which a pair of that similarity agrees on one with probability `sure`."""
    return int(np.ceil(np.log(1 - sure) / np.log(1 - (1 - share_of_bits(similarity)) ** bits)))


def _unpacked(wide: pa.Array) -> np.ndarray:
    """(row, bit) of fingerprints."""
    return np.unpackbits(np.frombuffer(b"".join(wide.to_pylist()), np.uint8).reshape(-1, 8 * WORDS), axis=1, bitorder="little")


def _key_of(bits: np.ndarray, salt: np.ndarray | np.uint64) -> np.ndarray:
    """A hash of each row's bits, 64 at most, and a salt."""
    agreed = np.packbits(bits, axis=1, bitorder="little")
    key = np.zeros((len(bits), 8), np.uint8)
    key[:, : agreed.shape[1]] = agreed
    return ((key.view(np.uint64)[:, 0] ^ salt) * _GOLDEN + salt).view(np.int64)


def wide_links(fps: DataFrame, similarity: float = ALIKE, shard: int = SHARD) -> DataFrame:
    """(a, b): links, by their hashes, that join all fingerprints (fp, wide; distinct) that a choice of bits and the radius
    connect. A shard over the limit is cut by more bits, by so many choices of them that a pair in it still meets with
    probability AGAIN. What is over the limit even then, a group of so many near copies that agree nearly everywhere, is
    cut by more bits again, by one choice, and its members are linked to the first of them that is near: pairs of such a
    group that neither meet nor are near its first are lost."""
    spark, radius = fps.sparkSession, wide_radius(similarity)
    bits, choices = bit_choices(fps.count(), similarity)
    salts = np.arange(1, len(choices) + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)

    def keys(batches):
        for b in batches:
            own, wide = b.column(0), b.column(1)
            x = _unpacked(wide)
            for c in range(len(choices)):
                yield pa.RecordBatch.from_arrays([pa.array(_key_of(x[:, choices[c, :bits]], salts[c])), own, wide], ["key", "fp", "wide"])

    def finer(level: int):
        def work(batches):
            for b in batches:
                x, key, more = _unpacked(b.column("wide")), b.column("key").to_numpy().view(np.uint64), b.column("more").to_numpy()
                for n in np.unique(more).tolist():
                    rows = np.flatnonzero(more == n)
                    own, wide = (b.column(c).take(pa.array(rows)) for c in ("fp", "wide"))
                    for k in range(1 if level else _many(n, similarity, AGAIN)):
                        chosen = np.random.default_rng([23, level, n, k]).permutation(64 * WORDS)[:n]
                        salt = (key[rows] ^ np.uint64((k + 1) * 0x2545F4914F6CDD1D & (1 << 64) - 1)) * _GOLDEN
                        yield pa.RecordBatch.from_arrays([pa.array(_key_of(x[rows][:, chosen], salt)), own, wide], ["key", "fp", "wide"])

        return work

    def work(batches):
        for t in runs(batches, ["key"], 10 * SHARD):
            key, names = t.column("key").to_numpy(), t.column("fp").to_numpy()
            wide, at, out = t.column("wide").to_pylist(), bounds(key), []
            for k in np.flatnonzero(np.diff(at) > 1).tolist():
                _join_all(wide[at[k] : at[k + 1]], names[at[k] : at[k + 1]].tolist(), radius, out)
            pairs = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def near_first(batches):
        for b in batches:
            one, two = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(-1, WORDS) for c in ("wide", "first_wide"))
            near = np.bitwise_count(one ^ two).sum(1, dtype=np.int64) <= radius
            yield pa.RecordBatch.from_arrays([b.column("fp"), b.column("first")], ["a", "b"]).filter(pa.array(near))

    keyed = fps.select("fp", "wide").transform(in_arrow, keys, "key long, fp long, wide binary")
    small, links = None, None
    for level in range(CUTS + 1):
        first = F.min(F.struct("fp", "wide"))
        large = cut(keyed.groupBy("key").agg(F.count("*").alias("count"), first.alias("f")).filter(F.col("count") > shard).select("key", "count", F.col("f.fp").alias("first"), F.col("f.wide").alias("first_wide")))
        n = large.count()
        if not n or level == CUTS:
            break
        large = F.broadcast(large) if n <= LARGE else large
        rest = keyed.join(large, "key", "left_anti")
        small = rest if small is None else small.unionByName(rest)
        over = keyed.join(large, "key")
        if level:
            star = over.filter(F.col("fp") != F.col("first")).select("fp", "wide", "first", "first_wide").transform(in_arrow, near_first, "a long, b long")
            links = star if links is None else links.unionByName(star)
        more = F.least(F.ceil(F.log2(F.col("count") / shard)) + FINER, F.lit(64)).cast("int")
        keyed = over.select("key", more.alias("more"), "fp", "wide").transform(in_arrow, finer(level), "key long, fp long, wide binary")
    rows = keyed if small is None else small.unionByName(keyed)
    found = rows.repartition(buckets(spark), "key").sortWithinPartitions("key").transform(in_arrow, work, "a long, b long")
    return found if links is None else found.unionByName(links)


def _join_all(wide: list[bytes], names: list[int], radius: int, out: list[tuple[int, int]]) -> None:
    """Links by name that join all values connected within the radius. In a crowd, all that are within half the radius of
    the value in its middle are near each other, so they are linked to that one and look for no others."""
    values, settled = [int.from_bytes(w, "little") for w in wide], [False] * len(wide)
    tree, of, top = BKTree(), {}, {v: v for v in values}

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    def join(a: int, b: int, name: int, other: int) -> None:
        if (x := root(a)) != (y := root(b)):
            top[max(x, y)] = min(x, y)
            out.append((name, other))

    if len(wide) >= CROWD:
        x = np.frombuffer(b"".join(wide), np.uint64).reshape(len(wide), -1)
        middle = np.packbits(np.unpackbits(x.view(np.uint8), axis=1).sum(0, dtype=np.int64) * 2 > len(wide)).view(np.uint64)
        leader = int(np.bitwise_count(x ^ middle).sum(1, dtype=np.int64).argmin())
        close = np.bitwise_count(x ^ x[leader]).sum(1, dtype=np.int64) <= radius // 2
        settled = close.tolist()
        for k in np.flatnonzero(close).tolist():
            if k != leader:
                join(values[k], values[leader], names[k], names[leader])
    for v, name in zip(values, names):
        of[v] = name
    for v, mark in zip(values, settled):
        if mark:
            tree.add(v)
    for v, name, mark in zip(values, names, settled):
        if not mark:
            for g in tree.near(v, radius):
                join(v, g, name, of[g])
            tree.add(v)


def keep_alike(docs: DataFrame, similarity: float = ALIKE, shard: int = SHARD) -> DataFrame:
    """As keep_one(), for classes of documents whose sets of shingles have that Jaccard similarity, by wide fingerprints."""
    return _first_of_each(docs, _named(wide_fingerprints(docs), lambda fps: wide_links(fps, similarity, shard)))
