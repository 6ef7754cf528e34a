"""Product codes of vectors: each of PARTS equal parts becomes the number of the nearest entry of its own codebook.

Components are taken as integers, floor(scale * x). The codebooks start as the parts of the rows with the smallest ids.
In each round a kd-tree of every codebook is broadcast (its size is that of the codebooks, whatever the number of rows),
workers look up the nearest entries of their rows and send one integer sum and count for each entry, component and task,
and the sums' floored means become the new entries; an entry that no row has stays. The search begins in the leaf that a
part falls in; other nodes are visited while their box is as near as the best entry so far or nearer, so that of equally
near entries the one with the lowest number is found. Sums are of whole numbers, so the order in which tasks come or are
run again makes no difference.

Defined results: rows without a vector, or with null or non-finite components, are left out; null ids come last, and rows
of one id are ordered by their vectors; repeated rows are rows of their own; fewer rows than entries give fewer entries; a
null label is a label of its own; an empty table gives an empty result; extra columns are left out. Vectors of different
lengths, of a length that has no so many equal parts, or with components whose squares would not fit 64 bits raise.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.llm.common import cut, in_arrow, skewed_join, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256.0
#: Entries of a leaf, components that are worked on together.
LEAF, TOGETHER = 4, 1 << 20
#: Labels whose errors are broadcast: so many at most.
LABELS = 100_000


class KDTree:
    """Over entries (number, component) of whole numbers."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.members: list[np.ndarray | None] = []
        self.low, self.high, self.dim, self.split, self.left, self.right = [], [], [], [], [], []
        self._add(np.arange(len(entries)))
        self.dim, self.split, self.left, self.right = map(np.array, (self.dim, self.split, self.left, self.right))

    def _add(self, members: np.ndarray) -> int:
        own, points = len(self.members), self.entries[members]
        low, high = points.min(0), points.max(0)
        for kept, value in ((self.members, None), (self.low, low), (self.high, high), (self.dim, 0), (self.split, 0), (self.left, own), (self.right, own)):
            kept.append(value)
        dim = int(np.argmax(high - low)) if len(low) else 0
        if len(members) <= LEAF or not len(low) or high[dim] == low[dim]:
            self.members[own] = np.sort(members)
            return own
        values = points[:, dim]
        split = int(np.sort(values)[(len(values) - 1) // 2])
        if split == high[dim]:
            split = int(values[values < split].max())
        self.dim[own], self.split[own] = dim, split
        self.left[own], self.right[own] = self._add(members[values <= split]), self._add(members[values > split])
        return own

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the entry nearest to each row; of equally near ones the lowest number."""
        n, rows = len(x), np.arange(len(x))
        home = np.zeros(n, np.int64)
        while True:
            down = np.where(x[rows, self.dim[home]] <= self.split[home], self.left[home], self.right[home]) if x.shape[1] else home
            if (down == home).all():
                break
            home = down
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.entries))

        def compare(node: int, some: np.ndarray) -> None:
            members = self.members[node]
            apart = ((x[some, None] - self.entries[members]) ** 2).sum(2)
            k = apart.argmin(1)  # the first of equals, and members are in order
            d, who = apart[np.arange(len(some)), k], members[k]
            better = (d < best[some]) | (d == best[some]) & (who < number[some])
            best[some[better]], number[some[better]] = d[better], who[better]

        def visit(node: int, some: np.ndarray) -> None:
            out = np.maximum(np.maximum(self.low[node] - x[some], x[some] - self.high[node]), 0)
            some = some[(out**2).sum(1) <= best[some]]
            if self.members[node] is None:
                if len(some):
                    visit(self.left[node], some)
                    visit(self.right[node], some)
            elif len(some := some[home[some] != node]):
                compare(node, some)

        for node, members in enumerate(self.members):
            if members is not None and len(some := np.flatnonzero(home == node)):
                compare(node, some)
        visit(0, rows)
        return number, best


def whole(vectors: pa.Array | pa.ChunkedArray, dim: int, scale: float) -> np.ndarray:
    """The integer components, (row, component)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(vectors) * dim or (np.diff(vectors.offsets.to_numpy()) != dim).any():
        raise ValueError(f"a vector does not have {dim} components")
    x = np.floor(scale * flat.astype(np.float64))
    if len(x) and max(dim, 1) * (2 * np.abs(x).max()) ** 2 >= 2.0**62:
        raise ValueError("components are too large for squared distances of 64 bits")
    return x.astype(np.int64).reshape(len(vectors), dim)


def _assigned(trees: list[KDTree], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, errors): a column each part."""
    found = [tree.nearest(part) for tree, part in zip(trees, np.split(x, len(trees), 1))]
    return np.stack([a for a, _ in found], 1), np.stack([b for _, b in found], 1)


def _together(batches, dim: int):
    """Tables of about TOGETHER components."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b) * max(dim, 1)
        if n >= TOGETHER:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def kept(rows: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """(vec_id, vector, label) of the rows whose vector is whole and finite."""
    v = rows.select(rows[id_col].cast("long").alias("vec_id"), rows[vector_col].cast("array<double>").alias("vector"), rows[label_col].alias("label"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.filter(F.col("vector").isNotNull() & ~F.exists("vector", odd))


def first_entries(v: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: float = SCALE) -> np.ndarray | None:
    """(part, number, component) of the rows with the smallest ids; None where there is no row."""
    first = v.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not first:
        return None
    dim = len(first[0].vector)
    if dim % parts:
        raise ValueError(f"{dim} components do not make {parts} equal parts")
    x = whole(pa.array([r.vector for r in first], pa.list_(pa.float64())), dim, scale)
    return np.stack(np.split(x, parts, 1))


def _sent(spark: SparkSession, books: np.ndarray) -> Broadcast:
    return spark.sparkContext.broadcast([KDTree(b) for b in books])


def refined(v: DataFrame, books: np.ndarray, scale: float = SCALE) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, width = books.shape
    trees = _sent(v.sparkSession, books)

    def work(batches):
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for t in _together(batches, parts * width):
            x = whole(t.column("vector"), parts * width, scale)
            codes, _ = _assigned(trees.value, x)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], x[:, p * width : (p + 1) * width])
                counts[p] += np.bincount(codes[:, p], minlength=entries)
        p, e = np.nonzero(counts)
        for place in range(-1, width):  # -1: the count
            total = counts[p, e] if place < 0 else sums[p, e, place]
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(np.full(len(p), place, np.int32)), pa.array(total)], ["part", "entry", "place", "total"])

    sent = v.select("vector").transform(in_arrow, work, "part int, entry int, place int, total long")
    new, counts = books.copy(), np.zeros((parts, entries), np.int64)
    rows = sent.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect()  # as many as the codebooks have components
    for r in rows:
        if r.place < 0:
            counts[r.part, r.entry] = r.total
    for r in rows:
        if r.place >= 0:
            new[r.part, r.entry, r.place] = r.total // counts[r.part, r.entry]
    return new


def codebooks(v: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> np.ndarray | None:
    """(part, number, component) after all rounds."""
    books = first_entries(v, parts, entries, scale)
    for _ in range(rounds if books is not None else 0):
        books = refined(v, books, scale)
    return books


def encoded(v: DataFrame, books: np.ndarray, scale: float = SCALE) -> DataFrame:
    """(vec_id, label, code, error): two hex digits a part, and the squared distances of all parts."""
    parts, entries, width = books.shape
    if entries > 256:
        raise ValueError("two hex digits hold 256 entries")
    trees = _sent(v.sparkSession, books)

    def work(batches):
        for t in _together(batches, parts * width):
            codes, errors = _assigned(trees.value, whole(t.column("vector"), parts * width, scale))
            hexed = codes.astype(np.uint8).tobytes().hex()
            code = pa.array([hexed[k : k + 2 * parts] for k in range(0, len(hexed), 2 * parts)], pa.string())
            out = pa.Table.from_arrays([t.column("vec_id"), t.column("label"), code, pa.array(errors.sum(1))], ["vec_id", "label", "code", "error"])
            yield from out.combine_chunks().to_batches()

    label = v.schema["label"].dataType.simpleString()
    return v.select("vec_id", "vector", "label").transform(in_arrow, work, f"vec_id long, label {label}, code string, error long")


def decoded(codes: DataFrame, books: np.ndarray, scale: float = SCALE) -> DataFrame:
    """codes (with a column code) and the vector that each stands for: the entries, over scale."""
    table = F.array(*[F.array(*[F.array(*[F.lit(float(x) / scale) for x in entry]) for entry in book]) for book in books])
    at = lambda k: F.conv(F.substring("code", 2 * k + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.flatten(F.array(*[table[k][at(k)] for k in range(len(books))])))


def _with_label_errors(rows: DataFrame) -> DataFrame:
    """rows with label_error, the error of all rows with the same label."""
    totals = cut(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    if totals.count() <= LABELS:
        small = totals.select(F.col("label").alias("_of"), "label_error")
        return rows.join(F.broadcast(small), F.col("label").eqNullSafe(F.col("_of"))).drop("_of")
    unlabelled = totals.filter("label IS NULL").first()
    named = skewed_join(rows.filter("label IS NOT NULL"), totals.filter("label IS NOT NULL"), "label", "n")
    rest = rows.filter("label IS NULL").withColumn("label_error", F.lit(unlabelled.label_error if unlabelled else None).cast("long"))
    return named.unionByName(rest)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE, **columns: str) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row that is kept. The codes are stored once."""
    v = kept(rows, **columns)
    books = codebooks(v, parts, entries, rounds, scale)
    if books is None:
        return v.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    out = _with_label_errors(stored(encoded(v, books, scale)))
    sha: Column = F.lit(digest(books))
    return out.select("vec_id", "code", "error", "label_error", sha.alias("codebooks_sha256"))


SQL = r"""
WITH kept AS (
  SELECT vec_id, label, q, len(q) // 16 AS w, row_number() OVER (ORDER BY vec_id NULLS LAST, q) AS r
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)),
parts AS MATERIALIZED (SELECT r, p, q[p * w + 1 : (p + 1) * w] AS v FROM kept, range(16) AS t(p)),
book0 AS (SELECT p, r - 1 AS e, v FROM parts WHERE r <= 64),
near1 AS (SELECT r, x.p, any_value(x.v) AS v, min({'d': list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, b.v) + list_inner_product(b.v, b.v), 'e': e}) AS m FROM parts x JOIN book0 b ON x.p = b.p GROUP BY r, x.p),
sums1 AS (SELECT p, e, k, floor(sum(c) / count(*)) AS c FROM (SELECT p, m.e AS e, unnest(v) AS c, unnest(range(len(v))) AS k FROM near1) GROUP BY p, e, k),
book1 AS MATERIALIZED (SELECT b.p, b.e, coalesce(any_value(n.v), any_value(b.v)) AS v FROM book0 b LEFT JOIN (SELECT p, e, list(c ORDER BY k) AS v FROM sums1 GROUP BY p, e) n ON b.p = n.p AND b.e = n.e GROUP BY b.p, b.e),
near2 AS (SELECT r, x.p, any_value(x.v) AS v, min({'d': list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, b.v) + list_inner_product(b.v, b.v), 'e': e}) AS m FROM parts x JOIN book1 b ON x.p = b.p GROUP BY r, x.p),
sums2 AS (SELECT p, e, k, floor(sum(c) / count(*)) AS c FROM (SELECT p, m.e AS e, unnest(v) AS c, unnest(range(len(v))) AS k FROM near2) GROUP BY p, e, k),
book2 AS MATERIALIZED (SELECT b.p, b.e, coalesce(any_value(n.v), any_value(b.v)) AS v FROM book1 b LEFT JOIN (SELECT p, e, list(c ORDER BY k) AS v FROM sums2 GROUP BY p, e) n ON b.p = n.p AND b.e = n.e GROUP BY b.p, b.e),
near3 AS (SELECT r, x.p, min({'d': list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, b.v) + list_inner_product(b.v, b.v), 'e': e}) AS m FROM parts x JOIN book2 b ON x.p = b.p GROUP BY r, x.p),
coded AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM near3 GROUP BY r),
sha AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY p, e, k)) AS s FROM (SELECT p, e, unnest(v) AS c, unnest(range(len(v))) AS k FROM book2))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256
FROM kept JOIN coded USING (r), sha
"""
