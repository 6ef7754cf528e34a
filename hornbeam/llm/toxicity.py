"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios (Wang & Manning, 2012).

Features are the distinct n-grams of characters of the lower-cased text, each run of white space one space, hashed to
2^BITS places; all places that a training text has count. Training takes a bounded sample: at most about SAMPLE
documents of each class, chosen by a hash of their ids and texts, each text once, and of these no more than about CHARS
characters a class. Each place is scaled by its log-count ratio, less so the less its counts tell: by the square of their
likelihood ratio's share of SURE, up to one. Logistic regression with an L2 penalty is then fitted by dual coordinate
descent, text by text, until nothing moves; the result is that of the convex problem, whatever the order.
The intercept is set for the share of toxic labels among all labels in use. A score is that of the whole text.

Defined results: null and empty texts have no features and get the score of the intercept; a document with several
labels trains once, as toxic if any label says so; null labels do not train; without labels of both classes every
score is the share of toxic labels (0 if there are none). Repeated rows and null ids are scored each; an empty table
gives an empty result; extra columns, `score` among them, are left out by score() and kept by accepted().
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornbeam.llm.common import fold, give_back, in_arrow, stored

ORDERS, BITS = (3, 4, 5), 20
SAMPLE, CHARS, SMOOTH = 4000, 25_000_000, 1.0
#: What a training text's loss weighs against the penalty, and when the fit ends.
COST, SWEEPS, STILL = 1.0, 60, 1e-3
#: A likelihood ratio (twice its logarithm) at which a place's counts are taken as they are.
SURE = 20.0
FOLDS, HELD = 5, 0
END = 1 << BITS
#: Characters of text hashed at a time; longer texts are taken in pieces that overlap by an n-gram.
PIECE = 1 << 20


def places(text: str | None) -> np.ndarray:
    """The hashed n-grams of a text, with repeats, in no order."""
    plain = " ".join((text or "").lower().split())
    if not plain:
        return np.zeros(0, np.uint32)
    x = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for at in range(0, len(x), PIECE):
        y = x[at : at + PIECE + max(ORDERS) - 1]
        h = np.zeros(len(y), np.uint32)
        for k in range(max(ORDERS)):
            h = (h[: len(y) - k] if k else h) * np.uint32(0x01000193)
            h = h[: max(0, len(y) - k)] + y[k:] + np.uint32(1)
            if k + 1 in ORDERS:
                own = h[: max(0, min(len(h), PIECE))]  # the next piece has those that begin in it
                out.append(((own ^ (own >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(k)) >> np.uint32(32 - BITS))
    return np.concatenate(out)


@dataclass
class Model:
    """Weight per place, and the intercept."""

    weights: np.ndarray
    intercept: float
    last: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.int64), repr=False)

    def score(self, text: str | None) -> float:
        found, z = places(text), self.intercept
        if len(found):
            n = np.arange(len(found))
            self.last[found] = n  # where each place comes last: there it counts
            z += float(self.weights[found[self.last[found] == n]].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def scales(clean: np.ndarray, toxic: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """What each place's feature is multiplied by, from the numbers of texts that have it and of all texts."""
    c0, c1 = clean + SMOOTH, toxic + SMOOTH
    ratio = np.log(c1 / c1.sum()) - np.log(c0 / c0.sum())
    both, every = clean + toxic, n0 + n1

    def part(seen: np.ndarray, due: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(due, 1e-300)), 0.0)

    telling = 2 * (part(toxic, both * n1 / every) + part(clean, both * n0 / every) + part(n1 - toxic, (every - both) * n1 / every) + part(n0 - clean, (every - both) * n0 / every))
    return np.where(both > 0, ratio * np.clip(telling / SURE, 0, 1) ** 2, 0.0)


def fit(texts: Sequence[np.ndarray], toxic: np.ndarray, cost: float = COST) -> tuple[np.ndarray, float]:
    """Weights and intercept from the distinct places of each text, ended by END. Minimizes half the squared norm of the coefficients
    of the scaled features, the intercept's among them, and cost times the sum of logistic losses. Of the dual one
    variable a text is solved for at a time, by Newton steps; weights are kept times their scale."""
    toxic = np.asarray(toxic)
    counts = np.zeros((2, END + 1), np.int32)
    for t, y in zip(texts, toxic.tolist()):
        counts[y, t] += 1
    square = np.append(scales(*counts[:, :END], int((toxic == 0).sum()), int((toxic == 1).sum())) ** 2, 1.0).astype(np.float32)
    norms = [float(square[t].sum(dtype=np.float64)) for t in texts]
    sign = np.where(toxic == 1, 1.0, -1.0).tolist()
    w, dual = np.zeros(END + 1, np.float32), [1e-3 * cost] * len(texts)
    for t, y, a in zip(texts, sign, dual):
        w[t] += np.float32(y * a) * square[t]
    rng = np.random.default_rng(7)
    for _ in range(SWEEPS):
        moved = 0.0
        for i in rng.permutation(len(texts)).tolist():
            t, y, q, old = texts[i], sign[i], norms[i], dual[i]
            margin, x = y * float(w[t].sum(dtype=np.float64)), old
            for _ in range(50):
                step = (q * (x - old) + margin + math.log(x / (cost - x))) / (q + cost / (x * (cost - x)))
                new = min(max(x - step, x / 10, 1e-12 * cost), (x + 9 * cost) / 10, (1 - 1e-12) * cost)
                done, x = abs(new - x) < 1e-9 * cost, new
                if done:
                    break
            if abs(x - old) > 1e-7 * cost:
                dual[i] = x
                w[t] += np.float32((x - old) * y) * square[t]
                moved = max(moved, abs(x - old) / cost)
        if moved < STILL:
            break
    return w[:-1].copy(), float(w[-1])


def features(text: str | None) -> np.ndarray:
    """The distinct places of a text in order, and END, the intercept's."""
    return np.append(np.unique(places(text)).astype(np.int32), np.int32(END))


def _pack(found: np.ndarray) -> bytes:
    """Sorted places, as the steps between them."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.diff(found, prepend=0).astype(np.int32).tobytes())


class _Packed(Sequence):
    """Packed places of texts, unpacked one at a time: the sample's take the driver some tens of megabytes."""

    def __init__(self, rows: list[bytes]):
        import zstandard

        self.rows, self.decompress = rows, zstandard.ZstdDecompressor().decompress

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> np.ndarray:
        return np.cumsum(np.frombuffer(self.decompress(self.rows[i]), np.int32), dtype=np.int32)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = CHARS) -> Model:
    """labels: (doc_id, toxic), of the documents that may train only."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    flat = Model(np.zeros(1 << BITS, np.float32), float(np.log((toxic + 1e-9) / (clean + 1e-9))) if toxic + clean else -500.0)
    if not toxic or not clean:
        return flat
    below = lambda key, name, share: F.pmod(F.xxhash64(key, F.lit(name)), F.lit(1 << 30)) < share * (1 << 30)
    share = F.when(F.col("toxic") == 1, min(1.0, sample / toxic)).otherwise(min(1.0, sample / clean))
    chosen = known.filter(below("doc_id", "toxicity", share))  # about 2 * SAMPLE rows at most
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = stored(texts.select("toxic", "text", F.xxhash64("text").alias("h")).dropDuplicates(["toxic", "h"]))
    sizes = {r["toxic"]: r["chars"] or 1 for r in texts.groupBy("toxic").agg(F.sum(F.length("text")).alias("chars")).collect()}
    if len(sizes) < 2:
        return flat
    some = texts.filter(below("h", "characters", F.when(F.col("toxic") == 1, min(1.0, chars / sizes[1])).otherwise(min(1.0, chars / sizes[0]))))

    def packed(batches):
        for b in batches:
            out = [_pack(features(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["toxic", "features"])

    got = some.select("toxic", "text").transform(in_arrow, packed, "toxic int, features binary").toArrow()
    rows = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist()))  # reruns agree whatever the tasks' order
    del got
    y, each = np.array([k for k, _ in rows]), _Packed([x for _, x in rows])
    del rows
    if not 0 < y.sum() < len(y):
        return flat
    weights, intercept = fit(each, y)
    del each
    give_back()
    s1 = int(y.sum())
    return Model(weights, float(intercept + np.log(toxic / clean) - np.log(s1 / (len(y) - s1))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted)."""
    weights, intercept = model.weights, model.intercept  # 4 << BITS bytes

    def work(batches):
        own = Model(weights, intercept)
        for b in batches:
            s = np.array([own.score(t) for t in b.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).transform(in_arrow, work, "doc_id long, score double, predicted int")


def held_out(id_col: str = "doc_id"):
    return fold(F.col(id_col), FOLDS) == HELD


def train_on_folds(docs: DataFrame, labels: DataFrame, **options) -> Model:
    return train(docs, labels.select("doc_id", "toxic").filter(~held_out()), **options)


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, with all their columns, in one pass."""
    weights, intercept, place = model.weights, model.intercept, docs.columns.index(text_col)

    def work(batches):
        own = Model(weights, intercept)
        for b in batches:
            yield b.filter(pa.array([own.score(t) < threshold for t in b.column(place).to_pylist()], pa.bool_()))

    return docs.transform(in_arrow, work, docs.schema)
