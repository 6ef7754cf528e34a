"""A bigram language model by deleted interpolation, trained and applied over all documents.

The probability of a token after its context is a mixture of the bigram's maximum-likelihood estimate, the word's, and
an add-one estimate that is never zero. The three weights depend on the bucket of the context's frequency (a power of
two) and are learned by expectation-maximisation on held-out counts: each training token is held out in turn, that
is, scored with its own occurrence deleted from the counts. EM needs only the ratios of the three estimates, so a
histogram of them (bounded: BUCKETS x steps of a quarter octave) over all training tokens is what the driver gets.

Counts go to where they are wanted and back, packed. A batch of documents (about BATCH bytes) lists its distinct words
and, for each, the distinct words that follow it, and sends each stretch of the words' hashes to one part. A part adds
up what all batches sent and answers each batch with the totals in the batch's own order; nothing is broadcast and
no table of words is ever held in one place. Words meet by 64-bit hash, followers of a word by 40 bits of theirs. Both
exchanges are pre-aggregated, so a very frequent word is one entry a batch.

Defined results: null and empty texts are the end token alone; a null id is not held out; repeated rows count and are
scored each; with no training tokens the base score is 0; an empty table gives an empty result; extra columns, whatever
their names, are left out. Two followers of one word whose 40 bits are the same count as one (one pair in 10^12).
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornbeam.llm.common import bounds, buckets, fold, in_arrow, runs, stored

FOLDS, HELD = 7, 2
BATCH = 8 << 20
END, START = b" end", b" start"  # no word has a space
BUCKETS, STEPS, FLOOR, ROUNDS = 48, 4, 1e-4, 60


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    # byte by byte of all numbers: like bytes pack better side by side
    raw = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if a.ndim == 1 and len(a) else a.tobytes() for a in arrays]
    return struct.pack(f"<I{len(raw)}Q", len(raw), *map(len, raw)) + zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def _unpack(data: bytes, *types: str) -> list[np.ndarray]:
    import zstandard

    n = struct.unpack_from("<I", data)[0]
    sizes = struct.unpack_from(f"<{n}Q", data, 4)
    raw, at, out = zstandard.ZstdDecompressor().decompress(data[4 + 8 * n :]), 0, []
    for s, t in zip(sizes, types):
        wide = np.dtype(t).itemsize
        planes = np.frombuffer(raw, np.uint8, s, at)
        out.append(np.ascontiguousarray(planes.reshape(wide, -1).T).reshape(-1).view(t) if wide > 1 and s else planes.view(t))
        at += s
    return out


def _bytes5(h: np.ndarray) -> np.ndarray:
    return h.view(np.uint8).reshape(-1, 8)[:, :5]


def _five(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = raw.reshape(-1, 5)
    return out.view(np.uint64)[:, 0]


def _pairs(tokens: np.ndarray, ends: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The batch's distinct (context, token) keys in order, and each token's place among them."""
    context = np.empty(len(tokens), np.int64)
    context[1:] = tokens[:-1]
    context[0] = start
    context[ends[:-1]] = start
    return np.unique(context << 32 | tokens, return_inverse=True)


def _request(parts: int):
    """Batches of documents -> rows (part, batch, kind, payload): kind 0 what is asked of a part, 1 the batch itself."""
    from pyspark import TaskContext

    def make(docs: list[tuple], n: int):
        from xxhash import xxh3_64_intdigest, xxh64

        index = {END: 0, START: 1}
        known, ids, sizes = index.setdefault, [], []
        for _, _, text in docs:
            found = [known(w, len(index)) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()]
            ids += found
            ids.append(0)
            sizes.append(len(found) + 1)
        hashes = np.array([xxh3_64_intdigest(w) for w in index], np.uint64)
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        hashes, tokens, ends = hashes[order], place[np.array(ids, np.int64)], np.cumsum(sizes)
        train = np.array([not held for _, held, _ in docs])
        every = np.repeat(train, sizes)
        keys, where = _pairs(tokens, ends, place[1])
        count = np.bincount(tokens[every], minlength=len(hashes)).astype(np.uint32)
        count[place[1]] = train.sum()  # as a context; it is no token
        after = np.bincount(where[every], minlength=len(keys)).astype(np.uint32)
        first, follower = keys >> 32, hashes[keys & 0xFFFFFFFF]
        many = np.bincount(first, minlength=len(hashes)).astype(np.uint32)
        part = ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        doc_ids = np.array([0 if i is None else i for i, _, _ in docs], np.int64)
        nulls = np.array([i is None for i, _, _ in docs])
        batch = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 20 | n
        mark = xxh64(doc_ids.tobytes() + tokens.tobytes()).intdigest()
        batch = (mark ^ batch * 0x9E3779B97F4A7C15) & 0x7FFFFFFFFFFFFFFF
        yield batch % parts, batch, 1, _pack(doc_ids, nulls, train, np.array(sizes, np.uint32), tokens.astype(np.uint32), np.array([place[0], place[1], len(hashes)], np.uint32))
        at = bounds(part)
        rows = np.searchsorted(first, at)
        for k in range(len(at) - 1):
            a, b, c, d = at[k], at[k + 1], rows[k], rows[k + 1]
            yield int(part[a]), batch, 0, _pack(np.diff(hashes[a:b], prepend=np.uint64(0)), count[a:b], many[a:b], _bytes5(follower[c:d]), after[c:d])

    def work(batches):
        held, size, n = [], 0, 0
        for b in batches:
            for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                held.append(row)
                size += len(row[2] or "") + 64
                if size >= BATCH:
                    yield _batch(make(held, n), "part", "batch", "kind", "payload")
                    held, size, n = [], 0, n + 1
        if held:
            yield _batch(make(held, n), "part", "batch", "kind", "payload")

    return work


KINDS = {"part": pa.int32(), "batch": pa.int64(), "kind": pa.int32(), "payload": pa.binary(), "n": pa.int64(), "v": pa.int64()}


def _batch(rows, *names: str) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, k in zip(cols, names)], list(names))


def _answer(batches):
    """Rows of whole parts -> answers (part, batch, kind 0), batches as they came (kind 1), totals (kind 2)."""
    from xxhash import xxh3_64_intdigest

    start = np.uint64(xxh3_64_intdigest(START))
    for t in runs(batches, ["part"]):
        part, kind = t.column("part").to_numpy(), t.column("kind").to_numpy()
        for a, b in zip(at := bounds(part), at[1:]):
            rows = [(t["batch"][int(k)].as_py(), t["payload"][int(k)].as_py()) for k in range(a, b) if kind[k] == 0]
            kept = [k for k in range(a, b) if kind[k] == 1]
            if kept:
                yield t.select(["part", "batch", "kind", "payload"]).take(kept).combine_chunks().to_batches()[0]
            if not rows:
                continue
            got = [_unpack(p, "u8", "u4", "u4", "u1", "u4") for _, p in rows]
            words, who = np.unique(np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got]), return_inverse=True)
            count = np.bincount(who, np.concatenate([g[1] for g in got]), len(words)).astype(np.uint64)
            context = np.repeat(who, np.concatenate([g[2] for g in got])).astype(np.uint64)
            follower = np.concatenate([_five(g[3]) for g in got])
            after = np.concatenate([g[4] for g in got])
            if len(words) < 1 << 24:
                _, pair = np.unique(context << np.uint64(40) | follower, return_inverse=True)
            else:
                _, pair = np.unique(np.stack([context, follower], 1), axis=0, return_inverse=True)
            total = np.bincount(pair, after).astype(np.uint64) if len(pair) else np.zeros(0, np.uint64)
            out, i, j = [], 0, 0
            for (batch, _), g in zip(rows, got):
                n, m = len(g[0]), len(g[4])
                out.append((int(part[a]), batch, 0, _pack(count[who[i : i + n]], total[pair[j : j + m]])))
                i, j = i + n, j + m
            real = count[words != start]
            out.append((int(part[a]), -1 - int(part[a]), 2, struct.pack("<2q", int(real.sum()), int(np.count_nonzero(real)))))
            yield _batch(out, "part", "batch", "kind", "payload")


def _assemble(batches):
    """Rows of whole batches -> one row a batch (kind 1, payload and answers together), and the totals (kind 2)."""
    for t in runs(batches, ["batch"]):
        batch, kind = t.column("batch").to_numpy(), t.column("kind").to_numpy()
        for a, b in zip(at := bounds(batch), at[1:]):
            rows = [t["payload"][int(k)].as_py() for k in range(a, b)]
            if kind[a] == 2:
                yield _batch([(2, p, *struct.unpack("<2q", p)) for p in rows], "kind", "payload", "n", "v")
                continue
            got = [_unpack(p, "u8", "u8") for p, k in zip(rows, kind[a:b]) if k == 0]
            own = [p for p, k in zip(rows, kind[a:b]) if k == 1]
            answers = _pack(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
            yield _batch([(1, struct.pack("<Q", len(own[0])) + own[0] + answers, 0, 0)], "kind", "payload", "n", "v")


class Counts:
    """A batch with what it needs: for each token the counts of itself, its context and both together."""

    def __init__(self, payload: bytes):
        n = struct.unpack_from("<Q", payload)[0]
        ids, nulls, self.train, sizes, tokens, marks = _unpack(payload[8 : 8 + n], "i8", "?", "?", "u4", "u4", "u4")
        words, pairs = _unpack(payload[8 + n :], "u8", "u8")
        self.ids = [None if z else i for i, z in zip(ids.tolist(), nulls)]
        self.sizes, self.starts = sizes.astype(np.int64), np.cumsum(sizes.astype(np.int64)) - sizes
        tokens = tokens.astype(np.int64)
        keys, where = _pairs(tokens, np.cumsum(self.sizes), int(marks[1]))
        self.own, self.both = words[tokens].astype(np.float64), pairs[where].astype(np.float64)
        self.context = words[keys >> 32][where].astype(np.float64)


def _estimates(own, context, both, n: float, v: float):
    base = (own + 1) / (n + (v + 1))
    return np.divide(both, context, out=np.zeros_like(both), where=context > 0), own / n if n > 0 else np.zeros_like(own), base


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.minimum(np.floor(np.log2(np.maximum(context, 1))) + 1, BUCKETS - 1), 0).astype(np.int64)


def _step(ratio: np.ndarray) -> np.ndarray:
    """0 for none, else a quarter octave; 128 and more octaves are out of reach of 64-bit counts."""
    return np.where(ratio > 0, np.clip(np.round(np.log2(np.maximum(ratio, 1e-30)) * STEPS), -255, 255) + 256, 0).astype(np.int64)


def learn(cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(BUCKETS, 3) weights by EM from the histogram; a cell is bucket, step of bigram and step of word over base."""
    bucket, two, one = cells >> 18, cells >> 9 & 511, cells & 511
    value = lambda s: np.where(s > 0, 2.0 ** ((s - 256) / STEPS), 0.0)
    ratios = np.stack([value(two), value(one), np.ones(len(cells))], 1)
    weights = np.full((BUCKETS, 3), 1 / 3)
    for b in range(BUCKETS):
        r, c = ratios[bucket == b], counts[bucket == b].astype(np.float64)
        if len(c):
            for _ in range(ROUNDS):
                share = r * weights[b]
                share /= share.sum(1, keepdims=True)
                weights[b] = c @ share / c.sum()
        if b == 0:
            weights[b, 0] = 0
        weights[b] = np.maximum(weights[b], [0 if b == 0 else FLOOR, FLOOR, FLOOR])
        weights[b] /= weights[b].sum()
    return weights


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row a document as in SCORES; docs: doc_id, text, held_out. parts: as many as shuffles have partitions, so a
    part's share of all distinct pairs is what a task holds. docs should come from a table or a checkpoint, so that a
    task that runs again after a lost executor makes the same batches."""
    spark = docs.sparkSession
    parts = parts or buckets(spark)
    kinds = "part int, batch long, kind int, payload binary"
    asked = docs.select(F.col("doc_id").cast("long"), F.col("held_out"), F.col("text").cast("string")).transform(in_arrow, _request(parts), kinds)
    answered = asked.repartition(parts, "part").sortWithinPartitions("part").transform(in_arrow, _answer, kinds)
    whole = answered.repartition(parts, "batch").sortWithinPartitions("batch", "kind", "part").transform(in_arrow, _assemble, "kind int, payload binary, n long, v long")
    kept = stored(whole)
    totals = kept.filter("kind = 2").agg(F.sum("n"), F.sum("v")).first()
    n, v = totals[0] or 0, totals[1] or 0
    batches = kept.filter("kind = 1").select("payload")

    def histogram(rows):
        total: dict[int, int] = {}
        for b in rows:
            for p in b.column(0):
                c = Counts(p.as_py())
                t = np.repeat(c.train, c.sizes)
                own, context, both = c.own[t] - 1, c.context[t] - 1, c.both[t] - 1
                two, one, base = _estimates(own, context, both, n - 1, v)
                cell = _bucket(context) << 18 | _step(two / base) << 9 | _step(one / base)
                for k, m in zip(*(x.tolist() for x in np.unique(cell, return_counts=True))):
                    total[k] = total.get(k, 0) + m
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["cell", "n"])

    cells = batches.transform(in_arrow, histogram, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").collect()
    weights = learn(np.array([r["cell"] for r in cells], np.int64), np.array([r["n"] for r in cells], np.int64))

    def work(rows):
        for b in rows:
            for p in b.column(0):
                c = Counts(p.as_py())
                two, one, base = _estimates(c.own, c.context, c.both, n, v)
                w = weights[_bucket(c.context)]
                mixed = np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] * base)
                add = lambda x: np.add.reduceat(x, c.starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.ids, pa.int64()), pa.array(~c.train), pa.array(c.sizes), pa.array(add((c.own > 0).astype(np.int64))), pa.array(np.full(len(c.ids), n, np.int64)), pa.array(add(np.log10(base))), pa.array(add(mixed))],
                    [x.split()[0] for x in SCORES.split(", ")],
                )

    return batches.transform(in_arrow, work, SCORES)


def score_folds(docs: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out")))
