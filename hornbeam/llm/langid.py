"""Language identification by a small byte convolutional network, trained and applied in numpy.

A text's UTF-8 bytes are cut into windows of WINDOW bytes that overlap by the widest filter less one, the last one
filled with zeros, so that every byte of every text is seen. Each byte has a learned vector of EMBED numbers; filters
of the widths in WIDTHS slide over a window, each keeps its largest response (max pooling) after a rectifier, and a
softmax gives a share for each language. A text's shares are the mean over its windows, weighted by their bytes.

Training takes a bounded sample: about SAMPLE documents in all, as many of each language, chosen by a hash of ids and
texts, with all windows of each. Null and empty texts and texts without letters are `und` with score 0; languages that
are null never train; without any training row everything is `und`; equal shares go to the first language by code point.
Repeated rows and null ids each give their own row; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornbeam.llm.common import fold, in_arrow

WINDOW, EMBED, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 16
WIDE = max(WIDTHS)
SAMPLE, EPOCHS, BATCH, RATE, SEED = 2400, 8, 64, 0.004, 7
FOLDS, HELD = 4, 2
UNKNOWN = "und"


def windows(raw: bytes) -> np.ndarray:
    """(windows, WINDOW) bytes that cover raw."""
    step = WINDOW - WIDE + 1
    n = max(1, -(-(len(raw) - WIDE + 1) // step))
    x = np.frombuffer(raw + bytes(max(0, (n - 1) * step + WINDOW - len(raw))), np.uint8)
    return np.lib.stride_tricks.as_strided(x, (n, WINDOW), (step, 1))


@dataclass
class Network:
    """embed (256, EMBED); filters (WIDE * EMBED, all filters), narrow ones zero at their end; a dense layer."""

    names: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    out: np.ndarray

    def pooled(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Patches (windows, places, WIDE * EMBED) and the filters' responses at every place."""
        n, places = len(w), WINDOW - WIDE + 1
        e = self.embed[w].reshape(n, WINDOW * EMBED)
        s = e.strides
        patches = np.lib.stride_tricks.as_strided(e, (n, places, WIDE * EMBED), (s[0], EMBED * s[1], s[1]))
        patches = np.ascontiguousarray(patches).reshape(n * places, WIDE * EMBED)
        return patches, (patches @ self.filters).reshape(n, places, -1)

    def shares(self, w: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(w)[1].max(1) + self.bias, 0) @ self.dense + self.out
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def gradients(net: Network, w: np.ndarray, target: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy of windows w with the languages target, by the network's parts; mask: what of the
    filters is not zero for good."""
    n, many = len(w), net.filters.shape[1]
    patches, r = net.pooled(w)
    top = r.argmax(1)  # (n, filters): where each filter responds most
    best = np.take_along_axis(r, top[:, None], 1)[:, 0] + net.bias
    hidden = np.maximum(best, 0)
    z = hidden @ net.dense + net.out
    z = np.exp(z - z.max(1, keepdims=True))
    d = z / z.sum(1, keepdims=True)
    d[np.arange(n), target] -= 1
    d /= n
    g = {"dense": hidden.T @ d, "out": d.sum(0)}
    back = (d @ net.dense.T) * (best > 0)
    at_top = patches.reshape(n, -1, WIDE * EMBED)[np.arange(n)[:, None], top]  # (n, filters, WIDE * EMBED)
    g["filters"] = np.einsum("nf,nfk->kf", back, at_top) * mask
    g["bias"] = back.sum(0)
    down = (back[:, :, None] * net.filters.T[None]).reshape(n, many, WIDE, EMBED)
    where = w[np.arange(n)[:, None, None], top[:, :, None] + np.arange(WIDE)]
    g["embed"] = np.stack([np.bincount(where.ravel(), down[..., k].ravel(), 256) for k in range(EMBED)], 1)
    return g


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> Network:
    """Adam over shuffled batches of windows x with language indexes y."""
    rng = np.random.default_rng(SEED)
    many = FILTERS * len(WIDTHS)
    mask = np.zeros((WIDE * EMBED, many), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[: width * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
    f32 = lambda a: a.astype(np.float32)
    net = Network(names, f32(rng.normal(0, 1, (256, EMBED))), f32(rng.normal(0, 0.2, mask.shape)) * mask, np.zeros(many, np.float32), f32(rng.normal(0, 0.2, (many, len(names)))), np.zeros(len(names), np.float32))
    parts = ("embed", "filters", "bias", "dense", "out")
    first, second = ({p: np.zeros_like(getattr(net, p)) for p in parts} for _ in range(2))
    t = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            w, target = x[order[at : at + BATCH]], y[order[at : at + BATCH]]
            g = gradients(net, w, target, mask)
            t += 1
            for p in parts:
                first[p] = 0.9 * first[p] + 0.1 * g[p]
                second[p] = 0.999 * second[p] + 0.001 * g[p] ** 2
                step = RATE * (first[p] / (1 - 0.9**t)) / (np.sqrt(second[p] / (1 - 0.999**t)) + 1e-8)
                setattr(net, p, f32(getattr(net, p) - step))
    return net


def train(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """docs: (doc_id, text, lang), of the documents that may train only."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    names = sorted(counts)
    each = max(1, sample // len(names))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("language")), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for k in names for x in (k, min(1.0, each / counts[k]))])
    chosen = known.filter(draw <= F.element_at(share, F.col("lang")) * (1 << 30)).select("lang", F.col("text").cast("string"))

    def cut_windows(batches):
        for b in batches:
            out, of = [], []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                if raw and any(map(str.isalpha, text)):
                    w = windows(raw)
                    out += [x.tobytes() for x in w]
                    of += [lang] * len(w)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(out, pa.binary())], ["lang", "window"])

    got = sorted(map(tuple, chosen.transform(in_arrow, cut_windows, "lang string, window binary").collect()))
    if not got:
        return None
    x = np.frombuffer(b"".join(w for _, w in got), np.uint8).reshape(-1, WINDOW)
    names = sorted({k for k, _ in got})
    index = {k: i for i, k in enumerate(names)}
    return fit(x, np.array([index[k] for k, _ in got]), names)


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", block: int = 96) -> DataFrame:
    """(doc_id, lang_pred, score); block: windows computed at a time."""

    def shares(texts: list[str | None]):
        """Mean shares of each text, windows of many texts computed together; None without letters."""
        queue, owner, waiting = [], [], 0
        sums, sizes = {}, {}

        def flush() -> None:
            nonlocal queue, owner, waiting
            if queue:
                w, who = np.concatenate(queue), np.concatenate(owner)
                for at in range(0, len(w), block):
                    part, ids = w[at : at + block], who[at : at + block]
                    heavy = np.count_nonzero(part, axis=1)[:, None]
                    got = net.shares(part) * heavy
                    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                    for i, g, h in zip(ids[starts], np.add.reduceat(got, starts), np.add.reduceat(heavy[:, 0], starts)):
                        sums[i] = sums.get(i, 0) + g
                        sizes[i] = sizes.get(i, 0) + h
            queue, owner, waiting = [], [], 0

        for i, t in enumerate(texts):
            if net is not None and t and any(map(str.isalpha, t)):
                w = windows(t.encode("utf-8", "surrogatepass"))
                queue.append(w)
                owner.append(np.full(len(w), i))
                waiting += len(w)
                if waiting >= 8 * block:
                    flush()
        flush()
        return [sums[i] / sizes[i] if sizes.get(i) else None for i in range(len(texts))]

    def work(batches):
        for b in batches:
            got = shares(b.column(1).to_pylist())
            best = [None if s is None else int(s.argmax()) for s in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([UNKNOWN if k is None else net.names[k] for k in best], pa.string()), pa.array([0.0 if k is None else min(1.0, float(s[k])) for s, k in zip(got, best)], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).transform(in_arrow, work, "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    return fold(F.col(id_col), FOLDS) == HELD


def train_on_folds(docs: DataFrame, **options) -> Network | None:
    return train(docs.select("doc_id", "text", "lang").filter(~held_out()), **options)
