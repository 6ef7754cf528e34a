"""Importance resampling towards a target distribution: documents whose n-grams are like the target's are drawn more often.

Features are runs of 1 to LONGEST words, hashed into BUCKETS by crc32. A bucket's gain is the logarithm of how much more
frequent it is in the target than in the documents, in thousandths, rounded down; a document's weight is the sum of the
gains of its features, and its score adds a Gumbel number made of a hash of its id, so that taking the highest scores is
drawing without replacement by weight.

Features are never spelled out: a worker has the checksum of each distinct word, and those of word sequences follow by
array arithmetic, since the crc of two texts in a row is that of the first moved on by the length of the second, a linear
map that four table lookups make, combined with that of the second. Counts of buckets are added up in each task before
they are shuffled. The highest scores are not sorted: a histogram of the scores, which are whole numbers, is a table of its
own, cut into BINS ranges whose totals (BINS at most) go to the driver; suffix sums in each range say how many documents
have higher scores, the cutoff score follows, and only the rows that reach it are numbered by id, within each score and
block of ids, so that no task has more rows than a block has ids.

Defined results: null and blank texts have no features and weight 0; documents under the least number of words are scored
and never drawn; a null id counts as the empty text in the hash and as the last of its score; rows of one id and score are
numbered in any order; an empty table gives an empty result; an empty target gives the gains that the formula says; extra
columns are left out.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hornbeam.llm.common import cut, in_arrow, stored

BUCKETS, LONGEST, SEED, LEAST_WORDS, PERCENT = 10_000, 3, "42", 20, 5
#: Ranges of scores; ids of a block.
BINS, BLOCK = 1024, 1 << 20
#: The bytes of words in lower case: digits, a-z and whatever is beyond ASCII.
_WORD, _GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
#: Words a worker remembers, bytes of a text that are cut into words at a time, words whose features are made at a time.
REMEMBERED, CHUNK, TOGETHER = 500_000, 1 << 20, 1 << 17
#: Lengths with a table of their own.
SHORT = 64


def _tables() -> np.ndarray:
    """[n, k, v]: what byte k with value v of a crc becomes when n bytes follow."""
    v = np.arange(256, dtype=np.uint32)
    one = v.copy()
    for _ in range(8):
        one = (one >> np.uint32(1)) ^ np.where(one & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    out = np.zeros((SHORT + 1, 4, 256), np.uint32)
    out[0] = v << (np.arange(4, dtype=np.uint32)[:, None] * np.uint32(8))
    for n in range(SHORT):
        out[n + 1] = (out[n] >> np.uint32(8)) ^ one[out[n] & np.uint32(255)]
    return out


TABLES = _tables()


def moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """crc (without what follows) of texts that n bytes follow."""
    crc = crc.copy()
    while True:
        step = np.minimum(n, SHORT)
        crc = TABLES[step, 0, crc & 255] ^ TABLES[step, 1, crc >> 8 & 255] ^ TABLES[step, 2, crc >> 16 & 255] ^ TABLES[step, 3, crc >> 24]
        n = n - step
        if not n.any():
            return crc


class Features:
    """Buckets of texts' features; what a worker remembers of words is bounded."""

    def __init__(self, buckets: int = BUCKETS, longest: int = LONGEST):
        self.buckets, self.longest = buckets, longest
        self.forget()

    def forget(self) -> None:
        self.seen: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        self.alone, self.after, self.length = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The words of texts, by number, side by side, and how many each text has."""
        if len(self.seen) > REMEMBERED:
            self.forget()
        seen, old, out, sizes = self.seen, len(self.seen), [], []
        for text in texts:
            raw, at, n = (text or "").encode("utf-8", "surrogatepass").lower(), 0, 0
            while at < len(raw):
                m = _GAP.search(raw, at + CHUNK) if len(raw) - at > CHUNK else None
                end = m.start() if m else len(raw)
                found = _WORD.findall(raw, at, end)
                out.append(np.fromiter(map(seen.__getitem__, found), np.int32, len(found)))
                n += len(found)
                at = end
            sizes.append(n)
        if new := list(itertools.islice(seen, old, None)):
            self.alone = np.concatenate((self.alone, np.array([zlib.crc32(w) for w in new], np.uint32)))
            self.after = np.concatenate((self.after, np.array([zlib.crc32(b" " + w) for w in new], np.uint32)))
            self.length = np.concatenate((self.length, np.array([len(w) + 1 for w in new], np.int64)))
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.array(sizes, np.int64)

    def of(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, bucket) of all features of texts, those that begin at TOGETHER words at a time; text: its place."""
        number, sizes = self.words(texts)
        text = np.repeat(np.arange(len(sizes)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(number))  # words from here to the end of the text
        for at in range(0, len(number), TOGETHER):
            k = number[at : at + TOGETHER + self.longest - 1]
            n = min(len(k), TOGETHER)
            crc = self.alone[k]
            yield text[at : at + n], crc[:n] % np.uint32(self.buckets)
            for more in range(1, self.longest):
                next_ = k[more:]
                crc = moved(crc[: len(next_)], self.length[next_]) ^ self.after[next_]
                inside = np.flatnonzero(left[at : at + min(n, len(next_))] > more)
                yield text[at + inside], crc[inside] % np.uint32(self.buckets)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, text_col: str = "text") -> np.ndarray:
    """How many features of all texts are in each bucket."""

    def work(batches):
        own, total = Features(buckets, longest), np.zeros(buckets, np.int64)
        for b in batches:
            for _, some in own.of(b.column(0).to_pylist()):
                total += np.bincount(some, minlength=buckets)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total[k])], ["bucket", "n"])

    counted = docs.select(docs[text_col].cast("string")).transform(in_arrow, work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():  # as many rows as buckets
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over that in the source, both with one more in each bucket."""
    m, s_all, t_all = float(len(source)), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + m) / ((s + 1.0) * (t_all + m)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every whole text."""

    def work(batches):
        own = Features(len(gain), longest)
        for b in batches:
            texts = b.column(1).to_pylist()
            weight, sizes = np.zeros(len(texts), np.int64), np.zeros((longest, len(texts)), np.int64)
            for k, (text, some) in enumerate(own.of(texts)):
                sizes[k % longest] += np.bincount(text, minlength=len(texts))
                weight += np.bincount(text, gain[some], len(texts)).astype(np.int64)  # whole numbers far below 2**53
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes[0]), pa.array(sizes.sum(0)), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).transform(in_arrow, work, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """floor(1000 times) a Gumbel number made of a hash of the id."""
    digits = F.substring(F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), "UTF-8"), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(uniform))).cast("long")


def ranked(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, bins: int = BINS, block: int = BLOCK) -> DataFrame:
    """scored (doc_id, n_words, score, ...; read several times, so stored) with rank: 1, 2, 3... for the percent of the
    documents of least_words or more that have the highest scores, ties to the smaller id; null for others."""
    able = F.col("n_words") >= least_words
    none = scored.withColumn("rank", F.lit(None).cast("long"))
    histogram = cut(scored.filter(able).groupBy("score").agg(F.count("*").alias("n")))
    low, high, n = histogram.agg(F.min("score"), F.max("score"), F.sum("n")).first()
    wanted = (n or 0) * percent // 100
    if not wanted:
        return none
    width = -(-(high - low + 1) // bins)
    binned = histogram.withColumn("bin", F.floor((F.lit(high) - F.col("score")) / width).cast("int"))
    totals = sorted((r.bin, r.n) for r in binned.groupBy("bin").agg(F.sum("n").alias("n")).collect())  # bins + 1 at most
    above = dict(zip((b for b, _ in totals), itertools.accumulate((k for _, k in totals), initial=0)))
    reached = {b: a for b, a in above.items() if a < wanted}
    starts = F.create_map(*[F.lit(x) for pair in reached.items() for x in pair])
    upto = F.sum("n").over(Window.partitionBy("bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0))
    offsets = binned.filter(F.col("bin") <= max(reached)).withColumn("higher", starts[F.col("bin")] + upto - F.col("n"))
    offsets = cut(offsets.filter(F.col("higher") < wanted).select("score", "higher"))
    cutoff = offsets.agg(F.min("score")).first()[0]
    drawn = able & (F.col("score") >= cutoff)
    mine = scored.filter(drawn).withColumn("block", F.coalesce(F.floor(F.col("doc_id") / block), F.lit(np.iinfo(np.int64).max)))
    blocks = mine.groupBy("score", "block").agg(F.count("*").alias("n")).join(offsets, "score")
    so_far = F.sum("n").over(Window.partitionBy("score").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    blocks = blocks.select("score", "block", (F.col("higher") + so_far - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("score", "block").orderBy(F.col("doc_id").asc_nulls_last()))
    rank = (F.col("before") + nth).cast("long")
    chosen = mine.join(blocks, ["score", "block"]).withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return chosen.select(*none.columns).unionByName(none.filter(~drawn))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, seed: str = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document, drawn towards the texts of target."""
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    scored = stored(weighed(docs, gain, longest).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    return ranked(scored, least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH RECURSIVE bits(v, k, c) AS (
  SELECT v, 0, v FROM range(256) AS t(v)
  UNION ALL SELECT v, k + 1, xor(c >> 1, (c & 1) * 3988292384) FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY v) AS t FROM bits WHERE k = 8),
texts AS (
  SELECT 0 AS kind, doc_id AS id, row_number() OVER () AS r, text FROM documents
  UNION ALL SELECT 1, item_id, row_number() OVER (), text FROM benchmark),
cut AS (
  SELECT kind, id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (
  SELECT kind, r, f, count(*) AS n
  FROM (SELECT kind, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM cut)
  GROUP BY kind, r, f),
spelled AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)),
hashed AS (
  SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM spelled, crc),
counted AS (SELECT kind, r, bucket, sum(n) AS n FROM features JOIN hashed USING (f) GROUP BY kind, r, bucket),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 1), 0)::DOUBLE AS t FROM counted GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM sums),
weights AS (SELECT r, sum(n * gain) AS weight FROM counted JOIN gains USING (bucket) WHERE kind = 0 GROUP BY r),
scored AS (
  SELECT id AS doc_id, c.r, len(w) AS n_words, len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM cut c LEFT JOIN weights USING (r) WHERE kind = 0),
drawn AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS many FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= 5 * many // 100 THEN rank END AS rank FROM scored LEFT JOIN drawn USING (r)
"""
