"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame operations only.

An item's shingles are its distinct runs of SHINGLE words (an item of fewer words is one shingle). The containment of
an item in a document is the share of its shingles that the document has. Items are partitioned by the power of two
that bounds their number of shingles. A partition's signature length is one more than the shingles that an item of
its largest size may lack at the wanted containment, so an item's signature, its so many shingles that come first in an
order, has a shingle in every document that contains it: the search misses nothing, however long the document. The
order is by how many items have a shingle, then by a hash, so that a template that items share is in no signature if it
need not be. Pairs of a document and an item whose signature it meets are candidates, and the shingles that both have,
as text, are counted exactly for these pairs only.

Signatures and items' shingles are broadcast while they have at most BROADCAST rows, and joined by shuffle beyond.
Defined results: null or blank texts and items contain and are contained in nothing; rows of one id are judged
together as one document; rows without an id are told apart by their texts; an empty table gives no rows; extra columns,
whatever their names, are left out by contained() and kept by clean().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hornbeam.llm.common import ascii_lower, cut

SHINGLE, CONTAINED = 5, 0.8
#: Rows of at most about 100 bytes each.
BROADCAST = 200_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _places(words: Column, width: int) -> Column:
    """1 to the last place where a shingle begins; there is a place 1 even where there are too few words."""
    return F.sequence(F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(1)))


def _at_each(width: int, of: Callable[[Column, int], Column]) -> Column:
    """An array of what `of` makes of each run of so many words."""
    return F.transform(_places(F.col("words"), width), lambda i: of(F.slice("words", i, width), width))


def document_key(doc_id: Column, text: Column) -> Column:
    """The id, or what stands for a row without one."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8"))))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST else df


def item_shingles(items: DataFrame, share: float = CONTAINED) -> DataFrame:
    """(item_id, width, shingle, hash, n, probe): the distinct shingles of each item; probe: it is in the signature."""
    words = items.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    each = words.select("item_id", F.least(F.size("words"), F.lit(SHINGLE)).alias("width"), F.explode(F.transform(_places(F.col("words"), SHINGLE), lambda i: F.slice("words", i, SHINGLE))).alias("s"))
    each = each.select("item_id", "width", F.concat_ws(" ", "s").alias("shingle"), F.xxhash64(F.transform("s", lambda w: F.xxhash64(w))).alias("hash")).distinct()
    each = each.join(each.groupBy("width", "shingle").agg(F.count("*").alias("items")), ["width", "shingle"])
    own = Window.partitionBy("item_id")
    each = each.withColumn("n", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy("items", F.xxhash64("hash"), "hash", "width", "shingle")))
    largest = F.pow(F.lit(2.0), F.ceil(F.log2("n")))
    lacking = largest - F.ceil(largest * share - 1e-9)
    return each.select("item_id", "width", "shingle", "hash", "n", (F.col("place") <= lacking + 1).alias("probe"))


def _contained(docs: DataFrame, items: DataFrame, share: float) -> DataFrame:
    """contained() with of, the document's key."""
    shingles = cut(item_shingles(items, share))
    sizes = shingles.agg(F.count("*"), F.count_if("probe"), F.collect_set("width")).first()
    rows, probes, widths = sizes[0], sizes[1], sorted(sizes[2])
    text = docs["text"].cast("string")
    texts = docs.select(document_key(docs["doc_id"], text).alias("of"), docs["doc_id"], text.alias("text"))
    hashed = texts.select("of", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("words"))
    parts = [_at_each(k, lambda s, _: F.xxhash64(s)) for k in widths or [SHINGLE]]
    found = hashed.select("of", F.explode(F.concat(*parts)).alias("hash"))
    wanted = shingles.filter("probe").select("hash", "item_id").distinct()
    candidates = cut(found.join(_small(wanted, probes), "hash").select("of", "item_id").distinct())
    due = candidates.join(_small(shingles.select("item_id", "width", "shingle", "n"), rows), "item_id")
    of = candidates.select("of").distinct()
    some = texts.join(_small(of, candidates.count()), "of", "left_semi")
    split = some.select("of", "doc_id", words_of(F.col("text")).alias("words"))
    parts = [_at_each(k, lambda s, k: F.struct(F.lit(k).alias("width"), F.concat_ws(" ", s).alias("shingle"))) for k in widths or [SHINGLE]]
    each = split.filter(F.size("words") > 0).select("of", "doc_id", F.explode(F.concat(*parts)).alias("s")).select("of", "doc_id", "s.width", "s.shingle")
    known = each.join(_small(shingles.select("width", "shingle").distinct(), rows), ["width", "shingle"], "left_semi").distinct()
    counted = known.join(due, ["of", "width", "shingle"]).groupBy("of", "doc_id", "item_id", "n").agg(F.count("*").alias("matched"))
    sure = counted.withColumnRenamed("n", "n_shingles").withColumn("containment", F.col("matched") / F.col("n_shingles")).filter(F.col("containment") >= share)
    return sure.select("of", "doc_id", "item_id", "n_shingles", "matched", "containment")


def contained(docs: DataFrame, items: DataFrame, share: float = CONTAINED) -> DataFrame:
    """(doc_id, item_id, n_shingles, matched, containment) of every pair with at least that containment."""
    return _contained(docs, items, share).drop("of")


def clean(docs: DataFrame, items: DataFrame, share: float = CONTAINED) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    bad = cut(_contained(docs, items, share).select(F.col("of").alias("_of")).distinct())
    return docs.join(_small(bad, bad.count()), document_key(docs["doc_id"], docs["text"]) == F.col("_of"), "left_anti")


SQL = r"""
WITH iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM benchmark),
i AS (
  SELECT DISTINCT item_id, least(len(ws), 5) AS width, array_to_string(ws[k:k + 4], ' ') AS shingle
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS k FROM iw WHERE len(ws) > 0)),
n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id),
dw AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, ''))) AS k, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
d AS (
  SELECT DISTINCT k, doc_id, width, array_to_string(ws[p:p + width - 1], ' ') AS shingle
  FROM (SELECT k, doc_id, ws, width, unnest(range(1, greatest(len(ws) - width + 2, 2))) AS p FROM dw, (SELECT DISTINCT width FROM i) WHERE len(ws) > 0))
SELECT d.doc_id, i.item_id, n_shingles, count(*) AS matched, count(*)::DOUBLE / n_shingles AS containment
FROM d JOIN i USING (width, shingle) JOIN n ON n.item_id = i.item_id
GROUP BY d.k, d.doc_id, i.item_id, n_shingles HAVING count(*)::DOUBLE / n_shingles >= 0.8
"""
