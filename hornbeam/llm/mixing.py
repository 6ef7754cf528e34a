"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each document draws an exponential key: minus the logarithm of a uniform number made from md5(seed, id), divided by
the document's quality weight, so that better documents tend to come first. A source's target is spent on complete
epochs first; what is left takes documents in order of their keys while the prefix sum of sizes stays within it (the
document at the border counts if at least half of it fits). The prefix sum has two levels, so that no source, however
large, is sorted in one task: keys fall into KEY_BUCKETS ranges, the ranges' sums are added up, and only the documents
of the one range that holds the border are sorted.

Defined results: null text has size 0 and is never taken; a null source is a source of its own, ranked last; a null
weight counts as 1; repeated rows are separate documents with equal keys; an empty table gives an empty result; extra
columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hornbeam.llm.common import WORD, cut

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
OCTAVE, LAST_RANGE = 512, 1 << 30
#: Tables of sources up to this many rows (under 10 MB) are broadcast; beyond it the join is dealt by source and salt.
BROADCAST_SOURCES, SALTS = 100_000, 32
#: Sampling weights of documents by label: quality 1, quality 0, unlabelled.
GOOD, POOR, UNKNOWN = 2.0, 0.5, 1.0


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(doc_id: Column, weight: Column, seed: str) -> Column:
    digits = F.substring(F.md5(F.encode(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(""))), "UTF-8")), 1, 13)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    known = F.when(weight.isNull() | F.isnan(weight), F.lit(UNKNOWN)).otherwise(weight.cast("double"))
    return F.when(known > 0, -F.log(uniform) / F.nullif(known, F.lit(0.0))).otherwise(F.lit(float("inf")))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size). Weights repeat over sources by code point, null last.

    Targets are min(most * size, level * weight) with the one level that spends share * all sizes: the limit of
    resharing what is above a limit by weight. One row a source goes through one task."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    nth = (F.row_number().over(by_name) - 1) % len(weights) + 1
    s = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), nth))
    s = s.withColumn("limit", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("limit") / F.col("weight"))
    everything, so_far = Window.partitionBy(), Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
    spent = F.sum("limit").over(so_far) + F.col("ratio") * (F.sum("weight").over(everything) - F.sum("weight").over(so_far))
    s = s.withColumn("capped", spent < F.col("budget"))
    left = F.col("budget") - F.sum(F.when(F.col("capped"), F.col("limit")).otherwise(0.0)).over(everything)
    level = left / F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything)
    return s.withColumn("level", level).select("source", "source_size", F.when(F.col("capped"), F.col("limit")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("limit"))).cast("double").alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix") -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) from (doc_id, source, size, weight); weight: sampling weight."""
    base = cut(
        docs.select("doc_id", "source", "size", key_of(F.col("doc_id"), F.col("weight").cast("double"), seed).alias("key"))
        .withColumn("bucket", F.when(F.col("key") < float("inf"), F.floor(F.log2("key") * OCTAVE).cast("int")).otherwise(LAST_RANGE))
    )
    sums = cut(base.groupBy("source", "bucket").agg(F.sum("size").alias("sum")))
    goal = targets(sums.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("epochs", whole).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    upto = F.sum("sum").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    edges = sums.withColumn("before", upto - F.col("sum")).withColumnRenamed("source", "of")
    border = goal.join(edges, F.col("source").eqNullSafe(F.col("of")) & (F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("sum")), "left")
    border = cut(border.select(F.col("source").alias("of"), "source_size", "target", "epochs", "rest", F.coalesce("bucket", F.when(F.col("rest") > 0, LAST_RANGE + 1).otherwise(-LAST_RANGE)).alias("edge"), F.coalesce("before", F.lit(0)).alias("before")))
    same = F.col("source").eqNullSafe(F.col("of"))
    if border.count() <= BROADCAST_SOURCES:
        joined = base.join(F.broadcast(border), same)
    else:
        salted = border.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = base.join(salted, same & (F.pmod("bucket", F.lit(SALTS)) == F.col("salt"))).drop("salt")
    sure = joined.filter(F.col("bucket") != F.col("edge")).withColumn("extra", (F.col("bucket") < F.col("edge")).cast("long"))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    prefix = F.col("before") + F.sum("size").over(order) - F.col("size")
    near = joined.filter(F.col("bucket") == F.col("edge")).withColumn("extra", (prefix + F.col("size") / 2 <= F.col("rest")).cast("long"))
    return sure.unionByName(near).select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("extra"))).alias("taken"), "source")


def mix_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """mix() of a documents table, weighted by its quality labels (the best one where a document has several)."""
    quality = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"))
    weight = F.when(F.col("quality") == 1, GOOD).when(F.col("quality") == 0, POOR).otherwise(UNKNOWN)
    return mix(sized.join(quality, "doc_id", "left").withColumn("weight", weight), **options)


SQL = r"""
WITH graded AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
base AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5('mix|' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / CASE WHEN quality = 1 THEN 2.0 WHEN quality = 0 THEN 0.5 ELSE 1.0 END AS key
  FROM documents d LEFT JOIN graded g ON d.doc_id = g.doc_id),
sizes AS (
  SELECT source, sum(size)::DOUBLE AS s, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM base GROUP BY source),
weighed AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM sizes),
spent AS (
  SELECT *, sum(2 * s) OVER o + 2 * s / w * (sum(w) OVER () - sum(w) OVER o) < 1.5 * sum(s) OVER () AS capped,
    1.5 * sum(s) OVER () AS budget
  FROM weighed WINDOW o AS (ORDER BY 2 * s / w, rank ROWS UNBOUNDED PRECEDING)),
levels AS (
  SELECT *, (budget - sum(CASE WHEN capped THEN 2 * s ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS level FROM spent),
goals AS (SELECT source, s, CASE WHEN capped THEN 2 * s ELSE least(level * w, 2 * s) END AS target FROM levels),
ordered AS (
  SELECT b.*, s, target, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY b.source ORDER BY key, b.doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM base b JOIN goals g ON b.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, s::BIGINT AS source_size, target,
  (size * (epochs + CASE WHEN before + size / 2.0 <= target - epochs * s THEN 1 ELSE 0 END))::BIGINT AS taken, source
FROM ordered
"""
