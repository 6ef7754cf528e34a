"""Name similarity joins: edit distance and containment, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornbeam.functions.names import as_bytes, edit_distance
from hornbeam.functions.storage import cut, spread


def _segment(length: Column, k: int, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and length of the k-th of so many even parts."""
    start = F.floor(length * k / parts).cast("int")
    return start, F.floor(length * (k + 1) / parts).cast("int") - start


#: A key that so many names share is split by a second one.
HOT = 1000
#: Two keys that so many names share are followed by a third.
SECOND = 100


def _own_keys(x: Column, parts: int) -> Column:
    """A name's segments: what they are looked up by (length of the name, number, text) and where they stand."""
    keys, n = [], F.length(x)
    for k in range(parts):
        start, size = _segment(n, k, parts)
        keys.append(F.struct(F.struct(n.alias("len"), F.lit(k).alias("part"), x.substr(start + 1, size).alias("text")).alias("key"), start.alias("at"), size.alias("size")))
    return F.array(*keys)


def _near_keys(y: Column, parts: int) -> Column:
    """The segments that a name within parts - 1 edits of y can have unchanged, as they are found in y."""
    keys, m, limit = [], F.length(y), parts - 1
    for change in range(-limit, limit + 1):
        n = m + change
        for k in range(parts):
            start, size = _segment(n, k, parts)
            for shift in range(-limit, limit + 1):
                at = start + shift
                fits = (n >= 0) & (at >= 0) & (at + size <= m)
                key = F.struct(n.alias("len"), F.lit(k).alias("part"), y.substr(at + 1, size).alias("text"))
                keys.append(F.when(fits, F.struct(key.alias("key"), at.alias("at"), size.alias("size"))))
    return F.array_distinct(F.filter(F.array(*keys), lambda x: x.isNotNull()))


def _rest(x: str) -> Column:
    """A name without the segment of its key."""
    c = F.col(x)
    return F.concat(c.substr(F.lit(1), F.col("at")), c.substr(F.col("at") + F.col("size") + 1, F.length(c)))


def _shortened(x: Column, limit: int) -> Column:
    """A name without none, and up to so many, of its characters. Names within the limit have one of these in common."""
    found = F.array(x)
    for _ in range(limit):
        found = F.array_distinct(F.flatten(F.transform(found, lambda v: F.transform(F.sequence(F.lit(0), F.length(v)), lambda i: F.concat(v.substr(F.lit(1), i - 1), v.substr(i + 1, F.length(v)))))))
    return found


def edit_distance_pairs(left: DataFrame, right: DataFrame | None = None, name: str = "name", limit: int = 2, metric: str = "bytes", include_self: bool = False) -> DataFrame:
    """(a, b, distance) of distinct names within the limit; without `right`, unordered pairs a < b of `left`.

    A name is cut into limit + 1 even segments; one that is within the limit must have one of them unchanged, shifted
    by the limit at most. Both sides become (length, segment number, text) keys for one equi-join, so the work follows
    the number of near names, not the square of all. Names that share a frequent segment, as those of one scope do, meet
    only if what is left of them shares a segment too: it is within the limit as well. Where both segments are frequent,
    as in numbered names, they meet, up to a limit of 2, by what is left without so many of its characters: what shares
    that is within twice the limit, so no key is frequent. A limit of 0 keeps every pair that shares its only key: equal
    ones."""
    plain = as_bytes if metric != "chars" else (lambda c: c)
    parts = limit + 1
    ours = left.select(F.col(name).alias("a")).filter(F.col(name).isNotNull()).distinct().transform(spread).withColumn("x", plain(F.col("a")))
    theirs = (left if right is None else right).select(F.col(name).alias("b")).filter(F.col(name).isNotNull()).distinct().transform(spread).withColumn("y", plain(F.col("b")))
    one = ours.select("a", "x", F.explode(_own_keys(F.col("x"), parts)).alias("k")).select("a", "x", "k.*")
    two = theirs.select("b", "y", F.explode(_near_keys(F.col("y"), parts)).alias("k")).select("b", "y", "k.*")
    hot = one.groupBy("key").count().filter(F.col("count") > HOT).select("key")
    if limit == 0 or hot.isEmpty():
        found = one.select("a", "key").join(two.select("b", "key"), "key")
    else:
        hot = cut(hot)
        found = one.join(hot, "key", "left_anti").select("a", "key").join(two.select("b", "key").hint("merge"), "key").select("a", "b")
        step = lambda df, who, x, keys: spread(df.join(hot, "key", "left_semi").select(who, "key", _rest(x).alias(x)).distinct()).select(who, "key", x, F.explode(keys(F.col(x), parts)).alias("k")).select(who, F.struct("key", F.col("k.key").alias("second")).alias("key"), x, "k.at", "k.size")
        far, near = cut(step(one, "a", "x", _own_keys)), step(two, "b", "y", _near_keys)
        hot = far.groupBy("key").count().filter(F.col("count") > SECOND).select("key")
        if limit <= 2 and not (hot := cut(hot)).isEmpty():
            near = cut(near.join(far.select("key").distinct().hint("merge"), "key", "left_semi"))
            last = lambda df, who, x: spread(df.join(hot, "key", "left_semi").select(who, "key", _rest(x).alias(x)).distinct()).select(who, "key", F.explode(_shortened(F.col(x), limit)).alias("left"))
            found = found.unionByName(last(far, "a", "x").join(last(near, "b", "y").hint("merge"), ["key", "left"]).select("a", "b"))
            far = far.join(hot, "key", "left_anti")
        found = found.unionByName(far.select("a", "key").join(near.select("b", "key").hint("merge"), "key").select("a", "b"))
    if right is None:
        found = found.filter(F.col("a") <= F.col("b") if include_self else F.col("a") < F.col("b"))
    found = spread(found.select("a", "b"), "a").distinct()
    measure = "chars" if metric == "chars" else "bytes"
    near = found.withColumn("distance", edit_distance(F.col("a"), F.col("b"), measure, limit)).filter(F.col("distance") >= 0)
    return near if metric != "normalized" else near.withColumn("distance", edit_distance(F.col("a"), F.col("b"), "normalized"))


def near_in_groups(names: DataFrame, group: str, key: str, name: str, limit: int = 2) -> DataFrame:
    """(a, b, distance) of rows (group, key, name) of one group with names within the limit by bytes, both ways, each row
    with itself. Names meet by what is left of them without up to so many bytes, so the work follows the rows and the near
    pairs, and not the square of a group; a name of n bytes has some n ** limit of these."""
    x = as_bytes(F.col(name))
    rows = spread(names.select(F.col(group).alias("g"), F.col(key).alias("k"), x.alias("x")).filter("g IS NOT NULL AND x IS NOT NULL"))
    short = cut(rows.select("g", "k", "x", F.explode(_shortened(F.col("x"), limit)).alias("left")).select("g", "k", "x", F.xxhash64("left").alias("h")))
    side = lambda k, x: short.select("g", "h", F.col("k").alias(k), F.col("x").alias(x))
    met = side("a", "x").join(side("b", "y").hint("merge"), ["g", "h"]).withColumn("distance", F.levenshtein("x", "y", limit))
    return met.filter(F.col("distance").between(0, limit)).select("a", "b", "distance").distinct()


#: How much of a name is compared where its leading run is frequent.
WIDE = 24


def combo_squats(names: DataFrame, name: str = "name", longer_than: int = 5) -> DataFrame:
    """(first, second): first is a proper part of second, both longer than so many characters. First's leading
    characters are looked up among the runs of as many characters of all names; where very many names begin alike, as
    those of one scope do, up to WIDE of them, or the whole name, are."""
    width = longer_than + 1
    n = names.select(F.col(name).alias("first")).filter(F.length("first") > longer_than).distinct().withColumn("gram", F.substring("first", 1, width))
    at = F.sequence(F.lit(1), F.length("second") - longer_than)
    grams = F.array_distinct(F.transform(at, lambda i: F.col("second").substr(i, F.lit(width))))
    wide = n.select(F.col("first").alias("second")).select("second", F.explode(grams).alias("gram"))
    hot = n.groupBy("gram").count().filter(F.col("count") > HOT).select("gram")
    if hot.isEmpty():
        found = n.join(wide, "gram")
    else:
        hot = cut(hot)
        cold = n.join(hot, "gram", "left_anti").join(wide, "gram").select("first", "second")
        places = n.select(F.col("first").alias("second")).select("second", F.explode(at).alias("at")).withColumn("gram", F.col("second").substr(F.col("at"), F.lit(width))).join(hot, "gram", "left_semi")
        sizes = F.sequence(F.lit(width), F.least(F.lit(WIDE), F.length("second") - F.col("at") + 1))
        runs = places.select("second", F.explode(F.transform(sizes, lambda k: F.col("second").substr(F.col("at"), k))).alias("run")).distinct()
        begun = n.join(hot, "gram", "left_semi").withColumn("run", F.substring("first", 1, WIDE))
        found = cold.unionByName(begun.join(runs, "run").select("first", "second"))
    return found.filter((F.col("first") != F.col("second")) & F.contains("second", "first")).select("first", "second")
