"""Content: hashes compared across registries and versions, and searches in files and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common_packages(tables: list[DataFrame], key: str = "pkg") -> DataFrame:
    out = tables[0].select(key)
    for t in tables[1:]:
        out = out.intersect(t.select(key))
    return out.distinct()


def common_versions(hashes: DataFrame) -> DataFrame:
    """(pkg, version) that every source of a package has, from (source, pkg, version); packages of one source are left out."""
    rows = hashes.select("source", "pkg", "version").distinct()
    sources = rows.groupBy("pkg").agg(F.count_distinct("source").alias("sources")).filter("sources > 1")
    return rows.groupBy("pkg", "version").agg(F.count("*").alias("having")).join(sources, "pkg").filter("having = sources").select("pkg", "version")


def hash_mismatches(hashes: DataFrame) -> DataFrame:
    """(pkg, version, sources, hashes) from (source, pkg, version, hash): at least two sources, and not one hash."""
    found = hashes.filter(F.col("hash").isNotNull()).groupBy("pkg", "version").agg(F.count_distinct("source").alias("sources"), F.count_distinct("hash").alias("hashes"))
    return found.filter("sources >= 2 AND hashes > 1")


def content_hashes(files: DataFrame) -> DataFrame:
    """(pkg, version, path, sha1) of (pkg, version, path, content)."""
    return files.select("pkg", "version", "path", F.sha1("content").alias("sha1"))


def content_differences(one: DataFrame, two: DataFrame) -> DataFrame:
    """(path, left_sha1, right_sha1) where a path is on one side only or its content differs."""
    both = one.select("path", F.col("sha1").alias("left_sha1")).join(two.select("path", F.col("sha1").alias("right_sha1")), "path", "full_outer")
    return both.filter(~F.col("left_sha1").eqNullSafe(F.col("right_sha1")))


def api_differences(one: DataFrame, two: DataFrame) -> DataFrame:
    """(key, left_n, right_n) where counts of an API differ, absent as 0."""
    both = one.select("key", F.col("n").alias("left_n")).join(two.select("key", F.col("n").alias("right_n")), "key", "full_outer").fillna(0, ["left_n", "right_n"])
    return both.filter("left_n <> right_n")


def duplicates(files: DataFrame, content: str = "content") -> DataFrame:
    """(sha1, n): contents that occur more than once."""
    return files.groupBy(F.sha1(F.col(content)).alias("sha1")).agg(F.count("*").alias("n")).filter("n > 1")


def version_hash(files: DataFrame, extensions: tuple[str, ...] = ("jar", "aar", "war")) -> DataFrame:
    """(pkg, version, hash): that of the first extension that a version has a file of."""
    by = [F.max(F.when(F.col("extension") == e, F.col("hash"))) for e in extensions]
    return files.groupBy("pkg", "version").agg(F.coalesce(*by).alias("hash")).filter("hash IS NOT NULL")


def grep(files: DataFrame, pattern: str, key: str = "pkg", text: str = "content") -> DataFrame:
    """(key, lines): the lines that match, in order, of each text that has one; texts are prefiltered whole."""
    lines = F.filter(F.split(F.col(text), "\r?\n"), lambda x: x.rlike(pattern))
    return files.filter(F.col(text).rlike(f"(?m){pattern}")).select(key, lines.alias("lines")).filter(F.size("lines") > 0)


def anchors(pages: DataFrame, anchor: str, key: str, html: str = "html") -> DataFrame:
    return pages.filter(F.contains(F.col(html), F.lit(anchor))).select(key)


def snapshot_diff(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the new snapshot whose keys the old one has not."""
    return new.join(old.select(*keys).distinct(), keys, "left_anti")


def without_noise(lines: DataFrame, patterns: list[str], column: str = "value") -> DataFrame:
    """Lines that none of the patterns fits, tested together."""
    return lines.filter(~F.coalesce(F.col(column).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))) if patterns else lines
