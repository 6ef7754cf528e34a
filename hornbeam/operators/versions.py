"""Versions of a package: choosing some, comparing what they use, and what stands out among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hornbeam.functions.names import ends_with_any, is_plain_version, time_bucket, version_array
from hornbeam.functions.storage import sized

#: APIs and permissions of interest (fixed values).
INTEREST = {
    "python": ["eval", "exec", "base64.b64decode"],
    "ruby": ["eval", "exec", "builtin_xstring", "Base64.urlsafe_decode64"],
    "javascript": ["eval", "child_process.exec", "child_process.execFileSync", "Base64.decode", "Buffer.from", "Buffer"],
    "php": ["eval", "exec", "shell_exec", "base64_decode"],
    "java": ["java.net.URLClassLoader.loadClass", "javax.script.ScriptEngine.eval", "java.lang.System.loadLibrary", "java.lang.Runtime.exec", "java.util.Base64.Decoder.decode"],
}
PERMISSIONS = ["OBFUSCATION", "CODE_GENERATION", "PROCESS_OPERATION", "NETWORK"]


def thin(versions: DataFrame, most: int = 15, gap_days: int = 30) -> DataFrame:
    """(pkg, version, ts): at most `most` versions of a package. Packages with no more keep all; of the others only
    plain versions count, the highest in each gap of time before the latest, latest first. most <= 0: all plain ones."""
    own = Window.partitionBy("pkg")
    v = versions.select("pkg", "version", "ts").withColumn("n", F.count("*").over(own)).withColumn("plain", F.coalesce(is_plain_version(F.col("version")), F.lit(False)))
    few = (F.col("n") <= most) if most > 0 else F.lit(False)
    v = v.filter(few | F.col("plain"))
    if most <= 0:
        return v.select("pkg", "version", "ts")
    v = v.withColumn("p", F.count("*").over(own)).withColumn("bucket", time_bucket(F.max("ts").over(own), F.col("ts"), gap_days))
    v = v.withColumn("in_bucket", F.row_number().over(Window.partitionBy("pkg", "bucket").orderBy(version_array(F.col("version")).desc(), F.col("version").desc())))
    v = v.withColumn("all", few | (F.col("p") <= most)).filter(F.col("all") | (F.col("in_bucket") == 1))
    v = v.withColumn("place", F.row_number().over(Window.partitionBy("pkg").orderBy(F.when(F.col("all"), F.lit(0)).otherwise(F.col("bucket")), F.col("ts").desc(), F.col("version").desc())))
    return v.filter(F.col("all") | (F.col("place") <= most)).select("pkg", "version", "ts")


def highest(versions: DataFrame, most: int) -> DataFrame:
    """The first so many versions of each package by number, for packages without times."""
    place = F.row_number().over(Window.partitionBy("pkg").orderBy(version_array(F.col("version")).desc(), F.col("version").desc()))
    return versions.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def latest_times(distributions: DataFrame) -> DataFrame:
    """(pkg, version, ts) with the last upload of each version's distributions."""
    return distributions.groupBy("pkg", "version").agg(F.max("ts").alias("ts"))


def latest_release(releases: DataFrame, value: str = "require") -> DataFrame:
    """(pkg, value) of the release with the latest time; releases without a time do not count."""
    return releases.filter(F.col("ts").isNotNull()).groupBy("pkg").agg(F.max_by(value, F.struct("ts", "version")).alias(value))


def latest_stable(versions: DataFrame) -> DataFrame:
    """(pkg, version): the highest normalized version that starts with a digit and is no branch; else the highest of all."""
    stable = F.col("normalized").rlike(r"^\d") & ~F.col("normalized").startswith("9999999")
    place = F.row_number().over(Window.partitionBy("pkg").orderBy(F.when(stable, 0).otherwise(1), version_array(F.col("normalized")).desc(), F.col("version").desc()))
    return versions.withColumn("place", place).filter("place = 1").select("pkg", "version")


def out_of_turn(versions: DataFrame) -> DataFrame:
    """(pkg, version, ts): versions that are younger than both neighbours in the order of version numbers."""
    order = Window.partitionBy("pkg").orderBy(version_array(F.col("version")).desc(), F.col("version").desc())
    v = versions.withColumn("above", F.lag("ts").over(order)).withColumn("below", F.lead("ts").over(order))
    return v.filter((F.col("above") < F.col("ts")) & (F.col("ts") > F.col("below"))).select("pkg", "version", "ts")


def compare(items: DataFrame, scope: str = "package", rows: int | None = None) -> DataFrame:
    """(pkg, version, key, n, is_common, is_unique) from (pkg, version, key): how often each version has a key;
    common: all versions of the package have it; unique: it is not common in the scope, package or global (all packages).
    rows: about how many items there are, which tasks are cut by."""
    items = sized(items, rows, "pkg", "key")
    counts = items.groupBy("pkg", "version", "key").agg(F.count("*").alias("n"))
    totals = items.groupBy("pkg").agg(F.count_distinct("version").alias("versions"))
    having = counts.groupBy("pkg", "key").agg(F.count("*").alias("having"))
    own = having.join(totals, "pkg").select("pkg", "key", (F.col("having") == F.col("versions")).alias("is_common"))
    out = counts.join(own, ["pkg", "key"])
    if scope == "package":
        return out.withColumn("is_unique", ~F.col("is_common"))
    every = items.select("pkg", "version").distinct().agg(F.count("*").alias("all"))
    shared = counts.groupBy("key").agg(F.count("*").alias("m")).crossJoin(F.broadcast(every)).select("key", (F.col("m") == F.col("all")).alias("global"))
    return out.join(shared, "key").withColumn("is_unique", ~F.col("global")).drop("global")


def common_keys(items: DataFrame, rows: int | None = None) -> DataFrame:
    return compare(items, rows=rows).filter("is_common").select("pkg", "key").distinct()


def interesting(items: DataFrame, versions: DataFrame, apis: list[str], as_of: str, days: int = 730) -> DataFrame:
    """(pkg, bad_versions, versions): packages with an API of interest in some versions but not all, of which one is
    younger than `days` before as_of, and fewer than half of all versions (pkg, version, ts) have one."""
    bad = compare(items).filter(F.col("is_unique") & F.col("key").isin(apis)).select("pkg", "version").distinct().withColumn("bad", F.lit(True))
    marked = versions.join(bad, ["pkg", "version"], "left")
    recent = F.col("bad") & (F.col("ts") > F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    return marked.groupBy("pkg").agg(F.count_if("bad").alias("bad_versions"), F.count("*").alias("versions"), F.max(F.coalesce(recent, F.lit(False))).alias("recent")).filter(F.col("recent") & (F.col("bad_versions") * 2 < F.col("versions"))).drop("recent")


def with_sensitive_permissions(rows: DataFrame, permissions: DataFrame, suffixes: list[str] = PERMISSIONS) -> DataFrame:
    """The rows whose package has a permission with one of the endings."""
    return rows.join(permissions.filter(ends_with_any(F.col("permission"), suffixes)).select("pkg").distinct(), "pkg", "left_semi")


def correlate(differences: DataFrame, usage: DataFrame, versions: DataFrame, blocked: list[str] = [], only_out_of_turn: bool = False, rows: int | None = None) -> DataFrame:  # noqa: B006
    """(pkg, version, key, calls): files and sources of calls to a version's unique APIs, from differences (pkg, version,
    key, is_unique), where the version is known and no blocked text is in the path; optionally of packages with a version out of turn. rows:
    about how many rows usage has."""
    unique = differences.filter("is_unique").select("pkg", "version", "key").join(versions.select("pkg", "version"), ["pkg", "version"], "left_semi")
    bad = F.lit(False)
    for text in blocked:
        bad = bad | F.contains("file", F.lit(text))
    calls = usage.filter(~bad).select("pkg", "version", F.col("full_name").alias("key"), F.struct("file", "source").alias("call"))
    found = unique.join(sized(calls, rows, "pkg", "version", "key"), ["pkg", "version", "key"]).groupBy("pkg", "version", "key").agg(F.array_sort(F.collect_list("call")).alias("calls"))
    if only_out_of_turn:
        odd = out_of_turn(versions).join(found.select("pkg", "version").distinct(), ["pkg", "version"], "left_semi").select("pkg").distinct()
        found = found.join(odd, "pkg", "left_semi")
    return found
