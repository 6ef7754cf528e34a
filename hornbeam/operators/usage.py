"""API usage: counts, permissions, filters, and formulas over a package and all it depends on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornbeam.functions.formula import satisfied
from hornbeam.operators.graph import inherited


def api_key(base: Column, name: Column, func_only: bool = False) -> Column:
    """base.name, or name without a base; by function only: .name, or name."""
    some = F.coalesce(base, F.lit("")) != ""
    return F.when(some, F.concat(F.lit("."), name) if func_only else F.concat(base, F.lit("."), name)).otherwise(name)


def permission(catalogue: DataFrame) -> DataFrame:
    """(full_name, permission): a source's source type, a sink's or danger's sink type."""
    return catalogue.select("full_name", F.when(F.col("functionality") == "SOURCE", F.col("source_type")).otherwise(F.col("sink_type")).alias("permission")).distinct()


def _api(by_file: bool) -> Column:
    return F.concat_ws(":", "file", "full_name") if by_file else F.col("full_name")


def usage_packages(usage: DataFrame, by_file: bool = False) -> DataFrame:
    """(api, pkg): each API's packages, one row each, so that the most common API is no larger a row than any other;
    `analyzed` has every package."""
    used = usage.filter(F.col("full_name").isNotNull()).select(_api(by_file).alias("api"), "pkg")
    return used.union(usage.select(F.lit("analyzed"), "pkg")).distinct()


def usage_counts(usage: DataFrame, detail: bool = False, by_file: bool = False) -> DataFrame:
    """(api, n): rows of each API, or with detail its distinct packages; `analyzed` counts packages."""
    if detail:
        return usage_packages(usage, by_file).groupBy("api").agg(F.count("pkg").alias("n"))
    out = usage.filter(F.col("full_name").isNotNull()).groupBy(_api(by_file).alias("api")).agg(F.count("*").alias("n"))
    return out.unionByName(usage.agg(F.count_distinct("pkg").alias("n")).withColumn("api", F.lit("analyzed")))


def packages_using(packages: DataFrame, usage: DataFrame, catalogue: DataFrame, key: str = "pkg") -> DataFrame:
    """The packages with at least one API of the catalogue."""
    used = usage.join(catalogue.select("full_name").distinct(), "full_name", "left_semi").select(F.col("pkg").alias(key)).distinct()
    return packages.join(used, key, "left_semi")


def with_permissions(usage: DataFrame, catalogue: DataFrame) -> DataFrame:
    return usage.join(permission(catalogue), "full_name")


def permission_counts(usage: DataFrame, catalogue: DataFrame, *by: str) -> DataFrame:
    keys = by or ("pkg",)
    return with_permissions(usage, catalogue).groupBy(*keys, "permission").agg(F.count("*").alias("n"))


def api_ids(usage: DataFrame, catalogue: DataFrame, func_only: bool = False) -> DataFrame:
    """(pkg, id): catalogue ids of what each package uses; by function only, of all that share the function's name. The
    catalogue, a list of APIs, is broadcast, and never what packages use, however few bytes it is."""
    if not func_only:
        return usage.select("pkg", "full_name").distinct().join(F.broadcast(catalogue.select("full_name", "id")), "full_name").select("pkg", "id").distinct()
    last = lambda c: F.when(c.contains("."), F.concat(F.lit("."), F.element_at(F.split(c, "[.]"), -1))).otherwise(c)
    ours = usage.select("pkg", last(F.col("full_name")).alias("k")).distinct()
    return ours.join(F.broadcast(catalogue.select(last(F.col("full_name")).alias("k"), "id")), "k").select("pkg", "id").distinct()


def formula_verdicts(packages: DataFrame, usage: DataFrame, catalogue: DataFrame, formula: str, edges: DataFrame | None = None, func_only: bool = False) -> DataFrame:
    """(pkg, ids, satisfied): the formula over what each package and, with edges, all its dependencies use."""
    used = api_ids(usage, catalogue, func_only)
    if edges is not None:
        used = inherited(edges, used.select(F.col("pkg").alias("id"), F.col("id").alias("mark"))).select(F.col("id").alias("pkg"), F.col("mark").alias("id"))
    grouped = used.groupBy("pkg").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    none = F.array().cast(grouped.schema["ids"].dataType)
    return packages.select("pkg").distinct().join(grouped.hint("merge"), "pkg", "left").select("pkg", F.coalesce("ids", none).alias("ids")).withColumn("satisfied", satisfied(formula, F.col("ids")))


def best_match(findings: DataFrame, catalogue: DataFrame, name: str = "name") -> DataFrame:
    """findings with the catalogue's name: the same one, or else the longest that the finding's name contains, ties by
    name. Containment is looked up by the leading three characters of catalogue names, not by comparing all."""
    names = catalogue.select(F.col("full_name").alias("match")).filter(F.length("match") >= 1).distinct()
    width = 3
    starts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("n"), F.lit(1))), lambda i: F.col("n").substr(i, F.lit(width))))
    short = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.array(s, F.substring(s, 1, 2), F.substring(s, 1, 1)))))
    probe = findings.select(F.col(name).alias("n")).filter(F.length("n") > 0).distinct().select("n", F.explode(short).alias("k"))
    hits = probe.join(names.withColumn("k", F.substring("match", 1, width)), "k").filter(F.contains("n", "match"))
    best = hits.groupBy("n").agg(F.min_by("match", F.struct(-F.length("match"), F.col("match"))).alias("match"))
    return findings.join(best, F.col(name) == F.col("n"), "left").drop("n")


def last_match(findings: DataFrame, catalogue: DataFrame, name: str = "name") -> DataFrame:
    """findings with id and full_name of the last entry of the catalogue (id, full_name), by id, whose full name contains
    the finding's, brackets left out; null where none does, and for a name of brackets only. Names meet by their first
    three characters, which entries are looked up by at every place."""
    width = 3
    bare = findings.select(F.col(name).alias("_name"), F.translate(F.col(name), "([", "").alias("_bare")).filter("_bare <> ''").distinct()
    probe = bare.withColumn("_key", F.substring("_bare", 1, width))
    at = F.sequence(F.lit(1), F.greatest(F.length("full_name"), F.lit(1)))
    keys = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(*[F.col("full_name").substr(i, F.lit(k)) for k in range(1, width + 1)]))))
    entries = catalogue.select("id", "full_name").filter("full_name <> ''").distinct()
    wanted = entries.select("id", "full_name", F.explode(keys).alias("_key")).join(probe.select("_key").distinct(), "_key", "left_semi")
    hits = probe.join(wanted, "_key").filter(F.contains("full_name", "_bare"))
    last = hits.groupBy("_name").agg(F.max(F.struct("id", "full_name")).alias("m")).select("_name", "m.*")
    return findings.join(last, F.col(name) == F.col("_name"), "left").drop("_name")


def distinct_findings(findings: DataFrame, *keys: str) -> DataFrame:
    """Findings that differ in more than their volatile fields: one for each value of the keys, those columns only."""
    return findings.select(*keys).distinct()


def report_diff(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Findings with status `fixed` (only in the old report) or `new` (only in the new one)."""
    gone = old.join(new, list(keys), "left_anti").select(*keys).distinct().withColumn("status", F.lit("fixed"))
    return gone.unionByName(new.join(old, list(keys), "left_anti").select(*keys).distinct().withColumn("status", F.lit("new")))
