"""Authors: e-mail addresses by registry, totals, and who stands out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornbeam.functions.names import EMAIL, emails


def author_emails(cell, language: str):
    """Distinct addresses in an author cell (a literal of nested dicts). Registries that keep addresses in `email`
    fields count those only; the others any address in the text."""
    if language in ("ruby", "php", "java"):
        field = r"['\"]email['\"]:\s*u?['\"](" + EMAIL + r")['\"]"
        return F.array_distinct(F.regexp_extract_all(cell, F.lit(field), F.lit(1)))
    return emails(cell)


def author_edges(packages: DataFrame) -> DataFrame:
    """(email, pkg) from packages (source, name, emails): packages are source:name."""
    return packages.select(F.explode("emails").alias("email"), F.concat_ws(":", "source", "name").alias("pkg")).distinct()


def author_stats(facts: DataFrame, languages: list[str]) -> DataFrame:
    """(email, packages, downloads, uses, and each per language) from (email, language, downloads, uses)."""
    out = [F.count("*").alias("packages"), F.sum("downloads").alias("downloads"), F.sum("uses").alias("uses")]
    for x in languages:
        here = F.col("language") == x
        out += [F.count_if(here).alias(f"{x}_packages"), F.sum(F.when(here, F.col("downloads")).otherwise(0)).alias(f"{x}_downloads"), F.sum(F.when(here, F.col("uses")).otherwise(0)).alias(f"{x}_uses")]
    return facts.groupBy("email").agg(*out)


def in_all_languages(facts: DataFrame, email: str = "email", language: str = "language") -> DataFrame:
    total = facts.agg(F.count_distinct(language).alias("all"))
    return facts.groupBy(email).agg(F.count_distinct(language).alias("n")).join(F.broadcast(total), F.col("n") == F.col("all")).select(email)


def top_union(stats: DataFrame, key: str, measures: list[str], n: int = 200) -> DataFrame:
    """The rows that are among the first n by any of the measures, ties by key."""
    best = None
    for m in measures:
        part = stats.orderBy(F.col(m).desc_nulls_last(), key).limit(n).select(key)
        best = part if best is None else best.union(part)
    return stats.join(best.distinct(), key, "left_semi")


def author_packages(packages: DataFrame) -> DataFrame:
    """(author, pkg): the same as rows, so that an author of very many packages is no larger a row than any other."""
    own = packages.filter(F.col("author").isNotNull() & F.col("pkg").isNotNull()).select("author", "pkg").distinct()
    return own.join(own.groupBy("author").count().filter("count > 1").select("author"), "author", "left_semi")


def same_author(packages: DataFrame) -> DataFrame:
    """(author, packages): names of packages that share an author, for authors of more than one; a null author is none."""
    return packages.filter(F.col("author").isNotNull()).groupBy("author").agg(F.array_sort(F.collect_set("pkg")).alias("packages")).filter(F.size("packages") > 1)
