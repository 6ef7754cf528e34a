"""Popularity: download cells, thresholds, top packages, samples and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hornbeam.functions.names import draw


def downloads_of(stats: Column, field: str | None = None) -> Column:
    """A count from a map of download statistics: the field, which must be overall or last_month, else the first of both."""
    if field is None:
        return F.coalesce(F.try_element_at(stats, F.lit("overall")), F.try_element_at(stats, F.lit("last_month")))
    if field not in ("overall", "last_month"):
        raise ValueError("downloads are counted overall or for last_month")
    return F.try_element_at(stats, F.lit(field))


def select_managers(counts: DataFrame, date: str, threshold: float) -> DataFrame:
    """(manager, n) from a wide table with a column for each manager: its last day that is not blank, if at the threshold."""
    managers = [c for c in counts.columns if c != date]
    long = counts.unpivot([date], managers, "manager", "n").filter(F.col("n").isNotNull())
    return long.groupBy("manager").agg(F.max_by("n", date).alias("n")).filter(F.col("n") >= threshold)


def select_packages(packages: DataFrame, measure: str, key: str, top: int | None = None, threshold: float | None = None) -> DataFrame:
    """The first `top` by the measure, ties by key, then those at the threshold; null counts come last."""
    out = packages
    if top is not None:
        out = out.orderBy(F.col(measure).desc_nulls_last(), key).limit(top)
    return out if threshold is None else out.filter(F.col(measure) >= threshold)


def sample_packages(packages: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows drawn by a hash of key and seed: the same ones in every run."""
    return packages.orderBy(draw(F.col(key), seed), key).limit(n)


def slices(nodes: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Every row with its slice 0 to n - 1: even in expectation, without a global order."""
    return nodes.withColumn("slice", (draw(F.col(key), seed) % n).cast("int"))


def even_slices(nodes: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The same with sizes that differ by one at most; the order is global, so for small tables only."""
    return nodes.withColumn("slice", F.ntile(n).over(Window.orderBy(draw(F.col(key), seed), key)) - 1)


def near_pairs(pairs: DataFrame, most: int = 3) -> DataFrame:
    """Pairs of a distance table off its diagonal, up to the distance."""
    return pairs.filter((F.col("a") != F.col("b")) & (F.col("distance") <= most))
