"""Dependency graphs of a registry in three kinds, written and chosen by kind: all packages, what popular ones need, and the
same between versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.operators.graph import closure
from hornbeam.sources.metadata import versioned_edges

#: (popular, versions) -> kind. Versions of all packages are not kept.
KINDS = {(False, False): "overall", (True, False): "popular", (True, True): "popular_versions"}


def kinds(dependencies: DataFrame, popular: DataFrame) -> DataFrame:
    """(kind, src, dst) of all kinds. dependencies (src, src_version, dst, dst_version); popular (id): packages that count
    as popular; with them comes all that they depend on."""
    known = dependencies.filter("src IS NOT NULL AND dst IS NOT NULL")
    plain = known.select("src", "dst").distinct()
    wanted = closure(plain, popular).select(F.col("dst").alias("src")).union(popular.select(F.col("id").alias("src"))).distinct()
    some = known.join(wanted, "src", "left_semi")  # what a package needs is wanted as well
    parts = {"overall": plain, "popular": some.select("src", "dst").distinct(), "popular_versions": versioned_edges(some)}
    out = None
    for kind, edges in parts.items():
        one = edges.select(F.lit(kind).alias("kind"), "src", "dst")
        out = one if out is None else out.unionByName(one)
    return out


def write(graphs: DataFrame, path: str, mode: str = "error") -> None:
    """A folder for each kind, so that loading one reads no other."""
    graphs.write.mode(mode).partitionBy("kind").parquet(path)


def load(spark: SparkSession, path: str, popular: bool = False, versions: bool = False) -> DataFrame:
    """(src, dst) of one kind."""
    if (popular, versions) not in KINDS:
        raise ValueError("there are no versions of all packages, only of popular ones")
    return spark.read.schema("src string, dst string, kind string").parquet(path).filter(F.col("kind") == KINDS[popular, versions]).select("src", "dst")
