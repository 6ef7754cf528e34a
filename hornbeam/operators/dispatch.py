"""One call for the statistics of any kind of result: data type -> operator over its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornbeam.operators import authors, behavior, flows, graph, usage


def _counted(rows: DataFrame, name: str) -> DataFrame:
    """(key, packages), with the key `analyzed` for all packages of the table."""
    found = rows.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("key")).agg(F.count_distinct("pkg").alias("packages"))
    return found.unionByName(rows.agg(F.count_distinct("pkg").alias("packages")).withColumn("key", F.lit("analyzed")))


#: Data type -> statistics of (its rows, a second table where it takes one).
STATISTICS: dict[str, Callable[..., DataFrame]] = {
    "api": lambda rows, _=None: usage.usage_counts(rows, detail=True).select(F.col("api").alias("key"), F.col("n").alias("packages")),
    "permission": lambda rows, catalogue: _counted(usage.with_permissions(rows, catalogue), "permission"),
    "dynamic": lambda rows, _=None: behavior.value_counts(rows, most=None).select(F.concat_ws(":", "kind", "value").alias("key"), "packages"),
    "taint": lambda rows, _=None: flows.flow_packages(rows).select(F.col("flow").alias("key"), "packages").unionByName(rows.agg(F.count_distinct("pkg").alias("packages")).withColumn("key", F.lit("analyzed"))),
    "dependency": lambda rows, _=None: graph.ancestors(rows).groupBy(F.col("src").alias("key")).agg(F.count("*").alias("packages")),
    "author": lambda rows, _=None: authors.author_edges(rows).groupBy(F.col("email").alias("key")).agg(F.count("*").alias("packages")),
}


def statistics(data_type: str, rows: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """(key, packages) of results of a type; an unknown type raises. Some types take a second table (permission: the
    catalogue)."""
    if data_type not in STATISTICS:
        raise ValueError(f"no statistics of {data_type!r}; there are {', '.join(sorted(STATISTICS))}")
    return STATISTICS[data_type](rows, other)
