"""Writers: lists, documents and tables. Appending replaces the read-change-write of result files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_documents(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object a row."""
    df.write.mode(mode).json(path)


def as_mapping(df: DataFrame, key: str, value: str, most: int = 1_000_000) -> DataFrame:
    """(json): one document {key: value} of a small table, keys in order; a table of over `most` rows raises, since one
    document is one row. write_documents() has no such bound."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows do not go into one document")
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col(value).alias("value"))))
    return df.agg(F.to_json(F.map_from_entries(pairs)).alias("json"))


def append_results(df: DataFrame, path: str, by: str = "language") -> None:
    """Adds results to a partitioned table; several writers at a time do no harm."""
    df.write.mode("append").partitionBy(by).parquet(path)


def without_done(df: DataFrame, spark_path: str, keys: list[str]) -> DataFrame:
    """Rows whose keys the table of results has not yet."""
    return df.join(df.sparkSession.read.parquet(spark_path).select(*keys).distinct(), keys, "left_anti")


def write_graph(edges: DataFrame, path: str, mode: str = "error") -> None:
    edges.write.mode(mode).parquet(path)


def pairs_from_matrix(wide: DataFrame, name: str) -> DataFrame:
    """(source, target, distance) of the cells of a distance matrix that are filled."""
    others = [c for c in wide.columns if c != name]
    return wide.unpivot([name], others, "target", "distance").filter("distance IS NOT NULL").withColumnRenamed(name, "source")
