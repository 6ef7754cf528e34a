"""A table of results that many writers add to: lists of one key grow together, however often a writer runs.

Writers only add: each batch of a writer is a folder of its own, named by the writer and the batch, so that running it
again replaces it and two writers never touch the same file. Reading merges by key. Compacting writes all that is there
as a new base, which names the batches it holds; a base is complete or is not seen, and the newest complete one counts, so
that readers and writers may go on meanwhile, and of two compactions at a time either result is right.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z0-9._-]+")


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a path that a writer has finished; batches and bases, not rows."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(place):
        return []
    found = [s.getPath() for s in store.listStatus(place) if s.isDirectory()]
    return sorted(p.getName() for p in found if store.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


class MergedTable:
    """keys: columns of a key; lists: array columns, which are united; other columns take their largest value."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], lists: list[str]):
        self.spark, self.path, self.schema, self.keys, self.lists = spark, path.rstrip("/"), schema, keys, lists

    def merged(self, rows: DataFrame) -> DataFrame:
        """One row a key."""
        united = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in self.lists]
        rest = [c for c in rows.columns if c not in self.keys and c not in self.lists]
        return rows.groupBy(*self.keys).agg(*united, *[F.max(c).alias(c) for c in rest]).select(*rows.columns)

    def add(self, rows: DataFrame, writer: str, batch: str | int) -> None:
        """Adds a writer's batch; the same batch again takes its own place."""
        name = f"{writer}@{batch}"
        if not _NAME.fullmatch(writer) or not _NAME.fullmatch(str(batch)):
            raise ValueError(f"{name} is no name of a folder")
        columns = self._empty().columns
        self.merged(rows.select(*columns)).write.mode("overwrite").parquet(f"{self.path}/added/{name}")

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def _base(self) -> tuple[str | None, list[str]]:
        """The newest base and the batches it holds."""
        bases = _folders(self.spark, f"{self.path}/holds")
        if not bases:
            return None, []
        return bases[-1], [r.value for r in self.spark.read.text(f"{self.path}/holds/{bases[-1]}").collect()]

    def _parts(self) -> tuple[str | None, list[str], list[str]]:
        base, held = self._base()
        return base, held, [b for b in _folders(self.spark, f"{self.path}/added") if b not in set(held)]

    def read(self) -> DataFrame:
        base, _, new = self._parts()
        parts = ([f"{self.path}/base/{base}"] if base else []) + [f"{self.path}/added/{b}" for b in new]
        if not parts:
            return self._empty()
        return self.merged(reduce(DataFrame.unionByName, [self.spark.read.schema(self.schema).parquet(p) for p in parts[:1]] + ([self.spark.read.schema(self.schema).parquet(*parts[1:])] if parts[1:] else [])))

    def compact(self) -> None:
        """All that is there becomes a base. A batch that is run again afterwards must say the same as before."""
        base, held, new = self._parts()
        if not new:
            return
        number = int(base.split("-")[0]) + 1 if base else 1
        name = f"{number:09}-{uuid.uuid4().hex}"
        self.read().write.parquet(f"{self.path}/base/{name}")
        # written last: a base counts from here on
        self.spark.createDataFrame([(b,) for b in [*held, *new]], "value string").coalesce(1).write.text(f"{self.path}/holds/{name}")
