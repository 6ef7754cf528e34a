"""Cutting lineage in loops with reliable checkpoints in the folder that the cluster shares, and bounded Arrow batches."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own,
    and any other raises: executors would write where the others cannot read."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="hornbeam-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all shuffle partitions, by the keys if there are any: for few bytes that make many rows, or much work, in
    the next step, which adaptive execution would put into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Rows of a task where a step sorts or groups all rows of a large table.
TASK_ROWS = 500_000


def sized(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """df dealt by the keys into as many partitions as so many rows need, so that what a task holds does not grow with the
    table; into no fewer than all shuffle partitions. As it is where rows is None."""
    if rows is None:
        return df
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    return df.repartition(n, *keys)


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each value of the key, of batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        value = b.column(key)
        cuts = np.flatnonzero(np.diff(value.to_numpy())) + 1
        for k, (at, end) in enumerate(zip([0, *cuts], [*cuts, len(value)])):
            if held and (k or held[-1].column(key)[-1] != value[at]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(at, end - at))
    if held:
        yield pa.Table.from_batches(held)


class Parts:
    """Rows that a loop adds round by round: each round's are stored once, and read with all others until MOST parts
    have come together, which then become one."""

    MOST = 16

    def __init__(self, first: DataFrame):
        self.parts = [cut(first)]

    def add(self, df: DataFrame) -> DataFrame:
        """The rows, stored."""
        if len(self.parts) >= self.MOST:
            self.parts = [cut(self.all())]
        self.parts.append(cut(df))
        return self.parts[-1]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)


#: Rows and bytes of a batch on its way to Python and back.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def in_arrow(df: DataFrame, work: Callable, schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow in batches of bounded size: whole files and archives travel in them. The sizes are settings of the
    session; they are lowered and never raised."""
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(name).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df.mapInArrow(work, schema)
