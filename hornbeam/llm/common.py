"""What the corpus operators share: reading tables, folds, cutting lineage and streaming over sorted rows."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id is in fold -1, which no rule names."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % parts, F.lit(-1))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def is_local(master: str) -> bool:
    """One process with its threads, not local-cluster."""
    return re.fullmatch(r"local(\[.*\])?", master) is not None


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own;
    any other raises, since executors would write where the others cannot read."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not is_local(sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="hornbeam-checkpoint-")
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The same rows from reliable storage, without their lineage."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like cut, as a compressed Parquet table in the shared folder: for larger intermediate results."""
    path = f"{shared_folder(df.sparkSession)}/hornbeam-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of plans that nothing refers to any more, which Spark does when memory is cleared: of
    the driver's Python first, then of its JVM, which finds out in a second round what the first has set free. Executors
    on other machines get a moment each time to do as they are told."""
    wait = 0.1 if is_local(spark.sparkContext.master) else 1.0
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.java.lang.System.gc()
        time.sleep(wait)


#: Rows and bytes of a batch on its way to Python and back.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def in_arrow(df: DataFrame, work: Callable, schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow in batches of bounded size, whose workers give their memory back when a task is done.

    The sizes are settings of the session; they are lowered and never raised."""
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(name).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))

    def tidy(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def give_back() -> None:
    """What allocators keep for later goes back to the system: idle workers live on beside others' tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


#: A key is frequent if it has over FREQUENT rows and over one in FREQUENT_KEYS of all rows, so at most FREQUENT_KEYS are.
FREQUENT, FREQUENT_KEYS = 50_000, 50_000


def skewed_join(big: DataFrame, small: DataFrame, key: str, n: str, rows: int | None = None) -> DataFrame:
    """big inner join small on a key that is unique in small, which also has n, the rows of big with that key.
    Frequent keys, whose number is bounded, are broadcast, so that no task has all rows of one; the rest is shuffled.
    rows: no less than big has, where that is known."""
    if rows is not None and rows <= FREQUENT:
        return big.join(small.drop(n), key)
    most, total = small.agg(F.max(n), F.sum(n)).first()
    least = max(FREQUENT, (total or 0) // FREQUENT_KEYS)
    if (most or 0) <= least:
        return big.join(small.drop(n), key)
    often, rest = small.filter(F.col(n) > least).drop(n), small.filter(F.col(n) <= least).drop(n)
    few = big.join(F.broadcast(often.select(key)), key, "left_anti").join(rest, key)
    return big.join(F.broadcast(often), key).unionByName(few)


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def runs(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 1) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal keys, from batches sorted by the keys. A run is never split; a table
    has `rows` rows or more, as far as there are, so memory is that of a batch and so many rows or of the longest run."""
    kept: list[pa.Table] = []
    for t in _runs(batches, keys):
        kept.append(t)
        if sum(map(len, kept)) >= rows:
            yield pa.concat_tables(kept)
            kept = []
    if kept:
        yield pa.concat_tables(kept)


def _runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        last = [batch.column(batch.schema.get_field_index(k))[n - 1].as_py() for k in keys]
        same = np.ones(n, bool)
        for k, v in zip(keys, last):
            col = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            same &= col == v
        start = n - int(np.argmin(same[::-1])) if not same.all() else 0
        if start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = [batch.slice(start)]
        else:
            if held:
                before = [held[-1].column(held[-1].schema.get_field_index(k))[held[-1].num_rows - 1].as_py() for k in keys]
                if before != last:
                    yield pa.Table.from_batches(held)
                    held = []
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def bounds(*cols: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    n = len(cols[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)
