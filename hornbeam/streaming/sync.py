"""Registry snapshots as a stream of files: what each brings that no earlier one had."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SNAPSHOT = "pkg string, version string, url string"


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot files (JSON lines) as they arrive."""
    return spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", 1).json(path)


#: The table of what is known is kept in so many parts by package, and a micro-batch reads those of its packages only.
PARTS = 64


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def sync(stream: DataFrame, known: str, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Keeps the table `known`: each micro-batch adds the (pkg, version) rows that are new, once each. A batch that is
    run again after a failure finds its rows there and adds nothing. Only a table that is not there counts as empty;
    any other failure to read it ends the stream."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(["pkg", "version"]).withColumn("part", F.pmod(F.xxhash64("pkg"), F.lit(PARTS)).cast("int"))
        if exists(spark, known):
            parts = [r.part for r in new.select("part").distinct().collect()]  # PARTS at most
            old = spark.read.schema(f"{SNAPSHOT}, part int").parquet(known).filter(F.col("part").isin(parts))
            new = new.join(old.select("part", "pkg", "version"), ["part", "pkg", "version"], "left_anti")
        new.select("pkg", "version", "url", "part").write.mode("append").partitionBy("part").parquet(known)

    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(add).start()
