"""Alerts as a stream: the batch operators over windows of event time, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hornbeam.functions.names import split_container
from hornbeam.operators.behavior import alert_values, value_of


def windowed_sets(alerts: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(window, pkg, version, sudo, rule, values) of a stream (ts, rule, output_fields): state ends with the watermark."""
    marked = alerts.withWatermark("ts", late)
    rows = _with_time(marked)
    return rows.groupBy(F.window("ts", width), "pkg", "version", "sudo", "rule").agg(F.array_sort(F.collect_set("value")).alias("values"))


def _with_time(alerts: DataFrame) -> DataFrame:
    """alert_values() with the alert's time kept."""
    host = F.col("output_fields").getItem("container.name")
    rows = alerts.select("ts", split_container(host).alias("of"), "rule", value_of().alias("value"), host.alias("host"))
    kept = rows.filter(F.col("host").isNotNull() & ~F.col("host").isin("", "host") & F.col("of").isNotNull() & F.col("value").isNotNull() & (F.col("value") != ""))
    return kept.select("ts", "of.pkg", "of.version", "of.sudo", "rule", "value")


def store(alerts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Writes distinct values of each micro-batch to a table by batch and rule; counts over the table are those of the
    batch query. A batch that is run again after a failure replaces its own rows."""

    def save(batch: DataFrame, number: int) -> None:
        alert_values(batch).distinct().write.mode("overwrite").partitionBy("rule").parquet(f"{path}/batch={number}")

    return alerts.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(save).start()
