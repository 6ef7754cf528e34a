"""Traces that have gone quiet and containers that have run too long, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

IDLE = 3600


def sessions(events: DataFrame, by: list[str], idle: int = IDLE, ts: str = "ts") -> DataFrame:
    """(by, start, last, events): runs of events of which none is more than idle seconds after the one before it. Of a
    stream with a watermark, a run is given out when the watermark has passed its end, and later rows are dropped.
    Partial runs are merged before and after the shuffle, so a key's events need not be in one task at a time. Rows without
    a time are left out."""
    window = F.session_window(F.col(ts), f"{idle} seconds")  # runs that touch are one
    return events.filter(F.col(ts).isNotNull()).groupBy(*by, window).agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("events")).select(*by, "start", "last", "events")


def rolled(events: DataFrame, by: list[str], idle: int = IDLE, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(quiet, active) traces: sessions() that ended more than idle seconds before the latest event of all, and others."""
    found = sessions(events, by, idle, ts)
    now = events.agg(F.max(ts)).first()[0]
    quiet = F.col("last") < F.lit(now).cast(events.schema[ts].dataType) - F.expr(f"INTERVAL {idle} SECONDS")
    return found.filter(quiet), found.filter(~quiet)


def overtime(events: DataFrame, timeout: int, now=None, ts: str = "ts") -> DataFrame:
    """(container, started, evicted) of containers that ran for over timeout seconds: those that stopped later than that,
    and those that had not stopped by `now` (the latest event of all). events (container, event, ts): the first `start`
    and the first `stop` of each container count."""
    when = lambda kind: F.min(F.when(F.col("event") == kind, F.col(ts)))
    if now is None:
        now = events.agg(F.max(ts)).first()[0]
    lives = events.groupBy("container").agg(when("start").alias("started"), when("stop").alias("stopped"))
    limit = F.col("started") + F.expr(f"INTERVAL {timeout} SECONDS")
    return lives.filter(limit < F.coalesce("stopped", F.lit(now).cast(events.schema[ts].dataType))).select("container", "started", limit.alias("evicted"))


class Evictor(StatefulProcessor):
    """A container's state is its start, and a timer for the end of its time; a stop takes both away."""

    def __init__(self, timeout: int, ts: str = "ts"):
        self.timeout, self.ts = timeout, ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.started = handle.getValueState("started", "at long")

    def _clear(self) -> None:
        if self.started.exists():
            self.handle.deleteTimer(self._due(self.started.get()[0]))
            self.started.clear()

    def _due(self, at: int) -> int:
        """Milliseconds, the first after the time is over."""
        return (at + self.timeout * 1_000_000) // 1000 + 1

    def _row(self, key, at: int) -> pd.DataFrame:
        return pd.DataFrame({"container": [key[0]], "started": [pd.Timestamp(at, unit="us")], "evicted": [pd.Timestamp(at + self.timeout * 1_000_000, unit="us")]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for r in pd.concat(list(rows)).sort_values("micros").itertuples(index=False):
            if r.event == "start" and not self.started.exists():
                self.started.update((int(r.micros),))
                self.handle.registerTimer(self._due(int(r.micros)))
            elif r.event == "stop" and self.started.exists():
                at = self.started.get()[0]
                self._clear()
                if r.micros > at + self.timeout * 1_000_000:
                    yield self._row(key, at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.started.exists():
            at = self.started.get()[0]
            self.started.clear()
            yield self._row(key, at)

    def close(self) -> None:
        pass


def overtime_stream(events: DataFrame, timeout: int, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """overtime() of a stream: a container's row comes when the watermark passes the end of its time, or with its stop.
    State is kept in RocksDB, which timers need (spark.sql.streaming.stateStore.providerClass)."""
    known = events.filter(F.col("container").isNotNull() & F.col(ts).isNotNull())
    t = known.withWatermark(ts, late).withColumn("micros", F.unix_micros(F.col(ts).cast("timestamp")))
    kind = events.schema["container"].dataType.simpleString()
    return t.groupBy("container").transformWithStateInPandas(Evictor(timeout, ts), f"container {kind}, started timestamp, evicted timestamp", "append", "eventTime")
