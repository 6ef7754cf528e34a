"""Rate limits by token buckets: as a batch that is parallel over time ranges, and as a stream with the same result.

A key's bucket holds at most `burst` tokens, is full at first and gains `rate` tokens every `per` seconds; an event takes
one token and passes, or is dropped where there is none. All is counted in whole parts of a token, so that batch and
stream agree to the last event.

Batch: what a range of time does to the tokens at its begin is a function min(top, x + shift) on pieces of x, which is
found without knowing x: gaining tokens moves a piece and bends it at the brim, an event splits a piece where its tokens
come to one. Ranges of a key are worked on apart; only their functions, a row each, are put together key by key, and say
how many tokens each range begins with; then every range is run. A key's events are in one task only as far as they are
in one range.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType

from hornbeam.functions.storage import spread

MICROS = 1_000_000


class Bucket:
    """rate tokens every per seconds; a token has per * MICROS parts, of which it gains rate each microsecond."""

    def __init__(self, rate: int, per: int, burst: int):
        if min(rate, per, burst) < 1:
            raise ValueError("rate, per and burst are whole numbers from 1 on")
        self.rate, self.token, self.full = rate, per * MICROS, burst * per * MICROS

    def run(self, x: int, at: int, times: list[int]) -> tuple[list[bool], int, int]:
        """(passed, parts left, time of it) of events in order of time, from x parts at time `at`; what is earlier than
        `at` comes at it."""
        passed, rate, token, full = [], self.rate, self.token, self.full
        for t in times:
            if t > at:
                x, at = min(full, x + (t - at) * rate), t
            passed.append(x >= token)
            if x >= token:
                x -= token
        return passed, x, at

    def function(self, begin: int, times: list[int], end: int) -> tuple[list[int], list[int], list[int]]:
        """(from, shift, top): from x = from[i] on, x parts at the begin are min(top[i], x + shift[i]) at the end."""
        low, shift, top = np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, self.full, np.int64)
        at, seldom = begin, 64
        for t in times:
            gain = min((t - at) * self.rate, self.full)
            shift, top, at = shift + gain, np.minimum(top + gain, self.full), t
            able = top >= self.token
            split = np.maximum(self.token - shift, low)  # from here on the event passes
            high = np.append(low[1:], self.full + 1)
            upper, lower = able & (split < high), ~able | (split > low)
            low, shift, top = (np.concatenate(x) for x in ((low[lower], split[upper]), (shift[lower], shift[upper] - self.token), (top[lower], top[upper] - self.token)))
            order = np.argsort(low, kind="stable")
            low, shift, top = low[order], shift[order], top[order]
            if len(low) > seldom:
                low, shift, top = self._joined(low, shift, top)
                seldom = 2 * len(low) + 64
        gain = min((end - at) * self.rate, self.full)
        low, shift, top = self._joined(low, shift + gain, np.minimum(top + gain, self.full))
        return low.tolist(), shift.tolist(), top.tolist()

    def _joined(self, low, shift, top):
        """Neighbours that are one function become one piece."""
        flat = low + shift >= top
        shift = np.where(flat, self.full, shift)  # all at the top
        new = np.append(True, (shift[1:] != shift[:-1]) | (top[1:] != top[:-1]))
        return low[new], shift[new], top[new]


def limited(events: DataFrame, key: str, rate: int = 1, per: int = 1, burst: int = 1000, span: int = 86_400, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """events with passed. Events of a key come in order of time and `order`; rows without a time or key do not pass and
    take nothing. span: seconds of a range."""
    bucket, width, columns = Bucket(rate, per, burst), span * MICROS, events.columns
    known = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    t = known.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_range", F.floor(F.col("_t") / width))
    kind = events.schema[key].dataType.simpleString()
    arrays = pa.list_(pa.int64())

    def function(table: pa.Table) -> pa.Table:
        number = table.column("_range")[0].as_py()
        parts = bucket.function(number * width, np.sort(table.column("_t").to_numpy()).tolist(), (number + 1) * width)
        return pa.Table.from_arrays([table.column(key).slice(0, 1), pa.array([number], pa.int64()), *(pa.array([x], arrays) for x in parts)], [key, "_range", "low", "shift", "top"])

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("_range")
        x, end, out = bucket.full, None, []
        for r in table.drop_columns([key]).to_pylist():
            begin = r["_range"] * width
            if end is not None:
                x = min(bucket.full, x + (begin - end) * bucket.rate)
            out.append(x)
            k = bisect_right(r["low"], x) - 1
            x, end = min(r["top"][k], x + r["shift"][k]), begin + width
        return table.select([key, "_range"]).append_column("_x", pa.array(out, pa.int64()))

    functions = spread(t.select(key, "_range", "_t"), key, "_range").groupBy(key, "_range").applyInArrow(function, f"{key} {kind}, _range long, low array<long>, shift array<long>, top array<long>")
    begins = spread(functions, key).groupBy(key).applyInArrow(chain, f"{key} {kind}, _range long, _x long")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_t", "ascending"), (order, "ascending")])
        passed, _, _ = bucket.run(table.column("_x")[0].as_py(), table.column("_range")[0].as_py() * width, table.column("_t").to_pylist())
        return table.select(columns).append_column("passed", pa.array(passed, pa.bool_()))

    out = spread(t.join(begins, [key, "_range"]), key, "_range").groupBy(key, "_range").applyInArrow(run, StructType([*events.schema, StructField("passed", BooleanType())]))
    lost = events.filter(F.col(key).isNull() | F.col(ts).isNull()).withColumn("passed", F.lit(False))
    return out.unionByName(lost)


def limited_stream(events: DataFrame, key: str, rate: int = 1, per: int = 1, burst: int = 1000, ts: str = "ts", order: str = "event_id", forget: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(key, order, ts, passed) of a stream: the same, micro-batch by micro-batch. An event that comes after later ones of
    its key counts as of their time. forget: a key loses its state when the watermark, `late` behind the latest event, is
    so long past its last one, by when its bucket must be full; events that come after the watermark are then dropped."""
    bucket = Bucket(rate, per, burst)
    kind, number = (events.schema[c].dataType.simpleString() for c in (key, order))
    keep = None if forget is None else int(pd.Timedelta(forget).total_seconds() * 1000)
    if keep is not None and keep * 1000 * rate < bucket.full:
        raise ValueError("a key is forgotten before its bucket is full")

    def work(keys, groups: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        x, at = state.get if state.exists else (bucket.full, None)
        group = pd.concat(list(groups)).sort_values(["_t", order])
        times = group["_t"].tolist()
        passed, x, at = bucket.run(x, times[0] if at is None else at, times)
        state.update((x, at))
        if keep is not None:
            state.setTimeoutTimestamp(max(at // 1000 + keep, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [keys[0]] * len(group), order: group[order].to_numpy(), ts: group[ts].to_numpy(), "passed": passed})

    t = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, order, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"))
    t, timeout = (t, GroupStateTimeout.NoTimeout) if keep is None else (t.withWatermark(ts, late), GroupStateTimeout.EventTimeTimeout)
    return t.groupBy(key).applyInPandasWithState(work, f"{key} {kind}, {order} {number}, {ts} {events.schema[ts].dataType.simpleString()}, passed boolean", "x long, at long", "append", timeout)
