"""Rate limits, sessions and evictions, as batches and as streams."""

import datetime
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hornbeam.streaming import limits, traces
from tests.conftest import rows

T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 5), st.integers(1, 4), st.integers(1, 6), st.lists(st.integers(0, 3_000_000), max_size=40), st.floats(0, 1))
def test_functions_of_ranges(rate, per, burst, gaps, share):
    b, t, times = limits.Bucket(rate, per, burst), 0, []
    for g in gaps:
        t += g
        times.append(t)
    low, shift, top = b.function(0, times, t + 7)
    for x in {0, b.full, int(share * b.full), *low, *(v - 1 for v in low[1:])}:
        passed, left, last = b.run(x, 0, times)
        want = min(b.full, left + (t + 7 - last) * rate)
        k = max(i for i, v in enumerate(low) if v <= x)
        assert min(top[k], x + shift[k]) == want


def brute(data, rate, per, burst):
    state, out = {}, {}
    for key, i, t in sorted(data, key=lambda r: (r[2], r[1])):
        tokens, last = state.get(key, (burst * per * 1_000_000, t))
        tokens = min(burst * per * 1_000_000, tokens + (t - last) * rate)
        out[i] = tokens >= per * 1_000_000
        state[key] = (tokens - out[i] * per * 1_000_000, t)
    return out


def events(n=600, seed=1):
    rnd, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += rnd.choice([0, 10_000, 400_000, 5_000_000])
        out.append((rnd.choice(["hot", "hot", "a", "b"]), i, t))
    return out


@pytest.mark.parametrize("span", [1, 60, 100_000])
def test_limited_equals_one_by_one(spark, span):
    data = events()
    df = spark.createDataFrame([(k, i, at(t / 1e6), "x") for k, i, t in data] + [(None, -1, at(1), "x"), ("a", -2, None, "x")], "user string, event_id long, ts timestamp, more string")
    got = limits.limited(df.repartition(3), "user", 2, 3, 4, span).collect()
    want = brute(data, 2, 3, 4)
    assert {r.event_id: r.passed for r in got} == want | {-1: False, -2: False} and {r.more for r in got} == {"x"}
    assert 0 < sum(want.values()) < len(want)
    assert limits.limited(df.limit(0), "user").count() == 0
    with pytest.raises(ValueError):
        limits.Bucket(0, 1, 1)


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def put(spark, folder, k, data, schema):
    """One file, which comes after those put before."""
    import json
    import os
    import time

    folder.mkdir(exist_ok=True)
    names = [x.split()[0] for x in schema.split(", ")]
    part = folder / f"{k:03}.json"
    part.write_text("\n".join(json.dumps(dict(zip(names, r)), default=lambda t: t.isoformat()) for r in data) + "\n")
    os.utime(part, (time.time() - 1000 + 10 * k,) * 2)


@pytest.mark.parametrize("forget", [None, "10 minutes"])
def test_the_stream_equals_the_batch(spark, tmp_path, forget):
    schema, data = "user string, event_id long, ts timestamp", events(300, 2)
    for k in range(3):
        put(spark, tmp_path / "in", k, [(u, i, at(t / 1e6)) for u, i, t in data[100 * k : 100 * k + 100]], schema)
    for _ in range(2):  # the second run begins where the first has stopped
        q = limits.limited_stream(stream_of(spark, tmp_path / "in", schema), "user", 2, 3, 4, forget=forget).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert {r.event_id: r.passed for r in spark.read.parquet(str(tmp_path / "out")).collect()} == brute(data, 2, 3, 4)
    with pytest.raises(ValueError):
        limits.limited_stream(stream_of(spark, tmp_path / "in", schema), "user", 1, 10, 10, forget="1 second")


def test_sessions_in_batch(spark):
    df = spark.createDataFrame([("a", at(0)), ("a", at(3600)), ("a", at(7200.000001)), ("b", at(9000)), (None, at(0)), ("a", None)], "k string, ts timestamp")
    got = rows(traces.sessions(df, ["k"]))
    assert got == sorted([("a", at(0), at(3600), 2), ("a", at(7200.000001), at(7200.000001), 1), ("b", at(9000), at(9000), 1), (None, at(0), at(0), 1)], key=repr)
    quiet, active = traces.rolled(df, ["k"])
    assert rows(quiet.select("k", "events")) == [("a", 2), (None, 1)] and rows(active.select("k")) == [("a",), ("b",)]
    assert traces.rolled(df.limit(0), ["k"])[0].count() == 0


def test_sessions_of_a_stream_drop_late_rows(spark, tmp_path):
    schema = "k string, ts timestamp"
    for n, data in enumerate([[("a", at(0)), ("a", at(100))], [("a", at(3000)), ("b", at(20_000))], [("b", at(20_100))], [("a", at(200)), ("b", at(20_200))], [("b", at(90_000))], [("b", at(90_001))]]):
        put(spark, tmp_path / "in", n, data, schema)
    marked = stream_of(spark, tmp_path / "in", schema).withWatermark("ts", "10 minutes")
    q = traces.sessions(marked, ["k"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [("a", at(0), at(3000), 3), ("b", at(20_000), at(20_200), 3)]  # a's row at 200 came too late


LIVES = [("quick", "start", 0), ("quick", "stop", 50), ("slow", "start", 10), ("slow", "stop", 500), ("lost", "start", 20), ("late", "start", 900), ("odd", "stop", 5)]


def test_overtime_in_batch(spark):
    df = spark.createDataFrame([(c, e, at(t)) for c, e, t in LIVES], "container string, event string, ts timestamp")
    assert rows(traces.overtime(df, 100)) == [("lost", at(20), at(120)), ("slow", at(10), at(110))]
    assert rows(traces.overtime(df, 100, at(2000)).select("container")) == [("late",), ("lost",), ("slow",)]
    assert traces.overtime(df.limit(0), 100).count() == 0


def test_overtime_of_a_stream_with_a_restart(spark, tmp_path):
    schema = "container string, event string, ts timestamp"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        parts = [[r for r in LIVES if r[2] < 30], [r for r in LIVES if 30 <= r[2] < 100], [("tick", "stop", 400)], [r for r in LIVES if r[2] >= 500], [("tick", "stop", 2000)], [("tick", "stop", 2001)]]
        for n, part in enumerate(parts):
            put(spark, tmp_path / "in", n, [(c, e, at(t)) for c, e, t in part], schema)
            if n in (2, 5):  # stopped in between
                q = traces.overtime_stream(stream_of(spark, tmp_path / "in", schema), 100, "1 second").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
                q.awaitTermination()
        assert rows(spark.read.parquet(str(tmp_path / "out"))) == [("late", at(900), at(1000)), ("lost", at(20), at(120)), ("slow", at(10), at(110))]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_ranges_of_time_go_to_all_partitions(spark):
    from hornbeam.streaming import limits

    events = spark.createDataFrame([(1, 1, datetime.datetime(2024, 1, 1))], "user_id int, event_id int, ts timestamp")
    said = limits.limited(events, "user_id")._jdf.queryExecution().executedPlan().toString()
    assert said.count("REPARTITION_BY_NUM") >= 2, said  # of functions, and of events with their beginnings
