"""The run store behind T17 and T18: bounded files, exact retries, atomic merges, level-wise refresh."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.operators import ticks as tk
from quarry.session import scratch_path
from quarry.streaming import store as st
from quarry.streaming import ticks as tst

TICKS = "instrument string, price double, timestamp timestamp_ntz, t_dt date"


def _ticks(spark, rows):
    return spark.createDataFrame([(i, p, t, t.date()) for i, p, t in rows], TICKS)


def _at(minutes, seconds=0):
    return dt.datetime(2024, 1, 1, 22, 0) + dt.timedelta(minutes=minutes, seconds=seconds)


def _sums(spark, root):
    return st.RunStore(spark, root, "k int, day date, n bigint, hi double", "day", st.added_up(["k", "day"], ["n"], ["hi"], []))


def test_runs_stay_few_and_sums_exact(spark, monkeypatch):
    monkeypatch.setattr(st, "FAN", 3)
    store = _sums(spark, scratch_path(spark, "store"))
    for b in range(20):
        rows = spark.createDataFrame([(b % 2, dt.date(2024, 1, 1 + b % 3), 1, float(b))], "k int, day date, n bigint, hi double").coalesce(1)
        store.append(rows, b)
        store.append(rows, b)  # a retry
        assert store.compact() <= 2 * 3
    store.append(spark.createDataFrame([(0, dt.date(2024, 1, 1), 99, 0.0)], "k int, day date, n bigint, hi double"), 7)  # an old batch again
    got = {(r.k, r.day.day): (r.n, r.hi) for r in store.read().collect()}
    want = {}
    for b in range(20):
        n, hi = want.get((b % 2, 1 + b % 3), (0, 0.0))
        want[b % 2, 1 + b % 3] = (n + 1, max(hi, float(b)))
    assert got == want


def test_a_merge_that_fails_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(st, "FAN", 2)
    store = _sums(spark, scratch_path(spark, "store"))
    assert store.read().count() == 0 and store.compact() == 0
    for b in range(2):
        store.append(spark.createDataFrame([(1, dt.date(2024, 1, 1), 1, 1.0)], "k int, day date, n bigint, hi double").coalesce(1), b)
    reader = store.stored_rows()
    number = store.manifest()[0]
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.compact()
    assert store.manifest()[0] == number and store.read().first().n == 2
    assert store.compact() == 1 and store.read().first().n == 2
    assert reader.count() == 2  # a reader from before the merge still finds its files
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit(store.manifest()[0], {})


def _chain(spark, rows):
    five = tk.tick_5min(tk.tick_minute(_ticks(spark, rows)))
    hourly = tk.tick_hourly(five)
    return {"five": five, "hourly": hourly, "daily": tk.tick_daily(hourly)}


def _plain(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in df.select(*sorted(df.columns)).collect())


def test_levels_follow_late_ticks_and_retries(spark, monkeypatch):
    monkeypatch.setattr(st, "FAN", 2)
    base = scratch_path(spark, "t18")
    batches = [
        [("A", 10.0, _at(0)), ("A", 20.0, _at(0, 30)), ("A", 30.0, _at(3)), ("B", 1.0, _at(61))],
        [("A", 40.0, _at(7)), ("B", 3.0, _at(180))],  # B: the next day
        [("A", 90.0, _at(0, 45))],  # late: changes minute 0, its five minutes, hour and day
        [("C", 5.0, _at(200))],
    ]
    seen = []
    for b, rows in enumerate(batches):
        tst.refresh_marts(spark, _ticks(spark, rows), b, base)
        tst.refresh_marts(spark, _ticks(spark, rows), b, base)
        seen += rows
        for name, want in _chain(spark, seen).items():
            assert _plain(tst.current_mart(spark, base, name)) == _plain(want), (b, name)


def test_a_batch_that_stopped_between_levels_goes_on(spark):
    base = scratch_path(spark, "t18")
    rows = [("A", 10.0, _at(0)), ("A", 20.0, _at(1)), ("B", 5.0, _at(70))]
    tst.mart_stores(spark, base)["minute"].append(tst.partial_minute_bars(_ticks(spark, rows)), 0)  # then it was killed
    tst.refresh_marts(spark, _ticks(spark, rows), 0, base)
    assert _plain(tst.current_mart(spark, base, "daily")) == _plain(_chain(spark, rows)["daily"])


def test_raw_ticks_are_read_once_a_batch(spark):
    base = scratch_path(spark, "t18")
    count = spark.sparkContext.accumulator(0)
    rows = _ticks(spark, [("A", 10.0, _at(i)) for i in range(50)]).coalesce(1)

    def seen(frames):
        for f in frames:
            count.add(len(f))
            yield f

    tst.refresh_marts(spark, rows.mapInPandas(seen, TICKS), 0, base)
    assert count.value == 50 and tst.current_mart(spark, base, "daily").agg(F.sum("trades")).first()[0] == 50
