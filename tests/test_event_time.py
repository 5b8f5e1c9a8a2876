"""Stateful stream operators in event time: several micro-batches with late rows against the batch forms."""

import datetime
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardline.operators.ranking import lockouts
from wardline.streaming import run, stateful, windows

START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def in_batches(spark, folder, rows, ddl, batches):
    """A stream that delivers one file of rows after the other."""
    for n, part in enumerate(batches):
        spark.createDataFrame([rows[i] for i in part], ddl).coalesce(1).write.parquet(f"{folder}/{n}")
    files = sorted((f"{folder}/{n}", f) for n in range(len(batches)) for f in os.listdir(f"{folder}/{n}") if f.endswith(".parquet"))
    flat = f"{folder}/flat"
    os.makedirs(flat)
    for n, (where, f) in enumerate(files):
        os.link(f"{where}/{f}", f"{flat}/{n}.parquet")
        os.utime(f"{flat}/{n}.parquet", (n + 1, n + 1))
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", "1").parquet(flat)


def late_batches(times, delay, rng, count=3):
    """Rows dealt to batches in time order, some of them a batch later, but inside the delay."""
    order = sorted(range(len(times)), key=lambda i: times[i])
    cuts = [order[len(order) * k // count : len(order) * (k + 1) // count] for k in range(count)]
    for k in range(count - 1):
        edge = max(times[i] for i in cuts[k])
        late = [i for i in cuts[k] if times[i] > edge - datetime.timedelta(seconds=delay) and rng.random() < 0.5]
        cuts[k] = [i for i in cuts[k] if i not in late]
        cuts[k + 1] = cuts[k + 1] + late
        rng.shuffle(cuts[k + 1])
    return cuts


def test_lockouts_with_late_rows(spark, tmp_path):
    rng = random.Random(7)
    rows, now = [], 0
    for i in range(400):
        now += rng.choice([5, 30, 60, 200, 901])
        rows.append((rng.randrange(5), at(now), i, rng.random() < 0.3))
    ddl = "user_id long, ts timestamp, seq long, ok boolean"
    stream = in_batches(spark, str(tmp_path), rows, ddl, late_batches([r[1] for r in rows], 600, rng))
    got = {r.seq: (r.failed_attempts, r.locked) for r in run.to_table(stateful.stream_lockouts(stream, "10 minutes"), "late").collect()}
    want = {r.seq: (r.failed_attempts, r.locked) for r in lockouts(spark.createDataFrame(rows, ddl)).collect()}
    passed = max(r[1] for r in rows) - datetime.timedelta(minutes=10)
    assert got == {r[2]: want[r[2]] for r in rows if r[1] <= passed}


def test_alert_fires_without_another_reading(spark, tmp_path):
    rows = [("a", at(0), 0, True, 120), ("b", at(0), 1, True, 500), ("a", at(1000), 2, False, 120), ("b", at(1000), 3, True, 500), ("a", at(5000), 4, True, 120)]
    ddl = "rule string, ts timestamp, seq long, breach boolean, hold int"
    stream = in_batches(spark, str(tmp_path), rows, ddl, [[1], [0, 2], [3, 4]])
    got = sorted(
        ((r.rule, (r.us - int(START.replace(tzinfo=datetime.UTC).timestamp() * 1e6)) // 10**6, r.seq, r.firing) for r in run.to_table(stateful.stream_alert_hold(stream, "1000 seconds"), "alarm").collect()),
        key=str,
    )
    assert got == sorted([("a", 0, 0, False), ("a", 120, None, True), ("a", 1000, 2, False), ("b", 0, 1, False), ("b", 500, None, True), ("b", 1000, 3, True)], key=str)


def test_revocations_by_state(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"t{rng.randrange(4)}", at(rng.randrange(20000)), i, rng.choice([None, None, 60, 2000])) for i in range(300)]
    ddl = "token string, ts timestamp, seq long, ttl_seconds int"
    stream = in_batches(spark, str(tmp_path), rows, ddl, late_batches([r[1] for r in rows], 300, rng, 4))
    got = {r.seq: r.revoked for r in run.to_table(stateful.stream_revocations(stream, "300 seconds"), "revoked").collect()}
    table = spark.createDataFrame(rows, ddl)
    marks = table.where("ttl_seconds is not null").select("token", F.col("ts").alias("revoked_at"), "ttl_seconds")
    revoked = {r.seq for r in windows.revoked_requests(table.where("ttl_seconds is null"), marks).collect()}
    passed = max(r[1] for r in rows) - datetime.timedelta(seconds=300)
    assert got == {r[2]: r[2] in revoked for r in rows if r[3] is None and r[1] <= passed}


class Store:
    """A state variable and the timers of one key."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, ddl):
        return Var(self)

    def getListState(self, name, ddl):
        return Var(Store())

    def registerTimer(self, ms):
        self.timers.add(ms)


class Var:
    def __init__(self, store):
        self.store = store

    def exists(self):
        return self.store.value is not None

    def get(self):
        return self.store.value

    def update(self, value):
        self.store.value = value

    put = update

    def appendList(self, rows):
        self.store.value = [*(self.store.value or []), *rows]

    def clear(self):
        self.store.value = None


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


@pytest.mark.parametrize("idle, kept", [(None, True), (100, False)])
def test_idle_keys_leave_the_state(idle, kept):
    store = Store()
    timed = stateful._Timed(stateful.Lockout(), "us long, seq long, ok boolean", idle)
    timed.init(store)
    rows = pd.DataFrame([(7, 1_000_000, 1, False)], columns=["user_id", "us", "seq", "ok"])
    list(timed.handleInputRows((7,), iter([rows]), Watermark(0)))
    (out,) = timed.handleExpiredTimer((7,), Watermark(2000), None)
    assert out["failed_attempts"].tolist() == [1] and store.value is not None
    list(timed.handleExpiredTimer((7,), Watermark(200_000), None))
    assert (store.value is not None) == kept
    # a success says no more than an empty state
    rows = pd.DataFrame([(7, 300_000_000, 2, True)], columns=["user_id", "us", "seq", "ok"])
    list(timed.handleInputRows((7,), iter([rows]), Watermark(200_000)))
    list(timed.handleExpiredTimer((7,), Watermark(400_000), None))
    assert store.value is None
