"""Operators whose next state depends on the previous one.

The processors keep a few numbers per key. Without a watermark, rows of a key are
put in time order within a micro-batch, whose size the source's trigger option
bounds. With a ``delay`` they run in event time: rows wait in the state until the
watermark has passed them, and a timer releases them in order, so a late row finds
its place whatever batch it comes in. Timers also let an alert fire without another
reading, and drop the state of keys that it says nothing about any more.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.prefix import RANGE, Running, in_ranges, running, time_chunk

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MICROS = 1_000_000
#: Rows of a key that are stepped through, and handed on, at a time.
SLICE_ROWS = 10_000
FRAME_TYPES = {"bigint": "Int64", "long": "Int64", "int": "Int64", "boolean": "boolean"}

# Fixed values.
LOGIN_LIMIT = 5
LOCK_MINUTES = 15
CIRCUIT_THRESHOLD = 3
CIRCUIT_BASE_SECONDS = 30
CIRCUIT_MAX_SECONDS = 300
MEMO_TTL_SECONDS = 3600


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Ordered(StatefulProcessor):
    """Steps through the rows of a key in time order with one state tuple."""

    state_ddl = ""
    initial: tuple = ()
    columns: list[str] = []
    row: type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.state_ddl)

    def step(self, state: tuple, row: object) -> tuple[tuple, tuple | None]:
        raise NotImplementedError

    @staticmethod
    def ordered(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values(["us", "seq"], kind="stable")

    def idle(self, state: tuple, us: int) -> bool:
        """Whether the state says no more than the initial one from this time on."""
        return state == self.initial

    def alarm(self, state: tuple) -> int | None:
        """When something happens without a further row."""
        return None

    def alarm_values(self, state: tuple) -> tuple:
        return ()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        batch = self.ordered(pd.concat([part[list(self.row._fields)] for part in rows], ignore_index=True))
        state = tuple(self.state.get()) if self.state.exists() else self.initial
        for at in range(0, len(batch), SLICE_ROWS):
            out = []
            for row in batch.iloc[at : at + SLICE_ROWS].itertuples(index=False):
                state, values = self.step(state, row)
                out.append((key[0], row.us, row.seq, *values))
            self.state.update(state)
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def _plain(row: tuple) -> tuple:
    """A row without the floats that stand for nulls, and for numbers beside them, in frames; no field is a float itself."""
    return tuple(None if v is None or v != v else int(v) if isinstance(v, float) else v for v in row)


class _Timed(StatefulProcessor):
    """Steps through the rows of a key in event time, as an ``_Ordered`` steps.

    ``columns`` of the rows: us, seq, then those of ``row_ddl``. The state goes when it is
    ``idle`` for the step's rules, or after ``idle_seconds`` without a row.
    """

    def __init__(self, steps: _Ordered, row_ddl: str, idle_seconds: int | None = None):
        self.steps, self.row_ddl, self.idle_seconds = steps, row_ddl, idle_seconds
        kinds = dict(part.split() for part in row_ddl.split(", "))
        self.fields = list(kinds)
        self.types = {f: FRAME_TYPES.get(kind, "object") for f, kind in kinds.items()}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"{self.steps.state_ddl}, last_us long")
        self.waiting = handle.getListState("waiting", self.row_ddl)

    def _alarm_at(self, us: int) -> None:
        """Wake up once the watermark is at or behind this time."""
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for part in rows:
            self.waiting.appendList([_plain(r) for r in part[self.fields].itertuples(index=False, name=None)])
            self._alarm_at(int(part["us"].min()))
        yield pd.DataFrame(columns=self.steps.columns)

    def _in_order(self) -> pd.DataFrame:
        """The waiting rows as columns of numbers; only a slice at a time becomes objects."""
        slices, rows = [], []
        for row in self.waiting.get() if self.waiting.exists() else ():
            rows.append(_plain(row))
            if len(rows) == SLICE_ROWS:
                slices.append(pd.DataFrame(rows, columns=self.fields).astype(self.types))
                rows = []
        slices.append(pd.DataFrame(rows, columns=self.fields).astype(self.types))
        return self.steps.ordered(pd.concat(slices, ignore_index=True))

    @staticmethod
    def _slices(rows: pd.DataFrame) -> Iterator[list[tuple]]:
        for at in range(0, len(rows), SLICE_ROWS):
            part = rows.iloc[at : at + SLICE_ROWS].astype(object)
            yield list(part.where(part.notna(), None).itertuples(index=False, name=None))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = self._in_order()
        n_ready = int((rows["us"] <= now).sum())
        *state, last = self.state.get() if self.state.exists() else (*self.steps.initial, None)
        state, out = tuple(state), []
        for part in self._slices(rows.iloc[:n_ready]):
            if out:
                yield pd.DataFrame(out, columns=self.steps.columns)
            out = []
            for row in map(self.steps.row._make, part):
                out += self._alarms(key, state, last, row.us - 1)
                state, values = self.steps.step(state, row)
                last = row.us
                if values is not None:
                    out.append((key[0], row.us, row.seq, *values))
        out += self._alarms(key, state, last, now)
        later = rows.iloc[n_ready:]
        if n_ready:
            self.waiting.clear()
            for part in self._slices(later):
                self.waiting.appendList(part)
        if len(later):
            self._alarm_at(int(later["us"].iloc[0]))
        alarm = self.steps.alarm(state)
        if alarm is not None and alarm > now:
            self._alarm_at(alarm)
        gone = last is None or self.steps.idle(state, now)
        if not gone and self.idle_seconds is not None:
            gone = last + self.idle_seconds * MICROS <= now
            if not gone:
                self._alarm_at(last + self.idle_seconds * MICROS)
        if gone:
            self.state.clear()
        else:
            self.state.update((*state, last))
        yield pd.DataFrame(out, columns=self.steps.columns)

    def _alarms(self, key: tuple, state: tuple, last: int | None, until: int) -> list[tuple]:
        """What happens by itself after the last row and up to a time."""
        at = self.steps.alarm(state)
        return [(key[0], at, None, *self.steps.alarm_values(state))] if at is not None and last is not None and last < at <= until else []

    def close(self) -> None:
        pass


class Lockout(_Ordered):
    """State: failures counted, lock end in microseconds."""

    state_ddl = "fails long, until long"
    initial = (0, 0)
    columns = ["user_id", "us", "seq", "failed_attempts", "locked", "locked_until_us"]
    row = namedtuple("Login", "us seq ok")

    def idle(self, state, us):
        return state[0] == 0 and state[1] <= us

    def step(self, state, row):
        fails, until = state
        if row.ok and row.us >= until:
            state = (0, 0)
        else:
            fails += 1
            state = (fails, row.us + LOCK_MINUTES * 60 * MICROS if fails >= LOGIN_LIMIT else until)
        locked = state[0] >= LOGIN_LIMIT
        return state, (state[0], locked, state[1] if locked else None)


class Circuit(_Ordered):
    """State: failures in a row, open flag, time of the last failure."""

    state_ddl = "fails long, is_open boolean, last long"
    initial = (0, False, 0)
    columns = ["provider", "us", "seq", "failures", "circuit_open", "reset_seconds"]
    row = namedtuple("Outcome", "us seq ok")

    def idle(self, state, us):
        return state[0] == 0 and not state[1]

    @staticmethod
    def pause(fails: int) -> int:
        return min(CIRCUIT_BASE_SECONDS * 2 ** min(fails, 10), CIRCUIT_MAX_SECONDS)

    def step(self, state, row):
        fails, is_open, last = state
        if is_open and row.us - last > self.pause(fails) * MICROS:
            fails, is_open = 0, False
        if row.ok:
            state = (0, False, last)
        else:
            fails += 1
            state = (fails, is_open or fails >= CIRCUIT_THRESHOLD, row.us)
        return state, (state[0], state[1], self.pause(state[0]) if state[1] else 0)


class Memo(_Ordered):
    """State: end of the stored response's life. A miss stores anew, a hit does not extend."""

    state_ddl = "until long"
    initial = (-1,)
    columns = ["key", "us", "seq", "hit"]
    row = namedtuple("Call", "us seq")

    def idle(self, state, us):
        return state[0] <= us

    def step(self, state, row):
        hit = row.us < state[0]
        return (state if hit else (row.us + MEMO_TTL_SECONDS * MICROS,)), (hit,)


class Hold(_Ordered):
    """State: start of the unbroken breach, -1 when there is none, and how long it must last."""

    state_ddl = "since long, hold long"
    initial = (-1, 0)
    columns = ["rule", "us", "seq", "since_us", "firing"]
    row = namedtuple("Reading", "us seq breach hold")

    def step(self, state, row):
        if not row.breach:
            return self.initial, (None, False)
        since = state[0] if state[0] >= 0 else row.us
        return (since, row.hold * MICROS), (since, row.us - since >= row.hold * MICROS)

    def alarm(self, state):
        return state[0] + state[1] if state[0] >= 0 else None

    def alarm_values(self, state):
        return state[0], True


class Revocation(_Ordered):
    """State: the latest end of the token's revocations so far. Rows are requests, or revocations with an ``until``."""

    state_ddl = "until long"
    initial = (-1,)
    columns = ["token", "us", "seq", "revoked"]
    row = namedtuple("Use", "us seq until")

    @staticmethod
    def ordered(rows):
        return rows.assign(late=rows["until"].isna()).sort_values(["us", "late", "seq"], kind="stable").drop(columns="late")

    def step(self, state, row):
        if row.until is not None:
            return (max(state[0], row.until),), None
        return state, (row.us < state[0],)

    def idle(self, state, us):
        return state[0] <= us


def _apply(
    df: DataFrame, key: str, steps: _Ordered, ddl: str, *extra: str, delay: str | None = None, idle_seconds: int | None = None
) -> DataFrame:
    """The rows of ``steps`` for a stream with ``ts``; in event time with a watermark of ``delay``."""
    use_state_store(df.sparkSession)
    if delay is None:
        rows = df.select(key, F.unix_micros("ts").alias("us"), "seq", *extra)
        return rows.groupBy(key).transformWithStateInPandas(steps, outputStructType=ddl, outputMode="append", timeMode="None")
    rows = df.withWatermark("ts", delay).select(key, "ts", F.unix_micros("ts").alias("us"), "seq", *extra)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    row_ddl = ", ".join(f"{f} {kinds[f]}" for f in ("us", "seq", *extra))
    return rows.groupBy(key).transformWithStateInPandas(
        _Timed(steps, row_ddl, idle_seconds), outputStructType=ddl, outputMode="append", timeMode="EventTime"
    )


def stream_lockouts(logins: DataFrame, delay: str | None = None, idle_seconds: int | None = None) -> DataFrame:
    """``user_id, ts, seq, ok`` → failed attempts and lock after every login."""
    ddl = "user_id long, us long, seq long, failed_attempts long, locked boolean, locked_until_us long"
    return _apply(logins, "user_id", Lockout(), ddl, "ok", delay=delay, idle_seconds=idle_seconds)


def stream_circuits(outcomes: DataFrame, delay: str | None = None, idle_seconds: int | None = None) -> DataFrame:
    """``provider, ts, seq, ok`` → failures, circuit state and reset time after every call."""
    ddl = "provider string, us long, seq long, failures long, circuit_open boolean, reset_seconds long"
    return _apply(outcomes, "provider", Circuit(), ddl, "ok", delay=delay, idle_seconds=idle_seconds)


def stream_memo(calls: DataFrame, delay: str | None = None) -> DataFrame:
    """``key, ts, seq`` → whether the memo table answers the call."""
    return _apply(calls, "key", Memo(), "key string, us long, seq long, hit boolean", delay=delay)


def stream_alert_hold(breaches: DataFrame, delay: str | None = None) -> DataFrame:
    """``rule, ts, seq, breach, hold`` → alert state after every evaluation.

    In event time also a row without ``seq`` when a breach has lasted long enough between two evaluations.
    """
    ddl = "rule string, us long, seq long, since_us long, firing boolean"
    return _apply(breaches, "rule", Hold(), ddl, "breach", "hold", delay=delay)


def stream_revocations(uses: DataFrame, delay: str) -> DataFrame:
    """``token, ts, seq, ttl_seconds`` → whether a request's token is revoked.

    Revocations and requests in one stream; those with a ``ttl_seconds`` revoke their token for
    so long. A token keeps one number, so each row costs one update however often it was revoked.
    """
    until = F.unix_micros("ts") + F.col("ttl_seconds") * MICROS
    rows = uses.select(F.sha2("token", 256).alias("token"), "ts", "seq", until.cast("long").alias("until"))
    return _apply(rows, "token", Revocation(), "token string, us long, seq long, revoked boolean", "until", delay=delay)


def alert_hold(breaches: DataFrame) -> DataFrame:
    """Batch form: an alert fires once its breach has lasted ``hold`` seconds without a gap."""
    order = ["_us", "seq"]
    logs = in_ranges(breaches.withColumn("_us", F.unix_micros("ts")), ["rule"], order)
    logs = running(
        logs, ["rule"], order, RANGE, _gap=Running("sum", F.when(~F.col("breach"), 1).otherwise(0))
    )
    logs = running(
        logs, ["rule", "_gap"], order, RANGE, _since=Running("min", F.when(F.col("breach"), F.col("_us")))
    )
    since = F.when(F.col("breach"), F.col("_since"))
    firing = F.coalesce(F.col("_us") - since >= F.col("hold").cast("bigint") * MICROS, F.lit(False))
    return logs.select(*breaches.columns, since.alias("since_us"), firing.alias("firing"))


def memo_lookup(
    calls: DataFrame, memo: DataFrame, key: str = "key", ttl: int = MEMO_TTL_SECONDS
) -> DataFrame:
    """Batch form against a memo table: is the latest stored response younger than the TTL?

    An as-of join as one sorted union: each call looks back to the last store of
    its key.
    """
    rows = calls.withColumn("_stored", F.lit(None).cast("long")).withColumn("_kind", F.lit(1))
    stores = memo.select(
        *[F.col(c) if c in memo.columns else F.lit(None).cast(calls.schema[c].dataType).alias(c) for c in calls.columns]
    )
    stores = stores.withColumn("_stored", F.unix_micros("ts")).withColumn("_kind", F.lit(0))
    both = rows.unionByName(stores).withColumns({"_us": F.unix_micros("ts"), "_seq": F.coalesce("seq", F.lit(0))})
    order = ["_us", "_kind", "_seq"]
    looked = running(in_ranges(both, [key], order), [key], order, RANGE, _last=Running("last", F.col("_stored")))
    hit = F.coalesce(F.col("_us") - F.col("_last") < ttl * MICROS, F.lit(False))
    return looked.where("_kind = 1").select(*calls.columns, hit.alias("hit"))


def limited_requests(requests: DataFrame, window_seconds: int, limit: Column | int) -> DataFrame:
    """Which requests exceed the fixed-window limit: the position within the client's window."""
    bound = F.lit(limit) if isinstance(limit, int) else limit
    rows = requests.withColumns(
        {"_us": F.unix_micros("ts"), "_window": time_chunk(F.col("ts"), window_seconds)}
    )
    keys, order = ["client", "_window"], ["_us", "seq"]
    counted = running(in_ranges(rows, keys, order), keys, order, RANGE, position=Running("sum", F.lit(1)))
    return counted.withColumn("rejected", F.col("position") > bound).drop("_us", "_window", RANGE)
