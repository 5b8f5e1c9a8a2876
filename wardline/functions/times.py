"""Time-dependent states. ``now`` is always a column, never the wall clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000.0)


def _whole(value: Column) -> Column:
    return F.floor(value).cast("bigint").cast("string")


def time_ago(ts: Column, now: Column) -> Column:
    seconds = F.floor(_seconds(now, ts))
    return (
        F.when(seconds < 60, F.lit("just now"))
        .when(seconds < 3600, F.concat(_whole(seconds / 60), F.lit("m ago")))
        .when(seconds < 86400, F.concat(_whole(seconds / 3600), F.lit("h ago")))
        .otherwise(F.concat(_whole(seconds / 86400), F.lit("d ago")))
    )


def uptime_text(seconds: Column) -> Column:
    days = F.floor(seconds / 86400)
    hours = F.floor((seconds % 86400) / 3600)
    minutes = F.floor((seconds % 3600) / 60)
    return (
        F.when(days > 0, F.concat(_whole(days), F.lit("d "), _whole(hours), F.lit("h")))
        .when(hours > 0, F.concat(_whole(hours), F.lit("h "), _whole(minutes), F.lit("m")))
        .otherwise(F.concat(_whole(minutes), F.lit("m")))
    )


def scan_progress(status: Column, done: Column, total: Column) -> Column:
    """Missing counters read as 0 of 1."""
    done, total = F.coalesce(done, F.lit(0)), F.coalesce(total, F.lit(1))
    running = F.when(total > 0, F.least(F.lit(0.95), done / total)).otherwise(F.lit(0.5))
    return (
        F.when(status == "running", running)
        .when(status == "completed", F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def scan_stage(status: Column) -> Column:
    return (
        F.when(status == "running", F.lit("analyzing"))
        .when(status.isin("completed", "failed"), status)
        .otherwise(F.lit("pending"))
    )


def is_locked(locked_until: Column, now: Column) -> Column:
    return F.coalesce(locked_until > now, F.lit(False))


def lock_minutes_left(locked_until: Column, now: Column) -> Column:
    """Whole minutes left, at least 1 while locked, else 0."""
    left = _seconds(locked_until, now)
    return F.when(left > 0, F.greatest(F.lit(1), F.floor(left / 60).cast("int"))).otherwise(F.lit(0))


def share_expiry(created: Column, hours: Column) -> Column:
    """Null or zero hours never expire."""
    expiry = created + F.make_dt_interval(hours=hours)
    return F.when(F.coalesce(hours, F.lit(0)) != 0, expiry)


def share_state(token: Column, revoked: Column, expires: Column, now: Column) -> Column:
    return (
        F.when(token.isNull(), F.lit("missing"))
        .when(revoked, F.lit("revoked"))
        .when(F.coalesce(expires < now, F.lit(False)), F.lit("expired"))
        .otherwise(F.lit("valid"))
    )


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
