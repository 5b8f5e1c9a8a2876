"""Deduplication, first and latest rows, ordering and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.severity import severity_rank
from .prefix import RANGE, Running, in_ranges, running


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None
) -> DataFrame:
    """The first ``n`` rows per key.

    The rank filter becomes a group limit before the shuffle: each task sends at
    most ``n`` rows per key, however hot the key is.
    """
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def dedup_findings(findings: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """One row per (cwe, file, line): highest confidence, the earliest of ties.

    ``seq`` is anything that has an order. The first data flow of the group is kept, also from a row that loses. Both
    picks are aggregates, so copies of one finding shrink before the shuffle. ``columns``
    names what is wanted of a winner, all by default; the others don't move with it.
    """
    wanted = list(findings.columns if columns is None else columns)
    moved = [c for c in wanted if c not in keys] or ["cwe_id"]
    group = {
        **{k: F.col(k) for k in keys},
        "_cwe": F.coalesce("cwe_id", F.lit("unknown")),
        "_file": F.coalesce("file_path", F.lit("unknown")),
        "_line": F.coalesce("line_start", F.lit(0)),
    }
    ordered = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), F.col("seq").isNull().alias("n"), "seq")
    flow_seq = F.when(F.col("data_flow").isNotNull(), F.col("seq"))
    picked = (
        findings.groupBy(*[c.alias(f"_k{i}") for i, c in enumerate(group.values())])
        .agg(
            F.min_by(F.struct(*moved), ordered).alias("_best"),
            F.min_by("data_flow", flow_seq).alias("_flow"),
        )
        .select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "_best.*", "_flow")
    )
    picked = picked.withColumn("data_flow", F.coalesce("data_flow", "_flow")) if "data_flow" in wanted else picked
    return picked.select(*wanted)


def one_per_line(findings: DataFrame) -> DataFrame:
    """One pattern finding per (file, rule, line)."""
    return findings.dropDuplicates(["file_id", "rule", "line_start"])


def first_per(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the smallest order value per key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The current row per key of a change log."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
    )


def lockouts(logins: DataFrame, limit: int = 5, minutes: int = 15) -> DataFrame:
    """Failed-login counter and lock per login, in event order.

    Input ``user_id, ts, seq, ok``. A success resets the counter, except while
    the account is locked: then it counts as one more failure and extends the
    lock. Once locked, every login inside the lock counts; a success after a
    pause of at least the lock time resets.

    So a user's log falls into segments that begin at a success after a pause.
    Within a segment failures count from the last success until the limit is
    reached, and from there on every login adds one. All of these are running
    values, over ranges of rows for hot users; the three scans share one exchange.
    """
    order = ["_us", "seq"]
    logs = in_ranges(logins.withColumn("_us", F.unix_micros("ts")), ["user_id"], order)
    logs = running(
        logs,
        ["user_id"],
        order,
        RANGE,
        _prev=Running("last", F.col("_us"), exclusive=True),
        _pos=Running("sum", F.lit(1)),
        _fails=Running("sum", F.when(~F.col("ok"), 1).otherwise(0)),
    )
    pause = F.coalesce(F.col("_us") - F.col("_prev") >= minutes * 60_000_000, F.lit(True))
    logs = running(
        logs,
        ["user_id"],
        order,
        RANGE,
        _segment=Running("sum", F.when(F.col("ok") & pause, 1).otherwise(0)),
        _base=Running("max", F.when(F.col("ok"), F.col("_fails"))),
    )
    logs = logs.withColumn("_run", F.col("_fails") - F.coalesce("_base", F.lit(0)))
    logs = running(
        logs,
        ["user_id", "_segment"],
        order,
        RANGE,
        _locked_at=Running("min", F.when(F.col("_run") >= limit, F.col("_pos"))),
    )
    count = F.when(
        F.col("_locked_at").isNotNull(), F.lit(limit) + F.col("_pos") - F.col("_locked_at")
    ).otherwise(F.col("_run"))
    out = logs.withColumn("failed_attempts", count.cast("bigint"))
    return out.select(
        *logins.columns,
        "failed_attempts",
        (F.col("failed_attempts") >= limit).alias("locked"),
        F.when(
            F.col("failed_attempts") >= limit, F.timestamp_micros(F.col("_us") + minutes * 60_000_000)
        ).alias("locked_until"),
    )


def page(df: DataFrame, order: Sequence[Column], skip: int = 0, limit: int = 20) -> DataFrame:
    """One page, newest first, with its paging numbers; ``order`` must end in a unique column."""
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = df.orderBy(*order).offset(skip).limit(limit)
    return rows.withColumns(
        {
            "total": total,
            "page": F.lit(skip // limit + 1),
            "page_size": F.lit(limit),
        }
    ).withColumn("total_pages", F.ceil(F.col("total") / limit).cast("bigint"))


def order_findings(findings: DataFrame, by: str = "severity", ascending: bool = False) -> DataFrame:
    """Panel order. Descending severity puts info first; ascending is most severe first."""
    key = {
        "severity": severity_rank(F.col("severity")),
        "file": F.col("file_path"),
        "type": F.col("vulnerability_type"),
    }[by]
    return findings.orderBy(key.asc() if ascending else key.desc(), "finding_id")


ACTIVITY_TYPES = {
    "completed": "scan_completed",
    "running": "scan_started",
    "failed": "vulnerability_found",
}


def activity_type(status: Column) -> Column:
    from ..functions.literal import lookup

    return F.coalesce(lookup(ACTIVITY_TYPES, status), F.lit(ACTIVITY_TYPES["running"]))
