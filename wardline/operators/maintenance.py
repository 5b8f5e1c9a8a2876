"""Table changes: base and change set in, new snapshot out.

Plain Parquet has no update in place, so each operator returns the next
snapshot for the caller to write.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from .prefix import RANGE, Running, in_ranges, running

ENROLLMENT_KEY = ["class_id", "student_id"]


def _with_previous(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Every change with the status its key had just before it; null = no row yet."""
    after = F.when(F.col("action") == "join", F.lit("active")).when(F.col("action") == "leave", F.lit("dropped"))
    start = base.select(*ENROLLMENT_KEY, F.col("status").alias("_base"))
    order = ["_us", "seq"]
    logs = running(
        in_ranges(changes.withColumn("_us", F.unix_micros("ts")), ENROLLMENT_KEY, order),
        ENROLLMENT_KEY,
        order,
        RANGE,
        _prev=Running("last", after, exclusive=True),
        _joins=Running("sum", F.when(F.col("action") == "join", 1).otherwise(0), exclusive=True),
    ).join(start, ENROLLMENT_KEY, "left")
    # Leaving without a row creates none, so only an earlier join or the base makes one.
    known = F.col("_base").isNotNull() | (F.col("_joins") > 0)
    return logs.withColumn("previous", F.when(known, F.coalesce("_prev", "_base")))


def enrollment_rejects(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Joins while active, and leaves without an active enrollment."""
    logs = _with_previous(base, changes)
    is_active = F.coalesce(F.col("previous") == "active", F.lit(False))
    reason = F.when((F.col("action") == "join") & is_active, "already enrolled").when(
        (F.col("action") == "leave") & ~is_active, "not enrolled"
    )
    return logs.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(
        *changes.columns, "reason"
    )


def apply_enrollments(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Snapshot after joins and leaves: the last action of a key decides."""
    last = changes.groupBy(*ENROLLMENT_KEY).agg(
        F.max_by("action", F.struct("ts", "seq")).alias("_action"),
        F.bool_or(F.col("action") == "join").alias("_joined"),
    )
    status = F.when(F.col("_action") == "join", "active").when(F.col("_action") == "leave", "dropped").otherwise(
        F.col("status")
    )
    merged = base.join(last, ENROLLMENT_KEY, "full")
    exists = F.col("status").isNotNull() | F.coalesce("_joined", F.lit(False))
    return merged.where(exists).withColumn("status", status).drop("_action", "_joined")


def soft_delete(base: DataFrame, keys: DataFrame, key: str, flag: str = "is_active") -> DataFrame:
    gone = keys.select(key).distinct().withColumn("_gone", F.lit(True))
    return (
        base.join(gone, key, "left")
        .withColumn(flag, F.when(F.col("_gone"), F.lit(False)).otherwise(F.col(flag)))
        .drop("_gone")
    )


def partial_update(base: DataFrame, changes: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Change only the fields a change map names; a named null is written, an absent key is not.

    ``changes``: key, ``fields map<string,string>``, one row per key.
    """
    merged = base.join(changes.select(key, "fields"), key, "left")
    new = {
        c: F.when(
            F.coalesce(F.map_contains_key("fields", c), F.lit(False)),
            F.col("fields")[c].cast(base.schema[c].dataType),
        ).otherwise(F.col(c))
        for c in allowed
    }
    return merged.withColumns(new).drop("fields").select(*base.columns)


def hard_delete(parents: DataFrame, children: list[DataFrame], doomed: DataFrame, key: str) -> list[DataFrame]:
    """The parents and each child table without the doomed keys."""
    keys = doomed.select(key)
    return [df.join(keys, key, "left_anti") for df in (parents, *children)]


def repoint_files(files: DataFrame, rescans: DataFrame, metadata: str = "file_metadata") -> DataFrame:
    """Files of a rescanned scan now belong to the new scan; the old one loses them.

    ``rescans``: analysis_id, new_analysis_id, one row per scan.
    """
    moves = rescans.select(
        F.col("analysis_id").cast("string").alias("_old"), F.col("new_analysis_id").cast("string").alias("_new")
    )
    keyed = files.withColumn("_old", F.get_json_object(metadata, "$.analysis_id"))
    moved = jsonx.merge_json(F.col(metadata), {"analysis_id": F.col("_new")})
    return (
        keyed.join(moves, "_old", "left")
        .withColumn(metadata, F.when(F.col("_new").isNotNull(), moved).otherwise(F.col(metadata)))
        .select(*files.columns)
    )


def mark_fixed(findings: DataFrame, applied: DataFrame, metadata: str = "finding_metadata") -> DataFrame:
    """Status and metadata of findings whose fix was applied.

    ``applied``: finding_id, applied_fix, fixed_by, fixed_at (text).
    """
    fields: Mapping[str, Column] = {c: F.col(f"_{c}") for c in ("applied_fix", "fixed_by", "fixed_at")}
    marks = applied.select("finding_id", *[F.col(c).alias(f"_{c}") for c in fields])
    done = F.col("_fixed_by").isNotNull()
    return (
        findings.join(marks, "finding_id", "left")
        .withColumns(
            {
                "status": F.when(done, "fixed").otherwise(F.col("status")),
                metadata: F.when(done, jsonx.merge_json(F.col(metadata), fields)).otherwise(F.col(metadata)),
            }
        )
        .select(*findings.columns)
    )


def scan_lifecycle(events: DataFrame) -> DataFrame:
    """Latest status, start, end, summary and error per scan, also after retries."""
    running_at = F.when(F.col("status") == "running", F.col("ts"))
    ended_at = F.when(F.col("status").isin("completed", "failed"), F.col("ts"))
    return events.groupBy("scan_id").agg(
        F.max_by("status", F.struct("ts", "seq")).alias("status"),
        F.max(running_at).alias("started_at"),
        F.max(ended_at).alias("completed_at"),
        F.max_by("summary", F.when(F.col("summary").isNotNull(), F.struct("ts", "seq"))).alias("summary"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.struct("ts", "seq"))).alias("error"),
    )


def update_scans(analyses: DataFrame, events: DataFrame) -> DataFrame:
    """Scan table after status events; a scan without events is unchanged."""
    now = scan_lifecycle(events).select(
        F.col("scan_id").alias("analysis_id"),
        *[F.col(c).alias(f"_{c}") for c in ("status", "started_at", "completed_at", "summary", "error")],
    )
    merged = analyses.join(now, "analysis_id", "left")
    new = {
        c: F.coalesce(F.col(f"_{c}"), F.col(c))
        for c in ("status", "started_at", "completed_at", "summary", "error")
    }
    return merged.withColumns(new).select(*analyses.columns)
