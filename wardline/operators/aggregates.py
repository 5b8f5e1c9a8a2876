"""Report aggregates. All of them combine on the map side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import severity as sev
from . import filters, joins
from .ranking import top_per_group


def count_where(df: DataFrame, **conditions: object) -> DataFrame:
    return filters.where_eq(df, **conditions).agg(F.count(F.lit(1)).alias("n"))


def exists_where(df: DataFrame, **conditions: object) -> DataFrame:
    """One row; the limit stops the scan at the first hit."""
    hit = filters.where_eq(df, **conditions).limit(1)
    return hit.agg((F.count(F.lit(1)) > 0).alias("found"))


def severity_level(col: Column) -> Column:
    """Severity as grouped in reports: lower case, unknown counts as medium."""
    return sev.stored_severity(F.coalesce(col, F.lit("medium")))


def severity_counts(findings: DataFrame, *keys: str) -> DataFrame:
    """One zero-filled column per level."""
    level = severity_level(F.col("severity"))
    counts = [F.count_if(level == name).alias(name) for name in sev.LEVELS]
    return findings.groupBy(*keys).agg(*counts)


def counts_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def class_scans(analyses: DataFrame, enrollments: DataFrame, latest: int | None = None) -> DataFrame:
    """The scans of every class, all of them or the ``latest`` newest."""
    members = enrollments.where(F.col("status") == "active").select("class_id", F.col("student_id").alias("user_id"))
    scans = analyses.select("analysis_id", "user_id", "created_at").join(members, "user_id")
    if latest is None:
        return scans
    return top_per_group(scans, ["class_id"], [F.col("created_at").desc(), F.col("analysis_id")], latest)


def class_metrics(
    classes: DataFrame,
    enrollments: DataFrame,
    analyses: DataFrame,
    findings: DataFrame,
    kind: str = "vulnerability_type",
    latest: int | None = None,
) -> DataFrame:
    """Every class at once: students, scans, findings by severity, average, top five types.

    Findings are read and joined once and counted per (class, type) with a column
    per level; totals and the top list come from these counts.
    """
    scans = class_scans(analyses, enrollments, latest)
    level = severity_level(F.col("severity"))
    types = (
        findings.select("analysis_id", level.alias("severity"), kind)
        .join(scans.select("class_id", "analysis_id"), "analysis_id")
        .groupBy("class_id", kind)
        .agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("severity") == s).alias(s) for s in sev.LEVELS])
    )
    rank = F.row_number().over(W.partitionBy("class_id").orderBy(F.col("n").desc(), kind))
    top = F.sort_array(F.collect_list(F.when(F.col("_rank") <= 5, F.struct("_rank", F.col(kind).alias("type"), "n"))))
    totals = (
        types.withColumn("_rank", rank)
        .groupBy("class_id")
        .agg(F.sum("n").alias("total_findings"), *[F.sum(s).alias(s) for s in sev.LEVELS], top.alias("_top"))
        .withColumn(
            "top_types",
            F.array_join(F.transform("_top", lambda t: F.concat(t["type"], F.lit(":"), t["n"].cast("string"))), ","),
        )
        .drop("_top")
    )
    n_scans = scans.groupBy("class_id").agg(F.count(F.lit(1)).alias("total_scans"))
    out = (
        joins.with_student_count(classes, enrollments)
        .withColumnRenamed("student_count", "total_students")
        .join(n_scans, "class_id", "left")
        .join(totals, "class_id", "left")
        .fillna(0, ["total_scans", "total_findings", *sev.LEVELS])
    )
    average = F.bround(F.col("total_findings") / F.greatest(F.col("total_students"), F.lit(1)), 1)
    return out.withColumn("avg_findings_per_student", average)


def scan_summary(findings: DataFrame) -> DataFrame:
    """Counts per scan by detector family, and the method they imply."""
    ai = F.col("stage") == 2
    flow = (F.col("stage") == 1) & (F.col("analyzer_type") == "sast-js")
    return (
        findings.groupBy("analysis_id")
        .agg(
            F.count(F.lit(1)).alias("total_findings"),
            F.count_if(flow).alias("sast_findings"),
            F.count_if(~ai & ~flow).alias("ast_findings"),
            F.count_if(ai).alias("ai_findings"),
        )
        .withColumn(
            "scan_method", F.when(F.col("sast_findings") > 0, "sast+taint").otherwise("direct_ast")
        )
    )


def dashboard(analyses: DataFrame, findings: DataFrame, owner: str = "user_id", last: int | None = None) -> DataFrame:
    """Totals and security score over the scans of every owner, all of them or the ``last`` newest."""
    recent = analyses.select(owner, "analysis_id", "created_at", "file_count")
    if last is not None:
        recent = top_per_group(recent, [owner], [F.col("created_at").desc(), F.col("analysis_id")], last)
    files = recent.groupBy(owner).agg(F.sum("file_count").alias("total_code_files"))
    levels = ["critical", "high", "medium", "low"]
    counts = (
        findings.select("analysis_id", "severity")
        .join(recent.select(owner, "analysis_id"), "analysis_id")
        .groupBy(owner)
        .agg(*[F.count_if(F.col("severity") == s).alias(s) for s in levels])
    )
    return (
        files.join(counts, owner, "left")
        .fillna(0, levels)
        .withColumn("total_vulnerabilities", sum((F.col(s) for s in levels[1:]), F.col(levels[0])))
        .withColumn("security_score", sev.security_score(*[F.col(s) for s in levels]))
    )


def severity_shares(findings: DataFrame, *keys: str) -> DataFrame:
    """Whole percent of four levels; 0 without findings."""
    levels = ["critical", "high", "medium", "low"]
    total = sum((F.col(s) for s in levels[1:]), F.col(levels[0]))
    share = {
        f"{s}_pct": F.when(total > 0, sev.half_up(F.col(s) / total * 100)).otherwise(F.lit(0).cast("bigint"))
        for s in levels
    }
    return severity_counts(findings, *keys).withColumns(share)


def severity_chart(findings: DataFrame, *keys: str) -> DataFrame:
    """Bar height against the largest level, and running offset of the ring segments.

    The window sees five rows per key, the counts.
    """
    counts = severity_counts(findings, *keys)
    bars = counts.unpivot(list(keys), sev.LEVELS, "severity", "count").withColumn(
        "rank", sev.severity_rank(F.col("severity"))
    )
    group = W.partitionBy(*keys)
    before = group.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("count").over(group)
    return bars.withColumns(
        {
            "height": F.col("count") / F.greatest(F.max("count").over(group), F.lit(1)),
            "share": F.when(total > 0, F.col("count") / total).otherwise(0.0),
            "offset": F.when(total > 0, F.coalesce(F.sum("count").over(before), F.lit(0)) / total).otherwise(0.0),
        }
    )


def severity_groups(findings: DataFrame, *keys: str) -> DataFrame:
    """Findings in contiguous severity lists, sorted by key, level and sequence.

    A range-partitioned sort keeps each list together without putting a whole
    list into one value or task.
    """
    level = severity_level(F.col("severity"))
    return findings.withColumn("group", level).orderBy(
        *keys, sev.severity_rank(level), "seq"
    )


def usage_by_provider(calls: DataFrame) -> DataFrame:
    return calls.groupBy("provider").agg(
        F.count(F.lit(1)).alias("total_calls"),
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
        F.sum("cost").alias("total_cost"),
    )


def usage_by_day(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost").alias("cost"),
    )


def usage_with_availability(calls: DataFrame, states: DataFrame) -> DataFrame:
    """Usage beside the latest circuit state; a provider without one is available."""
    latest = states.groupBy("provider").agg(F.max_by("circuit_open", F.struct("ts", "seq")).alias("_open"))
    return (
        usage_by_provider(calls)
        .join(latest, "provider", "left")
        .withColumn("available", ~F.coalesce("_open", F.lit(False)))
        .drop("_open")
    )


def with_views(rows: DataFrame, views: DataFrame, key: str) -> DataFrame:
    """Counters plus the views of the event table."""
    seen = views.groupBy(key).agg(F.count(F.lit(1)).alias("_seen"))
    return (
        rows.join(seen, key, "left")
        .withColumn("view_count", F.coalesce("view_count", F.lit(0)) + F.coalesce("_seen", F.lit(0)))
        .drop("_seen")
    )


def platform_totals(users: DataFrame, analyses: DataFrame) -> DataFrame:
    return users.agg(F.count(F.lit(1)).alias("total_users")).withColumn(
        "total_scans", analyses.agg(F.count(F.lit(1))).scalar()
    )


def overall_status(services: DataFrame, *keys: str) -> DataFrame:
    bad = F.bool_or(F.col("status").isin("unhealthy", "degraded"))
    return services.groupBy(*keys).agg(F.when(bad, "degraded").otherwise("healthy").alias("overall"))


def instructor_totals(classes: DataFrame, enrollments: DataFrame) -> DataFrame:
    return joins.with_student_count(classes, enrollments).groupBy("instructor_id").agg(
        F.count(F.lit(1)).alias("total_classes"), F.sum("student_count").alias("total_students")
    )


def error_ratios(requests: DataFrame, *keys: str | Column) -> DataFrame:
    server, client = F.col("status").between(500, 599), F.col("status").between(400, 499)
    return requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(client).alias("n_4xx"),
        F.count_if(server).alias("n_5xx"),
        (F.count_if(server) / F.count(F.lit(1))).alias("error_ratio"),
    )


def hit_rate(lookups: DataFrame, *keys: str) -> DataFrame:
    hits = F.count_if("hit")
    return lookups.groupBy(*keys).agg((F.lit(100.0) * hits / F.count(F.lit(1))).alias("hit_rate_pct"))


def archive_audit(members: DataFrame, keys: Sequence[str] = ("archive",)) -> DataFrame:
    """Totals and violations per archive.

    As in validation, unsafe names and then too deep names are left out of the
    size and ratio checks.
    """
    from ..functions import checks

    unsafe = checks.member_is_unsafe(F.col("name"))
    depth = F.regexp_count("name", F.lit("/"))
    deep = ~unsafe & (depth > checks.MAX_ARCHIVE_DEPTH)
    kept = ~unsafe & ~deep
    ratio = F.when(
        kept & (F.col("size") > 0) & (F.col("compressed") > 0), F.col("size") / F.col("compressed")
    )
    stats = members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entries"),
        F.coalesce(F.sum(F.when(kept, F.col("size"))), F.lit(0)).alias("total_uncompressed"),
        F.max(ratio).alias("max_ratio"),
        F.max(depth).alias("max_depth"),
        F.count_if(unsafe).alias("unsafe_names"),
        F.count_if(deep).alias("deep_names"),
        F.count_if(ratio > checks.MAX_ARCHIVE_RATIO).alias("bomb_members"),
    )
    valid = (
        (F.col("entries") <= checks.MAX_ARCHIVE_ENTRIES)
        & (F.col("unsafe_names") == 0)
        & (F.col("deep_names") == 0)
        & (F.col("bomb_members") == 0)
        & (F.col("total_uncompressed") <= checks.MAX_ARCHIVE_BYTES)
    )
    return stats.withColumn("is_valid", valid)
