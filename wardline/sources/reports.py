"""Report export and raw detector output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates
from .tables import scan_bucket

RAW_FINDING = (
    "vulnerability_type string, severity string, cwe_id string, file_path string, line_number int, "
    "line_start int, line_end int, code_snippet string, description string, confidence double, "
    "analyzer_type string"
)


def report_records(analyses: DataFrame, findings: DataFrame, fixes: DataFrame) -> DataFrame:
    """A report as JSON records: the scan with its summary, its findings, their fixes.

    One record per object and not one document per scan, so that a scan with
    very many findings never has to fit into a single value. Records carry the
    scan id and sort as scan, findings, fixes.
    """
    summary = aggregates.severity_counts(findings, "analysis_id").withColumn(
        "total_findings", sum((F.col(c) for c in ("high", "medium", "low", "info")), F.col("critical"))
    )
    levels = ["critical", "high", "medium", "low", "info", "total_findings"]
    scans = analyses.join(summary, "analysis_id", "left").fillna(0, levels)
    detail = ["finding_id", "vulnerability_type", "severity", "cwe_id", "file_path", "line_start", "status", "confidence"]
    fix_detail = ["fix_id", "finding_id", "title", "description", "code_before", "code_after", "language"]
    scan_rows = scans.select(
        "analysis_id",
        F.lit(0).alias("part"),
        F.to_json(F.struct("analysis_id", "status", F.struct(*levels).alias("summary"))).alias("record"),
    )
    finding_rows = findings.select("analysis_id", F.lit(1).alias("part"), F.to_json(F.struct(*detail)).alias("record"))
    fix_rows = fixes.join(findings.select("finding_id", "analysis_id"), "finding_id").select(
        "analysis_id", F.lit(2).alias("part"), F.to_json(F.struct(*fix_detail)).alias("record")
    )
    return scan_rows.unionByName(finding_rows).unionByName(fix_rows)


def export_reports(records: DataFrame, path: str) -> None:
    """Compressed JSON lines by scan bucket, each bucket sorted by scan and part."""
    (
        records.withColumn("bucket", scan_bucket("analysis_id"))
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "analysis_id", "part")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .json(path, compression="gzip")
    )


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("analysis_id string, part int, record string, bucket int").json(path)


def read_scanner_lines(spark: SparkSession, path: str) -> DataFrame:
    """Findings out of detector logs: JSON lines that name a vulnerability type."""
    return parse_scanner_lines(spark.read.text(path), "value")


def parse_scanner_lines(lines: DataFrame, column: str) -> DataFrame:
    """Keep the lines that are JSON objects with a vulnerability type; drop broken ones."""
    line = F.trim(F.regexp_replace(column, r"^\s+|\s+$", ""))
    kept = lines.withColumn("_line", line).where(
        F.col("_line").startswith("{")
        & F.col("_line").contains('"vulnerability_type"')
        & F.col("_line").rlike(r"\}$")
        & F.try_parse_json("_line").isNotNull()
    )
    parsed = F.from_json("_line", RAW_FINDING, {"mode": "PERMISSIVE"})
    return kept.withColumn("_f", parsed).select(*[c for c in lines.columns if c != column], "_f.*")
