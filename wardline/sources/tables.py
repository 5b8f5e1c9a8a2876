"""Modeled tables at rest, and the append sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import jsonx
from ..functions import severity as sev
from ..operators import sets

BUCKETS = 64


def load_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Scan of a table with its declared schema; nothing is inferred."""
    declared = schemas.TABLES.get(schema, schema) if isinstance(schema, str) else schema
    return spark.read.schema(declared).parquet(path)


def findings_rows(detected: DataFrame) -> DataFrame:
    """Detector rows as rows of the findings table.

    Severity keeps only the five names, confidence becomes a whole percent, and
    all fields without a column of their own go to the metadata with their types.
    """
    names = set(detected.columns)
    target = schemas.struct(schemas.FINDINGS)

    def has(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in names else F.lit(None).cast(kind)

    own = {*target.fieldNames(), "file_id", "analysis_id_bucket"}
    extra = {c: F.col(c) for c in detected.columns if c not in own}
    kind = F.coalesce(has("vulnerability_type"), F.lit("Unknown"))
    line = F.coalesce(has("line_start", "int"), F.lit(0))
    # a null field takes part as null; all detector fields do, so that two findings of a line differ
    ident = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(names)]), {"ignoreNullFields": "false"}), 256)
    values = {
        "id": F.left(ident, F.lit(36)),
        "code_file_id": has("code_file_id").cast("string") if "code_file_id" in names else has("file_id").cast("string"),
        "project_id": has("project_id").cast("string"),
        "analysis_id": has("analysis_id").cast("string"),
        "analyzer_type": F.coalesce(has("analyzer_type"), F.lit("sast")),
        "vulnerability_type": kind,
        "severity": sev.stored_severity(F.coalesce(has("severity"), F.lit("medium"))),
        "title": F.coalesce(has("title"), has("vulnerability_type"), F.lit("Unknown Vulnerability")),
        "description": F.coalesce(has("description"), has("explanation"), F.lit("")),
        "cwe_id": has("cwe_id"),
        "cvss_score": has("cvss_score").try_cast("double"),
        "cve_id": has("cve_id"),
        "file_path": F.coalesce(has("file_path"), F.lit("unknown")),
        "line_start": line,
        "line_end": F.coalesce(has("line_end", "int"), line),
        "code_snippet": F.coalesce(has("code_snippet"), F.lit("")),
        "status": F.lit("new"),
        "confidence": sev.confidence_pct(has("confidence", "double")),
        "finding_metadata": jsonx.leftover_metadata(extra, target.fieldNames()),
        "explanation": has("explanation"),
        "explanation_provider": has("explanation_provider"),
        "explanation_generated_at": has("explanation_generated_at", "timestamp"),
    }
    return detected.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in target])


def scan_bucket(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def append_findings(detected: DataFrame, path: str) -> None:
    """Append to the findings table, partitioned by scan bucket.

    The rows are rebalanced by bucket: small buckets share a task, and the bucket
    of a scan with very many findings is split over several.
    """
    rows = findings_rows(detected).withColumn("analysis_id_bucket", scan_bucket("analysis_id"))
    (
        rows.hint("rebalance", "analysis_id_bucket")
        .sortWithinPartitions("analysis_id_bucket", "analysis_id")
        .write.mode("append")
        .partitionBy("analysis_id_bucket")
        .parquet(path)
    )


def seed_if_missing(existing: DataFrame, new: DataFrame, key: str = "slug") -> DataFrame:
    """The rows of ``new`` whose key is not there yet, one per key."""
    return sets.missing_keys(new, existing, key).dropDuplicates([key])


def append_events(events: DataFrame, path: str) -> None:
    """Append to the event log, partitioned by day."""
    target = schemas.struct(schemas.SYSTEM_EVENTS)
    rows = events.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target])
    rows.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)
