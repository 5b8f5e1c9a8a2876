"""Labeled samples, and evaluation runs at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = (
    "file string, language string, category string, "
    "expected_findings array<struct<cwe_id:string,vulnerability_type:string,severity:string,min_confidence:double>>, "
    "description string"
)
FINDING = "array<struct<cwe_id:string,vulnerability_type:string,severity:string>>"
MISSING = "Could not load sample code"


def load_manifest(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Sample manifests: a JSON array per file, or one JSON object per line."""
    return spark.read.schema(MANIFEST).option("multiLine", str(multi_line).lower()).json(path)


def load_benchmark(manifest: DataFrame, samples: DataFrame) -> DataFrame:
    """Manifest entries with their code; a missing or empty sample becomes an error row."""
    joined = manifest.join(samples.select(F.col("file"), "content"), "file", "left")
    usable = F.coalesce(F.col("content") != "", F.lit(False))
    return joined.withColumns(
        {
            "parser_success": usable,
            "error": F.when(~usable, F.lit(MISSING)),
            "language": F.coalesce("language", F.lit("python")),
        }
    )


def benchmark_results(samples: DataFrame, findings: DataFrame) -> DataFrame:
    """Result rows: expected and actual findings per sample.

    At most one finding per rule reaches a sample, so the array stays as small
    as the rule list.
    """
    actual = findings.groupBy(F.col("file_id").alias("file")).agg(
        F.sort_array(F.collect_list(F.struct("cwe_id", "vulnerability_type", "severity"))).alias("actual_findings")
    )
    expected = F.transform(
        "expected_findings",
        lambda e: F.struct(e["cwe_id"].alias("cwe_id"), e["vulnerability_type"].alias("vulnerability_type"), e["severity"].alias("severity")),
    )
    return samples.join(actual, "file", "left").select(
        F.col("file").alias("sample_name"),
        "category",
        F.coalesce(expected, F.array().cast(FINDING)).alias("expected_findings"),
        F.coalesce("actual_findings", F.array().cast(FINDING)).alias("actual_findings"),
        "parser_success",
        "error",
    )


def save_run(metrics: DataFrame, path: str, run_id: str, is_baseline: bool = False) -> None:
    """Write the metrics of a run below its id; writing the same run again replaces it."""
    (
        metrics.withColumn("is_baseline", F.lit(is_baseline))
        .coalesce(1)
        .write.mode("overwrite")
        .json(f"{path}/run_id={run_id}")
    )


def load_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, is_baseline boolean, run_id string").json(path)
