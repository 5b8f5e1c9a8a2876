"""Headline queries at one scale; prints one JSON line.

    BENCH_SF_DIR   table folder, default /root/testdata/sf0.1
    BENCH_CPUS     local cores, default 8
    BENCH_QUERIES  comma-separated names instead of the headline list
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from wardline.functions import text
from wardline.plans.catalog import QUERIES
from wardline.plans.fixtures import view
from wardline.session import build_session

HEADLINE = [
    "p03_search_ilike",
    "p04_visible_analyses",
    "j04_with_fixes",
    "j07_attach_enrichment",
    "j12_annotate_lines",
    "a04_severity_counts",
    "a06_class_metrics",
    "a06_class_severity",
    "a09_dashboard",
    "a23_latency_quantiles",
    "w01_dedup_findings",
    "w06_lockouts",
    "l01_page",
    "l03_latest_scans",
    "f10_json_from_text",
    "d01_regex_scan_documents",
    "d01_regex_scan_programs",
    "d03_benchmark_scan",
    "d04_python_ast_scan",
    "d06_taint_findings",
    "d07_normalize_raw_findings",
    "d11_scan_corpus",
    "d11_scan_job",
    "m01_enrollment_upsert",
    "s07_append_findings",
    "t01_request_rate",
    "t07_lockouts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench", cpus, **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the code generator and the Python workers before the clock runs.
    warm = spark.range(1000).select(F.col("id").cast("string").alias("id"))
    warm.mapInArrow(lambda batches: batches, "id string").groupBy("id").count().write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    out = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    if "d01_regex_scan_documents" in times:
        size = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.sum(F.length("text"))).first()[0]
        out["d01_chars_per_sec"] = round(size / times["d01_regex_scan_documents"])
    if "d11_scan_job" in times:
        programs = view(spark, sf_dir, "v_programs").select(text.line_count(F.col("content")).alias("n"))
        lines = programs.agg(F.sum("n")).first()[0]
        out["scan_job_lines_per_sec"] = round(lines / times["d11_scan_job"])
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
