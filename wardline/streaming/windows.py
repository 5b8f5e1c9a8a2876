"""Windowed rates, ratios, quantiles, limits and counters.

Each function is a plain DataFrame transformation: on a stream, add the
watermark with ``watermarked`` first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literal import literal_table
from ..operators.prefix import RANGE, Running, in_ranges, running

# Fixed values.
RATE_WINDOW = "5 minutes"
EVALUATION = "15 seconds"
ERROR_RATIO_LIMIT = 0.05
LATENCY_LIMIT = 2.0
#: Rows that a latency sketch holds exactly.
SKETCH_SIZE = 4096
DEFAULT_LIMIT = 100
LIMIT_WINDOW = "60 seconds"
ROUTE_LIMITS = {
    "/auth/register": 5,
    "/auth/login": 5,
    "/auth/forgot-password": 3,
    "/auth/reset-password": 3,
    "/guest": 10,
}
GAUGE_RULES = [
    {"rule": "ScanQueueBacklog", "gauge": "scans_pending", "op": ">", "bound": 50.0, "hold": 600, "level": "warning"},
    {"rule": "WorkspaceDiskSpaceHigh", "gauge": "workspace_disk_free_ratio", "op": "<", "bound": 0.20, "hold": 300, "level": "warning"},
    {"rule": "HighMemoryUsage", "gauge": "memory_free_ratio", "op": "<", "bound": 0.15, "hold": 600, "level": "warning"},
    {"rule": "DiskSpaceLow", "gauge": "disk_free_ratio", "op": "<", "bound": 0.10, "hold": 300, "level": "critical"},
    {"rule": "ProcessDown", "gauge": "up", "op": "=", "bound": 0.0, "hold": 120, "level": "critical"},
    {"rule": "ConnectionSaturation", "gauge": "connection_ratio", "op": "<", "bound": 1.2, "hold": 300, "level": "warning"},
    {"rule": "CacheMemoryHigh", "gauge": "cache_memory_ratio", "op": ">", "bound": 0.85, "hold": 600, "level": "warning"},
]
GAUGE_DDL = "rule string, gauge string, op string, bound double, hold int, level string"


def read_stream(spark: SparkSession, path: str, schema: object, bytes_per_trigger: int = 1 << 28) -> DataFrame:
    """A table folder as a stream; the trigger size bounds what one batch holds."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", str(bytes_per_trigger)).parquet(path)


def watermarked(df: DataFrame, ts: str = "ts", delay: str = "1 minute") -> DataFrame:
    return df.withWatermark(ts, delay) if df.isStreaming else df


def _sliding(counts: DataFrame, by: Sequence[str], window: str, slide: str, sums: Sequence[str]) -> DataFrame:
    """Sums per sliding window from sums per slide bucket."""
    windows = F.window(F.window_time("bucket"), window, slide)
    return counts.groupBy(windows.alias("window"), *by).agg(*[F.sum(c).alias(c) for c in sums])


def request_rate(
    requests: DataFrame, by: Sequence[str] = (), window: str = RATE_WINDOW, slide: str = EVALUATION, seconds: int = 300
) -> DataFrame:
    """Requests per second in a sliding window.

    Rows are first counted per slide bucket, and only the counts are copied into
    the windows that overlap them.
    """
    buckets = requests.groupBy(F.window("ts", slide).alias("bucket"), *by).agg(F.count(F.lit(1)).alias("n"))
    return _sliding(buckets, by, window, slide, ["n"]).withColumn("rate", F.col("n") / seconds)


def error_ratio(
    requests: DataFrame, by: Sequence[str] = (), window: str = RATE_WINDOW, slide: str = EVALUATION
) -> DataFrame:
    """Share of server errors per sliding window, and whether it breaches the limit."""
    buckets = requests.groupBy(F.window("ts", slide).alias("bucket"), *by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").between(500, 599)).alias("errors")
    )
    out = _sliding(buckets, by, window, slide, ["n", "errors"])
    ratio = F.col("errors") / F.col("n")
    return out.withColumns({"ratio": ratio, "breach": ratio > ERROR_RATIO_LIMIT})


def latency_quantiles(
    requests: DataFrame, by: Sequence[str] = (), window: str = RATE_WINDOW, slide: str = EVALUATION, size: int = SKETCH_SIZE
) -> DataFrame:
    """p50, p95 and p99 per sliding window, and the p95 breach.

    Rows are summarized once, in a KLL sketch for each slide bucket; only sketches are
    copied into the windows that overlap a bucket, and merged there. Sketches of up to
    ``size`` rows are exact, beyond that a quantile's rank is off by about 2.3 / size of
    the rows (with 4096: 0.06 %).
    """
    buckets = requests.groupBy(F.window("ts", slide).alias("bucket"), *by).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col("duration").cast("double"), size).alias("_sketch")
    )
    windows = F.window(F.window_time("bucket"), window, slide)
    out = buckets.groupBy(windows.alias("window"), *by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("_sketch", size).alias("_sketch"))
    at = lambda q: F.kll_sketch_get_quantile_double("_sketch", F.lit(q))
    out = out.select("window", *by, "n", at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))
    return out.withColumn("breach", F.col("p95") > LATENCY_LIMIT)


def gauge_breaches(gauges: DataFrame, rules: Sequence[Mapping] = GAUGE_RULES) -> DataFrame:
    """Every gauge reading against the rules on that gauge."""
    table = literal_table(gauges.sparkSession, rules, GAUGE_DDL)
    value, bound = F.col("value"), F.col("bound")
    breach = (
        F.when(F.col("op") == ">", value > bound).when(F.col("op") == "<", value < bound).otherwise(value == bound)
    )
    return gauges.join(table, "gauge").withColumn("breach", breach)


def route_limit(route: Column) -> Column:
    out = F.lit(DEFAULT_LIMIT)
    for path, limit in ROUTE_LIMITS.items():
        out = F.when(route == path, F.lit(limit)).otherwise(out)
    return out


def limited_clients(requests: DataFrame, window: str = LIMIT_WINDOW, limit: Column | int = DEFAULT_LIMIT) -> DataFrame:
    """Clients over their limit per fixed window."""
    bound = F.lit(limit) if isinstance(limit, int) else limit
    keys = ["client", "route"] if "route" in requests.columns else ["client"]
    counts = requests.groupBy(F.window("ts", window).alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("limit", bound).where(F.col("n") > F.col("limit"))


def files_completed(progress: DataFrame, key: str = "scan_id") -> DataFrame:
    return progress.groupBy(key).agg(F.count(F.lit(1)).alias("files_completed"))


def usage_by_day(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.window("ts", "1 day").alias("window"), "provider").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )


def ingest_events(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Event log without repeats of an id inside the watermark."""
    return events.dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def revoked_requests(requests: DataFrame, revocations: DataFrame) -> DataFrame:
    """Requests with a revoked token, compared by hash.

    ``revocations``: token, revoked_at, ttl_seconds. A request is revoked when
    the latest end among the earlier revocations of its token lies after it. On
    a table that end is a running maximum, which a hot token cannot pile up in
    one task; a stream joins the revocation table.
    """
    until = F.col("revoked_at") + F.make_dt_interval(secs=F.col("ttl_seconds"))
    marks = revocations.select(F.sha2("token", 256).alias("_hash"), "revoked_at", until.alias("_until"))
    keyed = requests.withColumn("_hash", F.sha2("token", 256))
    if requests.isStreaming:
        test = (
            (keyed["_hash"] == marks["_hash"])
            & (keyed["ts"] >= marks["revoked_at"])
            & (keyed["ts"] < marks["_until"])
        )
        return keyed.join(marks, test, "left_semi").drop("_hash")
    rows = keyed.withColumn("_kind", F.lit(1)).unionByName(
        marks.select("_hash", F.col("revoked_at").alias("ts"), "_until", F.lit(0).alias("_kind")),
        allowMissingColumns=True,
    )
    order = ["ts", "_kind"]
    rows = running(in_ranges(rows, ["_hash"], order), ["_hash"], order, RANGE, _end=Running("max", F.col("_until")))
    return rows.where((F.col("_kind") == 1) & (F.col("ts") < F.col("_end"))).select(*requests.columns)
