"""Running a stream to the end of the data that is there, into a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def to_table(stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Append results to a Parquet folder; resumes from its checkpoint."""
    spark = stream.sparkSession
    target = path or scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{target}-state")
        .option("path", target)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def to_snapshot(stream: DataFrame, name: str, keys: Sequence[str], path: str | None = None) -> DataFrame:
    """Write updates per batch and return the last update of every key.

    A batch overwrites its own folder, so a retried batch changes nothing.
    """
    spark: SparkSession = stream.sparkSession
    target = path or scratch_path(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", f"{target}-state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    updates = spark.read.parquet(target)
    rest = [c for c in stream.columns if c not in keys]
    return (
        updates.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
        .select(*keys, "_row.*")
    )
