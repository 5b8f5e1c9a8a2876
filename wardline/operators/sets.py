"""Set operations between detector outputs and key sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_findings(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all detectors; columns a detector lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def shared_types(expected: DataFrame, actual: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """Distinct lower-cased types on both sides, per key."""
    def side(df: DataFrame) -> DataFrame:
        return df.select(*keys, F.lower(kind).alias(kind))

    return side(expected).intersect(side(actual))


def missing_keys(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return wanted.join(present.select(key), key, "left_anti")


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()
