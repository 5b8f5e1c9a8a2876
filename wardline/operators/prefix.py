"""Running values and exact quantiles that survive hot keys.

A plain window sorts all rows of a key in one task. Here rows are dealt out in
ranges of key and order, whose bounds are sampled so that they hold like
numbers of rows, however many of them fall into one second of one key. Rows are
scanned within (key, range), ranges are summarized with a partial aggregate,
and the summaries (at most one row for each key and range) carry the value from
range to range. The result equals the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage

CHUNK = "_chunk"
RANGE = "_range"


@dataclass(frozen=True)
class Running:
    """``kind`` is sum, min, max or last (last non-null); rows up to and with the
    current one count, or only the earlier ones when ``exclusive``."""

    kind: str
    value: Column
    exclusive: bool = False


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None, name: str = RANGE) -> DataFrame:
    """``df`` in ranges of (keys, order) of like size, with the range's number as column ``name``.

    Written to the shared folder: the bounds are sampled, so a lost task must not
    draw them anew. There are as many ranges as shuffle partitions unless told.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(parts, *keys, *order).withColumn(name, F.spark_partition_id()), "ranges")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | str,
    **measures: Running,
) -> DataFrame:
    """Add running measures per key along ``order`` (ascending, unique per key).

    ``chunk`` must not decrease along the order: the column of ``in_ranges``, by name,
    which several calls can share without moving the rows again, or an expression.
    Null is a key like any other.
    """
    source = df if isinstance(chunk, str) else df.withColumn(CHUNK, chunk)
    group = [*keys, chunk if isinstance(chunk, str) else CHUNK]

    def summary(name: str, m: Running) -> Column:
        if m.kind == "last":
            position = F.when(m.value.isNotNull(), F.struct(*order))
            return F.max_by(m.value, position).alias(name)
        return getattr(F, m.kind)(m.value).alias(name)

    totals = source.groupBy(*group).agg(*[summary(f"_t_{n}", m) for n, m in measures.items()])
    earlier = W.partitionBy(*keys).orderBy(group[-1]).rowsBetween(W.unboundedPreceding, -1)
    carries = totals.select(
        *group,
        *[_scan(m.kind, F.col(f"_t_{n}")).over(earlier).alias(f"_c_{n}") for n, m in measures.items()],
    )
    inside = W.partitionBy(*group).orderBy(*order)
    scanned = source.select(
        "*",
        *[
            _scan(m.kind, m.value)
            .over(inside.rowsBetween(W.unboundedPreceding, -1 if m.exclusive else 0))
            .alias(f"_w_{n}")
            for n, m in measures.items()
        ],
    )
    carries = carries.select(*[F.col(c).alias(f"_k_{c}") for c in group], *[f"_c_{n}" for n in measures])
    return scanned.join(carries, same_keys(group), "left").select(
        *[c for c in df.columns],
        *[_combine(m.kind, F.col(f"_c_{n}"), F.col(f"_w_{n}")).alias(n) for n, m in measures.items()],
    )


def same_keys(keys: Sequence[str], prefix: str = "_k_") -> Column:
    """Null-safe equality of ``keys`` with the columns of these names behind ``prefix``."""
    out = F.lit(True)
    for c in keys:
        out = out & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return out


def _scan(kind: str, value: Column) -> Column:
    return F.last(value, ignorenulls=True) if kind == "last" else getattr(F, kind)(value)


def _combine(kind: str, carry: Column, within: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(within, F.lit(0))
    if kind == "last":
        return F.coalesce(within, carry)
    return (F.greatest if kind == "max" else F.least)(carry, within)


def time_chunk(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Sequence[float],
    prefix: str = "p",
) -> DataFrame:
    """Interpolated quantiles per key without gathering a key's values.

    Equal values collapse first, then running counts along the value find the
    two neighbours of each rank. Columns are ``p50``, ``p95`` and so on.
    """
    names = [f"{prefix}{round(q * 100)}" for q in quantiles]
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running(in_ranges(counts, keys, [value]), keys, [value], RANGE, _upto=Running("sum", F.col("_n")))
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("n"))
    # A value covers the ranks [_upto - _n, _upto); the neighbours of rank r are the
    # smallest values whose cover ends after floor(r) and after ceil(r).
    totals = totals.select(*[F.col(c).alias(f"_k_{c}") for c in keys], "n") if keys else totals
    joined = ranked.join(totals, same_keys(keys)) if keys else ranked.withColumn("n", totals.scalar())
    sides = []
    for q, name in zip(quantiles, names):
        rank = F.lit(float(q)) * (F.col("n") - 1)
        sides += [
            F.min(F.when(F.col("_upto") > F.floor(rank), F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_upto") > F.ceil(rank), F.col(value))).alias(f"_hi_{name}"),
        ]
    found = joined.groupBy(*keys, "n").agg(*sides)
    out = []
    for q, name in zip(quantiles, names):
        rank = F.lit(float(q)) * (F.col("n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (rank - F.floor(rank))).alias(name))
    return found.select(*keys, "n", *out)
