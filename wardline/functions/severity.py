"""Severity, confidence and score columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .literal import lookup

# Fixed values.
LEVELS = ["critical", "high", "medium", "low", "info"]
ALIASES = {
    "critical": "critical",
    "crit": "critical",
    "high": "high",
    "important": "high",
    "medium": "medium",
    "moderate": "medium",
    "med": "medium",
    "warning": "medium",
    "low": "low",
    "minor": "low",
    "info": "info",
    "informational": "info",
}
SCORE_WEIGHTS = {"critical": 10.0, "high": 5.0, "medium": 2.0, "low": 0.5}
WHITESPACE = " \t\n\r\f\v"


def norm_severity(col: Column) -> Column:
    """Alias table after trimming and lower-casing; anything else is medium."""
    key = F.btrim(F.lower(col), F.lit(WHITESPACE))
    return F.coalesce(lookup(ALIASES, key), F.lit("medium"))


def stored_severity(col: Column) -> Column:
    """The write path: only the five names count, no aliases and no trimming."""
    low = F.lower(col)
    return F.when(low.isin(LEVELS), low).otherwise(F.lit("medium"))


def severity_rank(col: Column) -> Column:
    """critical = 0 ... info = 4, unknown = -1."""
    return F.array_position(F.lit(LEVELS), col).cast("int") - 1


def confidence_pct(col: Column, fractional: bool = True) -> Column:
    """A fraction is scaled by 100 and truncated, an int is kept, missing is 100."""
    value = (col * 100).cast("int") if fractional else col.cast("int")
    return F.coalesce(value, F.lit(100))


def half_up(col: Column) -> Column:
    """Round to an integer with .5 going up."""
    return F.floor(col + F.lit(0.5))


def confidence_2dp(col: Column) -> Column:
    """Two decimals, 0.7 when there is no number."""
    return F.coalesce(half_up(col * 100) / 100.0, F.lit(0.7))


def confidence_from_severity(severity: Column) -> Column:
    """Scale used by the line-based script detector."""
    return (
        F.when(severity == "critical", F.lit(0.95))
        .when(severity == "high", F.lit(0.85))
        .otherwise(F.lit(0.7))
    )


def security_score(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    penalty = (
        critical * SCORE_WEIGHTS["critical"]
        + high * SCORE_WEIGHTS["high"]
        + medium * SCORE_WEIGHTS["medium"]
        + low * SCORE_WEIGHTS["low"]
    )
    return F.greatest(F.lit(0).cast("bigint"), half_up(F.lit(100.0) - penalty))


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 60, "fair").otherwise("poor")


def score_trend(score: Column) -> Column:
    return F.when(score >= 70, "up").otherwise("down")


def confidence_band(pct: Column) -> Column:
    return F.when(pct >= 80, "high").when(pct >= 50, "medium").otherwise("low")


def taint_confidence(
    path_length: Column, has_weak: Column, has_strong: Column, category: Column
) -> Column:
    """0.90 less 0.15 for a weak sanitizer, 0.05 / 0.10 for long paths, 0.30 for environment."""
    score = (
        F.lit(0.90)
        - F.when(has_weak, 0.15).otherwise(0.0)
        - F.when(path_length > 5, 0.10).when(path_length > 3, 0.05).otherwise(0.0)
        - F.when(category == "environment", 0.30).otherwise(0.0)
    )
    clamped = F.greatest(F.lit(0.1), F.least(F.lit(1.0), score))
    return F.when(has_strong, F.lit(0.0)).otherwise(clamped)
