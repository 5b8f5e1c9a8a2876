"""Detector evaluation against labeled samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import joins

METRICS = ["precision", "recall", "f1", "fpr", "fnr", "accuracy"]


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def sample_outcomes(results: DataFrame) -> DataFrame:
    """TP, FP, TN or FN per sample.

    A vulnerable sample whose findings miss the expected type counts as FP here,
    although its verdict is "detected".
    """
    vulnerable = F.col("category") == "vulnerable"
    hit = F.size("actual_findings") > 0
    right = (F.size("expected_findings") == 0) | joins.types_overlap(
        F.col("expected_findings.vulnerability_type"), F.col("actual_findings.vulnerability_type")
    )
    outcome = (
        F.when(vulnerable & hit, F.when(right, "TP").otherwise("FP"))
        .when(vulnerable, "FN")
        .when(F.col("category") == "benign", F.when(hit, "FP").otherwise("TN"))
    )
    return results.withColumn("outcome", outcome)


def confusion_metrics(results: DataFrame, *keys: str) -> DataFrame:
    """Counts and six rates to four decimals, 0 on an empty denominator."""
    marked = sample_outcomes(results)
    cells = marked.groupBy(*keys).agg(
        *[F.count_if(F.col("outcome") == c).alias(c.lower()) for c in ("TP", "FP", "TN", "FN")]
    )
    return _rates(cells)


def _rates(cells: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    rates = {
        "total_samples": tp + fp + tn + fn,
        "precision": precision,
        "recall": recall,
        "f1": _ratio(2 * precision * recall, precision + recall),
        "fpr": _ratio(fp, fp + tn),
        "fnr": _ratio(fn, tp + fn),
        "accuracy": _ratio(tp + tn, tp + fp + tn + fn),
    }
    out = cells.withColumns(rates)
    return out.withColumns({m: F.bround(m, 4) for m in METRICS})


def confusion_from_flags(samples: DataFrame, *keys: str) -> DataFrame:
    """The same rates when only "was it flagged" is known."""
    vulnerable = F.col("category") == "vulnerable"
    flagged = F.col("flagged")
    cells = samples.groupBy(*keys).agg(
        F.count_if(vulnerable & flagged).alias("tp"),
        F.count_if(~vulnerable & flagged).alias("fp"),
        F.count_if(~vulnerable & ~flagged).alias("tn"),
        F.count_if(vulnerable & ~flagged).alias("fn"),
    )
    return _rates(cells)


def detection_by_cwe(results: DataFrame, *keys: str) -> DataFrame:
    """Expected and detected findings per CWE over the vulnerable samples."""
    expected = results.where(F.col("category") == "vulnerable").select(
        *keys,
        F.explode("expected_findings").alias("e"),
        F.transform("actual_findings.cwe_id", F.upper).alias("_actual"),
    )
    cwe = F.coalesce("e.cwe_id", F.lit("UNKNOWN"))
    found = expected.select(*keys, cwe.alias("cwe_id"), F.array_contains("_actual", F.upper(cwe)).alias("_hit"))
    return (
        found.groupBy(*keys, "cwe_id")
        .agg(F.count(F.lit(1)).alias("expected_count"), F.count_if("_hit").alias("detected_count"))
        .withColumn("detection_rate", F.bround(F.col("detected_count") / F.col("expected_count"), 4))
    )


def sample_verdicts(results: DataFrame) -> DataFrame:
    hit = F.size("actual_findings") > 0
    verdict = F.when(F.col("category") == "vulnerable", F.when(hit, "detected").otherwise("missed")).otherwise(
        F.when(hit, "false_positive").otherwise("clean")
    )
    return results.select(
        "sample_name",
        "category",
        F.size("expected_findings").alias("expected_findings"),
        F.size("actual_findings").alias("actual_findings"),
        verdict.alias("verdict"),
    )


def compare_runs(metrics: DataFrame, baseline: str, improved: str, key: str = "run_id") -> DataFrame:
    """Six deltas between two runs, joined on the metric name."""
    long = metrics.unpivot(key, METRICS, "metric", "value")
    old = long.where(F.col(key) == baseline).select("metric", F.col("value").alias("baseline"))
    new = long.where(F.col(key) == improved).select("metric", F.col("value").alias("improved"))
    return old.join(new, "metric").withColumn("delta", F.bround(F.col("improved") - F.col("baseline"), 4))


def report_metrics(samples: DataFrame, *keys: str) -> DataFrame:
    """The report's own definitions: precision over findings, recall over samples.

    Input per sample: ``category``, ``n_findings``. False positives are the
    findings on benign samples, so they can outnumber the samples.
    """
    vulnerable = F.col("category") == "vulnerable"
    hit = F.col("n_findings") > 0
    cells = samples.groupBy(*keys).agg(
        F.count_if(vulnerable).alias("vulnerable"),
        F.count_if(vulnerable & hit).alias("detected"),
        F.coalesce(F.sum(F.when(vulnerable, F.col("n_findings"))), F.lit(0)).alias("true_findings"),
        F.coalesce(F.sum(F.when(~vulnerable, F.col("n_findings"))), F.lit(0)).alias("false_findings"),
        F.count_if(~vulnerable & ~hit).alias("clean"),
    )
    recall = _ratio(F.col("detected"), F.col("vulnerable"))
    precision = _ratio(F.col("true_findings"), F.col("true_findings") + F.col("false_findings"))
    fpr = _ratio(F.col("false_findings"), F.col("false_findings") + F.col("clean"))
    return cells.withColumns(
        {
            "precision": precision,
            "recall": recall,
            "f1": _ratio(2 * precision * recall, precision + recall),
            "fpr": fpr,
            "fnr": _ratio(F.col("vulnerable") - F.col("detected"), F.col("vulnerable")),
        }
    ).withColumn("band", fpr_band(F.col("fpr")))


def fpr_band(fpr: Column) -> Column:
    return (
        F.when(fpr < 0.05, "Excellent")
        .when(fpr < 0.15, "Good")
        .when(fpr < 0.30, "Acceptable")
        .otherwise("Needs improvement")
    )
