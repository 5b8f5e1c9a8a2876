"""Data-flow tables of Python files, from the facts about them.

Variables are told apart by file and name. A source that is read directly in an
argument becomes a node of its own, named by its expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.literal import lookup
from . import taint
from .taint_tables import SANITIZERS


def _is_removed(callee: Column) -> Column:
    return F.coalesce(lookup(SANITIZERS, callee) == "strong", F.lit(False))


def _uses(facts: DataFrame, kind: str) -> DataFrame:
    return facts.where(F.col("kind") == kind).select("*", F.inline("uses")).where(~_is_removed(F.col("callee")))


def accesses(facts: DataFrame) -> DataFrame:
    """Expressions read into a variable, or straight into an argument."""
    assigned = _uses(facts, "assign").where("is_read").select(
        "file_id", F.explode("targets").alias("node"), F.col("name").alias("expr"), "line"
    )
    passed = _uses(facts, "call").where("is_read").select(
        "file_id", F.col("name").alias("node"), F.col("name").alias("expr"), "line"
    )
    return assigned.unionByName(passed)


def edges(facts: DataFrame) -> DataFrame:
    return _uses(facts, "assign").where("not is_read").select(
        "file_id", F.col("name").alias("src"), F.explode("targets").alias("dst"), F.col("callee").alias("sanitizer")
    )


def calls(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'call'").select(
        "file_id",
        F.col("seq").alias("call_id"),
        "line",
        F.col("owner").alias("object"),
        F.col("func").alias("method"),
        "n_args",
        "arg0_kind",
        "arg0_text",
        "arg1_kind",
    )


def args(facts: DataFrame) -> DataFrame:
    """Variables of each argument with the place of their first use in the call."""
    used = facts.where("kind = 'call'").select("*", F.posexplode("uses").alias("position", "use")).select("*", "use.*")
    return (
        used.where(~_is_removed(F.col("callee")))
        .groupBy("file_id", F.col("seq").alias("call_id"), F.col("pos").alias("arg_index"), F.col("name").alias("node"))
        .agg(F.min("position").alias("position"))
    )


def python_flows(facts: DataFrame, aliases: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """Data-flow findings of Python files; ``facts`` should be a table at rest, it is read four times.

    With ``files`` (file_id, content) findings have their code.
    """
    if aliases is None:
        aliases = facts.select("file_id", F.lit("").alias("alias")).limit(0)
    labels = taint.source_labels(taint.match_sources(accesses(facts), aliases))
    found = taint.taint_findings(calls(facts), args(facts), taint.reach(edges(facts), labels), files)
    paths = facts.where("kind = 'parsed'").select("file_id", "file_path")
    return found.join(paths, "file_id")
