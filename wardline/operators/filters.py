"""Predicates, projections and visibility."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times


def where_eq(df: DataFrame, skip_none: bool = True, **filters: object) -> DataFrame:
    """Equality filters; unknown columns are ignored.

    A None value is skipped in listings and counts, but compared when one row is
    looked up, where it can match nothing.
    """
    for name, value in filters.items():
        if name not in df.columns:
            continue
        if value is None:
            df = df if skip_none else df.where(F.lit(False))
        else:
            df = df.where(F.col(name) == F.lit(value))
    return df


def get_one(df: DataFrame, **filters: object) -> DataFrame:
    return where_eq(df, skip_none=False, **filters)


def get_by_id(df: DataFrame, ident: object, key: str = "id") -> DataFrame:
    return df.where(F.col(key) == F.lit(ident))


def matches_term(term: str, columns: Sequence[str]) -> Column:
    """Case-insensitive literal substring in any of the columns."""
    hits = [F.lower(F.col(c)).contains(term.lower()) for c in columns]
    return F.coalesce(reduce(or_, [F.coalesce(h, F.lit(False)) for h in hits]), F.lit(False))


def search(df: DataFrame, term: str | None, columns: Sequence[str]) -> DataFrame:
    return df.where(matches_term(term, columns)) if term else df


def visible_analyses(
    analyses: DataFrame, projects: DataFrame, user_id: object, is_admin: bool = False
) -> DataFrame:
    """Scans of own projects and own scans without a project; admins see all."""
    if is_admin:
        return analyses
    mine = projects.where(F.col("user_id") == F.lit(user_id)).select(
        F.col("project_id").alias("_own_project")
    )
    owned = analyses.join(mine, F.col("project_id") == F.col("_own_project"), "left")
    standalone = F.col("project_id").isNull() & (F.col("user_id") == F.lit(user_id))
    return owned.where(F.col("_own_project").isNotNull() | standalone).select(*analyses.columns)


def with_effective_owner(analyses: DataFrame, metadata: str, owner: str) -> DataFrame:
    """``uploaded_by`` of the metadata, else the owner column."""
    uploaded = F.nullif(F.get_json_object(metadata, "$.uploaded_by"), F.lit(""))
    return analyses.withColumn("effective_owner", F.coalesce(uploaded, F.col(owner).cast("string")))


def readable_by(analyses: DataFrame, user_id: object, is_admin: bool = False) -> DataFrame:
    """Rows whose effective owner is the user; no owner means denied."""
    if is_admin:
        return analyses
    return analyses.where(F.col("effective_owner") == F.lit(str(user_id)))


def active(df: DataFrame, flag: str = "is_active") -> DataFrame:
    return df.where(F.col(flag))


def without(df: DataFrame, *wide: str) -> DataFrame:
    """Listing without its wide columns, which then are not read at all."""
    return df.drop(*wide)


def with_iso_times(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: times.iso_utc(F.col(c)) for c in columns})


def history(df: DataFrame, status: str = "all", term: str = "") -> DataFrame:
    """Scan history: status tab and a search in branch or id."""
    if status != "all":
        df = df.where(F.col("status") == status)
    needle = term.strip()
    if not needle:
        return df
    found = matches_term(term, ["branch"]) | F.lower(F.col("analysis_id").cast("string")).contains(term.lower())
    return df.where(found)


def with_share_state(tokens: DataFrame, now: Column) -> DataFrame:
    return tokens.withColumn(
        "state", times.share_state(F.col("token"), F.col("is_revoked"), F.col("expires_at"), now)
    )


def by_severity(findings: DataFrame, level: str = "all") -> DataFrame:
    return findings if level == "all" else findings.where(F.col("severity") == level)
