"""Constant tables and lookups whose size is fixed in this package."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_table(spark: SparkSession, rows: Iterable[Mapping], ddl: str) -> DataFrame:
    """A DataFrame over constant rows.

    The rows sit in the plan itself, so the optimizer knows how small the table
    is and picks a broadcast join without a hint.
    """
    spec = f"array<struct<{', '.join(_nested(p) for p in _split(ddl))}>>"
    parsed = F.from_json(F.lit(json.dumps(list(rows))), spec)
    return spark.range(0, 1, 1, 1).select(F.inline(parsed))


def _split(ddl: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for ch in ddl:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += ch
    return [p.strip() for p in [*parts, current]]


def _nested(part: str) -> str:
    name, kind = part.split(None, 1)
    return f"{name}:{kind}"


def lookup(mapping: Mapping[str, object], key: Column) -> Column:
    """Value of ``key`` in a constant map, null when absent."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.element_at(F.create_map(*pairs), key)


def any_contains(text: Column, words: Iterable[str]) -> Column:
    """True when ``text`` contains one of the words."""
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out
