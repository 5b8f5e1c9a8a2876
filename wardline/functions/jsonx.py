"""JSON columns and repair of free-text scanner output."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .severity import WHITESPACE

# First present name wins.
FINDING_ALIASES = {
    "vulnerability_type": ["vulnerability_type", "type", "vuln_type", "vulnerability", "name"],
    "severity": ["severity", "level", "risk", "risk_level"],
    "cwe_id": ["cwe_id", "cwe", "cweId"],
    "file_path": ["file_path", "file", "filename", "path"],
    "line_number": ["line_number", "line", "lineNumber", "line_start"],
    "code_snippet": ["code_snippet", "code", "snippet", "vulnerable_code"],
    "explanation": ["explanation", "description", "details", "explain", "desc"],
    "remediation": ["remediation", "fix", "solution", "recommendation", "suggestion"],
    "confidence": ["confidence", "score", "certainty"],
}
FINDING_DEFAULTS = {
    "vulnerability_type": "Unknown Vulnerability",
    "explanation": "",
    "remediation": "",
    "severity": "medium",
    "confidence": 0.7,
}
FENCED_JSON = r"(?s)```json\s*\n?(.*?)\n?\s*```"
FENCED_ANY = r"(?s)```\s*\n?(.*?)\n?\s*```"
FENCED_CODE = r"(?s)```(?:\w+)?\s*\n(.*?)\n```"

_TOKENS = {"{": re.compile(r'\\.|["{}]', re.S), "[": re.compile(r'\\.|["\[\]]', re.S)}


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def tolerant_json(col: Column) -> Column:
    """The text when it is JSON, else null."""
    return F.when(F.try_parse_json(col).isNotNull(), col)


def _closing_span(text: str, opening: str) -> str | None:
    """The first balanced bracket span of one kind, if it is JSON."""
    start = text.find(opening)
    if start < 0:
        return None
    depth, quoted = 0, False
    for token in _TOKENS[opening].finditer(text, start):
        mark = token.group()
        if mark == '"':
            quoted = not quoted
        elif len(mark) == 1 and not quoted:
            depth += 1 if mark == opening else -1
            if depth == 0:
                span = text[start : token.end()]
                try:
                    json.loads(span)
                except ValueError:
                    return None
                return span
    return None


@F.pandas_udf(T.StringType())
def _balanced_json(texts: pd.Series) -> pd.Series:
    return texts.map(
        lambda t: None if t is None else _closing_span(t, "{") or _closing_span(t, "["),
    )


def json_from_text(col: Column) -> Column:
    """The JSON document inside a text: all of it, a fenced block, or a bracket span.

    Only texts that neither parse whole nor hold a parsable fence reach the
    Arrow function; all others pass a null to it.
    """
    text = strip(col)
    whole = F.when(text.rlike(r"(?s)^(?:\{.*\}|\[.*\])$"), tolerant_json(text))
    blocks = F.concat(
        F.regexp_extract_all(text, F.lit(FENCED_JSON), F.lit(1)),
        F.regexp_extract_all(text, F.lit(FENCED_ANY), F.lit(1)),
    )
    fenced = F.get(
        F.filter(
            F.transform(blocks, strip),
            lambda b: b.rlike(r"^[\[{]") & F.try_parse_json(b).isNotNull(),
        ),
        F.lit(0),
    )
    found = F.coalesce(whole, fenced)
    return F.coalesce(found, _balanced_json(F.when(found.isNull() & text.rlike(r"[{\[]"), text)))


def variant_field(node: Column, name: str) -> Column:
    """A member as variant: SQL null when absent, a variant null when JSON null."""
    return F.try_variant_get(node, f"$.{name}", "variant")


def first_present(node: Column, names: Iterable[str]) -> Column:
    return F.coalesce(*[variant_field(node, n) for n in names])


def json_first(col: Column, names: Iterable[str]) -> Column:
    """First present member as text, straight from a JSON string column."""
    return F.coalesce(*[F.get_json_object(col, f"$.{n}") for n in names])


def leftover_metadata(fields: Mapping[str, Column], columns: Iterable[str]) -> Column:
    """JSON of the set fields that have no column of their own; every value keeps its type."""
    taken = set(columns)
    kept = [v.alias(k) for k, v in fields.items() if k not in taken]
    return F.to_json(F.struct(*kept)) if kept else F.lit("{}")


def _as_variant(value: Column) -> Column:
    return F.variant_get(F.parse_json(F.to_json(F.struct(value.alias("v")))), "$.v", "variant")


def merge_json(col: Column, updates: Mapping[str, Column]) -> Column:
    """JSON object with some keys replaced or added; all others keep their value and type.

    Null counts as an empty object. A text that is not a JSON object stays as it is.
    """
    read = F.try_variant_get(F.try_parse_json(col), "$", "map<string,variant>")
    base = F.when(col.isNull(), F.create_map().cast("map<string,variant>")).otherwise(read)
    kept = F.map_filter(base, lambda k, _: ~k.isin(list(updates)))
    new = F.create_map(*[x for k, v in updates.items() for x in (F.lit(k), _as_variant(v))])
    return F.coalesce(F.to_json(F.map_concat(kept, new)), col)
