"""Repair of free-text scanner responses into finding, fix and explanation rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions import severity as sev

TEXT_FIELDS = ["explanation", "remediation"]
OPTIONAL_FIELDS = ["cwe_id", "file_path", "code_snippet"]
FINDING_LISTS = ["findings", "vulnerabilities", "results"]


def _kind(node: Column) -> Column:
    """Type name of a variant; null when absent."""
    return F.schema_of_variant(node)


def _is_text(node: Column) -> Column:
    return F.coalesce(_kind(node) == "STRING", F.lit(False))


def _is_number(node: Column) -> Column:
    return F.coalesce(_kind(node).rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.lit(False))


def _is_absent_or_null(node: Column) -> Column:
    return node.isNull() | F.is_variant_null(node)


def _as(node: Column, kind: str) -> Column:
    return F.try_variant_get(node, "$", kind)


def _finding(fields: dict[str, Column]) -> Column:
    """A typed finding struct and whether its fields pass validation."""
    text_ok = _is_text(fields["vulnerability_type"])
    for name in TEXT_FIELDS:
        text_ok &= fields[name].isNull() | _is_text(fields[name])
    for name in OPTIONAL_FIELDS:
        text_ok &= _is_absent_or_null(fields[name]) | _is_text(fields[name])
    line, score = fields["line_number"], fields["confidence"]
    whole = _as(line, "double")
    line_ok = _is_absent_or_null(line) | (whole.isNotNull() & (whole == F.floor(whole)))
    value = _as(score, "double")
    score_ok = score.isNull() | ((_is_number(score) | _is_text(score)) & value.between(0.0, 1.0))
    level = F.when(_is_text(fields["severity"]), _as(fields["severity"], "string"))
    defaults = jsonx.FINDING_DEFAULTS
    return F.struct(
        F.coalesce(text_ok & line_ok & score_ok, F.lit(False)).alias("ok"),
        _as(fields["vulnerability_type"], "string").alias("vulnerability_type"),
        sev.norm_severity(level).alias("severity"),
        _as(fields["cwe_id"], "string").alias("cwe_id"),
        _as(fields["file_path"], "string").alias("file_path"),
        whole.cast("int").alias("line_number"),
        _as(fields["code_snippet"], "string").alias("code_snippet"),
        F.coalesce(_as(fields["explanation"], "string"), F.lit(defaults["explanation"])).alias("explanation"),
        F.coalesce(_as(fields["remediation"], "string"), F.lit(defaults["remediation"])).alias("remediation"),
        F.coalesce(value, F.lit(defaults["confidence"])).alias("confidence"),
    )


def _plain(node: Column) -> dict[str, Column]:
    """The fields of a finding that carry their own names."""
    return {name: jsonx.variant_field(node, name) for name in jsonx.FINDING_ALIASES}


def _aliased(node: Column) -> dict[str, Column]:
    """The fields of a finding that may carry one of the known aliases; defaults fill the rest."""
    fields = {name: jsonx.first_present(node, names) for name, names in jsonx.FINDING_ALIASES.items()}
    unnamed = F.parse_json(F.lit(f'"{jsonx.FINDING_DEFAULTS["vulnerability_type"]}"'))
    fields["vulnerability_type"] = F.coalesce(fields["vulnerability_type"], unnamed)
    return fields


def _findings(items: Column, fields: Callable[[Column], dict[str, Column]]) -> Column:
    """Typed findings of an array of variants; a field is looked up once, however often the checks read it."""
    found = F.transform(items, lambda i: F.struct(*[c.alias(name) for name, c in fields(i).items()]))
    return F.transform(found, lambda f: _finding({name: f[name] for name in jsonx.FINDING_ALIASES}))


def _objects(items: Column) -> Column:
    return F.filter(items, lambda i: _kind(i).startswith("OBJECT"))


def normalize_raw_findings(raw: DataFrame, column: str = "response") -> DataFrame:
    """Rows of validated findings from response texts.

    A response that already follows the schema is taken as it is. Otherwise the
    list under one of the known names is read with the alias table, invalid
    entries are skipped; then a single finding object is tried. A text without
    any JSON gives one low-confidence row; an empty or unusable response gives
    one row whose outcome is ``rejected`` and whose finding is null.
    """
    doc = F.try_parse_json("_json")
    base = raw.withColumn("_json", jsonx.json_from_text(F.col(column))).withColumn("_doc", doc)
    node = F.col("_doc")
    direct_list = jsonx.variant_field(node, "findings")
    direct_items = F.try_variant_get(node, "$.findings", "array<variant>")
    plain = _findings(F.coalesce(direct_items, F.array().cast("array<variant>")), _plain)
    summary, language = jsonx.variant_field(node, "summary"), jsonx.variant_field(node, "language")
    total = _as(jsonx.variant_field(node, "total_findings"), "double")
    header_ok = (
        (summary.isNull() | _is_text(summary))
        & (language.isNull() | _is_text(language))
        & (jsonx.variant_field(node, "total_findings").isNull() | total.isNotNull())
    )
    list_ok = direct_list.isNull() | (direct_items.isNotNull() & F.forall("_plain", lambda f: f["ok"]))
    is_object = F.coalesce(_kind(node).startswith("OBJECT"), F.lit(False))
    listed = F.coalesce(
        F.try_variant_get(jsonx.first_present(node, FINDING_LISTS), "$", "array<variant>"),
        F.array().cast("array<variant>"),
    )
    repaired = F.filter(_findings(_objects(listed), _aliased), lambda f: f["ok"])
    single = F.filter(_findings(F.array(node), _aliased), lambda f: f["ok"])
    has_type = jsonx.variant_field(node, "vulnerability_type").isNotNull() | jsonx.variant_field(node, "type").isNotNull()
    text = F.col(column)
    fallback = F.array(
        F.struct(
            F.lit(True).alias("ok"),
            F.lit("Unknown").alias("vulnerability_type"),
            F.lit("medium").alias("severity"),
            F.lit(None).cast("string").alias("cwe_id"),
            F.lit(None).cast("string").alias("file_path"),
            F.lit(None).cast("int").alias("line_number"),
            F.lit(None).cast("string").alias("code_snippet"),
            text.alias("explanation"),
            F.lit("").alias("remediation"),
            F.lit(0.3).alias("confidence"),
        )
    )
    empty = text.isNull() | (jsonx.strip(text) == "")
    # Each reading is a column of its own, made once and only where the readings before it failed.
    marked = base.withColumn("_plain", F.when(is_object, plain))
    marked = marked.withColumn("_direct", F.coalesce(is_object & header_ok & list_ok, F.lit(False)))
    marked = marked.withColumn("_repaired", F.when(is_object & ~F.col("_direct"), repaired))
    alone = is_object & ~F.col("_direct") & ~F.coalesce(F.size("_repaired") > 0, F.lit(False)) & has_type
    marked = marked.withColumn("_single", F.when(alone, single))
    outcome = (
        F.when(empty, "rejected")
        .when(F.col("_json").isNull(), "fallback")
        .when(F.col("_direct"), "direct")
        .when(F.size("_repaired") > 0, "repaired")
        .when(F.size("_single") > 0, "single")
        .otherwise("rejected")
    )
    marked = marked.withColumn("outcome", outcome)
    rows = (
        F.when(F.col("outcome") == "fallback", fallback)
        .when(F.col("outcome") == "direct", F.col("_plain"))
        .when(F.col("outcome") == "repaired", F.col("_repaired"))
        .when(F.col("outcome") == "single", F.col("_single"))
    )
    return marked.select(*raw.columns, "outcome", F.inline_outer(rows)).drop("ok")


def _text_or(node: Column, default: Column) -> Column:
    return F.when(node.isNull(), default).otherwise(_as(node, "string"))


def parse_fixes(raw: DataFrame, column: str = "response", original: str = "original_code") -> DataFrame:
    """Fix rows: a JSON object, else the first fenced code block at confidence 0.5."""
    node = F.try_parse_json(jsonx.json_from_text(F.col(column)))
    base = raw.withColumn("_doc", node)
    doc = F.col("_doc")
    before = jsonx.variant_field(doc, "original_code")
    after = jsonx.first_present(doc, ["fixed_code", "fix", "solution"])
    why = jsonx.first_present(doc, ["explanation", "description"])
    score = jsonx.variant_field(doc, "confidence")
    value = F.coalesce(_as(score, "double"), F.when(score.isNull(), F.lit(0.7)))
    usable = (
        F.coalesce(_kind(doc).startswith("OBJECT") & (_kind(doc) != "OBJECT<>"), F.lit(False))
        & (before.isNull() | _is_text(before))
        & (after.isNull() | _is_text(after))
        & (why.isNull() | _is_text(why))
        & F.coalesce(value.between(0.0, 1.0), F.lit(False))
    )
    text = F.col(column)
    block = F.get(F.regexp_extract_all(text, F.lit(jsonx.FENCED_CODE), F.lit(1)), F.lit(0))
    outcome = F.when(usable, "json").when(block.isNotNull(), "code_block").otherwise("rejected")
    marked = base.withColumns({"outcome": outcome, "_block": block})
    from_json = F.col("outcome") == "json"
    from_block = F.col("outcome") == "code_block"
    return marked.select(
        *raw.columns,
        "outcome",
        F.when(from_json, _text_or(before, F.col(original))).when(from_block, F.col(original)).alias("code_before"),
        F.when(from_json, _text_or(after, F.lit(""))).when(from_block, jsonx.strip(F.col("_block"))).alias("code_after"),
        F.when(from_json, _text_or(why, F.lit(""))).when(from_block, text).alias("explanation"),
        F.when(from_json, value).when(from_block, F.lit(0.5)).alias("confidence"),
    )


def parse_explanations(raw: DataFrame, column: str = "response") -> DataFrame:
    """Explanation rows from JSON objects; missing texts are empty."""
    names = ["title", "description", "impact", "exploitation", "remediation"]
    node = F.try_parse_json(jsonx.json_from_text(F.col(column)))
    base = raw.withColumn("_doc", node)
    doc = F.col("_doc")
    refs = jsonx.variant_field(doc, "references")
    links = F.try_variant_get(doc, "$.references", "array<variant>")
    usable = F.coalesce(_kind(doc).startswith("OBJECT") & (_kind(doc) != "OBJECT<>"), F.lit(False))
    for name in names:
        field = jsonx.variant_field(doc, name)
        usable &= field.isNull() | _is_text(field)
    usable &= refs.isNull() | F.coalesce(F.forall(links, _is_text), F.lit(False))
    return base.withColumn("outcome", F.when(usable, "json").otherwise("rejected")).select(
        *raw.columns,
        "outcome",
        *[
            F.when(F.col("outcome") == "json", _text_or(jsonx.variant_field(doc, n), F.lit(""))).alias(n)
            for n in names
        ],
        F.when(
            F.col("outcome") == "json",
            F.coalesce(F.transform(links, lambda x: _as(x, "string")), F.array().cast("array<string>")),
        ).alias("references"),
    )


def aliased_fields(df: DataFrame, column: str) -> DataFrame:
    """The nine finding fields of a JSON column, first present alias wins."""
    return df.withColumns(
        {name: jsonx.json_first(F.col(column), names) for name, names in jsonx.FINDING_ALIASES.items()}
    )


def with_defaults(findings: DataFrame) -> DataFrame:
    """Fill what a detector left out; title falls back to the type, description to the explanation."""
    kind = F.coalesce("vulnerability_type", F.lit("Unknown"))
    return findings.withColumns(
        {
            "title": F.coalesce("title", "vulnerability_type", F.lit("Unknown Vulnerability")),
            "description": F.coalesce("description", "explanation", F.lit("")),
            "vulnerability_type": kind,
            "severity": sev.stored_severity(F.coalesce("severity", F.lit("medium"))),
            "analyzer_type": F.coalesce("analyzer_type", F.lit("sast")),
            "confidence": sev.confidence_pct(F.col("confidence")),
        }
    )
