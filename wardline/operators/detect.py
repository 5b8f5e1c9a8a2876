"""Pattern detection over a corpus of code files.

Input ``file_id, file_path, language, content``. Every detector works row by row
on the scan partitions; only findings, never contents, are shuffled later.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks, text
from ..functions import severity as sev
from ..functions.literal import any_contains, lookup
from ..session import cut_lineage
from . import knowledge, pyfacts, pyflows, ranking, sets
from .rules import BENCHMARK_RULES, KNOWLEDGE_RULES, REGEX_RULES, SCRIPT_RULES, Rule

KEYS = ("file_id", "file_path")


def _rule_struct(rule: Rule, **more: Column) -> Column:
    return F.struct(
        F.lit(rule.rule).alias("rule"),
        F.lit(rule.credential).alias("credential"),
        F.lit(rule.vulnerability_type).alias("vulnerability_type"),
        F.lit(rule.cwe_id).alias("cwe_id"),
        F.lit(rule.severity).alias("severity"),
        F.lit(rule.title or rule.vulnerability_type).alias("title"),
        F.lit(rule.description).alias("description"),
        F.lit(rule.remediation).alias("remediation"),
        F.lit(rule.confidence).alias("confidence"),
        *[column.alias(name) for name, column in more.items()],
    )


# Letters whose case-insensitive match is an ASCII letter although they do not lower to it.
FOLDED = ["\u017f", "\u0130", "\u0131"]


def _may_match(rule: Rule, content: Column, lowered: Column) -> Column:
    """Plain substring tests that every match passes; far cheaper than the pattern."""
    text_ = lowered if rule.ignores_case else content
    out = F.lit(True)
    for group in rule.needs:
        out = out & any_contains(text_, group)
    return out | any_contains(content, FOLDED) if rule.ignores_case else out


def _matching_rules(
    files: DataFrame,
    rules: Sequence[Rule],
    more: Callable[[Rule], dict[str, Column]],
    gate: Callable[[Rule], Column] | None = None,
) -> DataFrame:
    """One row per file and rule that occurs in it, with ``more`` columns per rule.

    ``gate`` says which files a rule looks at at all.

    All tests sit in one generator, which reads a content once; a filter on the
    hits would be pushed below it and run every pattern a second time.
    """
    content, lowered = F.col("content"), F.col("_lowered")

    def test(rule: Rule) -> Column:
        found = _may_match(rule, content, lowered) & content.rlike(rule.pattern)
        return gate(rule) & found if gate else found

    hits = [F.when(test(r), _rule_struct(r, **more(r))) for r in rules]
    return (
        files.withColumn("_lowered", F.lower("content"))
        .select(*files.columns, F.inline(F.array(*hits)))
        .where(F.col("rule").isNotNull())
    )


def _first_match(
    files: DataFrame, rules: Sequence[Rule], strict: bool, gate: Callable[[Rule], Column] | None = None
) -> DataFrame:
    """The line of the first match, less the credential matches that are none.

    Splitting at the first match yields the text before and after it, hence the
    match itself.
    """
    found = _matching_rules(files, rules, lambda r: {"_parts": F.split("content", r.pattern, 2)}, gate)
    prefix, rest = F.col("_parts")[0], F.col("_parts")[1]
    match = F.substring(
        F.col("content"), F.length(prefix) + 1, F.length("content") - F.length(prefix) - F.length(rest)
    )
    false_hit = F.col("credential") & text.is_false_credential(match, prefix, strict)
    return found.where(~false_hit).withColumn("line_start", text.line_after(prefix))


def regex_scan(
    files: DataFrame,
    rules: Sequence[Rule] = REGEX_RULES,
    strict: bool = False,
    analyzer: str = "regex",
    keep: Sequence[str] = (),
) -> DataFrame:
    """First hit of every rule in every file."""
    return _first_match(files, rules, strict).select(
        *KEYS,
        *keep,
        "vulnerability_type",
        "severity",
        "cwe_id",
        "line_start",
        (F.col("line_start") + 1).alias("line_end"),
        text.snippet_uneven(F.col("content"), F.col("line_start")).alias("code_snippet"),
        "title",
        "description",
        "remediation",
        "confidence",
        F.lit(analyzer).alias("analyzer_type"),
        "rule",
    )


def knowledge_scan(files: DataFrame, strict: bool = False) -> DataFrame:
    """The wider rules, described from the knowledge base."""
    found = regex_scan(files, KNOWLEDGE_RULES, strict, analyzer="ai")
    advice = {
        "description": _knowledge(knowledge.EXPLANATIONS),
        "remediation": _knowledge(knowledge.FIXES),
        "line_end": F.col("line_start"),
    }
    return found.withColumns(advice)


def _knowledge(table: dict[str, str]) -> Column:
    return lookup(table, F.col("cwe_id"))


def _has_code_match(content: Column, pattern: str) -> Column:
    """Is there a match that does not sit on a comment line?

    The text between matches is folded from left to right, keeping the head of
    the current line, so a file is read once whatever the number of matches.
    """
    pieces = F.split(content, pattern, -1)
    matches = F.regexp_extract_all(content, F.lit(pattern), F.lit(0))
    steps = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(matches)).alias("gap"), matches.alias("hit"))

    def line_head(head: Column, more: Column) -> Column:
        return F.substring_index(F.concat(head, more), "\n", -1)

    def step(acc: Column, item: Column) -> Column:
        head = line_head(acc["head"], item["gap"])
        return F.struct(
            line_head(head, item["hit"]).alias("head"),
            (acc["found"] | ~text.is_comment_head(head)).alias("found"),
        )

    start = F.struct(F.lit("").alias("head"), F.lit(False).alias("found"))
    return F.aggregate(steps, start, step, lambda acc: acc["found"])


def benchmark_scan(files: DataFrame, rules: Sequence[Rule] = BENCHMARK_RULES) -> DataFrame:
    """A finding per file and pattern that matches outside comment lines."""
    found = _matching_rules(files, rules, lambda r: {"_in_code": _has_code_match(F.col("content"), r.pattern)})
    return found.where("_in_code").select(
        *KEYS, "rule", "vulnerability_type", "severity", "cwe_id", "confidence"
    )


def _matching_lines(files: DataFrame, test: Callable[[Column], Column]) -> DataFrame:
    """Lines that pass a test, with their number."""
    lines = files.select(*files.columns, F.posexplode(F.split("content", "\n")).alias("_pos", "line"))
    return lines.where(test(F.col("line"))).withColumn("line_start", F.col("_pos") + 1).drop("_pos")


def script_scan(files: DataFrame, rules: Sequence[Rule] = SCRIPT_RULES) -> DataFrame:
    """Line rules for scripts: one finding per (rule, line)."""
    def any_rule(line: Column) -> Column:
        out = F.lit(False)
        for rule in rules:
            out = out | (_may_match(rule, line, F.lower(line)) & line.rlike(rule.pattern))
        return out

    lines = _matching_lines(files, any_rule)

    def hit(rule: Rule) -> Column:
        name = F.regexp_extract("line", rule.pattern, 1) if rule.names else F.lit("")
        return F.when(F.col("line").rlike(rule.pattern), _rule_struct(rule, _name=name))

    hits = F.array(*[hit(r) for r in rules])
    named = {c: F.replace(c, F.lit("{}"), F.col("_name")).alias(c) for c in ("title", "description")}
    return lines.select("*", F.inline(hits)).where(F.col("rule").isNotNull()).select(
        *KEYS,
        "vulnerability_type",
        "severity",
        "cwe_id",
        "line_start",
        F.col("line_start").alias("line_end"),
        text.snippet_centred(F.col("content"), F.col("line_start")).alias("code_snippet"),
        named["title"],
        named["description"],
        "remediation",
        "confidence",
        F.lit("sast-js").alias("analyzer_type"),
        "rule",
    )


def secret_lines(files: DataFrame) -> DataFrame:
    """The older line rule for secrets: eight characters, no templates, no SQL placeholders."""
    lines = _matching_lines(files.where(F.col("content").rlike(text.SECRET_LINE)), text.is_secret_line)
    return lines.select(
        *KEYS,
        F.lit("Hardcoded Secret").alias("vulnerability_type"),
        F.lit("high").alias("severity"),
        F.lit("CWE-798").alias("cwe_id"),
        "line_start",
        text.snippet_centred(F.col("content"), F.col("line_start")).alias("code_snippet"),
        sev.confidence_from_severity(F.lit("high")).alias("confidence"),
        F.lit("js_ast").alias("analyzer_type"),
        F.lit("secret_line").alias("rule"),
    )


def validate_fixes(fixes: DataFrame, findings: DataFrame) -> DataFrame:
    """Warnings and verdict of every fix, beside the CWE of its finding.

    Fixes for Python are parsed by the fact extractor; only its status row is
    used, and it comes back keyed by the fix.
    """
    python = fixes.where(F.lower("language").isin(*PYTHON)).select(
        F.col("fix_id").alias("file_id"), F.lit("fix").alias("file_path"), F.col("code_after").alias("content")
    )
    broken = pyfacts.unparsed_files(pyfacts.python_facts(python)).select(
        F.col("file_id").alias("fix_id"), F.concat(F.lit("Python syntax error: "), "error").alias("_syntax")
    )
    checked = fixes.join(broken, "fix_id", "left").withColumn(
        "warnings", checks.fix_warnings(F.col("code_before"), F.col("code_after"), F.col("_syntax"))
    )
    cwe = findings.select("finding_id", "cwe_id")
    return (
        checked.drop("_syntax").withColumn("valid", F.size("warnings") == 0).join(cwe, "finding_id", "left")
    )


def fix_quality(validated: DataFrame) -> DataFrame:
    """Validated share per CWE and language."""
    return validated.groupBy("cwe_id", "language").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("valid").alias("n_valid"),
        F.avg(F.col("valid").cast("double")).alias("valid_share"),
    )


PYTHON = ("python", "py")
SCRIPT = ("javascript", "js", "typescript", "ts")


#: What a data-flow finding shares with the others.
FLOW_COLUMNS = [
    "file_id", "file_path", "vulnerability_type", "severity", "cwe_id", "line_start", "line_end", "code_snippet", "title", "description",
    "remediation", "confidence", "analyzer_type", "rule", "data_flow",
]


def _is_other_language() -> Column:
    return ~F.coalesce(F.lower("language").isin(*PYTHON, *SCRIPT), F.lit(False))


def _parsed_languages(files: DataFrame) -> DataFrame:
    """Python and script files; Python that does not parse falls back to the regex rules.

    Data flow of Python files is followed over the same facts as the checks.
    """
    language = F.lower("language")
    # Two branches read the facts: materialize them, so that every file is parsed once.
    python = files.where(language.isin(*PYTHON))
    facts = cut_lineage(pyfacts.python_facts(python))
    content = python.select(F.col("file_id").cast("string").alias("file_id"), "content")
    return sets.union_findings(
        [
            pyfacts.python_findings(facts),
            pyflows.python_flows(facts, files=content).select(*FLOW_COLUMNS),
            regex_scan(pyfacts.unparsed_files(facts)),
            script_scan(files.where(language.isin(*SCRIPT))),
        ]
    )


def route_by_language(files: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """First stage: each file goes to the detector of its language.

    Files of other languages get the regex rules. ``flows`` are further data-flow
    findings, computed from edge tables of other front ends.
    """
    parts = [_parsed_languages(files), regex_scan(files.where(_is_other_language()))]
    return sets.union_findings(parts if flows is None else [*parts, flows])


def _pattern_stages(files: DataFrame, second: str) -> DataFrame:
    """Regex rules on other languages (stage 1) and the second detector on all files (stage 2).

    Both run in one pass, so that a content is not read once per stage.
    """
    other = _is_other_language()
    if second == "regex":
        # The two stages agree on files of other languages; those rows count for the first.
        found = regex_scan(files, keep=["language"])
        return found.withColumn("stage", F.when(other, 1).otherwise(2)).drop("language")
    mark = "first:"
    first = [replace(r, rule=mark + r.rule) for r in REGEX_RULES]
    found = _first_match(
        files, [*first, *KNOWLEDGE_RULES], False, lambda r: other if r.rule.startswith(mark) else F.lit(True)
    )
    is_first = F.col("rule").startswith(mark)
    return found.select(
        *KEYS,
        "vulnerability_type",
        "severity",
        "cwe_id",
        "line_start",
        F.when(is_first, F.col("line_start") + 1).otherwise(F.col("line_start")).alias("line_end"),
        text.snippet_uneven(F.col("content"), F.col("line_start")).alias("code_snippet"),
        "title",
        F.when(is_first, F.col("description")).otherwise(_knowledge(knowledge.EXPLANATIONS)).alias("description"),
        F.when(is_first, F.col("remediation")).otherwise(_knowledge(knowledge.FIXES)).alias("remediation"),
        "confidence",
        F.when(is_first, "regex").otherwise("ai").alias("analyzer_type"),
        F.regexp_replace("rule", f"^{mark}", "").alias("rule"),
        F.when(is_first, 1).otherwise(2).alias("stage"),
    )


def scan_corpus(files: DataFrame, flows: DataFrame | None = None, second: str = "knowledge") -> DataFrame:
    """Both stages, deduplicated together.

    The second stage runs over every file with the chosen detector, ``knowledge``
    or ``regex``.
    """
    parts = [_parsed_languages(files).withColumn("stage", F.lit(1)), _pattern_stages(files, second)]
    if flows is not None:
        parts.append(flows.withColumn("stage", F.lit(1)))
    rows = sets.union_findings(parts)
    if "data_flow" not in rows.columns:
        rows = rows.withColumn("data_flow", F.lit(None).cast("string"))
    # The order of a duplicate pair: stage, then detector, rule and title by name.
    rows = rows.withColumn("seq", F.struct("stage", "analyzer_type", "rule", "title"))
    return ranking.dedup_findings(rows, ("file_id",)).drop("seq")
