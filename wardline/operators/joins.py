"""Joins between scans, files, findings, classes and knowledge.

No hints: constant tables carry their size in the plan, every other side is
broadcast only when the optimizer measures it below its threshold, and AQE
splits hot keys of the sort-merge joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.literal import lookup
from . import knowledge


def class_students(enrollments: DataFrame, users: DataFrame) -> DataFrame:
    return enrollments.where(F.col("status") == "active").join(
        users.select(F.col("user_id").alias("student_id"), "full_name", "email"), "student_id"
    )


def active_counts(enrollments: DataFrame) -> DataFrame:
    return (
        enrollments.where(F.col("status") == "active")
        .groupBy("class_id")
        .agg(F.count(F.lit(1)).alias("student_count"))
    )


def with_student_count(classes: DataFrame, enrollments: DataFrame) -> DataFrame:
    return classes.join(active_counts(enrollments), "class_id", "left").fillna(0, ["student_count"])


def my_classes(classes: DataFrame, enrollments: DataFrame, users: DataFrame) -> DataFrame:
    """Active classes of every active student, with instructor and head count."""
    instructors = users.select(
        F.col("user_id").alias("instructor_id"),
        F.col("full_name").alias("instructor_name"),
        F.col("email").alias("instructor_email"),
    )
    described = with_student_count(classes.where(F.col("is_active")), enrollments).join(
        instructors, "instructor_id"
    )
    return enrollments.where(F.col("status") == "active").select("class_id", "student_id").join(
        described, "class_id"
    )


def analyses_of_students(analyses: DataFrame, enrollments: DataFrame) -> DataFrame:
    students = enrollments.where(F.col("status") == "active").select(
        F.col("student_id").alias("user_id")
    )
    return analyses.join(students, "user_id", "left_semi")


def with_fixes(findings: DataFrame, fixes: DataFrame) -> DataFrame:
    """One row per finding and fix, findings without a fix kept.

    Rows instead of an array per finding, so that a finding with very many fixes
    never has to fit into one value.
    """
    return findings.join(fixes, "finding_id", "left")


def files_of_scan(files: DataFrame, analyses: DataFrame, metadata: str = "file_metadata") -> DataFrame:
    """Files linked to their scan by the metadata key."""
    keyed = files.withColumn("_scan", F.get_json_object(metadata, "$.analysis_id"))
    scans = analyses.select(F.col("analysis_id").cast("string").alias("_scan"), "analysis_id")
    return keyed.join(scans, "_scan").drop("_scan")


def resolve_file(findings: DataFrame, files: DataFrame) -> DataFrame:
    """File id by scan and path, else the first file of the scan."""
    by_path = files.groupBy("analysis_id", "file_path").agg(F.max("file_id").alias("_exact"))
    first = files.groupBy("analysis_id").agg(F.min("file_id").alias("_first"))
    return (
        findings.join(by_path, ["analysis_id", "file_path"], "left")
        .join(first, "analysis_id", "left")
        .withColumn("code_file_id", F.coalesce("_exact", "_first"))
        .drop("_exact", "_first")
    )


def attach_enrichment(
    findings: DataFrame,
    enriched: DataFrame,
    analyzer: str = "sast-js",
    key: Sequence[str] = ("analysis_id", "file_path", "line_start", "cwe_id"),
) -> DataFrame:
    """Write an enrichment onto one finding per key, the one with the lowest id.

    The target is chosen with a partial aggregate and the update comes from the
    latest enrichment row of the key.
    """
    target = (
        findings.where(F.col("analyzer_type") == analyzer)
        .groupBy(*key)
        .agg(F.min("finding_id").alias("finding_id"))
    )
    latest = enriched.groupBy(*key).agg(
        F.max_by(F.struct("description", "explanation", "explanation_provider"), "enriched_seq").alias("_new")
    )
    updates = target.join(latest, list(key)).select("finding_id", "_new")
    new = {
        c: F.coalesce(F.col(f"_new.{c}"), F.col(c))
        for c in ("description", "explanation", "explanation_provider")
    }
    return findings.join(updates, "finding_id", "left").withColumns(new).drop("_new")


def merge_enriched(findings: DataFrame, enriched: DataFrame) -> DataFrame:
    """Replace explanation columns by (path, line, type) within a scan; the last enrichment wins."""
    key = ["analysis_id", "file_path", "line_start", "vulnerability_type"]
    latest = enriched.groupBy(*key).agg(F.max_by("explanation", "enriched_seq").alias("_new"))
    return (
        findings.join(latest, key, "left")
        .withColumn("explanation", F.coalesce("_new", "explanation"))
        .drop("_new")
    )


def explain_from_kb(findings: DataFrame) -> DataFrame:
    """Knowledge-base text per CWE, a generic text when the CWE is unknown."""
    cwe = F.col("cwe_id")
    generic = F.concat(
        F.lit("A "), F.coalesce("severity", F.lit("unknown")), F.lit(" severity vulnerability was detected: "),
        F.coalesce("title", F.lit("Unknown Vulnerability")),
    )
    return findings.withColumns(
        {
            "vulnerability_name": F.coalesce(
                lookup(knowledge.NAMES, cwe), "title", F.lit("Unknown Vulnerability")
            ),
            "kb_explanation": F.coalesce(lookup(knowledge.EXPLANATIONS, cwe), generic),
            "kb_impact": F.coalesce(lookup(knowledge.IMPACTS, cwe), F.lit(knowledge.DEFAULT_IMPACT)),
            "kb_fix": F.coalesce(lookup(knowledge.FIXES, cwe), F.lit(knowledge.DEFAULT_FIX)),
            "kb_references": F.coalesce(
                lookup({k: F.array(*map(F.lit, v)) for k, v in knowledge.REFERENCES.items()}, cwe),
                F.array().cast("array<string>"),
            ),
        }
    )


def needs_enrichment(findings: DataFrame, fixes: DataFrame) -> DataFrame:
    """What is still missing: an explanation, or a fix for a severe finding."""
    fixed = fixes.select("finding_id").distinct().withColumn("_fixed", F.lit(True))
    severe = F.col("severity").isin("critical", "high")
    flags = findings.join(fixed, "finding_id", "left").withColumns(
        {
            "needs_explanation": F.col("explanation").isNull(),
            "needs_fix": severe & F.col("_fixed").isNull(),
        }
    )
    return flags.where("needs_explanation or needs_fix").drop("_fixed")


def missing_fixes(candidates: DataFrame, fixes: DataFrame) -> DataFrame:
    """Fix rows to insert: only for findings that have none."""
    return candidates.join(fixes.select("finding_id"), "finding_id", "left_anti")


def annotate_lines(files: DataFrame, findings: DataFrame, content: str = "content") -> DataFrame:
    """Every code line with each finding of its scan that covers it; lines without one are kept.

    An interval join by dyadic blocks. Ranges are clamped to the file, and a range of n
    lines becomes at most 2 * log2(n) aligned blocks of 2**k lines, not n rows. A line looks
    for the block of each size that it lies in, of the sizes that its file's findings have.
    """
    key = ["analysis_id", "file_path"]
    sizes = files.select(*key, F.size(F.split(content, "\n")).alias("_lines"))
    last = F.greatest(F.col("line_start"), F.coalesce("line_end", "line_start"))
    covered = findings.join(sizes, key).where("line_start <= _lines")
    covered = covered.withColumns({"_first": F.greatest("line_start", F.lit(1)), "_last": F.least(last, "_lines")})
    blocks = covered.select(*key, "finding_id", "severity", F.explode(dyadic_blocks("_first", "_last")).alias("_b"))
    blocks = blocks.select(*key, "finding_id", "severity", F.col("_b.size").alias("_size"), F.col("_b.number").alias("_number"))
    present = blocks.groupBy(*key).agg(F.collect_set("_size").alias("_sizes"))
    lines = files.select(*key, F.posexplode(F.split(content, "\n")).alias("_pos", "line")).select(
        *key, (F.col("_pos") + 1).alias("line_no"), "line"
    )
    sought = lines.join(present, key).select(*key, "line_no", F.explode("_sizes").alias("_size"))
    sought = sought.withColumn("_number", F.expr("shiftright(line_no, _size)"))
    found = sought.join(blocks, [*key, "_size", "_number"]).select(*key, "line_no", "finding_id", "severity")
    return lines.join(found, [*key, "line_no"], "left")


def dyadic_blocks(first: str, last: str) -> Column:
    """The fewest aligned blocks (size, number) that make up the lines ``first`` to ``last``: lines number * 2**size and on.

    Level by level the range is cut at its ends to whole blocks of the next level: a block
    goes out on the left where the first one is odd, on the right where the last one is even.
    """
    def level(k: Column) -> Column:
        # blocks of 2**k lines that lie in the range, without those that larger blocks take
        low = F.call_function("shiftright", F.col(first) + F.call_function("shiftleft", F.lit(1), k) - 1, k)
        high = F.call_function("shiftright", F.col(last) + 1, k) - 1
        block = lambda test, n: F.when((low <= high) & test, F.struct(k.alias("size"), n.alias("number")))
        left = block(low % 2 == 1, low)
        right = block((high % 2 == 0) & ((low < high) | (low % 2 == 0)), high)
        return F.array(left, right)

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(29)), level)), lambda b: b.isNotNull())


def file_findings(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings whose path equals or ends with a file's name, within one scan.

    A suffix join by length: a path is cut to each length that a name of its scan has, so
    the join is one of equal texts and makes no pair that doesn't match. Paths repeat over
    findings, so each distinct path is cut once.
    """
    names = files.select("analysis_id", F.col("file_name").alias("current_file")).withColumn("_size", F.length("current_file"))
    sizes = names.select("analysis_id", "_size").distinct()
    paths = findings.select("analysis_id", "file_path").distinct().join(sizes, "analysis_id").where(F.length("file_path") >= F.col("_size"))
    ends = paths.withColumn("current_file", F.right("file_path", F.col("_size")))
    matched = ends.join(names, ["analysis_id", "current_file"]).select("analysis_id", "file_path", "current_file")
    columns = ["analysis_id", "current_file", *(c for c in findings.columns if c != "analysis_id")]
    return matched.join(findings, ["analysis_id", "file_path"]).select(columns)


def rescan_lineage(analyses: DataFrame, metadata: str = "analysis_metadata") -> DataFrame:
    """Rescans beside their original; an unknown original stays null."""
    rescans = analyses.withColumn("rescan_of", F.get_json_object(metadata, "$.rescan_of")).where(
        F.col("rescan_of").isNotNull()
    )
    originals = analyses.select(
        F.col("analysis_id").cast("string").alias("rescan_of"),
        F.col("status").alias("original_status"),
        F.col("branch").alias("original_branch"),
    )
    return rescans.join(originals, "rescan_of", "left")


def accessible_files(files: DataFrame, projects: DataFrame, user_id: object, is_superuser: bool) -> DataFrame:
    """Files of projects the user owns; a superuser reaches all files with a project."""
    owned = projects if is_superuser else projects.where(F.col("user_id") == F.lit(user_id))
    return files.join(owned.select("project_id"), "project_id", "left_semi")


def types_overlap(expected: Column, actual: Column) -> Column:
    """Do two arrays of type names share one, ignoring case?"""
    return F.arrays_overlap(F.transform(expected, F.lower), F.transform(actual, F.lower))
