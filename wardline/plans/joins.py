"""Joins."""

from pyspark.sql import functions as F

from ..operators import joins, knowledge
from .registry import Tables, query

ENRICHED = """
enriched as (
  select analysis_id, file_path, line_start, cwe_id, severity as vulnerability_type, l_seq as enriched_seq,
         concat('new ', cast(l_seq as varchar)) as description, concat('{"n": ', cast(l_seq as varchar), '}') as explanation,
         'kb' as explanation_provider
  from (select *, cast(split_part(finding_id, '-', 3) as bigint) * 100000000 + cast(split_part(finding_id, '-', 5) as bigint) as l_seq from v_findings)
  where line_start % 3 = 0
)
"""


def _enriched(t: Tables):
    parts = F.split("finding_id", "-")
    seq = parts[2].cast("bigint") * 100000000 + parts[4].cast("bigint")
    return t.v_findings.where("line_start % 3 = 0").select(
        "analysis_id",
        "file_path",
        "line_start",
        "cwe_id",
        F.col("severity").alias("vulnerability_type"),
        seq.alias("enriched_seq"),
        F.concat(F.lit("new "), seq.cast("string")).alias("description"),
        F.concat(F.lit('{"n": '), seq.cast("string"), F.lit("}")).alias("explanation"),
        F.lit("kb").alias("explanation_provider"),
    )


@query(
    "j01_class_students",
    "select e.class_id, e.student_id, u.full_name, u.email from v_enrollments e join v_users u on e.student_id = u.user_id"
    " where e.status = 'active'",
)
def _(t: Tables):
    return joins.class_students(t.v_enrollments, t.v_users).select("class_id", "student_id", "full_name", "email")


@query(
    "j02_my_classes",
    "select e.student_id, c.class_id, c.name, u.full_name as instructor_name, u.email as instructor_email,"
    " (select count(*) from v_enrollments x where x.class_id = c.class_id and x.status = 'active') as student_count"
    " from v_enrollments e join v_classes c on e.class_id = c.class_id join v_users u on c.instructor_id = u.user_id"
    " where e.status = 'active' and c.is_active",
)
def _(t: Tables):
    return joins.my_classes(t.v_classes, t.v_enrollments, t.v_users).select(
        "student_id", "class_id", "name", "instructor_name", "instructor_email", "student_count"
    )


@query(
    "j03_analyses_of_students",
    "select analysis_id, user_id from v_analyses where user_id in (select student_id from v_enrollments where status = 'active')",
)
def _(t: Tables):
    return joins.analyses_of_students(t.v_analyses, t.v_enrollments).select("analysis_id", "user_id")


@query(
    "j04_with_fixes",
    "select f.finding_id, x.fix_id, x.title from v_findings f left join v_fixes x on f.finding_id = x.finding_id",
)
def _(t: Tables):
    return joins.with_fixes(t.v_findings.select("finding_id"), t.v_fixes.select("finding_id", "fix_id", "title"))


@query(
    "j05_files_of_scan",
    "select f.file_id, a.analysis_id, f.file_path from v_files f join v_analyses a"
    " on json_extract_string(f.file_metadata, '$.analysis_id') = cast(a.analysis_id as varchar)",
)
def _(t: Tables):
    return joins.files_of_scan(t.v_files.drop("analysis_id"), t.v_analyses).select("file_id", "analysis_id", "file_path")


@query(
    "j06_resolve_file",
    "with p as (select analysis_id, concat('src/d0/', file_path) as file_path, finding_id from v_findings),"
    " exact as (select analysis_id, file_path, max(file_id) as fid from v_files group by 1, 2),"
    " firsts as (select analysis_id, min(file_id) as fid from v_files group by 1)"
    " select p.finding_id, coalesce(e.fid, x.fid) as code_file_id from p"
    " left join exact e on p.analysis_id = e.analysis_id and p.file_path = e.file_path"
    " left join firsts x on p.analysis_id = x.analysis_id",
)
def _(t: Tables):
    findings = t.v_findings.select(
        "analysis_id", F.concat(F.lit("src/d0/"), "file_path").alias("file_path"), "finding_id"
    )
    return joins.resolve_file(findings, t.v_files).select("finding_id", "code_file_id")


@query(
    "j07_attach_enrichment",
    "with " + ENRICHED + ", target as (select min(finding_id) as finding_id, analysis_id, file_path, line_start, cwe_id"
    " from v_findings where analyzer_type = 'sast-js' group by 2, 3, 4, 5),"
    " latest as (select * from enriched qualify row_number() over (partition by analysis_id, file_path, line_start, cwe_id order by enriched_seq desc) = 1),"
    " up as (select t.finding_id, l.* from target t join latest l using (analysis_id, file_path, line_start, cwe_id))"
    " select f.finding_id, u.description, coalesce(u.explanation, f.explanation) as explanation, u.explanation_provider"
    " from v_findings f left join up u on f.finding_id = u.finding_id",
)
def _(t: Tables):
    findings = t.v_findings.withColumns(
        {"description": F.lit(None).cast("string"), "explanation_provider": F.lit(None).cast("string")}
    )
    return joins.attach_enrichment(findings, _enriched(t)).select(
        "finding_id", "description", "explanation", "explanation_provider"
    )


@query(
    "j08_merge_enriched",
    "with " + ENRICHED + ", latest as (select analysis_id, file_path, line_start, vulnerability_type, arg_max(explanation, enriched_seq) as e"
    " from enriched group by 1, 2, 3, 4)"
    " select f.finding_id, coalesce(l.e, f.explanation) as explanation from v_findings f left join latest l"
    " on f.analysis_id = l.analysis_id and f.file_path = l.file_path and f.line_start = l.line_start and f.severity = l.vulnerability_type",
)
def _(t: Tables):
    findings = t.v_findings.withColumn("vulnerability_type", F.col("severity"))
    return joins.merge_enriched(findings, _enriched(t)).select("finding_id", "explanation")


def _sql_map(table: dict, default: str) -> str:
    branches = " ".join(f"when '{k}' then '{v.replace(chr(39), chr(39) * 2)}'" for k, v in table.items())
    return f"case cwe_id {branches} else {default} end"


@query(
    "j09_explain_from_kb",
    "select finding_id, " + _sql_map(knowledge.NAMES, "concat('T ', file_path)") + " as vulnerability_name, "
    + _sql_map(
        knowledge.EXPLANATIONS, "concat('A ', severity, ' severity vulnerability was detected: ', 'T ', file_path)"
    ) + " as kb_explanation, "
    + _sql_map(knowledge.IMPACTS, f"'{knowledge.DEFAULT_IMPACT}'") + " as kb_impact, "
    + _sql_map(knowledge.FIXES, f"'{knowledge.DEFAULT_FIX}'") + " as kb_fix, "
    + _sql_map({cwe: " ".join(links) for cwe, links in knowledge.REFERENCES.items()}, "''") + " as kb_references from v_findings",
)
def _(t: Tables):
    findings = t.v_findings.withColumn("title", F.concat(F.lit("T "), "file_path"))
    return joins.explain_from_kb(findings).select(
        "finding_id", "vulnerability_name", "kb_explanation", "kb_impact", "kb_fix",
        F.array_join("kb_references", " ").alias("kb_references"),
    )


@query(
    "j10_needs_enrichment",
    "select * from (select finding_id, explanation is null as needs_explanation, severity in ('critical', 'high') and"
    " finding_id not in (select finding_id from v_fixes) as needs_fix from v_findings) where needs_explanation or needs_fix",
)
def _(t: Tables):
    return joins.needs_enrichment(t.v_findings, t.v_fixes).select("finding_id", "needs_explanation", "needs_fix")


@query(
    "j11_insert_missing_fix",
    "select finding_id, severity from v_findings where finding_id not in (select finding_id from v_fixes)",
)
def _(t: Tables):
    return joins.missing_fixes(t.v_findings.select("finding_id", "severity"), t.v_fixes)


# Two scans hold a file of the same path, with other lines and other findings.
LINES = (
    "with files as (select file_id % 2 as analysis_id, concat('src/', cast(file_id // 2 as varchar)) as file_path, string_split(content, chr(10)) as ls from v_code_files),"
    " lines as (select analysis_id, file_path, unnest(range(1, len(ls) + 1)) as line_no, unnest(ls) as line from files),"
    " marks as (select doc_id as finding_id, doc_id % 2 as analysis_id, concat('src/', cast(doc_id // 2 as varchar)) as file_path,"
    " case when doc_id % 4 = 0 then 'high' else 'low' end as severity,"
    " 1 + doc_id % 3 as line_start, case when doc_id % 5 = 0 then null else doc_id % 7 end as line_end from documents)"
)


def _shared_path(doc_id: str) -> dict:
    return {
        "analysis_id": F.col(doc_id) % 2,
        "file_path": F.concat(F.lit("src/"), F.floor(F.col(doc_id) / 2).cast("string")),
    }


@query(
    "j12_annotate_lines",
    LINES + " select l.analysis_id, l.file_path, cast(l.line_no as integer) as line_no, md5(l.line) as line_md5, m.finding_id, m.severity from lines l left join marks m"
    " on l.analysis_id = m.analysis_id and l.file_path = m.file_path and (l.line_no = m.line_start or l.line_no between m.line_start and m.line_end)",
)
def _(t: Tables):
    files = t.v_code_files.withColumns(_shared_path("file_id"))
    findings = t.documents.withColumns(_shared_path("doc_id")).select(
        "analysis_id",
        "file_path",
        F.col("doc_id").alias("finding_id"),
        F.when(F.col("doc_id") % 4 == 0, "high").otherwise("low").alias("severity"),
        (F.col("doc_id") % 3 + 1).cast("int").alias("line_start"),
        F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 7).cast("int").alias("line_end"),
    )
    return joins.annotate_lines(files, findings).select(
        "analysis_id", "file_path", "line_no", F.md5("line").alias("line_md5"), "finding_id", "severity"
    )


@query(
    "j13_file_findings",
    "with files as (select distinct analysis_id, regexp_replace(file_path, '^src/', '') as file_name from v_files)"
    " select f.finding_id, x.file_name as current_file from files x join"
    " (select finding_id, analysis_id % 100 as analysis_id, concat('src/d1/', file_path) as file_path from v_findings) f"
    " on x.analysis_id = f.analysis_id and (f.file_path = x.file_name or ends_with(f.file_path, x.file_name))",
)
def _(t: Tables):
    files = t.v_files.select(
        "analysis_id", F.regexp_replace("file_path", "^src/", "").alias("file_name")
    ).distinct()
    findings = t.v_findings.select(
        "finding_id",
        (F.col("analysis_id") % 100).alias("analysis_id"),
        F.concat(F.lit("src/d1/"), "file_path").alias("file_path"),
    )
    return joins.file_findings(files, findings).select("finding_id", "current_file")


@query(
    "j14_rescan_lineage",
    "select a.analysis_id, json_extract_string(a.analysis_metadata, '$.rescan_of') as rescan_of, o.status as original_status"
    " from v_analyses a left join v_analyses o on json_extract_string(a.analysis_metadata, '$.rescan_of') = cast(o.analysis_id as varchar)"
    " where json_extract_string(a.analysis_metadata, '$.rescan_of') is not null",
)
def _(t: Tables):
    return joins.rescan_lineage(t.v_analyses).select("analysis_id", "rescan_of", "original_status")


@query(
    "j15_type_overlap",
    "select p_partkey as sample, lower(p_type) = lower(p_name) or lower(p_brand) = 'brand#2' or lower(p_name) = 'brand#2'"
    " or lower(p_brand) = lower(p_type) as overlap from part",
)
def _(t: Tables):
    expected = F.array(F.upper("p_type"), F.lit("BRAND#2"))
    actual = F.array("p_name", "p_brand")
    return t.part.select(F.col("p_partkey").alias("sample"), joins.types_overlap(expected, actual).alias("overlap"))


@query(
    "j16_project_access",
    "select file_id, project_id from v_files where project_id in (select project_id from v_projects where user_id = 14)",
)
def _(t: Tables):
    return joins.accessible_files(t.v_files, t.v_projects, 14, False).select("file_id", "project_id")
