"""Fixed table schemas, as DDL text so that importing needs no session."""

from __future__ import annotations

from pyspark.sql import types as T


def struct(ddl: str) -> T.StructType:
    """The parsed schema; needs an active session."""
    return T.StructType.fromDDL(ddl)


USERS = (
    "id string, email string, full_name string, role string, is_active boolean, "
    "is_superuser boolean, failed_login_attempts int, locked_until timestamp, "
    "last_login timestamp, created_at timestamp"
)
PROJECTS = (
    "id string, name string, description string, repository_url string, branch string, "
    "config string, user_id string, created_at timestamp"
)
CODE_FILES = (
    "id string, project_id string, file_path string, file_name string, file_extension string, "
    "file_size bigint, content string, language string, line_count int, file_metadata string"
)
ANALYSES = (
    "id string, project_id string, user_id string, branch string, scan_name string, "
    "commit_hash string, status string, started_at timestamp, completed_at timestamp, "
    "summary string, analysis_metadata string, error string, created_at timestamp"
)
FINDINGS = (
    "id string, code_file_id string, project_id string, analysis_id string, analyzer_type string, "
    "vulnerability_type string, severity string, title string, description string, cwe_id string, "
    "cvss_score double, cve_id string, file_path string, line_start int, line_end int, "
    "code_snippet string, status string, confidence int, finding_metadata string, "
    "explanation string, explanation_provider string, explanation_generated_at timestamp"
)
FIX_SUGGESTIONS = (
    "id string, finding_id string, title string, description string, priority int, "
    "code_before string, code_after string, language string, ast_validated boolean, "
    "validation_warnings array<string>, confidence double"
)
CLASSES = (
    "id string, name string, instructor_id string, join_code string, is_active boolean"
)
ENROLLMENTS = (
    "id string, class_id string, student_id string, status string, enrolled_at timestamp"
)
KB_ARTICLES = (
    "slug string, title string, category string, cwe_ids string, owasp_category string, "
    "content_markdown string, examples string, is_published boolean, view_count int, "
    "created_at timestamp"
)
SHARE_TOKENS = (
    "id string, token string, analysis_id string, created_by string, expires_at timestamp, "
    "is_revoked boolean, view_count int"
)
SYSTEM_EVENTS = (
    "event_id string, event_type string, severity string, user_id string, message string, "
    "metadata string, created_at timestamp"
)
BENCHMARK_RESULTS = (
    "sample_name string, category string, "
    "expected_findings array<struct<cwe_id:string,vulnerability_type:string,severity:string>>, "
    "actual_findings array<struct<cwe_id:string,vulnerability_type:string,severity:string>>, "
    "scan_time_ms bigint, parser_success boolean, error string"
)

TABLES = {
    "users": USERS,
    "projects": PROJECTS,
    "code_files": CODE_FILES,
    "analyses": ANALYSES,
    "findings": FINDINGS,
    "fix_suggestions": FIX_SUGGESTIONS,
    "classes": CLASSES,
    "enrollments": ENROLLMENTS,
    "kb_articles": KB_ARTICLES,
    "share_tokens": SHARE_TOKENS,
    "system_events": SYSTEM_EVENTS,
    "benchmark_results": BENCHMARK_RESULTS,
}
