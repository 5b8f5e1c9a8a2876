"""Text columns: lines, snippets, names, paths and suppression tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .literal import lookup

# Fixed values.
LANGUAGES = {
    "py": "python",
    "js": "javascript",
    "jsx": "javascript",
    "ts": "typescript",
    "tsx": "typescript",
    "java": "java",
    "go": "go",
    "rs": "rust",
    "c": "c",
    "cpp": "cpp",
    "h": "c",
    "swift": "swift",
}
SCRIPT_LANGUAGES = {
    "py": "python",
    "js": "javascript",
    "ts": "typescript",
    "jsx": "javascript",
    "tsx": "typescript",
}
SQL_CONTEXT = (
    r"(?iU)\b(?:SELECT|INSERT|INTO|UPDATE|DELETE|FROM|WHERE|SET|VALUES|AND|OR)\b"
)
SQL_CONTEXT_STRICT = r"(?iU)\b(?:SELECT|INSERT|INTO|UPDATE|DELETE|FROM|WHERE|SET|VALUES)\b"
SQL_CONTEXT_CHARS = 300
SQL_TEXT = r"(?i)\b(?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|FROM|WHERE)\b"
SQL_NAME = r"(?i)^(?:sql|query|stmt|command)"
SECRET_LINE = (
    r"(?i)(?:password|passwd|secret|api_key|apikey|token|auth_key)\s*[:=]\s*['\"][^'\"]{8,}['\"]"
)
SECRET_LINE_TEMPLATE = r"\$\{[^}]+\}"
SECRET_LINE_SQL = r"(?i)\b(?:select|insert|update|delete|where|from|and|or)\b"
SECRET_LINE_PLACEHOLDER = r"=\s*['\"][^'\"]*\$\{|=\s*['\"][^']*:\w"
UNSAFE_NAME_PARTS = ["..", "~", "|", "<", ">", "*", "?", '"']
FALLBACK_NAME = "unnamed_file"


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal in ``text``."""
    removed = F.replace(text, F.lit(part), F.lit(""))
    return ((F.length(text) - F.length(removed)) / len(part)).cast("int")


def line_count(content: Column) -> Column:
    return occurrences(content, "\n") + 1


def line_after(prefix: Column) -> Column:
    """1-based line of the character that follows ``prefix``."""
    return occurrences(prefix, "\n") + 1


def _slice_lines(content: Column, first: Column, stop: Column) -> Column:
    """Lines ``[first, stop)``, zero-based, clamped to the text."""
    lines = F.split(content, "\n")
    lo = F.greatest(first, F.lit(0))
    hi = F.least(stop, F.size(lines))
    return F.array_join(F.slice(lines, lo + 1, F.greatest(hi - lo, F.lit(0))), "\n")


def snippet_centred(content: Column, line: Column, context: int = 2) -> Column:
    """``context`` lines on both sides of ``line``."""
    return _slice_lines(content, line - context - 1, line + context)


def snippet_uneven(content: Column, line: Column) -> Column:
    """The lines the pattern detector stores: ``[line - 2, line + 2)`` zero-based."""
    return _slice_lines(content, line - 2, line + 2)


def is_comment_head(line_head: Column) -> Column:
    """Does a line that begins like this start a comment?"""
    return line_head.rlike(r"(?U)^\s*(?:#|//)")


def extension_of(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1))


def language_of(path: Column) -> Column:
    return F.coalesce(lookup(LANGUAGES, extension_of(path)), F.lit("plaintext"))


def script_language_of(path: Column) -> Column:
    """Short map, python when nothing matches."""
    return F.when(path.contains("."), F.coalesce(lookup(SCRIPT_LANGUAGES, extension_of(path)), F.lit("python"))).otherwise(
        "python"
    )


def in_sql_context(prefix: Column, strict: bool = False, chars: int | None = SQL_CONTEXT_CHARS) -> Column:
    """Does an SQL word occur in the characters before the match?

    The default word list holds AND and OR, so prose suppresses matches too;
    ``strict`` leaves these two out. ``chars`` is how far back to look, None to
    look at the whole prefix.
    """
    near = prefix if chars is None else F.right(prefix, F.lit(chars))
    return near.rlike(
        SQL_CONTEXT_STRICT if strict else SQL_CONTEXT
    )


def is_false_credential(
    match: Column, prefix: Column, strict: bool = False, chars: int | None = SQL_CONTEXT_CHARS
) -> Column:
    return match.contains("${") | match.contains("#{") | in_sql_context(prefix, strict, chars)


def is_secret_line(line: Column) -> Column:
    """The line-based secret rule with its template and SQL exceptions."""
    matched = F.regexp_substr(line, F.lit(SECRET_LINE))
    sql_line = line.rlike(SECRET_LINE_SQL) & line.rlike(SECRET_LINE_PLACEHOLDER)
    return line.rlike(SECRET_LINE) & ~matched.rlike(SECRET_LINE_TEMPLATE) & ~sql_line


def looks_like_sql(arg_kind: Column, arg_text: Column) -> Column:
    """Literals and templates need an SQL word, an identifier an SQL-like name."""
    return (
        F.when(arg_kind.isin("literal", "template", "concat"), arg_text.rlike(SQL_TEXT))
        .when(arg_kind == "identifier", arg_text.rlike(SQL_NAME))
        .otherwise(F.lit(False))
    )


def safe_filename(name: Column) -> Column:
    """Base name without control characters and shell characters; never empty."""
    out = F.regexp_replace(F.substring_index(name, "/", -1), r"[\x00\r\n]", "")
    for part in UNSAFE_NAME_PARTS:
        out = F.replace(out, F.lit(part), F.lit(""))
    out = F.btrim(out, F.lit(". "))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(FALLBACK_NAME))


def display_name(scan_name: Column, branch: Column) -> Column:
    return F.coalesce(F.nullif(scan_name, F.lit("")), F.nullif(branch, F.lit("")), F.lit("Unknown"))


def short_label(text: Column, limit: int = 25) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)


def short_id(ident: Column) -> Column:
    return F.left(ident.cast("string"), F.lit(8))


def prompt_hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(16))


def memo_key(template: Column, model: Column, text: Column) -> Column:
    return F.concat(F.lit("prompt_cache:"), template, F.lit(":"), model, F.lit(":"), prompt_hash(text))
