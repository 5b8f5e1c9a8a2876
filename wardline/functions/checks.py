"""Upload, archive and fix checks as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsonx import strip
from .text import occurrences

# Fixed values.
ALLOWED_EXTENSIONS = [
    ".py", ".js", ".ts", ".java", ".go", ".rs", ".c", ".cpp", ".h", ".hpp", ".swift",
]
MAX_FILE_SIZE = 10485760
EXPECTED_MIME = {
    ".py": ["text/x-python", "text/x-script.python", "application/x-python-code"],
    ".js": ["text/javascript", "application/javascript", "text/x-js"],
    ".ts": ["text/typescript", "application/typescript", "text/x-typescript"],
    ".java": ["text/x-java", "text/x-java-source"],
    ".go": ["text/x-go", "text/go"],
    ".rs": ["text/x-rust", "text/rust"],
    ".c": ["text/x-c", "text/c"],
    ".cpp": ["text/x-c++", "text/c++"],
    ".h": ["text/x-c", "text/c", "text/x-chdr"],
    ".hpp": ["text/x-c++", "text/c++"],
    ".swift": ["text/x-swift"],
    ".zip": ["application/zip", "application/x-zip-compressed"],
}
MAX_ARCHIVE_ENTRIES = 1000
MAX_ARCHIVE_DEPTH = 3
MAX_ARCHIVE_RATIO = 10.0
MAX_ARCHIVE_BYTES = 100 * 1024 * 1024
DANGEROUS_CALLS = {
    "eval(": "eval() usage",
    "exec(": "exec() usage",
    "__import__(": "__import__() usage",
    "pickle.loads(": "pickle.loads() usage",
    "yaml.load(": "yaml.load() without SafeLoader",
    "subprocess.call(": "subprocess.call() with potential shell=True",
    "innerHTML": "innerHTML assignment",
}


def suffix_of(name: Column) -> Column:
    """Extension with its dot, lower case; empty for none and for dot files."""
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*?(\.[^./]+)$", 1))


def upload_errors(name: Column, size: Column, mime: Column) -> Column:
    ext = suffix_of(name)
    expected = _expected_mime(ext)
    mismatch = F.coalesce(~F.array_contains(expected, mime), F.lit(False))
    tolerated = mime.startswith("text/") | (mime == "application/octet-stream")
    return F.array_compact(
        F.array(
            F.when(~ext.isin(ALLOWED_EXTENSIONS), F.concat(F.lit("extension not allowed: "), ext)),
            F.when(size > MAX_FILE_SIZE, F.concat(F.lit("file too large: "), size.cast("string"))),
            F.when(mismatch & ~tolerated, F.concat(F.lit("mime not allowed: "), mime)),
        )
    )


def upload_warnings(name: Column, mime: Column) -> Column:
    expected = _expected_mime(suffix_of(name))
    mismatch = F.coalesce(~F.array_contains(expected, mime), F.lit(False))
    tolerated = mime.startswith("text/") | (mime == "application/octet-stream")
    return F.array_compact(
        F.array(F.when(mismatch & tolerated, F.concat(F.lit("mime unexpected: "), mime)))
    )


def _expected_mime(ext: Column) -> Column:
    pairs = []
    for key, values in EXPECTED_MIME.items():
        pairs += [F.lit(key), F.array(*[F.lit(v) for v in values])]
    return F.element_at(F.create_map(*pairs), ext)


def regressions(before: Column, after: Column) -> Column:
    """Dangerous calls that the new code holds at least as often as the old code."""
    found = []
    for call, label in DANGEROUS_CALLS.items():
        stays = (
            before.contains(call)
            & after.contains(call)
            & (occurrences(after, call) >= occurrences(before, call))
        )
        found.append(F.when(stays, F.lit(label)))
    return F.array_compact(F.array(*found))


def fix_warnings(before: Column, after: Column, syntax_error: Column | None = None) -> Column:
    """All warnings of a fix; an empty fix is not checked further."""
    same = F.when(strip(after) == strip(before), F.lit("Fixed code is identical to original code"))
    empty = strip(after) == ""
    syntax = F.lit(None).cast("string") if syntax_error is None else syntax_error
    again = F.transform(
        regressions(before, after),
        lambda p: F.concat(F.lit("Fix may re-introduce vulnerability: "), p),
    )
    return F.when(empty, F.array_compact(F.array(same, F.lit("Fixed code is empty")))).otherwise(
        F.concat(F.array_compact(F.array(same, syntax)), again)
    )


def member_is_unsafe(name: Column) -> Column:
    return name.startswith("/") | name.contains("..") | name.contains("\x00")


def client_key(forwarded: Column, host: Column, cookie: Column) -> Column:
    """Rightmost forwarded address, else the host, else the cookie."""
    hops = F.filter(F.transform(F.split(forwarded, ","), strip), lambda h: h != "")
    return F.coalesce(
        F.try_element_at(hops, F.lit(-1)), F.nullif(host, F.lit("")), F.nullif(cookie, F.lit(""))
    )
