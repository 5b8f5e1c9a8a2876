"""Facts about Python files, and the checks over them.

The Arrow function only reports what a file contains: calls and assignments with
a few neutral attributes, or that it does not parse. Which facts are defects is
decided by the Spark filters below.
"""

from __future__ import annotations

import ast
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.literal import literal_table

FACTS = (
    "file_id string, file_path string, kind string, seq int, line int, snippet string, "
    "func string, owner string, is_name boolean, dynamic_args int, concat_args int, "
    "kw_shell boolean, kw_loader string, targets array<string>, literal string, "
    "fragments string, has_dynamic boolean, error string, content string, "
    "uses array<struct<pos:int,name:string,callee:string,is_read:boolean>>, n_args int, "
    "arg0_kind string, arg0_text string, arg1_kind string"
)
_ARROW = {
    "string": pa.string(),
    "int": pa.int32(),
    "boolean": pa.bool_(),
    "array<string>": pa.list_(pa.string()),
    "array<struct<pos:int,name:string,callee:string,is_read:boolean>>": pa.list_(
        pa.struct([("pos", pa.int32()), ("name", pa.string()), ("callee", pa.string()), ("is_read", pa.bool_())])
    ),
}
ARROW_FACTS = pa.schema([(name, _ARROW[kind]) for name, kind in (f.split() for f in FACTS.split(", "))])

BATCH_ROWS = 5000

# Fixed values.
SQL_CALLS = ["execute", "executemany", "raw", "raw_query"]
SQL_WORDS = ["SELECT", "INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER"]
SHELL_CALLS = ["system", "popen", "call", "run", "check_output", "check_call"]
EVAL_CALLS = ["eval", "exec"]
WEAK_HASHES = ["md5", "sha1"]
SECRET_KINDS = {
    "password": ["password", "passwd", "pwd"],
    "api_key": [
        "api_key", "apikey", "api_secret", "secret_key", "access_key",
        "private_key", "secret", "credential", "client_secret",
    ],
    "token": ["token", "auth_token", "access_token", "bearer_token"],
}
PLACEHOLDERS = [
    "", "none", "null", "todo", "changeme", "example", "your_key_here", "xxxxxx", "placeholder",
]
MIN_SECRET = 6
CHECK_FIELDS = ("rule", "vulnerability_type", "cwe_id", "severity", "confidence", "text")
CHECKS = [
    ("sql_call", "SQL Injection", "CWE-89", "high", 0.85, "String formatting detected in SQL query. Use parameterized queries instead."),
    ("sql_function", "SQL Injection", "CWE-89", "high", 0.75, "String formatting detected in SQL query execution."),
    ("sql_assign", "SQL Injection", "CWE-89", "high", 0.80, "Dynamic value interpolated/concatenated into SQL query. Use parameterized queries instead."),
    ("shell", "Command Injection", "CWE-78", "critical", 0.9, "String formatting in shell command. Use subprocess with shell=False and list arguments."),
    ("shell_true", "Command Injection", "CWE-78", "high", 0.9, "subprocess.call with shell=True is vulnerable to command injection."),
    ("secret", "Hardcoded Secret", "CWE-798", "high", 0.8, "Hardcoded {} detected. Use environment variables or a secrets manager."),
    ("eval", "Dangerous Function", "CWE-94", "critical", 0.95, "Use of {}() is dangerous and can lead to code injection."),
    ("pickle", "Insecure Deserialization", "CWE-502", "high", 0.85, "pickle.loads() on untrusted data can lead to arbitrary code execution."),
    ("yaml", "Insecure Deserialization", "CWE-502", "medium", 0.8, "yaml.load() without SafeLoader can lead to arbitrary code execution. Use yaml.safe_load()."),
    ("hash", "Weak Cryptography", "CWE-327", "medium", 0.85, "Weak hash function {} detected. Use SHA-256 or stronger."),
    ("path", "Path Traversal", "CWE-22", "high", 0.75, "String concatenation in file path with variable. Validate and sanitize path inputs."),
]


def _text_parts(node: ast.expr) -> tuple[list[str], bool]:
    """String constants joined by + or an f-string, and whether anything else is mixed in."""
    stack, parts, dynamic = [node], [], False
    while stack:
        item = stack.pop()
        if isinstance(item, ast.BinOp) and isinstance(item.op, ast.Add):
            stack += [item.right, item.left]
        elif isinstance(item, ast.JoinedStr):
            for value in item.values:
                if isinstance(value, ast.Constant):
                    parts.append(str(value.value))
                else:
                    dynamic = True
        elif isinstance(item, ast.Constant) and isinstance(item.value, str):
            parts.append(item.value)
        else:
            dynamic = True
    return parts, dynamic


def _dotted(node: ast.expr) -> str | None:
    """``a.b.c`` for a chain of attributes on a name."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def _uses(expression: ast.AST, pos: int) -> Iterator[dict]:
    """Names and attribute chains read in an expression, with the innermost call around them."""
    stack: list[tuple[ast.AST, str | None]] = [(expression, None)]
    while stack:
        node, callee = stack.pop()
        chain = _dotted(node) if isinstance(node, (ast.Name, ast.Attribute)) else None
        if chain:
            name, *members = chain.split(".")
            yield {"pos": pos, "name": name, "callee": callee, "is_read": False}
            if members:
                yield {"pos": pos, "name": chain, "callee": callee, "is_read": True}
        elif isinstance(node, ast.Call):
            inner = _dotted(node.func) or callee
            if isinstance(node.func, ast.Attribute):
                stack.append((node.func.value, callee))
            stack += [(child, inner) for child in (*node.args, *node.keywords)]
        else:
            stack += [(child, callee) for child in ast.iter_child_nodes(node)]


def _arg_kind(node: ast.expr) -> tuple[str, str | None]:
    """What an argument is, and the text that is known of it."""
    if isinstance(node, ast.Constant):
        kinds = {str: "literal", bool: "boolean", int: "number", float: "number"}
        kind = kinds.get(type(node.value), "other")
        return kind, node.value if kind == "literal" else None
    if isinstance(node, ast.JoinedStr):
        return ("template" if _text_parts(node)[1] else "static_template"), " ".join(_text_parts(node)[0])
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        return "concat", " ".join(_text_parts(node)[0])
    if isinstance(node, ast.Name):
        return "identifier", node.id
    return ("object" if isinstance(node, ast.Dict) else "other"), None


def _call_fact(node: ast.Call) -> dict:
    func = node.func
    attribute = isinstance(func, ast.Attribute)
    keywords = {k.arg: k.value for k in node.keywords}
    shell, loader = keywords.get("shell"), keywords.get("Loader")
    concats = [a for a in node.args if isinstance(a, ast.BinOp) and isinstance(a.op, ast.Add)]
    kinds = [_arg_kind(a) for a in node.args[:2]] + [(None, None)] * 2
    return {
        "kind": "call",
        "uses": [use for pos, arg in enumerate(node.args) for use in _uses(arg, pos)],
        "n_args": len(node.args),
        "arg0_kind": kinds[0][0],
        "arg0_text": kinds[0][1],
        "arg1_kind": kinds[1][0],
        "func": func.attr if attribute else getattr(func, "id", None),
        "owner": getattr(func.value, "id", None) if attribute else None,
        "is_name": isinstance(func, ast.Name),
        "dynamic_args": sum(isinstance(a, (ast.JoinedStr, ast.BinOp)) for a in node.args),
        "concat_args": sum(any(isinstance(x, ast.Name) for x in (a.left, a.right)) for a in concats),
        "kw_shell": isinstance(shell, ast.Constant) and shell.value is True,
        "kw_loader": loader.id if isinstance(loader, ast.Name) else None,
    }


def _assign_fact(node: ast.Assign) -> dict:
    value = node.value
    parts, dynamic = _text_parts(value)
    constant = isinstance(value, ast.Constant) and isinstance(value.value, str)
    return {
        "kind": "assign",
        "targets": [t.id for t in node.targets if isinstance(t, ast.Name)],
        "uses": list(_uses(value, 0)),
        "literal": value.value if constant else None,
        "fragments": " ".join(parts),
        "has_dynamic": dynamic,
    }


def _error_fact(exc: Exception, content: str) -> dict:
    message = f"Line {getattr(exc, 'lineno', 0)}: {getattr(exc, 'msg', exc)}"
    return {"kind": "error", "error": message, "content": content}


def _writable(value):
    """The value with lone surrogates, which sources may spell but no column can hold, replaced."""
    if isinstance(value, str):
        return value if value.isascii() else value.encode("utf-8", "replace").decode()
    return [_writable(v) for v in value] if isinstance(value, list) else value


def _file_facts(content: str) -> list[dict]:
    """The facts of one file; whatever goes wrong in it becomes its error row."""
    try:
        found = _facts(content)
    except Exception as exc:  # one file must not end the job
        found = [_error_fact(exc, content)]
    return [{k: _writable(v) for k, v in fact.items()} for fact in found]


#: Nodes that hold neither calls nor assignments.
LEAVES = (ast.Constant, ast.Name, ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop, ast.alias)


def _inner_nodes(tree: ast.AST) -> Iterator[ast.AST]:
    """``ast.walk`` without leaves, which are most of a tree; the others come in its order."""
    waiting = deque([tree])
    while waiting:
        node = waiting.popleft()
        yield node
        for field in node._fields:
            value = getattr(node, field, None)
            if isinstance(value, list):
                waiting.extend(v for v in value if isinstance(v, ast.AST) and not isinstance(v, LEAVES))
            elif isinstance(value, ast.AST) and not isinstance(value, LEAVES):
                waiting.append(value)


def _facts(content: str) -> list[dict]:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as exc:
        return [_error_fact(exc, content)]
    lines = content.split("\n")
    out = [{"kind": "parsed"}]
    for node in _inner_nodes(tree):
        if isinstance(node, ast.Call):
            fact = _call_fact(node)
        elif isinstance(node, ast.Assign):
            fact = _assign_fact(node)
        else:
            continue
        fact["line"] = node.lineno
        fact["snippet"] = "\n".join(lines[max(0, node.lineno - 3) : node.lineno + 2])
        out.append(fact)
    return out


def _facts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    for batch in batches:
        for file_id, path, content in zip(*(column.to_pylist() for column in batch.columns)):
            rows += [
                {"file_id": file_id, "file_path": path, "seq": i, **fact}
                for i, fact in enumerate(_file_facts(content or ""))
            ]
            # Whole files per batch, cut early so that large files do not pile up.
            if len(rows) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW_FACTS)
                rows = []
    yield pa.RecordBatch.from_pylist(rows, schema=ARROW_FACTS)


def python_facts(files: DataFrame) -> DataFrame:
    """Calls and assignments of every file, plus one status row per file.

    The status row of a file that does not parse carries its content, so the
    fallback detector needs no join back to the corpus.
    """
    rows = files.select(F.col("file_id").cast("string").alias("file_id"), "file_path", "content")
    return rows.mapInArrow(_facts_of, FACTS)


def unparsed_files(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'error'").select("file_id", "file_path", "content", "error")


def _secret_kind(name: Column) -> Column:
    out = None
    for kind, words in SECRET_KINDS.items():
        test = name.rlike("|".join(words))
        out = F.when(test, F.lit(kind)) if out is None else out.when(test, F.lit(kind))
    return out


def _check(rule: str, test: Column, copies: Column | None = None, detail: Column | None = None) -> Column:
    """A hit of one check: how often it counts, and the word that goes into its description."""
    times = F.lit(1) if copies is None else copies
    return F.struct(
        F.lit(rule).alias("rule"),
        F.when(test, times).otherwise(F.lit(0)).alias("copies"),
        (F.lit("") if detail is None else detail).alias("detail"),
    )


def python_findings(facts: DataFrame) -> DataFrame:
    """The checks. A call with several unsafe arguments counts once per argument."""
    func, owner, dynamic = F.col("func"), F.col("owner"), F.col("dynamic_args")
    is_call, is_assign = F.col("kind") == "call", F.col("kind") == "assign"
    method, named = is_call & ~F.col("is_name"), is_call & F.col("is_name")
    safe_loader = F.coalesce(F.lower("kw_loader").contains("safe"), F.lit(False))
    sql_text = F.upper("fragments").rlike("|".join(SQL_WORDS))
    hits = F.array(
        _check("sql_call", method & func.isin(SQL_CALLS), dynamic),
        _check("sql_function", named & func.isin(SQL_CALLS), dynamic),
        _check("sql_assign", is_assign & F.col("has_dynamic") & sql_text),
        _check("shell", is_call & func.isin(SHELL_CALLS), dynamic),
        _check("shell_true", method & (func == "call") & F.col("kw_shell")),
        _check("eval", named & func.isin(EVAL_CALLS), detail=func),
        _check("pickle", method & (func == "loads") & (owner == "pickle")),
        _check("yaml", method & (func == "load") & (owner == "yaml") & ~safe_loader),
        _check("hash", method & func.isin(WEAK_HASHES), detail=func),
        _check("path", named & (func == "open"), F.col("concat_args")),
    )
    # A literal with several targets counts once per secret name.
    real = is_assign & (F.length("literal") >= MIN_SECRET) & ~F.lower("literal").isin(PLACEHOLDERS)
    secrets = F.transform(
        F.filter(F.transform("targets", lambda t: _secret_kind(F.lower(t))), lambda k: k.isNotNull()),
        lambda kind: _check("secret", F.lit(True), detail=kind),
    )
    all_hits = F.when(real, secrets).otherwise(F.filter(hits, lambda h: h["copies"] > 0))
    # A literal assignment has no dynamic part, so the two kinds of hits exclude each other.
    found = facts.where(is_call | is_assign).select("*", F.inline(all_hits)).select(
        "file_id", "file_path", "line", "snippet", "rule", "detail", F.explode(F.array_repeat(F.lit(1), F.col("copies")))
    )
    checks = literal_table(
        facts.sparkSession,
        [dict(zip(CHECK_FIELDS, row)) for row in CHECKS],
        "rule string, vulnerability_type string, cwe_id string, severity string, confidence double, text string",
    )
    return found.join(checks, "rule").select(
        "file_id",
        "file_path",
        "vulnerability_type",
        "severity",
        "cwe_id",
        F.col("line").alias("line_start"),
        F.col("line").alias("line_end"),
        F.col("snippet").alias("code_snippet"),
        F.col("vulnerability_type").alias("title"),
        F.replace("text", F.lit("{}"), F.col("detail")).alias("description"),
        "confidence",
        F.lit("python_ast").alias("analyzer_type"),
        "rule",
    )
