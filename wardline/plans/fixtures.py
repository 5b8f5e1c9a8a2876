"""Views that give the test tables the shape of the engine's tables.

Each view is a list of expressions over one table or view. The text is valid in
Spark and in the checking database, so both sides start from equal rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import windows

VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "v_users": (
        "customer",
        {
            "user_id": "c_custkey",
            "email": "concat(lower(replace(c_name, '#', '.')), '@example.com')",
            "full_name": "c_name",
            "role": "case c_mktsegment when 'BUILDING' then 'instructor' when 'MACHINERY' then 'admin' else 'developer' end",
            "is_active": "c_acctbal >= 0",
        },
    ),
    "v_classes": (
        "nation",
        {
            "class_id": "n_nationkey",
            "name": "n_name",
            "instructor_id": "n_regionkey",
            "is_active": "n_nationkey % 5 <> 0",
        },
    ),
    "v_enrollments": (
        "customer",
        {
            "class_id": "c_nationkey",
            "student_id": "c_custkey",
            "status": "case when c_acctbal >= 0 then 'active' else 'dropped' end",
        },
    ),
    "v_projects": (
        "supplier",
        {
            "project_id": "s_suppkey",
            "name": "s_name",
            "user_id": "s_suppkey * 7",
            "is_active": "s_acctbal >= 0",
        },
    ),
    "v_analyses": (
        "orders",
        {
            "analysis_id": "o_orderkey",
            "user_id": "o_custkey",
            "project_id": "case when o_orderkey % 3 = 0 then null else o_custkey % 10 end",
            "status": "case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'pending' end",
            "branch": "o_orderpriority",
            "scan_name": "case when o_orderkey % 4 = 0 then '' else concat('scan ', cast(o_orderkey % 7 as varchar(20))) end",
            "file_count": "o_orderkey % 6",
            "analysis_metadata": (
                "case when o_orderkey % 11 = 0 then null else concat('{\"files_completed\": ', cast(o_orderkey % 5 as varchar(20)),"
                " ', \"file_count\": ', cast(o_orderkey % 6 as varchar(20)),"
                " case when o_orderkey % 2 = 0 then concat(', \"uploaded_by\": \"', cast(o_custkey + 1 as varchar(20)), '\"') else '' end,"
                " case when o_orderkey % 10 = 3 then concat(', \"rescan_of\": \"', cast(o_orderkey + 5 as varchar(20)), '\"') else '' end,"
                " '}') end"
            ),
            "created_at": "o_orderdate",
        },
    ),
    "v_findings": (
        "lineitem",
        {
            "finding_id": (
                "concat(cast(l_orderkey as varchar(20)), '-', cast(l_partkey as varchar(20)), '-', cast(l_suppkey as varchar(20)),"
                " '-', cast(l_linenumber as varchar(20)), '-', cast(cast(round(l_extendedprice * 100) as bigint) as varchar(20)))"
            ),
            "analysis_id": "l_orderkey",
            "file_path": "concat('file_', cast(l_partkey % 50 as varchar(20)))",
            "line_start": "cast(l_quantity as int)",
            "cwe_id": (
                "concat('CWE-', case l_partkey % 6 when 0 then '89' when 1 then '79' when 2 then '78' when 3 then '94'"
                " when 4 then '22' else '798' end)"
            ),
            "severity": (
                "case l_partkey % 5 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' when 3 then 'low' else 'info' end"
            ),
            "confidence": "1 - l_discount",
            "analyzer_type": "case l_returnflag when 'R' then 'sast-js' when 'A' then 'python_ast' else 'regex' end",
            "status": "case l_linestatus when 'F' then 'fixed' else 'new' end",
            "stage": "case when l_suppkey % 4 = 0 then 2 else 1 end",
            "explanation": "case when l_linenumber % 3 = 0 then concat('why ', cast(l_suppkey as varchar(20))) else null end",
        },
    ),
    "v_fixes": (
        "lineitem where l_returnflag = 'R'",
        {
            "fix_id": (
                "concat('fix-', cast(l_orderkey as varchar(20)), '-', cast(l_partkey as varchar(20)), '-', cast(l_suppkey as varchar(20)),"
                " '-', cast(l_linenumber as varchar(20)), '-', cast(cast(round(l_extendedprice * 100) as bigint) as varchar(20)))"
            ),
            "finding_id": (
                "concat(cast(l_orderkey as varchar(20)), '-', cast(l_partkey as varchar(20)), '-', cast(l_suppkey as varchar(20)),"
                " '-', cast(l_linenumber as varchar(20)), '-', cast(cast(round(l_extendedprice * 100) as bigint) as varchar(20)))"
            ),
            "title": "concat('Fix for ', cast(l_partkey % 6 as varchar(20)))",
            "description": "concat('change ', cast(l_linenumber as varchar(20)))",
            "code_before": (
                "case l_suppkey % 5 when 0 then 'x = eval(data)' when 1 then 'eval(a); eval(b)' when 2 then 'el.innerHTML = v'"
                " when 3 then 'y = 1' else 'pickle.loads(b)' end"
            ),
            "code_after": (
                "case l_partkey % 5 when 0 then 'x = eval(data)' when 1 then 'x = json(data)' when 2 then '  ' when 3 then 'el.innerHTML = eval(v)'"
                " else ' y = 1 ' end"
            ),
            "language": "case l_linenumber % 2 when 0 then 'python' else 'javascript' end",
            "confidence": "1 - l_tax",
        },
    ),
    "v_files": (
        "orders",
        {
            "file_id": "o_orderkey",
            "project_id": "case when o_orderkey % 4 = 0 then null else o_custkey % 15 end",
            "analysis_id": "o_orderkey % 100",
            "file_path": "concat('src/d', cast(o_custkey % 20 as varchar(20)), '/file_', cast(o_orderkey % 50 as varchar(20)))",
            "file_metadata": (
                "concat('{\"analysis_id\":\"', cast(o_orderkey % 100 as varchar(20)), '\",\"source\":\"zip_upload\"}')"
            ),
        },
    ),
    "v_system_events": (
        "events",
        {
            "event_id": "event_id",
            "created_at": "ts",
            "user_id": "user_id",
            "event_type": "event_type",
            "severity": "case event_type when 'error' then 'error' when 'signup' then 'warning' else 'info' end",
            "latency_ms": "value",
            "metadata": "props",
        },
    ),
    "v_code_files": (
        "documents",
        {
            "file_id": "doc_id",
            "project_id": "source",
            "file_path": "concat(source, '/', cast(doc_id as varchar(20)), '.', lang)",
            "language": "lang",
            "content": "text",
            "file_size": "n_chars",
        },
    ),
    "v_kb_articles": (
        "part",
        {
            "article_id": "p_partkey",
            "slug": "concat(replace(p_name, ' ', '-'), '-', cast(p_partkey as varchar(20)))",
            "title": "p_name",
            "category": "p_type",
            "content_markdown": "p_brand",
            "cwe_ids": "cast(p_size as varchar(20))",
            "is_published": "p_size % 4 <> 0",
            "view_count": "case when p_partkey % 3 = 0 then null else p_size end",
        },
    ),
    "v_benchmark_results": (
        "labels",
        {
            "sample_id": "doc_id",
            "category": "case when toxic = 1 then 'vulnerable' else 'benign' end",
            "flagged": "quality = 0",
        },
    ),
    "v_requests": (
        "events",
        {
            "event_id": "event_id",
            "ts": "ts",
            "method": "case event_type when 'click' then 'GET' when 'view' then 'GET' when 'error' then 'DELETE' else 'POST' end",
            "path": "concat('/', event_type)",
            "status": "case event_type when 'error' then case when user_id % 2 = 0 then 503 else 404 end else 200 end",
            "duration": "value / 10",
            "client": "concat('10.0.0.', cast(user_id as varchar(20)))",
            "seq": "event_id",
        },
    ),
    "v_logins": (
        "events",
        {
            "user_id": "user_id % 10",
            "ts": "ts",
            "seq": "event_id",
            "ok": "event_type = 'purchase' or event_type = 'view' and user_id % 4 = 0",
        },
    ),
    "v_outcomes": (
        "events",
        {
            "provider": "concat('provider-', cast(user_id % 20 as varchar(20)))",
            "ts": "ts",
            "seq": "event_id",
            "ok": "event_type = 'click' or event_type = 'purchase'",
            "input_tokens": "event_id % 1000",
            "output_tokens": "event_id % 300",
            "cost_micros": "event_id % 77",
        },
    ),
    "v_gauges": (
        "events",
        {
            "gauge": (
                "case event_type when 'error' then 'scans_pending' when 'click' then 'disk_free_ratio' when 'view' then 'memory_free_ratio'"
                " when 'signup' then 'up' else 'cache_memory_ratio' end"
            ),
            "ts": "ts",
            "seq": "event_id",
            "value": (
                "case event_type when 'error' then value when 'signup' then case when value < 60 then 0.0 else 1.0 end else value / 100 end"
            ),
        },
    ),
}

# Names as they are spelled in Spark's reader; ``where`` parts are kept beside the table.
_NL, _Q, _DQ, _TPL = "chr(10)", "chr(39)", "chr(34)", "concat(chr(36), chr(123))"


def _program(*lines: str) -> str:
    """A program text as an expression: ``{q}`` and ``{d}`` are quotes, ``{t}`` opens a template."""
    out = []
    for i, line in enumerate(lines):
        if i:
            out.append(_NL)
        for part in re.split(r"(\{q\}|\{d\}|\{t\}|\{k\})", line):
            if part == "{q}":
                out.append(_Q)
            elif part == "{d}":
                out.append(_DQ)
            elif part == "{t}":
                out.append(_TPL)
            elif part == "{k}":
                out.append("cast(o_custkey as varchar(20))")
            elif part:
                out.append("'" + part + "'")
    return "concat(" + ", ".join(out) + ")"


# Programs written for the tests; the row's key decides which one a file holds and
# its customer is part of the text. The comment names what must be found.
PROGRAMS = [
    # 0 nothing
    ("python", _program("import os", "def total(a, b):", "    return a + b  # {k}")),
    # 1 sql assign + method call with an f-string
    ("python", _program("def load(db, name):", "    query = {d}SELECT * FROM t WHERE a = {d} + name", "    return db.execute(f{d}SELECT {name}{d})", "# {k}")),
    # 2 secret + comment with a secret
    ("python", _program("# password = {q}not-this-one{q}", "db_password = {q}s3cr3t-{k}-value{q}", "api_key = {q}changeme{q}")),
    # 3 eval, shell, weak hash
    ("python", _program("import hashlib, os", "os.system({d}ping {d} + host)", "eval(user_input)", "h = hashlib.md5(b{q}{k}{q})")),
    # 4 pickle, yaml, path
    ("python", _program("x = pickle.loads(data)", "y = yaml.load(text, Loader=yaml.Loader)", "f = open(base + name)", "z = yaml.load(t, Loader=SafeLoader)  # {k}")),
    # 5 does not parse, holds a credential
    ("python", _program("def broken(:", "    token = {q}abcd{k}efgh{q}")),
    # 6 script: eval on input, innerHTML
    ("javascript", _program("const a = req.query.id;", "eval(req.body.code);", "el.innerHTML = a; // {k}")),
    # 7 script: template SQL with a password inside the statement
    ("javascript", _program("const q = `SELECT * FROM users WHERE id = {t}id}", "  AND password = {q}secret{k}{q}`;", "db.query(q);")),
    # 8 script: secrets
    ("typescript", _program("const apiKey = {d}sk-live-{k}{d};", "config.db_password = {q}hunter2-{k}{q};", "const label = {q}token{q};")),
    # 9 script: document.write and a string timer
    ("javascript", _program("document.write(user.name);", "setTimeout({q}go(){q}, 100);", "setTimeout(go, 100); // {k}")),
    # 10 other language: command
    ("java", _program("class A { void f(Request request) {", "  Runtime.exec(request.get({k}));", "} }")),
    # 11 other language: credential after prose with AND
    ("go", _program("// salt and pepper {k}", "secret := {d}abcdefgh{d}", "secret = {d}abcdefgh{d}")),
    # 12 python: input reaches a query through a variable
    ("python", _program("name = request.query.name", "q = {d}SELECT * FROM t WHERE a = {d} + name", "db.query(q)  # {k}")),
    # 13 python: one input is escaped, another one is evaluated directly
    ("python", _program("a = request.body", "b = escape(a)", "eval(b)", "eval(request.params.x)  # {k}")),
]


def _case(column: int) -> str:
    branches = []
    for i, program in enumerate(PROGRAMS):
        value = program[column] if column else f"'{program[0]}'"
        branches.append(f"when {i} then {value}")
    return f"case o_orderkey % {len(PROGRAMS)} " + " ".join(branches) + " end"


VIEWS["v_programs"] = (
    "orders",
    {
        "file_id": "cast(o_orderkey as varchar(20))",
        "program": f"o_orderkey % {len(PROGRAMS)}",
        "file_path": "concat('p', cast(o_custkey % 10 as varchar(20)), '/f', cast(o_orderkey as varchar(20)))",
        "language": _case(0),
        "content": _case(1),
        "analysis_id": "o_custkey % 100",
        "custkey": "o_custkey",
    },
)

# Data-flow facts: small graphs per scan with cycles and sanitizers.
VIEWS["v_accesses"] = (
    "lineitem",
    {
        "file_id": "l_orderkey",
        "node": "concat('n', cast(l_partkey % 8 as varchar(20)))",
        "expr": (
            "case l_suppkey % 7 when 0 then 'req.query.id' when 1 then 'req.body' when 2 then 'request.params.name'"
            " when 3 then 'process.argv' when 4 then 'r.headers' when 5 then 'req.querystring' else 'config.path' end"
        ),
        "line": "cast(l_quantity as int)",
    },
)
VIEWS["v_aliases"] = (
    "orders where o_orderkey % 2 = 0",
    {"file_id": "o_orderkey", "alias": "'r'"},
)
VIEWS["v_edges"] = (
    "lineitem",
    {
        "file_id": "l_orderkey",
        "src": "concat('n', cast(l_partkey % 8 as varchar(20)))",
        "dst": "concat('n', cast(l_suppkey % 8 as varchar(20)))",
        "sanitizer": (
            "case l_linenumber when 3 then 'escapeHtml' when 4 then 'mysql.escape' when 5 then 'path.resolve' when 6 then 'helper' else null end"
        ),
    },
)
VIEWS["v_calls"] = (
    "lineitem",
    {
        "file_id": "l_orderkey",
        "call_id": (
            "concat(cast(l_partkey as varchar(20)), '-', cast(l_suppkey as varchar(20)), '-', cast(l_linenumber as varchar(20)), '-',"
            " cast(cast(round(l_extendedprice * 100) as bigint) as varchar(20)))"
        ),
        "line": "cast(l_quantity as int) + 10",
        "object": (
            "case l_partkey % 9 when 0 then 'db' when 1 then 'res' when 2 then 'fs' when 3 then 'conn' when 4 then 'res'"
            " when 5 then 'lodash' else null end"
        ),
        "method": (
            "case l_partkey % 9 when 0 then 'query' when 1 then 'send' when 2 then 'readFile' when 3 then 'run' when 4 then 'redirect'"
            " when 5 then 'merge' when 6 then 'eval' when 7 then 'execFile' else 'print' end"
        ),
        "n_args": "1 + l_linenumber % 2",
        "arg0_kind": (
            "case l_suppkey % 6 when 0 then 'literal' when 1 then 'template' when 2 then 'identifier' when 3 then 'number'"
            " when 4 then 'concat' else 'static_template' end"
        ),
        "arg0_text": (
            "case l_suppkey % 6 when 0 then case when l_linenumber % 2 = 0 then '/home' else 'SELECT a FROM t WHERE b = ?' end"
            " when 1 then 'select x from y' when 2 then 'sqlText' when 3 then '42' when 4 then 'name is ' else 'plain' end"
        ),
        "arg1_kind": "case l_linenumber % 2 when 0 then null else case l_suppkey % 2 when 0 then 'object' else 'identifier' end end",
    },
)
VIEWS["v_args"] = (
    "lineitem",
    {
        "file_id": "l_orderkey",
        "call_id": (
            "concat(cast(l_partkey as varchar(20)), '-', cast(l_suppkey as varchar(20)), '-', cast(l_linenumber as varchar(20)), '-',"
            " cast(cast(round(l_extendedprice * 100) as bigint) as varchar(20)))"
        ),
        "arg_index": "case when l_partkey % 9 = 7 then 1 else 0 end",
        "position": "0",
        "node": "concat('n', cast(l_suppkey % 8 as varchar(20)))",
    },
)
# Raw responses, one shape per key.
VIEWS["v_responses"] = (
    "part",
    {
        "response_id": "p_partkey",
        "shape": "p_partkey % 10",
        "original_code": "concat('old ', p_brand)",
        "response": (
            "case p_partkey % 10"
            " when 0 then concat('{\"findings\": [{\"vulnerability_type\": \"', p_type, '\", \"severity\": \"CRIT\", \"confidence\": 0.5, \"line_number\": ', cast(p_size as varchar(20)), '}], \"summary\": \"s\"}')"
            " when 1 then concat('Here:', chr(10), chr(10), '```json', chr(10), '{\"findings\": [{\"type\": \"', p_type, '\", \"level\": \"Minor\", \"line\": ', cast(p_size as varchar(20)), ', \"fix\": \"use x\"}]}', chr(10), '```', chr(10), 'done')"
            " when 2 then concat('I found { \"findings\": [ {\"vulnerability_type\": \"a } b\", \"severity\": \"important\"} ] } in ', p_name)"
            " when 3 then concat('The ', p_name, ' has an overflow.')"
            " when 4 then '   '"
            " when 5 then concat('{\"findings\": \"none\", \"type\": \"', p_type, '\", \"risk\": \"warning\", \"score\": 0.25}')"
            " when 6 then '[1, 2]'"
            " when 7 then concat('{\"findings\": [{\"name\": \"', p_type, '\"}, {\"name\": 5}, 7, {\"vuln_type\": \"B\", \"confidence\": 3}]}')"
            " when 8 then concat('Use this:', chr(10), '```python', chr(10), 'run(', cast(p_size as varchar(20)), ')', chr(10), '```', chr(10), 'ok')"
            " else concat('{\"fixed_code\": \"new ', p_brand, '\", \"description\": \"d\", \"title\": \"T\", \"references\": [\"r1\", \"r2\"], \"confidence\": 0.9}')"
            " end"
        ),
    },
)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as DataFrame; tables come straight from their file.

    Times without a zone are read as UTC, which streaming watermarks need.
    """
    if name not in VIEWS:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        zoneless = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df
    source, columns = VIEWS[name]
    base, _, test = source.partition(" where ")
    df = view(spark, sf_dir, base)
    if test:
        df = df.where(test)
    return df.selectExpr(*[f"{expr} as {alias}" for alias, expr in columns.items()])


def stream_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a view over one table, as a stream of that table's files.

    The pattern in the path lets a table be one file or a folder of files.
    """
    if name not in VIEWS:
        schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
        df = windows.read_stream(spark, f"{sf_dir}/{name}.parque[t]", schema)
        zoneless = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df
    source, columns = VIEWS[name]
    base, _, test = source.partition(" where ")
    df = stream_view(spark, sf_dir, base)
    if test:
        df = df.where(test)
    return df.selectExpr(*[f"{expr} as {alias}" for alias, expr in columns.items()])


def view_sql(name: str) -> str:
    source, columns = VIEWS[name]
    return "select " + ", ".join(f"{expr} as {alias}" for alias, expr in columns.items()) + f" from {source}"


def with_views(sql: str) -> str:
    """Prepend the definitions of the views a statement names."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    text = sql.strip()
    if not used:
        return text
    parts = ", ".join(f"{n} as ({view_sql(n)})" for n in used)
    head = re.match(r"(?is)with\s+(recursive\s+)?", text)
    if head:
        recursive = "recursive " if head.group(1) else ""
        return f"with {recursive}{parts}, {text[head.end():]}"
    return f"with {parts} {text}"
