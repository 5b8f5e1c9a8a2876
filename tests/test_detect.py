"""Detectors on small programs written from the rule descriptions."""

import pytest
from pyspark.sql import functions as F

from wardline.operators import detect, pyfacts
from wardline.operators.rules import BENCHMARK_RULES, KNOWLEDGE_RULES, REGEX_RULES, SCRIPT_RULES


def files(spark, *contents, language="python"):
    rows = [(str(i), f"f{i}", language, c) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "file_id string, file_path string, language string, content string")


def rules_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.file_id, []).append(r.rule)
    return {k: sorted(v) for k, v in out.items()}


def test_regex_rules(spark):
    df = files(
        spark,
        "q = `select a from t where b = ${x}`",
        "x = 1\npassword = 'hunter22'",
        "rows WHERE x\npassword = 'hunter22'",
        "password = '${value}'",
        "el.innerHTML = user.name",
        "medieval(request)\nx = eval(request.x)",
        "run.exec(input)",
        "plain text",
        "paſſword = 'abcdef'",
    )
    assert rules_of(detect.regex_scan(df)) == {
        "0": ["sql"], "1": ["credentials"], "4": ["xss"], "5": ["eval"], "6": ["command"], "8": ["credentials"],
    }
    assert rules_of(detect.regex_scan(df, strict=True)).keys() == {"0", "1", "4", "5", "6", "8"}


def test_first_match_position_counts_characters(spark):
    text = "\U0001f600 é\n" * 3 + "medieval(\n eval(user)"
    (row,) = detect.regex_scan(files(spark, text)).collect()
    assert (row.line_start, row.line_end) == (5, 6)
    assert row.code_snippet == "medieval(\n eval(user)"


def test_literal_prefilters_never_lose_a_match(spark):
    """A rule's literals must occur in whatever its pattern matches."""
    samples = {
        "sql": ["SELECT a ${b}", "Insert x ${y}", "select 'a' + b + 'c'", "select x .format (", "select %(a)s", "drop 'a' + b.c + 'd'"],
        "credentials": ["ToKeN : 'abcd'", "passwd=\"abcde\"", "DB_PASS = 'abcd'"],
        "xss": [".innerHTML = x.query", "document.write( body user"],
        "eval": ["eval( input", "exec( user"],
        "command": ["execSync (user", "spawn(body", "execFile(query"],
    }
    for rules in (REGEX_RULES, KNOWLEDGE_RULES):
        for rule in rules:
            df = spark.createDataFrame([(s,) for s in samples[rule.rule]], "content string")
            may = detect._may_match(rule, F.col("content"), F.lower("content"))
            lost = df.where(F.col("content").rlike(rule.pattern) & ~may)
            assert lost.count() == 0, rule.rule
    assert all(r.needs for r in [*REGEX_RULES, *KNOWLEDGE_RULES, *BENCHMARK_RULES, *SCRIPT_RULES])


def test_benchmark_rules_skip_comment_lines(spark):
    df = files(
        spark,
        "# password = 'x'\n  // eval(a)",
        "# password = 'x'\npassword = 'y'",
        "x = 1 # eval(a)",
        "pickle.load(f); yaml.load(f, Loader=yaml.Loader)\nreturn f'{a} {request.args}'",
        "os.path.join(a,\n b + c)",
        "cur.execute('SELECT a' + b)\ncur.execute(f'SELECT {a}')",
    )
    assert rules_of(detect.benchmark_scan(df)) == {
        "1": ["password"], "2": ["eval"], "3": ["pickle", "xss", "yaml"], "4": ["path_join"], "5": ["sql_concat", "sql_fstring"],
    }


PYTHON_CASES = [
    ("cur.execute(f'select {x}')", ["sql_call"]),
    ("execute('a' + b)", ["sql_function"]),
    ("cur.executemany('a' + b, 'c' % d)", ["sql_call", "sql_call"]),
    ("q = 'delete from t where a = ' + str(x) + ' and b'", ["sql_assign"]),
    ("q = 'hello ' + name", []),
    ("q = 'SELECT a FROM t'", []),
    ("os.system(f'ls {x}')", ["shell"]),
    ("subprocess.call(cmd, shell=True)", ["shell_true"]),
    ("subprocess.run(['ls', x])", []),
    ("db_password = 'abcdefg'", ["secret"]),
    ("password = token = 'abcdefg'", ["secret", "secret"]),
    ("password = 'abc'", []),
    ("password = 'changeme'", []),
    ("eval(x)", ["eval"]),
    ("obj.eval(x)", []),
    ("pickle.loads(x)", ["pickle"]),
    ("json.loads(x)", []),
    ("yaml.load(x)", ["yaml"]),
    ("yaml.load(x, Loader=SafeLoader)", []),
    ("hashlib.sha1(x)", ["hash"]),
    ("open(base + name)", ["path"]),
    ("open('a' + 'b')", []),
]


def test_python_checks(spark):
    df = files(spark, *[code for code, _ in PYTHON_CASES])
    got = rules_of(pyfacts.python_findings(pyfacts.python_facts(df)))
    assert got == {str(i): sorted(want) for i, (_, want) in enumerate(PYTHON_CASES) if want}


def test_unparsed_python_falls_back(spark):
    df = files(spark, "def f(:\n secret = 'abcdef'", "x = 1")
    assert rules_of(detect.route_by_language(df)) == {"0": ["credentials"]}


def test_script_rules(spark):
    df = files(
        spark,
        "eval(x); eval(y)\nobj.eval(z)",
        "a.innerHTML == b\na.innerHTML = b",
        "let userToken = 'abcdefg'\nconst t = 'abcdefg'",
        "window.setTimeout('x')\nsetInterval(\"x()\", 3)",
        "const apiKey: string = \"sk-live-123456\"",
        "let a = 1, password = \"hunter22\"",
        "let a = 1; label = \"password\"",
        language="javascript",
    )
    found = detect.script_scan(df)
    assert rules_of(found) == {
        "0": ["eval"], "1": ["innerHTML"], "2": ["secret"], "3": ["timer"], "4": ["secret"], "5": ["secret"],
    }
    titles = {r.file_id: (r.title, r.description) for r in found.where("rule = 'secret'").collect()}
    assert {k: t for k, (t, _) in titles.items()} == {
        "2": "Hardcoded secret: userToken", "4": "Hardcoded secret: apiKey", "5": "Hardcoded secret: password",
    }
    assert titles["5"][1].startswith("Hardcoded secret 'password' embedded")


@pytest.mark.parametrize("second", ["knowledge", "regex"])
def test_corpus_keeps_one_row_per_defect(spark, second):
    df = files(spark, "password = 'abcdefgh'\nname = 'x'")
    rows = detect.scan_corpus(df, second=second).collect()
    assert [(r.cwe_id, r.line_start, r.confidence) for r in rows] == [("CWE-798", 1, 0.85)]


def test_facts_come_in_the_order_of_a_whole_walk():
    import ast

    from wardline.operators import pyfacts

    code = "import os as o\nclass A(B(1)):\n    x: int = f(g(h), *k(), q=m(n))\n    def r(self, a=s()):\n        t = u = [v(w) for w in z() if -w > y(3)]\n"
    code += "        with p() as q, r():\n            e = lambda b=c(): d(b) or {i(): j()}\n        match f():\n            case C(a=1):\n                l[0] = k(f'{m()}')\n"
    tree = ast.parse(code)
    seen = list(pyfacts._inner_nodes(tree))
    wanted = (ast.Call, ast.Assign)
    assert [n for n in seen if isinstance(n, wanted)] == [n for n in ast.walk(tree) if isinstance(n, wanted)]
    assert len(seen) < 0.6 * sum(1 for _ in ast.walk(tree))
