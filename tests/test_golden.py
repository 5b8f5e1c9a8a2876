"""Golden cases of scalar functions, repair, evaluation and sources."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from wardline.functions import checks, jsonx, severity, text, times
from wardline.operators import aggregates, evaluate, repair
from wardline.session import scratch_path
from wardline.sources import benchmarks, corpus, reports


def column(spark, values, expr, ddl="x string"):
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(expr).collect()]


def test_progress(spark):
    rows = [("running", 1, 5), ("running", 0, 0), ("running", 5, 5), ("completed", 1, 2), ("failed", 1, 2)]
    expr = times.scan_progress(F.col("s"), F.col("d"), F.col("n"))
    assert column(spark, rows, expr, "s string, d int, n int") == [0.2, 0.5, 0.95, 1.0, 0.0]


def test_severity_names(spark):
    names = ["crit", " Important", "moderate", "WARNING", "minor", "informational", "other", None]
    assert column(spark, names, severity.norm_severity(F.col("x"))) == [
        "critical", "high", "medium", "medium", "low", "info", "medium", "medium",
    ]
    assert column(spark, ["HIGH", "crit"], severity.stored_severity(F.col("x"))) == ["high", "medium"]


def test_confidence_truncates(spark):
    assert column(spark, [0.85, 0.57, None], severity.confidence_pct(F.col("x")), "x double") == [85, 56, 100]


def test_filenames(spark):
    names = ["../../etc/passwd", "a\x00b.py", "...", "x?.py ", "dir/"]
    assert column(spark, names, text.safe_filename(F.col("x"))) == ["passwd", "ab.py", "unnamed_file", "x.py", "unnamed_file"]


def test_uptime_and_ago(spark):
    assert column(spark, [59, 3700, 90061], times.uptime_text(F.col("x")), "x long") == ["0m", "1h 1m", "1d 1h"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"a": 1}', '{"a": 1}'),
        ('x\n```json\n{"a": 1}\n```', '{"a": 1}'),
        ('```\n[1]\n```', "[1]"),
        ('see {"a": "}"} end', '{"a": "}"}'),
        ('bad {x} then [1, 2] end', "[1, 2]"),
        ("none", None),
        ("  ", None),
        ('{"a": 1', None),
    ],
)
def test_json_from_text(spark, raw, want):
    assert column(spark, [raw], jsonx.json_from_text(F.col("x"))) == [want]


def findings_of(spark, raw):
    df = spark.createDataFrame([(raw,)], "response string")
    return [(r.outcome, r.vulnerability_type, r.severity, r.confidence) for r in repair.normalize_raw_findings(df).collect()]


def test_raw_findings(spark):
    assert findings_of(spark, '{"findings": [], "summary": "ok"}') == [("direct", None, None, None)]
    assert findings_of(spark, '{"findings": [{"vulnerability_type": "XSS", "severity": "HIGH"}]}') == [("direct", "XSS", "high", 0.7)]
    assert findings_of(spark, '{"findings": [{"type": "XSS", "risk": "minor"}]}') == [("repaired", "XSS", "low", 0.7)]
    assert findings_of(spark, "just text") == [("fallback", "Unknown", "medium", 0.3)]
    assert findings_of(spark, "") == [("rejected", None, None, None)]


FIX_ROWS = [
    ("x = eval(a)", "x = int(a)", []),
    ("a", "a ", ["Fixed code is identical to original code"]),
    ("a", " ", ["Fixed code is empty"]),
    ("eval(a)", "eval(b)", ["Fix may re-introduce vulnerability: eval() usage"]),
    ("eval(a) eval(b)", "eval(c)", []),
]


def test_fix_warnings(spark):
    expr = checks.fix_warnings(F.col("b"), F.col("a"))
    assert column(spark, [r[:2] for r in FIX_ROWS], expr, "b string, a string") == [r[2] for r in FIX_ROWS]


RESULT_DDL = (
    "sample_name string, category string, expected_findings array<struct<cwe_id:string,vulnerability_type:string,severity:string>>, "
    "actual_findings array<struct<cwe_id:string,vulnerability_type:string,severity:string>>"
)


def test_metrics(spark):
    hit = [("CWE-89", "SQL Injection", "high")]
    rows = [("a", "vulnerable", hit, [("cwe-89", "sql injection", "high")]), ("b", "benign", [], [])]
    perfect = evaluate.confusion_metrics(spark.createDataFrame(rows, RESULT_DDL)).first()
    assert (perfect.precision, perfect.recall, perfect.f1, perfect.fpr, perfect.fnr) == (1, 1, 1, 0, 0)
    flagged = spark.createDataFrame([("b", "benign", [], hit)], RESULT_DDL)
    row = evaluate.confusion_metrics(flagged).first()
    assert (row.fp, row.precision, row.fpr) == (1, 0.0, 1.0)
    wrong = spark.createDataFrame([("a", "vulnerable", hit, [("CWE-79", "XSS", "high")])], RESULT_DDL)
    assert evaluate.confusion_metrics(wrong).first().fp == 1
    assert evaluate.sample_verdicts(wrong).first().verdict == "detected"
    assert evaluate.detection_by_cwe(spark.createDataFrame(rows, RESULT_DDL)).first().detection_rate == 1.0


def test_run_delta(spark):
    rows = [("old", 0.80, 0.70, 0.75, 0.10, 0.30, 0.9), ("new", 0.85, 0.72, 0.78, 0.08, 0.28, 0.91)]
    metrics = spark.createDataFrame(rows, "run_id string, precision double, recall double, f1 double, fpr double, fnr double, accuracy double")
    delta = {r.metric: r.delta for r in evaluate.compare_runs(metrics, "old", "new").collect()}
    assert (delta["precision"], delta["recall"], delta["fpr"]) == (0.05, 0.02, -0.02)


def test_archive_members_and_audit(spark):
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as box:
        box.writestr("src/a.py", "print(1)\n")
        box.writestr("../up.py", "x")
        box.writestr("a/b/c/d/e.py", "x")
        box.writestr("bomb.py", "0" * 100000)
        box.writestr("notes.txt", "x")
    df = spark.createDataFrame([("ok", bytearray(blob.getvalue())), ("bad", bytearray(b"nope"))], "archive string, content binary")
    files = {r.file_path: r.content for r in corpus.expand_archives(df).collect()}
    assert files["src/a.py"] == "print(1)\n" and set(files) == {"src/a.py", "a/b/c/d/e.py", "bomb.py"}
    members = corpus.archive_members(df)
    assert members.where("archive = 'bad' and error is not null").count() == 1
    row = aggregates.archive_audit(members.where("archive = 'ok'")).first()
    assert (row.entries, row.unsafe_names, row.deep_names, row.bomb_members, row.is_valid) == (5, 1, 1, 1, False)


def test_archives_from_files(spark, tmp_path):
    for name, member in (("one.zip", "a.py"), ("deep/two.zip", "b.go")):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        with zipfile.ZipFile(path, "w") as box:
            box.writestr(member, "x = 1\n")
    files = corpus.expand_archives(corpus.load_archives(spark, str(tmp_path)))
    rows = {r.file_path: (r.language, r.line_count) for r in corpus.derive_code_files(files).collect()}
    assert rows == {"a.py": ("py", 2), "b.go": ("go", 2)}


def test_usage_totals(spark):
    rows = [("a", "2024-01-01", 10, 5, 0.5), ("a", "2024-01-02", 20, 7, 0.25), ("b", "2024-01-02", 1, 1, 0.0)]
    calls = spark.createDataFrame(rows, "provider string, day string, input_tokens long, output_tokens long, cost double").withColumn(
        "ts", F.col("day").cast("timestamp")
    )
    by_provider = {r.provider: (r.total_calls, r.total_input_tokens, r.total_cost) for r in aggregates.usage_by_provider(calls).collect()}
    assert by_provider == {"a": (2, 30, 0.75), "b": (1, 1, 0.0)}
    assert {str(r.day): r.calls for r in aggregates.usage_by_day(calls).collect()} == {"2024-01-01": 1, "2024-01-02": 2}


def test_corpus_filters_folders_and_decodes(spark, tmp_path):
    for name in ("a.py", "node_modules/b.js", ".git/c.ts", "src/d.tsx", "e.txt", ".hidden/f.py", "pkg/__init__.py", "_g.js", "H.JS"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x = '\xff'\n")
    rows = {r.file_path: r.content for r in corpus.load_corpus(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.py", "src/d.tsx", ".hidden/f.py", "pkg/__init__.py", "_g.js", "H.JS"}
    assert rows["a.py"] == "x = '�'\n"


def test_manifest_array(spark, tmp_path):
    path = tmp_path / "metadata.json"
    path.write_text('[{"file": "a.py", "category": "benign", "expected_findings": []}, {"file": "b.py", "category": "vulnerable"}]')
    manifest = benchmarks.load_manifest(spark, str(path))
    samples = spark.createDataFrame([("a.py", "x = 1")], "file string, content string")
    rows = {r.file: (r.parser_success, r.error) for r in benchmarks.load_benchmark(manifest, samples).collect()}
    assert rows == {"a.py": (True, None), "b.py": (False, "Could not load sample code")}


def test_scanner_lines(spark):
    lines = ['{"vulnerability_type": "XSS", "line_number": 3}', ' {"vulnerability_type": "broken"', '{"other": 1}', "text"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [(r.vulnerability_type, r.line_number) for r in reports.parse_scanner_lines(df, "value").collect()] == [("XSS", 3)]


def test_work_folder_comes_from_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(folder)
