"""Nothing is cut, retyped or lost, and one bad row never ends a job."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from wardline.functions import jsonx, text
from wardline.operators import maintenance, prefix, pyfacts, repair
from wardline.plans import catalog
from wardline.sources import corpus, tables

SF_DIR = "/root/testdata/sf0.01"


def test_merge_keeps_types(spark):
    docs = ['{"a":1,"b":{"c":[1,2.5,null]},"d":true,"e":null,"k":"old"}', "not json", "[1]", None, "{}"]
    rows = spark.createDataFrame(list(enumerate(docs)), "id int, doc string")
    merged = jsonx.merge_json(F.col("doc"), {"k": F.struct(F.lit(7).alias("n")), "by": F.lit("me")})
    got = [r.m for r in rows.select("id", merged.alias("m")).orderBy("id").collect()]
    new = {"k": {"n": 7}, "by": "me"}
    assert json.loads(got[0]) == json.loads(docs[0]) | new
    assert got[1:3] == docs[1:3]
    assert json.loads(got[3]) == new and json.loads(got[4]) == new


def test_leftover_keeps_types(spark):
    rows = spark.sql("select 1 as n, array(1, 2) as xs, named_struct('y', 2.5d) as s, true as b, cast(null as string) as z, 'v' as severity")
    doc = rows.select(jsonx.leftover_metadata({c: F.col(c) for c in rows.columns}, ["severity"]).alias("m")).first().m
    assert json.loads(doc) == {"n": 1, "xs": [1, 2], "s": {"y": 2.5}, "b": True}


def test_fix_is_an_object(spark):
    findings = spark.createDataFrame([(1, "new", '{"stage":1,"tags":["a"]}'), (2, "new", None)], "finding_id long, status string, finding_metadata string")
    applied = spark.sql("select 1L as finding_id, named_struct('code', 'x', 'lines', array(1, 2)) as applied_fix, 'u1' as fixed_by, 't' as fixed_at")
    first, second = maintenance.mark_fixed(findings, applied).orderBy("finding_id").collect()
    assert json.loads(first.finding_metadata) == {
        "stage": 1, "tags": ["a"], "applied_fix": {"code": "x", "lines": [1, 2]}, "fixed_by": "u1", "fixed_at": "t",
    }
    assert (first.status, second.status, second.finding_metadata) == ("fixed", "new", None)


def test_findings_keep_every_field(spark):
    rows = spark.sql(
        "select 1 as analysis_id, 'f' as file_id, 'T' as title, 'because' as explanation, 'p' as explanation_provider, 9 as project_id,"
        " array('esc') as sanitizers, named_struct('a', 1) as path, cast(null as string) as cwe_id, x as sink_note from values ('n1'), ('n2') t(x)"
    )
    out = tables.findings_rows(rows).collect()
    assert len({r.id for r in out}) == 2
    assert {r.explanation for r in out} == {"because"} and {r.project_id for r in out} == {"9"}
    kept = json.loads(sorted(r.finding_metadata for r in out)[0])
    assert kept == {"sanitizers": ["esc"], "path": {"a": 1}, "sink_note": "n1"}


def test_responses_stay_whole(spark):
    long = "no json here " * 200
    rows = spark.createDataFrame([(1, long), (2, '{"findings": [], "findings": [{"type": "XSS"}]}')], "response_id int, response string")
    by = {r.response_id: r for r in repair.normalize_raw_findings(rows).collect()}
    assert by[1].explanation == long and by[1].outcome == "fallback"
    assert by[2].outcome != "rejected"


def test_context_of_any_length(spark):
    rows = spark.createDataFrame([("SELECT " + "x" * 400,)], "p string")
    short, whole = rows.select(text.in_sql_context(F.col("p")), text.in_sql_context(F.col("p"), chars=None)).first()
    assert (short, whole) == (False, True)


def test_null_key_has_quantiles(spark):
    rows = spark.createDataFrame([(k, float(v)) for k in ("a", None) for v in range(5)], "k string, v double")
    found = {r.k: r.p50 for r in prefix.exact_quantiles(rows, ["k"], "v", [0.5]).collect()}
    assert found == {"a": 2.0, None: 2.0}
    run = prefix.running(rows, ["k"], ["v"], F.floor(F.col("v") / 2), s=prefix.Running("sum", F.col("v")))
    assert sorted(r.s for r in run.filter("k is null").collect()) == [0.0, 1.0, 3.0, 6.0, 10.0]


def test_bad_source_is_a_row(spark):
    files = spark.createDataFrame(
        [(1, "a.py", 's = "\\ud800abc"\nprint(s)\n'), (2, "b.py", "def ("), (3, "c.py", "print(1)")], "file_id int, file_path string, content string"
    )
    kinds = {(str(r.file_id), r.kind) for r in pyfacts.python_facts(files).collect()}
    assert {("1", "parsed"), ("1", "assign"), ("2", "error"), ("3", "parsed")} <= kinds


def test_bad_members_are_rows(spark):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w", zipfile.ZIP_DEFLATED) as z:
        for name in ("a.py", "b.py", "c.py"):
            z.writestr(name, f"print('{name}')\n" * 50)
    blob = bytearray(box.getvalue())
    with zipfile.ZipFile(io.BytesIO(bytes(blob))) as z:
        at = z.getinfo("b.py").header_offset + 34
    blob[at : at + 12] = b"\xff" * 12
    archives = spark.createDataFrame([("ok", bytes(box.getvalue())), ("hurt", bytes(blob)), ("none", b"no zip")], "archive string, content binary")
    rows = corpus.archive_members(archives).collect()
    assert {(r.archive, r.name) for r in rows if r.error} == {("hurt", "b.py"), ("none", None)}
    kept = {(r.archive, r.file_path) for r in corpus.expand_archives(archives).collect()}
    assert kept == {("ok", n) for n in ("a.py", "b.py", "c.py")} | {("hurt", "a.py"), ("hurt", "c.py")}


def test_upsert_keeps_every_enrollment(spark):
    given = spark.read.parquet(f"{SF_DIR}/customer.parquet").select(F.col("c_nationkey").alias("class_id"), F.col("c_custkey").alias("student_id"))
    out = catalog.QUERIES["m01_enrollment_upsert"](spark, SF_DIR)
    assert given.join(out, ["class_id", "student_id"], "left_anti").isEmpty()
    # both an insert and an update must occur
    changes = spark.read.parquet(f"{SF_DIR}/events.parquet").select((F.col("user_id") % 5).alias("class_id"), F.col("user_id").alias("student_id"))
    assert not out.join(given, ["class_id", "student_id"], "left_anti").isEmpty()
    assert not given.join(changes, ["class_id", "student_id"], "left_semi").isEmpty()


def test_sources_of_every_line(spark):
    """A file whose only request input is on its third line or later has a source."""
    kind = F.col("l_suppkey") % 7
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").withColumn("input", kind <= 3)
    late = lines.groupBy("l_orderkey").agg(F.min(F.when(F.col("input"), F.col("l_linenumber"))).alias("first")).filter("first > 2")
    out = catalog.QUERIES["d06a_match_sources"](spark, SF_DIR)
    assert late.count() > 0
    assert late.join(out, late.l_orderkey == out.file_id, "left_anti").isEmpty()
