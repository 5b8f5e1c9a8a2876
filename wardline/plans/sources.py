"""Sources and sinks: each query writes what it reads from the given tables."""

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import detect, evaluate
from ..session import scratch_path
from ..sources import benchmarks, corpus, reports, tables
from .registry import Tables, query


@query("s01_load_table", "select c_custkey, c_name from customer")
def _(t: Tables):
    return tables.load_table(t.spark, f"{t.sf_dir}/customer.parquet", "c_custkey bigint, c_name string")


@query(
    "s02_load_corpus",
    "select lang, cast(sum(length(text) - length(replace(text, chr(10), '')) + 1) as bigint) as newlines, cast(sum(length(text) + 1) as bigint) as chars from documents group by 1",
)
def _(t: Tables):
    root = scratch_path(t.spark, "tree")
    t.documents.select("lang", "text").write.partitionBy("lang").text(root)
    files = corpus.load_corpus(t.spark, root, [".txt"])
    return files.groupBy(F.regexp_extract("file_path", "lang=([^/]+)/", 1).alias("lang")).agg(
        F.sum(F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))).alias("newlines"),
        F.sum(F.length("content")).cast("bigint").alias("chars"),
    )


@query(
    "s03_derive_code_files",
    "select concat(source, '/', cast(doc_id as varchar), '.', lang) as file_path, concat(cast(doc_id as varchar), '.', lang) as file_name, concat('.', lang) as file_extension,"
    " lang as language, cast(strlen(text) as integer) as file_size, cast(length(text) - length(replace(text, chr(10), '')) + 1 as integer) as line_count from documents",
)
def _(t: Tables):
    out = corpus.derive_code_files(t.v_code_files.select("file_path", "content"))
    return out.select("file_path", "file_name", "file_extension", "language", "file_size", "line_count")


@F.pandas_udf(T.BinaryType())
def _zip_of(names: pd.Series, texts: pd.Series) -> pd.Series:
    def pack(name: str, text: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as box:
            box.writestr(f"src/{name}.py", text)
            box.writestr("../evil.py", "x")
            box.writestr("/root.js", "x")
            box.writestr("notes.txt", text)
            box.writestr(f"a/{name}.js", text[::-1])
        return out.getvalue()

    return pd.Series([pack(n, x) for n, x in zip(names, texts)])


def _archives(t: Tables):
    return t.documents.select(
        F.col("doc_id").cast("string").alias("archive"),
        _zip_of(F.col("doc_id").cast("string"), F.col("text")).alias("content"),
    )


@query(
    "s04_expand_archives",
    "select cast(doc_id as varchar) as archive, concat('src/', cast(doc_id as varchar), '.py') as file_path, md5(text) as content_md5 from documents union all"
    " select cast(doc_id as varchar), concat('a/', cast(doc_id as varchar), '.js'), md5(array_to_string(list_reverse(regexp_extract_all(text, '(?s).')), '')) from documents",
)
def _(t: Tables):
    files = corpus.expand_archives(_archives(t))
    return files.select("archive", "file_path", F.md5("content").alias("content_md5"))


@query(
    "s04_archive_members",
    "select cast(doc_id as varchar) as archive, n as name, case when n in ('../evil.py', '/root.js') then 1 else strlen(text) end as size, d as depth from documents,"
    " (values ('../evil.py', 1), ('/root.js', 1), ('notes.txt', 0), ('p', 1), ('j', 1)) m(n, d) where n not in ('p', 'j') union all"
    " select cast(doc_id as varchar), concat('src/', cast(doc_id as varchar), '.py'), strlen(text), 1 from documents union all"
    " select cast(doc_id as varchar), concat('a/', cast(doc_id as varchar), '.js'), strlen(text), 1 from documents",
)
def _(t: Tables):
    return corpus.archive_members(_archives(t)).select("archive", "name", "size", "depth")


MANIFEST_SQL = (
    "select concat(cast(doc_id * 2 as varchar), '.py') as file, case when toxic = 1 then 'vulnerable' else 'benign' end as category, doc_id * 2 as sample from labels"
)


def _manifest(t: Tables):
    """Manifest entries; every second sample exists in ``documents``."""
    expected = F.array(F.struct(F.lit("CWE-798").alias("cwe_id"), F.lit("Hardcoded Credentials").alias("vulnerability_type"), F.lit("high").alias("severity")))
    vulnerable = F.col("toxic") == 1
    rows = t.labels.select(
        F.concat((F.col("doc_id") * 2).cast("string"), F.lit(".py")).alias("file"),
        F.lit("python").alias("language"),
        F.when(vulnerable, "vulnerable").otherwise("benign").alias("category"),
        F.when(vulnerable, expected).otherwise(F.array()).alias("expected_findings"),
    )
    path = scratch_path(t.spark, "manifest")
    rows.write.json(path)
    return benchmarks.load_manifest(t.spark, path, multi_line=False)


def _samples(t: Tables):
    return t.documents.select(F.concat(F.col("doc_id").cast("string"), F.lit(".py")).alias("file"), F.col("text").alias("content"))


@query(
    "s05_load_benchmark",
    f"with m as ({MANIFEST_SQL}) select m.file, m.category, coalesce(d.text <> '', false) as parser_success,"
    " case when coalesce(d.text <> '', false) then null else 'Could not load sample code' end as error from m left join documents d on m.sample = d.doc_id",
)
def _(t: Tables):
    return benchmarks.load_benchmark(_manifest(t), _samples(t)).select("file", "category", "parser_success", "error")


BENCH_RULE = "regexp_matches(line, '(password|api_key|secret)\\s*=\\s*[\"''][^\"'']+[\"'']') and not regexp_matches(line, '^\\s*(#|//)')"


@query(
    "s05_benchmark_run",
    f"with m as ({MANIFEST_SQL}), l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents),"
    " h as (select distinct doc_id from l where " + BENCH_RULE + "),"
    " r as (select m.file, m.category, h.doc_id is not null as hit from m left join h on m.sample = h.doc_id)"
    " select file as sample_name, category, case when category = 'vulnerable' then case when hit then 'TP' else 'FN' end else case when hit then 'FP' else 'TN' end end as outcome from r",
)
def _(t: Tables):
    samples = benchmarks.load_benchmark(_manifest(t), _samples(t))
    files = samples.where("parser_success").select(F.col("file").alias("file_id"), F.col("file").alias("file_path"), "language", "content")
    found = detect.benchmark_scan(files)
    return evaluate.sample_outcomes(benchmarks.benchmark_results(samples, found)).select("sample_name", "category", "outcome")


@query(
    "s06_export_report",
    "with s as (select analysis_id, count(*) as n, count(*) filter (where severity = 'critical') as c from v_findings group by 1)"
    " select cast(a.analysis_id as varchar) as analysis_id, 0 as part, cast(coalesce(s.n, 0) as varchar) as key, cast(coalesce(s.c, 0) as varchar) as detail from v_analyses a left join s using (analysis_id)"
    " union all select cast(analysis_id as varchar), 1, finding_id, severity from v_findings"
    " union all select cast(f.analysis_id as varchar), 2, x.fix_id, x.code_after from v_fixes x join v_findings f on x.finding_id = f.finding_id",
)
def _(t: Tables):
    findings = t.v_findings.withColumn("vulnerability_type", F.col("cwe_id"))
    path = scratch_path(t.spark, "reports")
    reports.export_reports(reports.report_records(t.v_analyses, findings, t.v_fixes), path)
    field = lambda *names: F.coalesce(*[F.get_json_object("record", f"$.{n}") for n in names])
    part = F.col("part")
    return reports.read_reports(t.spark, path).select(
        "analysis_id",
        "part",
        F.when(part == 0, field("summary.total_findings")).when(part == 1, field("finding_id")).otherwise(field("fix_id")).alias("key"),
        F.when(part == 0, field("summary.critical")).when(part == 1, field("severity")).otherwise(field("code_after")).alias("detail"),
    )


@query(
    "s07_append_findings",
    "select cast(analysis_id as varchar) as analysis_id, severity, cwe_id as title, cast(trunc(confidence * 100) as integer) as confidence, line_start as line_end, 'new' as status,"
    " cast(stage as varchar) as stage, count(*) as n from v_findings group by all",
)
def _(t: Tables):
    path = scratch_path(t.spark, "findings")
    rows = t.v_findings.withColumns({"title": F.lit(None).cast("string"), "vulnerability_type": F.col("cwe_id"), "file_id": F.col("finding_id")}).drop("explanation")
    tables.append_findings(rows.where("stage = 1"), path)
    tables.append_findings(rows.where("stage = 2"), path)
    stored = tables.load_table(t.spark, path, "findings")
    return stored.groupBy(
        "analysis_id", "severity", "title", "confidence", "line_end", "status",
        F.get_json_object("finding_metadata", "$.stage").alias("stage"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "s08_seed_if_missing",
    "select slug, title from v_kb_articles where not is_published",
)
def _(t: Tables):
    path = scratch_path(t.spark, "kb")
    t.v_kb_articles.where("is_published").select("slug", "title").write.parquet(path)
    existing = t.spark.read.parquet(path)
    seeds = t.v_kb_articles.select("slug", "title")
    return tables.seed_if_missing(existing, seeds.unionByName(seeds))


@query(
    "s09_read_scanner_lines",
    "select finding_id as file_path, cwe_id as vulnerability_type, severity, line_start as line_number, confidence from v_findings where line_start % 4 in (0, 3)",
)
def _(t: Tables):
    path = scratch_path(t.spark, "lines")
    line = F.to_json(
        F.struct(
            F.col("cwe_id").alias("vulnerability_type"), "severity", F.col("finding_id").alias("file_path"),
            F.col("line_start").alias("line_number"), "confidence",
        )
    )
    kind = F.col("line_start") % 4
    text = F.when(kind == 0, F.concat(F.lit("  "), line, F.lit(" "))).when(kind == 1, F.left(line, F.length(line) - 1)).when(
        kind == 2, F.concat(F.lit("log: "), line)
    ).otherwise(line)
    t.v_findings.select(text).write.text(path)
    return reports.read_scanner_lines(t.spark, path).select(
        "file_path", "vulnerability_type", "severity", "line_number", "confidence"
    )


@query(
    "s10_append_events",
    "select cast(event_id as varchar) as event_id, event_type, severity, cast(user_id as varchar) as user_id, strftime(created_at, '%Y-%m-%d') as day from v_system_events",
)
def _(t: Tables):
    path = scratch_path(t.spark, "events")
    events = t.v_system_events.withColumn("message", F.concat("event_type", F.lit(" happened")))
    tables.append_events(events.where("event_type = 'error'"), path)
    tables.append_events(events.where("event_type <> 'error'"), path)
    return t.spark.read.parquet(path).select(
        "event_id", "event_type", "severity", "user_id", F.col("day").cast("string").alias("day")
    )


@query(
    "s11_save_runs",
    "with c as (select sample_id % 2 as r, count(*) filter (where category = 'vulnerable' and flagged) as tp, count(*) filter (where category = 'vulnerable') as v from v_benchmark_results group by 1)"
    " select case r when 0 then 'base' else 'next' end as run_id, r = 0 as is_baseline, tp, round_even(case when v > 0 then tp / v else 0 end, 4) as recall from c",
)
def _(t: Tables):
    path = scratch_path(t.spark, "runs")
    for run_id, rest in (("base", 0), ("next", 1)):
        metrics = evaluate.confusion_from_flags(t.v_benchmark_results.where(F.col("sample_id") % 2 == rest))
        benchmarks.save_run(metrics.select("tp", "recall"), path, run_id, is_baseline=rest == 0)
    return benchmarks.load_runs(t.spark, path, "tp bigint, recall double").select("run_id", "is_baseline", "tp", "recall")
