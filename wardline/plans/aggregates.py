"""Report aggregates and evaluation."""

from pyspark.sql import functions as F

from ..functions import severity as sev
from ..operators import aggregates, evaluate, joins
from ..operators.prefix import exact_quantiles
from .registry import Tables, query

LEVELS = ", ".join(f"count(*) filter (where severity = '{s}') as {s}" for s in sev.LEVELS)
ACTIVE = "select class_id, count(*) as n from v_enrollments where status = 'active' group by 1"


@query("a01_count_where", "select count(*) as n from v_findings where severity = 'high' and status = 'new'")
def _(t: Tables):
    return aggregates.count_where(t.v_findings, severity="high", status="new", no_such_column=1)


@query("a02_exists", "select exists(select 1 from v_users where role = 'admin') as found")
def _(t: Tables):
    return aggregates.exists_where(t.v_users, role="admin")


@query(
    "a03_student_counts",
    "select c.class_id, c.name, (select count(*) from v_enrollments e where e.class_id = c.class_id and e.status = 'active')"
    " as student_count from v_classes c",
)
def _(t: Tables):
    return joins.with_student_count(t.v_classes, t.v_enrollments).select("class_id", "name", "student_count")


@query("a04_severity_counts", f"select analysis_id, {LEVELS} from v_findings group by 1")
def _(t: Tables):
    return aggregates.severity_counts(t.v_findings, "analysis_id")


@query(
    "a04_unknown_is_medium",
    "select count(*) filter (where l = 'critical') as critical, count(*) filter (where l = 'high') as high,"
    " count(*) filter (where l not in ('critical', 'high', 'low', 'info')) as medium,"
    " count(*) filter (where l = 'low') as low, count(*) filter (where l = 'info') as info"
    " from (select lower(coalesce(case when p_size % 5 = 0 then null when p_size % 7 = 0 then 'HIGH' when p_size % 3 = 0 then 'low'"
    " else p_type end, 'medium')) as l from part)",
)
def _(t: Tables):
    size = F.col("p_size")
    level = F.when(size % 5 == 0, None).when(size % 7 == 0, "HIGH").when(size % 3 == 0, "low").otherwise(F.col("p_type"))
    return aggregates.severity_counts(t.part.select(level.alias("severity")))


@query("a05_counts_by_type", "select cwe_id, count(*) as n from v_findings group by 1")
def _(t: Tables):
    return aggregates.counts_by(t.v_findings, "cwe_id")


CLASS_METRICS = """
with students as (select class_id, student_id from v_enrollments where status = 'active'),
scans as (select s.class_id, a.analysis_id from v_analyses a join students s on a.user_id = s.student_id),
hits as (select s.class_id, f.severity, f.cwe_id from v_findings f join scans s on f.analysis_id = s.analysis_id),
lv as (select class_id, count(*) as total_findings, {levels} from hits group by 1),
ty as (select class_id, cwe_id, count(*) as n, row_number() over (partition by class_id order by count(*) desc, cwe_id) as r from hits group by 1, 2),
top as (select class_id, string_agg(concat(cwe_id, ':', cast(n as varchar)), ',' order by r) as top_types from ty where r <= 5 group by 1),
st as (select class_id, count(*) as n from students group by 1),
sc as (select class_id, count(*) as n from scans group by 1)
select c.class_id, c.name, coalesce(st.n, 0) as total_students, coalesce(sc.n, 0) as total_scans,
       coalesce(lv.total_findings, 0) as total_findings, coalesce(critical, 0) as critical, coalesce(high, 0) as high,
       coalesce(medium, 0) as medium, coalesce(low, 0) as low, coalesce(info, 0) as info,
       round_even(coalesce(lv.total_findings, 0) / greatest(coalesce(st.n, 0), 1), 1) as avg_findings_per_student, top_types
from v_classes c left join st using (class_id) left join sc using (class_id) left join lv using (class_id) left join top using (class_id)
""".format(levels=LEVELS)


@query("a06_class_metrics", CLASS_METRICS)
def _(t: Tables):
    out = aggregates.class_metrics(t.v_classes, t.v_enrollments, t.v_analyses, t.v_findings, kind="cwe_id")
    return out.select(
        "class_id", "name", "total_students", "total_scans", "total_findings", *sev.LEVELS,
        "avg_findings_per_student", "top_types",
    )


@query(
    "a06_class_severity",
    "with students as (select class_id, student_id from v_enrollments where status = 'active'),"
    " scans as (select s.class_id, a.analysis_id from v_analyses a join students s on a.user_id = s.student_id)"
    f" select c.class_id, c.name, {LEVELS} from v_findings f join scans s on f.analysis_id = s.analysis_id"
    " join v_classes c on c.class_id = s.class_id group by 1, 2",
)
def class_severity(t: Tables):
    """Severity counts per class over the newest scans of its active students."""
    scans = aggregates.class_scans(t.v_analyses, t.v_enrollments)
    hits = t.v_findings.select("analysis_id", "severity").join(scans.select("class_id", "analysis_id"), "analysis_id")
    counts = aggregates.severity_counts(hits, "class_id")
    return t.v_classes.select("class_id", "name").join(counts, "class_id")


@query("a07_findings_per_scan", "select analysis_id, count(*) as n from v_findings group by 1")
def _(t: Tables):
    return aggregates.counts_by(t.v_findings, "analysis_id")


@query(
    "a08_scan_summary",
    "select analysis_id, count(*) as total_findings, count(*) filter (where stage = 1 and analyzer_type = 'sast-js') as sast_findings,"
    " count(*) filter (where stage = 1 and analyzer_type <> 'sast-js') as ast_findings, count(*) filter (where stage = 2) as ai_findings,"
    " case when count(*) filter (where stage = 1 and analyzer_type = 'sast-js') > 0 then 'sast+taint' else 'direct_ast' end as scan_method"
    " from v_findings group by 1",
)
def _(t: Tables):
    return aggregates.scan_summary(t.v_findings)


@query(
    "a09_dashboard",
    "with recent as (select user_id, analysis_id, file_count from v_analyses),"
    f" c as (select r.user_id, {LEVELS} from recent r join v_findings f on r.analysis_id = f.analysis_id group by 1),"
    " f as (select user_id, cast(sum(file_count) as bigint) as total_code_files from recent group by 1)"
    " select f.user_id, total_code_files, coalesce(critical, 0) + coalesce(high, 0) + coalesce(medium, 0) + coalesce(low, 0) as total_vulnerabilities,"
    " cast(greatest(0, floor(100 - 10 * coalesce(critical, 0) - 5 * coalesce(high, 0) - 2 * coalesce(medium, 0) - 0.5 * coalesce(low, 0) + 0.5)) as bigint) as security_score"
    " from f left join c on f.user_id = c.user_id",
)
def _(t: Tables):
    return aggregates.dashboard(t.v_analyses, t.v_findings).select(
        "user_id", "total_code_files", "total_vulnerabilities", "security_score"
    )


@query(
    "a10_severity_shares",
    f"with c as (select analysis_id, {LEVELS} from v_findings group by 1), x as (select *, critical + high + medium + low as total from c)"
    " select analysis_id, "
    + ", ".join(
        f"cast(case when total > 0 then floor({s} / total * 100 + 0.5) else 0 end as bigint) as {s}_pct"
        for s in sev.LEVELS[:4]
    )
    + " from x",
)
def _(t: Tables):
    return aggregates.severity_shares(t.v_findings, "analysis_id").select(
        "analysis_id", *[f"{s}_pct" for s in sev.LEVELS[:4]]
    )


RATES = """
select {keys} tp + fp + tn + fn as total_samples, tp, fp, tn, fn,
  round_even(p, 4) as precision, round_even(r, 4) as recall,
  round_even(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 4) as f1,
  round_even(case when fp + tn > 0 then fp / (fp + tn) else 0 end, 4) as fpr,
  round_even(case when tp + fn > 0 then fn / (tp + fn) else 0 end, 4) as fnr,
  round_even(case when tp + fp + tn + fn > 0 then (tp + tn) / (tp + fp + tn + fn) else 0 end, 4) as accuracy
from (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0 end as r from cells)
"""
RESULTS = (
    "results as (select doc_id, case when toxic = 1 then 'vulnerable' else 'benign' end as category,"
    " case when doc_id % 6 = 0 then null else case doc_id % 3 when 0 then 'SQL Injection' when 1 then 'XSS' else 'Path' end end as expected,"
    " case when quality = 1 and doc_id % 5 <> 0 then null else case doc_id % 4 when 0 then 'sql injection' when 1 then 'xss' else 'path' end end as actual from labels)"
)


def _results(t: Tables):
    """One expected and one actual finding per sample, or none."""
    expected = F.when(F.col("doc_id") % 6 != 0, F.element_at(F.array(F.lit("SQL Injection"), F.lit("XSS"), F.lit("Path")), (F.col("doc_id") % 3 + 1).cast("int")))
    flagged = ~((F.col("quality") == 1) & (F.col("doc_id") % 5 != 0))
    actual = F.when(flagged, F.element_at(F.array(F.lit("sql injection"), F.lit("xss"), F.lit("path"), F.lit("path")), (F.col("doc_id") % 4 + 1).cast("int")))
    cwe = lambda c: F.concat(F.lit("cwe-"), F.lower(F.substring(c, 1, 2)))
    def findings(c):
        one = F.struct(cwe(c).alias("cwe_id"), c.alias("vulnerability_type"), F.lit("high").alias("severity"))
        return F.when(c.isNotNull(), F.array(one)).otherwise(F.array().cast("array<struct<cwe_id:string,vulnerability_type:string,severity:string>>"))
    return t.labels.select(
        F.col("doc_id").cast("string").alias("sample_name"),
        F.when(F.col("toxic") == 1, "vulnerable").otherwise("benign").alias("category"),
        findings(expected).alias("expected_findings"),
        findings(actual).alias("actual_findings"),
        F.col("doc_id"),
    )


@query(
    "a11_confusion_from_flags",
    "with cells as (select count(*) filter (where category = 'vulnerable' and flagged) as tp, count(*) filter (where category = 'benign' and flagged) as fp,"
    " count(*) filter (where category = 'benign' and not flagged) as tn, count(*) filter (where category = 'vulnerable' and not flagged) as fn from v_benchmark_results)"
    + RATES.format(keys=""),
)
def _(t: Tables):
    out = evaluate.confusion_from_flags(t.v_benchmark_results)
    return out.select("total_samples", "tp", "fp", "tn", "fn", *evaluate.METRICS)


@query(
    "a11_confusion_metrics",
    "with " + RESULTS + ", marked as (select case when category = 'vulnerable' then case when actual is null then 'FN' when expected is null or"
    " lower(expected) = lower(actual) then 'TP' else 'FP' end else case when actual is null then 'TN' else 'FP' end end as o from results),"
    " cells as (select count(*) filter (where o = 'TP') as tp, count(*) filter (where o = 'FP') as fp, count(*) filter (where o = 'TN') as tn,"
    " count(*) filter (where o = 'FN') as fn from marked)" + RATES.format(keys=""),
)
def _(t: Tables):
    out = evaluate.confusion_metrics(_results(t))
    return out.select("total_samples", "tp", "fp", "tn", "fn", *evaluate.METRICS)


@query(
    "a12_detection_by_cwe",
    "with " + RESULTS + " select concat('cwe-', lower(substr(expected, 1, 2))) as cwe_id, count(*) as expected_count,"
    " count(*) filter (where upper(substr(expected, 1, 2)) = upper(substr(actual, 1, 2))) as detected_count,"
    " round_even(count(*) filter (where upper(substr(expected, 1, 2)) = upper(substr(actual, 1, 2))) / count(*), 4) as detection_rate"
    " from results where category = 'vulnerable' and expected is not null group by 1",
)
def _(t: Tables):
    return evaluate.detection_by_cwe(_results(t))


@query(
    "a13_sample_verdicts",
    "with " + RESULTS + " select cast(doc_id as varchar) as sample_name, category, case when expected is null then 0 else 1 end as expected_findings,"
    " case when actual is null then 0 else 1 end as actual_findings, case when category = 'vulnerable' then case when actual is null then 'missed' else 'detected' end"
    " else case when actual is null then 'clean' else 'false_positive' end end as verdict from results",
)
def _(t: Tables):
    return evaluate.sample_verdicts(_results(t))


@query(
    "a14_run_delta",
    "with cells as (select sample_id % 2 as run_id, count(*) filter (where category = 'vulnerable' and flagged) as tp,"
    " count(*) filter (where category = 'benign' and flagged) as fp, count(*) filter (where category = 'benign' and not flagged) as tn,"
    " count(*) filter (where category = 'vulnerable' and not flagged) as fn from v_benchmark_results group by 1),"
    " rates as (" + RATES.format(keys="run_id,") + "), long as (unpivot rates on precision, recall, f1, fpr, fnr, accuracy into name metric value value)"
    " select b.metric, b.value as baseline, i.value as improved, round_even(i.value - b.value, 4) as delta"
    " from long b join long i on b.metric = i.metric where b.run_id = 0 and i.run_id = 1",
)
def _(t: Tables):
    runs = t.v_benchmark_results.withColumn("run_id", (F.col("sample_id") % 2).cast("string"))
    metrics = evaluate.confusion_from_flags(runs, "run_id")
    return evaluate.compare_runs(metrics, "0", "1").select("metric", "baseline", "improved", "delta")


@query(
    "a15_report_metrics",
    "with s as (select category, case when flagged then 1 + sample_id % 3 else 0 end as n from v_benchmark_results),"
    " c as (select count(*) filter (where category = 'vulnerable') as v, count(*) filter (where category = 'vulnerable' and n > 0) as d,"
    " coalesce(sum(n) filter (where category = 'vulnerable'), 0)::bigint as tf, coalesce(sum(n) filter (where category = 'benign'), 0)::bigint as ff,"
    " count(*) filter (where category = 'benign' and n = 0) as cl from s),"
    " r as (select case when tf + ff > 0 then tf / (tf + ff) else 0 end as p, case when v > 0 then d / v else 0 end as rc,"
    " case when ff + cl > 0 then ff / (ff + cl) else 0 end as fpr, case when v > 0 then (v - d) / v else 0 end as fnr from c)"
    " select round(p, 9) as precision, round(rc, 9) as recall, round(case when p + rc > 0 then 2 * p * rc / (p + rc) else 0 end, 9) as f1,"
    " round(fpr, 9) as fpr, round(fnr, 9) as fnr, case when fpr < 0.05 then 'Excellent' when fpr < 0.15 then 'Good' when fpr < 0.30 then 'Acceptable'"
    " else 'Needs improvement' end as band from r",
)
def _(t: Tables):
    samples = t.v_benchmark_results.withColumn(
        "n_findings", F.when(F.col("flagged"), F.col("sample_id") % 3 + 1).otherwise(0)
    )
    out = evaluate.report_metrics(samples)
    return out.select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "fpr", "fnr")], "band")


def _calls(t: Tables):
    return t.v_outcomes.withColumn("cost", F.col("cost_micros"))


@query(
    "a16_usage_by_provider",
    "select provider, count(*) as total_calls, sum(input_tokens)::bigint as total_input_tokens, sum(output_tokens)::bigint as total_output_tokens,"
    " sum(cost_micros)::bigint as total_cost from v_outcomes group by 1",
)
def _(t: Tables):
    return aggregates.usage_by_provider(_calls(t))


@query(
    "a16_usage_by_day",
    "select strftime(ts, '%Y-%m-%d') as day, count(*) as calls, sum(input_tokens)::bigint as input_tokens,"
    " sum(output_tokens)::bigint as output_tokens, sum(cost_micros)::bigint as cost from v_outcomes group by 1",
)
def _(t: Tables):
    return aggregates.usage_by_day(_calls(t)).withColumn("day", F.col("day").cast("string"))


@query(
    "a16_usage_with_availability",
    "select provider, count(*) as total_calls, arg_max(ok, (ts, seq)) as available from v_outcomes group by 1",
)
def _(t: Tables):
    states = t.v_outcomes.select("provider", "ts", "seq", (~F.col("ok")).alias("circuit_open"))
    return aggregates.usage_with_availability(_calls(t), states).select("provider", "total_calls", "available")


@query(
    "a17_severity_groups",
    "select analysis_id, severity as \"group\", finding_id from v_findings",
)
def _(t: Tables):
    findings = t.v_findings.withColumn("seq", F.col("finding_id"))
    return aggregates.severity_groups(findings, "analysis_id").select("analysis_id", "group", "finding_id")


@query("a18_published_categories", "select distinct category from v_kb_articles where is_published")
def _(t: Tables):
    return t.v_kb_articles.where("is_published").select("category").distinct()


@query(
    "a19_view_counters",
    "select a.article_id, coalesce(a.view_count, 0) + coalesce(v.n, 0) as view_count from v_kb_articles a left join"
    " (select user_id as article_id, count(*) as n from v_system_events where event_type = 'view' group by 1) v using (article_id)",
)
def _(t: Tables):
    views = t.v_system_events.where("event_type = 'view'").select(F.col("user_id").alias("article_id"))
    return aggregates.with_views(t.v_kb_articles, views, "article_id").select("article_id", "view_count")


@query(
    "a20_platform_totals",
    "select (select count(*) from v_users) as total_users, (select count(*) from v_analyses) as total_scans",
)
def _(t: Tables):
    return aggregates.platform_totals(t.v_users, t.v_analyses)


@query(
    "a21_service_status",
    "select method, case when bool_or(status >= 500) then 'degraded' else 'healthy' end as overall from v_requests group by 1",
)
def _(t: Tables):
    services = t.v_requests.select("method", F.when(F.col("status") >= 500, "unhealthy").otherwise("healthy").alias("status"))
    return aggregates.overall_status(services, "method")


@query(
    "a22_instructor_totals",
    f"with s as ({ACTIVE}) select c.instructor_id, count(*) as total_classes, sum(coalesce(s.n, 0))::bigint as total_students"
    " from v_classes c left join s on c.class_id = s.class_id group by 1",
)
def _(t: Tables):
    return aggregates.instructor_totals(t.v_classes, t.v_enrollments)


@query(
    "a23_latency_quantiles",
    "select path, count(*) as n, round(quantile_cont(duration, 0.5), 6) as p50, round(quantile_cont(duration, 0.95), 6) as p95,"
    " round(quantile_cont(duration, 0.99), 6) as p99 from v_requests group by 1",
)
def _(t: Tables):
    out = exact_quantiles(t.v_requests, ["path"], "duration", [0.5, 0.95, 0.99])
    return out.select("path", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


@query(
    "a24_error_ratios",
    "select strftime(ts, '%Y-%m-%d') as day, count(*) as total, count(*) filter (where status between 400 and 499) as n_4xx,"
    " count(*) filter (where status between 500 and 599) as n_5xx,"
    " round(count(*) filter (where status between 500 and 599) / count(*), 9) as error_ratio from v_requests group by 1",
)
def _(t: Tables):
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return aggregates.error_ratios(t.v_requests, day).withColumn("error_ratio", F.round("error_ratio", 9))


@query("a25_scans_by_state", "select status, count(*) as n from v_analyses group by 1")
def _(t: Tables):
    return aggregates.counts_by(t.v_analyses, "status")


@query(
    "a26_hit_rate",
    "select provider, round(100.0 * count(*) filter (where ok) / count(*), 6) as hit_rate_pct from v_outcomes group by 1",
)
def _(t: Tables):
    lookups = t.v_outcomes.withColumnRenamed("ok", "hit")
    return aggregates.hit_rate(lookups, "provider").withColumn("hit_rate_pct", F.round("hit_rate_pct", 6))


@query(
    "a27_archive_audit",
    "with m as (select l_orderkey as archive, case l_partkey % 40 when 0 then 'u' when 1 then 'u' when 2 then 'd' else 'k' end as kind,"
    " case l_partkey % 40 when 1 then 1 when 2 then 4 else 1 end as depth,"
    " trunc(l_extendedprice)::bigint as size, trunc(l_extendedprice)::bigint / (1 + l_suppkey % 12) as packed from lineitem)"
    " select archive, count(*) as entries, coalesce(sum(size) filter (where kind = 'k'), 0)::bigint as total_uncompressed,"
    " round(max(size / packed) filter (where kind = 'k' and size > 0 and packed > 0), 6) as max_ratio, max(depth)::integer as max_depth,"
    " count(*) filter (where kind = 'u') as unsafe_names, count(*) filter (where kind = 'd') as deep_names,"
    " count(*) filter (where kind = 'k' and size > 0 and packed > 0 and size / packed > 10.0) as bomb_members from m group by 1",
)
def _(t: Tables):
    size = F.col("l_extendedprice").cast("bigint")
    head = (
        F.when(F.col("l_partkey") % 40 == 0, "../")
        .when(F.col("l_partkey") % 40 == 1, "/")
        .when(F.col("l_partkey") % 40 == 2, "a/b/c/d/")
        .otherwise("src/")
    )
    members = t.lineitem.select(
        F.col("l_orderkey").alias("archive"),
        F.concat(head, F.lit("f"), F.col("l_linenumber").cast("string"), F.lit(".py")).alias("name"),
        size.alias("size"),
        (size / (F.col("l_suppkey") % 12 + 1)).alias("compressed"),
    )
    out = aggregates.archive_audit(members)
    return out.select(
        "archive", "entries", "total_uncompressed", F.round("max_ratio", 6).alias("max_ratio"), "max_depth",
        "unsafe_names", "deep_names", "bomb_members",
    )
