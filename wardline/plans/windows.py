"""Window-like operators, ordering, pages and set operations."""

from pyspark.sql import functions as F

from ..functions import severity as sev
from ..functions import text
from ..operators import aggregates, filters, ranking, sets
from .registry import Tables, query

def _numbered(t: Tables):
    """Findings with a total order and a data flow on some of them."""
    return t.v_findings.withColumns(
        {
            "seq": F.conv(F.left(F.md5("finding_id"), F.lit(12)), 16, 10).cast("bigint"),
            "data_flow": F.when(F.col("line_start") % 2 == 0, F.concat(F.lit("flow "), "finding_id")),
        }
    )


@query(
    "w01_dedup_findings",
    "with n as (select *, cast(concat('0x', substr(md5(finding_id), 1, 12)) as bigint) as seq,"
    " case when line_start % 2 = 0 then concat('flow ', finding_id) else null end as data_flow from v_findings),"
    " g as (select *, row_number() over w as r, first_value(data_flow ignore nulls) over (partition by cwe_id, file_path, line_start order by seq"
    " rows between unbounded preceding and unbounded following) as first_flow from n"
    " window w as (partition by cwe_id, file_path, line_start order by confidence desc, seq))"
    " select finding_id, cwe_id, file_path, line_start, coalesce(data_flow, first_flow) as data_flow from g where r = 1",
)
def _(t: Tables):
    return ranking.dedup_findings(_numbered(t)).select("finding_id", "cwe_id", "file_path", "line_start", "data_flow")


@query(
    "w01_dedup_per_scan",
    "with g as (select *, row_number() over (partition by analysis_id, cwe_id, file_path, line_start order by confidence desc,"
    " cast(concat('0x', substr(md5(finding_id), 1, 12)) as bigint)) as r from v_findings)"
    " select finding_id, analysis_id from g where r = 1",
)
def _(t: Tables):
    return ranking.dedup_findings(_numbered(t), ("analysis_id",), ["finding_id", "analysis_id"])


@query(
    "w02_first_match",
    "select analysis_id, cwe_id, min(line_start) as line_start from v_findings group by 1, 2",
)
def _(t: Tables):
    rows = t.v_findings.select("analysis_id", "cwe_id", "line_start", "severity")
    return ranking.first_per(rows, ["analysis_id", "cwe_id"], "line_start").select("analysis_id", "cwe_id", "line_start")


@query(
    "w03_one_per_line",
    "select distinct analysis_id as file_id, cwe_id as rule, line_start from v_findings",
)
def _(t: Tables):
    rows = t.v_findings.select(F.col("analysis_id").alias("file_id"), F.col("cwe_id").alias("rule"), "line_start", "finding_id")
    return ranking.one_per_line(rows).select("file_id", "rule", "line_start")


@query(
    "w04_first_secret_class",
    "select l_orderkey, l_linenumber, l_partkey, arg_min(kind, rnk) as kind from (select l_orderkey, l_linenumber, l_partkey,"
    " unnest(['token', 'api_key', 'password']) as kind, unnest([3, 2, 1]) as rnk, l_partkey % 3 as k from lineitem) where rnk > k group by 1, 2, 3",
)
def _(t: Tables):
    names = F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(k).alias("kind")) for r, k in ((3, "token"), (2, "api_key"), (1, "password"))])
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.inline(names)).where("rank > l_partkey % 3")
    return ranking.first_per(rows, ["l_orderkey", "l_linenumber", "l_partkey"], "rank").select(
        "l_orderkey", "l_linenumber", "l_partkey", "kind"
    )


@query(
    "w05_severity_chart",
    "with c as (select analysis_id % 50 as scan_group, severity, count(*) as n from v_findings group by 1, 2),"
    " l as (select unnest(['critical', 'high', 'medium', 'low', 'info']) as severity, unnest([0, 1, 2, 3, 4]) as rank),"
    " a as (select g.scan_group, l.severity, l.rank, coalesce(c.n, 0) as n from (select distinct scan_group from c) g cross join l"
    " left join c on c.scan_group = g.scan_group and c.severity = l.severity)"
    " select scan_group, severity, n as count, round(n / greatest(max(n) over p, 1), 9) as height, round(n / sum(n) over p, 9) as share,"
    " round(coalesce(sum(n) over (partition by scan_group order by rank rows between unbounded preceding and 1 preceding), 0) / sum(n) over p, 9) as \"offset\""
    " from a window p as (partition by scan_group)",
)
def _(t: Tables):
    rows = t.v_findings.withColumn("scan_group", F.col("analysis_id") % 50)
    chart = aggregates.severity_chart(rows, "scan_group")
    return chart.select("scan_group", "severity", "count", *[F.round(c, 9).alias(c) for c in ("height", "share", "offset")])


LOCKOUT_SQL = """
with recursive o as (select *, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, seq) as rn from v_logins),
r(user_id, rn, seq, fails, until) as (
  select user_id, rn, seq, case when ok then 0 else 1 end::bigint, 0::bigint from o where rn = 1
  union all
  select o.user_id, o.rn, o.seq,
    case when o.ok and o.us >= r.until then 0 else r.fails + 1 end,
    case when o.ok and o.us >= r.until then 0 when r.fails + 1 >= 5 then o.us + 900000000 else r.until end
  from r join o on o.user_id = r.user_id and o.rn = r.rn + 1)
select user_id, seq, fails as failed_attempts, fails >= 5 as locked, case when fails >= 5 then until end as locked_until_us from r
"""


@query("w06_lockouts", LOCKOUT_SQL)
def _(t: Tables):
    return ranking.lockouts(t.v_logins).select(
        "user_id", "seq", "failed_attempts", "locked", F.unix_micros("locked_until").alias("locked_until_us")
    )


@query(
    "w07_current_state",
    "select user_id, arg_max(event_type, (created_at, event_id)) as event_type, arg_max(event_id, (created_at, event_id)) as event_id"
    " from v_system_events group by 1",
)
def _(t: Tables):
    rows = t.v_system_events.select("user_id", "event_type", "event_id", "created_at")
    return ranking.latest_per(rows, ["user_id"], ["created_at", "event_id"]).select("user_id", "event_type", "event_id")


@query(
    "l01_page",
    "select analysis_id, status, (select count(*) from v_analyses) as total, 4 as page, 25 as page_size,"
    " cast(ceil((select count(*) from v_analyses) / 25.0) as bigint) as total_pages"
    " from v_analyses order by created_at desc, analysis_id limit 25 offset 75",
)
def _(t: Tables):
    rows = ranking.page(t.v_analyses, [F.col("created_at").desc(), F.col("analysis_id")], skip=75, limit=25)
    return rows.select("analysis_id", "status", "total", "page", "page_size", "total_pages")


@query(
    "l02_top_types",
    "select analysis_id, cwe_id, n from (select analysis_id, cwe_id, count(*) as n, row_number() over (partition by analysis_id order by count(*) desc, cwe_id) as r"
    " from v_findings group by 1, 2) where r <= 5",
)
def _(t: Tables):
    counts = aggregates.counts_by(t.v_findings, "analysis_id", "cwe_id")
    return ranking.top_per_group(counts, ["analysis_id"], [F.col("n").desc(), F.col("cwe_id")], 5)


@query(
    "l03_latest_scans",
    "select user_id, analysis_id from v_analyses qualify row_number() over (partition by user_id order by created_at desc, analysis_id) <= 500",
)
def _(t: Tables):
    order = [F.col("created_at").desc(), F.col("analysis_id")]
    return ranking.top_per_group(t.v_analyses, ["user_id"], order, 500).select("user_id", "analysis_id")


RANK = "case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 when 'info' then 4 else -1 end"


@query(
    "l04_findings_order",
    f"select finding_id, severity, {RANK} as severity_rank from v_findings",
)
def _(t: Tables):
    rows = ranking.order_findings(t.v_findings, "severity", ascending=True)
    return rows.select("finding_id", "severity", sev.severity_rank(F.col("severity")).alias("severity_rank"))


@query(
    "l04_findings_order_default",
    f"select finding_id, severity from v_findings",
)
def _(t: Tables):
    return ranking.order_findings(t.v_findings).select("finding_id", "severity")


@query(
    "l05_activity_feed",
    "select analysis_id, case status when 'completed' then 'scan_completed' when 'running' then 'scan_started' when 'failed' then 'vulnerability_found'"
    " else 'scan_started' end as type, coalesce(nullif(scan_name, ''), nullif(branch, ''), 'Unknown') as project"
    " from v_analyses order by created_at desc, analysis_id limit 5",
)
def _(t: Tables):
    newest = t.v_analyses.orderBy(F.col("created_at").desc(), "analysis_id").limit(5)
    return newest.select(
        "analysis_id",
        ranking.activity_type(F.col("status")).alias("type"),
        text.display_name(F.col("scan_name"), F.col("branch")).alias("project"),
    )


@query(
    "l06_kb_search_newest",
    "select article_id, title from v_kb_articles where is_published and contains(lower(title), 'e') order by article_id desc limit 20",
)
def _(t: Tables):
    hits = filters.search(filters.active(t.v_kb_articles, "is_published"), "E", ["title"])
    return hits.orderBy(F.col("article_id").desc()).limit(20).select("article_id", "title")


@query(
    "l07_findings_page",
    "select finding_id, severity from v_findings order by finding_id limit 50 offset 100",
)
def _(t: Tables):
    return ranking.page(t.v_findings, [F.col("finding_id")], skip=100, limit=50).select("finding_id", "severity")


@query(
    "u01_union_detectors",
    "select finding_id, severity, data_flow from (select finding_id, severity, null::varchar as data_flow from v_findings where analyzer_type = 'regex'"
    " union all select finding_id, severity, 'flow' from v_findings where analyzer_type = 'sast-js')",
)
def _(t: Tables):
    plain = t.v_findings.where("analyzer_type = 'regex'").select("finding_id", "severity")
    flows = t.v_findings.where("analyzer_type = 'sast-js'").select("finding_id", "severity", F.lit("flow").alias("data_flow"))
    return sets.union_findings([plain, flows]).select("finding_id", "severity", "data_flow")


@query(
    "u02_shared_types",
    "select analysis_id, lower(cwe_id) as cwe_id from v_findings where stage = 1 intersect"
    " select analysis_id, lower(cwe_id) from v_findings where stage = 2",
)
def _(t: Tables):
    first, second = t.v_findings.where("stage = 1"), t.v_findings.where("stage = 2")
    return sets.shared_types(first, second, ["analysis_id"], "cwe_id")


@query(
    "u03_missing_keys",
    "select slug from v_kb_articles where slug not in (select slug from v_kb_articles where is_published)",
)
def _(t: Tables):
    return sets.missing_keys(t.v_kb_articles, t.v_kb_articles.where("is_published"), "slug").select("slug")


@query("u04_distinct", "select distinct category, is_published from v_kb_articles")
def _(t: Tables):
    return sets.distinct_values(t.v_kb_articles, "category", "is_published")
