"""Table changes."""

from pyspark.sql import functions as F

from ..functions import jsonx
from ..operators import maintenance
from .registry import Tables, query

CHANGES = (
    "changes as (select user_id % 5 as class_id, user_id as student_id, case when event_type in ('click', 'view') then 'join' else 'leave' end as action, ts, event_id as seq"
    " from events where event_type in ('click', 'view', 'error'))"
)
BASE = "base as (select class_id, student_id, status from v_enrollments)"


def _base(t: Tables):
    return t.v_enrollments.select("class_id", "student_id", "status")


def _changes(t: Tables):
    return t.events.where("event_type in ('click', 'view', 'error')").select(
        (F.col("user_id") % 5).alias("class_id"),
        F.col("user_id").alias("student_id"),
        F.when(F.col("event_type") == "error", "leave").otherwise("join").alias("action"),
        "ts",
        F.col("event_id").alias("seq"),
    )


@query(
    "m01_enrollment_upsert",
    f"with {BASE}, {CHANGES}, l as (select class_id, student_id, arg_max(action, (ts, seq)) as a, bool_or(action = 'join') as j from changes group by 1, 2)"
    " select class_id, student_id, case l.a when 'join' then 'active' when 'leave' then 'dropped' else b.status end as status"
    " from base b full join l using (class_id, student_id) where b.status is not null or l.j",
)
def _(t: Tables):
    return maintenance.apply_enrollments(_base(t), _changes(t)).select("class_id", "student_id", "status")


REJECTS = f"""
with recursive {BASE}, {CHANGES},
o as (select c.*, b.status as base, row_number() over (partition by c.class_id, c.student_id order by ts, seq) as rn
      from changes c left join base b using (class_id, student_id)),
r(class_id, student_id, rn, seq, action, before, state) as (
  select class_id, student_id, rn, seq, action, base, case when action = 'join' then 'active' when base is null then null else 'dropped' end from o where rn = 1
  union all
  select o.class_id, o.student_id, o.rn, o.seq, o.action, r.state, case when o.action = 'join' then 'active' when r.state is null then null else 'dropped' end
  from r join o on o.class_id = r.class_id and o.student_id = r.student_id and o.rn = r.rn + 1)
select seq, case when action = 'join' then 'already enrolled' else 'not enrolled' end as reason from r
where (action = 'join' and before = 'active') or (action = 'leave' and coalesce(before, '') <> 'active')
"""


@query("m01_enrollment_rejects", REJECTS)
def _(t: Tables):
    return maintenance.enrollment_rejects(_base(t), _changes(t)).select("seq", "reason")


@query(
    "m02_soft_delete",
    "select user_id, is_active and user_id not in (select user_id from events where event_type = 'error') as is_active from v_users",
)
def _(t: Tables):
    gone = t.events.where("event_type = 'error'").select("user_id")
    return maintenance.soft_delete(t.v_users, gone, "user_id").select("user_id", "is_active")


@query(
    "m03_partial_update",
    "select article_id, case when article_id % 3 = 0 then concat('new ', slug) else title end as title,"
    " case when article_id % 5 = 0 then null else category end as category, is_published from v_kb_articles",
)
def _(t: Tables):
    key = F.col("article_id")
    title = F.when(key % 3 == 0, F.create_map(F.lit("title"), F.concat(F.lit("new "), "slug")))
    category = F.when(key % 5 == 0, F.create_map(F.lit("category"), F.lit(None).cast("string")))
    banned = F.create_map(F.lit("is_published"), F.lit("false"))
    none = F.create_map().cast("map<string,string>")
    fields = F.map_concat(F.coalesce(title, none), F.coalesce(category, none), banned)
    changes = t.v_kb_articles.select("article_id", fields.alias("fields"))
    out = maintenance.partial_update(t.v_kb_articles, changes, "article_id", ["title", "category", "content_markdown"])
    return out.select("article_id", "title", "category", "is_published")


DOOMED = "(select analysis_id from v_analyses where status = 'pending')"


@query(
    "m04_hard_delete",
    f"select 'findings' as part, count(*) as n from v_findings where analysis_id not in {DOOMED} union all"
    f" select 'analyses', count(*) from v_analyses where analysis_id not in {DOOMED}",
)
def _(t: Tables):
    doomed = t.v_analyses.where("status = 'pending'")
    parents, children = maintenance.hard_delete(t.v_analyses, [t.v_findings], doomed, "analysis_id")
    count = F.count(F.lit(1)).alias("n")
    return children.agg(count).select(F.lit("findings").alias("part"), "n").unionByName(
        parents.agg(count).select(F.lit("analyses").alias("part"), "n")
    )


@query(
    "m05_repoint_files",
    "select file_id, cast(case when file_id % 100 < 30 then 1000000 + file_id % 100 else file_id % 100 end as varchar) as analysis_id, 'zip_upload' as source from v_files",
)
def _(t: Tables):
    rescans = t.v_files.select("analysis_id").where("analysis_id < 30").distinct().withColumn(
        "new_analysis_id", F.col("analysis_id") + 1000000
    )
    out = maintenance.repoint_files(t.v_files, rescans)
    return out.select(
        "file_id",
        F.get_json_object("file_metadata", "$.analysis_id").alias("analysis_id"),
        F.get_json_object("file_metadata", "$.source").alias("source"),
    )


@query(
    "m06_mark_fixed",
    "select f.finding_id, case when x.finding_id is not null then 'fixed' else f.status end as status, x.code_after as applied_fix,"
    " case when x.finding_id is not null then 'u1' end as fixed_by, cast(f.stage as varchar) as stage"
    " from v_findings f left join v_fixes x on f.finding_id = x.finding_id",
)
def _(t: Tables):
    findings = t.v_findings.withColumn("finding_metadata", jsonx.leftover_metadata({"stage": F.col("stage")}, []))
    applied = t.v_fixes.select(
        "finding_id", F.col("code_after").alias("applied_fix"), F.lit("u1").alias("fixed_by"), F.lit("2024-01-31T00:00:00").alias("fixed_at")
    )
    out = maintenance.mark_fixed(findings, applied)
    field = lambda name: F.get_json_object("finding_metadata", f"$.{name}").alias(name)
    return out.select("finding_id", "status", field("applied_fix"), field("fixed_by"), field("stage"))


STATUS = "case event_type when 'click' then 'running' when 'view' then 'completed' when 'error' then 'failed' else 'pending' end"


def _status_events(events):
    kind = F.col("event_type")
    status = (
        F.when(kind == "click", "running").when(kind == "view", "completed").when(kind == "error", "failed").otherwise("pending")
    )
    return events.select(
        F.col("user_id").alias("scan_id"),
        status.alias("status"),
        "ts",
        F.col("event_id").alias("seq"),
        F.when(kind == "view", F.col("props")).alias("summary"),
        F.when(kind == "error", F.lit("boom")).alias("error"),
    )


LIFECYCLE = (
    f"select user_id as scan_id, arg_max({STATUS}, (ts, event_id)) as status, epoch_us(max(ts) filter (where event_type = 'click')) as started_us,"
    " epoch_us(max(ts) filter (where event_type in ('view', 'error'))) as completed_us, arg_max(props, (ts, event_id)) filter (where event_type = 'view') as summary,"
    " max(case when event_type = 'error' then 'boom' end) as error from events group by 1"
)


@query(
    "m07_scan_status_update",
    f"with e as ({LIFECYCLE}) select a.analysis_id, coalesce(e.status, a.status) as status, e.started_us, e.completed_us, e.summary"
    " from v_analyses a left join e on a.analysis_id = e.scan_id",
)
def _(t: Tables):
    empty = {"started_at": "timestamp", "completed_at": "timestamp", "summary": "string", "error": "string"}
    analyses = t.v_analyses.withColumns({c: F.lit(None).cast(k) for c, k in empty.items()})
    out = maintenance.update_scans(analyses, _status_events(t.events))
    return out.select(
        "analysis_id", "status", F.unix_micros("started_at").alias("started_us"),
        F.unix_micros("completed_at").alias("completed_us"), "summary",
    )
