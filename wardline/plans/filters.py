"""Predicates and projections."""

from pyspark.sql import functions as F

from ..operators import filters, ranking
from .registry import Tables, query

NOW = "2024-01-31 00:00:00"


@query(
    "p01_where_eq",
    "select user_id, email, role from v_users where role = 'developer' and is_active = true",
)
def _(t: Tables):
    rows = filters.where_eq(t.v_users, role="developer", is_active=True, unknown_column=3, email=None)
    return rows.select("user_id", "email", "role")


@query("p01_get_one_null", "select user_id, email from v_users where false")
def _(t: Tables):
    return filters.get_one(t.v_users, email=None).select("user_id", "email")


@query("p02_get_by_id", "select user_id, full_name from v_users where user_id = 42")
def _(t: Tables):
    return filters.get_by_id(t.v_users, 42, "user_id").select("user_id", "full_name")


@query(
    "p03_search_ilike",
    "select article_id, title, category from v_kb_articles"
    " where contains(lower(title), 'ring') or contains(lower(category), 'ring')",
)
def _(t: Tables):
    return filters.search(t.v_kb_articles, "RING", ["title", "category"]).select("article_id", "title", "category")


@query(
    "p03_search_literal_wildcards",
    "with a as (select article_id, slug, case article_id % 7 when 0 then concat(title, ' 5%') when 1 then concat(title, ' a_b') else title end as title"
    " from v_kb_articles) select article_id, title from a where contains(title, '_') or contains(title, '%')",
)
def _(t: Tables):
    kind = F.col("article_id") % 7
    title = F.when(kind == 0, F.concat("title", F.lit(" 5%"))).when(kind == 1, F.concat("title", F.lit(" a_b"))).otherwise(F.col("title"))
    hits = filters.matches_term("_", ["title"]) | filters.matches_term("%", ["title", "slug"])
    return t.v_kb_articles.withColumn("title", title).where(hits).select("article_id", "title")


@query(
    "p04_visible_analyses",
    "select analysis_id, user_id, project_id from v_analyses where project_id in"
    " (select project_id from v_projects where user_id = 7) or (project_id is null and user_id = 7)",
)
def _(t: Tables):
    return filters.visible_analyses(t.v_analyses, t.v_projects, 7).select("analysis_id", "user_id", "project_id")


@query("p04_visible_to_admin", "select analysis_id from v_analyses")
def _(t: Tables):
    return filters.visible_analyses(t.v_analyses, t.v_projects, 7, is_admin=True).select("analysis_id")


@query(
    "p05_effective_owner",
    "select analysis_id, coalesce(json_extract_string(analysis_metadata, '$.uploaded_by'), cast(user_id as varchar)) as effective_owner"
    " from v_analyses",
)
def _(t: Tables):
    return filters.with_effective_owner(t.v_analyses, "analysis_metadata", "user_id").select(
        "analysis_id", "effective_owner"
    )


@query(
    "p05_readable_by_owner",
    "select analysis_id from v_analyses where json_extract_string(analysis_metadata, '$.uploaded_by') = '8'",
)
def _(t: Tables):
    owned = filters.with_effective_owner(t.v_analyses.withColumn("none", F.lit(None).cast("string")), "analysis_metadata", "none")
    return filters.readable_by(owned, 8).select("analysis_id")


@query("p06_active_published", "select article_id, slug from v_kb_articles where is_published")
def _(t: Tables):
    return filters.active(t.v_kb_articles, "is_published").select("article_id", "slug")


@query("p07_pruned_listing", "select file_id, project_id, file_path, language, file_size from v_code_files")
def _(t: Tables):
    return filters.without(t.v_code_files, "content")


@query(
    "p08_response_projection",
    "select analysis_id, status, branch, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as created_at from v_analyses",
)
def _(t: Tables):
    return filters.with_iso_times(t.v_analyses.select("analysis_id", "status", "branch", "created_at"), "created_at")


@query(
    "p09_event_filter",
    "select event_id, user_id from v_system_events where event_type = 'error' and severity = 'error'",
)
def _(t: Tables):
    return filters.where_eq(t.v_system_events, event_type="error", severity="error").select("event_id", "user_id")


@query(
    "p10_history_filter",
    "select analysis_id, branch from v_analyses where status = 'completed'"
    " and (contains(lower(branch), 'urgent') or contains(cast(analysis_id as varchar), 'urgent'))",
)
def _(t: Tables):
    return filters.history(t.v_analyses, "completed", "Urgent").select("analysis_id", "branch")


@query(
    "p11_share_state",
    "select c_custkey as share_id, case when c_custkey % 10 = 0 then 'missing' when c_acctbal < 0 then 'revoked'"
    " when c_custkey % 3 <> 0 and timestamp '2024-01-01' + c_custkey * interval '1' hour < timestamp '2024-01-31' then 'expired'"
    " else 'valid' end as state from customer",
)
def _(t: Tables):
    start = F.lit("2024-01-01").cast("timestamp")
    tokens = t.customer.select(
        F.col("c_custkey").alias("share_id"),
        F.when(F.col("c_custkey") % 10 != 0, F.concat(F.lit("tok"), "c_custkey")).alias("token"),
        (F.col("c_acctbal") < 0).alias("is_revoked"),
        F.when(F.col("c_custkey") % 3 != 0, start + F.make_dt_interval(hours=F.col("c_custkey").cast("int"))).alias("expires_at"),
    )
    return filters.with_share_state(tokens, F.lit(NOW).cast("timestamp")).select("share_id", "state")


@query("p12_findings_filter", "select finding_id, severity from v_findings where severity = 'high'")
def _(t: Tables):
    return filters.by_severity(t.v_findings, "high").select("finding_id", "severity")


@query(
    "p13_user_search",
    "with hits as (select * from v_users where role = 'developer' and (contains(lower(email), '00') or contains(lower(full_name), '00')))"
    " select user_id, email, cast((select count(*) from hits) as bigint) as total, 2 as page, 20 as page_size,"
    " cast(ceil((select count(*) from hits) / 20.0) as bigint) as total_pages"
    " from hits order by user_id desc limit 20 offset 20",
)
def _(t: Tables):
    hits = filters.search(filters.where_eq(t.v_users, role="developer"), "00", ["email", "full_name"])
    rows = ranking.page(hits, [F.col("user_id").desc()], skip=20, limit=20)
    return rows.select("user_id", "email", "total", "page", "page_size", "total_pages")
