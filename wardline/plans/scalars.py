"""Scalar functions over whole tables."""

from pyspark.sql import functions as F

from ..functions import checks, jsonx, text, times
from ..functions import severity as sev
from ..operators import repair
from .registry import Tables, query

NOW = "2024-01-31 00:00:00"
RAW_SEVERITY = (
    "case p_size % 14 when 0 then ' CRIT ' when 1 then 'important' when 2 then 'Moderate' when 3 then 'med' when 4 then 'WARNING'"
    " when 5 then 'minor' when 6 then 'informational' when 7 then 'critical' when 8 then 'High' when 9 then 'low' when 10 then 'info'"
    " when 11 then 'other' when 12 then null else '' end"
)


@query(
    "f01_norm_severity",
    f"with r as (select p_partkey, {RAW_SEVERITY} as raw from part), k as (select p_partkey, raw, trim(lower(raw)) as s from r)"
    " select p_partkey, case when s in ('critical', 'crit') then 'critical' when s in ('high', 'important') then 'high'"
    " when s in ('low', 'minor') then 'low' when s in ('info', 'informational') then 'info' else 'medium' end as severity,"
    " case when lower(raw) in ('critical', 'high', 'medium', 'low', 'info') then lower(raw) else 'medium' end as stored from k",
)
def _(t: Tables):
    raw = F.expr(RAW_SEVERITY)
    return t.part.select(
        "p_partkey", sev.norm_severity(raw).alias("severity"), sev.stored_severity(raw).alias("stored")
    )


@query(
    "f02_severity_rank",
    "select finding_id, case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 when 'info' then 4 else -1 end"
    " as rank from v_findings",
)
def _(t: Tables):
    return t.v_findings.select("finding_id", sev.severity_rank(F.col("severity")).alias("rank"))


@query(
    "f03_confidence_pct",
    "select finding_id, cast(trunc(confidence * 100) as integer) as pct, line_start as whole, 100 as missing from v_findings",
)
def _(t: Tables):
    return t.v_findings.select(
        "finding_id",
        sev.confidence_pct(F.col("confidence")).alias("pct"),
        sev.confidence_pct(F.col("line_start"), fractional=False).alias("whole"),
        sev.confidence_pct(F.lit(None).cast("double")).alias("missing"),
    )


PATHS = "concat('src/a.b/', p_name, case p_size % 15 when 0 then '.py' when 1 then '.JS' when 2 then '.jsx' when 3 then '.ts' when 4 then '.tsx' when 5 then '.java' when 6 then '.go' when 7 then '.rs' when 8 then '.c' when 9 then '.cpp' when 10 then '.h' when 11 then '.swift' when 12 then '.rb' when 13 then '' else '.' end)"


@query(
    "f04_language_of",
    f"with x as (select p_partkey, {PATHS} as path from part), e as (select p_partkey, lower(split_part(path, '.', -1)) as e from x)"
    " select p_partkey, case when e = 'py' then 'python' when e in ('js', 'jsx') then 'javascript' when e in ('ts', 'tsx') then 'typescript'"
    " when e = 'rs' then 'rust' when e = 'h' then 'c' when e in ('java', 'go', 'c', 'cpp', 'swift') then e else 'plaintext' end as language,"
    " case when e in ('js', 'jsx') then 'javascript' when e in ('ts', 'tsx') then 'typescript' else 'python' end as script from e",
)
def _(t: Tables):
    path = F.expr(PATHS)
    return t.part.select(
        "p_partkey", text.language_of(path).alias("language"), text.script_language_of(path).alias("script")
    )


@query(
    "f05_match_line",
    "select doc_id, cast(length(p) - length(replace(p, chr(10), '')) + 1 as integer) as line, cast(length(text) - length(replace(text, chr(10), '')) + 1 as integer) as line_count"
    " from (select doc_id, text, substr(text, 1, position(' the ' in text) - 1) as p from documents where contains(text, ' the '))",
)
def _(t: Tables):
    prefix = F.substring_index("text", " the ", 1)
    return t.documents.where(F.col("text").contains(" the ")).select(
        "doc_id", text.line_after(prefix).alias("line"), text.line_count(F.col("text")).alias("line_count")
    )


@query(
    "f06_snippets",
    "with l as (select doc_id, string_split(text, chr(10)) as ls, 1 + doc_id % len(string_split(text, chr(10))) as n from documents)"
    " select doc_id, md5(array_to_string(list_slice(ls, greatest(n - 2, 1), least(n + 2, len(ls))), chr(10))) as centred,"
    " md5(array_to_string(list_slice(ls, greatest(n - 1, 1), least(n + 2, len(ls))), chr(10))) as uneven from l",
)
def _(t: Tables):
    line = (F.col("doc_id") % text.line_count(F.col("text")) + 1).cast("int")
    return t.documents.select(
        "doc_id",
        F.md5(text.snippet_centred(F.col("text"), line)).alias("centred"),
        F.md5(text.snippet_uneven(F.col("text"), line)).alias("uneven"),
    )


@query(
    "f07_comment_lines",
    "with l as (select file_id, unnest(string_split(content, chr(10))) as line from v_programs)"
    " select file_id, count(*) filter (where regexp_matches(line, '^\\s*(#|//)')) as comments, count(*) as lines from l group by 1",
)
def _(t: Tables):
    lines = t.v_programs.select("file_id", F.explode(F.split("content", "\n")).alias("line"))
    return lines.groupBy("file_id").agg(
        F.count_if(text.is_comment_head(F.col("line"))).alias("comments"), F.count(F.lit(1)).alias("lines")
    )


CREDENTIAL = r"(?i)(?:password|passwd|secret|api_key|apikey|token|auth_key)[\s\p{Z}]*[:=][\s\p{Z}]*[\"''][^\"'']{4,}[\"'']"
SQL_WORDS = r"(?i)(?:^|[^\p{L}\p{N}_])(?:SELECT|INSERT|INTO|UPDATE|DELETE|FROM|WHERE|SET|VALUES|AND|OR)(?:[^\p{L}\p{N}_]|$)"
STRICT_WORDS = SQL_WORDS.replace("|AND|OR", "")
CREDENTIAL_SQL = (
    "with m as (select doc_id, text, regexp_extract(text, '" + CREDENTIAL + "') as hit from documents),"
    " h as (select doc_id, hit, substr(text, 1, position(hit in text) - 1) as prefix from m where hit <> '')"
)


@query(
    "f08_false_credentials",
    CREDENTIAL_SQL
    + " select doc_id, contains(hit, chr(36) || '{') or contains(hit, '#{') or regexp_matches(right(prefix, 300), '" + SQL_WORDS + "') as suppressed,"
    " contains(hit, chr(36) || '{') or contains(hit, '#{') or regexp_matches(right(prefix, 300), '" + STRICT_WORDS + "') as suppressed_strict from h",
)
def _(t: Tables):
    from ..operators.rules import REGEX_RULES

    pattern = next(r.pattern for r in REGEX_RULES if r.credential)
    hits = t.documents.where(F.col("text").rlike(pattern)).select(
        "doc_id",
        F.regexp_substr("text", F.lit(pattern)).alias("hit"),
        F.split("text", pattern, 2)[0].alias("prefix"),
    )
    return hits.select(
        "doc_id",
        text.is_false_credential(F.col("hit"), F.col("prefix")).alias("suppressed"),
        text.is_false_credential(F.col("hit"), F.col("prefix"), strict=True).alias("suppressed_strict"),
    )


@query(
    "f09_secret_lines",
    "with l as (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no, unnest(string_split(text, chr(10))) as line from documents),"
    " m as (select *, regexp_extract(line, '(?i)(?:password|passwd|secret|api_key|apikey|token|auth_key)\\s*[:=]\\s*[''\"][^''\"]{8,}[''\"]') as hit from l)"
    " select doc_id, cast(line_no as integer) as line_no from m where hit <> '' and not regexp_matches(hit, '\\$\\{[^}]+\\}') and not"
    " (regexp_matches(line, '(?i)\\b(?:select|insert|update|delete|where|from|and|or)\\b') and"
    " regexp_matches(line, '=\\s*[''\"][^''\"]*\\$\\{|=\\s*[''\"][^'']*:\\w'))",
)
def _(t: Tables):
    lines = t.documents.where(F.col("text").rlike(text.SECRET_LINE)).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    return lines.where(text.is_secret_line(F.col("line"))).select("doc_id", (F.col("pos") + 1).alias("line_no"))


JSON_TEXT = (
    "case shape when 0 then response when 1 then regexp_extract(response, '```json\\n(.*)\\n```', 1) when 2 then regexp_extract(response, '\\{.*\\}')"
    " when 5 then response when 6 then response when 7 then response when 9 then response end"
)


@query("f10_json_from_text", f"select response_id, {JSON_TEXT} as doc from v_responses")
def _(t: Tables):
    return t.v_responses.select("response_id", jsonx.json_from_text(F.col("response")).alias("doc"))


def _aliases_sql() -> str:
    columns = []
    for name, aliases in jsonx.FINDING_ALIASES.items():
        parts = ", ".join(f"json_extract_string(doc, '$.{a}')" for a in aliases)
        columns.append(f"coalesce({parts}) as {name}")
    return ", ".join(columns)


ALIASED_DOC = (
    "case p_partkey % 3 when 0 then concat('{\"type\": \"', p_type, '\", \"level\": \"x\", \"line\": ', cast(p_size as varchar(20)), '}')"
    " when 1 then concat('{\"name\": \"n\", \"vuln_type\": \"', p_brand, '\", \"score\": \"0.5\", \"cweId\": \"CWE-1\", \"desc\": \"d\"}')"
    " else concat('{\"vulnerability_type\": \"v\", \"type\": \"t\", \"solution\": \"', p_name, '\", \"path\": \"p\", \"snippet\": \"s\"}') end"
)


@query("f11_field_aliases", f"with d as (select p_partkey, {ALIASED_DOC} as doc from part) select p_partkey, {_aliases_sql()} from d")
def _(t: Tables):
    docs = t.part.select("p_partkey", F.expr(ALIASED_DOC).alias("doc"))
    return repair.aliased_fields(docs, "doc").drop("doc")


@query(
    "f12_tolerant_json",
    "select event_id, case when event_id % 3 = 0 then null else json_extract_string(props, '$.k') end as k,"
    " event_id % 3 <> 0 as is_json from events",
)
def _(t: Tables):
    broken = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    doc = jsonx.tolerant_json(broken)
    return t.events.select("event_id", F.get_json_object(doc, "$.k").alias("k"), doc.isNotNull().alias("is_json"))


@query(
    "f13_finding_defaults",
    "select finding_id, coalesce(case when line_start % 2 = 0 then cwe_id end, 'Unknown Vulnerability') as title,"
    " coalesce(explanation, '') as description, coalesce(case when line_start % 2 = 0 then cwe_id end, 'Unknown') as vulnerability_type,"
    " case when line_start % 5 = 0 then 'medium' else severity end as severity, coalesce(case when line_start % 7 <> 0 then analyzer_type end, 'sast') as analyzer_type,"
    " coalesce(case when line_start % 3 <> 0 then cast(trunc(confidence * 100) as integer) end, 100) as confidence from v_findings",
)
def _(t: Tables):
    line = F.col("line_start")
    raw = t.v_findings.withColumns(
        {
            "vulnerability_type": F.when(line % 2 == 0, F.col("cwe_id")),
            "title": F.lit(None).cast("string"),
            "description": F.lit(None).cast("string"),
            "severity": F.when(line % 5 != 0, F.col("severity")),
            "analyzer_type": F.when(line % 7 != 0, F.col("analyzer_type")),
            "confidence": F.when(line % 3 != 0, F.col("confidence")),
        }
    )
    return repair.with_defaults(raw).select(
        "finding_id", "title", "description", "vulnerability_type", "severity", "analyzer_type", "confidence"
    )


BAD_NAME = (
    "concat(case p_size % 6 when 0 then '../../etc/' when 1 then 'a/b/' when 2 then '..' when 3 then '~|<' else '' end, "
    "case p_size % 5 when 0 then '' when 1 then ' .. ' when 2 then concat(p_name, chr(10), '.py') when 3 then concat('?', p_name, '*.js') else concat(p_name, '.') end)"
)


@query(
    "f14_safe_filename",
    f"with n as (select p_partkey, {BAD_NAME} as raw from part), b as (select p_partkey, regexp_replace(replace(split_part(raw, '/', -1), chr(10), ''), '\\.\\.|~|\\||<|>|\\*|\\?|\"', '', 'g') as c from n)"
    " select p_partkey, coalesce(nullif(trim(c, '. '), ''), 'unnamed_file') as name from b",
)
def _(t: Tables):
    return t.part.select("p_partkey", text.safe_filename(F.expr(BAD_NAME)).alias("name"))


@query(
    "f15_time_texts",
    "with s as (select event_id, floor((epoch_us(timestamp '2024-01-31') - epoch_us(ts)) / 1000000)::bigint as s, event_id * 37 as up from events)"
    " select event_id, case when s < 60 then 'just now' when s // 60 < 60 then concat((s // 60)::varchar, 'm ago') when s // 3600 < 24 then concat((s // 3600)::varchar, 'h ago')"
    " else concat((s // 86400)::varchar, 'd ago') end as ago, case when up // 86400 > 0 then concat((up // 86400)::varchar, 'd ', (up % 86400 // 3600)::varchar, 'h')"
    " when up % 86400 // 3600 > 0 then concat((up % 86400 // 3600)::varchar, 'h ', (up % 3600 // 60)::varchar, 'm') else concat((up % 3600 // 60)::varchar, 'm') end as uptime from s",
)
def _(t: Tables):
    now = F.lit(NOW).cast("timestamp")
    return t.events.select(
        "event_id", times.time_ago(F.col("ts"), now).alias("ago"), times.uptime_text(F.col("event_id") * 37).alias("uptime")
    )


@query(
    "f16_prompt_hash",
    "select doc_id, substr(sha256(text), 1, 16) as hash, concat('prompt_cache:', source, ':', lang, ':', substr(sha256(text), 1, 16)) as key from documents",
)
def _(t: Tables):
    return t.documents.select(
        "doc_id",
        text.prompt_hash(F.col("text")).alias("hash"),
        text.memo_key(F.col("source"), F.col("lang"), F.col("text")).alias("key"),
    )


@query(
    "f17_scan_progress",
    "with m as (select analysis_id, status, coalesce(cast(json_extract_string(analysis_metadata, '$.files_completed') as integer), 0) as d,"
    " coalesce(cast(json_extract_string(analysis_metadata, '$.file_count') as integer), 1) as n from v_analyses)"
    " select analysis_id, round(case status when 'running' then case when n > 0 then least(0.95, d / n) else 0.5 end when 'completed' then 1.0 else 0.0 end, 9) as progress,"
    " case status when 'running' then 'analyzing' when 'completed' then 'completed' when 'failed' then 'failed' else 'pending' end as stage from m",
)
def _(t: Tables):
    done = F.get_json_object("analysis_metadata", "$.files_completed").cast("int")
    total = F.get_json_object("analysis_metadata", "$.file_count").cast("int")
    return t.v_analyses.select(
        "analysis_id",
        F.round(times.scan_progress(F.col("status"), done, total), 9).alias("progress"),
        times.scan_stage(F.col("status")).alias("stage"),
    )


@query(
    "f18_lock_state",
    "select event_id, coalesce(u > n, false) as locked, cast(case when u > n then greatest(1, floor((epoch_us(u) - epoch_us(n)) / 60000000)) else 0 end as integer) as minutes"
    " from (select event_id, case when event_id % 4 <> 0 then ts end as u, timestamp '2024-01-15' as n from events)",
)
def _(t: Tables):
    until, now = F.when(F.col("event_id") % 4 != 0, F.col("ts")), F.lit("2024-01-15").cast("timestamp")
    return t.events.select(
        "event_id", times.is_locked(until, now).alias("locked"), times.lock_minutes_left(until, now).alias("minutes")
    )


@query(
    "f19_display_name",
    "select analysis_id, coalesce(nullif(scan_name, ''), nullif(case when analysis_id % 8 = 0 then '' else branch end, ''), 'Unknown') as name from v_analyses",
)
def _(t: Tables):
    branch = F.when(F.col("analysis_id") % 8 == 0, "").otherwise(F.col("branch"))
    return t.v_analyses.select("analysis_id", text.display_name(F.col("scan_name"), branch).alias("name"))


@query(
    "f20_short_labels",
    "select doc_id, case when length(text) > 25 then concat(left(text, 25), '...') else text end as label, left(concat(source, cast(doc_id as varchar)), 8) as short from documents",
)
def _(t: Tables):
    return t.documents.select(
        "doc_id", text.short_label(F.col("text")).alias("label"), text.short_id(F.concat("source", F.col("doc_id").cast("string"))).alias("short")
    )


@query(
    "f21_bands",
    "select p_partkey, case when s >= 80 then 'good' when s >= 60 then 'fair' else 'poor' end as score_band, case when s >= 70 then 'up' else 'down' end as trend,"
    " case when s >= 80 then 'high' when s >= 50 then 'medium' else 'low' end as confidence_band from (select p_partkey, p_partkey % 101 as s from part)",
)
def _(t: Tables):
    score = F.col("p_partkey") % 101
    return t.part.select(
        "p_partkey",
        sev.score_band(score).alias("score_band"),
        sev.score_trend(score).alias("trend"),
        sev.confidence_band(score).alias("confidence_band"),
    )


@query(
    "f22_taint_confidence",
    "select l_orderkey, l_linenumber, l_partkey, round(case when l_suppkey % 9 = 0 then 0 else greatest(0.1, least(1.0, 0.90 - case when l_suppkey % 3 = 0 then 0.15 else 0 end"
    " - case when l_linenumber > 5 then 0.10 when l_linenumber > 3 then 0.05 else 0 end - case when l_partkey % 4 = 0 then 0.30 else 0 end)) end, 6)::double as confidence from lineitem",
)
def _(t: Tables):
    category = F.when(F.col("l_partkey") % 4 == 0, "environment").otherwise("http_request")
    value = sev.taint_confidence(
        F.col("l_linenumber"), F.col("l_suppkey") % 3 == 0, F.col("l_suppkey") % 9 == 0, category
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(value, 6).alias("confidence"))


@query(
    "f23_confidence_scales",
    "select event_id, coalesce(floor(c * 100 + 0.5) / 100.0, 0.7) as rounded, case event_type when 'error' then 0.95 when 'click' then 0.85 else 0.7 end::double as by_severity"
    " from (select event_id, event_type, case when event_id % 5 = 0 then null else value / 7 end as c from events)",
)
def _(t: Tables):
    value = F.when(F.col("event_id") % 5 != 0, F.col("value") / 7)
    level = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "click", "high").otherwise("low")
    return t.events.select(
        "event_id", sev.confidence_2dp(value).alias("rounded"), sev.confidence_from_severity(level).alias("by_severity")
    )


def _calls_sql() -> str:
    parts = []
    for call, label in checks.DANGEROUS_CALLS.items():
        n = lambda c: f"(length({c}) - length(replace({c}, '{call}', '')))"
        parts.append(
            f"case when contains(b, '{call}') and contains(a, '{call}') and {n('a')} >= {n('b')}"
            f" then 'Fix may re-introduce vulnerability: {label}' end"
        )
    return ", ".join(parts)


FIX_WARNINGS_SQL = (
    "with p as (select fix_id, code_before as b, code_after as a from v_fixes)"
    " select fix_id, coalesce(case when trim(a) = '' then case when trim(a) = trim(b) then 'Fixed code is identical to original code; ' else '' end || 'Fixed code is empty'"
    " else array_to_string(list_filter([case when trim(a) = trim(b) then 'Fixed code is identical to original code' end, " + _calls_sql() + "], lambda x: x is not null), '; ') end, '') as warnings from p"
)


@query("f24_fix_warnings", FIX_WARNINGS_SQL)
def _(t: Tables):
    warnings = checks.fix_warnings(F.col("code_before"), F.col("code_after"))
    return t.v_fixes.select("fix_id", F.array_join(warnings, "; ").alias("warnings"))


UPLOADS = (
    "select p_partkey, concat(p_name, case p_size % 6 when 0 then '.py' when 1 then '.js' when 2 then '.exe' when 3 then '.zip' when 4 then '' else '.C' end) as name,"
    " case when p_partkey % 9 = 0 then 10485761 else p_partkey end as size,"
    " case p_partkey % 5 when 0 then 'text/x-python' when 1 then 'text/plain' when 2 then 'application/octet-stream' when 3 then 'image/png' else 'text/x-c' end as mime from part"
)


@query(
    "f25_upload_checks",
    f"with u as ({UPLOADS}), e as (select *, case when contains(name, '.') then lower(concat('.', split_part(name, '.', -1))) else '' end as ext from u),"
    " x as (select *, (ext = '.py' and mime not in ('text/x-python', 'text/x-script.python', 'application/x-python-code')) or (ext = '.js' and mime not in ('text/javascript', 'application/javascript', 'text/x-js'))"
    " or (ext = '.zip' and mime not in ('application/zip', 'application/x-zip-compressed')) or (ext = '.c' and mime not in ('text/x-c', 'text/c')) as bad,"
    " starts_with(mime, 'text/') or mime = 'application/octet-stream' as soft from e)"
    " select p_partkey, array_to_string(list_filter([case when ext not in ('.py', '.js', '.ts', '.java', '.go', '.rs', '.c', '.cpp', '.h', '.hpp', '.swift') then concat('extension not allowed: ', ext) end,"
    " case when size > 10485760 then concat('file too large: ', cast(size as varchar)) end, case when bad and not soft then concat('mime not allowed: ', mime) end], lambda z: z is not null), '; ') as errors,"
    " case when bad and soft then concat('mime unexpected: ', mime) else '' end as warnings from x",
)
def _(t: Tables):
    size = F.col("p_partkey") % 9 == 0
    pick = lambda column, n, values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(column) % n + 1).cast("int"))
    rows = t.part.select(
        "p_partkey",
        F.concat("p_name", pick("p_size", 6, [".py", ".js", ".exe", ".zip", "", ".C"])).alias("name"),
        F.when(size, 10485761).otherwise(F.col("p_partkey")).alias("size"),
        pick("p_partkey", 5, ["text/x-python", "text/plain", "application/octet-stream", "image/png", "text/x-c"]).alias("mime"),
    )
    return rows.select(
        "p_partkey",
        F.array_join(checks.upload_errors(F.col("name"), F.col("size"), F.col("mime")), "; ").alias("errors"),
        F.array_join(checks.upload_warnings(F.col("name"), F.col("mime")), "; ").alias("warnings"),
    )


@query(
    "f26_client_key",
    "select event_id, case when event_id % 4 = 0 then '10.0.0.1' when event_id % 4 = 1 then concat('h', cast(user_id as varchar)) when event_id % 4 = 2 then 'cookie'"
    " else case when user_id % 2 = 0 then 'b' end end as client from events",
)
def _(t: Tables):
    kind, user = F.col("event_id") % 4, F.col("user_id")
    forwarded = F.when(kind == 0, "9.9.9.9, 10.0.0.1 , ").when(kind == 1, " , ").when((kind == 3) & (user % 2 == 0), "a,b")
    host = F.when(kind == 1, F.concat(F.lit("h"), user.cast("string"))).otherwise("")
    cookie = F.when(kind == 2, "cookie")
    return t.events.select("event_id", checks.client_key(forwarded, host, cookie).alias("client"))


@query(
    "f27_looks_like_sql",
    "select call_id, file_id, case when arg0_kind in ('literal', 'template', 'concat') then regexp_matches(arg0_text, '(?i)\\b(?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|FROM|WHERE)\\b')"
    " when arg0_kind = 'identifier' then regexp_matches(arg0_text, '(?i)^(?:sql|query|stmt|command)') else false end as sql_like from v_calls",
)
def _(t: Tables):
    return t.v_calls.select(
        "call_id", "file_id", text.looks_like_sql(F.col("arg0_kind"), F.col("arg0_text")).alias("sql_like")
    )


@query(
    "f28_leftover_metadata",
    "select finding_id, stage as m_stage, explanation as m_explanation, null::varchar as m_severity from v_findings",
)
def _(t: Tables):
    fields = {c: F.col(c) for c in ("severity", "stage", "explanation", "file_path")}
    doc = jsonx.leftover_metadata(fields, ["severity", "file_path"])
    return t.v_findings.select(
        "finding_id",
        F.get_json_object(doc, "$.stage").cast("int").alias("m_stage"),
        F.get_json_object(doc, "$.explanation").alias("m_explanation"),
        F.get_json_object(doc, "$.severity").alias("m_severity"),
    )


@query(
    "f29_merge_json",
    "select event_id, json_extract_string(props, '$.k') as old_k, event_type as fixed_by, case when event_id % 2 = 0 then 'new' else json_extract_string(props, '$.k') end as k from events",
)
def _(t: Tables):
    plain = jsonx.merge_json(F.col("props"), {"fixed_by": F.col("event_type")})
    replaced = jsonx.merge_json(F.col("props"), {"fixed_by": F.col("event_type"), "k": F.lit("new")})
    doc = F.when(F.col("event_id") % 2 == 0, replaced).otherwise(plain)
    return t.events.select(
        "event_id",
        F.get_json_object("props", "$.k").alias("old_k"),
        F.get_json_object(doc, "$.fixed_by").alias("fixed_by"),
        F.get_json_object(doc, "$.k").alias("k"),
    )


@query(
    "f30_share_expiry",
    "select event_id, case when event_id % 3 = 0 then null when user_id = 0 then null else epoch_us(ts + user_id * interval '1' hour) end as expires_us from events",
)
def _(t: Tables):
    hours = F.when(F.col("event_id") % 3 != 0, F.col("user_id").cast("int"))
    return t.events.select("event_id", F.unix_micros(times.share_expiry(F.col("ts"), hours)).alias("expires_us"))
