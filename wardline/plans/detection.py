"""Detection, data flow and repair of raw output."""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect, pyfacts, pyflows, repair, taint
from ..operators.rules import BENCHMARK_RULES, KNOWLEDGE_RULES, REGEX_RULES
from ..operators.taint_tables import SANITIZERS, SINKS, SQL_METHODS
from ..session import cut_lineage
from ..sources.corpus import spread
from .registry import Tables, query
from .scalars import CREDENTIAL, SQL_WORDS, STRICT_WORDS


def _at_rest(view: DataFrame) -> DataFrame:
    """A fact view as the table that an extraction job would have written."""
    return cut_lineage(spread(view), "facts", codec="zstd")


def _re2(pattern: str) -> str:
    """The pattern for the checking database, where ``U`` means something else."""
    return re.sub(r"^\(\?(\w+)\)", lambda m: f"(?{m.group(1).replace('U', '')})" if m.group(1) != "U" else "", pattern).replace("'", "''")


def _rule_sql(rules, source: str, words: str = SQL_WORDS, wide: bool = False) -> str:
    """First match of every rule in every file: prefix, then line."""
    parts = []
    for r in rules:
        pattern = _re2(r.pattern)
        if r.credential:
            pattern = CREDENTIAL if not wide else CREDENTIAL.replace("|auth_key)", "|auth_key|db_pass)")
        keep = "hit <> ''"
        if r.credential:
            keep += f" and not (contains(hit, chr(36) || '{{') or contains(hit, '#{{') or regexp_matches(right(prefix, 300), '{words}'))"
        parts.append(
            f"select file_id, '{r.rule}' as rule, '{r.vulnerability_type}' as vulnerability_type, '{r.cwe_id}' as cwe_id, '{r.severity}' as severity,"
            f" cast(length(prefix) - length(replace(prefix, chr(10), '')) + 1 as integer) as line_start, content from"
            f" (select file_id, content, hit, substr(content, 1, position(hit in content) - 1) as prefix from"
            f" (select file_id, content, regexp_extract(content, '{pattern}') as hit from {source})) where {keep}"
        )
    return " union all ".join(parts)


SNIPPET = (
    "md5(array_to_string(list_slice(string_split(content, chr(10)), greatest(line_start - 1, 1),"
    " least(line_start + 2, len(string_split(content, chr(10))))), chr(10))) as snippet"
)


@query(
    "d01_regex_scan_documents",
    f"select file_id, rule, line_start, {SNIPPET} from ({_rule_sql(REGEX_RULES, 'v_code_files')})",
)
def _(t: Tables):
    found = detect.regex_scan(spread(t.v_code_files))
    return found.select("file_id", "rule", "line_start", F.md5("code_snippet").alias("snippet"))


@query(
    "d01_regex_scan_strict",
    f"select file_id, rule, line_start from ({_rule_sql(REGEX_RULES, 'v_code_files', STRICT_WORDS)})",
)
def _(t: Tables):
    return detect.regex_scan(spread(t.v_code_files), strict=True).select("file_id", "rule", "line_start")


@query(
    "d01_regex_scan_programs",
    f"select file_id, rule, vulnerability_type, cwe_id, severity, line_start, line_start + 1 as line_end, {SNIPPET}"
    f" from ({_rule_sql(REGEX_RULES, 'v_programs')})",
)
def _(t: Tables):
    return detect.regex_scan(spread(t.v_programs)).select(
        "file_id", "rule", "vulnerability_type", "cwe_id", "severity", "line_start", "line_end",
        F.md5("code_snippet").alias("snippet"),
    )


@query(
    "d01_regex_scan_pages",
    f"select file_id, rule, line_start from ({_rule_sql(REGEX_RULES, '(select page_id as file_id, html as content from pages)')})",
)
def _(t: Tables):
    pages = t.pages.select(F.col("page_id").alias("file_id"), F.col("url").alias("file_path"), F.col("html").alias("content"))
    return detect.regex_scan(spread(pages)).select("file_id", "rule", "line_start")


@query(
    "d02_knowledge_scan",
    f"select file_id, rule, vulnerability_type, cwe_id, line_start from ({_rule_sql(KNOWLEDGE_RULES, 'v_programs', wide=True)})",
)
def _(t: Tables):
    return detect.knowledge_scan(spread(t.v_programs)).select("file_id", "rule", "vulnerability_type", "cwe_id", "line_start")


@query(
    "d02_knowledge_scan_documents",
    f"select file_id, rule, line_start from ({_rule_sql(KNOWLEDGE_RULES, 'v_code_files', wide=True)})",
)
def _(t: Tables):
    return detect.knowledge_scan(spread(t.v_code_files)).select("file_id", "rule", "line_start")


def _benchmark_sql(source: str) -> str:
    """No fixture pattern spans lines, so a match outside comments is a match on such a line."""
    parts = [
        f"select distinct file_id, '{r.rule}' as rule, '{r.cwe_id}' as cwe_id from"
        f" (select file_id, unnest(string_split(content, chr(10))) as line from {source})"
        f" where regexp_matches(line, '{_re2(r.pattern)}') and not regexp_matches(line, '^\\s*(#|//)')"
        for r in BENCHMARK_RULES
    ]
    return " union all ".join(parts)


@query("d03_benchmark_scan", _benchmark_sql("v_programs"))
def _(t: Tables):
    return detect.benchmark_scan(spread(t.v_programs)).select("file_id", "rule", "cwe_id")


# What each fixture program holds: program, rule, cwe, severity, confidence, line.
PYTHON_EXPECTED = [
    (1, "sql_assign", "CWE-89", "high", 0.80, 2),
    (1, "sql_call", "CWE-89", "high", 0.85, 3),
    (2, "secret", "CWE-798", "high", 0.80, 2),
    (3, "shell", "CWE-78", "critical", 0.90, 2),
    (3, "eval", "CWE-94", "critical", 0.95, 3),
    (3, "hash", "CWE-327", "medium", 0.85, 4),
    (4, "pickle", "CWE-502", "high", 0.85, 1),
    (4, "yaml", "CWE-502", "medium", 0.80, 2),
    (4, "path", "CWE-22", "high", 0.75, 3),
    (12, "sql_assign", "CWE-89", "high", 0.80, 2),
    (13, "eval", "CWE-94", "critical", 0.95, 3),
    (13, "eval", "CWE-94", "critical", 0.95, 4),
]
SCRIPT_EXPECTED = [
    (6, "eval", "CWE-94", "critical", 0.95, 2),
    (6, "innerHTML", "CWE-79", "high", 0.70, 3),
    (8, "secret", "CWE-798", "high", 0.90, 1),
    (8, "secret_member", "CWE-798", "high", 0.90, 2),
    (9, "docwrite", "CWE-79", "medium", 0.80, 1),
    (9, "timer", "CWE-94", "high", 0.85, 2),
]
ROUTED_EXPECTED = [
    *PYTHON_EXPECTED,
    (5, "credentials", "CWE-798", "high", 0.85, 2),
    *SCRIPT_EXPECTED,
    (10, "command", "CWE-78", "critical", 0.85, 2),
    (12, "flow:db.query", "CWE-89", "critical", 0.90, 3),
    (13, "flow:eval", "CWE-94", "critical", 0.90, 4),
]


def _expected(rows) -> str:
    values = ", ".join(f"({p}, '{r}', '{c}', '{s}', cast({conf} as double), {line})" for p, r, c, s, conf, line in rows)
    return (
        "select p.file_id, e.rule, e.cwe_id, e.severity, e.confidence, e.line_start from v_programs p join"
        f" (values {values}) e(program, rule, cwe_id, severity, confidence, line_start) on p.program = e.program"
    )


FOUND = ("file_id", "rule", "cwe_id", "severity", "confidence", "line_start")


@query("d04_python_ast_scan", _expected(PYTHON_EXPECTED))
def _(t: Tables):
    files = spread(t.v_programs).where("language = 'python'")
    return pyfacts.python_findings(pyfacts.python_facts(files)).select(*FOUND)


@query(
    "d04_parse_status",
    "select file_id, program <> 5 as parsed from v_programs where language = 'python'",
)
def _(t: Tables):
    facts = pyfacts.python_facts(spread(t.v_programs).where("language = 'python'")).where("kind in ('parsed', 'error')")
    return facts.select("file_id", (F.col("kind") == "parsed").alias("parsed"))


@query("d05_script_scan", _expected(SCRIPT_EXPECTED))
def _(t: Tables):
    return detect.script_scan(spread(t.v_programs).where("language in ('javascript', 'typescript')")).select(*FOUND)


def _secret_lines_sql(source: str) -> str:
    return (
        f"with l as (select file_id, unnest(range(1, len(string_split(content, chr(10))) + 1)) as n, unnest(string_split(content, chr(10))) as line from {source}),"
        " m as (select *, regexp_extract(line, '(?i)(?:password|passwd|secret|api_key|apikey|token|auth_key)\\s*[:=]\\s*[''\"][^''\"]{8,}[''\"]') as hit from l)"
        " select file_id, 'CWE-798' as cwe_id, cast(n as integer) as line_start, 0.85::double as confidence from m"
        " where hit <> '' and not regexp_matches(hit, '\\$\\{[^}]+\\}') and not"
        " (regexp_matches(line, '(?i)\\b(?:select|insert|update|delete|where|from|and|or)\\b') and"
        " regexp_matches(line, '=\\s*[''\"][^''\"]*\\$\\{|=\\s*[''\"][^'']*:\\w'))"
    )


@query("d05_secret_lines", _secret_lines_sql("v_programs"))
def _(t: Tables):
    return detect.secret_lines(spread(t.v_programs)).select("file_id", "cwe_id", "line_start", "confidence")


@query("d05_secret_lines_documents", _secret_lines_sql("v_code_files"))
def _(t: Tables):
    return detect.secret_lines(spread(t.v_code_files)).select("file_id", "cwe_id", "line_start", "confidence")


SOURCE_SQL = (
    "select a.file_id, a.node, a.expr, a.line, case when expr = 'req.query.id' then 'req.query' when expr = 'req.body' then 'req.body'"
    " when expr = 'request.params.name' then 'request.params' when expr = 'process.argv' then 'process.argv'"
    " when expr = 'r.headers' and x.file_id is not null then 'req.headers' end as source_type"
    " from v_accesses a left join (select distinct file_id from v_aliases) x on a.file_id = x.file_id"
)
CATEGORY = "case when source_type = 'process.argv' then 'cli_input' else 'http_request' end"


@query(
    "d06a_match_sources",
    f"select file_id, node, expr, line, source_type, {CATEGORY} as category,"
    " case when source_type in ('req.headers', 'process.argv') then 'medium' else 'high' end as severity_base"
    f" from ({SOURCE_SQL}) where source_type is not null",
)
def _(t: Tables):
    return taint.match_sources(t.v_accesses, t.v_aliases).select(
        "file_id", "node", "expr", "line", "source_type", "category", "severity_base"
    )


def _sinks_sql() -> str:
    names = ", ".join(f"'{k}'" for k in SINKS)
    methods = ", ".join(f"'{m}'" for m in SQL_METHODS)
    sql_like = (
        "case when arg0_kind in ('literal', 'template', 'concat') then regexp_matches(arg0_text, '(?i)\\b(?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|FROM|WHERE)\\b')"
        " when arg0_kind = 'identifier' then regexp_matches(arg0_text, '(?i)^(?:sql|query|stmt|command)') else false end"
    )
    values = ", ".join(f"('{k}', '{v[0]}', '{v[1]}', '{v[2]}', '{v[3]}', {v[4]})" for k, v in SINKS.items())
    return (
        f"select c.*, s.sink, s.sink_category, s.vulnerability_type, s.cwe_id, s.severity, s.taint_arg from (select *, case when object || '.' || method in ({names}) then object || '.' || method"
        f" when object is not null and method in ({methods}) and {sql_like} then '.query' when method in ({names}) then method end as k from v_calls) c"
        f" join (values {values}) s(sink, sink_category, vulnerability_type, cwe_id, severity, taint_arg) on c.k = s.sink"
    )


@query("d06b_match_sinks", f"select file_id, call_id, sink, cwe_id, taint_arg from ({_sinks_sql()})")
def _(t: Tables):
    return taint.match_sinks(_at_rest(t.v_calls)).select("file_id", "call_id", "sink", "cwe_id", "taint_arg")


SAFE = (
    "coalesce((sink_category = 'sql_injection' and n_args > 1 and ((arg0_kind = 'literal' and (contains(arg0_text, '?') or contains(arg0_text, '$1') or contains(arg0_text, ':1')))"
    " or arg0_kind = 'static_template' or (coalesce(arg1_kind, '') = 'object' and arg0_kind = 'literal' and (contains(arg0_text, ':') or contains(arg0_text, '$1')))))"
    " or (sink_category = 'xss' and arg0_kind in ('number', 'boolean')) or (sink_category = 'open_redirect' and arg0_kind = 'literal' and starts_with(arg0_text, '/') and not contains(arg0_text, '//'))"
    " or (sink_category = 'path_traversal' and arg0_kind = 'literal'), false)"
)


@query("d06c_safe_calls", f"select file_id, call_id, {SAFE} as safe from ({_sinks_sql()})")
def _(t: Tables):
    return taint.match_sinks(_at_rest(t.v_calls)).select("file_id", "call_id", taint.is_safe_call().alias("safe"))


def _reach_sql(layers: int = 8) -> str:
    """Breadth-first layers written out; eight variables need at most seven steps."""
    strengths = ", ".join(f"('{k}', '{v}')" for k, v in SANITIZERS.items())
    pick = "qualify row_number() over (partition by file_id, node order by source_line, path, source_type, sans) = 1"
    parts = [
        f"strengths as (select * from (values {strengths}) s(name, strength))",
        "live as (select e.*, s.strength from v_edges e left join strengths s on e.sanitizer = s.name where coalesce(s.strength, '') <> 'strong')",
        f"l0 as (select file_id, node, source_type, line as source_line, {CATEGORY} as category, expr || ' ' || node as path, 2 as len, '' as sans, false as weak"
        f" from ({SOURCE_SQL}) where source_type is not null {pick})",
    ]
    for i in range(1, layers):
        seen = " union all ".join(f"select file_id, node from l{j}" for j in range(i))
        parts.append(
            f"l{i} as (select * from (select f.file_id, e.dst as node, f.source_type, f.source_line, f.category, f.path || ' ' || e.dst as path, f.len + 1 as len,"
            f" case when e.strength is null then f.sans when f.sans = '' then e.sanitizer else f.sans || ' ' || e.sanitizer end as sans, f.weak or coalesce(e.strength = 'weak', false) as weak"
            f" from l{i - 1} f join live e on f.file_id = e.file_id and f.node = e.src) c"
            f" where not exists (select 1 from ({seen}) s where s.file_id = c.file_id and s.node = c.node) {pick})"
        )
    union = " union all ".join(f"select * from l{i}" for i in range(layers))
    return "with " + ", ".join(parts) + f", reached as ({union})"


@query(
    "d06_taint_reach",
    _reach_sql() + " select file_id, node, source_type, source_line, category, path, sans as sanitizers from reached",
)
def _(t: Tables):
    return _reached(t, t.v_accesses)


def _reached(t: Tables, accesses):
    labels = taint.source_labels(taint.match_sources(accesses, t.v_aliases))
    reached = taint.taint_reach(_at_rest(t.v_edges), labels)
    return reached.select(
        "file_id",
        "node",
        "source_type",
        "source_line",
        "category",
        F.array_join("path", " ").alias("path"),
        F.array_join("sanitizers.name", " ").alias("sanitizers"),
    )


FINDINGS_SQL = (
    _reach_sql()
    + f", sinks as (select * from ({_sinks_sql()}) where not {SAFE}),"
    " used as (select s.*, a.node from sinks s join (select distinct * from v_args) a on s.file_id = a.file_id and s.call_id = a.call_id and a.arg_index ="
    " case s.taint_arg when -1 then s.n_args - 1 when -2 then 0 else s.taint_arg end)"
    " select u.file_id, u.call_id, u.vulnerability_type || ' via ' || r.source_type as title, u.severity, u.line as line_start,"
    " floor(greatest(0.1, 0.90 - case when r.weak then 0.15 else 0 end - case when r.len > 5 then 0.10 when r.len > 3 then 0.05 else 0 end) * 100 + 0.5) / 100.0 as confidence, r.path, r.source_line"
    " from used u join reached r on u.file_id = r.file_id and u.node = r.node"
)


def _findings(t: Tables, accesses):
    labels = taint.source_labels(taint.match_sources(accesses, t.v_aliases))
    # edges and arguments are read once; equal arguments count once
    reached = taint.reach(t.v_edges, labels)
    return taint.taint_findings(_at_rest(t.v_calls), t.v_args, reached)


@query("d06_taint_findings", f"select file_id, call_id, title, severity, line_start, round(confidence, 6) as confidence, path from ({FINDINGS_SQL})")
def _(t: Tables):
    return _finding_rows(_findings(t, t.v_accesses))


def _finding_rows(findings):
    return findings.select(
        "file_id", "call_id", "title", "severity", "line_start", F.round("confidence", 6).alias("confidence"),
        F.array_join("path", " ").alias("path"),
    )


@query(
    "d06d_flow_records",
    "select file_id, call_id, source_line as first_line, line_start as sink_line, split_part(path, ' ', 1) as first_step, split_part(path, ' ', -1) as last_step,"
    f" 'source_access' as first_operation from ({FINDINGS_SQL})",
)
def _(t: Tables):
    return _flow_records(_findings(t, t.v_accesses))


#: What the flow query reads back from a record, in one pass over its text.
FLOW = "source struct<line:int>, propagation array<struct<variable:string,operation:string>>, sink struct<line:int>"


def _flow_records(findings):
    flows = findings.select("file_id", "call_id", F.from_json("data_flow", FLOW).alias("_flow"))
    steps = F.col("_flow.propagation")
    return flows.select(
        "file_id",
        "call_id",
        F.col("_flow.source.line").alias("first_line"),
        F.col("_flow.sink.line").alias("sink_line"),
        steps[0]["variable"].alias("first_step"),
        F.element_at(steps, -1)["variable"].alias("last_step"),
        steps[0]["operation"].alias("first_operation"),
    )


@query(
    "d06_python_flows",
    "select file_id, file_path, case program when 12 then 'SQL Injection via request.query' else 'Code Injection via request.params' end as title,"
    " case program when 12 then 3 else 4 end as line_start, case program when 12 then 'request.query.name name q' else 'request.params.x' end as path,"
    " 0.9::double as confidence from v_programs where program in (12, 13)",
)
def _(t: Tables):
    facts = cut_lineage(pyfacts.python_facts(spread(t.v_programs).where("language = 'python'")))
    return pyflows.python_flows(facts).select(
        "file_id", "file_path", "title", "line_start", F.array_join("path", " ").alias("path"), "confidence"
    )


RAW_SQL = """
select response_id, 'direct' as outcome, p_type as vulnerability_type, 'critical' as severity, cast(p_size as integer) as line_number, '' as explanation, '' as remediation, 0.5::double as confidence from x where shape = 0
union all select response_id, 'repaired', p_type, 'low', p_size, '', 'use x', 0.7 from x where shape = 1
union all select response_id, 'direct', 'a } b', 'high', null, '', '', 0.7 from x where shape = 2
union all select response_id, 'fallback', 'Unknown', 'medium', null, response, '', 0.3 from x where shape in (3, 8)
union all select response_id, 'rejected', null, null, null, null, null, null from x where shape in (4, 6)
union all select response_id, 'single', p_type, 'medium', null, '', '', 0.25 from x where shape = 5
union all select response_id, 'repaired', p_type, 'medium', null, '', '', 0.7 from x where shape = 7
union all select response_id, 'direct', null, null, null, null, null, null from x where shape = 9
"""
RESPONSES = "with x as (select r.*, p.p_type, p.p_size, p.p_brand from v_responses r join part p on r.response_id = p.p_partkey)"


@query("d07_normalize_raw_findings", RESPONSES + RAW_SQL)
def _(t: Tables):
    return repair.normalize_raw_findings(spread(t.v_responses)).select(
        "response_id", "outcome", "vulnerability_type", "severity", "line_number", "explanation", "remediation", "confidence"
    )


@query(
    "d08_parse_fixes",
    RESPONSES + " select response_id, case when shape in (3, 4, 6) then 'rejected' when shape = 8 then 'code_block' else 'json' end as outcome,"
    " case when shape not in (3, 4, 6) then original_code end as code_before,"
    " case when shape in (3, 4, 6) then null when shape = 8 then 'run(' || p_size || ')' when shape = 9 then 'new ' || p_brand else '' end as code_after,"
    " case when shape in (3, 4, 6) then null when shape = 8 then response when shape = 9 then 'd' else '' end as explanation,"
    " case when shape in (3, 4, 6) then null when shape = 8 then 0.5 when shape = 9 then 0.9 else 0.7 end::double as confidence from x",
)
def _(t: Tables):
    return repair.parse_fixes(spread(t.v_responses)).select(
        "response_id", "outcome", "code_before", "code_after", "explanation", "confidence"
    )


@query(
    "d08_parse_explanations",
    "select response_id, case when shape in (3, 4, 6, 8) then 'rejected' else 'json' end as outcome, case when shape in (3, 4, 6, 8) then null when shape = 9 then 'T' else '' end as title,"
    " case when shape in (3, 4, 6, 8) then null when shape = 9 then 'd' else '' end as description, case when shape in (3, 4, 6, 8) then null when shape = 9 then 'r1,r2' else '' end as \"references\" from v_responses",
)
def _(t: Tables):
    return repair.parse_explanations(spread(t.v_responses)).select(
        "response_id", "outcome", "title", "description", F.array_join("references", ",").alias("references")
    )


@query("d09_route_by_language", _expected(ROUTED_EXPECTED))
def _(t: Tables):
    return detect.route_by_language(spread(t.v_programs)).select(*FOUND)


FIXES_OK = (
    "with p as (select x.*, f.cwe_id from v_fixes x left join v_findings f on x.finding_id = f.finding_id),"
    " v as (select cwe_id, language, not (trim(code_after) = '' or trim(code_after) = trim(code_before) or (language = 'python' and code_after = ' y = 1 ')"
    " or (contains(code_before, 'eval(') and contains(code_after, 'eval(') and (length(code_after) - length(replace(code_after, 'eval(', ''))) >= (length(code_before) - length(replace(code_before, 'eval(', ''))))"
    " or (contains(code_before, 'innerHTML') and contains(code_after, 'innerHTML'))) as ok from p)"
)


@query(
    "d10_validate_fixes",
    FIXES_OK + " select cwe_id, language, count(*) as n, count(*) filter (where ok) as n_valid, round(avg(case when ok then 1.0 else 0.0 end), 9) as valid_share from v group by 1, 2",
)
def _(t: Tables):
    validated = detect.validate_fixes(t.v_fixes, t.v_findings)
    return detect.fix_quality(validated).withColumn("valid_share", F.round("valid_share", 9))


KNOWLEDGE_SQL = _rule_sql(KNOWLEDGE_RULES, "v_programs", wide=True)
CORPUS_SQL = (
    f"with first as ({_expected(ROUTED_EXPECTED)}), again as ({KNOWLEDGE_SQL}),"
    " rows as (select file_id, cwe_id, line_start, confidence from first union all select file_id, cwe_id, line_start, 0.85::double from again)"
    " select file_id, cwe_id, line_start, max(confidence) as confidence from rows group by 1, 2, 3"
)


@query("d11_scan_corpus", CORPUS_SQL)
def _(t: Tables):
    return detect.scan_corpus(spread(t.v_programs)).select("file_id", "cwe_id", "line_start", "confidence")
