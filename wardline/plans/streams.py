"""Streaming jobs run to the end of the table, and their batch forms."""

from pyspark.sql import functions as F

from ..operators.maintenance import scan_lifecycle
from ..streaming import run, stateful, windows
from .maintenance import LIFECYCLE, _status_events
from .registry import Tables, query
from .windows import LOCKOUT_SQL

# A stream emits a window once the watermark, the latest time less the delay, has passed its end.
CLOSED = "(select max(ts) - interval 1 minute from v_requests)"


def _span(df):
    """Window bounds in seconds."""
    return df.withColumns(
        {"start_s": F.unix_seconds("window.start"), "end_s": F.unix_seconds("window.end")}
    ).drop("window")


def _sliding_sql(columns: str, keys: str, size: int, slide: int) -> str:
    return (
        "with w as (select *, unnest(range(0, {n})) as k from v_requests),"
        " s as (select *, cast(floor(epoch(ts) / {slide}) as bigint) * {slide} - k * {slide} as start_s from w)"
        " select {keys} start_s, start_s + {size} as end_s, {columns} from s"
        " where start_s + {size} <= epoch({closed}) group by {group}"
    ).format(
        n=size // slide, slide=slide, size=size, keys=keys, columns=columns, closed=CLOSED, group=keys + " start_s, end_s"
    )


RATE = _sliding_sql("count(*) as n, round(count(*) / 300, 9) as rate", "method,", 300, 60)


@query("t01_request_rate", RATE)
def _(t: Tables):
    requests = windows.watermarked(t.stream("v_requests"))
    rates = windows.request_rate(requests, ["method"], slide="1 minute")
    return _span(run.to_table(rates, "rates")).withColumn("rate", F.round("rate", 9))


@query("t01_request_rate_batch", RATE.replace(f"where start_s + 300 <= epoch({CLOSED}) ", ""))
def _(t: Tables):
    return _span(windows.request_rate(t.v_requests, ["method"], slide="1 minute")).withColumn("rate", F.round("rate", 9))


ERROR_COLUMNS = (
    "count(*) as n, count(*) filter (where status between 500 and 599) as errors,"
    " round(count(*) filter (where status between 500 and 599) / count(*), 9) as ratio,"
    " count(*) filter (where status between 500 and 599) / count(*) > 0.05 as breach"
)


@query("t02_error_ratio", _sliding_sql(ERROR_COLUMNS, "", 300, 60))
def _(t: Tables):
    ratios = windows.error_ratio(windows.watermarked(t.stream("v_requests")), slide="1 minute")
    return _span(run.to_table(ratios, "errors")).withColumn("ratio", F.round("ratio", 9))


def _open(sql: str) -> str:
    """The statement with the windows that are still open at the end."""
    return sql[: sql.index("where start_s")] + sql[sql.index("group by") :]


@query("t02_error_ratio_batch", _open(_sliding_sql(ERROR_COLUMNS, "", 300, 60)))
def _(t: Tables):
    return _span(windows.error_ratio(t.v_requests, slide="1 minute")).withColumn("ratio", F.round("ratio", 9))


QUANTILES = (
    "count(*) as n, quantile_disc(duration, 0.5) as p50, quantile_disc(duration, 0.95) as p95, quantile_disc(duration, 0.99) as p99,"
    " quantile_disc(duration, 0.95) > 2.0 as breach"
)


@query("t03_latency_quantiles", _sliding_sql(QUANTILES, "", 21600, 10800))
def _(t: Tables):
    requests = windows.watermarked(t.stream("v_requests"))
    return _span(run.to_table(windows.latency_quantiles(requests, window="6 hours", slide="3 hours"), "latency"))


@query("t03_latency_quantiles_batch", _open(_sliding_sql(QUANTILES, "", 21600, 10800)))
def _(t: Tables):
    return _span(windows.latency_quantiles(t.v_requests, window="6 hours", slide="3 hours"))


HOLD_RULES = [dict(r, hold=r["hold"] * 60) for r in windows.GAUGE_RULES]
RULES_SQL = (
    "rules as (select * from (values "
    + ", ".join(f"('{r['rule']}', '{r['gauge']}', '{r['op']}', cast({r['bound']} as double), {r['hold']})" for r in HOLD_RULES)
    + ") r(rule, gauge, op, bound, hold)),"
    " b as (select r.rule, g.seq, g.ts, r.hold, case r.op when '>' then g.value > r.bound when '<' then g.value < r.bound else g.value = r.bound end as breach"
    " from v_gauges g join rules r on g.gauge = r.gauge)"
)
HOLD_SQL = (
    f"with {RULES_SQL}, i as (select *, sum(case when breach then 0 else 1 end) over (partition by rule order by ts, seq rows unbounded preceding) as island from b),"
    " s as (select *, min(epoch_us(ts)) filter (where breach) over (partition by rule, island) as since from i)"
    " select rule, seq, case when breach then since end as since_us, breach and epoch_us(ts) - since >= hold::bigint * 1000000 as firing from s"
)


@query("t04_alert_hold", HOLD_SQL)
def _(t: Tables):
    breaches = windows.gauge_breaches(t.stream("v_gauges"), HOLD_RULES)
    return run.to_table(stateful.stream_alert_hold(breaches), "alerts").select("rule", "seq", "since_us", "firing")


# In event time a row is judged once the watermark has passed it.
PASSED = "epoch_ms(ts) <= (select epoch_ms(max(ts) - interval 1 minute) from v_gauges)"


@query("t04_alert_hold_event_time", f"select x.* from ({HOLD_SQL}) x join v_gauges g on x.seq = g.seq where {PASSED.replace('(ts)', '(g.ts)', 1)}")
def _(t: Tables):
    breaches = windows.gauge_breaches(t.stream("v_gauges"), HOLD_RULES)
    out = run.to_table(stateful.stream_alert_hold(breaches, "1 minute"), "alerts")
    return out.where("seq is not null").select("rule", "seq", "since_us", "firing")


@query("t04_alert_hold_batch", HOLD_SQL)
def _(t: Tables):
    breaches = windows.gauge_breaches(t.v_gauges, HOLD_RULES)
    return stateful.alert_hold(breaches).select("rule", "seq", "since_us", "firing")


@query("t05_gauge_breaches", f"with {RULES_SQL} select rule, seq, breach from b")
def _(t: Tables):
    breaches = windows.gauge_breaches(t.stream("v_gauges"), HOLD_RULES)
    return run.to_table(breaches.select("rule", "seq", "breach"), "breaches")


@query(
    "t06_limited_clients",
    "select client, cast(epoch(date_trunc('day', ts)) as bigint) as start_s, cast(epoch(date_trunc('day', ts)) as bigint) + 86400 as end_s, count(*) as n, 3 as \"limit\""
    f" from v_requests where date_trunc('day', ts) + interval 1 day <= {CLOSED} group by 1, 2, 3 having count(*) > 3",
)
def _(t: Tables):
    requests = windows.watermarked(t.stream("v_requests")).select("ts", "client")
    return _span(run.to_table(windows.limited_clients(requests, "1 day", 3), "limits"))


@query(
    "t06_limited_clients_batch",
    "select client, cast(epoch(date_trunc('day', ts)) as bigint) as start_s, cast(epoch(date_trunc('day', ts)) as bigint) + 86400 as end_s, count(*) as n, 3 as \"limit\""
    " from v_requests group by 1, 2, 3 having count(*) > 3",
)
def _(t: Tables):
    return _span(windows.limited_clients(t.v_requests.select("ts", "client"), "1 day", 3))


@query(
    "t06_limited_routes_batch",
    "with r as (select user_id % 3 as client, ts, case event_type when 'click' then '/auth/login' when 'error' then '/auth/reset-password' else '/x' end as route from events)"
    " select client, route, cast(floor(epoch(ts) / 3600) as bigint) * 3600 as start_s, cast(floor(epoch(ts) / 3600) as bigint) * 3600 + 3600 as end_s, count(*) as n,"
    " case route when '/auth/login' then 5 when '/auth/reset-password' then 3 else 100 end as \"limit\" from r group by all"
    " having count(*) > case route when '/auth/login' then 5 when '/auth/reset-password' then 3 else 100 end",
)
def _(t: Tables):
    kind = F.col("event_type")
    route = F.when(kind == "click", "/auth/login").when(kind == "error", "/auth/reset-password").otherwise("/x")
    requests = t.events.select((F.col("user_id") % 3).alias("client"), "ts", route.alias("route"))
    return _span(windows.limited_clients(requests, "1 hour", windows.route_limit(F.col("route"))))


@query(
    "t06_limited_requests_batch",
    "select event_id, row_number() over (partition by client, date_trunc('day', ts) order by ts, seq) as position,"
    " row_number() over (partition by client, date_trunc('day', ts) order by ts, seq) > 3 as rejected from v_requests",
)
def _(t: Tables):
    out = stateful.limited_requests(t.v_requests, 86400, 3)
    return out.select("event_id", "position", "rejected")


@query(
    "t06_route_limits",
    "select event_id, case path when '/auth/login' then 5 when '/guest' then 10 when '/auth/reset-password' then 3 else 100 end as \"limit\" from"
    " (select event_id, case event_type when 'click' then '/auth/login' when 'view' then '/guest' when 'error' then '/auth/reset-password' else '/x' end as path from events)",
)
def _(t: Tables):
    kind = F.col("event_type")
    route = F.when(kind == "click", "/auth/login").when(kind == "view", "/guest").when(kind == "error", "/auth/reset-password").otherwise("/x")
    return t.events.select("event_id", windows.route_limit(route).alias("limit"))


@query("t07_lockouts", LOCKOUT_SQL)
def _(t: Tables):
    return run.to_table(stateful.stream_lockouts(t.stream("v_logins")), "lockouts").select(
        "user_id", "seq", "failed_attempts", "locked", "locked_until_us"
    )


CIRCUIT_SQL = """
with recursive o as (select provider, seq, ok, epoch_us(ts) as us, row_number() over (partition by provider order by ts, seq) as rn from v_outcomes),
r(provider, rn, seq, fails, is_open, last) as (
  select provider, rn, seq, case when ok then 0 else 1 end::bigint, false, case when ok then 0 else us end from o where rn = 1
  union all
  select o.provider, o.rn, o.seq,
    case when o.ok then 0 when r.is_open and o.us - r.last > least(30 * power(2, least(r.fails, 10)), 300) * 1000000 then 1 else r.fails + 1 end::bigint,
    case when o.ok then false when r.is_open and o.us - r.last > least(30 * power(2, least(r.fails, 10)), 300) * 1000000 then false else r.is_open or r.fails + 1 >= 3 end,
    case when o.ok then r.last else o.us end
  from r join o on o.provider = r.provider and o.rn = r.rn + 1)
select provider, seq, fails as failures, is_open as circuit_open, case when is_open then least(30 * power(2, least(fails, 10)), 300) else 0 end::bigint as reset_seconds from r
"""


@query("t08_circuits", CIRCUIT_SQL)
def _(t: Tables):
    outcomes = t.stream("v_outcomes").select("provider", "ts", "seq", "ok")
    return run.to_table(stateful.stream_circuits(outcomes), "circuits").select(
        "provider", "seq", "failures", "circuit_open", "reset_seconds"
    )


@query("t09_scan_lifecycle", LIFECYCLE)
def _(t: Tables):
    states = scan_lifecycle(_status_events(t.stream("events")))
    latest = run.to_snapshot(states, "lifecycle", ["scan_id"])
    return latest.select(
        "scan_id", "status", F.unix_micros("started_at").alias("started_us"),
        F.unix_micros("completed_at").alias("completed_us"), "summary", "error",
    )


@query("t10_files_completed", "select user_id as scan_id, count(*) as files_completed from v_system_events group by 1")
def _(t: Tables):
    progress = t.stream("v_system_events").select(F.col("user_id").alias("scan_id"))
    return run.to_snapshot(windows.files_completed(progress), "progress", ["scan_id"])


@query("t11_ingest_events", "select distinct event_id, user_id, event_type from v_system_events")
def _(t: Tables):
    once = t.stream("v_system_events")
    twice = windows.watermarked(once.unionByName(once), "created_at", "10 minutes")
    return run.to_table(windows.ingest_events(twice), "log").select("event_id", "user_id", "event_type")


MEMO_SQL = """
with recursive o as (select cast(user_id % 7 as varchar) as key, event_id as seq, epoch_us(ts) as us, row_number() over (partition by user_id % 7 order by ts, event_id) as rn from events),
r(key, rn, seq, until, hit) as (
  select key, rn, seq, us + 3600000000, false from o where rn = 1
  union all
  select o.key, o.rn, o.seq, case when o.us < r.until then r.until else o.us + 3600000000 end, o.us < r.until from r join o on o.key = r.key and o.rn = r.rn + 1)
select key, seq, hit from r
"""


@query("t12_memo_replay", MEMO_SQL)
def _(t: Tables):
    calls = t.stream("v_system_events").select(
        (F.col("user_id") % 7).cast("string").alias("key"), F.col("created_at").alias("ts"), F.col("event_id").alias("seq")
    )
    return run.to_table(stateful.stream_memo(calls), "memo").select("key", "seq", "hit")


@query(
    "t12_memo_lookup_batch",
    "with m as (select user_id % 7 as k, ts from events where event_type = 'purchase'), c as (select user_id % 7 as k, ts, event_id as seq from events where event_type <> 'purchase')"
    " select c.seq, coalesce(epoch_us(c.ts) - epoch_us(m.ts) < 3600000000, false) as hit from c asof left join m on c.k = m.k and c.ts >= m.ts",
)
def _(t: Tables):
    keyed = t.events.select((F.col("user_id") % 7).alias("key"), "ts", F.col("event_id").alias("seq"), "event_type")
    calls = keyed.where("event_type <> 'purchase'").drop("event_type")
    memo = keyed.where("event_type = 'purchase'").drop("event_type")
    return stateful.memo_lookup(calls, memo).select("seq", "hit")


@query(
    "t13_usage_by_day_batch",
    "select provider, cast(epoch(date_trunc('day', ts)) as bigint) as start_s, cast(epoch(date_trunc('day', ts)) as bigint) + 86400 as end_s, count(*) as calls,"
    " sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens from v_outcomes group by 1, 2, 3",
)
def _(t: Tables):
    return _span(windows.usage_by_day(t.v_outcomes))


@query(
    "t13_usage_by_day",
    "select provider, cast(epoch(date_trunc('day', ts)) as bigint) as start_s, cast(epoch(date_trunc('day', ts)) as bigint) + 86400 as end_s, count(*) as calls,"
    " sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens from v_outcomes"
    " where date_trunc('day', ts) + interval 1 day <= (select max(ts) - interval 1 day from v_outcomes) group by 1, 2, 3",
)
def _(t: Tables):
    calls = windows.watermarked(t.stream("v_outcomes"), "ts", "1 day")
    return _span(run.to_table(windows.usage_by_day(calls), "usage"))


REVOKED = (
    "with v as (select user_id % 40 as token, ts as revoked_at, 3600 * (1 + event_id % 30) as ttl from events where event_type = 'error')"
    " select e.event_id from events e where e.event_type <> 'error' and exists (select 1 from v where v.token = e.user_id % 40 and e.ts >= v.revoked_at"
    " and epoch_us(e.ts) < epoch_us(v.revoked_at) + v.ttl * 1000000)"
)


def _tokens(events):
    token = F.concat(F.lit("token-"), (F.col("user_id") % 40).cast("string"))
    return events.select("event_id", "ts", "event_type", token.alias("token"))


def _revocations(t: Tables):
    return _tokens(t.events).where("event_type = 'error'").select(
        "token", F.col("ts").alias("revoked_at"), (3600 * (F.col("event_id") % 30 + 1)).alias("ttl_seconds")
    )


@query("t14_revoked_requests", REVOKED)
def _(t: Tables):
    requests = _tokens(t.stream("v_system_events").withColumnRenamed("created_at", "ts")).where("event_type <> 'error'")
    return run.to_table(windows.revoked_requests(requests, _revocations(t)).select("event_id"), "revoked")


@query(
    "t14_revoked_requests_state",
    REVOKED + " and epoch_ms(e.ts) <= (select epoch_ms(max(ts) - interval 10 minute) from events)",
)
def _(t: Tables):
    uses = _tokens(t.stream("v_system_events").withColumnRenamed("created_at", "ts"))
    ttl = F.when(F.col("event_type") == "error", 3600 * (F.col("event_id") % 30 + 1))
    uses = uses.select("token", "ts", F.col("event_id").alias("seq"), ttl.alias("ttl_seconds"))
    out = run.to_table(stateful.stream_revocations(uses, "10 minutes"), "revoked")
    return out.where("revoked").select(F.col("seq").alias("event_id"))


@query("t14_revoked_requests_batch", REVOKED)
def _(t: Tables):
    requests = _tokens(t.events).where("event_type <> 'error'")
    return windows.revoked_requests(requests, _revocations(t)).select("event_id")
