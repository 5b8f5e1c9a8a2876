"""Chunked running values, quantiles and sequential operators against plain Python."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators.maintenance import apply_enrollments, enrollment_rejects
from wardline.operators.joins import annotate_lines, file_findings
from wardline.operators.prefix import RANGE, Running, exact_quantiles, in_ranges, running
from wardline.operators.ranking import dedup_findings, lockouts
from wardline.streaming import stateful

START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


@pytest.mark.parametrize("seed", [1, 2])
def test_running_equals_plain_scan(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("aab"), i, rng.choice([None, -2, 0, 3, 7])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, pos long, v long")
    out = running(
        df,
        ["k"],
        ["pos"],
        F.floor(F.col("pos") / 17),
        total=Running("sum", F.col("v")),
        low=Running("min", F.col("v")),
        high=Running("max", F.col("v")),
        before=Running("last", F.col("v"), exclusive=True),
    )
    got = {r.pos: (r.total, r.low, r.high, r.before) for r in out.collect()}
    seen = {"a": [], "b": []}
    for k, pos, v in rows:
        earlier = [x for x in seen[k] if x is not None]
        seen[k].append(v)
        now = [x for x in seen[k] if x is not None]
        assert got[pos] == (
            sum(now), min(now, default=None), max(now, default=None), earlier[-1] if earlier else None
        )


def test_exact_quantiles_match_interpolation(spark):
    rng = random.Random(5)
    rows = [(rng.choice("xy"), round(rng.expovariate(0.1), 2)) for _ in range(500)] + [("z", 4.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    for r in exact_quantiles(df, ["k"], "v", [0.5, 0.95, 0.99]).collect():
        values = [v for k, v in rows if k == r.k]
        want = np.quantile(values, [0.5, 0.95, 0.99])
        assert np.allclose([r.p50, r.p95, r.p99], want)


def login_states(events):
    """The rules, one login after the other."""
    fails, until, out = 0, None, []
    for ts, ok in events:
        if ok and (until is None or ts >= until):
            fails, until = 0, None
        else:
            fails += 1
            if fails >= 5:
                until = ts + datetime.timedelta(minutes=15)
        out.append((fails, fails >= 5, until if fails >= 5 else None))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_lockouts_match_sequential_rules(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for user in range(6):
        now, events = 0, []
        for i in range(60):
            now += rng.choice([30, 120, 600, 901, 5000])
            events.append((at(now), rng.random() < 0.3))
            rows.append((user, at(now), user * 1000 + i, events[-1][1]))
        for i, state in enumerate(login_states(events)):
            want[user * 1000 + i] = state
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, seq long, ok boolean")
    out = lockouts(df).collect()
    assert {r.seq: (r.failed_attempts, r.locked, r.locked_until) for r in out} == want


def test_circuit_steps():
    c = stateful.Circuit()
    row = lambda s, ok: type("R", (), {"us": s * 1_000_000, "seq": 0, "ok": ok})()
    state = c.initial
    for s in (0, 1, 2):
        state, values = c.step(state, row(s, False))
    assert values == (3, True, 240)
    assert c.step(state, row(3, True))[1] == (0, False, 0)
    state, values = c.step(state, row(2 + 241, False))
    assert values == (1, False, 0)


def test_alert_fires_after_unbroken_breach(spark):
    rows = [("r", at(60 * i), i, i not in (0, 4), 120) for i in range(9)]
    df = spark.createDataFrame(rows, "rule string, ts timestamp, seq long, breach boolean, hold int")
    firing = {r.seq: r.firing for r in stateful.alert_hold(df).collect()}
    assert [s for s in firing if firing[s]] and sorted(s for s in firing if firing[s]) == [3, 7, 8]


def test_dedup_keeps_first_flow_and_earliest_tie(spark):
    rows = [
        ("CWE-1", "a", 1, 0.5, 1, "flow-low"),
        ("CWE-1", "a", 1, 0.9, 2, None),
        ("CWE-1", "a", 1, 0.9, 3, "flow-late"),
        (None, "a", 1, 0.1, 4, None),
    ]
    df = spark.createDataFrame(rows, "cwe_id string, file_path string, line_start int, confidence double, seq long, data_flow string")
    out = {r.seq: r.data_flow for r in dedup_findings(df).collect()}
    assert out == {2: "flow-low", 4: None}


def test_enrollment_changes(spark):
    base = spark.createDataFrame([(1, 1, "active"), (1, 2, "dropped")], "class_id long, student_id long, status string")
    changes = spark.createDataFrame(
        [
            (1, 1, "join", at(1), 1),
            (1, 1, "leave", at(2), 2),
            (1, 2, "join", at(3), 3),
            (1, 3, "leave", at(4), 4),
            (1, 4, "leave", at(5), 5),
            (1, 4, "join", at(6), 6),
            (1, 4, "join", at(7), 7),
        ],
        "class_id long, student_id long, action string, ts timestamp, seq long",
    )
    state = {r.student_id: r.status for r in apply_enrollments(base, changes).collect()}
    assert state == {1: "dropped", 2: "active", 4: "active"}
    rejected = {r.seq: r.reason for r in enrollment_rejects(base, changes).collect()}
    assert rejected == {1: "already enrolled", 4: "not enrolled", 5: "not enrolled", 7: "already enrolled"}


def test_a_burst_of_one_key_and_second_spreads(spark):
    rows = spark.range(8000).select(F.lit("hot").alias("k"), F.lit(at(0)).alias("ts"), F.col("id").alias("seq"))
    dealt = in_ranges(rows, ["k"], ["ts", "seq"], 8)
    sizes = [r["count"] for r in dealt.groupBy(RANGE).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2000
    out = running(dealt, ["k"], ["ts", "seq"], RANGE, n=Running("sum", F.lit(1)))
    assert out.where("n <> seq + 1").isEmpty()


def test_line_marks_as_brute_force(spark):
    rng = random.Random(2)
    files = [(s, f"f{i}", "\n".join(f"l{n}" for n in range(rng.choice([1, 2, 7, 64, 100])))) for s in (1, 2) for i in range(4)]
    findings = [
        (i, rng.choice([1, 2]), f"f{rng.randrange(4)}", "high", rng.choice([0, 1, 2, 5, 33, 64, 200]), rng.choice([None, 0, 1, 6, 40, 64, 10**6]))
        for i in range(60)
    ]
    out = annotate_lines(
        spark.createDataFrame(files, "analysis_id long, file_path string, content string"),
        spark.createDataFrame(findings, "finding_id long, analysis_id long, file_path string, severity string, line_start int, line_end int"),
    )
    want = []
    for scan, path, content in files:
        for n, line in enumerate(content.split("\n"), 1):
            own = [i for i, s, p, _, a, b in findings if (s, p) == (scan, path) and a <= n <= max(a, b if b is not None else a)]
            want += [(scan, path, n, line, i) for i in own] or [(scan, path, n, line, None)]
    got = [(r.analysis_id, r.file_path, r.line_no, r.line, r.finding_id) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_wide_finding_moves_few_rows(spark):
    from wardline.operators.joins import dyadic_blocks

    rows = spark.createDataFrame([(2, 999_999)], "a int, b int").select(F.explode(dyadic_blocks("a", "b")).alias("x")).select("x.*").collect()
    assert len(rows) <= 40
    lines = sorted((r.number << r.size, (r.number + 1) << r.size) for r in rows)
    assert lines[0][0] == 2 and lines[-1][1] == 1_000_000 and all(x[1] == y[0] for x, y in zip(lines, lines[1:]))


def test_file_names_match_plain_suffixes(spark):
    files = [(1, "app.js"), (1, "src/app.js"), (2, "app.js"), (1, "index.js")]
    paths = [(1, 1, "web/src/app.js"), (2, 1, "web/xapp.js"), (3, 2, "app.js"), (4, 1, "app.jsx"), (5, 1, "a/index.js"), (6, 3, "app.js")]
    out = file_findings(
        spark.createDataFrame(files, "analysis_id long, file_name string"),
        spark.createDataFrame(paths, "finding_id long, analysis_id long, file_path string"),
    )
    assert sorted((r.finding_id, r.current_file) for r in out.collect()) == [
        (1, "app.js"), (1, "src/app.js"), (2, "app.js"), (3, "app.js"), (5, "index.js"),
    ]
