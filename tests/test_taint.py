"""Reachability on random graphs against a set-based closure, and golden flows."""

import json
import random

import pyarrow as pa
import pytest

from wardline.operators import detect, pyfacts, pyflows, taint
from wardline.operators.taint_tables import SANITIZERS
from wardline.plans import catalog, detection

LABELS = (
    "file_id long, node string, source_type string, source_line int, category string, path array<string>, "
    "sanitizers array<struct<name:string,strength:string>>"
)


def closure(edges, starts):
    reached, frontier = set(starts), set(starts)
    while frontier:
        frontier = {
            (f, d) for f, s, d, san in edges if (f, s) in frontier and SANITIZERS.get(san) != "strong"
        } - reached
        reached |= frontier
    return reached


@pytest.mark.parametrize("seed", [3, 4])
def test_reach_equals_closure(spark, seed):
    rng = random.Random(seed)
    names = [f"v{i}" for i in range(9)]
    edges = [
        (f, rng.choice(names), rng.choice(names), rng.choice([None, None, "escapeHtml", "mysql.escape", "helper"]))
        for f in range(12)
        for _ in range(14)
    ]
    starts = {(f, "v0") for f in range(12)}
    edge_df = spark.createDataFrame(edges, "file_id long, src string, dst string, sanitizer string")
    labels = spark.createDataFrame([(f, n, "req.body", 1, "http_request", ["req.body", n], []) for f, n in starts], LABELS)
    out = taint.taint_reach(edge_df, labels).collect()
    assert {(r.file_id, r.node) for r in out} == closure(edges, starts)
    assert len(out) == len({(r.file_id, r.node) for r in out})


def chain(spark, n, sanitizer=None):
    edges = [(1, f"a{i}", f"a{i + 1}", sanitizer if i == 0 else None) for i in range(n)]
    edge_df = spark.createDataFrame(edges, "file_id long, src string, dst string, sanitizer string")
    labels = spark.createDataFrame([(1, "a0", "req.query", 3, "http_request", ["req.query", "a0"], [])], LABELS)
    return edge_df, labels


def test_long_chain_is_followed_to_its_end_and_a_limit_stops_it(spark):
    edges, labels = chain(spark, 13)
    assert taint.taint_reach(edges, labels).count() == 14
    assert taint.taint_reach(edges, labels, max_passes=10).count() == 11


@pytest.mark.parametrize("sanitizer, confidence", [(None, 0.9), ("mysql.escape", 0.75), ("path.resolve", 0.9)])
def test_sanitizers_on_the_way(spark, sanitizer, confidence):
    edges, labels = chain(spark, 1, sanitizer)
    calls = spark.createDataFrame(
        [(1, "c", 9, "db", "query", 1, "identifier", "x", None)],
        "file_id long, call_id string, line int, object string, method string, n_args int, arg0_kind string, arg0_text string, arg1_kind string",
    )
    args = spark.createDataFrame([(1, "c", 0, 0, "a1")], "file_id long, call_id string, arg_index int, position int, node string")
    (row,) = taint.taint_findings(calls, args, taint.taint_reach(edges, labels)).collect()
    assert (row.cwe_id, row.confidence, row.title) == ("CWE-89", confidence, "SQL Injection via req.query")


def test_strong_sanitizer_stops(spark):
    edges, labels = chain(spark, 2, "escapeHtml")
    assert [r.node for r in taint.taint_reach(edges, labels).collect()] == ["a0"]


FLOW_CASES = [
    ("a = request.query.x\nb = 'x' + a.strip()\ndb.query(b)", [("SQL Injection via request.query", 3)]),
    ("a = escape(request.query.x)\nres.send(a)", []),
    ("a = request.query.x\nres.send('x' + escape(a))", []),
    ("a = path.resolve(request.params.p)\nfs.readFile(a)", [("Path Traversal via request.params", 2)]),
    ("eval(request.body.code)", [("Code Injection via request.body", 1)]),
    ("a = request.body\nexecFile('ls', a)\nexecFile(a, 'x')", [("Command Injection via request.body", 2)]),
    ("a = config.value\neval(a)", []),
    ("x = 1\n" + "y = " + " + ".join(["'s'"] * 1500), []),
]


def test_flows_of_python_files(spark):
    rows = [(str(i), f"f{i}", code) for i, (code, _) in enumerate(FLOW_CASES)]
    facts = pyfacts.python_facts(spark.createDataFrame(rows, "file_id string, file_path string, content string")).cache()
    got = {}
    for r in pyflows.python_flows(facts).collect():
        got.setdefault(int(r.file_id), []).append((r.title, r.line_start))
    assert {k: sorted(v) for k, v in got.items()} == {i: want for i, (_, want) in enumerate(FLOW_CASES) if want}
    assert facts.where("kind = 'error'").count() == 0


def plain_reach(edges, starts):
    """Shortest labels level by level, whole paths carried along."""
    live = {}
    for f, s, d, san in edges:
        if SANITIZERS.get(san) != "strong" and s != d:
            live.setdefault((f, s), []).append((d, san if san in SANITIZERS else ""))
    known = {(f, n): (line, " ".join(path), kind, path, ()) for f, n, kind, line, path in starts}
    frontier = dict(known)
    while frontier:
        found = {}
        for (f, s), (line, _, kind, path, used) in frontier.items():
            for d, san in live.get((f, s), ()):
                if (f, d) not in known:
                    way = [*path, d]
                    names = (*used, san) if san else used
                    label = (line, " ".join(way), kind, way, names)
                    old = found.get((f, d))
                    if old is None or (label[:3], " ".join(names)) < (old[:3], " ".join(old[4])):
                        found[f, d] = label
        known |= found
        frontier = found
    return known


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_labels_equal_level_by_level_search(spark, seed):
    rng = random.Random(seed)
    edges, starts = [], []
    for f in range(6):
        names = [f"v{i}" for i in range(rng.choice([5, 12, 30]))]
        for _ in range(len(names)):  # sparse, so that there are chains, rings and dead ends
            edges.append((f, rng.choice(names), rng.choice(names), rng.choice([None, None, "mysql.escape", "path.resolve", "escapeHtml", "helper"])))
        for i in range(0, len(names) - 4, 7):
            edges += [(f, names[j], names[j + 1], rng.choice([None, "mysql.escape"])) for j in range(i, i + 4)]
        for n in rng.sample(names, 2):
            starts.append((f, n, "req.body", rng.randint(1, 2), ["req.body", n]))
    df = spark.createDataFrame(edges, "file_id long, src string, dst string, sanitizer string")
    labels = spark.createDataFrame([(f, n, k, line, "http_request", p, []) for f, n, k, line, p in starts], LABELS)
    want = {key: (line, path, used) for key, (line, _, _, path, used) in plain_reach(edges, starts).items()}
    got = {(r.file_id, r.node): (r.source_line, r.path, tuple(s.name for s in r.sanitizers)) for r in taint.taint_reach(df, labels).collect()}
    assert got == want
    some = taint.labelled(taint.reach(df, labels), spark.createDataFrame([(0, "v1"), (1, "v2")], "file_id long, node string"))
    assert {(r.file_id, r.node) for r in some.collect()} == {k for k in want if k in ((0, "v1"), (1, "v2"))}


def test_chain_of_ten_thousand_steps(spark, monkeypatch):
    passes = []
    plain = taint._extended
    monkeypatch.setattr(taint, "_extended", lambda rows: passes.append(1) or plain(rows))
    edges, labels = chain(spark, 10000)
    edges = edges.union(spark.createDataFrame([(1, "a10000", "z", "mysql.escape"), (1, "a10000", "y", None), (1, "y", "z", None)], edges.schema))
    found = taint.reach(edges, labels)
    assert len(passes) < 20 and found.labels.count() == 10003
    (end,) = taint.labelled(found, spark.createDataFrame([(1, "z")], "file_id long, node string")).collect()
    assert end.path == ["req.query", *(f"a{i}" for i in range(10001)), "z"] and [s.name for s in end.sanitizers] == ["mysql.escape"]


def test_findings_carry_code_and_description(spark):
    edges, labels = chain(spark, 1)
    calls = spark.createDataFrame(
        [(1, "c", 5, "box", "outerHTML", 1, "identifier", "x", None), (1, "d", 6, "db", "query", 1, "identifier", "x", None)],
        "file_id long, call_id string, line int, object string, method string, n_args int, arg0_kind string, arg0_text string, arg1_kind string",
    )
    args = spark.createDataFrame([(1, "c", 0, 0, "a1"), (1, "d", 0, 0, "a1")], "file_id long, call_id string, arg_index int, position int, node string")
    files = spark.createDataFrame([(1, "\n".join(f"line {i}" for i in range(1, 9)))], "file_id long, content string")
    rows = {r.rule: r for r in taint.taint_findings(calls, args, taint.reach(edges, labels), files).collect()}
    assert set(rows) == {"flow:innerHTML", "flow:db.query"}
    assert rows["flow:innerHTML"].description == "innerHTML assignment with user-controlled content"
    assert rows["flow:db.query"].code_snippet == "line 4\nline 5\nline 6\nline 7\nline 8"
    flow = json.loads(rows["flow:db.query"].data_flow)
    assert flow["source"]["code"] == "line 1\nline 2\nline 3\nline 4\nline 5" and flow["sink"]["code"].startswith("line 4")
    assert [s["code"].split("\n")[0] for s in flow["propagation"]] == ["line 1", "line 2", "line 3"]


def test_a_scan_follows_data(spark):
    code = "def f(request, db):\n    name = request.query['id']\n    db.query(name)\n"
    files = spark.createDataFrame([("p1", "a.py", "python", code)], "file_id string, file_path string, language string, content string")
    (row,) = detect.scan_corpus(files).where("rule = 'flow:db.query'").collect()
    assert (row.line_start, row.title, row.stage) == (3, "SQL Injection via request.query", 1)
    assert row.description and "db.query(name)" in row.code_snippet and json.loads(row.data_flow)["propagation"]


def test_small_files_are_searched_without_passes_and_large_ones_agree(spark, monkeypatch):
    """Files of bounded size take no pass over all files, and both ways give the same labels."""
    rng = random.Random(7)
    edges, starts = [], []
    for f in range(40):
        names = [f"v{i}" for i in range(rng.choice([4, 9, 25]))]
        edges += [(f, rng.choice(names), rng.choice(names), rng.choice([None, "mysql.escape", "helper"])) for _ in range(2 * len(names))]
        starts += [(f, n, rng.choice(["req.body", "req.query"]), rng.choice([1, 2, None]), "http_request", ["req", n], []) for n in rng.sample(names, 2)]
    edges += [(None, "a", "b", None), (50, "a", None, None)]
    starts += [(None, "a", "req.body", 1, "http_request", ["req", "a"], []), (50, None, "req.body", 1, "http_request", ["req"], []), (51, "x", "req.body", 1, "c", ["x"], [])]
    df = spark.createDataFrame(edges, "file_id long, src string, dst string, sanitizer string")
    labels = spark.createDataFrame(starts, LABELS)
    passes = []
    plain = taint._extended
    monkeypatch.setattr(taint, "_extended", lambda rows: passes.append(1) or plain(rows))
    for limit, sizes in ((None, (500, 30)), (2, (500, 0))):
        found = []
        for size in sizes:
            monkeypatch.setattr(taint, "SMALL_FILE", size)
            monkeypatch.setattr(taint, "HELD_STEPS", 10)
            passes.clear()
            found.append(sorted(map(str, taint.taint_reach(df.repartition(3), labels, limit).collect())))
            assert bool(passes) == (size < 500)
        assert found[0] == found[1]


def test_small_files_move_once(spark, monkeypatch):
    """Edges and labels of small files go through one shuffle and one table, sizes are told in the search."""
    edges, labels = chain(spark, 5)
    written = []
    plain = taint.cut_lineage
    monkeypatch.setattr(taint, "cut_lineage", lambda df, name="cut", **kw: written.append(name) or plain(df, name, **kw))
    assert taint.taint_reach(edges, labels).count() == 6
    assert written == ["reached"]


def level_search(labels, edges):
    """node -> (row of the source's label, steps): shortest, then line, path as text and kind, nulls first."""
    ahead = {}
    for src, dst, san in edges:
        ahead.setdefault(src, {})[dst] = min(san, ahead.get(src, {}).get(dst, san))
    known, found = {}, {}
    for row, (node, line, path, kind) in enumerate(labels):
        key = None if path is None else " ".join(s for s in path if s is not None)
        order = ((line is not None, line), (key is not None, key), (kind is not None, kind))
        if node not in found or order < found[node][0]:
            found[node] = (order, row, ())
    while found:
        known |= found
        frontier, found = found, {}
        for node, ((line, (_, key), kind), row, steps) in frontier.items():
            for dst, san in ahead.get(node, {}).items():
                order = (line, (True, dst if key is None else f"{key} {dst}"), kind)
                if dst not in known and (dst not in found or order < found[dst][0]):
                    found[dst] = (order, row, (*steps, (dst, san)))
    return {node: (row, steps) for node, (_, row, steps) in known.items()}


@pytest.mark.parametrize("piece", [1, 7, 40, 10**6])
def test_pieces_of_files_are_searched_like_each_file_alone(monkeypatch, piece):
    rng = random.Random(piece)
    paths, lines, kinds = (["b"], ["a", "x"], ["a", None], [None], [], None), (1, 2, None), ("req.body", "req.query", None)
    rows, want, large = [], {}, []
    for f in range(60):
        names = [f"{i}é" for i in range(rng.choice([2, 5, 12]))]
        labels = [(rng.choice([*names, None]), rng.choice(lines), rng.choice(paths), rng.choice(kinds)) for _ in range(rng.choice([0, 1, 4]))]
        edges = [(*rng.sample(names, 2), rng.choice(["", "mysql.escape"])) for _ in range(rng.choice([0, 3, 3 * len(names)]))]
        told = [str((f, line, None if p is None else " ".join(s for s in p if s), k)) for _, line, p, k in labels]  # equal ones are equally good
        mixed = [(f, n, None, None, k, line, told[i], p, []) for i, (n, line, p, k) in enumerate(labels)]
        mixed += [(f, s, d, san, None, None, None, None, None) for s, d, san in edges]
        rng.shuffle(mixed)
        rows += mixed
        if len(mixed) > 25:
            large.append(f)
        else:
            want |= {(f, n): (told[i], steps) for n, (i, steps) in level_search(labels, edges).items()}
    assert large and want
    struct = pa.struct([("name", pa.string()), ("strength", pa.string())])
    fields = [("file_id", pa.int64()), ("node", pa.string()), ("dst", pa.string()), ("sanitizer", pa.string()), ("source_type", pa.string())]
    fields += [("source_line", pa.int32()), ("category", pa.string()), ("path", pa.list_(pa.string())), ("sanitizers", pa.list_(struct))]
    table = pa.table([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])
    monkeypatch.setattr(taint, "PIECE_ROWS", piece)
    got = [r for batch in taint._search(None, 25, 9)(iter(table.to_batches(max_chunksize=6))) for r in batch.to_pylist()]
    assert [r["file_id"] for r in got if r["large"]] == large
    steps = lambda r: tuple((s["node"], s["sanitizer"]) for s in r["trace"])
    reached = [((r["file_id"], r["node"]), (r["category"], steps(r))) for r in got if not r["large"]]
    assert len(reached) == len(want) and dict(reached) == want


def test_only_what_may_name_a_source_meets_the_aliases(spark):
    rows = [(1, "a", "r.body", 1), (1, "a", "r.body", 1), (1, "b", "r.bodyguard", 2), (2, "a", "r.body", 3), (1, "c", "req.body.x", 4), (None, "d", "r.body", 5), (1, "e", None, 6)]
    accesses = spark.createDataFrame(rows, "file_id long, node string, expr string, line int")
    aliases = spark.createDataFrame([(1, "r"), (1, "r"), (None, "r"), (2, "q"), (2, None)], "file_id long, alias string")
    found = taint.match_sources(accesses, aliases)
    assert sorted((r.file_id, r.node, r.line, r.source_type) for r in found.collect()) == [(1, "a", 1, "req.body"), (1, "a", 1, "req.body"), (1, "c", 4, "req.body")]
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "_head" in line]
    assert joins and all("LeftSemi" in line for line in joins)


CALLS = "file_id long, call_id string, line int, object string, method string, n_args int, arg0_kind string, arg0_text string, arg1_kind string"
ARGS = "file_id long, call_id string, arg_index int, position int, node string"


def flow_tables(spark, seed):
    """Edges, labels, calls and arguments of files of many sizes, with rows that come twice and nulls."""
    rng = random.Random(seed)
    edges, starts, calls, args = [], [], [], []
    for f in [*range(100), None]:
        names = [f"v{i}é" for i in range(rng.choice([3, 8, 20]))]
        edges += [(f, rng.choice(names), rng.choice([*names, None]), rng.choice([None, "mysql.escape", "escapeHtml", "helper"])) for _ in range(2 * len(names))]
        for n in rng.sample([*names, None], rng.choice([0, 2, 3])):
            done = rng.choice([[], [("mysql.escape", "weak")], None])
            starts.append((f, n, rng.choice(["req.body", "req.query"]), rng.choice([1, 2, None]), rng.choice(["http_request", None]), ["req", n], done))
        for c in range(rng.choice([0, 2, 12])):
            method = rng.choice(["eval", "eval", "execFile", "Function", "print"])
            call = (f, rng.choice([*[f"c{c}"] * 5, None]), rng.choice([c, None]), rng.choice(["box", None]), method, rng.randint(1, 3), "identifier", "x", None)
            calls += [call] * rng.choice([1, 1, 2])
            args += [(f, call[1], rng.choice([0, 0, 1, 2, None]), rng.choice([0, 1, None]), rng.choice([*names, None])) for _ in range(rng.choice([2, 4, 6]))]
    args += args[::4]
    rows = ((edges, "file_id long, src string, dst string, sanitizer string"), (starts, LABELS), (calls, CALLS), (args, ARGS))
    return [spark.createDataFrame(r, ddl).repartition(3) for r, ddl in rows]


@pytest.mark.parametrize("limit, most", [(None, 2000), (None, 40), (1, 2000), (None, 0)])
def test_findings_of_the_search_equal_those_of_joins(spark, monkeypatch, limit, most):
    """One search for flows finds what labels, calls and arguments joined find, and so do files too large for it."""
    monkeypatch.setattr(taint, "SMALL_FLOWS", most)
    monkeypatch.setattr(taint, "HELD_STEPS", 10)
    edges, labels, calls, args = flow_tables(spark, 11)
    joined = taint.taint_findings(calls, args, taint.taint_reach(edges, labels, limit))
    searched = taint.taint_findings(calls, args, taint.reach(edges, labels, limit))
    assert searched.schema.simpleString() == joined.schema.simpleString()
    want = sorted(map(str, joined.collect()))
    assert len(want) > 20 and sorted(map(str, searched.collect())) == want


@pytest.mark.parametrize("piece", [1, 9, 60])
def test_flows_do_not_depend_on_pieces(spark, monkeypatch, piece):
    edges, labels, calls, args = flow_tables(spark, 12)
    narrow = taint.match_sinks(calls).selectExpr("file_id", "greatest(taint_arg, 0) as arg_index", *taint.CALL)
    table = taint._flow_rows(taint._passing(edges), taint._known(labels), narrow, args).sort("file_id").toArrow()
    found = lambda size: [r for b in taint._search(None, 60, 9, True)(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
    whole = found(10**6)
    monkeypatch.setattr(taint, "PIECE_ROWS", piece)
    assert sum(r["large"] for r in whole) and sum(not r["large"] for r in whole) > 20
    assert sorted(map(str, found(5))) == sorted(map(str, whole))


def test_calls_and_arguments_move_once(spark, monkeypatch):
    """Findings of small files take one shuffle by file and one table; nothing is shuffled for them afterwards."""
    edges, labels = chain(spark, 3)
    calls = spark.createDataFrame([(1, c, 9, "db", "query", 1, "identifier", "x", None) for c in "cd"], CALLS)
    args = spark.createDataFrame([(1, c, 0, p, n) for c in "cd" for p, n in ((0, "q"), (1, "a3"), (2, "a1"), (1, "a3"))], ARGS)
    written = []
    plain = taint.cut_lineage
    monkeypatch.setattr(taint, "cut_lineage", lambda df, name="cut", **kw: written.append((name, df)) or plain(df, name, **kw))
    findings = taint.taint_findings(calls, args, taint.reach(edges, labels))
    assert [r.path[-1] for r in findings.collect()] == ["a3", "a3"]
    ((name, flows),) = written
    assert name == "flows" and flows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 1
    assert "Exchange hashpartitioning(" not in findings._jdf.queryExecution().executedPlan().toString()


def test_a_chain_is_searched_in_few_passes_when_it_is_read(spark, monkeypatch):
    passes = []
    plain = taint._extended
    monkeypatch.setattr(taint, "_extended", lambda rows: passes.append(1) or plain(rows))
    edges, labels = chain(spark, 3000)
    found = taint.reach(edges, labels)
    assert found.labels.count() == 3001 and 0 < len(passes) < 20
    done = len(passes)
    assert found.chains is not None and found.labels.count() == 3001 and len(passes) == done


@pytest.mark.parametrize("name", ["d06d_flow_records", "d06_taint_findings"])
def test_flow_queries_write_calls_and_flows_only(spark, tmp_path, monkeypatch, name):
    """Of the facts only calls are stored before the one search, whose result is not shuffled again."""
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"
    # n6 is read from req.query; eval of n0 behind it, eval of n5 out of reach, and a row that comes twice
    rows = [(1, 6, 0, 1, 5.0, 1.25), (1, 6, 0, 1, 5.0, 1.25), (1, 15, 13, 2, 9.0, 2.5), (3, 24, 5, 1, 7.0, 3.0), (None, 6, 0, 1, 5.0, 4.0)]
    spark.createDataFrame(rows, line).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1,), (3,)], "o_orderkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    written = []
    for module in (taint, detection):
        plain = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df, name="cut", plain=plain, **kw: written.append(name) or plain(df, name, **kw))
    found = catalog.QUERIES[name](spark, str(tmp_path))
    (row,) = found.collect()
    assert written == ["facts", "flows"] and "Exchange hashpartitioning(" not in found._jdf.queryExecution().executedPlan().toString()
    if name == "d06d_flow_records":
        assert row[:] == (1, "6-0-1-125", 5, 15, "req.query.id", "n0", "source_access")
    else:
        assert row[:] == (1, "6-0-1-125", "Code Injection via req.query", "critical", 15, 0.9, "req.query.id n6 n0")
