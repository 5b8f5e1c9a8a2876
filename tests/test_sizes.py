"""Rows move in bounded pieces, and readings are made once."""

from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from wardline.operators import repair
from wardline.plans import catalog, detection
from wardline.sources import reports
from wardline.streaming import stateful


class _Cell:
    """A value and a list state in one."""

    def __init__(self):
        self.kept = None

    def exists(self):
        return bool(self.kept)

    def get(self):
        return iter(self.kept) if isinstance(self.kept, list) else self.kept

    def update(self, value):
        self.kept = value

    def appendList(self, rows):
        self.kept = [*(self.kept or []), *rows]

    def clear(self):
        self.kept = None


def _handle():
    cells = {}
    return SimpleNamespace(
        getValueState=lambda name, ddl: cells.setdefault(name, _Cell()),
        getListState=lambda name, ddl: cells.setdefault(name, _Cell()),
        registerTimer=lambda at: None,
        cells=cells,
    )


def _logins(n):
    return pd.DataFrame({"user_id": 1, "us": [10**6 * (n - i) for i in range(n)], "seq": range(n), "ok": [i % 7 == 0 for i in range(n)]})


def _stepped(rows):
    steps, state, out = stateful.Lockout(), stateful.Lockout.initial, []
    for row in rows.sort_values("us").itertuples(index=False):
        state, values = steps.step(state, row)
        out.append((row.us, row.seq, values[0]))
    return out


def _seen(frames):
    return [row for f in frames for row in zip(f["us"].tolist(), f["seq"].tolist(), f["failed_attempts"].tolist())]


def test_rows_of_a_hot_key_leave_in_slices():
    steps, rows = stateful.Lockout(), _logins(25_000)
    steps.init(_handle())
    frames = list(steps.handleInputRows((1,), iter([rows[:9000], rows[9000:]]), None))
    assert max(map(len, frames)) <= 10_000
    assert _seen(frames) == _stepped(rows)


def test_waiting_rows_of_a_hot_key_leave_in_slices():
    timed, rows, handle = stateful._Timed(stateful.Lockout(), "us bigint, seq bigint, ok boolean"), _logins(25_000), _handle()
    timed.init(handle)
    list(timed.handleInputRows((1,), iter([rows]), None))
    watermark = SimpleNamespace(getCurrentWatermarkInMs=lambda: 24_000_000)
    frames = list(timed.handleExpiredTimer((1,), watermark, None))
    assert max(map(len, frames)) <= 10_000
    assert _seen(frames) == _stepped(rows)[:24_000]
    assert sorted(handle.cells["waiting"].kept)[0][0] == 24_001 * 10**6 and len(handle.cells["waiting"].kept) == 1000


def test_long_texts_reach_python_in_bounded_batches(spark, tmp_path):
    spark.createDataFrame([(1, "x = 1")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert catalog.QUERIES["s04_expand_archives"](spark, str(tmp_path)).count() == 2

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    texts = spark.range(0, 64, 1, 1).select(F.expr("repeat('x', 1048576)").alias("text"))
    assert max(r.n for r in texts.mapInArrow(sizes, "n long").collect()) < 16 << 20


def test_responses_of_one_file_use_all_cores(spark, tmp_path):
    rows = [(k, "T", 3, "B", "n") for k in range(10)]
    frame = spark.createDataFrame(rows, "p_partkey long, p_type string, p_size int, p_brand string, p_name string")
    frame.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("d07_normalize_raw_findings", "d08_parse_fixes", "d08_parse_explanations"):
        assert catalog.QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_odd_responses_keep_their_outcome(spark):
    texts = [
        None, " ", "no json", "[1]", "{}", '{"findings": [], "summary": 5}', '{"findings": null}', '{"type": "X", "score": 0.5}',
        '{"findings": [{"type": "A", "line": 1.5}, {"type": "B", "line": "7"}]}', '{"findings": [{"vulnerability_type": "C", "severity": 3}]}',
    ]
    raw = spark.createDataFrame(list(enumerate(texts)), "id int, response string")
    got = [(r.id, r.outcome, r.vulnerability_type) for r in repair.normalize_raw_findings(raw).orderBy("id").collect()]
    assert got == [
        (0, "rejected", None), (1, "rejected", None), (2, "fallback", "Unknown"), (3, "rejected", None), (4, "direct", None),
        (5, "rejected", None), (6, "rejected", None), (7, "direct", None), (8, "repaired", "B"), (9, "direct", "C"),
    ]


def test_reports_are_compressed(spark, tmp_path):
    records = spark.createDataFrame([("a", 0, '{"x": 1}'), ("b", 1, '{"y": "\\u00e9"}')], "analysis_id string, part int, record string")
    reports.export_reports(records, f"{tmp_path}/out")
    assert all(p.name.endswith(".json.gz") for p in tmp_path.glob("out/bucket=*/part-*"))
    assert sorted(r.record for r in reports.read_reports(spark, f"{tmp_path}/out").collect()) == sorted(r.record for r in records.collect())


def test_a_flow_record_is_parsed_once(spark):
    flow = '{"source":{"type":"req.body","line":4},"propagation":[{"variable":"a \\"b\\"","line":4,"operation":"source_access"},{"variable":"c","line":5,"operation":"assignment"}],"sink":{"type":"eval","line":9}}'
    found = spark.createDataFrame([("f", "c1", flow), ("f", "c2", '{"sink":{"type":"eval"}}')], "file_id string, call_id string, data_flow string")
    rows = detection._flow_records(found)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and "get_json_object" not in plan
    assert [tuple(r)[1:] for r in rows.orderBy("call_id").collect()] == [("c1", 4, 9, 'a "b"', "c", "source_access"), ("c2", None, None, None, None, None)]


def test_dedup_moves_only_the_columns_asked_for(spark):
    """A wide column that nobody asked for is not part of the shuffled rows; winners and data flows stay the same."""
    from wardline.operators import ranking

    rows = [(1, "f", "CWE-1", 3, 0.5, 2, "flow b", "x"), (1, "f", "CWE-1", 3, 0.9, 3, None, "y"), (1, "f", "CWE-1", 3, 0.9, 4, "flow c", "z"), (2, None, None, None, None, 1, None, "w")]
    df = spark.createDataFrame(rows, "analysis_id int, file_path string, cwe_id string, line_start int, confidence double, seq int, data_flow string, wide string")
    whole = ranking.dedup_findings(df, ("analysis_id",))
    some = ranking.dedup_findings(df, ("analysis_id",), ["seq", "analysis_id", "data_flow"])
    assert whole.columns == df.columns
    assert sorted(map(tuple, some.collect())) == sorted((r.seq, r.analysis_id, r.data_flow) for r in whole.collect()) == [(1, 2, None), (3, 1, "flow b")]
    dealt = lambda df: [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x]
    assert any("wide" in x for x in dealt(whole)) and not any("wide" in x for x in dealt(some))
    assert ranking.dedup_findings(df, ("analysis_id",), ["analysis_id"]).columns == ["analysis_id"]
