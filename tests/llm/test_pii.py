import re

from pyspark.sql import functions as F

from wardline.llm import pii
from wardline.llm.queries import QUERIES

from .cases import SF_DIR, documents, table

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = []
    for kind, pattern in PLAIN.items():
        found += [(m.start(), pii.KINDS.index(kind), kind, m.end()) for m in re.finditer(pattern, text or "") if valid(kind, m[0])]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def base_spans(spark, rows):
    found = pii.attach_spans(rows, pii.personal_spans(rows)).collect()
    return [((r.doc_id, r.text), [(x.kind, x.start, x.stop) for x in r.found if x.base], [(x.kind, x.start, x.stop) for x in r.found]) for r in found]


def test_base_as_plain_patterns(spark):
    # the plain patterns take quadratic time on the two long runs
    rows = documents(spark).filter("text is null or length(text) not between 30000 and 50000")
    checked = 0
    for (_, text), base, spans in base_spans(spark, rows):
        assert base == brute(text)
        assert set(base) <= set(spans)
        checked += len(base)
    assert checked > 1000


def test_long_runs_end(spark):
    rows = documents(spark).filter("length(text) between 30000 and 50000")
    assert sorted(b for _, b, _ in base_spans(spark, rows)) == [[], [("email", 0, 36002)]]


def test_tables(spark):
    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    found = 0
    for r in QUERIES["op9_personal_data"](spark, SF_DIR).collect():
        base = brute(texts[r.doc_id])
        found += len(base)
        assert [sum(k == kind for k, _, _ in base) for kind in pii.BASE] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
        assert {":".join(map(str, s)) for s in base} <= set(r.spans.split(","))
    assert found


def test_redaction(spark):
    rows = spark.createDataFrame(
        [(1, "write to ann@mail.example.com or +1 (555) 234-5678."), (2, None), (3, "nothing")], "doc_id long, text string"
    )
    out = {r.doc_id: r.text for r in pii.redacted(rows, pii.personal_spans(rows)).collect()}
    assert out == {1: "write to [EMAIL] or [PHONE].", 2: None, 3: "nothing"}


def test_empty_and_extra_columns(spark):
    rows = documents(spark).withColumns({"kind": F.lit("x"), "start": F.lit(1), "key": F.lit("k"), "found": F.lit(0)})
    assert pii.attach_spans(rows, pii.personal_spans(rows)).count() == rows.count()
    none = rows.limit(0)
    assert pii.attach_spans(none, pii.personal_spans(none)).count() == 0
    assert pii.redacted(none, pii.personal_spans(none)).columns == none.columns


def test_patterns_are_told_apart():
    seen = [("phone", (1, 1, 1, 1, 1), 90), ("phone", (-1, 0, -1, -1, -1), 60), ("phone", (-1, 1, 1, 1, 1), 3)]
    _, real = pii.reliabilities(seen)
    assert real["phone", (1, 1, 1, 1, 1)] > 0.9 > 0.1 > real["phone", (-1, 0, -1, -1, -1)]
