import base64
import gzip
import hashlib
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from wardline.llm import chat, warc
from wardline.llm.queries import QUERIES
from wardline.llm.queries_records import Digests

from .cases import SF_DIR, table

NASTY = ["", "plain", "\\", "\\\\<turn>", "</turn>### Assistant:<text>", "####  User:### User:", "a\\</turn> b", "ünï 😀\n\n### Role:"]


def test_escape_round_trip():
    for t in NASTY:
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not any(c in e for c in chat.CONTROL)


def passed_through():
    """A fold that returns each parsed turn."""

    class Rows:
        names = ["conv_id", "seq", "turn", "n_chars", "role", "text", "learned"]
        kinds = [pa.int64()] * 4 + [pa.string()] * 3

        def add(self, row):
            return [row]

        def end(self):
            return []

    return Rows


def test_turns_round_trip(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", "odd <text> role", None) for t in NASTY)]
    rows += [(2, 0, "user", None), (2, 0, "assistant", "same turn"), (None, 0, "system", "no id"), (3, 1, "user", "x" * 50000), (3, 1, "user", "x" * 50000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit("clash"))
    formatted = chat.format_conversations(turns).cache()
    back = chat.read_turns(
        formatted, passed_through(), "conv_id long, seq long, turn long, n_chars long, role string, text string, learned string"
    ).collect()
    want = sorted(((c is None, c or 0), t, r or "", x or "") for c, t, r, x in rows)
    assert sorted(((b.conv_id is None, b.conv_id or 0), b.turn, b.role, b.text) for b in back) == want
    assert all(b.learned == (b.text if b.role == "assistant" else "") for b in back)
    for conv in (1, 2, 3):
        own = formatted.filter(F.col("conv_id") == conv).orderBy("seq").collect()
        assert [r.token_start for r in own] == [sum(len(x.ids) for x in own[:i]) for i in range(len(own))]
        assert [r.char_start for r in own] == [sum(x.n_chars for x in own[:i]) for i in range(len(own))]
        assert all(len(r.ids) == len(r.loss) for r in own)
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_conversation_digests(spark):
    by = {}
    for r in table(spark, "conversations").collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    found = {r.conv_id: r for r in QUERIES["op1_chat_format"](spark, SF_DIR).collect()}
    assert set(found) == {*by, -7}
    for conv, rows in by.items():
        rows.sort()
        learned = "".join(t for _, role, t in rows if role == "assistant")
        assert found[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in rows).encode()).hexdigest()
        assert found[conv].loss_chars == len(learned) and found[conv].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert found[-7].n_turns == 2 and found[-7].loss_chars == len("\\### Assistant: </turn> ok")
    assert Digests().end() == []


PAGES = [
    (1, "http://a", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (9, "http://c", "<p>same</p>"), (3, None, None), (4, "x\r\ny", ""),
    (5, "http://d", "ü" * 5000 + "\r\n\r\nWARC/1.1\r\n"), (None, "http://e", "<p>none</p>"), (None, "http://f", "<p>same</p>"),
    (7, "http://g", "twice"), (7, "http://g", "twice"), (8, "http://h", "y" * 300000), (6, "http://i", "y" * 300000),
]


def brute_pages(rows, least):
    out = []
    groups = {}
    for p, u, h in rows:
        groups.setdefault(h or "", []).append((p is not None, p or 0, u or ""))
    for payload, own in groups.items():
        data = payload.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        best = max((x[0], x[1]) for x in own)
        taken = False
        for has, p, _ in sorted(own):
            response = len(data) < least or ((has, p) == best and not taken)
            taken |= (has, p) == best
            out.append((p if has else None, len(data), digest, "response" if response else "revisit", None if response else (best[1] if best[0] else None)))
    return sorted(map(str, out))


def archived(spark, tmp_path, rows, **kw):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit(1))
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path, **kw)
    return path, warc.read_archives(spark, path).collect()


def test_archives_as_brute_force(spark, tmp_path):
    for n, kw in enumerate(({}, {"least": 12}, {"chunk": 1000, "per_file": 3}, {"chunk": 1000, "per_file": 500})):
        (tmp_path / str(n)).mkdir()
        _, rows = archived(spark, tmp_path / str(n), PAGES, **kw)
        got = sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.kind, r.refers_page)) for r in rows)
        assert got == brute_pages(PAGES, kw.get("least", 0))
        assert all(r.intact for r in rows)


def test_files_are_records(spark, tmp_path):
    path, _ = archived(spark, tmp_path, PAGES, chunk=1000, per_file=50)
    total = b""
    for file in Path(path).glob("*.gz"):
        with gzip.open(file) as f:
            for fields, body in warc.records_of(f):
                assert len(body) <= 4000
                if fields["warc-type"] != "revisit":
                    assert fields["warc-block-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
                total += body
    assert len(total) == sum(len(x.encode()) for x in {h or "" for _, _, h in PAGES})


def test_running_digests(spark):
    pages = spark.createDataFrame([(1, "u", "abcdefghij")], "page_id long, url string, html string")
    rows = warc.chunk_rows(warc.planned(pages), 4).orderBy("chunk").collect()
    want = ["sha1:" + base64.b32encode(hashlib.sha1(b"abcdefghij"[:n]).digest()).decode() for n in (4, 8, 10)]
    assert [r.so_far for r in rows] == want


def test_no_pages(spark, tmp_path):
    assert archived(spark, tmp_path, [])[1] == []


def test_tables(spark):
    rows = [(r.page_id, r.url, r.html) for r in table(spark, "pages").collect()]
    found = QUERIES["op10_warc"](spark, SF_DIR).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in found) == brute_pages(rows, 0)
