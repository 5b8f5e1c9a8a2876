"""WARC archives from a table of pages, and back, through a table of chunks.

A payload becomes rows of (record, chunk number, bytes, digest so far). The first
chunk is a ``response`` record, further ones are ``continuation`` records with segment
numbers, so that no record is larger than a chunk, and Spark's text writer puts them
into gzip files of a bounded number of records. A reader streams a file record by
record and carries the digest from chunk to chunk. Only records that run on into
another file send their chunks to one task, in order.

Among records with equal payloads of at least ``least`` bytes the one with the largest
page_id is the response; the others are ``revisit`` records that name it.

Defined cases: a null html is an empty payload; a null page_id sorts below all others;
of rows equal in page_id and payload the first by url is the response and the others
revisit it; a null url is left out of the record; other columns are not archived; an
empty table writes an archive without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

CHUNK_CHARS = 1 << 16
RECORDS_PER_FILE = 4000
#: Copies of one row that are numbered at once.
COPIES = 4096
DATE = "2020-01-01T00:00:00Z"
END = b"\r\n"


def _record_id(page_id: Column, digest: Column, url: Column, copy: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("~")), digest, copy.cast("string"), F.coalesce(F.concat(F.lit("="), url), F.lit("~"))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts))


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """(record, page_id, url, html, digest, refers): every page with its type decided; ``refers`` is null for responses.

    The decision moves no html: rows equal in id, url and payload are counted, and a payload's
    response is its largest id's first url. Each distinct payload then moves once, to its responses.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    payload = F.encode(html, "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        html.alias("html"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"),
    )
    each = rows.groupBy("digest", "size", "page_id", "url").agg(F.count("*").alias("c"))
    # the largest id, or none; then the first url
    best = F.struct(F.col("page_id").isNull().alias("none"), F.bitwise_not("page_id").alias("down"), F.col("url").alias("first"))
    firsts = each.groupBy("digest", "size").agg(F.min(best).alias("best"))
    start = F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"), F.lit(COPIES).cast("long")))
    each = each.withColumn("start", start)
    each = each.withColumn("copy", F.explode(F.sequence("start", F.least(F.col("c"), F.col("start") + COPIES - 1))))
    decided = each.join(firsts, ["digest", "size"])
    largest = F.when(~F.col("best.none"), F.bitwise_not("best.down"))
    first = F.col("page_id").eqNullSafe(largest) & F.col("url").eqNullSafe(F.col("best.first")) & (F.col("copy") == 1)
    target = _record_id(largest, F.col("digest"), F.col("best.first"), F.lit(1))
    decided = decided.select(
        _record_id(F.col("page_id"), F.col("digest"), F.col("url"), F.col("copy")).alias("record"), "page_id", "url", "digest", "size",
        F.when(~first & (F.col("size") >= least), target).alias("refers"),
    )
    decided = cut_lineage(decided, "decided")
    payloads = rows.groupBy("digest", "size").agg(F.first("html").alias("html"))
    responses = decided.filter("refers is null").join(payloads, ["digest", "size"])
    revisits = decided.filter("refers is not null").withColumn("html", F.lit(None).cast("string"))
    columns = ["record", "page_id", "url", "html", "digest", "refers"]
    return responses.select(columns).unionByName(revisits.select(columns))


def chunk_rows(plan: DataFrame, chunk: int = CHUNK_CHARS) -> DataFrame:
    """(record, chunk, head, body, so_far): chunks in order, with the SHA-1 of the payload up to each one's end."""

    def run(batches):
        def digest(h):
            return "sha1:" + base64.b32encode(h.digest()).decode()

        for batch in batches:
            rows = []
            for record, page_id, url, text, whole, refers in zip(*(batch.column(i) for i in range(6))):
                record, page_id, url, whole, refers = (x.as_py() for x in (record, page_id, url, whole, refers))
                text = text.as_py()
                about = [f"WARC-Record-ID: <{record}>", f"WARC-Date: {DATE}"]
                about += [f"WARC-Target-URI: {' '.join(url.split())}"] if url else []
                about += [f"WARC-Page-ID: {page_id}"] if page_id is not None else []
                about.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(whole)).decode())
                if refers is not None:
                    head = ["WARC-Type: revisit", *about, f"WARC-Refers-To: <{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
                    rows.append((record, 0, "\r\n".join(["WARC/1.1", *head, "Content-Length: 0"]), "", None))
                    continue
                h, sent = hashlib.sha1(), 0
                for n, at in enumerate(range(0, max(1, len(text)), chunk)):
                    body = text[at : at + chunk]
                    data = body.encode()
                    h.update(data)
                    sent += len(data)
                    last = at + chunk >= len(text)
                    head = ["WARC-Type: response" if n == 0 else "WARC-Type: continuation"]
                    if n == 0:
                        head += [*about, "Content-Type: text/html"]
                    else:
                        head += [f"WARC-Record-ID: <{record}-{n}>", f"WARC-Date: {DATE}", f"WARC-Segment-Origin-ID: <{record}>"]
                    if not (n == 0 and last):
                        head.append(f"WARC-Segment-Number: {n + 1}")
                    if n and last:
                        head.append(f"WARC-Segment-Total-Length: {sent}")
                    head += [f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(data).digest()).decode()}", f"Content-Length: {len(data)}"]
                    rows.append((record, n, "\r\n".join(["WARC/1.1", *head]), body, digest(h)))
                    if len(rows) >= 64:
                        yield batch_of(rows)
                        rows = []
            yield batch_of(rows)

    def batch_of(rows):
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
        columns = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["record", "chunk", "head", "body", "so_far"])

    return plan.select("record", "page_id", "url", "html", "digest", "refers").mapInArrow(
        run, "record string, chunk int, head string, body string, so_far string"
    )


def write_archives(pages: DataFrame, path: str, least: int = 0, chunk: int = CHUNK_CHARS, per_file: int = RECORDS_PER_FILE) -> None:
    """Write the pages as gzip WARC files below ``path``; the writer ends each row with the second line end of a record."""
    rows = chunk_rows(planned(pages, least), chunk)
    text = F.concat("head", F.lit("\r\n\r\n"), "body", F.lit("\r\n"))
    rows.select(text.alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def records_of(file) -> object:
    """(fields, payload) of each record of an open file, one at a time."""
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {line[:40]!r}")
        fields = {}
        while (line := file.readline()) not in (END, b""):
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, file.read(int(fields["content-length"]))


SEGMENT = "record string, n int, last boolean, page_id long, kind string, refers string, stated string, size long, digest string, body binary"


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """A row for each whole record without its bytes, and for records over two files a row for each chunk with them."""

    def run(batches):
        kinds = [pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in SEGMENT.split(", ")]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        def done(rows, h):
            """One row for the chunks of a record that starts and ends here."""
            first = rows[0]
            return (first[0], 1, True, *first[3:7], sum(r[7] for r in rows), base64.b32encode(h.digest()).decode(), None)

        for batch in batches:
            for content in batch.column(0):
                out, open_rows, h = [], [], None
                for f, body in records_of(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                    record = f.get("warc-segment-origin-id", f["warc-record-id"]).strip("<>")
                    n = int(f.get("warc-segment-number", 1))
                    last = "warc-segment-number" not in f or "warc-segment-total-length" in f
                    page = int(f["warc-page-id"]) if "warc-page-id" in f else None
                    refers = f["warc-refers-to"].strip("<>") if "warc-refers-to" in f else None
                    stated = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    row = (record, n, last, page, f["warc-type"], refers, stated, len(body), None, body)
                    if n == 1:
                        out += open_rows
                        open_rows, h = [], hashlib.sha1()
                    if h is not None:
                        h.update(body)
                    open_rows.append(row)
                    if last:
                        out += open_rows if h is None else [done(open_rows, h)]
                        open_rows, h = [], None
                    elif len(open_rows) > 64:
                        # a long record: its chunks leave memory and are joined elsewhere
                        out += open_rows
                        open_rows, h = [], None
                    if len(out) >= 64:
                        yield batch_of(out)
                        out = []
                out += open_rows
                if out:
                    yield batch_of(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, SEGMENT)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record, page_id, kind, refers, refers_page, payload_bytes, payload_digest, intact) of every response and revisit.

    ``intact``: the bytes' digest is the stated one. A revisit has the size and digest of the record it names.
    """
    rows = cut_lineage(_segments(spark, path), "segments")

    def join(batches):
        row, h, size = None, None, 0
        for batch in batches:
            out = []
            for n, r in enumerate(batch.to_pylist()):
                if r["n"] == 1:
                    row, h, size = r, hashlib.sha1(), 0
                h.update(r["body"])
                size += r["size"]
                if r["last"]:
                    out.append((row["record"], row["page_id"], row["kind"], row["refers"], row["stated"], size, base64.b32encode(h.digest()).decode()))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["record", "page_id", "kind", "refers", "stated", "size", "digest"])

    schema = "record string, page_id long, kind string, refers string, stated string, size long, digest string"
    names = [x.split()[0] for x in schema.split(", ")]
    split = rows.filter("body is not null").repartition("record").sortWithinPartitions("record", "n").mapInArrow(join, schema)
    whole = cut_lineage(rows.filter("body is null").select(names).unionByName(split), "records")
    found = whole.filter("kind = 'response'").select(
        F.col("record").alias("refers"), F.col("page_id").alias("refers_page"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest")
    )
    responses = whole.filter("kind = 'response'").withColumns(
        {"refers_page": F.lit(None).cast("long"), "payload_bytes": F.col("size"), "payload_digest": F.col("digest")}
    )
    revisits = whole.filter("kind = 'revisit'").join(found, "refers")
    return responses.unionByName(revisits).select(
        "record", "page_id", "kind", "refers", "refers_page", "payload_bytes", "payload_digest", (F.col("stated") == F.col("payload_digest")).alias("intact")
    )
