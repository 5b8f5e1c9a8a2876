"""Byte-level BPE over whole corpora, with long texts cut into overlapping chunks.

A text of one chunk is encoded where it lies. A longer one becomes chunk rows that
are dealt out over the cluster; each chunk, with the first characters of the next,
is pre-tokenised on its own. Chunk and successor both read the overlap; where their
pre-token boundaries coincide and white space follows a visible character, both
readings go on alike and the text may be cut. Pieces between cuts are encoded
separately and their ids concatenated. A seam without such a place leaves its two
chunks in one piece.

Defined cases: a null text encodes as the empty text; rows equal in id and text are
encoded once if long and each get the result; other columns are kept as they are.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared, text_key, unused

CHUNK_CHARS = 16384
OVERLAP_CHARS = 1024
#: Rows per Arrow batch on the way back, so that ids of long texts don't add up.
BATCH_IDS = 1 << 17

_built: dict[bytes, object] = {}


def default_vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pre-token pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encoder(ranks: bytes, pattern: str):
    """The library's encoder for these ranks, built once for each worker."""
    import tiktoken

    key = hashlib.sha256(ranks).digest() + pattern.encode()
    if key not in _built:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _built[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _built[key]


def token_bytes(ranks: bytes) -> list[bytes]:
    """The bytes of each id; ids without a token have none."""
    table = {int(b): base64.b64decode(a) for a, b in map(bytes.split, ranks.splitlines())}
    return [table.get(i, b"") for i in range(max(table) + 1)]


def seam(text: str, body: int, pattern) -> int | None:
    """Offset behind ``body`` at which this chunk's reading and its successor's first resynchronise, or None."""
    own = {m.start() for m in pattern.finditer(text) if m.start() > body}
    tail = text[body:]
    for m in pattern.finditer(tail):
        at = m.start()
        if at and body + at in own and tail[at].isspace() and not tail[at - 1].isspace():
            return at
    return None


def _chunked(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(_key, n, body, text): chunk ``n`` of each long text, ``body`` characters of its own and the overlap."""

    def cut(batches):
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for n, at in enumerate(range(0, len(text), chunk)):
                    part = text[at : at + chunk + overlap]
                    yield pa.RecordBatch.from_pydict(
                        {"_key": [key], "n": pa.array([n], pa.int32()), "body": pa.array([min(chunk, len(part))], pa.int32()), "text": [part]}
                    )

    rows = long.select("_key", "_text").mapInArrow(cut, "_key string, n int, body int, text string")
    return rows.repartition("_key", "n").dropDuplicates(["_key", "n"])


def _pieces(chunks: DataFrame, pattern: str) -> DataFrame:
    """(_key, piece, text): the texts between cuts."""

    def seams(batches):
        import regex

        compiled = regex.compile(pattern)
        for batch in batches:
            texts, bodies = batch.column(3).to_pylist(), batch.column(2).to_pylist()
            cuts = [seam(t, b, compiled) if len(t) > b else None for t, b in zip(texts, bodies)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cuts, pa.int32())], names=[*batch.schema.names, "cut"])

    rows = chunks.mapInArrow(seams, "_key string, n int, body int, text string, cut int")
    order = Window.partitionBy("_key").orderBy("n")
    rows = rows.withColumn("begin", F.lag("cut").over(order))
    rows = rows.withColumn("piece", F.count("begin").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    begin = F.coalesce("begin", F.lit(0))
    own = F.col("text").substr(begin + 1, F.greatest(F.col("body") + F.coalesce("cut", F.lit(0)) - begin, F.lit(0)))
    parts = F.sort_array(F.collect_list(F.struct("n", own.alias("t"))))
    return rows.groupBy("_key", "piece").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("text"))


def _encoded(df: DataFrame, column: str, vocabulary, pattern: str) -> DataFrame:
    """``df`` with ``ids`` in place of the text ``column``."""
    keep = [f for f in df.schema.fields if f.name != column]
    schema = T.StructType([*keep, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    names = [f.name for f in keep]

    def encode(batches):
        enc = encoder(vocabulary(), pattern)
        for batch in batches:
            start, rows, ids = 0, batch.num_rows, []
            size, texts = 0, batch.column(column)
            for i in range(rows):
                ids.append(enc.encode_ordinary(texts[i].as_py() or ""))
                size += len(ids[-1])
                if size >= BATCH_IDS or i == rows - 1:
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(ids, pa.list_(pa.int32()))], names=[*names, "ids"])
                    start, size, ids = i + 1, 0, []

    return df.mapInArrow(encode, schema)


def encode(
    documents: DataFrame, column: str = "text", path: str | None = None, pattern: str | None = None,
    chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """The documents' rows with ``ids`` (array of int), the tokens of the whole text, in place of the text."""
    if path is None or pattern is None:
        known = default_vocabulary()
        path, pattern = path or known[0], pattern or known[1]
    vocabulary = shared(documents.sparkSession, read_vocabulary(path))
    others = [c for c in documents.columns if c not in (column, "ids")]
    own, key = unused(documents, "own_text", "key")
    rows = documents.select(*others, F.coalesce(column, F.lit("")).alias(own))
    short = _encoded(rows.filter(F.length(own) <= chunk), own, vocabulary, pattern)
    doc_id = others[0] if others else own
    long = rows.filter(F.length(own) > chunk).withColumn(key, text_key(doc_id, own))
    chunks = _chunked(long.select(F.col(key).alias("_key"), F.col(own).alias("_text")), chunk, overlap)
    pieces = _encoded(_pieces(chunks, pattern), "text", vocabulary, pattern)
    whole = pieces.groupBy(F.col("_key").alias(key)).agg(F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("p"))
    whole = whole.select(key, F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
    return short.unionByName(long.drop(own).join(whole, key).drop(key))


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """Rows of ``encode`` with ``ids`` replaced by ``data`` (binary): the tokens' bytes, concatenated."""
    vocabulary = shared(tokens.sparkSession, read_vocabulary(path or default_vocabulary()[0]))
    keep = [f for f in tokens.schema.fields if f.name != "ids"]
    names = [f.name for f in keep]

    def run(batches):
        known = token_bytes(vocabulary()).__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data = [b"".join(map(known, x.as_py() or [])) for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(data, pa.binary())], names=[*names, "data"])

    return tokens.mapInArrow(run, T.StructType([*keep, T.StructField("data", T.BinaryType())]))
