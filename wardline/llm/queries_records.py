"""Queries of the operators on conversations and pages."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import chat, packing, warc
from .registry import query

EXTRA = (-7, ("user", "assistant"), "\\### Assistant: </turn> ok")


class Digests:
    """Running digests of a conversation's turns and learned texts."""

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def __init__(self):
        self.turns = 0

    def add(self, row):
        conv, seq, _, chars, role, text, learned = row
        out = self.end() if seq == 0 else []
        if seq == 0:
            self.conv, self.turns, self.learned, self.chars = conv, 0, 0, 0
            self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.turns += 1
        self.chars += chars
        self.learned += len(learned)
        self.all.update(f"{role}\n{text}\n".encode())
        self.loss.update(learned.encode())
        return out

    def end(self):
        if not self.turns:
            return []
        return [(self.conv, self.turns, self.all.hexdigest(), self.learned, self.loss.hexdigest(), self.chars)]


CHAT_SQL = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
 e as (select *, length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '<turn>|<text>|</turn>|### (Role|System|User|Assistant):')) as c,
  case role when 'system' then 11 when 'user' then 9 when 'assistant' then 14 else 9 + 6 + length(role) end as h from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
 cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
 cast(sum(6 + h + c + 7) as bigint) as formatted_chars
from e group by 1"""


@query("op1_chat_format", CHAT_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    conv, roles, text = EXTRA
    extra = spark.range(len(roles)).select(
        F.lit(conv).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(*map(F.lit, roles)), F.col("id").cast("int") + 1).alias("role"), F.lit(text).alias("text")
    )
    return chat.read_turns(chat.format_conversations(turns.unionByName(extra)), Digests, Digests.schema)


@query("op10_warc")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    rows = warc.read_archives(spark, path)
    return rows.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers_page").alias("refers_to"), "intact")


@query("op13_best_fit")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return packing.pack(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
