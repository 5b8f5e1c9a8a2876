"""Queries of the text operators: formatting, decontamination, encoding, language."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, langid, pii, runs, search
from .registry import query


def digest_tokens(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """Counts and digests of encoded rows: the ids, and the bytes that they decode to."""
    ranks = bpe.shared(tokens.sparkSession, bpe.read_vocabulary(path or bpe.default_vocabulary()[0]))

    def run(batches):
        known = bpe.token_bytes(ranks()).__getitem__
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids.values.to_numpy() if ids.values is not None else []
                ids = list(ids.tolist()) if len(ids) else []
                text = " ".join(map(str, ids)).encode()
                out.append((doc_id, len(ids), hashlib.sha256(text).hexdigest(), hashlib.sha256(b"".join(map(known, ids))).hexdigest()))
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op3_byte_bpe")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest_tokens(bpe.encode(documents))


WORDS_SQL = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

DECONTAM_SQL = f"""
with d as (select doc_id, {WORDS_SQL} as w from documents),
 b as (select cast(item_id as varchar) as item, {WORDS_SQL} as w from benchmark),
 bw as (select item, w, unnest(range(1, 1 + greatest(len(w) - 9, 1))) as s from b where len(w) > 0),
 win as (select distinct item, list_slice(w, s, s + 9) as t from bw),
 sizes as (select distinct len(t) as n from win),
 dw as (select doc_id, n, list_slice(w, s, s + n - 1) as t, s from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, sizes where len(w) >= n)),
 hit as (select dw.doc_id, dw.s, dw.n, win.item from dw join win on dw.t = win.t),
 pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from hit) group by 1),
 its as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as l from hit group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
 sha256(coalesce(l, '')) as items_sha256, n_hit is not null as contaminated
from d left join pos using (doc_id) left join its using (doc_id)"""


@query("op2_decontaminate", DECONTAM_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontam.contamination(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op5_language")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    documents = documents.withColumn("held_out", held_out)
    model = langid.train(documents.filter("not held_out"))
    return langid.identify(documents.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


@query("op9_personal_data")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = pii.attach_spans(documents, pii.personal_spans(documents))
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    base = F.filter("found", lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, pii.BASE), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


def with_periods(documents: DataFrame) -> DataFrame:
    """``documents`` with texts of a tenth of the ids made periodic: from word a on, word i is the word at a + (i - a) % p."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = documents.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    n, g = F.size("w"), F.col("g")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    made = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("w", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    return rows.select("doc_id", F.when(F.coalesce(n, F.lit(0)) > 0, F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs.periodic_runs(with_periods(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    written = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return rows.withColumn("top", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.s")).alias("start"), F.col("top.l").alias("length"), (-F.col("top.p")).alias("period"),
        F.floor(1000 * F.col("top.l") / -F.col("top.p")).alias("exponent_milli"),
        F.sha2(F.array_join(written, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


TERMS_SQL = WORDS_SQL.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")

SEARCH_SQL = f"""
with d as (select doc_id, {TERMS_SQL} as w from documents),
 s as (select count(*) filter (where len(w) > 0) as n, coalesce(cast(sum(len(w)) as bigint), 0) as l from d),
 tf as (select doc_id, t, count(*) as tf from (select doc_id, unnest(w) as t from d) group by 1, 2),
 q as (select distinct item_id, t from (select item_id, unnest({TERMS_SQL}) as t from benchmark)),
 w as (select t, cast(floor(1000 * ln((2 * s.n + 2) / (2 * df + 1))) as bigint) as w from (select t, count(*) as df from tf group by 1), s),
 m as (select doc_id, 10 + (90 * len(w) * s.n) // s.l as m from d, s where len(w) > 0),
 score as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from q join tf using (t) join w using (t) join m using (doc_id) group by 1, 2),
 r as (select *, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank from score where score > 0)
select item_id, rank, doc_id, score from r where rank <= 10"""


@query("op11_ranked_search", SEARCH_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
