"""Queries of the operators that compare rows with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, jaccard, quality, substring
from .registry import query

JACCARD_SQL = r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
 g as (select distinct doc_id, list_slice(w, s, s + 4) as t from (select doc_id, w, unnest(range(1, 1 + greatest(len(w) - 4, 1))) as s from d where len(w) > 0)),
 n as (select doc_id, count(*) as n from g group by 1),
 common as (select a.doc_id as x, b.doc_id as y, count(*) as c from g a join g b on a.t = b.t where a.doc_id <> b.doc_id group by 1, 2),
 link as (select x, y from common join n a on x = a.doc_id join n b on y = b.doc_id where 100 * c >= 75 * (a.n + b.n - c)),
 reach as (select doc_id as x, doc_id as y from documents union select r.x, link.y from reach r join link on r.y = link.x)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, r.c as component_id
from d left join n using (doc_id) join (select x, min(y) as c from reach group by 1) r on r.x = d.doc_id"""


@query("op7_jaccard_join", JACCARD_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SETS_SQL = r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
 g as (select distinct doc_id, list_slice(w, s, s + 4) as t from (select doc_id, w, unnest(range(1, 1 + greatest(len(w) - 4, 1))) as s from d where len(w) > 0)),
 n as (select doc_id, count(*) as n from g group by 1),
 common as (select a.doc_id as x, b.doc_id as y, count(*) as c from g a join g b on a.t = b.t where a.doc_id <> b.doc_id group by 1, 2),
 link as (select x, y, c = a.n and c = b.n as same from common join n a on x = a.doc_id join n b on y = b.doc_id where 100 * c >= 75 * (a.n + b.n - c)),
 named as (select n.doc_id, least(n.doc_id, coalesce(min(y) filter (where same), n.doc_id)) as class_id from n left join link on x = n.doc_id group by n.doc_id),
"""
PAIRS_SQL = SETS_SQL + """
 heads as (select doc_id from named where doc_id = class_id)
select x as class_a, y as class_b from link where x < y and x in (select doc_id from heads) and y in (select doc_id from heads)"""
MEMBERS_SQL = SETS_SQL + """
 reach as (select doc_id as x, doc_id as y from documents union select r.x, link.y from reach r join link on r.y = link.x),
 many as (select x, count(*) as m from link group by 1)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, r.c as component_id, coalesce(class_id, d.doc_id) as class_id, cast(coalesce(m, 0) as bigint) as n_links
from d left join n using (doc_id) left join named using (doc_id) left join many on many.x = d.doc_id join (select x, min(y) as c from reach group by 1) r on r.x = d.doc_id"""


@query("op7_jaccard_pairs", PAIRS_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_links(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]


@query("op7_jaccard_members", MEMBERS_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_links(spark.read.parquet(f"{sf_dir}/documents.parquet"))[1]


SUBSTRING_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
 win as (select doc_id, s, hash(list_slice(w, s, s + 34)) as h, list_slice(w, s, s + 34) as t from (select doc_id, w, unnest(range(1, len(w) - 33)) as s from d where len(w) >= 35)),
 twice as (select t from win group by t having count(*) > 1),
 gone as (select distinct doc_id, unnest(range(s, s + 35)) as p from win join twice using (t)),
 words as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d),
 kept as (select words.doc_id, string_agg(x, ' ' order by words.p) filter (where gone.p is null) as k, count(gone.p) as n from words left join gone on gone.doc_id = words.doc_id and gone.p = words.p group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(k, '')) as kept_sha256
from d left join kept using (doc_id)"""


@query("op6_substring_dedup", SUBSTRING_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_nearest")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    forest = ann.fit(vectors)
    if forest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return ann.neighbours(vectors.filter("vec_id % 100 = 0"), vectors, forest)


@query("op8_quality")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 toxic, 1 poor, 2 good. A document is kept that is more likely good than not and likely not toxic."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality is not null and toxic is not null")
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    learned = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).withColumn("grade", grade)
    model = quality.fit(documents, learned, 3)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    rows = quality.grade_texts(documents, model)
    tail = lambda j: F.get("tails", F.lit(j))
    return rows.select(
        "doc_id", held_out.alias("held_out"), F.col("expected_grade"), (1 - tail(0)).alias("p_toxic"), tail(1).alias("p_good"),
        (tail(0) < 0.5).alias("toxic"), (tail(1) >= 0.5).alias("keep"),
    )
