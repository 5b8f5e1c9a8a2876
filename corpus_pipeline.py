"""A corpus from raw documents to token digests, in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of
``documents``. Null ids, null texts, repeated rows and empty tables pass through the
operators as their modules define; a stage that joins its decisions back keys rows by
id and text. Columns that ``documents`` doesn't have are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import bpe, decontam, jaccard, langid, pii
from wardline.llm.common import small_batches
from wardline.llm.queries_text import digest_tokens
from wardline.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets ``lang`` to the predicted language. Texts without a letter have none and go; if no row has a label, the others stay as they are."""
    small_batches(spark)
    model = langid.train(docs)
    if not model.languages:
        return docs.filter(langid.has_letter("text")).select(COLUMNS)
    found = langid.identify(docs, model).filter("lang_pred <> 'und'")
    return found.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of similar documents: the smallest id, and of equal ids or none one of the texts."""
    rows = docs.select(COLUMNS).withColumn("_key", jaccard.row_key())
    kept = rows.join(jaccard.representatives(docs).withColumnRenamed("key", "_key"), "_key", "left_semi")
    return kept.dropDuplicates(["_key"]).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("n_hit = 0").select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces spans of personal data by their kind; ``n_chars`` follows the text."""
    return pii.redacted(docs, pii.personal_spans(docs)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the documents that are left."""
    return digest_tokens(bpe.encode(docs.select("doc_id", "text")))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SQL expresses neither the language model nor the merges of the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
