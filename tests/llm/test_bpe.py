import base64

import pytest
import tiktoken

from wardline.llm import bpe
from wardline.llm.queries_text import digest_tokens

from .cases import documents, table


@pytest.fixture(scope="module")
def plain():
    path, pattern = bpe.default_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk, overlap", [(16384, 1024), (50, 20), (7, 3)])
def test_same_ids_as_whole_texts(spark, plain, chunk, overlap):
    rows = documents(spark).filter("text is null or length(text) < 5000") if chunk < 100 else documents(spark)
    got = sorted((r.doc_id is None, r.doc_id, r.ids) for r in bpe.encode(rows.drop("lang"), chunk=chunk, overlap=overlap).collect() if r.doc_id is not None)
    want = sorted((False, r.doc_id, plain.encode_ordinary(r.text or "")) for r in rows.collect() if r.doc_id is not None)
    assert got == want


def test_round_trip(spark):
    rows = documents(spark)
    back = bpe.decode(bpe.encode(rows, chunk=1000, overlap=100)).collect()
    want = sorted(((r.doc_id or -1), (r.text or "").encode()) for r in rows.collect())
    assert sorted(((r.doc_id or -1), bytes(r.data)) for r in back) == want
    assert set(back[0].asDict()) == {"doc_id", "lang", "source", "n_chars", "data"}


def test_tables(spark, plain):
    rows = table(spark, "documents").select("doc_id", "text")
    got = {r.doc_id: r.n_tokens for r in digest_tokens(bpe.encode(rows)).collect()}
    assert got == {r.doc_id: len(plain.encode_ordinary(r.text or "")) for r in rows.collect()}
    assert bpe.encode(rows.limit(0)).count() == 0


def test_extra_columns(spark):
    rows = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, ids long, piece string")
    assert bpe.encode(rows).first().asDict() == {"doc_id": 1, "piece": "x", "ids": [64, 275]}
