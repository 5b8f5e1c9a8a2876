"""Ranked search against a plain scorer over all documents."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wardline.llm import search

from .cases import documents, table


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k=10):
    """(item, rank, doc, score) by scoring every document."""
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    total = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(terms(t))
    out = []
    for i, q in queries.items():
        scored = []
        for d, c in counted:
            m = 10 + 90 * sum(c.values()) * len(counted) // total
            score = sum(math.floor(1000 * math.log((2 * len(counted) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in q if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, n + 1, d, -s) for n, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def found(docs, items, **kw):
    return sorted(map(tuple, search.ranked(docs, items, **kw).collect()), key=str)


@pytest.mark.parametrize("seed, block", [(1, 1 << 15), (2, 7)])
def test_as_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(search, "BLOCK_DOCS", block)
    monkeypatch.setattr(search, "FIRST_READ", 2)
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(400)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 20])))) for i in range(250)]
    docs += [(1000 + i, docs[i % 3][1]) for i in range(40)]  # many equal scores
    items = [(f"q{i}", " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 12])))) for i in range(25)] + [("q1", "w1 w2"), ("q9", "absent")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert found(d, spark.createDataFrame(items, "item_id string, text string")) == brute(docs, items)
    assert found(d, spark.createDataFrame(items, "item_id string, text string"), k=3) == brute(docs, items, 3)


def test_few_query_terms_at_once(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_TERMS", 40)
    docs, items = table(spark, "documents").limit(60), table(spark, "benchmark").limit(6)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(docs, items) == want


def test_cases(spark):
    docs = documents(spark).withColumns({"n": F.lit("clash"), "slots": F.lit(1), "item": F.lit(2)})
    items = spark.createDataFrame([(1, "The same words"), (2, None), (3, ""), (None, "id worten"), (None, "no"), (1, "geht"), (5, "... --")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(docs, items) == brute(rows, [tuple(r) for r in items.collect()])
    assert found(docs.limit(0), items) == [] and found(docs, items.limit(0)) == []


def test_search_stops_early(spark, monkeypatch):
    """A list is not read to its end once nothing unseen can reach the k best."""
    import numpy as np

    read = []
    plain = search.Block.direct
    monkeypatch.setattr(search.Block, "direct", lambda self, docs, *a: read.append(len(docs)) or plain(self, docs, *a))
    n = 5000
    slot, tf = np.zeros(n, np.int64), np.ones(n, np.int64)
    tf[:10] = 50
    block = search.Block(np.arange(n), np.full(n, 60), np.arange(n + 1), slot, tf, np.array([700]), n, 60 * n)
    best = block.search(np.array([0]), [], 10)
    assert [d for _, d in best] == list(range(10)) and sum(read) < 100
