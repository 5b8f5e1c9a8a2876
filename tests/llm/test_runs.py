"""Periodic runs against all periods tried one by one, on words, texts and the query."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import runs
from wardline.llm.queries import QUERIES

from .cases import SF_DIR, documents, table


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def brute(words, least=12):
    """Every run, by comparing the words with themselves at each distance."""
    names = {}
    w = np.array([names.setdefault(x, len(names)) for x in words])
    found = {}
    for q in range(1, len(w) // 2 + 1):
        edges = np.diff(np.concatenate([[0], (w[:-q] == w[q:]).astype(int), [0]]))
        for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)):
            length = int(b - a) + q
            if length >= max(least, 2 * q):
                found.setdefault((int(a), length), q)
    return sorted((a, n, q) for (a, n), q in found.items())


def found(texts, least=12):
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    hashes = np.array([x for t in texts for x in t], np.uint64)
    start, length, period = runs.runs_of(hashes, first, least)
    row = np.searchsorted(first, start, "right") - 1
    out = [[] for _ in texts]
    for i, a, n, q in zip(row, start, length, period):
        out[i].append((int(a - first[i]), int(n), int(q)))
    return out


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def doubled(n):
    return [bin(i).count("1") % 2 for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_runs_as_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(120):
        texts = []
        for _ in range(rng.randint(1, 5)):
            n, letters = rng.randint(0, rng.choice([15, 60, 200])), rng.choice([1, 2, 2, 3])
            t = [rng.randrange(letters) for _ in range(n)]
            if n > 5 and rng.random() < 0.6:
                p, a = rng.randint(1, n // 2), rng.randrange(n)
                t = [t[i] if i < a else t[a + (i - a) % p] for i in range(n)]
            texts.append(t)
        texts += [fibonacci(rng.randint(0, 150)), doubled(rng.randint(0, 150))]
        least = rng.choice([12, 12, 2, 3, 5, 7])
        assert found(texts, least) == [brute(t, least) for t in texts]


def test_long_texts():
    assert found([[7] * 30000]) == [[(0, 30000, 1)]]
    half = list(range(5000))
    assert found([half + half, half]) == [[(0, 10000, 5000)], []]


def test_wavelet_tree():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 100):
        values = rng.permutation(n)
        tree = runs.WaveletTree(values)
        low = rng.integers(0, n, 200)
        high = rng.integers(low, n + 1)
        at = rng.integers(0, n + 1, 200)
        want = [min([v for v in values[a:b] if v >= x], default=n) for a, b, x in zip(low, high, at)]
        assert tree.successor(low, high, at, n).tolist() == want


def collapsed(words, every):
    gone = {i for a, n, q in every for i in range(a + q, a + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


def test_cases(spark):
    docs = documents(spark).withColumns({"runs": F.lit("clash"), "start": F.lit(3)})
    rows = runs.periodic_runs(docs).collect()
    assert len(rows) == docs.count() and rows[0].start == 3
    texts = sorted((words_of(r.text) for r in docs.collect()), key=str)
    got = sorted(([(x.start, x.length, x.period) for x in r.runs], r.collapsed) for r in rows)
    want = sorted((every := brute(w), collapsed(w, every)) for w in texts)
    assert got == want
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_query_as_brute_force(spark):
    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    for r in QUERIES["op12_periodic_runs"](spark, SF_DIR).collect():
        w = words_of(texts[r.doc_id])
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        if n > 4000:
            continue
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        every = brute(w)
        top = max(every, key=lambda x: (x[1], -x[0], -x[2])) if every else (None, None, None)
        text = "".join(f"{a},{n},{q}\n" for a, n, q in every)
        want = (len(every), *top, 1000 * top[1] // top[2] if every else None, hashlib.sha256(text.encode()).hexdigest())
        assert tuple(r[1:7]) == want
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, every).encode()).hexdigest()
