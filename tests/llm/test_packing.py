"""Packing under every capacity, ids against the library, and the query against a plain version."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from wardline.llm import packing
from wardline.llm.packing import Limits
from wardline.llm.queries import QUERIES

from .cases import SF_DIR, documents, table


@pytest.fixture(scope="module")
def known():
    with open(packing.default_vocabulary(), "rb") as file:
        return packing.PreTokens(file.read())


def test_pre_tokens_as_the_library(known):
    pieces = known.tokenizer.pre_tokenizer.pre_tokenize_str
    stable = [c for c in map(chr, range(0x10000)) if packing.STABLE.fullmatch(c)]
    for at in range(0, len(stable), 40):
        for form in ("a{}", "1{}", " {}", "!{}", "\n{}"):
            text = "".join(form.format(c) + x for c in stable[at : at + 40] for x in ("", "a", "1", " ", "!", "\n"))
            assert packing.PRE_TOKEN.findall(text) == [text[a:b] for _, (a, b) in pieces(text)]


def test_ids_as_the_library(known):
    rng = random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "1", "!", "é", "Ж", "漢", "\r\n", "<|endoftext|>", "😀", " ", "\x85", "x" * 9]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        assert known.encode(text) == known.library(text)
        cut = list(packing.stretches(text, 7))
        assert "".join(cut) == text and b"".join(map(known.library, cut)) == known.library(text)


def test_a_full_memory_is_forgotten(known, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 5)
    small = packing.PreTokens(known.tokenizer.to_str().encode())
    for text in ("one two three four five six", "six seven  eight", "one two", "a b c d e f g h"):
        assert small.encode(text) == known.library(text)


def checked(histogram, limits, plan):
    """Every piece placed once, gapless, under every capacity; the sequences' number."""
    lengths = np.repeat(list(histogram), list(histogram.values())).astype(np.int64)
    ranks = np.concatenate([np.arange(n) for n in histogram.values()])
    sequence, offset = plan.place(lengths, ranks)
    held = {}
    for s, o, n in zip(sequence.tolist(), offset.tolist(), lengths.tolist()):
        held.setdefault(s, []).append((o, n))
    for own in held.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= limits.tokens
        assert limits.documents is None or len(own) <= limits.documents
        assert limits.attention is None or sum(n * n for _, n in own) <= limits.attention
    assert sorted(held) == list(range(plan.sequences))
    return plan.sequences


@pytest.mark.parametrize("limits", [Limits(100), Limits(100, 4), Limits(100, None, 6400), Limits(100, 3, 3000), Limits(7, 2, 40)])
def test_plans_hold_every_capacity(limits):
    rng = random.Random(5)
    for _ in range(30):
        histogram = Counter(rng.randint(1, limits.longest()) for _ in range(rng.randint(1, 300)))
        for choice in packing.CHOICES:
            checked(histogram, limits, packing.best_fit(histogram, limits, *choice))
        best = checked(histogram, limits, packing.plan(histogram, limits))
        total = sum(k * n for k, n in histogram.items())
        assert best >= -(-total // limits.tokens)
        if limits.documents is None and limits.attention is None:
            assert best <= 11 / 9 * -(-total // limits.tokens) + 6 / 9 + sum(n for k, n in histogram.items() if 2 * k > limits.tokens)


def test_plan_reaches_known_optima():
    assert packing.plan({60: 10, 40: 10, 50: 20}, Limits(100)).sequences == 20
    assert packing.plan({100: 3, 1: 200}, Limits(100)).sequences == 5
    assert packing.plan({1: 10}, Limits(100, 4)).sequences == 3
    assert packing.plan({}, Limits(100)).sequences == 0
    with pytest.raises(ValueError):
        packing.plan({101: 1}, Limits(100))


def pieces_of(tokenizer, text, capacity=1024):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
    first = (len(ids) - 1) % capacity + 1
    cuts = [0, *range(first, len(ids) + 1, capacity)]
    return [(i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def test_cases(spark, known, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 3)  # many parts of one length
    docs = documents(spark).withColumns({"length": F.lit("clash"), "at": F.lit(1), "part": F.lit(2)}).drop("n_chars")
    packed = packing.pack(packing.pieces(docs.unionByName(docs.filter("doc_id = 3")), capacity=64), Limits(64)).cache()
    rows = packed.collect()
    want = sorted(p[1:] for r in [*docs.collect(), *docs.filter("doc_id = 3").collect()] for p in pieces_of(known.tokenizer, r.text, 64))
    assert sorted((r.start, r["length"], zlib.crc32(r.ids)) for r in rows) == want
    assert all(r["at"] == 1 and r["part"] == 2 for r in rows)
    for s in packing.sequences(packed).collect():
        own = sorted((r.offset, r.ids) for r in rows if r.sequence_id == s.sequence_id)
        assert b"".join(i for _, i in own) == s.ids and len(s.ids) <= 256 and s.starts == [o for o, _ in own]
    assert packing.pack(packing.pieces(docs.limit(0)), Limits(64)).count() == 0


def test_query_as_plain_version(spark, known):
    rows = QUERIES["op13_best_fit"](spark, SF_DIR).collect()
    docs = table(spark, "documents").select("doc_id", "text").collect()
    want = sorted((d.doc_id, *p) for d in docs for p in pieces_of(known.tokenizer, d.text))
    assert sorted((r.doc_id, r.piece, r.start, r["length"], r.ids_crc32) for r in rows) == want
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r["length"]))
    for own in held.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 1024
    assert len(held) <= 1.02 * sum(r["length"] for r in rows) / 1024 + 1


def test_pattern_is_the_public_one():
    public = pytest.importorskip("public_tokenizers")
    for text in ("It's 12 o'clock,  she'll\n\n go!", "Ünïcode — 漢字かな Привет\tмир  "):
        assert packing.PRE_TOKEN.findall(text) == regex.findall(public.PATTERN, text)
        assert re.sub(r"\s", "", text) == re.sub(r"\s", "", "".join(packing.PRE_TOKEN.findall(text)))
