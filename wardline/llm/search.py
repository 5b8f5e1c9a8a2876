"""Ranked lexical search by the Best Position Algorithm over impact-ordered lists.

The queries' terms are counted in every document, which leaves a table of documents with
their postings. Each task reads a part of that table and turns blocks of a bounded number
of postings into lists ordered by impact, the integer that a term adds to a document's
score. A query reads its lists in parallel from the top. Each document met is scored by
direct accesses to all lists, which also tell its positions there, so that a list's best
position, up to which all positions are seen, runs ahead of what was read. No unseen
document can score more than the sum of the impacts behind the best positions; the search
of a block ends when that sum is strictly below the k-th score found so far, so equal
scores are never missed. A task passes on the k best rows of each query, and the k best
of all tasks remain. Statistics are counted over all documents first.

A term is a maximal run of letters, digits and characters beyond ASCII, A-Z lower-cased.
Its impact is ``w * ((1000000000 * tf) div (1000 * tf + 8 * m))`` with
``m = 10 + (90 * n * N) div L`` and ``w = floor(1000 * ln((2N + 2) / (2df + 1)))``: n terms in
the document, N documents with terms, L terms in all, df documents with the term. Terms
are compared by 64-bit hashes.

Queries are taken in blocks of a bounded number of terms (or of one query), and so is what
tasks receive and the driver holds.

Defined cases: a null or empty text has no terms, so such a document is never found and
such a query finds nothing; queries that share an id, or have none, are one query with the
terms of all; each row of documents is a document, so of repeated rows each is found; a
null id comes last among equal scores; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from . import hashing
from .common import shared, slices, text_buffer

#: Terms of the queries that are searched together.
QUERY_TERMS = 1 << 18
#: Documents and postings that a task indexes at once.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 15, 1 << 22
#: Positions of each list that are read at first; each further step reads twice as many.
FIRST_READ = 16
#: Parts of a query's rows that are ranked apart first.
PARTS = 64
NO_ID = np.iinfo(np.int64).max

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, and the first term of each row."""
    starts, ends, first = hashing.spans(data, offsets, SEPARATOR)
    return hashing.word_hashes(hashing.FOLD[data], starts, ends), first


def query_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, term): the distinct terms of each query, as hashes."""
    kind = items.schema[item_id].dataType

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in slices(offsets):
                terms, first = _terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                row = np.repeat(np.arange(a, b), np.diff(first)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(terms.view(np.int64))], names=["item", "term"])

    rows = items.select(F.col(item_id).alias("item"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField("item", kind), T.StructField("term", T.LongType())])).distinct()


POSTINGS = "doc_id long, n long, slots array<int>, tfs array<int>"


def postings(documents: DataFrame, vocabulary, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, slots, tfs): of each document its terms in all, and which of the sorted ``vocabulary`` it holds how often."""

    def run(batches):
        known = vocabulary()
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in slices(offsets):
                terms, first = _terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                slot = np.searchsorted(known, terms)
                held = known[np.minimum(slot, len(known) - 1)] == terms if len(known) else np.zeros(len(terms), bool)
                row = np.repeat(np.arange(b - a), np.diff(first))[held]
                pairs, tf = np.unique(row * max(len(known), 1) + slot[held], return_counts=True)
                row, slot = np.divmod(pairs, max(len(known), 1))
                bounds = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (slot, tf)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first).astype(np.int64)), *lists], names=["doc_id", "n", "slots", "tfs"])

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, POSTINGS)


def document_frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """In how many documents each slot occurs; a task sends at most one row for each slot."""

    def run(batches):
        seen = np.zeros(size, np.int64)
        for batch in batches:
            seen += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        slot = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(seen[slot])], names=["slot", "n"])

    out = np.zeros(size, np.int64)
    for r in rows.select("slots").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[r["slot"]] = r["n"]
    return out


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Block:
    """Impact-ordered lists of some documents, and each document's entries with their places in the lists."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, bounds: np.ndarray, slot: np.ndarray, tf: np.ndarray, weights: np.ndarray, documents: int, terms: int):
        length = 10 + 90 * n * documents // max(terms, 1)
        doc = np.repeat(np.arange(len(ids)), np.diff(bounds))
        tf = tf.astype(np.int64)
        impact = weights[slot] * (1000000000 * tf // (1000 * tf + 8 * length[doc]))
        held = impact > 0  # the others add nothing
        self.ids = ids
        self.slot, self.impact, doc = slot[held], impact[held], doc[held]
        self.bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
        order = np.lexsort((doc, -self.impact, self.slot))
        self.list_doc, self.list_impact = doc[order], np.append(self.impact[order], 0)
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.first = np.searchsorted(self.slot[order], np.arange(len(weights) + 1))
        self.own = np.full(len(weights), -1, np.int64)
        self.met = np.zeros(len(ids), bool)

    def search(self, slots: np.ndarray, best: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """The k best (-score, id) of ``best`` and this block, best first."""
        slots = slots[self.first[slots + 1] > self.first[slots]]
        if not len(slots):
            return best
        begin, size = self.first[slots], self.first[slots + 1] - self.first[slots]
        # a flag for each position of each list, and one behind it that stays unset
        offset = np.concatenate([[0], np.cumsum(size + 1)])
        seen = np.zeros(offset[-1], bool)
        self.own[slots] = np.arange(len(slots))
        position = np.zeros(len(slots), np.int64)  # the first unseen one
        touched, read, step = [], 0, FIRST_READ
        while True:
            low, high = np.maximum(position, np.minimum(read, size)), np.minimum(read + step, size)
            taken = np.maximum(high - low, 0)
            at = np.repeat(begin + low - np.concatenate([[0], np.cumsum(taken)[:-1]]), taken) + np.arange(taken.sum())
            docs = self.list_doc[at]
            docs = np.unique(docs[~self.met[docs]])
            if len(docs):
                self.met[docs] = True
                touched.append(docs)
                score = self.direct(docs, seen, offset, begin)
                if len(best) >= k:
                    good = score >= -best[-1][0]
                    docs, score = docs[good], score[good]
                if len(docs) > k:  # no more than k of them, and those equal to the k-th
                    good = score >= np.partition(score, -k)[-k]
                    docs, score = docs[good], score[good]
                best = sorted([*best, *zip((-score).tolist(), self.ids[docs].tolist())])[:k]
            read, step = read + step, 2 * step
            for j in range(len(slots)):
                position[j] += seen[offset[j] + position[j] : offset[j + 1]].argmin()
            rest = np.where(position < size, self.list_impact[begin + position], 0).sum()
            if rest == 0 or (len(best) >= k and rest < -best[-1][0]):
                break
        for docs in touched:
            self.met[docs] = False
        self.own[slots] = -1
        return best

    def direct(self, docs: np.ndarray, seen: np.ndarray, offset: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The scores of documents by their entries in all lists, whose positions become seen."""
        low, size = self.bounds[docs], self.bounds[docs + 1] - self.bounds[docs]
        ends = np.cumsum(size)
        at = np.repeat(low - (ends - size), size) + np.arange(ends[-1])
        own = self.own[self.slot[at]]
        impact = np.where(own >= 0, self.impact[at], 0)
        at, own = at[own >= 0], own[own >= 0]
        seen[offset[own] + self.place[at] - begin[own]] = True
        sums = np.concatenate([[0], np.cumsum(impact)])
        return sums[ends] - sums[ends - size]


def _blocks(batches) -> Iterator[tuple]:
    """Arrow rows of postings as (ids, n, bounds, slots, tfs) of a bounded number of documents and entries."""
    held, docs, entries = [], 0, 0

    def joined():
        parts = list(zip(*held))
        sizes = np.concatenate(parts[2])
        return (*(np.concatenate(p) for p in parts[:2]), np.concatenate([[0], np.cumsum(sizes)]), *(np.concatenate(p) for p in parts[3:]))

    for batch in batches:
        table = pa.Table.from_batches([batch])
        ids = table["doc_id"].combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)
        slots, tfs = table["slots"].combine_chunks(), table["tfs"].combine_chunks()
        sizes = np.diff(slots.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
        held.append((ids, table["n"].to_numpy(), sizes, slots.flatten().to_numpy(), tfs.flatten().to_numpy()))
        docs, entries = docs + len(ids), entries + int(sizes.sum())
        if docs >= BLOCK_DOCS or entries >= BLOCK_POSTINGS:
            yield joined()
            held, docs, entries = [], 0, 0
    if docs:
        yield joined()


FOUND = "item int, score long, doc_id long"


def _top(rows: DataFrame, k: int) -> DataFrame:
    """(item, rank, score, doc_id) of the k best rows of each item, ranked in parts first."""
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    parts = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(parts)).filter(F.col("rank") <= k)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)


def _searched(documents: DataFrame, terms: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """The k best documents of the queries of one block of (item, term)."""
    spark = documents.sparkSession
    table = terms.toArrow()
    items = table["item"].combine_chunks().dictionary_encode(null_encoding="encode") if table.num_rows else None
    number = items.indices.to_numpy(zero_copy_only=False) if items is not None else np.zeros(0, np.int32)
    vocabulary, slot = np.unique(table["term"].to_numpy().view(np.uint64), return_inverse=True)
    order = np.argsort(number, kind="stable")
    edges = np.searchsorted(number[order], np.arange((number.max() + 1 if len(number) else 0) + 1))
    queries = [slot[order[a:b]] for a, b in zip(edges, edges[1:])]
    rows = cut_lineage(postings(documents, shared(spark, vocabulary), doc_id, text), "postings")
    counted = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    n, total = counted["n"], counted["l"]
    df = document_frequencies(rows, len(vocabulary))
    handle = shared(spark, (queries, np.array([weight(int(x), n) if x else 0 for x in df], np.int64)))

    def run(batches):
        queries, weights = handle()
        best: list[list] = [[] for _ in queries]
        for block in _blocks(batches):
            block = Block(*block, weights, n, total)
            for i, slots in enumerate(queries):
                best[i] = block.search(slots, best[i], k)
        out = [(i, -s, None if d == NO_ID else d) for i, found in enumerate(best) for s, d in found]
        columns = list(zip(*out)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], names=["item", "score", "doc_id"])

    names = spark.createDataFrame(
        list(enumerate(items.dictionary.to_pylist() if items is not None else [])), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", terms.schema["item"].dataType)])
    )
    found = _top(rows.mapInArrow(run, FOUND), k)
    return found.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked(documents: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each query with a score above 0, ties by id."""
    terms = cut_lineage(query_terms(items, item_id, text), "terms")
    blocks = max(1, -(-terms.count() // QUERY_TERMS))
    part = F.pmod(F.xxhash64("item"), F.lit(blocks))
    return reduce(DataFrame.unionByName, (_searched(documents, terms.filter(part == b), k, doc_id, text) for b in range(blocks)))
