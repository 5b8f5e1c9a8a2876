"""Graded quality by ordinal regression on hashed text.

Grades are ordered; one weight per hashed feature is shared by all of them and ordered
thresholds cut the score: P(grade <= j) = sigmoid(threshold_j - w.x). Features are
the distinct words of a text, folded, their heads, and shares of repeated neighbours,
of shouting and of junk; all are hashed on Arrow buffers. The model is fitted on at
most ``LIMIT`` labelled rows, the smallest by a hash of key and grade, by adaptive gradient
steps on the log of P(grade) = sigmoid(t_grade - w.x) - sigmoid(t_grade-1 - w.x); every row
of the corpus is scored.

Defined cases: a null or empty text has only the feature of its size; rows without a
label or a key are not learned from, and of a repeated key one text is; with fewer than two grades the first is predicted; other
columns are kept as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from . import hashing
from .common import shared, slices, text_buffer

LOG2_FEATURES = 22
LIMIT = 20000
#: A feature of a smaller share of the fitted rows has no weight.
LEAST_SHARE = 0.001
#: Bytes of a word that count as its head.
HEAD = 4
EPOCHS, RATE, DECAY, GROUP = 20, 0.2, 1e-6, 64


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each row, one row after the other, and their bounds."""
    starts, ends, first = hashing.spans(data, offsets, hashing.WHITE)
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    words = hashing.word_hashes(hashing.FOLD[data], starts, ends)
    letters = np.zeros(256, bool)
    letters[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    bare_starts, bare_ends, bare_first = hashing.spans(data, offsets, ~letters)
    bare = hashing.word_hashes(hashing.FOLD[data], bare_starts, bare_ends)
    heads = hashing.word_hashes(hashing.FOLD[data], bare_starts, np.minimum(bare_ends, bare_starts + HEAD), hashing.BASES[1])
    bare_row = np.repeat(np.arange(rows), np.diff(bare_first))
    count = lambda flags, of: np.bincount(of, flags, rows)
    size = np.maximum(np.diff(first), 1)
    capital = (data[starts] >= 0x41) & (data[starts] <= 0x5A) & (ends - starts > 1)
    last = np.minimum(starts + 1, np.maximum(len(data) - 1, 0))
    shout = capital & (data[last] >= 0x41) & (data[last] <= 0x5A)
    tail = data[np.maximum(ends - 1, 0)]
    marked = ~letters[tail] & ~np.isin(tail, list(b".,0123456789"))
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    shares = [count(x, row) / size for x in (shout, marked, again)]
    distinct = np.unique(np.stack([row.astype(np.uint64), words]), axis=1)
    shares.append(1 - np.bincount(distinct[0].astype(np.int64), minlength=rows) / size)
    made = [np.log2(size)]
    made += [np.minimum(np.ceil(s * 20), 20) for s in shares]
    mask = np.uint64((1 << LOG2_FEATURES) - 1)
    all_rows = np.concatenate([bare_row, bare_row, *[np.arange(rows)] * len(made)])
    all_slots = np.concatenate(
        [bare & mask, heads & mask, *[hashing.mix(np.floor(m).astype(np.uint64) + np.uint64((i + 1) << 32)) & mask for i, m in enumerate(made)]]
    )
    order = np.lexsort((all_slots, all_rows))
    all_rows, all_slots = all_rows[order], all_slots[order]
    new = np.ones(len(all_rows), bool)
    new[1:] = (all_rows[1:] != all_rows[:-1]) | (all_slots[1:] != all_slots[:-1])
    all_rows, all_slots = all_rows[new], all_slots[new].astype(np.int64)
    return all_slots, np.searchsorted(all_rows, np.arange(rows + 1))


class Model:
    def __init__(self, grades: int):
        self.weights = np.zeros(1 << LOG2_FEATURES, np.float32)
        self.cuts = np.linspace(-1, 1, max(1, grades - 1))
        self.grades = grades

    def score(self, slots: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[slots], dtype=np.float64)])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold j."""
        if self.grades < 2:
            return np.zeros((len(score), 0))
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts, -30, 30)))


def likelihood(score: np.ndarray, grade: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row log P(grade), its slope in the score, and its slopes in the cuts.

    P(grade) = sigmoid(cut above - score) - sigmoid(cut below - score); the lowest grade has no
    cut below, the highest none above.
    """
    edges = np.concatenate([[-np.inf], cuts, [np.inf]])
    x = np.clip(edges[np.stack([grade, grade + 1])] - score, -40, 40)
    below, above = np.where(grade == 0, 0, 1 / (1 + np.exp(-x[0]))), np.where(grade == len(cuts), 1, 1 / (1 + np.exp(-x[1])))
    share = np.maximum(above - below, 1e-12)
    slopes = np.zeros((len(score), len(cuts) + 2))
    rows = np.arange(len(score))
    slopes[rows, grade] = -below * (1 - below) / share
    slopes[rows, grade + 1] = above * (1 - above) / share
    return np.log(share), above + below - 1, slopes[:, 1:-1]


def train_model(slots: np.ndarray, bounds: np.ndarray, grade: np.ndarray, grades: int, seed: int = 3, least_share: float = LEAST_SHARE) -> Model:
    """Adaptive gradient steps on the cumulative-link log-likelihood of the grades."""
    model = Model(grades)
    if grades < 2 or not len(grade):
        return model
    rng = np.random.default_rng(seed)
    kept = (np.bincount(slots, minlength=len(model.weights)) >= max(1, least_share * len(grade)))[slots]
    bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
    slots = slots[kept]
    # where a text without features stands: the grades' shares
    share = np.clip(np.cumsum(np.bincount(grade, minlength=grades))[:-1] / len(grade), 1e-3, 1 - 1e-3)
    model.cuts = np.maximum.accumulate(np.log(share / (1 - share)))
    seen, seen_cuts = np.full(len(model.weights), 1e-3, np.float32), np.full(grades - 1, 1e-3)
    sizes = np.diff(bounds)
    for _ in range(EPOCHS):
        order = rng.permutation(len(grade))
        for at in range(0, len(order), GROUP):
            rows = order[at : at + GROUP]
            own = np.concatenate([slots[bounds[r] : bounds[r + 1]] for r in rows])
            sums = np.concatenate([[0.0], np.cumsum(model.weights[own], dtype=np.float64)])
            ends = np.cumsum(sizes[rows])
            score = sums[ends] - sums[ends - sizes[rows]]
            _, in_score, in_cuts = likelihood(score, grade[rows], model.cuts)
            touched, place = np.unique(own, return_inverse=True)
            slope = -np.bincount(place, np.repeat(in_score, sizes[rows]), len(touched)) / len(rows)
            slope += DECAY * model.weights[touched]
            seen[touched] += slope**2
            model.weights[touched] -= RATE * slope / np.sqrt(seen[touched])
            slope = -in_cuts.sum(axis=0) / len(rows)
            seen_cuts += slope**2
            model.cuts = np.sort(model.cuts - RATE * slope / np.sqrt(seen_cuts))
    return model


def chosen(labels: DataFrame, grades: int, key: str, grade: str, limit: int) -> DataFrame:
    """At most ``limit`` rows (key, grade), the smallest by a hash of both; only narrow rows near that share are ordered."""
    rows = labels.filter(F.col(key).isNotNull() & F.col(grade).between(0, grades - 1)).select(F.col(key).alias("key"), F.col(grade).cast("int").alias("grade")).distinct()
    rows = rows.withColumn("h", F.xxhash64("key", "grade"))
    count = rows.count()
    if count > limit:  # hashes are even, so a quarter more than the share of the limit holds the limit
        rows = rows.filter(F.shiftrightunsigned("h", 1) <= int(min(1.0, 1.25 * limit / count + 0.001) * (1 << 63)) - 1)
    return rows.orderBy("h", "key", "grade").limit(limit).select("key", "grade")


def fit(documents: DataFrame, labels: DataFrame, grades: int, key: str = "doc_id", text: str = "text", grade: str = "grade", limit: int = LIMIT) -> Model:
    """A model from the documents of at most ``limit`` rows of ``labels`` (key, grade); grades are 0 to ``grades`` - 1.

    The keys are chosen first; features are taken where the texts lie, and only they move.
    """

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for a, b in slices(offsets):
                slots, bounds = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                rows = [slots[bounds[i] : bounds[i + 1]].astype(np.int32).tobytes() for i in range(b - a)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())], names=["key", "grade", "slots"])

    sample = cut_lineage(chosen(labels, grades, key, grade, limit), "sample")  # its size is bounded by the limit
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample), "key")
    kind = T.StructType([sample.schema["key"], T.StructField("grade", T.IntegerType()), T.StructField("slots", T.BinaryType())])
    # of a repeated key one text stays, so that there are never more rows than the limit
    found = rows.select("key", "grade", "text").mapInArrow(run, kind).groupBy("key", "grade").agg(F.min("slots").alias("slots"))
    found = found.orderBy("key", "grade").select("grade", "slots").collect()
    parts = [np.frombuffer(r.slots, np.int32) for r in found]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    slots = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    return train_model(slots, bounds, np.array([r.grade for r in found], np.int64), grades)


def grade_texts(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents' rows with ``expected_grade`` and ``tails``, P(grade > j) for each threshold j."""
    kept = [f for f in documents.schema.fields if f.name not in ("expected_grade", "tails")]
    names = [f.name for f in kept]
    handle = shared(documents.sparkSession, model)

    def run(batches):
        model = handle()
        for batch in batches:
            data, offsets = text_buffer(batch.column(names.index(text)))
            for a, b in slices(offsets):
                tails = model.tails(model.score(*features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(tails.sum(axis=1), pa.float64()), pa.array(list(tails), pa.list_(pa.float64()))],
                    names=[*names, "expected_grade", "tails"],
                )

    extra = [T.StructField("expected_grade", T.DoubleType()), T.StructField("tails", T.ArrayType(T.DoubleType()))]
    return documents.select(names).mapInArrow(run, T.StructType([*kept, *extra]))
