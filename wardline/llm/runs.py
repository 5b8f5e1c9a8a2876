"""Maximal periodic stretches of words, found by internal pattern matching.

A run is a stretch of words that repeats its first ``period`` words at least twice and
can't be made longer. Every run holds an aligned block of 2**k words that occurs again
one period later, less than 4 * 2**k words on. So for every dyadic block its next
occurrences in that neighbouring window are asked for: the suffix array puts the
occurrences of a block into one interval, and a wavelet tree over the array gives the
next larger position in an interval (a range successor). Occurrences that overlap by
half a block form a progression; of the block's own progression only the difference is
a candidate period, later ones give one candidate for each member. A candidate is
extended to both sides by comparing blocks of halving size, and what is long enough is
a run; of equal stretches the smallest period stays.

Several texts are indexed together, each ended by a word of its own, so no match leaves
its text. A task holds one slice of texts (at least one whole text) at a time: some 100
bytes and 8 bytes a level for each word. Words are compared by 64-bit hashes.

Defined cases: a null text has no words, an empty one neither; rows are judged one by
one, so repeated rows and null ids don't matter; other columns are kept as they are (a
column that has the name of a result is replaced).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .common import slices, text_buffer

LEAST_WORDS = 12


class WaveletTree:
    """Counts below a bound and the r-th smallest value in intervals of an array of 0 to n-1, many queries at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length()) if len(values) else 1
        self.zeros, self.edge = [], []
        for bit in reversed(range(self.bits)):
            one = (values >> bit) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one, dtype=np.int32)]).astype(np.int32))
            self.edge.append(int(self.zeros[-1][-1]))
            values = np.concatenate([values[~one], values[one]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of each interval are smaller than ``bound``."""
        low, high = low.copy(), high.copy()
        count = np.where(bound >= 1 << self.bits, high - low, 0)
        bound = np.minimum(bound, (1 << self.bits) - 1)
        full = count > 0
        for level, bit in enumerate(reversed(range(self.bits))):
            zeros = self.zeros[level]
            a, b = zeros[low], zeros[high]
            one = (bound >> bit) & 1 == 1
            count = count + np.where(one & ~full, b - a, 0)
            low, high = np.where(one, self.edge[level] + low - a, a), np.where(one, self.edge[level] + high - b, b)
        return count

    def smallest(self, low: np.ndarray, high: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The r-th smallest value, from 0; ``r`` is less than the interval's size."""
        low, high, r = low.copy(), high.copy(), r.copy()
        out = np.zeros(len(low), np.int64)
        for level, bit in enumerate(reversed(range(self.bits))):
            zeros = self.zeros[level]
            a, b = zeros[low], zeros[high]
            one = r >= b - a
            out += one.astype(np.int64) << bit
            r = np.where(one, r - (b - a), r)
            low, high = np.where(one, self.edge[level] + low - a, a), np.where(one, self.edge[level] + high - b, b)
        return out

    def successor(self, low: np.ndarray, high: np.ndarray, at: np.ndarray, none: int) -> np.ndarray:
        """The smallest value of each interval that is at least ``at``, or ``none``."""
        r = self.below(low, high, at)
        found = r < high - low
        out = np.full(len(low), none, np.int64)
        out[found] = self.smallest(low[found], high[found], r[found])
        return out


@dataclass
class Index:
    """Suffix array of words, and for each level k the rank of the 2**k words from each position among all such."""

    suffixes: np.ndarray
    ranks: list[np.ndarray]
    sizes: list[np.ndarray]

    @classmethod
    def of(cls, words: np.ndarray, longest: int) -> Index:
        """``words``: ids, texts ended by ids of their own; levels go up to half of the longest text."""
        n = len(words)
        order = np.argsort(words, kind="stable")
        rank = cls.ranked(words[order])
        level = np.empty(n, np.int32)
        level[order] = rank
        ranks, sizes = [level], [cls.spread(level)]
        k = 0
        while True:
            # only positions that share their rank are sorted again, inside the rank's interval
            shared = sizes[-1] > 1
            if not shared.any():
                break
            at = np.flatnonzero(shared[order])
            rows = order[at]
            ahead = rows + (1 << k)
            behind = np.where(ahead < n, level[np.minimum(ahead, n - 1)].astype(np.int64) + 1, 0)
            key = level[rows].astype(np.int64) * (n + 2) + behind
            turn = np.argsort(key, kind="stable")
            order[at] = rows[turn]
            key = key[turn]
            start = np.ones(len(key), bool)
            start[1:] = key[1:] != key[:-1]
            level = level.copy()
            level[rows[turn]] = at[np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))]
            ranks.append(level)
            sizes.append(cls.spread(level))
            k += 1
            if 1 << k > longest:
                break
        return cls(order, ranks, sizes)

    @staticmethod
    def ranked(ordered: np.ndarray) -> np.ndarray:
        start = np.ones(len(ordered), bool)
        start[1:] = ordered[1:] != ordered[:-1]
        return np.maximum.accumulate(np.where(start, np.arange(len(ordered)), 0)).astype(np.int32)

    @staticmethod
    def spread(level: np.ndarray) -> np.ndarray:
        """How many positions have the rank of each position."""
        return np.bincount(level, minlength=len(level)).astype(np.int32)[level]

    def equal_after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` and from ``b`` on are the same."""
        n, size = len(self.suffixes), np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.ranks))):
            level, x, y = self.ranks[k], a + size, b + size
            inside = (x < n) & (y < n)
            same = inside & (level[np.minimum(x, n - 1)] == level[np.minimum(y, n - 1)])
            size += same.astype(np.int64) << k
        return size

    def equal_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before ``a`` and before ``b`` are the same."""
        size = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.ranks))):
            level, x, y = self.ranks[k], a - size - (1 << k), b - size - (1 << k)
            inside = (x >= 0) & (y >= 0)
            same = inside & (level[np.maximum(x, 0)] == level[np.maximum(y, 0)])
            size += same.astype(np.int64) << k
        return size


def candidates(index: Index, tree: WaveletTree, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and shifts: a block and a later occurrence of it less than four of its lengths on.

    All but the last period of a run is half of it at least, so it holds an aligned block of more than a quarter of its words.
    """
    n = len(index.suffixes)
    places, shifts = [], []
    for k in range((-(-least // 2) + 1).bit_length() - 2, len(index.ranks)):
        m = 1 << k
        block = np.arange(0, n - m + 1, m)
        block = block[index.sizes[k][block] > 1]
        low = index.ranks[k][block].astype(np.int64)
        high = low + index.sizes[k][block]
        last = np.minimum(block + 4 * m, n)
        at, own = block.copy(), np.ones(len(block), bool)
        while len(block):
            found = tree.successor(low, high, at + 1, n)
            near = found < last
            block, low, high, last, own, found = (x[near] for x in (block, low, high, last, own, found))
            if not len(block):
                break
            # a block that occurs again within half its length goes on in steps of that difference
            begin = np.where(own, block, found)
            second = np.where(own, found, n)
            later = np.flatnonzero(~own)
            second[later] = tree.successor(low[later], high[later], found[later] + 1, n)
            step = second - begin
            dense = step <= m // 2
            reach = np.zeros(len(block), np.int64)
            reach[dense] = index.equal_after(begin[dense], second[dense])
            members = np.where(dense, (reach + step - m) // np.maximum(step, 1) + 1, 1)
            # the block's own progression has one candidate, its difference
            count = np.where(own, 1, np.minimum(members, -(-(last - begin) // np.maximum(step, 1))))
            count = np.where(dense | own, count, 1)
            row = np.repeat(np.arange(len(block)), count)
            turn = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            places.append(block[row])
            shifts.append(np.where(own[row], found[row], begin[row] + turn * np.where(dense, step, 0)[row]) - block[row])
            at = np.where(dense, begin + (members - 1) * step, np.where(own, found, begin))
            own = np.zeros(len(block), bool)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(shifts)


def runs_of(words: np.ndarray, first: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run of at least ``least`` words in texts whose words begin at ``first``, by start and period.

    Starts count from the first word of all. ``words`` are 64-bit hashes.
    """
    none = np.zeros(0, np.int64)
    texts, sizes = len(first) - 1, np.diff(first)
    if not len(words) or sizes.max() < max(least, 2):
        return none, none, none
    _, ids = np.unique(words, return_inverse=True)
    text = np.repeat(np.arange(texts), sizes)
    spots = np.arange(len(words)) + text  # each text is followed by a word of its own
    joined = np.empty(len(words) + texts, np.int64)
    joined[spots] = ids
    joined[first[1:] + np.arange(texts)] = len(words) + np.arange(texts)
    index = Index.of(joined, int(sizes.max()) // 2)
    place, shift = candidates(index, WaveletTree(index.suffixes), max(least, 2))
    pairs = np.unique(np.stack([place, shift]), axis=1)
    place, shift = pairs
    after = index.equal_after(place, place + shift)
    before = index.equal_before(place, place + shift)
    start, length = place - before, shift + before + after
    long = (length >= 2 * shift) & (length >= least)
    start, length, shift = start[long], length[long], shift[long]
    # of equal stretches the smallest period is the period
    order = np.lexsort((shift, length, start))
    start, length, shift = start[order], length[order], shift[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, shift = start[new], length[new], shift[new]
    order = np.lexsort((shift, start))
    start, length, shift = start[order], length[order], shift[order]
    return start - np.searchsorted(first[1:] + np.arange(texts), start, "left"), length, shift


def collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, kept: np.ndarray) -> list[bytes]:
    """Of each text its kept words, joined by one space."""
    rows = len(first) - 1
    row = np.repeat(np.arange(rows), np.diff(first))[kept]
    starts, ends = starts[kept], ends[kept]
    last = np.ones(len(row), bool)
    last[:-1] = row[1:] != row[:-1]
    sizes = ends - starts + ~last
    total = np.concatenate([[0], np.cumsum(sizes)])
    source = np.arange(total[-1]) + np.repeat(starts - total[:-1], sizes)
    out = data[np.minimum(source, max(len(data) - 1, 0))]
    out[total[1:][~last] - 1] = 0x20
    bounds = total[np.searchsorted(row, np.arange(rows + 1))]
    whole = out.tobytes()
    return [whole[a:b] for a, b in zip(bounds, bounds[1:])]


RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def periodic_runs(documents: DataFrame, text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """The documents' other columns with ``runs`` (start, length, period; by start, then period) and ``collapsed``, the text without repeats.

    A word goes if any run has it behind its first ``period`` words; the others are joined by one space.
    """
    made = ["runs", "collapsed"]
    keep = [f for f in documents.schema.fields if f.name != text and f.name not in made]
    names = [f.name for f in keep]
    kind = pa.struct([(n, pa.int64()) for n in RUN.names])

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(text))
            for a, b in slices(offsets):
                own, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, first = hashing.spans(own, bounds, hashing.WHITE)
                start, length, period = runs_of(hashing.word_hashes(own, starts, ends), first, least)
                cover = np.zeros(len(starts) + 1, np.int64)
                np.add.at(cover, start + period, 1)
                np.add.at(cover, start + length, -1)
                kept = np.cumsum(cover[:-1]) == 0
                row = np.searchsorted(first, start, "right") - 1
                parts = [pa.array(x, pa.int64()) for x in (start - first[row], length, period)]
                found = pa.ListArray.from_arrays(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32), pa.StructArray.from_arrays(parts, fields=list(kind)))
                left = pa.array([x.decode() for x in collapsed(own, starts, ends, first, kept)], pa.string())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), found, left], names=[*names, *made])

    added = [T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]
    return documents.select(*names, F.col(text).cast("string").alias(text)).mapInArrow(run, T.StructType([*keep, *added]))
