"""Token sequences of a fixed size, filled by vector best fit.

A piece takes three things of a sequence: tokens, one document, and attention cost
(its length squared). All three follow from its length, so the packing is decided on
the histogram of lengths, which has at most as many rows as a sequence has tokens
whatever the corpus holds. Lengths go from large to small; open sequences with the
same residual are one group, and a length goes to the group whose residual it fits
best under every capacity: by the weighted dot product of need and residual over the
residual's squared norm, or by the norm of what would be left. The plan is a list of
segments: the pieces of a length with ranks from a to b fill so many sequences each,
from that sequence and offset on. Pieces get their rank within their length by a
grouped count, with lengths split into parts of a bounded number of rows, so that a
length of many copies is ranked by many tasks.

Texts are encoded by the tokenizers library. A text of characters whose class no
Unicode version changed is cut into the library's pre-tokens first, and each distinct
pre-token is encoded once for a worker; every other text goes to the library whole.

Defined cases: a null or empty text is the end id alone; rows equal in all columns are
separate documents; a null id is kept; an empty table has no pieces; other columns are
kept as they are (a column that has the name of a result is replaced).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .bpe import read_vocabulary
from .common import shared, unused

CAPACITY = 1024
#: Rows of a length that are ranked together.
PART_ROWS = 4096
#: Characters that are encoded at once, up to the next place where a cut changes nothing.
STRETCH = 1 << 16
#: Pre-tokens that a worker remembers, and their characters in all.
CACHE_ENTRIES, CACHE_CHARS = 1 << 19, 1 << 24
#: Bytes of ids in an Arrow batch.
BATCH_BYTES = 1 << 20

#: Letters and numbers whose classes are the same in every Unicode version (Latin, Cyrillic, kana, Han), and the texts
#: made of them, ASCII and usual marks.
LETTER, NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ɏЀ-ҁҊ-ԯぁ-ゖァ-ヺ一-龥", "0-9²³¹¼-¾"
STABLE = re.compile(f"[\t\n\r -~¡-¬®-¿×÷‐-‧‰-⁞、-〃{LETTER}]*")
#: The pre-token pattern of byte_bpe_50k.json over such texts.
PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+")
CUT = re.compile(f"(?<=[!-~{LETTER}])(?=[ \n])")

_built: dict[bytes, PreTokens] = {}


class PreTokens:
    """Ids of pre-tokens as little-endian 32-bit bytes, filled by the tokenizer as texts need them."""

    def __init__(self, vocabulary: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary.decode())
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.known: dict[str, bytes] = {}
        self.size = 0

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Encode pre-tokens in one call: a line feed between two of them is a pre-token of its own."""
        visible = [p for p in pieces if not p.isspace()]
        self.size += sum(map(len, pieces))
        for p in pieces.difference(visible):
            self.known[p] = self.library(p)
        if visible:
            encoded = self.tokenizer.encode("\n".join(visible), add_special_tokens=False)
            word = np.array(encoded.word_ids)
            bounds = np.searchsorted(word, np.arange(0, 2 * len(visible), 2)), np.searchsorted(word, np.arange(1, 2 * len(visible), 2))
            ids = np.array(encoded.ids, "<u4").tobytes()
            for p, a, b in zip(visible, *(4 * x for x in bounds)):
                self.known[p] = ids[a:b]

    def encode(self, text: str) -> bytes:
        out = []
        for part in stretches(text):
            if not STABLE.fullmatch(part):
                out.append(self.library(part))
                continue
            found = PRE_TOKEN.findall(part)
            fresh = set(found).difference(self.known)
            if fresh:
                if len(self.known) + len(fresh) > CACHE_ENTRIES or self.size > CACHE_CHARS:
                    self.known.clear()
                    self.size, fresh = 0, set(found)
                self.learn(fresh)
            out.append(b"".join(map(self.known.__getitem__, found)))
        return b"".join(out)


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """Parts of a text that are encoded apart with the same result: a token never goes on from a visible character to white space."""
    at = 0
    while len(text) - at > size:
        cut = CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(documents: DataFrame, capacity: int = CAPACITY, end_id: int = 2, text: str = "text", path: str | None = None) -> DataFrame:
    """The documents' other columns with ``piece``, ``start``, ``length`` and ``ids`` (binary, 32 bits each, little-endian).

    A document is its text's ids and ``end_id``. One of more than ``capacity`` ids is cut into
    pieces of that length; the first piece has what is left over.
    """
    vocabulary = shared(documents.sparkSession, read_vocabulary(path or default_vocabulary()))
    made = ["piece", "start", "length", "ids"]
    keep = [f for f in documents.schema.fields if f.name != text and f.name not in made]
    names = [f.name for f in keep]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        data = vocabulary()
        key = hashlib.sha256(data).digest()
        if key not in _built:
            _built[key] = PreTokens(data)
        known = _built[key]

        def batch_of(batch, rows, out):
            columns = [batch.column(n).take(pa.array(rows, pa.int32())) for n in names]
            made_kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(c, k) for c, k in zip(zip(*out), made_kinds))], names=[*names, *made])

        for batch in batches:
            rows, out, size = [], [], 0
            for i, value in enumerate(batch.column(text)):
                ids = known.encode(value.as_py() or "") + end
                total = len(ids) // 4
                first = (total - 1) % capacity + 1
                for n, (a, b) in enumerate(zip([0, *range(first, total, capacity)], range(first, total + 1, capacity))):
                    rows.append(i)
                    out.append((n, a, b - a, ids[4 * a : 4 * b]))
                    size += 4 * (b - a)
                    if size >= BATCH_BYTES:
                        yield batch_of(batch, rows, out)
                        rows, out, size = [], [], 0
            if rows:
                yield batch_of(batch, rows, out)

    added = [T.StructField(n, k) for n, k in zip(made, (T.IntegerType(), T.LongType(), T.LongType(), T.BinaryType()))]
    return documents.select(*names, F.col(text).cast("string").alias(text)).mapInArrow(run, T.StructType([*keep, *added]))


@dataclass(frozen=True)
class Limits:
    """What a sequence holds: tokens, documents, and attention cost (the sum of squared lengths); None has no limit."""

    tokens: int = CAPACITY
    documents: int | None = None
    attention: int | None = None

    def capacity(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.float64)

    def longest(self) -> int:
        """Tokens of the longest piece that a sequence can hold."""
        return min(self.tokens, int(np.sqrt(self.attention)) if self.attention else self.tokens)


#: Rules and weights of tokens, documents and attention cost that are tried; the fewest sequences win.
CHOICES = [("norm", (1.0, 0.0, 0.0)), ("dot", (1.0, 0.1, 0.1)), ("norm", (1.0, 0.3, 0.3)), ("dot", (1.0, 0.0, 1.0))]


@dataclass
class Plan:
    """Segments over pieces in the order of length (descending) and rank: their first piece, sequence, offset and pieces a sequence."""

    base: dict[int, int]
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    each: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kinds, place = np.unique(length, return_inverse=True)
        at = np.array([self.base[int(x)] for x in kinds], np.int64)[place] + rank
        k = np.searchsorted(self.first, at, "right") - 1
        turn = at - self.first[k]
        return self.sequence[k] + turn // self.each[k], self.offset[k] + turn % self.each[k] * length


def best_fit(histogram: dict[int, int], limits: Limits, rule: str, weights: tuple[float, float, float]) -> Plan:
    """Pack ``histogram`` (length: pieces) by one rule. Groups are open sequences with equal residuals."""
    capacity = limits.capacity()
    weight = np.array(weights) / capacity**2
    residual, bins, first_bin = np.zeros((0, 3)), np.zeros(0, np.int64), np.zeros(0, np.int64)
    segments, base, begun, opened = [], {}, 0, 0
    for length in sorted(histogram, reverse=True):
        need = np.array([length, 1, length**2], np.float64)
        if length < 1 or (need > capacity).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        left, base[length] = histogram[length], begun
        while left:
            open_ = (residual >= need).all(axis=1)
            if open_.any():
                rows = np.flatnonzero(open_)
                r = residual[rows]
                if rule == "dot":
                    score = (r * need * weight).sum(axis=1) / np.maximum((r * r * weight).sum(axis=1), 1e-300)
                else:
                    score = -((r - need) ** 2 * weight).sum(axis=1)
                g = int(rows[np.argmax(score)])
                room, there, at = residual[g].copy(), int(bins[g]), int(first_bin[g])
            else:
                g, room, there, at = -1, capacity.copy(), left, opened
            each = min(left, int((room // need).min()))
            taken = min(there, left // each)  # sequences that take the same number of this length
            segments.append((begun, at, int(capacity[0] - room[0]), each))
            begun += each * taken
            left -= each * taken
            if g < 0:
                opened += taken
            elif taken == there:
                residual, bins, first_bin = np.delete(residual, g, 0), np.delete(bins, g), np.delete(first_bin, g)
            else:
                bins[g] -= taken
                first_bin[g] += taken
            room = room - each * need
            if room.min() >= 1:
                residual = np.vstack([residual, room])
                bins, first_bin = np.append(bins, taken), np.append(first_bin, at)
    parts = [np.array(c, np.int64) for c in zip(*segments)] or [np.zeros(0, np.int64)] * 4
    return Plan(base, *parts, opened)


def plan(histogram: dict[int, int], limits: Limits = Limits(), choices: list = CHOICES) -> Plan:
    """The plan of fewest sequences among the rules and weights given."""
    return min((best_fit(histogram, limits, *choice) for choice in choices), key=lambda p: p.sequences)


def pack(rows: DataFrame, limits: Limits = Limits(), choices: list = CHOICES) -> DataFrame:
    """``rows`` (any columns and ``length``) with ``sequence_id`` and ``offset``: gapless from 0 in each sequence."""
    names = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    at, part, parts, rank, before = unused(rows, "at", "part", "parts", "rank", "before")
    stored = cut_lineage(rows.select(*names, F.monotonically_increasing_id().alias(at)), "pieces")
    counted = stored.groupBy("length").agg(F.count("*").alias(parts))
    # at most as many rows as a sequence has tokens, so they may be collected and broadcast
    histogram = {r["length"]: r[parts] for r in counted.collect()}
    decided = plan(histogram, limits, choices)
    split = F.broadcast(counted.select("length", F.ceil(F.col(parts) / PART_ROWS).alias(parts)))
    dealt = stored.join(split, "length").withColumn(part, F.pmod(F.xxhash64(at), F.col(parts)))
    sizes = dealt.groupBy("length", part).agg(F.count("*").alias(before))
    lower = F.sum(before).over(Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", part, F.coalesce(lower, F.lit(0)).alias(before))
    inside = F.row_number().over(Window.partitionBy("length", part).orderBy(at))
    ranked = dealt.withColumn(rank, inside).join(sizes, ["length", part]).withColumn(rank, F.col(before) + F.col(rank) - 1)
    handle = shared(rows.sparkSession, decided)
    fields = [stored.schema[n] for n in names]

    def run(batches):
        decided = handle()
        for batch in batches:
            length, turn = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", rank))
            sequence, offset = decided.place(length, turn)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    added = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return ranked.select(*names, rank).mapInArrow(run, T.StructType([*fields, *added]))


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """(sequence_id, ids, starts): the ids of each sequence and where its pieces begin. A group has no more rows than a sequence has tokens."""
    inside = F.sort_array(F.collect_list(F.struct("offset", F.hex(ids).alias("h"))))
    rows = packed.groupBy("sequence_id").agg(inside.alias("p"))
    return rows.select("sequence_id", F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("ids"), F.transform("p", lambda x: x["offset"]).alias("starts"))
