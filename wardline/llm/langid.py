"""Language identification of whole texts, word by word.

A model holds log-probabilities of hashed byte n-grams per language and the scripts
each language was seen in. A word's script narrows its candidate languages, its
n-grams score them, and a Viterbi pass with a penalty for switching labels the spans
of a text. The label with most letters wins; its share of the letters is the score.

Training counts all labelled rows in Spark; what comes to the driver is the table of
2**18 counts per language, whatever the corpus. Work runs on Arrow buffers: equal words
of many slices are taken apart once, in training and in scoring.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows
with a null label are not learned from; with no labelled row everything is ``und``;
ties go to the language that sorts first; other columns are kept as they are.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .common import shared, slices, text_buffer

LOG2_GRAMS = 18
ORDERS = (1, 2, 3, 4)
SWITCH = 12.0
#: A script counts as one of a language if it has this share of its letters.
SCRIPT_SHARE = 0.002
GROUP_WORDS = 1 << 20
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: First code points of Unicode script areas (fixed values); code points between two belong to the first.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0x20000, "han"),
)
NAMES = sorted({n for _, n in SCRIPTS})
_FIRST, _SCRIPT = np.array([a for a, _ in SCRIPTS]), np.array([NAMES.index(n) for _, n in SCRIPTS])
#: Words, of slices after each other, whose counts wait to be summed by word; distinct words whose scores a worker remembers.
WAITING_WORDS, KNOWN_WORDS = 1 << 19, 1 << 19


@cache
def alphabet() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


class Words:
    """Some words of a buffer, folded: their letters, scripts and grams."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends = data, starts, ends

    def taken(self, chosen: np.ndarray) -> Words:
        """The chosen words in a buffer of their own, a space behind each."""
        starts, sizes = self.starts[chosen], self.ends[chosen] - self.starts[chosen]
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])
        data = np.full(int(begin[-1]), 0x20, np.uint8)
        ends = begin[1:] - 1
        inner = np.ones(len(data), bool)
        inner[ends] = False
        data[inner] = self.data[np.flatnonzero(inner) + np.repeat(starts - begin[:-1], sizes)]
        return Words(data, begin[:-1], ends)

    def letters(self) -> tuple[np.ndarray, np.ndarray]:
        """Letters and script of each word; runs of bytes above ASCII may hold none."""
        high = np.concatenate([[0], np.cumsum(self.data >= 0x80)])
        letters, script = (self.ends - self.starts).astype(np.int64), np.full(len(self.starts), NAMES.index("latin"))
        odd = np.flatnonzero(high[self.ends] > high[self.starts])
        if len(odd):
            text = np.frombuffer(self.taken(odd).data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
            letter = np.flatnonzero(alphabet()[text])
            word, letter = np.cumsum(text == 0x20)[letter], text[letter]
            letters[odd] = np.bincount(word, minlength=len(odd))
            ascii_letters = np.bincount(word[letter < 0x80], minlength=len(odd))
            first = np.flatnonzero(np.diff(word, prepend=-1))
            first = first[ascii_letters[word[first]] == 0]
            script[odd[word[first]]] = _SCRIPT[np.searchsorted(_FIRST, letter[first], "right") - 1]
        return letters, script

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Gram slots of all words, one after the other, and where each word's begin.

        A word is framed by a byte on each side; all n-grams of the orders count.
        """
        sizes = self.ends - self.starts + 2
        begin = np.concatenate([[0], np.cumsum(sizes)])
        framed = np.zeros(int(begin[-1]), np.uint64)
        inner = np.arange(int(begin[-1])) - np.repeat(begin[:-1], sizes)
        body = (inner > 0) & (inner < np.repeat(sizes, sizes) - 1)
        framed[body] = self.data[(np.repeat(self.starts, sizes) + inner - 1)[body]]
        left = np.repeat(sizes, sizes) - inner  # bytes from here to the word's end
        slots = np.full((len(framed), len(ORDERS)), -1, np.int64)
        value = np.zeros(len(framed), np.uint64)
        for k, order in enumerate(range(1, max(ORDERS) + 1)):
            shifted = np.zeros(len(framed), np.uint64)
            shifted[: len(framed) - k] = framed[k:]
            value = value * np.uint64(257) + shifted + np.uint64(1)
            if order in ORDERS:
                h = hashing.mix(value + np.uint64(order << 40)) >> np.uint64(64 - LOG2_GRAMS)
                slots[:, ORDERS.index(order)] = np.where(left >= order, h.astype(np.int64), -1)
        return slots, begin


class Slice:
    """Distinct words of some rows, by hash, and which word stands where."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, self.first = hashing.spans(data, offsets, ~LETTERS)
        folded = hashing.FOLD[data]
        self.hashes, kept, self.word = np.unique(hashing.word_hashes(folded, starts, ends), return_index=True, return_inverse=True)
        self.words = Words(folded, starts[kept], ends[kept])


class Counter:
    """Grams and letters of scripts, by language; what distinct words of many slices hold is counted once."""

    def __init__(self, languages: int):
        self.total = np.zeros((languages, (1 << LOG2_GRAMS) + len(NAMES)), np.int64)
        self.waiting: list[tuple[np.ndarray, Words, np.ndarray]] = []
        self.size = 0

    def add(self, part: Slice, label: np.ndarray) -> None:
        """Words of a slice whose rows have these labels."""
        languages, words = len(self.total), len(part.hashes)
        key = np.repeat(label, np.diff(part.first)) * words + part.word
        times = np.bincount(key, minlength=languages * words).reshape(languages, words)
        self.waiting.append((part.hashes, part.words.taken(np.arange(words)), times))
        self.size += words + len(self.waiting[-1][1].data) // 16
        if self.size >= WAITING_WORDS:
            self.count()

    def count(self) -> None:
        if not self.waiting:
            return
        hashes, parts, times = zip(*self.waiting)
        self.waiting, self.size = [], 0
        _, kept, word = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        times = np.stack([np.bincount(word, np.concatenate(t), len(kept)).astype(np.int64) for t in zip(*times)])
        shift = np.cumsum([0, *(len(p.data) for p in parts)])
        words = Words(
            np.concatenate([p.data for p in parts]), np.concatenate([p.starts + n for p, n in zip(parts, shift)])[kept],
            np.concatenate([p.ends + n for p, n in zip(parts, shift)])[kept],
        )
        slots = 1 << LOG2_GRAMS
        for low, high in slices(np.concatenate([[0], np.cumsum(words.ends - words.starts)])):
            own, weight = words.taken(np.arange(low, high)), times[:, low:high]
            letters, script = own.letters()
            grams, begin = own.grams()
            of_gram = np.repeat(np.arange(high - low), np.diff(begin) * grams.shape[1])
            grams = grams.ravel()
            for i in np.flatnonzero(weight.any(axis=1)):
                some = np.flatnonzero((weight[i] > 0)[of_gram] & (grams >= 0))
                self.total[i, :slots] += np.bincount(grams[some], weight[i][of_gram[some]], slots).astype(np.int64)
                self.total[i, slots:] += np.bincount(script, weight[i] * letters, len(NAMES)).astype(np.int64)


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        """``counts``: gram slots by language; ``scripts``: letters of each script by language."""
        self.languages = languages
        total = counts.sum(axis=0, keepdims=True)
        logs = np.log((counts + 0.5) / (total + 0.5 * len(counts)))
        # a last row of zeros stands for "no gram"
        self.logs = np.vstack([logs, np.zeros((1, len(languages)))]).astype(np.float32) if languages else None
        share = scripts / np.maximum(scripts.sum(axis=0, keepdims=True), 1)
        self.allowed = share >= SCRIPT_SHARE
        self.allowed[~self.allowed.any(axis=1)] = True
        self.memory = None

    def lookup(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Letters and scores of a slice's distinct words; a word is scored once while it is remembered."""
        if self.memory is None or len(self.memory[0]) > KNOWN_WORDS:
            self.memory = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, max(1, len(self.languages))), np.float32)
        hashes, letters, scores = self.memory
        at = np.searchsorted(hashes, part.hashes)
        new = np.flatnonzero((at == len(hashes)) | (np.append(hashes, np.uint64(0))[at] != part.hashes))
        if len(new):
            own = part.words.taken(new)
            found = own.letters()
            hashes, letters = np.insert(hashes, at[new], part.hashes[new]), np.insert(letters, at[new], found[0])
            scores = np.insert(scores, at[new], self.scores(own, *found), axis=0)
            self.memory = hashes, letters, scores
            at = np.searchsorted(hashes, part.hashes)
        return letters[at], scores[at]

    def scores(self, words: Words, letters: np.ndarray, script: np.ndarray) -> np.ndarray:
        """Mean log-probability over the gram orders, by word and language; zero for words without letters."""
        if not self.languages:
            return np.zeros((len(letters), 1), np.float32)
        slots, begin = words.grams()
        out = np.zeros((len(words.starts), len(self.languages)), np.float32)
        if len(out):
            for k in range(slots.shape[1]):
                out += np.add.reduceat(self.logs[slots[:, k]], begin[:-1], axis=0)
            out /= slots.shape[1]
            out[~self.allowed[script]] -= 4 * SWITCH
            out -= out.max(axis=1, keepdims=True)
            out[letters == 0] = 0
        return out


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best label of each word; ``first`` bounds the words of each text. All texts take each step together."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = first[:-1][order], sizes[order]
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(steps), "left")
    switched = np.zeros(scores.shape, bool)
    source = np.zeros(len(scores), np.int16)
    labels = np.zeros(len(scores), np.int16)
    best = np.zeros((len(sizes), scores.shape[1]), np.float32)
    for t in range(steps):
        n = active[t]
        at = begin[:n] + t
        now = best[:n]
        if t:
            top = now.argmax(axis=1)
            jump = now[np.arange(n), top] - penalty
            switched[at] = now < jump[:, None]
            source[at] = top
            np.maximum(now, jump[:, None], out=now)
        now += scores[at]
    state = best.argmax(axis=1).astype(np.int16)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        labels[at] = state[:n]
        state[:n] = np.where(switched[at, state[:n]], source[at], state[:n])
    return labels


def has_letter(text: str) -> Column:
    """Whether a text holds a letter of any script; a null one doesn't."""
    return F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False))


def train(documents: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts of every labelled row; a word counts for its row's language as often as it stands there."""
    rows = documents.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    languages = [r[0] for r in rows.select(lang).distinct().orderBy(lang).collect()]
    size = (1 << LOG2_GRAMS) + len(NAMES)
    if not languages:
        return Model([], np.zeros((size - len(NAMES), 0)), np.zeros((len(NAMES), 0)))

    def count(batches):
        counter = Counter(len(languages))
        for batch in batches:
            label = np.array([languages.index(x) for x in batch.column(1).to_pylist()], np.int64)
            data, offsets = text_buffer(batch.column(0))
            for a, b in slices(offsets):
                part = Slice(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if len(part.word):
                    counter.add(part, label[a:b])
        counter.count()
        total = counter.total
        step = 1 << 14
        for i in range(len(languages)):
            at = [k for k in range(0, size, step) if total[i, k : k + step].any()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array([total[i, k : k + step].tobytes() for k in at], pa.binary())],
                names=["i", "at", "n"],
            )

    def merge(table):
        n = sum(np.frombuffer(x, np.int64) for x in table["n"].to_pylist())
        return pa.table({"i": table["i"][:1], "at": table["at"][:1], "n": pa.array([n.tobytes()], pa.binary())})

    schema = "i int, at int, n binary"
    counts = np.zeros((len(languages), size), np.int64)
    for r in rows.select(text, lang).mapInArrow(count, schema).groupBy("i", "at").applyInArrow(merge, schema).toLocalIterator():
        part = np.frombuffer(r.n, np.int64)
        counts[r.i, r.at : r.at + len(part)] = part
    return Model(languages, counts[:, : size - len(NAMES)].T, counts[:, size - len(NAMES) :].T)


def identify(documents: DataFrame, model: Model, text: str = "text", penalty: float = SWITCH) -> DataFrame:
    """The documents' rows with ``lang_pred``, ``score`` and ``spans`` (runs of words with one label)."""
    kept = [f for f in documents.schema.fields if f.name not in ("lang_pred", "score", "spans")]
    names = [f.name for f in kept]
    handle = shared(documents.sparkSession, model)
    run = T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.IntegerType())])
    extra = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(run))]
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))

    def label(batches):
        model = handle()
        known = np.array([*model.languages, "und"], object)
        for batch in batches:
            data, offsets = text_buffer(batch.column(names.index(text)))
            for a, b in slices(offsets, 4 * GROUP_WORDS):
                scores, letters, first, at = [], [], [np.zeros(1, np.int64)], 0
                for i, j in slices(offsets[a : b + 1]):
                    low = offsets[a + i]
                    part = Slice(data[low : offsets[a + j]], offsets[a + i : a + j + 1] - low)
                    of_word = model.lookup(part)
                    letters.append(of_word[0][part.word])
                    scores.append(of_word[1][part.word])
                    first.append(part.first[1:] + at)
                    at += len(part.word)
                scores, letters, first = np.concatenate(scores), np.concatenate(letters), np.concatenate(first)
                labels = viterbi(scores, first, penalty)
                rows, width = b - a, max(1, len(model.languages))
                row = np.repeat(np.arange(rows), np.diff(first))
                mass = np.bincount(row * width + labels, letters, rows * width).reshape(rows, width)
                total = mass.sum(axis=1)
                best = np.where((total > 0) & (len(model.languages) > 0), mass.argmax(axis=1), len(model.languages))
                score = np.where(best < len(model.languages), mass.max(axis=1) / np.maximum(total, 1), 0.0)
                change = np.ones(len(labels), bool)
                change[1:] = (labels[1:] != labels[:-1]) | (row[1:] != row[:-1])
                begins = np.flatnonzero(change)
                lengths = np.diff(np.append(begins, len(labels)))
                bounds = np.searchsorted(row[begins], np.arange(rows + 1))
                structs = pa.StructArray.from_arrays([pa.array(known[labels[begins]], pa.string()), pa.array(lengths, pa.int32())], names=["lang", "words"])
                spans = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), structs).cast(span_type)
                part = batch.slice(a, rows)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(known[best], pa.string()), pa.array(score, pa.float64()), spans], names=[*names, "lang_pred", "score", "spans"]
                )

    return documents.select(names).mapInArrow(label, T.StructType([*kept, *extra]))
