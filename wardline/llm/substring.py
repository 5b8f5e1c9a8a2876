"""Removal of word windows that repeat, found by difference-cover anchors.

Residues 0, 1, 4, 14 and 16 modulo 21 hold every difference: whatever the places of
two equal windows, some shift below 21 brings both to cover positions. So two equal
windows of 35 words share an anchor, 15 words that start at a cover position inside
both. Only anchors are hashed at first (5 of 21 positions); an anchor that stands once
in the corpus rules its place out. Windows around the others are extended to full
length, hashed and counted, and the words of windows that stand more than once go.

Each batch of texts sends a hash once, with a mark if the batch itself repeats it, so
that a window that a third of the corpus holds costs no bin more than one entry per
batch; repeats inside a batch are settled there. Anchors that repeat are kept in a
bitmap of fixed size; what passes it wrongly is only counted in vain.

Hashes have 64 bits, so that among w windows about w**2 / 2**65 are taken wrongly for
repeated.

Defined cases: a null text has no words; rows equal in id and text are separate
documents, so each repeats the other; white space around words is not kept; a text of
fewer words than a window stays whole; other columns are kept as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .common import Bitmap, bins_of, by_bin, shared, slices, text_buffer, unused

WINDOW = 35
PERIOD = 21
COVER = (0, 1, 4, 14, 16)
#: Hashes that a task gathers before it sends them.
FLUSH = 1 << 19
IN_COVER = np.isin(np.arange(PERIOD), COVER)


class Words:
    """Word hashes of some texts: row, place and the row's number of words for each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, self.first = hashing.spans(data, offsets, hashing.WHITE)
        self.hashes = hashing.word_hashes(data, starts, ends)
        sizes = np.diff(self.first)
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(len(self.hashes)) - self.first[self.row]
        self.size = sizes[self.row]

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all anchors, and their hashes."""
        length = window - PERIOD + 1
        found = hashing.windows(self.hashes, length)
        at = np.flatnonzero(IN_COVER[self.place % PERIOD] & (self.place + length <= self.size) & (self.size >= window))
        return at, found[at]


def _settled(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, start of each run of equal hashes, and the runs' lengths."""
    order = np.argsort(hashes, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    starts = np.flatnonzero(new)
    return order, starts, np.diff(np.append(starts, len(order)))


def repeated_anchors(documents: DataFrame, window: int, bins: int) -> DataFrame:
    """(hash) of every anchor that stands more than once in the corpus."""

    def send(batches):
        def flush(parts):
            hashes = np.concatenate(parts)
            order, starts, runs = _settled(hashes)
            for b, part in by_bin({"h": hashes[order[starts]], "m": (runs > 1).astype(np.uint8)}, "h", bins):
                yield pa.RecordBatch.from_pydict({"bin": pa.array([b], pa.int32()), "h": [part["h"].tobytes()], "m": [part["m"].tobytes()]})

        parts, gathered = [], 0
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for a, b in slices(offsets):
                parts.append(Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).anchors(window)[1])
                gathered += len(parts[-1])
                if gathered >= FLUSH:
                    yield from flush(parts)
                    parts, gathered = [], 0
        if gathered:
            yield from flush(parts)

    def find(table):
        h = np.frombuffer(b"".join(table["h"].to_pylist()), np.uint64)
        m = np.frombuffer(b"".join(table["m"].to_pylist()), np.uint8)
        order, starts, runs = _settled(h)
        marked = np.add.reduceat(m[order].astype(np.int64), starts) > 0 if len(starts) else np.zeros(0, bool)
        return pa.table({"hash": pa.array(h[order[starts]][(runs > 1) | marked].view(np.int64), pa.int64())})

    rows = documents.select(F.col("text").cast("string")).mapInArrow(send, "bin int, h binary, m binary")
    return rows.groupBy("bin").applyInArrow(find, "hash long")


def repeated_windows(documents: DataFrame, anchors: Bitmap, window: int, bins: int) -> DataFrame:
    """(bin, key, place): packed places of windows that repeat, by bins of the documents' keys.

    ``documents`` have ``_key`` and ``text``. A row of kind 0 asks for hashes, one of
    kind 1 holds places that its batch has settled itself and that only pass through.
    """
    known = shared(documents.sparkSession, anchors)

    def send(batches):
        bitmap = known()
        names = ["bin", "kind", "h", "m", "key", "place"]

        def row(b, kind, h, m, key, place):
            values = [pa.array([b], pa.int32()), pa.array([kind], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (h, m, key, place))]
            return pa.RecordBatch.from_arrays(values, names=names)

        def flush(parts):
            hashes, keys, places = (np.concatenate(x) for x in zip(*parts))
            order, starts, runs = _settled(hashes)
            asked = order[starts]
            marks = (runs > 1).astype(np.uint8)
            for b, p in by_bin({"h": hashes[asked], "m": marks, "key": keys[asked], "place": places[asked]}, "h", bins):
                yield row(b, 0, p["h"], p["m"], p["key"], p["place"])
            again = np.ones(len(order), bool)
            again[starts] = False
            rest = order[again]
            for b, p in by_bin({"key": keys[rest], "place": places[rest]}, "key", bins):
                yield row(b, 1, p["key"][:0], np.zeros(0, np.uint8), p["key"], p["place"])

        parts, gathered = [], 0
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            key = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
            for a, b in slices(offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                at, found = words.anchors(window)
                if not len(at):
                    continue
                hit = np.zeros(len(words.hashes) + 1, np.int32)
                hit[at + 1] = bitmap.holds(found)
                hit = np.cumsum(hit)
                whole = hashing.windows(words.hashes, window, hashing.BASES[2])
                n = len(whole)
                start = np.flatnonzero((hit[PERIOD : n + PERIOD] > hit[:n]) & (words.place[:n] + window <= words.size[:n]))
                parts.append((whole[start], key[a + words.row[start]], words.place[start].astype(np.int32)))
                gathered += len(start)
                if gathered >= FLUSH:
                    yield from flush(parts)
                    parts, gathered = [], 0
        if gathered:
            yield from flush(parts)

    def answer(table):
        def column(kind, name, dtype):
            rows = table.filter(pa.compute.equal(table["kind"], kind))
            return np.frombuffer(b"".join(rows[name].to_pylist()), dtype)

        h, m, key, place = (column(0, c, t) for c, t in (("h", np.uint64), ("m", np.uint8), ("key", np.uint64), ("place", np.int32)))
        order, starts, runs = _settled(h)
        marked = np.add.reduceat(m[order].astype(np.int64), starts) > 0 if len(starts) else np.zeros(0, bool)
        yes = order[np.repeat((runs > 1) | marked, runs)]
        key, place = np.concatenate([key[yes], column(1, "key", np.uint64)]), np.concatenate([place[yes], column(1, "place", np.int32)])
        out = [(b, p["key"].tobytes(), p["place"].tobytes()) for b, p in by_bin({"key": key, "place": place}, "key", bins)]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table({"bin": pa.array(columns[0], pa.int32()), "key": pa.array(columns[1], pa.binary()), "place": pa.array(columns[2], pa.binary())})

    import pyarrow.compute  # noqa: F401  used in tasks

    rows = documents.select("_key", F.col("text").cast("string")).mapInArrow(send, "bin int, kind int, h binary, m binary, key binary, place binary")
    return rows.groupBy("bin").applyInArrow(answer, "bin int, key binary, place binary")


def without_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents' rows with ``kept`` (remaining words, joined by one space), ``n_words`` and ``n_removed``.

    A word goes if some window of ``window`` words that covers it starts at more than one place of the corpus.
    """
    if window < 2 * PERIOD - 1 - (PERIOD - 1):
        raise ValueError(f"a window has at least {PERIOD} words")
    bins = bins_of(documents.sparkSession)
    others = documents.drop("kept", "n_words", "n_removed")
    key_name, bin_name = unused(others, "key", "bin")
    keyed = others.withColumn(key_name, F.xxhash64("doc_id", "text"))
    anchors = Bitmap.of(repeated_anchors(documents, window, bins), "hash")
    places = repeated_windows(keyed.select(F.col(key_name).alias("_key"), "text"), anchors, window, bins)
    # the same bin as by_bin chooses
    keyed = keyed.withColumn(bin_name, F.expr(f"cast(pmod(shiftrightunsigned({key_name}, 20), {bins}) as int)"))
    names = others.columns
    schema = T.StructType(
        [*others.schema.fields, T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    )

    def cut(left, right):
        key = np.frombuffer(b"".join(right["key"].to_pylist()), np.int64)
        place = np.frombuffer(b"".join(right["place"].to_pylist()), np.int32)
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
        kept, total, removed = [], [], []
        for own, text in zip(left[key_name].to_pylist(), left["text"]):
            words = (text.as_py() or "").encode().split()
            a, b = np.searchsorted(key, own, "left"), np.searchsorted(key, own, "right")
            gone = 0
            if b > a:
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, place[a:b], 1)
                np.add.at(edges, place[a:b] + window, -1)
                stays = np.cumsum(edges[:-1]) == 0
                gone = len(words) - int(stays.sum())
                total.append(len(words))
                words = [words[i] for i in np.flatnonzero(stays)]
            else:
                total.append(len(words))
            kept.append(b" ".join(words).decode())
            removed.append(gone)
        columns = [left[n] for n in names]
        return pa.Table.from_arrays(
            [*columns, pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=[*names, "kept", "n_words", "n_removed"]
        )

    return keyed.groupBy(bin_name).cogroup(places.groupBy("bin")).applyInArrow(cut, schema)
