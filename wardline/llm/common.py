"""Helpers that several operators share: keys, Arrow text buffers, bounded bitmaps, packed rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Workers stay alive between tasks; the system's allocator gives freed buffers back, those of
# a megabyte and more at once (option -3 is the GNU library's M_MMAP_THRESHOLD).
pa.set_memory_pool(pa.system_memory_pool())
if hasattr(LIBC := ctypes.CDLL(None), "mallopt"):
    LIBC.mallopt(-3, 1 << 20)

#: Rows of text per Arrow batch.
BATCH_ROWS = 1000
#: Bytes of text that a task turns into arrays at once; a longer text is one slice of its own.
SLICE_BYTES = 1 << 18


def text_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key of (id, text) for rows whose id may be null or repeated; equal rows share it."""
    return F.concat_ws(
        "-",
        F.coalesce(F.col(doc_id).cast("string"), F.lit("~")),
        F.coalesce(F.length(text), F.lit(-1)).cast("string"),
        F.hex(F.xxhash64(text)),
        F.hex(F.hash(text)),
    )


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold few rows, as texts are long; results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, however it spells them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bins_of(spark: SparkSession) -> int:
    """Number of bins for packed rows: as many as shuffle partitions, which follow the input."""
    return max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bins_for(stored: DataFrame, rows: int) -> int:
    """Number of bins for the rows of a stored table, about ``rows`` in each, whatever the session's settings."""
    return max(64, -(-stored.count() // rows))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        last = max(row + 1, min(last, rows))
        yield row, last
        row = last


def packed(kind: type, array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array, kind).tobytes()


def unpacked(kind: type, column: pa.Array) -> np.ndarray:
    """All values of a column of packed arrays, one after the other."""
    data, offsets = text_buffer(column)
    return data[offsets[0] : offsets[-1]].view(kind)


def ragged(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation and offsets of arrays."""
    sizes = np.array([0, *(len(p) for p in parts)], np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.cumsum(sizes)


def by_bin(batch: dict[str, np.ndarray], key: str, bins: int) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Parts of equal-length arrays by ``key`` modulo ``bins``; the upper bits of the hash choose the bin."""
    bin_of = ((batch[key] >> np.uint64(20)) % np.uint64(bins)).astype(np.int32)
    order = np.argsort(bin_of, kind="stable")
    bounds = np.searchsorted(bin_of[order], np.arange(bins + 1))
    for b in range(bins):
        if bounds[b] < bounds[b + 1]:
            rows = order[bounds[b] : bounds[b + 1]]
            yield b, {name: values[rows] for name, values in batch.items()}


class Bitmap:
    """A set of hashes as a Bloom filter of fixed size: no false negatives, and a proven size bound.

    Two probes per hash. An overfull filter lets more through, which only costs
    time: what passes is always checked exactly afterwards.
    """

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def probes(hashes: np.ndarray, log2: int) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << log2) - 1)
        return hashes & mask, (hashes >> np.uint64(31)) & mask

    @classmethod
    def of(cls, df: DataFrame, column: str, log2: int = 27) -> Bitmap:
        """Of a column of 64-bit hashes. Tasks set bits in parts of 2**16 bytes, which are merged by part."""

        def build(batches):
            bits = np.zeros(1 << (log2 - 3), np.uint8)
            for batch in batches:
                values = batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                for probe in cls.probes(values, log2):
                    np.bitwise_or.at(bits, probe >> np.uint64(3), np.uint8(1) << (probe & np.uint64(7)).astype(np.uint8))
            step = min(len(bits), 1 << 16)
            parts = [i for i in range(len(bits) // step) if bits[i * step : (i + 1) * step].any()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.int32()), pa.array([bits[i * step : (i + 1) * step].tobytes() for i in parts], pa.binary())],
                names=["part", "bits"],
            )

        def merge(table):
            out = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table["bits"].to_pylist()])
            return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "bits": pa.array([out.tobytes()], pa.binary())})

        schema = "part int, bits binary"
        found = df.select(column).mapInArrow(build, schema).groupBy("part").applyInArrow(merge, schema)
        bits = np.zeros(1 << (log2 - 3), np.uint8)
        step = min(len(bits), 1 << 16)
        for row in found.collect():  # at most the bits themselves, whatever the rows
            bits[row.part * step : (row.part + 1) * step] = np.frombuffer(row.bits, np.uint8)
        return cls(bits)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        log2 = (8 * len(self.bits)).bit_length() - 1
        found = np.ones(len(hashes), bool)
        for probe in self.probes(hashes, log2):
            found &= (self.bits[probe >> np.uint64(3)] >> (probe & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return found


def shared(spark: SparkSession, value) -> Callable[[], object]:
    """A broadcast of a value of bounded size; the call reads it in a task."""
    handle = spark.sparkContext.broadcast(value)
    return lambda: handle.value
