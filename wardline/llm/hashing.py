"""64-bit hashes of words and of word windows, computed on whole Arrow text buffers.

A word is a maximal run of bytes outside the separators. Its hash is a
polynomial modulo 2**64 with an odd base, finalised by a mixer; hashes of
windows are polynomials over the mixed word hashes. Sums run over all bytes of a
slice at once and a word's part is cut out by a difference of prefix sums.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 18
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _tables:
        steps = []
        for b in (base, pow(base, -1, 1 << 64)):
            factors = np.full(PIECE + 1, b, np.uint64)
            factors[0] = 1
            steps.append(np.cumprod(factors, dtype=np.uint64))
        _tables[base] = steps[0], steps[1]
    return _tables[base]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (exclusive) of every word in ``data``, and the first word of each row.

    ``offsets`` are the rows' bounds in ``data``; a row's end also ends a word.
    """
    inner = ~separator[data]
    starts, ends = inner.copy(), inner.copy()
    if len(data):
        starts[1:] &= ~inner[:-1]
        ends[:-1] &= ~inner[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        starts[edges] = inner[edges]
        ends[edges - 1] = inner[edges - 1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    power, inverse = _powers(base)
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = int(np.searchsorted(ends, starts[first] + PIECE, "right"))
        if last <= first:  # one word of more than a piece
            total = 0
            for k, at in enumerate(range(int(starts[first]), int(ends[first]), PIECE)):
                part = data[at : min(at + PIECE, ends[first])].astype(np.uint64) + np.uint64(1)
                total += int((part * power[: len(part)]).sum(dtype=np.uint64)) * pow(base, k * PIECE, 1 << 64)
            out[first] = total % (1 << 64)
            first += 1
            continue
        low, high = int(starts[first]), int(ends[last - 1])
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * power[: high - low], out=sums[1:])
        a, b = starts[first:last] - low, ends[first:last] - low
        out[first:last] = (sums[b] - sums[a]) * inverse[a]
        first = last
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(BASES[2]))


def windows(words: np.ndarray, size: int, base: int = BASES[1]) -> np.ndarray:
    """Hash of the ``size`` words from each position on; the last ``size - 1`` positions have none."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(base)
    out = np.empty(count, np.uint64)
    step = PIECE - size
    for at in range(0, count, step):
        part = words[at : at + step + size - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=sums[1:])
        n = len(part) - size + 1
        out[at : at + n] = (sums[size:] - sums[:n]) * inverse[:n]
    return mix(out + np.uint64(size))
