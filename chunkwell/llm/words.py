"""Words of whole Arrow batches as 64-bit hashes, by numpy alone: no Python object a word or a text.

A word is a run of bytes other than ASCII white space. Its hash is that of its bytes as digits of a number in an odd
base modulo 2^64, mixed with its length. Bytes are taken in blocks that end before a word, so that memory stays
bounded by a block and the words of a batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15  # odd, and so invertible
_INVERSE = pow(_BASE, -1, 1 << 64)
_DIGITS = np.random.default_rng(2026).integers(1, 1 << 63, 256, dtype=np.uint64)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes hashed at a time.
BLOCK = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    np.multiply.accumulate(np.full(n - 1, base, dtype=np.uint64), out=out[1:])
    return out


_tables: list[np.ndarray] = []


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, at least n of them."""
    if not _tables or len(_tables[0]) < n:
        size = max(BLOCK, 1 << (n - 1).bit_length())
        _tables[:] = [_powers(_BASE, size), _powers(_INVERSE, size)]
    return _tables[0], _tables[1]


@dataclass
class Words:
    row: np.ndarray  # of each word
    hash: np.ndarray
    line: np.ndarray  # its line in the batch: changes with a newline and with the row
    start: np.ndarray  # its first code point in its row
    first: np.ndarray  # of each row, and one more: its first word
    length: np.ndarray  # of each row: code points


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the column's texts one after another, and where each begins; a null has none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def batch_words(column: pa.Array, lower: bool = False, places: bool = False) -> Words:
    """The words of a column of texts. lower: A-Z as a-z. places: fill line, start and length as well."""
    raw, at = _bytes_of(column)
    n = len(raw)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~_WHITE[raw]
    begins = np.zeros(n + 1, dtype=bool)
    begins[at] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | begins[:-1]))
    stops = np.flatnonzero(inside[1:-1] & (~inside[2:] | begins[1:])) + 1
    hashes = np.zeros(len(starts), dtype=np.uint64)
    k = 0
    while k < len(starts):
        low = starts[k]
        j = max(k + 1, int(np.searchsorted(stops, low + BLOCK, side="right")))
        high = stops[j - 1]
        powers, inverses = _table(int(high - low))
        block = raw[low:high]
        total = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(_DIGITS[_LOWER[block] if lower else block] * powers[: high - low], out=total[1:])
        a, b = starts[k:j] - low, stops[k:j] - low
        hashes[k:j] = (total[b] - total[a]) * inverses[a] + (b - a).astype(np.uint64)
        k = j
    rows = np.searchsorted(at, starts, side="right") - 1
    first = np.searchsorted(starts, at)
    none = np.zeros(0, dtype=np.int64)
    line, begin, length = none, none, none
    if places:
        breaks = np.flatnonzero((raw == 10) | begins[:-1])
        line = np.searchsorted(breaks, starts, side="right")
        if (raw < 128).all():
            begin, length = starts - at[rows], np.diff(at)
        else:
            points = np.zeros(n + 1, dtype=np.int64)
            np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
            begin, length = points[starts] - points[at[rows]], np.diff(points[at])
    return Words(rows, mix(hashes), line, begin, first, length)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, by doubling."""
    odd = np.uint64(_BASE)
    done, size, out, covered, bits = words, 1, None, 0, n
    while bits:
        if bits & 1:
            if out is None:
                out, covered = done, size
            else:
                m = max(0, min(len(out), len(done) - covered))
                out = mix(out[:m] * odd + done[covered : covered + m])
                covered += size
        bits >>= 1
        if bits:
            m = max(0, len(done) - size)
            done = mix(done[:m] * odd + done[size : size + m])
            size *= 2
    return out[: max(0, len(words) - n + 1)]
