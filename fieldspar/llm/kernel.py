"""Vectorised word and shingle hashing over Arrow string buffers.

Words are the runs ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  Both rules are about single ASCII
bytes, which never occur inside a longer UTF-8 sequence, so the work is done on bytes: a prefix sum
of a polynomial hash gives every word's 64-bit hash without making one Python string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
SHINGLE_WORDS = 5

pa.set_memory_pool(pa.system_memory_pool())  # gives freed batches back at once

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_RNG = np.random.default_rng(20240229)
_COEF = _RNG.integers(0, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LENGTH = _RNG.integers(0, 1 << 63, SHINGLE_WORDS + 1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64))
    values[65:91] = values[97:123]  # A-Z count as a-z
    return values


VALUES = _byte_values()


def _table(separators: bytes) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Words end only at white space.
SPACED = _table(b" \t\n\v\f\r")
#: Words end at any ASCII byte that is no letter or digit.
LETTERS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the hash's base, or of its inverse."""
    if len(_powers[kind]) < n:
        factors = np.full(max(n, PIECE_BYTES + 65536), _BASE if kind == "up" else _BASE_INV, np.uint64)
        factors[0] = 1
        _powers[kind] = np.cumprod(factors)
    return _powers[kind][:n]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    ends = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def small(batches: Iterator[pa.RecordBatch], column: int, limit: int = 2 * PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of a string column; a longer row is alone."""
    for batch in batches:
        _, offsets = string_buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def _pieces(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about PIECE_BYTES that never cut a word: they end at a row's end or a separator."""
    total, at = int(offsets[-1]), 0
    while at < total:
        to = min(total, at + PIECE_BYTES)
        if to < total:
            row = int(offsets[np.searchsorted(offsets, to, side="right") - 1])
            if row > at:
                to = row
            else:  # inside one very long row
                step = 4096
                while to < total and table[data[to - 1]]:
                    gap = np.flatnonzero(~table[data[to : to + step]])
                    stop = int(offsets[np.searchsorted(offsets, to, side="left")])
                    nxt = to + int(gap[0]) + 1 if len(gap) else min(total, to + step)
                    to = min(nxt, stop) if stop > to else nxt
                    if to == stop:
                        break
        yield at, to
        at = to


def words(column: pa.Array, table: np.ndarray = SPACED, places: bool = False, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hashes of all words of a column, in order, and the number of words of each row.

    With ``places`` also the byte range of each word, counted from the start of the column's bytes.
    With ``stems``, numbers of bytes, each word is followed by the hashes of its first so many
    bytes, and by its own hash again where it isn't longer; the numbers of words count all of them.
    """
    data, offsets = string_buffers(column)
    hashes, firsts, lasts = [], [], []
    for at, to in _pieces(data, offsets, table):
        part = data[at:to]
        inside = table[part]
        cut = offsets[(offsets > at) & (offsets < to)] - at
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[cut] = inside[cut]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        closes[cut - 1] = inside[cut - 1]
        first, last = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        running = np.empty(len(part) + 1, np.uint64)
        running[0] = 0
        np.cumsum(VALUES[part] * power("up", len(part)), out=running[1:])
        down = power("down", len(part))[first]
        own = mix((running[last] - running[first]) * down + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        if stems:
            heads = [mix((running[np.minimum(first + n, last)] - running[first]) * down + np.uint64(n << 40)) for n in stems]
            longer = [last - first > n for n in stems]
            own = np.stack([own, *(np.where(ok, h, own) for ok, h in zip(longer, heads, strict=True))], axis=1).ravel()
        hashes.append(own)
        firsts.append(first + at)
        lasts.append(last + at)
    empty = np.zeros(0, np.int64)
    first = np.concatenate(firsts) if firsts else empty
    counts = np.diff(np.searchsorted(first, offsets)) * (1 + len(stems))
    out = (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts)
    return (*out, first, np.concatenate(lasts) if lasts else empty) if places else out


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and how many each row has.

    A row with fewer words has its whole sequence as the one shingle; a row without words has none.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    n = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    if not len(hashes):
        return np.zeros(0, np.uint64), n
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    total = np.zeros(len(hashes), np.uint64)
    for j in range(size):
        total += padded[j : j + len(hashes)] * _COEF[j]
    total += _LENGTH[size]
    for row in np.flatnonzero((counts > 0) & (counts < size)):
        a, m = starts[row], counts[row]
        total[a] = np.append(hashes[a : a + m] * _COEF[:m], _LENGTH[m]).sum(dtype=np.uint64)
    mask = np.ones(len(hashes), bool)
    for j in range(1, size):  # the last size - 1 words of a row start no shingle
        at = ends[counts >= size] - j
        mask[at] = False
    for row in np.flatnonzero((counts > 1) & (counts < size)):
        mask[starts[row] + 1 : ends[row]] = False
    return mix(total[mask]), n


def row_slices(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of the rows' items in one long array."""
    ends = np.cumsum(n)
    yield from zip((ends - n).tolist(), ends.tolist(), strict=True)


def distinct_shingles(column: pa.Array, size: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """For each row the sorted distinct shingle hashes."""
    found, n = shingles(*words(column), size)
    for a, b in row_slices(n):
        yield np.unique(found[a:b])
