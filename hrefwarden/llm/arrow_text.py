"""Texts of Arrow batches as numpy arrays of bytes, words and word shingles, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text is worked on alone.
PIECE_BYTES = 1 << 20

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_VALUES_LOWERED = _VALUES.copy()
_VALUES_LOWERED[65:91] = _VALUES[97:123]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one array, and where each row begins and the last ends; null is empty."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    found = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    if not len(texts):
        return found[:0], np.zeros(1, dtype=np.int64)
    return found[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes, one row at least."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = max(first + 1, min(last, len(offsets) - 1))
        yield first, last
        first = last


def batch_pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about so many bytes of text."""
    _, offsets = text_bytes(batch.column(column))
    for first, last in pieces(offsets, limit):
        yield batch.slice(first, last - first)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and the number of words before each row and after the last."""
    solid = np.zeros(len(data) + 2, dtype=bool)
    np.logical_not(_BLANK[data], out=solid[1:-1])
    begins, ends = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = solid[1:-1][inner]
    ends[inner - 1] = solid[1:-1][inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return first, last, np.searchsorted(first, offsets)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_cached: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _cached or len(_cached[name]) < n:
        _cached[name] = _powers(base, max(n, 2 * PIECE_BYTES))
    return _cached[name][:n]


def running_sums(data: np.ndarray, lowered: bool = False) -> np.ndarray:
    """Sums from which the hash of any stretch of bytes follows; see ``stretch_hashes``."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    values = _VALUES_LOWERED if lowered else _VALUES
    np.cumsum(values[data] * _power("up", _ODD, len(data)), out=sums[1:])
    return sums


def stretch_hashes(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[first:last], equal for equal bytes wherever they stand."""
    raw = (sums[last] - sums[first]) * _power("down", _ODD_INVERSE, len(sums))[first]
    return mixed(raw + (last - first).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lowered: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z as a-z if asked for, and the word counts before each row."""
    first, last, counts = word_spans(data, offsets)
    return stretch_hashes(running_sums(data, lowered), first, last), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each row, ascending within it, and their counts before each row.

    A row of fewer words has its whole sequence as one shingle, a row without words none.
    """
    lengths = np.diff(counts)
    rolled, by_length = words, {1: words}
    for k in range(2, width + 1):
        fits = max(0, len(words) - k + 1)
        rolled = by_length[k] = mixed(rolled[:fits] * np.uint64(0xD6E8FEB86659FD93) + words[k - 1 :][:fits])
    found, sizes = [], np.zeros(len(lengths) + 1, dtype=np.int64)
    for row in np.flatnonzero(lengths):
        n, at = lengths[row], counts[row]
        if n <= width:
            own = by_length[n][at : at + 1]
        else:
            own = np.sort(rolled[at : at + n - width + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        found.append(own)
        sizes[row + 1] = len(own)
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64), np.cumsum(sizes)
