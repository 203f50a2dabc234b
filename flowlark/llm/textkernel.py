"""Vectorised word and shingle hashing over Arrow text buffers.

All functions work on a whole batch at once: the batch's UTF-8 bytes are one
``uint8`` array, documents are slices of it. Nothing loops over characters or
words in Python, and no text is cut short. Hashes are 64 bits wide; two
different words or shingles are taken as equal with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space and ASCII punctuation: words then are runs of letters, digits and bytes beyond ASCII.
WORD_BREAKS = _SPACE.copy()
WORD_BREAKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS = (np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
_EMPTY = np.zeros(0, dtype=np.uint64)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), so that every bit is usable."""
    z = values ^ (values >> np.uint64(30))
    z = z * np.uint64(0xBF58476D1CE4E5B9)
    z = z ^ (z >> np.uint64(27))
    z = z * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class _Powers:
    """Powers of the base, grown to the longest word seen."""

    def __init__(self) -> None:
        self.table = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            step = self.table[-1:] * _BASE
            self.table = np.concatenate([self.table, self.table * step])
        return self.table


_POWERS = _Powers()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _words(data: np.ndarray, offsets: np.ndarray, lower: bool, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(data) == 0:
        return _EMPTY, np.zeros(len(offsets), dtype=np.int64)
    inside = ~breaks[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    begins = inside.copy()
    begins[1:] &= first[1:-1] | ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= first[1:-1] | ~inside[1:]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    bounds = np.searchsorted(start, offsets)
    if len(start) == 0:
        return _EMPTY, bounds
    lengths = stop - start
    at = np.flatnonzero(inside)
    values = _BYTE_VALUE[_LOWER[data[at]] if lower else data[at]]
    power = _POWERS.upto(int(lengths.max()))
    before = np.cumsum(lengths) - lengths
    values *= power[np.arange(len(at)) - np.repeat(before, lengths)]
    return mix(np.add.reduceat(values, before)), bounds


def word_hashes(data: np.ndarray, offsets: np.ndarray, *, lower: bool = True, breaks: np.ndarray = _SPACE, block: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each document and the end).

    Words are maximal runs outside of space, tab, LF, VT, FF and CR; with
    ``lower`` A-Z count as a-z. ``breaks`` may give another set of bytes. Works in blocks of about ``block`` bytes (whole
    documents), which bounds the memory.
    """
    out, bounds, done, i, n = [], [np.zeros(1, dtype=np.int64)], 0, 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + block, side="right")) - 1)
        words, at = _words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower, breaks)
        out.append(words)
        bounds.append(at[1:] + done)
        done += len(words)
        i = j
    return (np.concatenate(out) if out else _EMPTY), np.concatenate(bounds)


def window_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of ``size`` successive words (none if there are fewer)."""
    n = len(words) - size + 1
    if n <= 0:
        return _EMPTY
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total += words[k : k + n] * _MULTIPLIERS[k]
    return mix(total)


def shingle_sequence(words: np.ndarray, size: int) -> np.ndarray:
    """Shingle of each window; with fewer words than ``size`` the whole sequence is one, without words none."""
    if len(words) == 0:
        return _EMPTY
    if len(words) < size:
        return mix(np.array([np.sum(words * _MULTIPLIERS[: len(words)], dtype=np.uint64) ^ np.uint64(len(words))], dtype=np.uint64))
    return window_hash(words, size)


def shingle_sets(column: pa.Array, size: int, *, lower: bool = True) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of the column."""
    words, bounds = word_hashes(*text_buffer(column), lower=lower)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield np.unique(shingle_sequence(words[a:b], size))


def list_column(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """One Arrow list for each array."""
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)
    if kind == pa.int64() and values.dtype == np.uint64:
        values = values.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


# --- words with their prefixes, and words with their shapes ---------------------------------------------------


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = WORD_BREAKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, document) of each word, in order."""
    if len(data) == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    inside = ~breaks[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= first[1:-1] | ~inside[:-1]
    ends[:-1] &= first[1:-1] | ~inside[1:]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1 - start, np.searchsorted(offsets, start, side="right") - 1


def prefix_hashes(data: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the first ``size`` bytes from each start (A-Z as a-z); equal bytes, equal hashes for one size."""
    total = np.zeros(len(start), dtype=np.uint64)
    for k in range(size):
        total += _BYTE_VALUE[_LOWER[data[start + k]]] * _MULTIPLIERS[k]
    return mix(total ^ np.uint64(size * 0x51ED27))


_CLASS = np.ones(256, dtype=np.uint8)  # letters and bytes beyond ASCII
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4
_CLASS[48:58] = 3
_CLASS[[*range(0, 32), 32, 127]] = 0
_CLASS[10] = 5
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_CAPITAL, _CAPITALS, _NUMBER, _LINE = (np.uint64(x) for x in (0xA1, 0xA2, 0xA3, 0xA4))


def word_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, first token of each document and the end).

    Tokens are words (runs of letters and of bytes beyond ASCII, A-Z as a-z),
    each with its own hash, numbers by their length up to four digits, runs of
    punctuation and of line ends. A word with one capital, or with more, is
    followed by a token that says so.
    """
    if len(data) == 0:
        return _EMPTY, np.zeros(len(offsets), dtype=np.int64)
    kind = _CLASS[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    begins = np.ones(len(data), dtype=bool)
    begins[1:] = (kind[1:] != kind[:-1]) | first[1:-1]
    start = np.flatnonzero(begins)
    lengths = np.diff(np.append(start, len(data)))
    power = _POWERS.upto(int(lengths.max()))
    values = _BYTE_VALUE[_LOWER[data]] * power[np.arange(len(data)) - np.repeat(start, lengths)]
    hashes, capitals = mix(np.add.reduceat(values, start)), np.add.reduceat(_UPPER[data], start)
    classes = kind[start]
    hashes[classes == 3] = _NUMBER + (np.minimum(lengths[classes == 3], 4) << 8).astype(np.uint64)
    hashes[classes == 5] = _LINE
    keep = classes > 0
    hashes, capitals, start = hashes[keep], capitals[keep], start[keep]
    shaped = np.flatnonzero(capitals > 0)
    place = np.searchsorted(start, offsets)
    hashes = np.insert(hashes, shaped + 1, np.where(capitals[shaped] > 1, _CAPITALS, _CAPITAL))
    return mix(hashes), place + np.searchsorted(shaped, place)
