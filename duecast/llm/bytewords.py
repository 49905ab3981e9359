"""Words of whole Arrow text columns as numpy arrays, without a Python object per word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at a time; a single longer text is taken alone.
CHUNK_BYTES = 4 << 20
LONG_WORD = 64

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15 | 1)
_UNSTEP = _U(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_CODES = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[9, 10, 11, 12, 13, 32]] = False
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[48:58] = ALNUM_WORDS[97:123] = ALNUM_WORDS[128:] = True


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    table = np.full(n, base, _U)
    table[:1] = 1
    return np.cumprod(table)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def chunks(ends: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; one row at least."""
    start, rows = 0, len(ends) - 1
    while start < rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
        yield start, stop
        start = stop


def word_spans(raw: np.ndarray, ends: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, row) of every word; words never cross rows."""
    if not len(raw):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = is_word[raw]
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[ends] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | cut[1:-1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(stops) + 1, np.searchsorted(ends, first, "right") - 1


def word_hashes(raw: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of every word: a polynomial of byte codes by running sums, then mixed.

    Words over ``LONG_WORD`` bytes take a digest instead: modulo a power of two, polynomials of long words can be made to agree.
    """
    out = np.empty(len(first), _U)
    at = 0
    while at < len(first):
        base = first[at]
        to = max(at + 1, int(np.searchsorted(stop, base + CHUNK_BYTES, "right")))
        span = raw[base : stop[to - 1]]
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE_CODES[span] * _power_table(_STEP, len(span)))])
        a, b = first[at:to] - base, stop[at:to] - base
        out[at:to] = (sums[b] - sums[a]) * _power_table(_UNSTEP, len(span) + 1)[a]
        at = to
    out = mix(out + (stop - first).astype(_U))
    for i in np.flatnonzero(stop - first > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(raw[first[i] : stop[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def chain(*parts: np.ndarray) -> np.ndarray:
    """Hash of a sequence of hashes; order matters."""
    out = np.full(len(parts[0]), 0x5851F42D4C957F2D, _U)
    for part in parts:
        out = mix(out * _U(0x2545F4914F6CDD1D) + part)
    return out
