"""Words of whole texts as flat numpy arrays, straight from Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text is handled alone, whole.
SLICE_BYTES = 2 << 20

_RNG = np.random.default_rng(20240229)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)  # odd, so it has an inverse mod 2**64
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BYTE_FOLDED = _BYTE[_FOLD]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits depend on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        grown = np.full(n, base, np.uint64)
        grown[0] = 1
        have = np.multiply.accumulate(grown)
        if n <= SLICE_BYTES + 1:
            _powers[kind] = have
    return have[:n]


@dataclass
class Words:
    """The words of rows [lo, hi): byte spans in ``data`` and the row of each."""

    lo: int
    hi: int
    data: np.ndarray
    row_at: np.ndarray  # hi - lo + 1 offsets into data
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray  # 0-based from lo

    def hashes(self, fold_case: bool = True) -> np.ndarray:
        """A 64-bit hash of each word, ASCII case folded if asked."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.uint64)
        table = _BYTE_FOLDED if fold_case else _BYTE
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(table[self.data] * _power("up", _BASE, n), out=prefix[1:])
        span = (prefix[self.end] - prefix[self.start]) * _power("down", _BASE_INV, n)[self.start]
        return mix(span + (self.end - self.start).astype(np.uint64) * _ODD)

    def first(self) -> np.ndarray:
        """Index of each row's first word, and the number of words at the end."""
        return np.searchsorted(self.row, np.arange(self.hi - self.lo + 1))


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one large-string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.cast(pa.large_string()).fill_null("")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, bytes, offsets) for runs of rows of about ``limit`` bytes."""
    n = len(texts)
    if not n:
        return
    at = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Words]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text; a word never crosses two texts."""
    for lo, hi, data, row_at in slices(texts, limit):
        space = _SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[row_at] = True
        before = np.ones(len(data) + 1, bool)
        before[1:] = space
        before |= edge
        after = np.ones(len(data) + 1, bool)
        after[:-1] = space
        after |= edge
        solid = ~space
        start = np.flatnonzero(solid & before[:-1])
        end = np.flatnonzero(solid & after[1:]) + 1
        row = np.searchsorted(row_at, start, "right") - 1
        yield Words(lo, hi, data, row_at, start, end, row)
