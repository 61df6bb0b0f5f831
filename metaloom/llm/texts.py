"""Vectorised views of text columns inside Arrow tasks.

A task walks its batches in blocks of about ``BLOCK`` bytes (one document at least), so
its memory follows the longest document and not the batch. Words are found on UTF-8
bytes; hashes are 64-bit polynomials that fold A-Z to a-z.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 19
_RNG = np.random.default_rng(20_240_601)
byte_hashes = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = byte_hashes.copy()
_FOLDED[65:91] = byte_hashes[97:123]
_BASE = int(_RNG.integers(2**40, 2**62)) | 1
_INVERSE = pow(_BASE, -1, 2**64)


class _OfProcess(dict):
    """What a process keeps for itself: tasks are sent it empty."""

    def __reduce__(self):
        return _OfProcess, ()


_POWERS: dict[int, np.ndarray] = _OfProcess()


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that is true for the bytes inside the closed ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Everything but blank and the controls 9 to 13.
WORD = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Letters, digits and every byte outside ASCII.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


@dataclass
class Block:
    """Rows ``first`` to ``first + len(offsets) - 1`` of a batch and their bytes."""

    first: int
    offsets: np.ndarray
    data: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def raw(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()

    def text(self, row: int) -> str:
        return self.raw(row).decode("utf-8", "replace")


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    """The column in blocks; null counts as empty. What Arrow keeps of batches that are gone is given back first."""
    pa.default_memory_pool().release_unused()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield Block(first, at[first : last + 1] - at[first], data[at[first] : at[last]])
        first = last


def words(block: Block, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of every maximal run of word bytes; runs end with their document."""
    n = len(block.data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = table[block.data]
    edge = np.zeros(n + 1, bool)
    edge[block.offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(block.offsets, starts, "right") - 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(0)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        for slot, base in ((0, _BASE), (1, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[slot] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hash of every span of bytes, equal for equal (folded) bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else byte_hashes)[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def chain(parts: list[np.ndarray], seed: int = 7) -> np.ndarray:
    """Order-dependent 64-bit hash of equally long columns of hashes."""
    out = np.full(len(parts[0]), seed, np.uint64)
    for part in parts:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + part)
    return out


def counts_of(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)
