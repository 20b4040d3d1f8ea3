"""Vectorised word scanning over Arrow text columns.

A batch is cut into blocks of a few hundred kilobytes. Each block is one byte
array; words, their 64-bit hashes and the hashes of word windows come out of
whole-array numpy operations, so the cost per byte is a few nanoseconds and the
memory is bounded by the block size (one text longer than a block is a block of
its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one block holds, unless a single text is longer.
BLOCK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_U64 = np.uint64


def _letters(delims: list[tuple[int, int]]) -> np.ndarray:
    table = np.ones(256, bool)
    for lo, hi in delims:
        table[lo : hi + 1] = False
    return table


#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after lower-casing A-Z).
ALNUM = _letters([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Bytes of words `[^\x20\x09-\x0D]+`.
NONSPACE = _letters([(0x20, 0x20), (0x09, 0x0D)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_HASH = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U64(2) + _U64(1)
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_pow[0]) < n:
        size = max(n, BLOCK_BYTES + 64)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _pow[k] = np.multiply.accumulate(out)
    both = _pow[0][:n], _pow[1][:n]
    if n > 4 * BLOCK_BYTES:  # a giant text's tables don't stay
        _pow[0], _pow[1] = _pow[0][:1].copy(), _pow[1][:1].copy()
    return both


def mix(h: np.ndarray) -> np.ndarray:
    """A finishing permutation of 64-bit hashes."""
    h = h ^ (h >> _U64(31))
    h = h * _U64(0xBF58476D1CE4E5B9)
    h ^= h >> _U64(27)
    h *= _U64(0x94D049BB133111EB)
    h ^= h >> _U64(31)
    return h


@dataclass
class Block:
    """Consecutive texts of a batch: rows lo to hi, their bytes and offsets."""

    lo: int
    hi: int
    raw: np.ndarray
    offsets: np.ndarray

    def text(self, row: int) -> str:
        return self.raw[self.offsets[row] : self.offsets[row + 1]].tobytes().decode("utf-8", "replace")


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a column (null: empty) as blocks of about `most` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_utf8())
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield Block(lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """Words of a block: byte ranges, hashes, and each text's first word (one more at the end)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    sums: np.ndarray

    def prefixes(self, n: int) -> np.ndarray:
        """Hashes of the first n bytes of each word; 0 for shorter words."""
        at = np.minimum(self.starts + n, len(self.sums) - 1)
        inv = _powers(len(self.sums))[1]
        h = mix((self.sums[at] - self.sums[self.starts]) * inv[self.starts] + _U64(n))
        h[self.ends - self.starts < n] = 0
        return h

    def part_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges within words."""
        inv = _powers(len(self.sums))[1]
        return mix((self.sums[ends] - self.sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(block: Block, letters: np.ndarray) -> Words:
    """All words of a block, A-Z lower-cased; a word never spans two texts."""
    low = LOWER[block.raw]
    n = len(low)
    inside = letters[low]
    edges = block.offsets[:-1][block.offsets[:-1] < n]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_HASH[low] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Words(starts, ends, hashes, np.searchsorted(starts, block.offsets), sums)


def word_hashes(text: str, letters: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    return words(Block(0, 1, data, np.array([0, len(data)])), letters).hashes


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k consecutive words of a flat word array."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    n = len(hashes) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _U64(_BASE)
        out += hashes[j : j + n]
    return mix(out + _U64(k))


def code_points(raw: np.ndarray, at: list[int]) -> list[int]:
    """Code point positions of byte positions in a UTF-8 array."""
    if not at:
        return []
    heads = np.cumsum((raw & 0xC0) != 0x80)
    return [int(heads[i - 1]) if i else 0 for i in at]
