"""Words of many texts at once, from the bytes of an Arrow column.

Words are found and hashed with whole-array steps over the UTF-8 bytes, so no Python object is
made per word. Two words get the same 64-bit hash exactly when their lower-cased bytes agree, up to
hash collisions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: bytes of text handled at once (a longer text is handled alone)
SLICE_BYTES = 1_000_000
#: rows of a pandas column that are copied to Arrow at once
COPIED_ROWS = 1_000

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

#: ASCII A-Z to a-z, all other bytes as they are
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: bytes of words that end at ASCII white space
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: bytes of words made of ASCII letters, digits and everything beyond ASCII
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x30:0x3A] = LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < size:
        size = max(size, SLICE_BYTES + 65536)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Words:
    """Words of consecutive rows: ``hash``, byte ``start`` and ``end`` in ``data``, and per row the
    position of its first word in ``first`` (one entry more than rows)."""

    row: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))

    def text(self, i: int) -> str:
        return self.data[self.start[i]:self.end[i]].tobytes().decode("utf-8", "replace")


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, data


def _hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _power_table(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def word_slices(column: pa.Array, letters: np.ndarray = SPACED, slice_bytes: int = SLICE_BYTES) -> Iterator[Words]:
    """Words of a text column (null counts as empty), some rows at a time and each text whole."""
    if not len(column):
        return
    offsets, data = _buffers(column)
    row = 0
    while row < len(offsets) - 1:
        stop = int(np.searchsorted(offsets, offsets[row] + slice_bytes, "right")) - 1
        stop = min(max(stop, row + 1), len(offsets) - 1)
        own = LOWER[data[offsets[row]:offsets[stop]]]
        bounds = offsets[row:stop + 1] - offsets[row]
        inside = letters[own]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        filled = np.diff(bounds) > 0
        heads, tails = bounds[:-1][filled], bounds[1:][filled] - 1
        begins[heads] = inside[heads]
        ends[tails] = inside[tails]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        yield Words(row, own, bounds, start, end, _hash_spans(own, start, end), np.searchsorted(start, bounds))
        row = stop


def joined(parts: list[Words]) -> Words:
    """The words of consecutive slices as one (at least one slice)."""
    at = np.cumsum([0] + [len(p.data) for p in parts])
    words = np.cumsum([0] + [len(p.hash) for p in parts])
    def shifted(name: str, by: np.ndarray, bounds: bool = False) -> np.ndarray:
        rows = [getattr(p, name) + b for p, b in zip(parts, by)]
        return np.concatenate([rows[0][:1], *[r[1:] for r in rows]] if bounds else rows)
    return Words(parts[0].row, np.concatenate([p.data for p in parts]), shifted("offsets", at, True), shifted("start", at),
                 shifted("end", at), np.concatenate([p.hash for p in parts]), shifted("first", words, True))


def sequence_hash(parts: list[np.ndarray]) -> np.ndarray:
    """One hash per place from the hashes at that place of several arrays, in order."""
    total = np.full(len(parts[0]), 0x51ED270B9F4C1D3D, np.uint64)
    for part in parts:
        total = mix(total * np.uint64(0x2545F4914F6CDD1D) + part)
    return total


class HashIndex:
    """Positions of 64-bit keys by direct addressing: tables in a row, each for the keys that met a taken
    slot in the one before."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.tables: list[tuple[np.uint64, np.uint64, np.ndarray]] = []
        left = np.arange(len(keys))
        while len(left):
            bits = max(4, int(4 * len(left)).bit_length())
            factor = np.uint64(2 * len(self.tables) * 0x632BE59BD9B4E019 % (1 << 64) | 1)
            shift = np.uint64(64 - bits)
            slots = ((keys[left] * factor) >> shift).astype(np.int64)
            table = np.full(1 << bits, -1, np.int32)
            table[slots] = left
            self.tables.append((factor, shift, table))
            left = left[table[slots] != left]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Position of each hash among the keys, -1 where it is none."""
        found = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for factor, shift, table in self.tables:
            at = table[((hashes[open_] * factor) >> shift).astype(np.int64)]
            hit = at >= 0
            hit[hit] = self.keys[at[hit]] == hashes[open_[hit]]
            found[open_[hit]] = at[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
        return found
