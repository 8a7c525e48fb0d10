"""Vectorised words of Arrow string columns: whole texts as arrays of 64-bit word hashes, a few megabytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is taken by itself.
SLAB = 2_000_000

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2 ** 64, computed once for the longest slab seen."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up[:n], cls.down[:n]


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each text begins and the last ends; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slabs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with up to SLAB bytes together, or one longer row."""
    data, offsets = string_bytes(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLAB, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slab in order, and the bounds of each text's words among them.

    White space separates words and A-Z count as lower case. plain: so does ASCII punctuation, and so do Latin-1 capitals.
    """
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    if plain:
        capital = np.append(False, data[:-1] == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        data = data + (capital.astype(np.uint8) << 5)
    inside = ~(_BREAK if plain else _SPACE)[data]
    fresh = np.ones(len(data) + 1, bool)
    fresh[1:-1] = ~inside[:-1]
    fresh[offsets] = True
    starts = np.flatnonzero(inside & fresh[:-1])
    ends = np.flatnonzero(inside & np.append(~inside[1:] | fresh[1:-1], True)) + 1
    up, down = _Powers.of(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_LOWER[data] * up[:-1], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    return hashes, np.searchsorted(starts, offsets)


_PLACES = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct word shingles of every text of a slab; fewer words than size make one shingle of all of them."""
    hashes, bounds = words(data, offsets)
    grams = np.zeros(max(len(hashes) - size + 1, 0), np.uint64)
    for i in range(size):
        grams += hashes[i : len(grams) + i] * _PLACES[i]
    grams = mixed(grams)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(mixed(np.array([(hashes[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64) + _PLACES[63] * np.uint64(b - a)])))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def array_of_lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column of the given arrays."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, kind))
