"""Words of a buffer by content: names from prefix sums find candidates for equality, and a comparison of all their characters decides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15)
INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: The lowest 0 to 8 bytes of a number.
LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def powers(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, as many as the longest buffer so far."""
    if len(_powers[0]) < size:
        for k, b in enumerate((BASE, INVERSE)):
            row = np.full(size, b, np.uint64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers


def names(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name of each word, from the values of the buffer's characters. Equal words have equal names, but so have a few others."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)


def distinct(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the first of each distinct word among all words, and for each word the number of the one that it equals.

    Words are not empty. Those that share a name with a word of other characters are told apart by their characters.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = pa.array(name).dictionary_encode()
    number = coded.indices.to_numpy().astype(np.int64)
    first = np.empty(len(coded.dictionary), np.int64)
    first[number[::-1]] = np.arange(len(name))[::-1]  # the last one written is the first one there
    holder, sizes = first[number], ends - starts
    again = np.flatnonzero(holder != np.arange(len(starts)))
    other = sizes[holder[again]] != sizes[again]
    if len(again):
        # Eight bytes at once, from any place; of a word's last eight those behind its end do not count.
        item = units.itemsize
        raw = np.concatenate([units.view(np.uint8), np.zeros(8, np.uint8)])
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        size = sizes[again] * item
        parts = (size + 7) // 8
        before = np.cumsum(parts) - parts
        own = np.repeat(starts[again] * item - 8 * before, parts) + 8 * np.arange(int(parts.sum()))
        its = own + np.repeat((starts[holder[again]] - starts[again]) * item, parts)
        differs = eight[own] ^ eight[np.minimum(its, len(eight) - 1)]
        differs[before + parts - 1] &= LOW[size - 8 * (parts - 1)]
        other |= np.logical_or.reduceat(differs != 0, before)
    if other.any():
        found: dict[bytes, int] = {}
        extra: list[int] = []
        for k in again[other].tolist():
            word = units[starts[k] : ends[k]].tobytes()
            if word not in found:
                found[word] = len(first) + len(extra)
                extra.append(k)
            number[k] = found[word]
        first = np.append(first, np.array(extra, np.int64))
    return first, number


def token_cuts(sizes: np.ndarray, some: list[str], width: int = 4) -> list[int] | None:
    """Where each word's ids start in the bytes of all ids (width each), and where the last one's end, from the number of bytes that each
    token stands for. None if a token reaches over the end of a word."""
    ends = np.cumsum(sizes)
    stops = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in some])
    cuts = np.searchsorted(ends, stops) + 1
    if not len(ends) or cuts[-1] != len(ends) or (ends[cuts - 1] != stops).any():
        return None
    return [0, *(cuts * width).tolist()]
