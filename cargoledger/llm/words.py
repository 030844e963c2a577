"""Words of many texts at once: byte positions and hashes as numpy arrays.

A task turns an Arrow column into blocks of about `BLOCK` bytes (a longer text is a block of its
own), so memory is bounded by the longest text, whatever the batch.

A word's hash takes in eight bytes at a time and mixes them after each step; words of more than `LANES`
eights get a BLAKE2 digest. The hash of a run of words is made from those of its halves, mixed at every
level. No step is linear in what came before, so words or runs of a regular build (as the Thue-Morse words, which
make any polynomial modulo 2**64 collide) are told apart like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Everything below 0x80 but digits and letters.
NOT_ALPHANUMERIC = np.zeros(256, bool)
NOT_ALPHANUMERIC[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_words(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(steps + np.uint64(seed * 0x51ED2701 + 1))


LANES = 8
_LENGTH, _STEP, _LEFT, _RIGHT, _LEFT_2, _RIGHT_2 = (x | np.uint64(1) for x in random_words(2, 6))
#: Masks that keep the first 0 to 8 bytes of a little-endian eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _eights(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with room behind them, and the eight bytes from every place on as an integer."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return padded, np.ndarray((len(data) + 1,), "<u8", buffer=padded.data, strides=(1,))


def same_bytes(one: np.ndarray, start: np.ndarray, two: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether one[start : start + length] equals two[other : other + length], for arrays of spans."""
    (padded, left), (padded_2, right) = _eights(one), _eights(two)
    out = np.ones(len(start), bool)
    live = np.arange(len(start))
    for lane in range(LANES):
        rest = length[live] - 8 * lane
        if lane:
            live, rest = live[rest > 0], rest[rest > 0]
        if not len(live):
            return out
        mask = _FIRST[np.minimum(rest, 8)]
        out[live] &= (left[start[live] + 8 * lane] & mask) == (right[other[live] + 8 * lane] & mask)
    for k in np.flatnonzero(length > 8 * LANES).tolist():
        out[k] = (padded[start[k] : start[k] + length[k]] == padded_2[other[k] : other[k] + length[k]]).all()
    return out


def byte_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for arrays of spans."""
    padded, eights = _eights(data)
    length = end - start
    out = mix(length.astype(np.uint64) * _LENGTH + _STEP)
    live, at = np.arange(len(start)), start
    for lane in range(LANES):
        left = length[live] - 8 * lane
        if lane:
            more = left > 0
            live, left = live[more], left[more]
        if not len(live):
            return out
        bytes_ = eights[at[live] + 8 * lane] & _FIRST[np.minimum(left, 8)]
        out[live] = mix(out[live] * _STEP ^ mix(bytes_ + np.uint64(lane + 1)))
    long = np.flatnonzero(length > 8 * LANES)
    whole = memoryview(padded)
    for k, a, b in zip(long.tolist(), start[long].tolist(), end[long].tolist(), strict=True):
        out[k] = int.from_bytes(blake2b(whole[a:b], digest_size=8).digest(), "little")
    return out


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _LEFT + right * _RIGHT)


def run_hash(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of `length` words (words[i : i + length] at i), from the hashes of the words."""
    return _run_hashes(words, length)[0]


def run_hashes(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each run, the second made of the halves in another way."""
    one, left, right = _run_hashes(words, length)
    return one, mix(left * _LEFT_2 + right * _RIGHT_2 + np.uint64(length))


def _run_hashes(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, and those of the two halves (of which the second may begin within the first)."""
    if len(words) < length:
        none = np.zeros(0, np.uint64)
        return none, none, none
    out, width, left, right = words, 1, words, words
    while width < length:
        step = min(width, length - width)
        left, right = out[: len(out) - step], out[step:]
        out, width = _joined(left, right), width + step
    return out, left, right


@dataclass
class Block:
    """Some rows of a column: their bytes, and where their words are.

    Row r has the words `first[r]` to `first[r + 1]` (exclusive); word i has the bytes
    `start[i]` to `end[i]` of `data`.
    """

    row: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    def word_hashes(self) -> np.ndarray:
        return byte_hash(self.data, self.start, self.end)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the rows' offsets in them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    array = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), ends


def blocks(
    column: pa.Array | pa.ChunkedArray, separators: np.ndarray = BLANKS, lower: bool = False
) -> Iterator[Block]:
    """Cut a column into blocks of rows and find their words."""
    data, ends = utf8(column)
    rows = len(ends) - 1
    row = 0
    while row < rows:
        last = int(np.searchsorted(ends, ends[row] + BLOCK, side="right")) - 1
        last = min(max(last, row + 1), rows)
        part = data[ends[row] : ends[last]]
        if lower:
            part = LOWER[part]
        bounds = ends[row : last + 1] - ends[row]
        inside = np.zeros(len(part) + 2, bool)
        np.logical_not(separators[part], out=inside[1:-1])
        edge = np.zeros(len(part) + 1, bool)
        edge[bounds] = True
        start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        yield Block(row, part, start, end, np.searchsorted(start, bounds))
        row = last
