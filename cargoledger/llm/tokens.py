"""Token ids of many texts, by a public tokenizer whose pieces never reach across a blank.

`word_bpe_49k.json` drops blanks and encodes each piece between them by itself; its pieces also end
wherever an ASCII letter or digit meets an ASCII mark (apostrophes aside). So the ids of a text are
those of its chunks between such borders, one after the other. A task finds the chunks of a block
of texts with array operations, encodes every different one once and keeps up to `KEPT`; then it starts over.
Results do not depend on what is kept. Chunks are found by a 64-bit hash, those of ASCII without regard to
case, and their bytes are compared; where two share a hash, their texts are encoded whole. Texts that may hold the tokenizer's special strings are encoded whole.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers.pre_tokenizers import ByteLevel

from cargoledger.llm.words import LOWER, byte_hash, same_bytes, utf8

KEPT = 1_000_000
SLOTS = 1 << 21
#: Chunks of these letters are one piece, and the tokenizer's normaliser only lowers their case.
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: 0 blanks of every definition in use, 1 ASCII letters and digits, 2 ASCII marks, 3 all else.
KIND = np.full(256, 3, np.uint8)
KIND[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 2
KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
KIND[[0x20, 0x09, 0x0A, 0x0D]] = 0


@lru_cache(maxsize=2)
def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process, so that what it has learned serves all its tasks."""
    return ChunkEncoder(path)


def chunks_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions of all chunks; none reaches across a row's bounds."""
    kind = np.zeros(len(data) + 2, np.uint8)
    kind[1:-1] = KIND[data]
    left, right = kind[:-1], kind[1:]
    border = (left == 0) | (right == 0) | ((left ^ right) == 3) & (left != 0) & (left != 3) & (right != 3)
    border[bounds] = True
    at = np.flatnonzero(border)
    start, end = at[:-1], at[1:]
    real = kind[start + 1] != 0
    return start[real], end[real]


class Growing:
    """An array with room to append."""

    def __init__(self, kind: type):
        self.values, self.n = np.zeros(1024, kind), 0

    def append(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.values):
            grown = np.zeros(2 * (self.n + len(more)), self.values.dtype)
            grown[: self.n] = self.values[: self.n]
            self.values = grown
        self.values[self.n : self.n + len(more)] = more
        self.n += len(more)


class ChunkEncoder:
    """Ids of chunks, held as one flat array with the offsets of each known chunk."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        to_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        letters = (chr(c) for c in range(0xC0, 0x100))
        self.as_bytes = str.maketrans({c: to_bytes(c)[0][0] for c in letters})
        self._clear()

    def _clear(self) -> None:
        self.slots = np.full(SLOTS, -1, np.int32)
        self.others: dict[int, int] = {}  # chunks whose slot another one took first
        self.hashes, self.flat, self.offsets = Growing(np.uint64), Growing(np.uint32), Growing(np.int64)
        self.offsets.append(np.zeros(1, np.int64))
        self.spelled, self.spelled_at = Growing(np.uint8), Growing(np.int64)
        self.spelled_at.append(np.zeros(1, np.int64))

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each chunk, -1 if it is not known."""
        number = self.slots[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)]
        wrong = np.flatnonzero((number >= 0) & (self.hashes.values[number] != hashes))
        if len(wrong):
            number[wrong] = [self.others.get(h, -1) for h in hashes[wrong].tolist()]
        return number

    def _learn(self, hashes: np.ndarray, chunks: list[str]) -> None:
        ids: list[list[int]] = [[]] * len(chunks)
        rest = []
        for k, chunk in enumerate(chunks):
            if PLAIN.fullmatch(chunk):
                piece = chunk.lower()
                if not piece.isascii():
                    piece = piece.translate(self.as_bytes)
                ids[k] = [t.id for t in self.model.tokenize(piece)]
            else:
                rest.append(k)
        encoded = self.tokenizer.encode_batch_fast([chunks[k] for k in rest], add_special_tokens=False)
        for k, found in zip(rest, encoded, strict=True):
            ids[k] = found.ids
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        first = self.hashes.n
        self.offsets.append(self.flat.n + np.cumsum(lengths))
        self.flat.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())))
        self.hashes.append(hashes)
        spelled = [c.encode() for c in chunks]
        self.spelled_at.append(self.spelled.n + np.cumsum([len(c) for c in spelled]))
        self.spelled.append(np.frombuffer(b"".join(spelled), np.uint8))
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        number = np.arange(first, first + len(hashes), dtype=np.int32)
        free = self.slots[slot] < 0
        self.slots[slot[free]] = number[free]
        for k in np.flatnonzero(self.slots[slot] != number).tolist():
            self.others[int(hashes[k])] = int(number[k])

    def _numbers(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        number = self._find(hashes)
        unknown = np.flatnonzero(number < 0)
        if len(unknown):
            new, at = np.unique(hashes[unknown], return_index=True)
            if self.hashes.n + len(new) > KEPT:
                self._clear()
                new, at = np.unique(hashes, return_index=True)
                unknown = np.arange(len(hashes))
            text = data.tobytes()
            spans = zip(start[unknown[at]].tolist(), end[unknown[at]].tolist(), strict=True)
            self._learn(new, [text[a:b].decode() for a, b in spans])
            number = self._find(hashes)
        return number

    def _same(self, number: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether chunks are spelled like the known ones of their hash."""
        at = self.spelled_at.values
        known, length = at[number], end - start
        out = at[number + 1] - known == length
        like = np.flatnonzero(out)
        spelled = self.spelled.values[: self.spelled.n]
        out[like] = same_bytes(data, start[like], spelled, known[like], length[like])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (no nulls), and the offset of each text in them."""
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        if special.any():
            return self._with_special(texts, special)
        data, ends = utf8(texts)
        data, bounds = data[ends[0] : ends[-1]], ends - ends[0]
        start, end = chunks_of(data, bounds)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        # lowering the case first is only safe where no combining mark can follow
        other = np.concatenate([[0], np.cumsum(KIND[data] == 3)])
        low = np.where(other[end] == other[start], len(data), 0)
        both = np.concatenate([data, LOWER[data]])
        number = self._numbers(byte_hash(both, start + low, end + low), both, start + low, end + low)
        clash = np.flatnonzero(~self._same(number, both, start + low, end + low))
        if len(clash):
            rows = np.zeros(len(texts), bool)
            rows[np.searchsorted(bounds, start[clash], side="right") - 1] = True
            return self._with_special(texts, rows)
        offsets = self.offsets.values
        first = offsets[number]
        lengths = offsets[number + 1] - first
        total = np.concatenate([[0], np.cumsum(lengths)])
        at = np.arange(total[-1]) + np.repeat(first - total[:-1], lengths)
        return self.flat.values[at], total[np.searchsorted(start, bounds)]

    def _with_special(self, texts: pa.Array, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.if_else(pa.array(special), "", texts)
        ids, offsets = self.encode(plain)
        rows = [ids[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
        for r in np.flatnonzero(special).tolist():
            whole = self.tokenizer.encode(texts[r].as_py(), add_special_tokens=False)
            rows[r] = np.array(whole.ids, np.uint32)
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])


def pieces_of(texts: pa.Array, encoder: ChunkEncoder, size: int = 1 << 20):
    """(first row, ids, offsets) for runs of rows of about `size` bytes."""
    lengths = pc.binary_length(texts).to_numpy()
    ends = np.cumsum(lengths)
    row = 0
    while row < len(texts):
        before = ends[row - 1] if row else 0
        last = max(int(np.searchsorted(ends, before + size)), row + 1)
        yield (row, *encoder.encode(texts.slice(row, last - row)))
        row = last
