"""Wavelet matrix: bit planes of a sequence, with rank directories."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from quaestor.llm.packs import squeeze, unsqueeze

MAGIC = b"QWM3"
WORD, SPAN = 64, 8  # bits of a word, words of an entry of the rank directory
BLOCK_WORDS = 1024  # of a plane, compressed apart


class Plane:
    """Words of a bit plane in compressed blocks; one is decompressed when a word of it is asked for, and kept."""

    def __init__(self, blocks: Sequence, first: int, n: int):
        self._blocks, self._first, self._n, self.opened = blocks, first, n, {}

    def __len__(self) -> int:
        return self._n

    def block(self, b: int) -> np.ndarray:
        if b not in self.opened:
            data = self._blocks[self._first + b]
            self.opened[b] = unsqueeze(data if isinstance(data, bytes) else data.as_py(), np.uint64)
        return self.opened[b]

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        of, out = i // BLOCK_WORDS, np.empty(i.shape, np.uint64)
        for b in np.unique(of).tolist():
            here = of == b
            out[here] = self.block(b)[i[here] % BLOCK_WORDS]
        return out

    def whole(self) -> np.ndarray:
        blocks = [self.block(b) for b in range(-(-self._n // BLOCK_WORDS))]
        self.opened = {}
        return np.concatenate(blocks) if blocks else np.empty(0, np.uint64)


class WaveletMatrix:
    """Access, rank and select over non-negative integers of ``bits`` bits.

    Plane k holds bit (bits - 1 - k) of the values as ordered by all planes before it, zeros first. ``ones[k]`` is its rank
    directory: the ones before each 512 bits, and in all. Both are stored, so opening a matrix counts nothing, and a lookup decompresses the blocks of planes that it passes.
    """

    def __init__(self, n: int, planes: np.ndarray | list[Plane], ones: np.ndarray):
        self.n, self.planes, self.ones, self.bits = n, planes, ones, len(planes)
        self.zeros = [n - int(o[-1]) for o in ones]

    @classmethod
    def build(cls, values: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        bits = bits or max(1, int(values.max(initial=0)).bit_length())
        planes = np.zeros((bits, -(-len(values) // (WORD * SPAN)) * SPAN), np.uint64)
        now = np.asarray(values)
        for k in range(bits - 1, -1, -1):
            bit = (now >> now.dtype.type(k)) & now.dtype.type(1) == 1
            raw = np.packbits(bit, bitorder="little")
            planes[bits - 1 - k].view(np.uint8)[: len(raw)] = raw
            now = np.concatenate([now[~bit], now[bit]])
        counts = np.bitwise_count(planes).reshape(bits, -1, SPAN).sum(axis=2, dtype=np.uint32)
        ones = np.concatenate([np.zeros((bits, 1), np.uint32), np.cumsum(counts, axis=1, dtype=np.uint32)], axis=1)
        return cls(len(values), planes, ones)

    def _whole(self, k: int) -> np.ndarray:
        plane = self.planes[k]
        return plane.whole() if isinstance(plane, Plane) else plane

    def _bit(self, k: int, i: np.ndarray) -> np.ndarray:
        return (self.planes[k][i // WORD] >> (i % WORD).astype(np.uint64)) & np.uint64(1) == 1

    def _ones_before(self, k: int, i: np.ndarray) -> np.ndarray:
        span, word, rest = i // (WORD * SPAN), i // WORD, (i % WORD).astype(np.uint64)
        total = self.ones[k][span].astype(np.int64)
        for j in range(SPAN):
            at = span * SPAN + j
            inside = np.flatnonzero(at < len(self.planes[k]))  # at the end of a full last span there is no word
            full, part = at[inside] < word[inside], at[inside] == word[inside]
            mask = np.where(full, ~np.uint64(0), np.where(part, (np.uint64(1) << rest[inside]) - np.uint64(1), np.uint64(0)))
            total[inside] += np.bitwise_count(self.planes[k][at[inside]] & mask)
        return total

    def access(self, i) -> np.ndarray:
        """Values at positions i."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        out = np.zeros(len(i), np.int64)
        for k in range(self.bits):
            bit, ones = self._bit(k, i), self._ones_before(k, i)
            out = out << 1 | bit
            i = np.where(bit, self.zeros[k] + ones, i - ones)
        return out

    def _range(self, value: int, i: int) -> tuple[int, int]:
        lo, hi = np.array([0]), np.array([i])
        for k in range(self.bits):
            a, b = self._ones_before(k, lo), self._ones_before(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if value >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return int(lo[0]), int(hi[0])

    def rank(self, value: int, i: int | None = None) -> int:
        """Occurrences of value before position i (all by default)."""
        if value < 0 or value >> self.bits:
            return 0
        lo, hi = self._range(value, self.n if i is None else i)
        return hi - lo

    def _select_bit(self, k: int, one: bool, j: np.ndarray, block: int = 1 << 12) -> np.ndarray:
        """Positions of the j-th (from 0) ones or zeros of plane k."""
        before = self.ones[k].astype(np.int64)
        before = before if one else np.arange(len(before)) * WORD * SPAN - before
        out = np.empty(len(j), np.int64)
        for lo in range(0, len(j), block):
            want = j[lo : lo + block]
            span = np.searchsorted(before, want, side="right") - 1
            words = self.planes[k][span[:, None] * SPAN + np.arange(SPAN)[None]]
            bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
            hits = np.cumsum(bits == one, axis=1, dtype=np.int16)
            out[lo : lo + block] = span * WORD * SPAN + np.argmax(hits > (want - before[span])[:, None], axis=1)
        return out

    def select(self, value: int, j) -> np.ndarray:
        """Positions of the j-th (from 0) occurrences of value."""
        j = np.atleast_1d(np.asarray(j, np.int64))
        lo, hi = self._range(value, self.n) if not value >> self.bits else (0, 0)
        if len(j) and (j.min() < 0 or j.max() >= hi - lo):
            raise IndexError("fewer occurrences")
        at = lo + j
        for k in range(self.bits - 1, -1, -1):
            one = value >> (self.bits - 1 - k) & 1 == 1
            at = self._select_bit(k, one, at - self.zeros[k] if one else at)
        return at

    def occurrences(self, value: int) -> np.ndarray:
        return self.select(value, np.arange(self.rank(value)))

    def to_array(self) -> np.ndarray:
        """All values, plane by plane from the last."""
        now = None
        for k in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self._whole(k).view(np.uint8), count=self.n, bitorder="little").view(bool)
            out = np.empty(self.n, np.uint32)
            if now is None:
                out[:] = bit
            else:
                zeros = self.zeros[k]
                out[~bit] = now[:zeros]
                out[bit] = now[zeros:] | np.uint32(1 << (self.bits - 1 - k))
            now = out
        return now if now is not None else np.empty(0, np.uint32)

    def to_parts(self) -> tuple[bytes, list[bytes]]:
        """(rank directory as it is, blocks of the planes compressed apart: all of the first plane, then of the second, and so on)."""
        head = MAGIC + np.array([self.n, self.bits], np.int64).tobytes() + self.ones.tobytes()
        whole = [self._whole(k) for k in range(self.bits)]
        return head, [squeeze(p[lo : lo + BLOCK_WORDS]) for p in whole for lo in range(0, len(p), BLOCK_WORDS)]

    @classmethod
    def from_parts(cls, head: bytes, blocks: Sequence) -> WaveletMatrix:
        """A matrix that decompresses a block when it is first looked at. blocks: bytes, or anything with ``as_py`` that gives them."""
        if head[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        n, bits = map(int, np.frombuffer(head, np.int64, 2, 4))
        spans = -(-n // (WORD * SPAN))
        ones = np.frombuffer(head, np.uint32, bits * (spans + 1), 20).reshape(bits, spans + 1)
        of_plane = -(-spans * SPAN // BLOCK_WORDS)
        return cls(n, [Plane(blocks, k * of_plane, spans * SPAN) for k in range(bits)], ones)
