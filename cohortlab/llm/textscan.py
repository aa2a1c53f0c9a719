"""Whole texts as arrays: words, hashes of words and of byte strings, for use inside tasks.

Texts come in blocks of bounded size, joined by line breaks, so one pass of array operations serves many documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


BASE = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
CODES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_cache: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept between blocks."""
    if len(_cache.get("up", ())) < n:
        _cache.update(up=_powers(BASE, n), down=_powers(INVERSE, n))
    return _cache["up"][:n], _cache["down"][:n]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut to about `limit` bytes of text each; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes + 1) // limit
        edges = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            yield batch.slice(a, b - a)


class Block:
    """Texts of a block: bytes joined by line breaks, and where each text begins and ends."""

    def __init__(self, texts: pa.Array):
        plain = pc.fill_null(texts, "")
        self.sizes = pc.binary_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends = np.cumsum(self.sizes + 1) - 1
        self.begins = self.ends - self.sizes
        self.raw = b"\n".join([*plain.cast(pa.binary()).to_pylist(), b""])
        self.bytes = np.frombuffer(self.raw, np.uint8)

    def words(self, lower: bool) -> "Words":
        return Words(self, lower)

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        """Running hash before each byte and at the end."""
        up, _ = powers(len(codes) + 1)
        out = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[:-1], out=out[1:])
        return out

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k bytes from each place; the last k - 1 places are left out."""
        run = self.prefix(CODES[self.bytes])
        _, down = powers(len(run))
        return mix((run[k:] - run[:-k]) * down[: len(run) - k])


class Words:
    """Words of a block with their hashes, in order; `first[d]` to `first[d + 1]` are those of text d."""

    def __init__(self, block: Block, lower: bool):
        inside = IS_WORD[block.bytes]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        codes = CODES.copy()
        if lower:
            codes[65:91] = codes[97:123]
        run = block.prefix(codes[block.bytes])
        _, down = powers(len(run))
        self.hash = mix((run[self.end] - run[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64) * _ODD)
        self.first = np.concatenate((np.searchsorted(self.start, block.begins), [len(self.start)]))
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    def windows(self, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of windows of k words inside one text; a place is the number of the window's first word."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = h * BASE + self.hash[j: j + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1:])
        return at, mix(h[at] ^ CODES[seed])
