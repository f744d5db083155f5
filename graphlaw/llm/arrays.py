"""Whole batches of texts as flat arrays: bytes, words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Fixed odd multipliers and the base of the running hash.
M1, M2, BASE = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53), U(0x9E3779B97F4A7C15)
LETTERS = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * M1
    x ^= x >> U(33)
    x *= M2
    x ^= x >> U(29)
    return x


class Powers:
    """Powers of BASE and of its inverse modulo 2**64."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            size = 1 << n.bit_length()
            for name, base in (("up", int(BASE)), ("down", pow(int(BASE), -1, 1 << 64))):
                row = np.full(size, U(base))
                row[0] = 1
                setattr(cls, name, np.multiply.accumulate(row))
        return cls.up, cls.down


class Texts:
    """Some texts of an Arrow column: data (bytes of all, one after another) and edges (where each begins, and the end)."""

    def __init__(self, column: pa.Array, first: int = 0, last: int | None = None):
        last = len(column) if last is None else last
        offsets = np.frombuffer(column.buffers()[1], np.int32 if column.type in (pa.string(), pa.binary()) else np.int64)
        offsets = offsets[column.offset + first : column.offset + last + 1].astype(np.int64)
        whole = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        self.data, self.edges = whole[offsets[0] : offsets[-1]], offsets - offsets[0]

    def __len__(self) -> int:
        return len(self.edges) - 1


def slices(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about size bytes each; a longer text is a range of its own."""
    offsets = np.frombuffer(column.buffers()[1], np.int32 if column.type in (pa.string(), pa.binary()) else np.int64)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(to, len(column))
        at = to


def running_hash(data: np.ndarray) -> np.ndarray:
    """Sums of the bytes' codes times powers of BASE, from the front; with Powers they give the hash of any stretch."""
    up, _ = Powers.upto(len(data))
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(LETTERS[data] * up[: len(data)], out=out[1:])
    return out


def stretch_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches of bytes, of their content and length."""
    _, down = Powers.upto(len(sums))
    return mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * M2)


class Words:
    """The words of some texts: begin and end (in bytes), hash, doc (number of its text), and first (where each text's words begin, and the end)."""

    def __init__(self, texts: Texts):
        space = SPACES[texts.data]
        cut = np.zeros(len(space) + 1, bool)
        cut[texts.edges] = True
        word = ~space
        begins = word & np.r_[True, space[:-1]] | word & cut[:-1] if len(space) else word
        ends = word & (np.r_[space[1:], True] | cut[1:]) if len(space) else word
        self.begin, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.hash = stretch_hash(running_hash(texts.data), self.begin, self.end)
        self.first = np.searchsorted(self.begin, texts.edges)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one text and the number of that text; a text of fewer words is one shingle."""
    n = len(words.hash)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = np.diff(words.first)
    last = words.first[1:][words.doc]
    left = last - np.arange(n)
    h = np.zeros(n, np.uint64)
    padded = np.r_[words.hash, np.zeros(k, np.uint64)]
    for j in range(k):
        h = mixed(h * BASE + np.where(left > j, padded[j : n + j], U(j)))
    keep = (left >= k) | ((size[words.doc] < k) & (np.arange(n) == words.first[:-1][words.doc]))
    return h[keep], words.doc[keep]
