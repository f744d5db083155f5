"""Substring dedup with an FM-index for each shard.

Backward search over a wavelet matrix gives the matching statistics of the
streamed segments: how far the words from each place on can be followed while they
still stand at another place of the index. Intervals of the threshold's length
or more are reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from graphlaw.llm.arrays import U
from graphlaw.llm.common import long_keys, named_keys
from graphlaw.llm.repeats import LAST_KEY, Units, covered, find, inside, texts_with_ranges

WINDOW, ANCHOR, SHARD_WORDS = 35, 12, 250_000


class Bits:
    """A bit vector with rank: packed words and counts before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]
        self.zeros = len(bits) - int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        at = i >> 6
        return self.before[at] + np.bitwise_count(self.words[at] & ((U(1) << (i & 63).astype(np.uint64)) - U(1)))


class FMIndex:
    """A compressed index of a text of symbols 0 to sigma - 1 for patterns of at most depth symbols; 0 separates and is never searched.

    The symbols before the sorted suffixes are held as runs: a wavelet matrix of
    the runs' symbols, and where they begin. Suffixes are sorted by their first depth
    symbols only; for patterns no longer than that, the intervals are those of the
    full order. weight: what an occurrence that begins at a place of the text counts.
    """

    def __init__(self, text: np.ndarray, sigma: int, depth: int, weight: np.ndarray | None = None):
        n = len(text)
        rank, have = text.astype(np.int64), 1
        while have < depth:
            follow = np.zeros(n, np.int64)
            follow[: max(0, n - have)] = rank[have:] + 1
            value = rank * (n + sigma + 2) + follow
            order = np.argsort(value, kind="stable")
            ordered = value[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
            have *= 2
        order = np.argsort(rank, kind="stable")
        last = text[order - 1]  # the symbol before each suffix; before the first stands the last, a separator
        self.size, self.levels = n, max(1, int(sigma - 1).bit_length())
        self.starts = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))]
        self.weight = np.r_[0, np.cumsum(weight[order])] if weight is not None else np.arange(n + 1)
        self.run = np.flatnonzero(np.r_[True, last[1:] != last[:-1]])
        heads = last[self.run]
        self.heads = heads.astype(np.int32)
        sizes = np.diff(np.r_[self.run, n])[np.argsort(heads, kind="stable")]
        self.runs = np.r_[0, np.cumsum(np.bincount(heads, minlength=sigma))]  # of lower symbols
        self.sums = np.r_[0, np.cumsum(sizes)]  # symbols in the runs of lower symbols and in earlier runs of the same
        self.bits: list[Bits] = []
        for level in reversed(range(self.levels)):
            bit = (heads >> level & 1).astype(np.uint8)
            self.bits.append(Bits(bit))
            heads = np.concatenate([heads[bit == 0], heads[bit == 1]])
        self.base = self._down(np.arange(sigma), np.zeros(sigma, np.int64))
        self._parents(text, order, depth)

    def _parents(self, text: np.ndarray, order: np.ndarray, depth: int) -> None:
        """common: symbols that neighbours in the order share; lower, higher: the nearest places on either side that share less."""
        n = self.size
        self.common = np.zeros(n + 1, np.int32)
        self.common[[0, n]] = -1
        live = np.arange(1, n)
        for m in range(depth):
            x = text[order[live] + m]
            live = live[(x == text[order[live - 1] + m]) & (x > 0)]
            if not len(live):
                break
            self.common[live] = m + 1
        self.lower, self.higher = np.zeros(n + 1, np.int32), np.full(n + 1, n, np.int32)
        places = np.arange(n + 1, dtype=np.int32)
        for v in range(int(self.common.max(initial=0)) + 1):
            at = np.flatnonzero(self.common == v)
            if len(at):
                less = places[self.common < v]
                next_ = np.searchsorted(less, at)
                self.lower[at], self.higher[at] = less[next_ - 1], less[next_]

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits in zip(reversed(range(self.levels)), self.bits, strict=True):
            ones = bits.rank(i)
            i = np.where(symbol >> level & 1, bits.zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often the symbol stands among the first i symbols before suffixes."""
        run = np.searchsorted(self.run, i, "right") - 1
        first = self.runs[symbol]
        full = self.sums[first + self._down(symbol, run) - self.base[symbol]] - self.sums[first]
        return full + np.where(self.heads[run] == symbol, i - self.run[run], 0)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with the symbol put before."""
        start = self.starts[symbol]
        return self.rank(symbol, low) + start, self.rank(symbol, high) + start

    def parent(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next larger intervals, of shorter patterns: (low, high, symbols)."""
        a, b = self.common[low], self.common[high]
        q = np.maximum(np.maximum(a, b), 0)
        return np.where(a == q, self.lower[low], low), np.where(b == q, self.higher[high], high), q

    def matching_statistics(self, text: np.ndarray, begin: np.ndarray, size: np.ndarray, least: int = 2) -> np.ndarray:
        """For every place of the stretches text[begin : begin + size], one after another: how many symbols from there on, within the stretch, occur in the index least times or more.

        All stretches are streamed side by side from their ends. A step either puts
        the next symbol before the pattern or, where that occurs too rarely, drops
        symbols at the pattern's end, so a stretch takes at most two steps a symbol.
        """
        out = np.zeros(int(size.sum()), np.int32)
        to = np.r_[0, np.cumsum(size)][:-1]
        at, q = size - 1, np.zeros(len(size), np.int64)
        low, high = np.zeros(len(size), np.int64), np.full(len(size), self.size)
        live = at >= 0
        begin, to, at, q, low, high = (v[live] for v in (begin, to, at, q, low, high))
        while len(at):
            a, b = self.extend(text[begin + at], low, high)
            good = self.weight[b] - self.weight[a] >= least
            done = good | (q == 0)
            up, down, shorter = self.parent(low, high)
            out[to[done] + at[done]] = np.where(good, q + 1, 0)[done]
            low = np.where(good, a, np.where(done, 0, up))
            high = np.where(good, b, np.where(done, self.size, down))
            q = np.where(good, q + 1, np.where(done, 0, shorter))
            at = at - done
            live = at >= 0
            if not live.all():
                begin, to, at, q, low, high = (v[live] for v in (begin, to, at, q, low, high))
        return out


def repeated_windows(flat: np.ndarray, sizes: np.ndarray, x: dict[str, np.ndarray], window: int = WINDOW) -> np.ndarray:
    """For the windows of all segments which occur twice or more, a segment standing for as many as c says: those from which the matching statistics reach the window's length."""
    values, symbols = np.unique(flat, return_inverse=True)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    at = np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)
    text, weight = np.zeros(len(flat) + len(sizes), np.int64), np.zeros(len(flat) + len(sizes), np.int64)
    text[at], weight[at] = symbols + 1, np.repeat(x["c"], sizes)
    index = FMIndex(text, len(values) + 1, int(sizes.max()), weight)
    reach = index.matching_statistics(text, begin, sizes)
    return reach[inside(np.cumsum(sizes) - sizes, sizes - window + 1)] >= window


def drop_repeated_words(docs: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For every row: key, n_words, n_removed, spans (removed runs of words, as (s, e), e exclusive) and kept (the other words, joined by one space).

    A word goes if a window of that many consecutive words covers it whose
    sequence also starts at any other place, in any document or the same; rows that
    repeat a document are places of their own. Texts with fewer words than a
    window lose nothing; null counts as empty. Null keys stay null; keys may be of any
    type that can be ordered. Texts of any length are whole. An empty table gives an
    empty table; other columns of docs play no part.
    """
    units = Units(window, min(ANCHOR, window // 2 + 1), True, SHARD_WORDS)
    kind = docs.schema[key].dataType
    docs, names = long_keys(docs, key, text)
    dealt, flags = find(docs, units, lambda codes, sizes, x: repeated_windows(codes, sizes, x, window), False, text, key)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts, ranges in texts_with_ranges(batch):
                n_words, removed, runs, out = [], [], [], []
                for t, r in zip(texts, ranges, strict=True):
                    words = t.split()
                    spans = covered(len(words), r, window) if r else []
                    kept, last = [], 0
                    for s, e in spans:
                        kept += words[last:s]
                        last = e
                    n_words.append(len(words))
                    removed.append(sum(e - s for s, e in spans))
                    runs.append(spans)
                    out.append(b" ".join(kept + words[last:]).decode())
                yield pa.RecordBatch.from_arrays([batch.column("d").slice(a, b - a), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), spans_array(runs), pa.array(out, pa.string())], names=["d", "n_words", "n_removed", "spans", "kept"])

    out = dealt.join(flags, ["d", "frag"], "left").select("d", "t", "ranges").mapInArrow(finish, "d long, n_words long, n_removed long, spans array<struct<s:long,e:long>>, kept string")
    return by_key(out, key, kind, names)


def spans_array(runs: list[list[tuple[int, int]]]) -> pa.Array:
    flat = [x for r in runs for x in r]
    ends = pa.StructArray.from_arrays([pa.array([s for s, _ in flat], pa.int64()), pa.array([e for _, e in flat], pa.int64())], names=["s", "e"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in runs])], pa.int32()), ends)


def by_key(out: DataFrame, key: str, kind: DataType, names: DataFrame | None) -> DataFrame:
    """The rows of out (d, …) by the key that d stands for."""
    value = F.when(F.col("d") != LAST_KEY, F.col("d"))
    rest = [c for c in out.columns if c != "d"]
    return named_keys(out.select((value if names else value.cast(kind)).alias(key), *rest), names, key)
