"""Suffix-array dedup by grouping suffixes.

The suffix array of each shard is built in two linear phases without recursion
and without renaming. First, suffixes that share their longest Lyndon prefix are
gathered into groups: groups are taken in descending order, every member points
to the nearest place on its left that lies in a lower group, and the places
pointed to move up within their groups by how many members point to them. Then
groups are filled in ascending order: each suffix emitted brings the one before it, and along the
pointers those that follow from it, to the front of their groups.

Symbols are blocks of bytes that are aligned to a segment's anchor, as equal
windows are; runs of the array with a common prefix, with hashes of the bytes left
over at both ends, give equal windows, whose bytes are then compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphlaw.llm.arrays import LETTERS, U, mixed
from graphlaw.llm.common import long_keys
from graphlaw.llm.fmindex import by_key, spans_array
from graphlaw.llm.repeats import Units, covered, find, stretch, sums_of, texts_with_ranges

WINDOW, ANCHOR, BLOCK, SHARD_BYTES = 100, 32, 33, 2 << 20


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of a text of non-negative ints whose last one is smaller than all others."""
    n = len(text)
    if not n:
        return []
    size = [0] * (max(text) + 1)
    for c in text:
        size[c] += 1
    first, total = [], 0
    for s in size:
        first.append(total)
        total += s
    group = [first[c] for c in text]  # a group is named by its first place
    held = [0] * n  # members by place
    place = [0] * n
    count = [0] * n  # members of the group that begins at a place
    for i in range(n):
        g = group[i]
        place[i] = at = g + count[g]
        held[at] = i
        count[g] += 1
    before = [-1] * n
    end = n
    while end > 0:
        g = group[held[end - 1]]
        if end - g == 1:
            i = held[g]
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            moves = ((j,),) if j >= 0 else ()
        else:
            times: dict[int, int] = {}
            for i in sorted(held[g:end]):
                j = i - 1
                while j >= 0 and group[j] >= g:
                    j = before[j]
                before[i] = j
                if j >= 0:
                    times[j] = times.get(j, 0) + 1
            if len(times) < 2:
                moves = (tuple(times),) if times else ()
            else:
                by: dict[int, list[int]] = {}
                for j, t in times.items():
                    by.setdefault(t, []).append(j)
                moves = tuple(by[t] for t in sorted(by, reverse=True))
        for members in moves:
            # they leave their groups and become new groups right above what stays
            left: dict[int, list[int]] = {}
            for j in members:
                old = group[j]
                count[old] -= 1
                to, was = old + count[old], place[j]
                other = held[to]
                held[was], place[other] = other, was
                held[to], place[j] = j, to
                left.setdefault(old, []).append(j)
            for old, moved in left.items():
                new = old + count[old]
                if new != old:
                    for j in moved:
                        group[j] = new
                count[new] = len(moved)
        end = g
    out = [-1] * n
    next_ = list(range(n))
    done = bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    next_[group[n - 1]] += 1
    for at in range(n):
        s = out[at] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[next_[g]] = s
            next_[g] += 1
            done[s] = 1
            s = before[s]
    return out


def earlier_windows(flat: np.ndarray, sizes: np.ndarray, x: dict[str, np.ndarray], window: int = WINDOW, block: int = BLOCK) -> np.ndarray:
    """For the windows of all segments, which are in the order of their first occurrences (d, p), which stand earlier in this or another segment."""
    begin = np.cumsum(sizes) - sizes
    sums = sums_of(LETTERS[flat])
    skip = x["off"] % block  # bytes before the first block
    blocks = (sizes - skip) // block
    seg = np.repeat(np.arange(len(sizes)), blocks)
    nth = np.arange(len(seg)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    names, symbol = np.unique(stretch(sums, begin[seg] + skip[seg] + nth * block, block), return_inverse=True)
    own = np.cumsum(blocks + 1) - (blocks + 1)  # where a segment's symbols begin; a separator follows them
    text = np.ones(int(blocks.sum()) + len(sizes) + 1, np.int64)
    text[own[seg] + nth] = symbol + 2
    text[-1] = 0
    array = np.array(suffix_array(text.tolist()))
    # runs of the array with m symbols in common, none of them a separator
    most = window // block
    padded = np.r_[text, np.zeros(most, np.int64)]
    same = np.ones(len(array), bool)
    runs = {}
    for m in range(1, most + 1):
        a, b = padded[array + m - 1], padded[np.r_[array[:1], array[:-1]] + m - 1]
        same = same & (a == b) & (a > 1)
        same[0] = False
        if m >= most - 1:
            runs[m] = np.empty(len(array), np.int64)
            runs[m][array] = np.cumsum(~same)
    n = sizes - window + 1
    owner = np.repeat(np.arange(len(sizes)), n)
    j = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    lead = (skip[owner] - j) % block
    full = (window - lead) // block
    start = own[owner] + (j + lead - skip[owner]) // block
    name = np.where(full == most, runs[most][start], runs.get(most - 1, runs[most])[start])
    at = begin[owner] + j
    left = stretch(sums, at, lead)
    right = stretch(sums, at + lead + full * block, window - lead - full * block)
    key = mixed(mixed(mixed(name.astype(np.uint64) * U(8) + full.astype(np.uint64)) + left) + right + lead.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    head = np.empty(len(order), np.int64)
    head[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    bad = head != np.arange(len(head))
    # hashes named the windows; their bytes decide. Where a window follows one that equals its head's forerunner, only its last byte is new
    follows = np.zeros(len(bad), bool)
    follows[1:] = bad[1:] & bad[:-1] & (at[1:] == at[:-1] + 1) & (at[head[1:]] == at[head[:-1]] + 1)
    wrong = [i[flat[at[i] + window - 1] != flat[at[head[i]] + window - 1]] for i in (np.flatnonzero(bad & follows),)]
    fresh = np.flatnonzero(bad & ~follows)
    for part in np.array_split(fresh, 1 + len(fresh) // 100_000):
        wrong.append(part[(flat[at[part][:, None] + np.arange(window)] != flat[at[head[part]][:, None] + np.arange(window)]).any(1)])
    # two windows at one place of texts of one key are no repeats of one another
    d, p = x["d"][owner], x["p"][owner] + j
    bad &= (d > d[head]) | (p > p[head])
    for k in np.unique(key[np.concatenate(wrong)]):
        seen: dict[bytes, int] = {}
        for i in order[key[order] == k].tolist():
            first = seen.setdefault(flat[at[i] : at[i] + window].tobytes(), i)
            bad[i] = (d[first], p[first]) < (d[i], p[i])
    return bad


def drop_earlier_bytes(docs: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For every row: key, n_bytes, n_removed, spans (removed runs of UTF-8 bytes, as (s, e), e exclusive) and kept (the other bytes).

    A byte goes if a string of that many bytes covers it which also starts
    earlier: in a lower key, or in the same key further left. Rows of equal key and
    text are one document in this sense. Shorter texts lose nothing; null counts as
    empty. Null keys stay null and come after all others; keys may be of any type that
    can be ordered. Texts of any length are whole. An empty table gives an empty
    table; other columns of docs play no part.
    """
    units = Units(window, min(ANCHOR, window // 2 + 1), False, SHARD_BYTES)
    block = max(1, window // 3)
    kind = docs.schema[key].dataType
    docs, names = long_keys(docs, key, text)
    dealt, flags = find(docs, units, lambda codes, sizes, x: earlier_windows(codes, sizes, x, window, block), True, text, key)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts, ranges in texts_with_ranges(batch):
                removed, runs, out = [], [], []
                for t, r in zip(texts, ranges, strict=True):
                    spans = covered(len(t), r, window) if r else []
                    kept, last = [], 0
                    for s, e in spans:
                        kept.append(t[last:s])
                        last = e
                    removed.append(sum(e - s for s, e in spans))
                    runs.append(spans)
                    out.append(b"".join([*kept, t[last:]]))
                yield pa.RecordBatch.from_arrays([batch.column("d").slice(a, b - a), pa.array(map(len, texts), pa.int64()), pa.array(removed, pa.int64()), spans_array(runs), pa.array(out, pa.binary())], names=["d", "n_bytes", "n_removed", "spans", "kept"])

    out = dealt.join(flags, ["d", "frag"], "left").select("d", "t", "ranges").mapInArrow(finish, "d long, n_bytes long, n_removed long, spans array<struct<s:long,e:long>>, kept binary")
    return by_key(out, key, kind, names)
