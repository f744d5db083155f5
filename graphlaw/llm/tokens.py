"""Token counts by rank-synchronous merging over ragged arrays.

The vocabulary file is never trained nor copied; its path is a parameter. Each
Arrow batch is cut into pre-tokens; the distinct ones not met before are laid
out as one ragged symbol array, and in every round each sequence applies its own
lowest-ranked pair at all its places at once. The symbols that survive are the
tokens.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlaw.llm.common import text_of

NONE = np.int32(2**31 - 1)
#: Pre-tokens kept with their counts by each worker, and the longest kept.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 64
#: Bytes of pre-tokens merged together.
BLOCK_BYTES = 4_000_000
#: Fixed value: the splitting pattern of byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    shifted = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


class MergeTable:
    """Pairs of symbol ids with their rank and the id that they make; ids 0 to 255 are the bytes."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or not pre.get("use_regex", True):
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        self.prefix_space = bool(pre.get("add_prefix_space"))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens with lstrip, rstrip or single_word are not supported")
        ids = {c: b for c, b in byte_letters().items()}
        left, right, made = [], [], []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left.append(ids[a])
            right.append(ids[b])
            made.append(ids.setdefault(a + b, len(ids)))
        self.size = len(ids)
        key = np.array(left, np.int64) * self.size + np.array(right, np.int64)
        first = np.unique(key, return_index=True)
        self.key, self.rank = first[0], first[1].astype(np.int32)
        self.made = np.array(made, np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.full(len(left), NONE)
        want = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.rank[at], NONE)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each piece after all merges."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = np.zeros(len(pieces), np.int64)
        sym = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int32)
        own = np.repeat(np.arange(len(pieces)), lens)
        if not len(sym):
            return out
        rank = np.full(len(sym), NONE)
        inside = np.flatnonzero(own[:-1] == own[1:])
        rank[inside] = self.ranks(sym[inside], sym[inside + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            done = least == NONE
            if done.any():
                out[own[starts[done]]] = sizes[done]
                live = np.repeat(~done, sizes)
                sym, own, rank = sym[live], own[live], rank[live]
                least, sizes = least[~done], sizes[~done]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            # of overlapping places (the pair of one symbol with itself) every second one counts, from the left
            begins = np.flatnonzero(np.r_[True, np.diff(hit) != 1])
            nth = np.arange(len(hit)) - np.repeat(begins, np.diff(np.r_[begins, len(hit)]))
            hit = hit[nth % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            now = hit - np.arange(len(hit))
            sym, own, rank = sym[keep], own[keep], rank[keep]
            for at in (now, now[now > 0] - 1):
                rank[at] = NONE
                at = at[at + 1 < len(sym)]
                at = at[own[at] == own[at + 1]]
                rank[at] = self.ranks(sym[at], sym[at + 1])
        return out


class TokenCounter:
    """Token counts of whole texts; special strings inside a text are one token each and cut it, as the library does by default."""

    def __init__(self, table: MergeTable):
        import regex

        self.table, self.known = table, {}
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(table.special, key=len, reverse=True))).split if table.special else None

    def pieces(self, text: str) -> tuple[list[str], int]:
        parts = self.cut(text) if self.cut else [text]
        if self.table.prefix_space:
            parts = [p if not p or p[0].isspace() else f" {p}" for p in parts]
        found = self.find(parts[0])
        for p in parts[1:]:
            found += self.find(p)
        return found, len(parts) - 1

    def learn(self, new: list[str]) -> dict[str, int]:
        got, block, size = {}, [], 0
        for piece in [*new, None]:
            if piece is None or size > BLOCK_BYTES:
                got.update(zip(block, self.table.count([b.encode() for b in block]).tolist(), strict=True))
                block, size = [], 0
            if piece is not None:
                block.append(piece)
                size += len(piece)
        return got

    def counts(self, texts: list[str]) -> list[int]:
        cut = [(Counter(found), n) for found, n in map(self.pieces, texts)]
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        known = self.known
        new = self.learn(list(dict.fromkeys(p for c, _ in cut for p in c if p not in known)))
        out = [n + sum(k * (known[p] if p in known else new[p]) for p, k in c.items()) for c, n in cut]
        known.update((p, k) for p, k in new.items() if len(p) <= CACHE_CHARS)
        return out


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) in place of its text.

    A null text counts as empty: 0 bytes, 0 tokens. Texts of any length are
    counted whole. Repeated rows keep their own rows. Columns of docs named like
    the new ones are replaced. An empty table gives an empty table.
    """
    table = MergeTable(path)
    rest = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    base = docs.select(*[docs[c] for c in rest], text_of(docs, text).alias("__text"))
    schema = base.drop("__text").schema.add("n_bytes", "long").add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(table)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column("__text")
                n = counter.counts(texts.to_pylist())
                sizes = pa.compute.binary_length(texts.cast(pa.binary())).cast(pa.int64())
                columns = [part.column(c) for c in range(len(rest))] + [sizes, pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*rest, "n_bytes", "n_tokens"])

    import pyarrow.compute  # noqa: F401  (pa.compute on the executors)

    return base.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
