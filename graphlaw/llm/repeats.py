"""Passages that stand more than once, found exactly and without comparing documents.

Texts are sequences of units (bytes or words). Of every window of a fixed length
the k units of the least hash are its anchor; equal windows have equal anchors,
and neighbouring windows mostly share one, so a document becomes a few segments:
the windows of one anchor, one after another. Anchors only route: segments whose
anchor occurs once hold no repeat and go no further, segments of equal content
become one with their number as weight, and all others are dealt to shards by anchor.
An index is built for each shard (the kernels of the two operators that use this
module) and decides which windows are repeats. Where one anchor has more different
segments than a shard takes, its windows are told apart by longer anchors, each
twice as near to the whole window, until every anchor's segments fit; so no task
holds an unbounded group and no pairs are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlaw.llm.arrays import LETTERS, M2, Powers, Texts, U, Words, mixed, slices
from graphlaw.llm.common import drop, text_of, written

#: Text worked on at a time, bits of a position there, windows of one text at a time.
BLOCK, POSITION, CHUNK = 1 << 16, 24, 1 << 22
#: Different segments that share an anchor; of more, the anchors are made longer.
SHARD_SEGMENTS = 4000
#: A place: first window in the high 32 bits, the anchor's distance from there and the number of windows in 16 bits each.
OFF, SHORT = 16, (1 << 16) - 1
#: Key of rows without one: after all others.
LAST_KEY = 2**63 - 1


@dataclass(frozen=True)
class Units:
    """window and anchor: lengths in units; by_words: units are words, else bytes; shard: units indexed together, about."""

    window: int
    anchor: int
    by_words: bool
    shard: int

    def __post_init__(self) -> None:
        if not 0 < self.anchor <= self.window or self.reach > SHORT:
            raise ValueError(f"windows of {self.window} units aren't supported")

    @property
    def reach(self) -> int:
        return self.window - self.anchor + 1

    def of(self, column: pa.Array, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the units of rows a to b of a column, and where each text begins."""
        texts = Texts(column, a, b)
        if self.by_words:
            words = Words(texts)
            return words.hash, words.first
        return LETTERS[texts.data], texts.edges


def placed(p: np.ndarray, off: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (p.astype(np.int64) << 32) | (off.astype(np.int64) << OFF) | n


def parts_of(place: np.ndarray) -> dict[str, np.ndarray]:
    return {"p": place >> 32, "off": place >> OFF & SHORT, "n": place & SHORT}


def sums_of(codes: np.ndarray) -> np.ndarray:
    up, _ = Powers.upto(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def stretch(sums: np.ndarray, begin: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Hashes of the stretches of units."""
    _, down = Powers.upto(len(sums))
    return mixed((sums[begin + size] - sums[begin]) * down[begin] + np.asarray(size).astype(np.uint64) * M2)


def segments(codes: np.ndarray, edges: np.ndarray, units: Units) -> dict[str, np.ndarray]:
    """The segments of some texts: doc, place (first window, the anchor's distance from there, windows), a (hash of the anchor), s (hash of the content)."""
    out = []
    for lo, hi, doc in _pieces(edges, units):
        part = codes[lo:hi]
        if len(part) < units.window:
            continue
        sums = sums_of(part)
        count = len(part) - units.anchor + 1
        _, down = Powers.upto(len(sums))
        kmer = mixed((sums[units.anchor :] - sums[:count]) * down[:count] + np.full(1, units.anchor, np.uint64) * M2)
        # the least of each stretch of reach anchors, leftmost first: the hash's high bits, then the place
        least, have = (kmer & ~U((1 << POSITION) - 1)) | np.arange(count, dtype=np.uint64), 1
        while have * 2 <= units.reach:
            least, have = np.minimum(least[: len(least) - have], least[have:]), have * 2
        rest = units.reach - have
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        at = (least & U((1 << POSITION) - 1)).astype(np.int64)
        starts = np.arange(len(at))
        if doc is None:
            inner = np.clip(edges, lo, hi) - lo
            own = np.searchsorted(inner, starts, "right") - 1
            ok = starts + units.window <= inner[own + 1]
            starts, at, own = starts[ok], at[ok], own[ok]
        else:
            own = np.full(len(at), doc)
        if not len(at):
            continue
        new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        n = np.diff(np.r_[new, len(at)])
        p, anchor = starts[new], at[new]
        s = stretch(sums, p, n + (units.window - 1))
        place = placed(p + lo - edges[own[new]], anchor - p, n)
        out.append((own[new], place, kmer[anchor].view(np.int64), s.view(np.int64)))
    names = ("doc", "place", "a", "s")
    if not out:
        return {x: np.zeros(0, np.int64) for x in names}
    return {x: np.concatenate(c) for x, c in zip(names, zip(*out, strict=True), strict=True)}


def _pieces(edges: np.ndarray, units: Units) -> Iterator[tuple[int, int, int | None]]:
    """Stretches of units that are worked on together: all texts at once, or long ones in overlapping parts."""
    if edges[-1] - edges[0] <= CHUNK:
        yield int(edges[0]), int(edges[-1]), None
        return
    for d in range(len(edges) - 1):
        lo, hi = int(edges[d]), int(edges[d + 1])
        for at in range(lo, max(lo + 1, hi - units.window + 1), CHUNK):
            yield at, min(hi, at + CHUNK + units.window - 1), d


def longer_anchors(content: list[np.ndarray], place: np.ndarray, core: np.ndarray, units: Units) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """Two parts of each segment by longer anchors: (segment, its first window in it, place's off and n, length of the anchor, hash of the anchor, hash of the content).

    Every window holds the anchor and slack more units, so it reaches half of them
    further on the left, or more than the other half on the right. Equal windows go the
    same way, by equal anchors; an anchor of a whole window has one content only.
    """
    x = parts_of(place)
    for i, codes in enumerate(content):
        sums = sums_of(codes if units.by_words else LETTERS[codes])
        off, n, length = int(x["off"][i]), int(x["n"][i]), int(core[i])
        slack = units.window - length
        far = -(-slack // 2)
        left = min(max(off - far + 1, 0), n)
        for first, windows, at, size in ((0, left, off - far, length + far), (left, n - left, off - left, length + slack // 2 + 1)):
            if windows:
                anchor, whole = (int(stretch(sums, np.array([b]), s).view(np.int64)[0]) for b, s in ((first + at, size), (first, windows + units.window - 1)))
                yield i, first, at, windows, size, anchor, whole


def inside(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of some stretches, one after another."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


def runs_of(bad: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of windows that hold, segments having n each: (segment, first window, windows)."""
    ends = np.cumsum(n)
    cut = np.zeros(len(bad) + 1, bool)
    cut[np.r_[0, ends]] = True
    before, after = np.r_[False, bad[:-1]] & ~cut[:-1], np.r_[bad[1:], False] & ~cut[1:]
    start, last = np.flatnonzero(bad & ~before), np.flatnonzero(bad & ~after)
    owner = np.searchsorted(ends, start, "right")
    return owner, start - (ends - n)[owner], last - start + 1


def find(docs: DataFrame, units: Units, kernel: Callable[[np.ndarray, np.ndarray, dict[str, np.ndarray]], np.ndarray], later_only: bool, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(docs, flags). docs: d, frag (64-bit hash of the text, which tells texts of one key apart), t, partitioned by d, frag; flags: d, frag and ranges, an array of (s, n): n windows from unit s on are repeats.

    later_only: a window is a repeat if an equal one starts in a lower key, or in
    the same key further left; else if an equal one starts at any other place.
    kernel(codes, sizes, columns) gets the codes (or bytes) of the different segments of
    a shard, one after another by d and p, and the columns d, p, off, n (of the first
    occurrence), c (occurrences), and tells for all windows of all segments which occur
    twice or more (later_only: which of the first occurrence's windows also stand earlier).
    Rows of equal key and equal text have equal ranges. key: a long column; null keys
    count as the largest, null texts as empty.
    """
    window = units.window
    t = text_of(docs, text)
    base = docs.select(F.coalesce(docs[key].cast("long"), F.lit(LAST_KEY)).alias("d"), F.xxhash64(t).alias("frag"), t.alias("t"))
    code = np.uint64 if units.by_words else np.uint8

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("t")
            d, frag = (batch.column(c).to_numpy() for c in ("d", "frag"))
            for a, b in slices(column, BLOCK):
                x = segments(*units.of(column, a, b), units)
                own = a + x["doc"]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x["a"], x["s"], d[own], frag[own], x["place"])], names=["a", "s", "d", "frag", "place"])

    anchors = base.mapInArrow(cut, "a long, s long, d long, frag long, place long")
    # a table of its own, so that the join deals both sides anew and can split a hot anchor
    twice = written(anchors.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a"), "twice")
    # all these tables grow with the corpus, so none is broadcast at any size
    repeated = written(anchors.join(twice.hint("merge"), "a"), "repeated")
    drop(twice)
    different = repeated.groupBy("a", "s").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("d", "place", "frag")).alias("first"))
    different = written(different.select("a", "s", "c", "first.d", "first.frag", "first.place"), "different")
    crowded = written(different.groupBy("a").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > SHARD_SEGMENTS).select("a"), "crowded")
    parts = max(1, base.sparkSession.sparkContext.defaultParallelism, int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = base.repartition(parts, "d", "frag")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, lists = batch.column("t"), batch.column("xs")
            for i, j in slices(column, 4 * BLOCK):
                texts, xs = Texts(column, i, j), lists.slice(i, j - i)
                if units.by_words:
                    words = Words(texts)
                    codes, edges = words.hash, words.first
                else:
                    codes, edges = texts.data, texts.edges
                x = xs.flatten()
                owner = np.repeat(np.arange(j - i), np.diff(xs.offsets.to_numpy()))
                at = parts_of(x.field("place").to_numpy())
                begin = edges[owner] + at["p"]
                end = begin + at["n"] + window - 1
                content = [codes[s:e].tobytes() for s, e in zip(begin.tolist(), end.tolist(), strict=True)]
                d = pa.array(batch.column("d").to_numpy()[i + owner])
                yield pa.RecordBatch.from_arrays([x.field("a"), x.field("s"), x.field("c"), d, x.field("place"), pa.array(content, pa.binary())], names=["a", "s", "c", "d", "place", "content"])

    kind = "a long, s long, c long, d long, place long, content binary"
    asked = lambda rows: rows.select("d", "frag", F.struct("a", "s", "c", "place").alias("x")).groupBy("d", "frag").agg(F.collect_list("x").alias("xs"))
    contents = lambda texts, asked: texts.join(asked, ["d", "frag"]).select("d", "frag", "t", "xs").mapInArrow(take, kind)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = list(batches)
        if not sum(b.num_rows for b in tables):
            return
        table = pa.Table.from_batches(tables).combine_chunks()
        x = {c: table.column(c).to_numpy() for c in ("a", "s", "c", "d", "place")}
        # rows that repeat key and text ask for a segment once each; the others by key and place
        order = np.lexsort((x["place"], x["d"], x["s"], x["a"]))
        same = [x[c][order][1:] == x[c][order][:-1] for c in ("a", "s")]
        keep = order[np.r_[True, ~(same[0] & same[1])]]
        keep = keep[np.lexsort((x["place"][keep], x["d"][keep]))]
        content = Texts(table.column("content").chunk(0))
        del tables, table
        x = {c: v[keep] for c, v in x.items()}
        x |= parts_of(x["place"])
        data = content.data.view(code)
        begin, size = content.edges[keep] // data.itemsize, (content.edges[keep + 1] - content.edges[keep]) // data.itemsize
        flat = data[inside(begin, size)]
        bad = kernel(flat, size, x)
        owner, first, n = runs_of(bad, x["n"])
        cols = [x["a"][owner], x["s"][owner], first, n, np.zeros(len(owner), np.int64), np.full(len(owner), -1)]
        if later_only:
            # all others of a kind stand later than the first
            whole = np.add.reduceat(bad, np.cumsum(x["n"]) - x["n"]) == x["n"]
            more = np.flatnonzero((x["c"] > 1) & ~whole)
            cols = [np.r_[u, v] for u, v in zip(cols, (x["a"][more], x["s"][more], np.zeros(len(more), np.int64), x["n"][more], x["d"][more], x["p"][more]), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in cols], names=["a", "s", "from", "n", "xd", "xp"])

    judged_as = "a long, s long, from long, n long, xd long, xp long"

    def judged(segments: DataFrame, total: int) -> DataFrame:
        """Ranges of windows that are repeats, by segment (a, s), at every occurrence but the one that starts at xd, xp."""
        return segments.repartition(max(parts, -(-int(total) // units.shard)), "a").mapInArrow(index, judged_as)

    units_in = lambda df: df.agg(F.coalesce(F.sum(F.col("place").bitwiseAND(SHORT) + window - 1), F.lit(0))).first()[0]
    hot = not crowded.isEmpty()
    easy = different.join(crowded.hint("merge"), "a", "left_anti") if hot else different
    found = judged(contents(dealt, asked(easy)), units_in(easy))
    if hot:
        # a size that the planner knows, so few texts are looked up without moving all
        wanted = written(asked(different.join(crowded, "a", "left_semi")), "asked")
        now = contents(base, wanted).dropDuplicates(["a", "s"]).select("a", "s", F.lit(0).cast("long").alias("shift"), "c", "d", "place", F.lit(units.anchor).alias("core"), "content")
        now = written(now, "crowd")
        while not now.isEmpty():
            now, more = _apart(now, units, code, judged)
            found = found.unionByName(more) if more is not None else found
    hits = repeated.join(found.withColumnRenamed("n", "k").hint("merge"), ["a", "s"])
    p = F.shiftright("place", 32)
    hits = hits.where((F.col("d") != F.col("xd")) | (p != F.col("xp")))
    hits = hits.select("d", "frag", F.struct((p + F.col("from")).cast("long").alias("s"), F.col("k").alias("n")).alias("x"))
    return dealt, hits.groupBy("d", "frag").agg(F.collect_list("x").alias("ranges"))


def _apart(now: DataFrame, units: Units, code: type, judged: Callable[[DataFrame, int], DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """One round of longer anchors for segments (a, s, shift, …, content): those whose anchors are still shared by too many, and what is judged of the others.

    A segment keeps the name (a, s) of the one that it is a part of, and shift, its first window there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.frombuffer(v.as_py(), code) for v in batch.column("content")]
            x = {c: batch.column(c).to_numpy() for c in ("a", "s", "shift", "c", "d", "place", "core")}
            rows = list(longer_anchors(codes, x["place"], x["core"], units))
            if not rows:
                continue
            i, first, off, n, core, anchor, whole = (np.array(v, np.int64) for v in zip(*rows, strict=True))
            place = placed((x["place"][i] >> 32) + first, off, n)
            content = [codes[k][f : f + m + units.window - 1].tobytes() for k, f, m in zip(i.tolist(), first.tolist(), n.tolist(), strict=True)]
            cols = [x["a"][i], x["s"][i], x["shift"][i] + first, x["c"][i], x["d"][i], place, core.astype(np.int32), anchor, whole]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(content, pa.binary())], names=["a", "s", "shift", "c", "d", "place", "core", "a2", "s2", "content"])

    parts = now.mapInArrow(run, "a long, s long, shift long, c long, d long, place long, core int, a2 long, s2 long, content binary")
    parts = written(parts, "parts")
    kinds = parts.groupBy("a2", "s2").agg(F.sum("c").alias("c"), F.min(F.struct("d", "place")).alias("first"))
    totals = kinds.groupBy("a2").agg(F.count(F.lit(1)).alias("m"), F.sum("c").alias("all")).where("all > 1").select("a2", "m")
    totals = written(totals, "anchors")
    fine = totals.where(F.col("m") <= SHARD_SEGMENTS).select("a2")
    # different segments of one anchor, each once, with the weight of all of its kind
    each = parts.join(fine, "a2", "left_semi").groupBy("a2", "s2").agg(F.sum("c").alias("c"), F.min(F.struct("d", "place")).alias("first"), F.first("content").alias("content"))
    each = written(each.select(F.col("a2").alias("a"), F.col("s2").alias("s"), "c", "first.d", "first.place", "content"), "kinds")
    total = each.agg(F.coalesce(F.sum(F.length("content")), F.lit(0))).first()[0] // np.dtype(code).itemsize
    more = None
    if total:
        said = judged(each, total).withColumnsRenamed({"a": "a2", "s": "s2"})
        names = parts.select("a", "s", "shift", "a2", "s2")
        # xp names the first window of the kind, a segment's name that of the whole: hence less its shift
        back = said.join(names, ["a2", "s2"]).select("a", "s", (F.col("from") + F.col("shift")).alias("from"), "n", "xd", F.when(F.col("xp") >= 0, F.col("xp") - F.col("shift")).otherwise(-1).alias("xp"))
        more = written(back, "judged")
    left = parts.join(totals.where(F.col("m") > SHARD_SEGMENTS).select("a2"), "a2", "left_semi")
    return written(left.select("a", "s", "shift", "c", "d", "place", "core", "content"), "crowd"), more


def covered(size: int, ranges: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """The maximal runs of units that repeated windows cover; ranges: (first window, number of windows)."""
    out: list[tuple[int, int]] = []
    for s, n in sorted(ranges):
        e = min(size, s + n + window - 1)
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def texts_with_ranges(batch: pa.RecordBatch, rows: int = 64) -> Iterator[tuple[int, int, list[bytes], list[list[tuple[int, int]]]]]:
    """Some rows at a time: (first, last, texts, ranges of each)."""
    for a in range(0, batch.num_rows, rows):
        b = min(a + rows, batch.num_rows)
        lists = batch.column("ranges").slice(a, b - a)
        at = np.r_[0, np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy())].tolist()
        flat = lists.flatten()
        pairs = list(zip(flat.field("s").to_pylist(), flat.field("n").to_pylist(), strict=True))
        yield a, b, batch.column("t").slice(a, b - a).cast(pa.binary()).to_pylist(), [pairs[x:y] for x, y in zip(at, at[1:])]
