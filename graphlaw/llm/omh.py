"""Document fingerprints by order min hash, in DataFrame operations only.

The k-mers of a text's tokens get occurrence numbers (the second equal k-mer is
another element than the first), and their hashes order them: by a bin, then by
the rest. Every bin begins an order of its own, which runs from there round the
circle of bins; its two least k-mers are selected, put back into text order, and
hashed as one tuple, so every text has as many tuples of two k-mers as there are
orders. The share of equal tuples of two texts falls with moved as well as with
changed passages, as edit distance does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlaw.llm.common import numbered, text_of, words_of

#: Bits of a bin's number, of a hash and of a position (no array is longer) in one packed long; bits of a tuple in a fingerprint.
BIN, HASH, POS, TUPLE = 6, 26, 31, 16
ORDERS = 1 << BIN
#: Texts of fewer words are cut into code points.
LEAST_WORDS = 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being computed once a row however often body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens_of(text: Column) -> Column:
    return let(words_of(text), lambda w: F.when(F.size(w) >= LEAST_WORDS, w).otherwise(F.filter(F.split(text, ""), lambda c: c != "")))


def _packed(kmer: Column, nth: Column, pos: Column) -> Column:
    h = F.xxhash64(kmer, nth).bitwiseAND((1 << (BIN + HASH)) - 1)
    return F.shiftleft(h, POS).bitwiseOR(pos.cast("long"))


def _elements(kmers: Column) -> Column:
    """Packed (hash of k-mer and occurrence number, position) of each k-mer."""

    def numbered(k: Column) -> Column:
        # equal k-mers lie together once sorted; the first of each run is found by pointer doubling
        pairs = F.array_sort(F.transform(k, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def after(s: Column) -> Column:
            back = F.transform(s, lambda p, j: F.when(p["x"] == F.get(s, j - 1)["x"], j - 1).otherwise(j))
            rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(s))).cast("int"))
            first = F.aggregate(rounds, back, lambda b, _: F.transform(b, lambda j: F.get(b, j)))
            return let(first, lambda f: F.transform(s, lambda p, j: _packed(p["x"], j - F.get(f, j), p["i"])))

        return let(pairs, after)

    return let(kmers, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.transform(k, lambda x, i: _packed(x, F.lit(0), i))).otherwise(numbered(k)))


def fingerprint(text: Column, k: int = 3) -> Column:
    """The signature of a text: an array of ORDERS shorts, a tuple for each order; empty for a text without tokens.

    Tokens are words, or code points where there are fewer than LEAST_WORDS
    words; the last k-1 k-mers are cut short by the end, so short texts have
    k-mers as well. The one k-mer of a text of one token is a tuple by itself. Of
    equal hashes the one further left is the less.
    """

    def kmers(h: Column) -> Column:
        return F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))

    def bin_of(x: Column) -> Column:
        return F.shiftright(x, HASH + POS).cast("int")

    def select(s: Column) -> Column:
        """The two least of every bin: no order selects others."""
        return F.filter(s, lambda x, j: (j < 2) | (bin_of(F.get(s, j - 2)) != bin_of(x)))

    def tuples(t: Column) -> Column:
        mask = (1 << POS) - 1
        code = lambda x: F.shiftright(x, POS)

        def one(x: Column, j: Column) -> Column:
            """The tuple of the orders that begin after the last bin and up to x's, once for each."""
            y = F.get(t, (j + 1) % F.size(t))
            ahead = x.bitwiseAND(mask) < y.bitwiseAND(mask)
            h = F.when(F.size(t) == 1, F.xxhash64(code(x))).when(ahead, F.xxhash64(code(x), code(y))).otherwise(F.xxhash64(code(y), code(x)))
            orders = F.when(j == 0, bin_of(x) + 1).otherwise(bin_of(x) - bin_of(F.get(t, j - 1)))
            short = (h.bitwiseAND((1 << TUPLE) - 1) - (1 << (TUPLE - 1))).cast("short")
            return F.when(orders > 0, F.array_repeat(short, orders)).otherwise(F.array().cast("array<short>"))

        # the orders that begin after the last bin run on to the first
        return let(F.flatten(F.transform(t, one)), lambda f: F.when(F.size(f) == 0, f).otherwise(F.concat(f, F.array_repeat(F.get(f, F.lit(0)), F.lit(ORDERS) - F.size(f)))))

    hashes = F.transform(tokens_of(text), lambda w: F.xxhash64(w))
    elements = let(hashes, lambda h: _elements(kmers(h)))
    return let(let(F.sort_array(elements), select), tuples)


def likeness(a: Column, b: Column) -> Column:
    """The share of orders with equal tuples; 1 for two texts without tokens, 0 for one without and one with."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when(F.size(a) != F.size(b), 0.0).when(F.size(a) == 0, 1.0).otherwise(same / ORDERS)


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x.cast("long") + (1 << (TUPLE - 1))), TUPLE // 4, "0")), "")


def edited_by_next(docs: DataFrame, value: Callable[[Column], Column], key: str = "doc_id", text: str = "text", rows_per_task: int = 500_000) -> DataFrame:
    """For every row of docs: key, text, value(text), edited, edited_value and next_value.

    The next row is that with the next lower key (nulls lowest; after the lowest the
    highest); rows of equal keys are in the order of a hash of their texts, those
    that repeat key and text follow one another. edited is the text whose last third (rounded down)
    is replaced by as much of the next one's beginning, or all of it. A single row
    is its own next; null texts are empty; keys may be of any type that can be
    ordered; an empty table gives an empty table.

    Rows are numbered in order without their texts. Each different text then moves
    once; only the piece of it that its predecessor wants moves again.
    """
    t = text_of(docs, text)
    name = lambda *seed: F.xxhash64(*seed, docs[key], docs[key].isNull(), t)
    base = docs.select(docs[key].alias("__key"), t.alias("__text"), name().alias("__a"), name(F.lit(1)).alias("__b"))
    short = base.groupBy("__a", "__b").agg(F.first("__key").alias("__key"), F.first(F.xxhash64("__text")).alias("__h"), F.first(F.length("__text")).alias("__n"), F.count(F.lit(1)).alias("__rows"))
    order = [F.col("__key").desc_nulls_last(), F.col("__h").desc(), F.col("__a"), F.col("__b")]
    short = numbered(short, order, "__i", rows_per_task)
    count = short.count()
    third = F.floor(F.col("__n") / 3).cast("int")
    wants = short.select(((F.col("__i") + 1) % F.lit(max(1, count))).alias("__i"), F.col("__a").alias("__to_a"), F.col("__b").alias("__to_b"), third.alias("__third"))
    wants = short.select("__i", "__a", "__b").join(wants, "__i").drop("__i")
    # both uses below read one exchange; the texts' values are computed before it
    own = base.select("__a", "__b", "__text", value(F.col("__text")).alias("__value")).groupBy("__a", "__b").agg(F.first("__text").alias("__text"), F.first("__value").alias("__value"))
    given = own.join(wants, ["__a", "__b"]).select(F.col("__to_a").alias("__a"), F.col("__to_b").alias("__b"), F.struct(F.left("__text", F.col("__third")).alias("piece"), F.col("__value").alias("value"), F.lit(1).cast("long").alias("rows")).alias("__next"))
    whole = own.join(short.select("__a", "__b", "__key", "__n", "__rows"), ["__a", "__b"]).join(given, ["__a", "__b"])
    # of rows that repeat key and text all but the last are followed by their like
    like = F.struct(F.left("__text", third).alias("piece"), F.col("__value").alias("value"), (F.col("__rows") - 1).alias("rows"))
    nexts = F.when(F.col("__rows") > 1, F.array("__next", like)).otherwise(F.array("__next"))
    rows = whole.select("__key", "__text", "__value", "__n", F.explode(nexts).alias("__next"))
    edited = F.concat(F.left("__text", F.col("__n") - third), "__next.piece")
    rows = rows.select("__key", "__text", "__value", edited.alias("edited"), F.col("__next.value").alias("next_value"), F.col("__next.rows").alias("__rows"))
    rows = rows.withColumn("edited_value", value(F.col("edited")))
    names = [F.col("__key").alias(key), F.col("__text").alias(text), F.col("__value").alias("value"), "edited", "edited_value", "next_value"]
    return rows.select(*names, F.explode(F.array_repeat(F.lit(0), F.col("__rows").cast("int"))).alias("__each")).drop("__each")
