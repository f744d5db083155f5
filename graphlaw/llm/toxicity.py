"""Toxicity by weak supervision.

Many voters, each a lexicon or a pattern, say toxic, clean, or nothing of a
text, labelled or not. Lexicons are learned on one half of the labelled rows and
vote on the other half and on unlabelled rows; a row's own label is one voter among
them. A generative label model (expectation maximisation over the unknown label)
estimates how often each voter says what under either label, and which voters
err together; correlated voters share their say. The posterior labels it gives
train a linear classifier on words, word beginnings and patterns, and that
classifier scores every whole text. Texts of the sample stay on the executors;
only which text has which of the chosen features reaches the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlaw.llm.common import drop, text_of, written

#: Bounds of the fit: rows of either label and without one, features, lexicon voters learned on a half.
ROWS_A_CLASS, MAX_FEATURES, MAX_VOTERS = 3000, 3000, 160
#: Texts of the sample that a feature must be in; standard errors that a voter's feature must be off by.
LEAST_SEEN, SURE = 4, 4.0
#: Numbers that incidence packs; highest byte first, so they sort as they are.
PLACE = np.dtype(">i4")
#: How often a given label is taken to be right.
LABEL_TRUST = 0.97
#: Characters of a word's beginning that are features of their own.
STEMS = (4, 5, 6, 7)
#: A small lexicon of insults to start from; the rest is learned from labelled rows.
INSULTS = frozenset("idiot moron stupid scum trash clown loser pathetic disgusting worthless dumb fool jerk vermin filth imbecile cretin bastard hateful garbage".split())
PATTERNS = {
    "shout": re.compile(r"\b[^\W\d_a-z]{3,}(?:\W+[^\W\d_a-z]{3,}){3}"),
    "exclaim": re.compile(r"!{2,}"),
    "you_are": re.compile(r"\byou(?:'re| are)\s+(?:an?\s+)?\w+", re.I),
    "threat": re.compile(r"\b(?:kill|hurt|destroy|hate)\s+(?:you|him|her|them|all)\b", re.I),
    "masked": re.compile(r"\b\w[*#@$]{2,}\w*\b"),
}
WORDS = re.compile(r"[^\W_]+")


def parts_of(word: str) -> tuple[str, ...]:
    return (word, *(f"{word[:n]}~" for n in STEMS if len(word) > n))


def features_of(text: str) -> set[str]:
    """Words (lower case), word beginnings and patterns of a whole text."""
    out: set[str] = set()
    for w in set(WORDS.findall(text.lower())):
        out.update(parts_of(w))
    out.update(f"!{name}" for name, p in PATTERNS.items() if p.search(text))
    if not INSULTS.isdisjoint(out):
        out.add("!insult")
    return out


class LabelModel:
    """A two-class generative model of votes (1 toxic, -1 clean, 0 silent), with shared say for voters that err together."""

    def __init__(self, prior: float, rounds: int = 25):
        self.prior, self.rounds = prior, rounds

    def _rates(self, votes: np.ndarray, q: np.ndarray) -> np.ndarray:
        """log P(vote | label), shape (label, vote + 1, voter)."""
        out = np.empty((2, 3, votes.shape[1]))
        for y, w in enumerate((1 - q, q)):
            for v in (-1, 0, 1):
                out[y, v + 1] = (w @ (votes == v) + 0.5) / (w.sum() + 1.5)
        return np.log(out)

    def posterior(self, votes: np.ndarray, evidence: np.ndarray | float = 0.0) -> np.ndarray:
        odds = np.full(len(votes), np.log(self.prior / (1 - self.prior))) + evidence
        for v in (-1, 0, 1):
            odds += (votes == v) @ ((self.rates[1, v + 1] - self.rates[0, v + 1]) * self.say)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def fit(self, votes: np.ndarray, labels: np.ndarray | None = None) -> LabelModel:
        """labels: 1, 0 or -1 (unknown) for each row; a label counts as one more voter, right LABEL_TRUST of the time, that never adapts. q: the posterior.

        The first guess is that voter where it speaks, else the majority of the
        others, near copies of a voter sharing one vote.
        """
        votes = votes.astype(np.int8)
        trust = np.log(LABEL_TRUST / (1 - LABEL_TRUST))
        evidence = np.zeros(len(votes)) if labels is None else np.where(labels == 1, trust, np.where(labels == 0, -trust, 0.0))
        x = votes - votes.mean(0)
        sd = np.maximum(x.std(0), 1e-9)
        alike = np.clip((x.T @ x / max(len(x), 1) / sd / sd[:, None] - 0.7) / 0.3, 0, 1)
        np.fill_diagonal(alike, 1)
        self.say = 1 / alike.sum(0)
        q = np.where(evidence != 0, evidence > 0, votes @ self.say > 0) * 0.96 + 0.02
        for n in range(self.rounds):
            self.rates = self._rates(votes, q)
            if n % 5 == 0:
                # correlations left when the label is known: what a voter says beyond its mean for that label
                self.correlation = np.zeros_like(alike)
                for w in (1 - q, q):
                    x = votes - (w @ votes) / max(w.sum(), 1e-9)
                    cov = (x * w[:, None]).T @ x / max(w.sum(), 1e-9)
                    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                    self.correlation = np.maximum(self.correlation, cov / sd / sd[:, None])
                share = np.clip((self.correlation - 0.3) / 0.7, 0, 1)
                np.fill_diagonal(share, 1)
                self.say = np.minimum(self.say, 1 / share.sum(0))  # else copies of a voter come to be the label
            q = self.posterior(votes, evidence)
        self.q = q
        return self


def logistic(x, q: np.ndarray, weight: np.ndarray, l2: float = 3e-4, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias for soft labels q, by accelerated gradient descent; x: (row indices, feature indices, n_features)."""
    rows, cols, n = x
    w, b = np.zeros(n), 0.0
    vw, vb, total = w.copy(), b, weight.sum()
    deg = np.bincount(rows, minlength=len(q)).max(initial=1)
    rate = 4.0 / (1 + 0.05 * deg)
    for t in range(steps):
        z = np.bincount(rows, vw[cols], len(q)) + vb
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - q) * weight
        nw = vw - rate * (np.bincount(cols, g[rows], n) / total + l2 * vw)
        nb = vb - rate * g.sum() / total
        m = t / (t + 3)
        vw, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    return w, float(b)


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float
    voters: list[str] = field(default_factory=list)
    accuracies: dict[str, float] = field(default_factory=dict)

    def score(self, texts: list[str]) -> list[float]:
        known, out = self.__dict__.setdefault("_known", {}), []
        if len(known) > 500_000:
            known.clear()
        get, weights = known.get, self.weights
        patterns = [(f"!{n}", p) for n, p in PATTERNS.items() if f"!{n}" in weights]
        for text in texts:
            found: set[str] = set()
            for w in set(WORDS.findall(text.lower())):
                parts = get(w)
                if parts is None:
                    parts = known[w] = tuple(p for p in parts_of(w) if p in weights) + (("!insult",) if w in INSULTS and "!insult" in weights else ())
                if parts:
                    found.update(parts)
            found.update(n for n, p in patterns if p.search(text))
            z = self.bias + sum(weights[f] for f in sorted(found))
            out.append(float(1 / (1 + np.exp(-max(-30.0, min(30.0, z))))))
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 5 == 0


def sample_of(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, rows_a_class: int) -> tuple[DataFrame, float | None]:
    """(rows, share of toxic labels): (key, y, half, text) of at most rows_a_class rows of either label and as many without (y -1), those of the least hashes of the key, as a table."""
    known = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("y")).where("key is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("key"))).groupBy("key").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    least = lambda df: df.orderBy(F.xxhash64("key"), "key").limit(rows_a_class)
    others = docs.select(docs[key].alias("key")).where(F.col("key").isNotNull() & ~held_out(F.col("key"))).join(known, "key", "left_anti")
    picked = [least(known.where(F.col("y") == y)) for y in (0, 1)] + [least(others.distinct()).withColumn("y", F.lit(-1))]
    sample = F.broadcast(picked[0].unionByName(picked[1]).unionByName(picked[2]))  # 3 * rows_a_class rows at most
    rows = docs.select(docs[key].alias("key"), text_of(docs, text).alias("text")).join(sample, "key")
    # of rows that share a key one text is taken
    rows = rows.groupBy("key").agg(F.first("y").alias("y"), F.min("text").alias("text"))
    half = F.when(F.col("y") < 0, -1).otherwise(F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(2)).cast("int"))
    prior = counts.get(1, 0) / sum(counts.values()) if counts else None
    return written(rows.select("key", "y", half.alias("half"), "text"), "sample"), prior


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, seen, p0, n0, p1, n1): texts of the sample that have each feature, and those of either label in either half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, y, half in zip(*(batch.column(c).to_pylist() for c in ("text", "y", "half")), strict=True):
                at = 0 if half < 0 else 1 + 2 * half + (1 - y)
                for f in features_of(text):
                    row = counts.setdefault(f, [0, 0, 0, 0, 0])
                    row[at] += 1
        if counts:
            cols = np.array(list(counts.values()), np.int64)
            arrays = [pa.array(list(counts)), pa.array(cols.sum(1)), *(pa.array(cols[:, i]) for i in range(1, 5))]
            yield pa.RecordBatch.from_arrays(arrays, names=["feature", "seen", "p0", "n0", "p1", "n1"])

    parts = sample.mapInArrow(run, "feature string, seen long, p0 long, n0 long, p1 long, n1 long")
    return parts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("seen", "p0", "n0", "p1", "n1")]).where(F.col("seen") >= LEAST_SEEN)


def incidence(sample: DataFrame, names: list[str]) -> list:
    """Rows (y, half, has): which of the named features each text of the sample has, by their places in names, as PLACE numbers; in the order of the keys' hashes.

    has is packed, since the driver would hold each number of a list as an object, in the JVM and in Python.
    """
    index = {n: i for i, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = [np.array(sorted(index[f] for f in features_of(t) if f in index), PLACE).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("y"), batch.column("half"), pa.array(has, pa.binary())], names=["h", "y", "half", "has"])

    rows = sample.withColumn("h", F.xxhash64("key")).select("h", "y", "half", "text").mapInArrow(run, "h long, y int, half int, has binary")
    return sorted(rows.collect(), key=lambda r: (r["h"], r["y"], r["has"]))


def fit_on(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", rows_a_class: int = ROWS_A_CLASS) -> ToxicityModel:
    """A model from rows of docs that aren't held out, labelled ones and others.

    The sample is bounded as sample_of says; the share of toxic rows is counted over
    all labels. Conflicting labels of one key count as toxic; null keys and labels are
    left out; texts of any length are whole. Without labels, or with fewer than 5 of either kind
    in either half, the built-in voters alone vote. Empty tables give a model of the
    built-in lexicon.
    """
    sample, prior = sample_of(docs, labels, text, key, label, rows_a_class)
    totals = {(r["y"], r["half"]): r["count"] for r in sample.groupBy("y", "half").count().collect()}
    if not totals:
        return ToxicityModel({"!insult": 6.0}, -3.0)
    prior = min(0.9, max(0.005, prior if prior is not None else 0.1))
    learned = all(totals.get((y, h), 0) >= 5 for y in (0, 1) for h in (0, 1))
    counts = written(feature_counts(sample), "features")
    of = lambda y, *halves: sum(totals.get((y, h), 0) for h in halves)

    def surplus(*halves: int) -> Column:
        """By how many standard errors the share of toxic texts with the feature is above that of clean ones."""
        p, n = (sum((F.col(f"{c}{h}") for h in halves), F.lit(0)) for c in "pn")
        toxic, calm = max(1, of(1, *halves)), max(1, of(0, *halves))
        share = (p + n + 0.5) / (toxic + calm + 1)
        return (p / toxic - n / calm) / F.sqrt(share * (1 - share) * (1 / toxic + 1 / calm))

    def ratio() -> Column:
        """How much more often toxic texts have the feature than clean ones: the logarithm of the rates' ratio, of either sign."""
        p, n = F.col("p0") + F.col("p1"), F.col("n0") + F.col("n1")
        return F.log((p + 0.3) / (of(1, 0, 1) + 0.6)) - F.log((n + 0.3) / (of(0, 0, 1) + 0.6))

    def best(value: Column, ok: Column, most: int) -> list[str]:
        return [r["feature"] for r in counts.where(ok).orderBy(value.desc(), "feature").limit(most).select("feature").collect()]

    lexicons, clean = ([[], []], [[], []]) if not learned else ([best(surplus(h), (surplus(h) > SURE) & (F.col(f"p{h}") >= LEAST_SEEN - 1), MAX_VOTERS) for h in (0, 1)], [best(-surplus(h), surplus(h) < -SURE, MAX_VOTERS // 4) for h in (0, 1)])
    built_in = ["!insult", *(f"!{p}" for p in PATTERNS)]
    known = {r["feature"] for r in counts.where(F.col("feature").isin(built_in)).select("feature").collect()}
    kept = best(F.abs(ratio()) * F.sqrt("seen") if learned else F.col("seen"), F.lit(True), MAX_FEATURES)
    kept = list(dict.fromkeys([*kept, *(f for f in built_in if f in known)]))
    names = list(dict.fromkeys([*kept, *lexicons[0], *lexicons[1], *clean[0], *clean[1]]))
    rows = incidence(sample, names)
    drop(sample, counts)

    index = {n: i for i, n in enumerate(names)}
    y, half = (np.array([r[c] for r in rows]) for c in ("y", "half"))
    cols = np.frombuffer(b"".join(r["has"] for r in rows), PLACE).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r["has"]) // PLACE.itemsize for r in rows])

    def has(features: list[str]) -> np.ndarray:
        """How many of the features each text has."""
        chosen = np.zeros(len(names) + 1, bool)
        chosen[[index[f] for f in features if f in index]] = True
        return np.bincount(row[chosen[cols]], minlength=len(rows))

    def fair(by_half: list[list[str]]) -> np.ndarray:
        """The same, by lexicons of the other half; rows of neither half by both."""
        a, b = map(has, by_half)
        return np.where(half == 0, b, np.where(half == 1, a, has(list({*by_half[0], *by_half[1]}))))

    voters: dict[str, np.ndarray] = {}
    for sign, name, lists in ((1, "lexicon", lexicons), (-1, "clean", clean)):
        for f in sorted({*lists[0], *lists[1]}):
            voters[f"{name}:{f}"] = (sign * (fair([[f] if f in x else [] for x in lists]) > 0)).astype(np.int8)
    for i in range(8):
        n = fair([x[i::8] for x in lexicons])
        voters |= {f"any:group{i}": (n > 0) * 1, f"two:group{i}": (n > 1) * 1, f"none:group{i}": (n == 0) * -1}
    voters |= {"insult": 2 * has(["!insult"]) - 1} | {p: has([f"!{p}"]) for p in PATTERNS}
    votes = np.stack([v.astype(np.int8) for v in voters.values()], 1)
    balanced = of(1, 0, 1) / max(1, len(rows)) if learned else prior
    model = LabelModel(min(0.95, max(0.02, balanced))).fit(votes, y if learned else None)
    q = model.q
    ok = cols < len(kept)  # kept come first among the names
    # both labels weigh alike, whatever their shares in the sample
    share = float(q.mean())
    weight = np.where(q >= 0.5, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
    w, b = logistic((row[ok], cols[ok], len(kept)), q, weight)
    rates = np.exp(model.rates)
    accuracy = {n: float(rates[1, 2, i] / (rates[1, 2, i] + rates[0, 2, i])) for i, n in enumerate(voters)}
    return ToxicityModel({f: float(w[i]) for i, f in enumerate(kept) if abs(w[i]) > 1e-3}, b, list(voters), accuracy)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", column: str = "score") -> DataFrame:
    """docs with the model's score (0 to 1) of every whole text, however long; null texts score as empty ones. Repeated rows stay; a column of that name is replaced; an empty table gives an empty table."""
    base = docs.drop(column).withColumn("__text", text_of(docs, text))
    names = base.columns[:-1]
    schema = base.drop("__text").schema.add(column, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                scores = model.score(part.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in range(len(names))), pa.array(scores, pa.float64())], names=[*names, column])

    return base.mapInArrow(run, schema)
