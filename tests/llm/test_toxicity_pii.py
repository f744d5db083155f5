import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from graphlaw.llm import pii, toxicity
from graphlaw.llm import queries as Q
from tests.conftest import DATA
from tests.llm.cases import COLUMNS, frame

SF = str(DATA / "sf0.001")


def corpus(n, seed=1):
    """Texts of which a third is toxic: known insults in one language, an invented stem in another."""
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in ("n", "rt", "st")]
    rows = []
    for i in range(n):
        text, toxic = rng.choices(words, k=rng.randrange(5, 80)), i % 3 == 0
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["idiot", "scum"]) if i % 2 else "vexq" + rng.choice(words)
            text.append(rng.choice(["moron", "clown"]) if i % 2 else "vexq" + rng.choice(words))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_label_model_finds_accuracies_and_shares_say():
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.3
    votes = np.stack([np.where(rng.random(4000) < a, y, ~y) * 2 - 1 for a in (0.95, 0.9, 0.8)], 1)
    votes = np.concatenate([votes, votes[:, 2:], votes[:, 2:]], 1)  # two copies of the weakest voter
    model = toxicity.LabelModel(0.3).fit(votes)
    q = model.posterior(votes)
    assert ((q > 0.5) == y).mean() > 0.93
    assert abs(np.exp(model.rates[1, 2, 0]) - 0.95) < 0.04
    assert model.say[2] < 0.5 < 0.9 < model.say[0]


def test_op1_incidence_reaches_the_driver_packed(spark):
    texts = ["you idiot", "", "a calm day, a calm sea", "idiot sea " * 50]
    rows = [(i, i % 2, -1, t) for i, t in enumerate(texts)]
    names = sorted({f for t in texts for f in toxicity.features_of(t)}) + ["never"]
    got = toxicity.incidence(spark.createDataFrame(rows, "key long, y int, half int, text string"), names)
    assert all(isinstance(r["has"], bytes | bytearray) for r in got)
    has = Counter((r["y"], tuple(np.frombuffer(bytes(r["has"]), toxicity.PLACE).tolist())) for r in got)
    assert has == Counter((y, tuple(i for i, n in enumerate(names) if n in toxicity.features_of(t))) for _, y, _, t in rows)


def test_op1_held_out_accuracy(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], COLUMNS)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit_on(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    held = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 200 and np.mean(held) > 0.97


def test_op1_learns_from_its_fold_only(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t, _ in rows], COLUMNS)
    scores = []
    for flip in (False, True):
        labels = [(i, 1 - y if flip and zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows]
        model = toxicity.fit_on(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        scores.append([r.score for r in toxicity.score_toxicity(docs, model).orderBy("doc_id").collect()])
    assert scores[0] == scores[1]


def test_op1_scores_follow_from_the_weights(spark):
    """Features and scores by code of their own."""
    rows = corpus(900)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t, _ in rows], COLUMNS)
    model = toxicity.fit_on(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    texts = [*(t for _, t, _ in rows[:200]), "", "IDIOT! you are a b***d", "GET OUT OF HERE NOW!!"]
    for text, score in zip(texts, model.score(texts), strict=True):
        found = set()
        for w in re.findall(r"[^\W_]+", text.lower()):
            found |= {w} | {w[:n] + "~" for n in (4, 5, 6, 7) if len(w) > n}
        found |= {f"!{n}" for n, p in toxicity.PATTERNS.items() if p.search(text)} | ({"!insult"} if found & toxicity.INSULTS else set())
        z = model.bias + sum(w for f, w in model.weights.items() if f in found)
        assert abs(score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9
    assert len(model.voters) > 30 and any(v.startswith("lexicon:") for v in model.voters)


def test_op1_uses_unlabelled_rows_and_each_label_once(spark):
    """A row's votes come from lexicons that its own half didn't choose; unlabelled rows are in the sample."""
    rows = corpus(900)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t, _ in rows], COLUMNS)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i // 2 % 2], "doc_id long, toxic int")
    sample, prior = toxicity.sample_of(docs, labels, "text", "doc_id", "toxic", 3000)
    got = sample.groupBy("y").count().collect()
    assert {r.y for r in got} == {-1, 0, 1} and 0.2 < prior < 0.5
    small, _ = toxicity.sample_of(docs, labels, "text", "doc_id", "toxic", 20)
    assert {(r.y, r["count"]) for r in small.groupBy("y").count().collect()} == {(-1, 20), (0, 20), (1, 20)}
    model = toxicity.fit_on(docs, labels)
    scores = model.score([t for _, t, _ in rows])
    assert np.mean([(s >= 0.5) == bool(y) for s, (_, _, y) in zip(scores, rows, strict=True)]) > 0.95


def test_op1_on_its_table(spark):
    rows = Q.op1_toxicity(spark, SF).collect()
    assert len(rows) == 200 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_op1_awkward(spark):
    df = frame(spark, extra=True)
    none = spark.createDataFrame([(None, None), (1, None), (2, 1), (2, 0), (2, 1)], "doc_id long, toxic int")
    for labels in (none, none.limit(0)):
        out = toxicity.score_toxicity(df, toxicity.fit_on(df, labels))
        assert out.count() == 17 and out.where("score is null").count() == 0
    empty = frame(spark, [])
    assert toxicity.score_toxicity(empty, toxicity.fit_on(empty, none)).collect() == []


RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    out = []
    for o, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                x = [int(c) for c in reversed(d)]
                if not 14 <= len(d) <= 19 or (sum(x[::2]) + sum(sum(divmod(2 * v, 10)) for v in x[1::2])) % 10:
                    continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), o, m.end(), kind))
    return sorted(out)


def test_op6_base_spans_equal_the_rules(spark):
    rng = random.Random(8)
    texts = ["", None, "1.2.3.4.5.6.7.8 999.1.1.1 0255.000001.0.0", "a@b.c a@b.com_x@d.e.f a@b a@b. @c.d x@y.z@w.v", "4111 1111-1111 1111 4111111111111112 1 2", "+1 (663) 555-6869 +1234567890123456 +12", "7" * 30000, "1 " * 20000, "a." * 20000 + "@x.yz", "+1" + " " * 3000, "é😀 mail a@b.co 1.1.1.1", "+4111111111111111@1.1.1.1.com"]
    pools = ["0123456789 -", "ab@.-+1 ", "+12() .-3", "4111 -5", "12.3"]
    texts += ["".join(rng.choices(rng.choice(pools), k=rng.randrange(120))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], COLUMNS)
    got = {r.doc_id: [tuple(x) for x in r.base] for r in pii.find_pii(df, None).collect()}
    assert got == {i: brute_base(t) for i, t in enumerate(texts)}
    assert sum(map(len, got.values())) > 100


def pii_corpus(n=400):
    rng = random.Random(2)
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    out = []
    for i in range(n):
        parts = ["some words here", f"page {digits(2)}", f"version {digits(1)}.{digits(2)}"]
        parts.append((f"token = \"{'%032x' % rng.getrandbits(128)}\"", f"call +1 ({digits(3)}) 555-{digits(4)} now", f"10.{rng.randrange(256)}.3.4", f"order {digits(8)}/{digits(4)}")[i % 4])
        rng.shuffle(parts)
        out.append((i, " ".join(parts), "en", "s", 0))
    return out


def test_op6_judge_adds_and_base_stays(spark):
    df = spark.createDataFrame(pii_corpus(), COLUMNS)
    judge = pii.fit_judge(df)
    assert judge is not None
    rows = pii.find_pii(df, judge).collect()
    added = [x.k for r in rows for x in r.spans if x not in r.base]
    assert added.count("secret") >= 90 and all(set(r.base) <= set(r.spans) for r in rows)
    assert len(added) - added.count("secret") <= 5
    for r in rows:
        s = sorted((x.s, x.e) for x in r.spans)
        assert all(a[1] <= b[0] for a, b in zip(s, s[1:])) or any(x in r.base for x in r.spans)
    clean = df.withColumn("base", F.lit(0))
    hidden = pii.find_pii(clean, judge).select(pii.redact(F.col("text"), F.col("spans")).alias("t")).collect()
    assert not any(re.search(r"[0-9a-f]{32}|555-", r.t) for r in hidden) and any("<secret>" in r.t for r in hidden)


def account(rng):
    """An account number with right check digits."""
    body, country = "".join(rng.choices("0123456789", k=18)), "DE"
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{country}{98 - number % 97:02}{body}"


def test_op6_all_generators_can_add(spark):
    """Spelled-out addresses and account numbers by their own weak labels, some with wrong check digits; part numbers are left alone."""
    rng = random.Random(3)
    rows = []
    for i in range(400):
        good = account(rng)
        bad = good[:2] + f"{(int(good[2:4]) + 7) % 90:02}" + good[4:]
        code = f"part no. {'X' * 3}{rng.randrange(10**9):09}Q"
        rows.append((i, (f"pay to account {good} please", f"{code} is in stock", f"write to j{i} [at] ex{i} [dot] com today", f"account {bad} unknown" if i % 80 == 3 else "nothing here 12")[i % 4], None, None, 0))
    df = spark.createDataFrame(rows, COLUMNS)
    judge = pii.fit_judge(df)
    assert judge is not None
    kinds = Counter(x.k for r in pii.find_pii(df, judge).collect() for x in r.spans)
    assert kinds["address"] >= 90 and 80 <= kinds["code"] <= 105, kinds


def test_op6_judge_counts_all_candidates(spark):
    """Of 5400 numbers that look alike, 5000 are cards: precision is enough over all of them, and not over as many of either label as are few."""
    rng = random.Random(4)
    rows = []
    for i in range(5400):
        body = "4" + "".join(rng.choices("0123456789", k=14))
        x = [int(c) for c in reversed(body)]
        check = -sum(x[1::2] + [sum(divmod(2 * v, 10)) for v in x[::2]]) % 10
        rows.append((i, f"number {body}{(check + (i < 400)) % 10} here", None, None, 0))
    df = spark.createDataFrame(rows, COLUMNS)
    judge = pii.fit_judge(df)
    assert judge.least["number"] < 1
    table = pii.examples(df)
    assert {(r.k, r.label): r.n for r in table.groupBy("k", "label").agg(F.sum("n").alias("n")).collect()} == {(k, y): n for k in ("card", "number") for y, n in ((0, 400), (1, 5000))}
    assert pii.fit_judge(df.repartition(13, "text")) == judge  # whatever the order of the rows


def test_op6_tree_equals_brute_force(spark):
    """All splits of a small table tried by loops."""
    rng = random.Random(6)
    rows = [(rng.randrange(9), rng.randrange(4), rng.randrange(3), rng.choice((-1, 1)), rng.randrange(1, 4)) for _ in range(80)]
    rows = [(a, b, c, y if a < 5 else abs(y) if b else -abs(y), n) for a, b, c, y, n in rows]
    used = ["length", "digits", "letters"]
    df = spark.createDataFrame(rows, ", ".join(f"{x} int" for x in (*used, "y", "n"))).withColumns({x: F.lit(0) for x in pii.FEATURES if x not in used})
    mean = lambda some: sum(r[3] * r[4] for r in some) / sum(r[4] for r in some)
    loss = lambda some: sum((r[3] - mean(some)) ** 2 * r[4] for r in some)

    def grow(some, depth):
        best = (loss(some) - 1e-9, None)
        for j in range(3) if depth else ():
            held = sorted({r[j] for r in some})
            for v, after in zip(held, held[1:]):
                parts = [r for r in some if r[j] <= v], [r for r in some if r[j] > v]
                if min(sum(r[4] for r in p) for p in parts) >= 3 and sum(map(loss, parts)) < best[0] - 1e-9:
                    best = sum(map(loss, parts)), (used[j], (v + after) / 2, parts)
        if best[1] is None:
            return mean(some)
        name, at, (left, right) = best[1]
        return name, at, grow(left, depth - 1), grow(right, depth - 1)

    def same(a, b):
        if isinstance(a, tuple) and isinstance(b, tuple):
            return a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])
        return not isinstance(a, tuple) and not isinstance(b, tuple) and abs(a - b) < 1e-6

    got, want = pii.fit_tree(df, F.col("y").cast("double")), grow(rows, pii.DEPTH)
    assert isinstance(want, tuple) and same(got, want), (got, want)


def test_op6_spans_equal_brute_force(spark):
    """What is added, by loops over all pairs: above its threshold, clear of base spans and of better ones."""
    rows = pii_corpus() + [(1000, " ".join(f"{i}.{i % 300}.1.2 tel 555-{i:04} key={'ab1' * 8}{i} ({i}) 12/34/{i}" for i in range(300)), "en", "s", 0)]
    df = spark.createDataFrame(rows, COLUMNS)
    judge = pii.fit_judge(df)
    kinds = [*pii.BASE, *pii.MORE]
    found = df.select("doc_id", *[pii.matches(F.col("text"), k).alias(k) for k in kinds])
    found = found.select("doc_id", pii.base_spans({k: F.col(k) for k in kinds}).alias("base"), pii.tagged({k: F.col(k) for k in kinds}, list(pii.MORE)).alias("c"))
    scored = found.select("doc_id", "base", F.transform("c", lambda c: F.struct(judge.score(pii.features(c)).alias("p"), c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k"))).alias("c"))
    want = {}
    for r in scored.collect():
        base = [tuple(b) for b in r.base]
        over = lambda a, b: a[0] < b[1] and b[0] < a[1]
        good = [(c.p, c.e - c.s, -c.s, kinds.index(c.k), c.s, c.e, c.k) for c in r.c if c.p >= judge.least.get(c.k, 2.0)]
        good = [c for c in good if not any(over((c[4], c[5]), (b[0], b[2])) for b in base)]
        kept = [c for c in good if not any(over((c[4], c[5]), (d[4], d[5])) and (d[0], d[1], d[2]) > (c[0], c[1], c[2]) for d in good)]
        want[r.doc_id] = sorted(base + [(c[4], c[3], c[5], c[6]) for c in kept])
    got = {r.doc_id: sorted(tuple(x) for x in r.spans) for r in pii.find_pii(df, judge).collect()}
    assert got == want and sum(len(w) for w in want.values()) > 500


def test_op6_on_its_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = Q.op6_pii(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_base(texts[r.doc_id])
        said = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == k for x in want) for k in RULES]
        assert {f"{k}:{s}:{e}" for s, _, e, k in want} <= set(r.spans.split(","))


def test_op6_awkward(spark):
    df = frame(spark, extra=True)
    out = pii.find_pii(df, pii.fit_judge(df))
    assert out.count() == 17 and "base" in out.columns
    assert pii.find_pii(frame(spark, []), pii.fit_judge(frame(spark, []))).collect() == []
