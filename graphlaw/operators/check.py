"""Checking laws: the rows that offend."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial, reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlaw import terms as T
from graphlaw.functions.dialect import value_valid
from graphlaw.plans.compiler import Engine
from graphlaw.plans.registry import ANY, Law, Registry, Structure
from graphlaw.sources.store import TYPES, GraphStore

OFFENCES = "structure string, law string, offenders array<string>"


def engine(store: GraphStore, registry: Registry) -> Engine:
    return Engine(store, registry.rules())


def offenders(eng: Engine, registry: Registry, s: Structure, law: Law) -> DataFrame:
    """The offenders of one law, a column each."""
    store = eng.store
    if law.plan is not None:
        found = law.plan(store)
        if law.scope != "global":
            # the first offender is an instance of the owner, or of the scope
            found = found.join(instances(eng, registry, law.scope or s.tag).toDF(law.offenders[0]), law.offenders[0], "left_semi")
        return found.select(*law.offenders).distinct()
    if isinstance(law.where, tuple) and law.where and isinstance(law.where[0], str):
        desc = next(d for d in _slot_offences(eng, registry, s) if d is not None)
        cols = [F.get("offenders", F.lit(i)).cast("long").alias(c) for i, c in enumerate(law.offenders)]
        return desc.where(F.col("law") == law.desc).select(*cols)
    sub = Engine(store, [*(r for rs in eng.rules.values() for r in rs), *T.rules(law.rules)]) if law.rules else eng
    where = registry.scoped(s, law)
    return sub.body(where, set(law.offenders)).select(*law.offenders).distinct()


def instances(eng: Engine, registry: Registry, tag: str) -> DataFrame:
    """(eid): the nodes of a structure, those of a facet's or realized one's by its rule."""
    if tag in registry.direct():
        return eng.store.nodes_of(frozenset({tag})).where(F.col("tag") == tag).select("eid").distinct()
    return eng.rule(tag.rsplit("/", 1)[-1]).toDF("eid")


def _invalid(form: Any, v: Column) -> Column:
    return ~value_valid(form, v)


def _slot_offences(eng: Engine, registry: Registry, s: Structure) -> list[DataFrame]:
    """(law, offenders) of all laws that a structure's slots give, by one pass over its values and two over its relations.

    Relations are counted as such, so one that is held twice is one; a target that
    isn't there offends as well.
    """
    store, out = eng.store, []
    said = {law.desc: law.where for law in registry.slot_laws(s)}
    one = lambda laws, who: F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(desc)) for desc, bad in laws]))).alias("law") if laws else who
    scalar = [x for x in s.slots if x.scalar]
    if scalar:
        values = store.values(s.tag, [x.rel for x in scalar])
        laws = []
        for x in scalar:
            held = {c: c.rsplit("/", 1)[1] for c in values.columns if c != "eid" and c.rsplit("/", 1)[0] == x.rel}
            wrong = partial(_invalid, T.read_form(x.target))
            bad = [F.exists(F.coalesce(F.col(f"`{c}`"), F.array().cast(f"array<{TYPES[t]}>")), lambda v: wrong(v)) for c, t in held.items()]  # noqa: B023
            laws.append((registry.law_name(s, x, "value"), reduce(lambda a, b: a | b, bad, F.lit(False))))
            if x.card == "one":
                none = [F.size(F.coalesce(F.col(f"`{c}`"), F.array().cast(f"array<{TYPES[t]}>"))) == 0 for c, t in held.items()]
                laws.append((registry.law_name(s, x, "none"), reduce(lambda a, b: a & b, none, F.lit(True))))
        out.append(values.select("eid", one(laws, None)).select("law", F.array(F.col("eid").cast("string")).alias("offenders")))
    linked = [x for x in s.slots if not x.scalar]
    # a foreign key in the node's own row is there once or not at all
    row = store.row(s.tag)
    keyed = [x for x in linked if row is not None and x.rel in row.links]
    linked = [x for x in linked if x not in keyed]
    if keyed:
        of = lambda x: F.col(f"`{row.links[x.rel]}`")
        laws = [(registry.law_name(s, x, "none"), of(x).isNull()) for x in keyed if x.card in ("one", "some")]
        if laws:
            out.append(row.frame.select("eid", one(laws, None)).select("law", F.array(F.col("eid").cast("string")).alias("offenders")))
        aims = [F.struct(F.lit(registry.law_name(s, x, "target")).alias("law"), F.lit(x.target).alias("is"), of(x).alias("dst")) for x in keyed if x.target != ANY]
        if aims:
            ends = row.frame.select("eid", F.explode(F.array(*aims)).alias("x")).select("eid", "x.*").where("dst is not null").join(_good(eng, registry, [x.target for x in keyed if x.target != ANY]), ["dst", "is"], "left_anti")
            out.append(ends.select("law", F.array(F.col("eid").cast("string"), F.col("dst").cast("string")).alias("offenders")).distinct())
    counted = [x for x in linked if x.card != "many" and x.card != "set"]
    kinds = lambda slots: frozenset(x.rel for x in slots)
    own = store.nodes_of(frozenset({s.tag})).where(F.col("tag") == s.tag).select("eid").distinct()
    edges = lambda slots: store.edges_of(kinds(slots), frozenset({s.tag})).where(F.col("kind").isin([x.rel for x in slots]))
    if counted:
        n = edges(counted).groupBy(F.col("src").alias("eid")).agg(*[F.count_distinct(F.when(F.col("kind") == x.rel, F.col("rid"))).alias(f"n{i}") for i, x in enumerate(counted)])
        rows = own.join(n, "eid", "left")
        laws = []
        for i, x in enumerate(counted):
            if x.card in ("one", "some"):
                laws.append((registry.law_name(s, x, "none"), F.coalesce(f"n{i}", F.lit(0)) == 0))
            if x.card in ("one", "optional"):
                laws.append((registry.law_name(s, x, "several"), F.coalesce(f"n{i}", F.lit(0)) > 1))
        out.append(rows.select("eid", one(laws, None)).select("law", F.array(F.col("eid").cast("string")).alias("offenders")))
    typed = [x for x in linked if x.target != ANY]
    if typed:
        ends = edges(typed).join(own.toDF("src"), "src", "left_semi").select("src", "kind", "dst").distinct()
        must = F.coalesce(*[F.when(F.col("kind") == x.rel, F.lit(x.target)) for x in typed])
        named = F.coalesce(*[F.when(F.col("kind") == x.rel, F.lit(registry.law_name(s, x, "target"))) for x in typed])
        ends = ends.withColumn("is", must).join(_good(eng, registry, [x.target for x in typed]), ["dst", "is"], "left_anti")
        out.append(ends.select(named.alias("law"), F.array(F.col("src").cast("string"), F.col("dst").cast("string")).alias("offenders")))
    return [reduce(lambda a, b: a.unionByName(b), out)] if out and said else [None]


def _good(eng: Engine, registry: Registry, tags: Iterable[str]) -> DataFrame:
    """(dst, is): the nodes of some structures, with the structure."""
    plain, derived = [], []
    for t in dict.fromkeys(tags):
        (plain if t in registry.direct() else derived).append(t)
    good = [eng.store.nodes_of(frozenset(plain)).where(F.col("tag").isin(plain)).select(F.col("eid").alias("dst"), F.col("tag").alias("is"))] if plain else []
    good += [eng.rule(t.rsplit("/", 1)[-1]).toDF("dst").withColumn("is", F.lit(t)) for t in derived]
    return reduce(lambda a, b: a.unionByName(b), good)


def roll_call(store: GraphStore, registry: Registry, only: Iterable[str] | None = None) -> DataFrame:
    """(structure, law, status): every law with "planned", or "unsupported" and why. Laws with plans of their own are not run."""
    eng = engine(store, registry)
    rows = []
    for s in registry.structures.values():
        for law in registry.laws_of(s) if only is None or s.tag in set(only) else ():
            try:
                if law.plan is None:
                    offenders(eng, registry, s, law)
                rows.append((s.tag, law.desc, "planned"))
            except T.QueryError as e:
                rows.append((s.tag, law.desc, f"unsupported: {e}"))
    return store.spark.createDataFrame(rows, "structure string, law string, status string")


def check(store: GraphStore, registry: Registry, only: Iterable[str] | None = None, strict: bool = False) -> DataFrame:
    """A row for each offence: structure, law, offenders (ids as text). only: the laws of these structures.

    The laws of a structure's slots are read off its values and relations together;
    other laws are queries of their own. A law that can't be planned is a row with the
    law "unsupported: …" and no offenders, or with strict an error.
    """
    eng, out = engine(store, registry), []
    for s in registry.structures.values():
        if only is not None and s.tag not in set(only):
            continue

        def put(desc: str, plan: Callable[[], DataFrame | None], s: Structure = s) -> None:
            try:
                df = plan()
                if df is not None:
                    out.append(df.select(F.lit(s.tag).alias("structure"), "law", "offenders"))
            except T.QueryError as e:
                if strict:
                    raise
                out.append(store.spark.createDataFrame([(s.tag, f"unsupported: {desc} ({e})", [])], OFFENCES))

        put(f"{s.name}'s slots", lambda s=s: _slot_offences(eng, registry, s)[0] if registry.slot_laws(s) else None)
        for law in s.laws:

            def one(s: Structure = s, law: Law = law) -> DataFrame:
                df = offenders(eng, registry, s, law)
                return df.select(F.lit(law.desc).alias("law"), F.array(*[F.col(c).cast("string") for c in df.columns]).alias("offenders"))

            put(law.desc, one)
    if not out:
        return store.spark.createDataFrame([], OFFENCES)
    return reduce(lambda a, b: a.unionByName(b), out)


def law_offenders(store: GraphStore, registry: Registry, tag: str, nth: int = 0) -> DataFrame:
    """The offenders of a structure's own law, without checking any other."""
    s = registry.structures[tag]
    return offenders(engine(store, registry), registry, s, s.laws[nth])


def names_of(store: GraphStore, ids: DataFrame) -> DataFrame:
    """The distinct names of nodes, by one join."""
    return ids.toDF("eid").join(store.nodes, "eid").select("name").where("name is not null").distinct()
