"""Readings of a code graph: dependencies, drift, coverage, effects, latent boundaries. All results are DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlaw import vocab as V
from graphlaw.operators.check import law_offenders, names_of
from graphlaw.operators.fixpoint import connected_components, reach_labels
from graphlaw.plans.code_laws import Code, unmodelled
from graphlaw.plans.registry import Registry
from graphlaw.sources.shared import drop, written
from graphlaw.sources.store import GraphStore


def module_dependencies(store: GraphStore, reg: Registry | None = None) -> DataFrame:
    """(m, n): names of modules, the first depending on the second by a delegation or by a type that it owns."""
    c = Code(store)
    names = c.nodes(V.MODULE).where("name is not null")
    return c.dependencies.join(names.toDF("m", "mn"), "m").join(names.toDF("n", "nn"), "n").select(F.col("mn").alias("m"), F.col("nn").alias("n")).distinct()


def offending_names(store: GraphStore, reg: Registry, tag: str, nth: int = 0) -> DataFrame:
    """(name): those of the offenders of one law, which alone is run."""
    return names_of(store, law_offenders(store, reg, tag, nth))


def drifted_operations(store: GraphStore, reg: Registry) -> DataFrame:
    return offending_names(store, reg, "code/Realization")


def uncovered_public_operations(store: GraphStore, reg: Registry) -> DataFrame:
    return offending_names(store, reg, "code/Encapsulation")


def totality_violations(store: GraphStore, reg: Registry) -> DataFrame:
    return offending_names(store, reg, "code/Totality")


def unrealized_delegates(store: GraphStore, reg: Registry) -> DataFrame:
    return offending_names(store, reg, "code/CallRealization")


def unfaithful_calls(store: GraphStore, reg: Registry) -> DataFrame:
    return offending_names(store, reg, "code/Fidelity")


def uncovered_readers(store: GraphStore, reg: Registry) -> DataFrame:
    return offending_names(store, reg, "lens/Coverage")


def uncovered_operations(store: GraphStore, reg: Registry | None = None) -> DataFrame:
    """(name): operations in code that are no twin."""
    c = Code(store)
    return c.side(True).join(c.twins.select(F.col("b").alias("eid")), "eid", "left_anti").where("name is not null").select("name").distinct()


def uncovered_calls(store: GraphStore, reg: Registry | None = None) -> DataFrame:
    """(k1, k2): modules between which code calls without an intended delegation."""
    c = Code(store)
    return c.called.where("k1 != k2").select("k1", "k2").distinct().join(c.covered, ["k1", "k2"], "left_anti")


def unrealized_dispatch(store: GraphStore, reg: Registry | None = None) -> DataFrame:
    """(name): authored operations with a delegation to another module that no path of calls and dispatches realizes.

    Twins stay in groups, and a dispatch between two groups is one step between hubs
    that their members lead to and come from: nothing is listed by pairs of twins.
    """
    c = Code(store)
    groups, own, code = c.twin_groups
    ends = lambda df: df.toDF("x", "y").join(own.toDF("x", "s"), "x").join(own.toDF("y", "t"), "y").select("s", "t").distinct()
    at = lambda kind, key: F.struct(F.lit(kind).alias("kind"), F.col(key).alias("key"))
    turns = written(ends(c.pairs("dispatches-to")), "turns")
    out = code.join(turns.select(F.col("s").alias("g")), "g", "left_semi").select(at("node", "b"), at("from", "g"))
    into = code.join(turns.select(F.col("t").alias("g")), "g", "left_semi").select(at("to", "g"), at("node", "b"))
    calls = c.pairs("calls").select(at("node", "src"), at("node", "dst"))
    steps = reduce(lambda a, b: a.union(b), (calls, out, turns.select(at("from", "s"), at("to", "t")), into)).toDF("src", "dst")
    goals = ends(c.intended.select("x", "y").distinct()).join(groups.toDF("s", "name"), "s")
    found = unreached(written(goals, "goals"), written(code.select("g", at("node", "b").alias("v")), "members"), written(steps, "steps"))
    drop(turns, own, code)
    return found


#: Labels times steps up to which a pivot isn't worth its rounds.
FEW_PAIRS = 5_000_000


def unreached(goals: DataFrame, members: DataFrame, steps: DataFrame) -> DataFrame:
    """(name): of goals (s, t, name), those names with a goal of which some member of s has no path of one step or more to some member of t.

    members (g, v), steps (src, dst), all of them tables, without repeated rows. A name whose goal fails is known, and its other goals
    needn't be decided. First members without any step out, or in, tell; then, unless little is left,
    what a pivot joins (all that leads to it reaches all that it leads to) is taken off, and with it the paths that pass
    it; only for what is left labels travel back, along the steps left.
    """
    named = lambda df, *ids: df.select(*ids).distinct()
    known: list[DataFrame] = []

    def settle(goals: DataFrame, lost: DataFrame) -> DataFrame:
        """The goals of names that none of the goals lost has."""
        known.append(written(lost.select("name").distinct(), "names"))
        return written(goals.join(known[-1], "name", "left_anti"), "goals")

    def lacking(nodes: DataFrame, side: str) -> DataFrame:
        """(s or t): groups with a member that isn't among the nodes."""
        return members.join(named(nodes.toDF("v"), "v"), "v", "left_anti").select(F.col("g").alias(side)).distinct()

    def where(goals: DataFrame, groups: DataFrame) -> DataFrame:
        return goals.join(groups, groups.columns, "left_semi")

    def names() -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), known).distinct()

    goals = settle(goals, where(goals, lacking(steps.select("src"), "s")).unionByName(where(goals, lacking(steps.select("dst"), "t"))))
    if goals.isEmpty():
        return names()
    aimed = lambda: members.join(goals.select(F.col("t").alias("g")), "g", "left_semi").select(F.col("v").alias("dst")).distinct()
    degree = lambda end: steps.groupBy(F.col(end).alias("v")).agg(F.count(F.lit(1)).alias(f"n_{end}"))
    pivot = written(degree("src").join(degree("dst"), "v").orderBy((F.col("n_src") * F.col("n_dst")).desc(), "v").select("v").limit(1 if aimed().count() * steps.count() > FEW_PAIRS else 0), "pivot")
    label = F.lit(True).alias("label")
    behind = written(reach_labels(pivot.select(F.col("v").alias("node"), label), steps).select(F.col("node").alias("v")), "behind")
    first = steps.join(pivot.toDF("src"), "src", "left_semi").select(F.col("dst").alias("node"), label)
    ahead = written(reach_labels(first, steps.toDF("dst", "src")).select(F.col("node").alias("v")), "ahead")
    # a member that isn't behind the pivot only has steps among such nodes, one that isn't ahead of it is only come to from such
    stray, off = written(lacking(behind, "s"), "stray"), written(lacking(ahead, "t"), "off")
    aside, before = steps.join(behind.toDF("src"), "src", "left_anti"), steps.join(ahead.toDF("dst"), "dst", "left_anti")
    early, late = where(goals, off), where(goals, stray)
    goals = written(named(early.unionByName(late), "s", "t", "name"), "goals")
    goals = settle(goals, where(early, lacking(before.select("src"), "s")).unionByName(where(late, lacking(aside.select("dst"), "t"))))
    if goals.isEmpty():
        return names()
    left = written(named(aside.select("src", "dst").unionByName(before.select("src", "dst")), "src", "dst"), "left")
    starts = left.join(aimed(), "dst", "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("label"))
    is_in = lambda nodes, name: nodes.withColumn(name, F.lit(True))
    own = members.join(is_in(behind, "behind"), "v", "left").join(is_in(ahead, "ahead"), "v", "left")
    own = written(own.select("g", "v", F.col("behind").isNotNull().alias("behind"), F.col("ahead").isNotNull().alias("ahead")), "own")
    size = own.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_if("behind").alias("nb"), F.count_if("ahead").alias("na"))
    pairs = reach_labels(starts, left).join(own.select(F.col("g").alias("s"), F.col("v").alias("node"), "behind"), "node")
    pairs = pairs.join(own.select(F.col("g").alias("t"), F.col("v").alias("label"), "ahead"), "label").where("not (behind and ahead)")
    met = pairs.join(goals.select("s", "t").distinct(), ["s", "t"], "left_semi").groupBy("s", "t").agg(F.count(F.lit(1)).alias("met"))
    done = goals.join(met, ["s", "t"], "left").join(size.select(F.col("g").alias("s"), F.col("n").alias("ns"), "nb"), "s").join(size.select(F.col("g").alias("t"), F.col("n").alias("nt"), "na"), "t")
    known.append(done.where(F.coalesce("met", F.lit(0)) + F.col("nb") * F.col("na") < F.col("ns") * F.col("nt")).select("name").distinct())
    return names()


def dispatch(store: GraphStore) -> DataFrame:
    """(name, handlers): authored operations that dispatch, by name, with the names of what they dispatch to, sorted."""
    c = Code(store)
    pairs = c.pairs("dispatches-to").join(c.extracted.toDF("src"), "src", "left_anti")
    names = store.nodes.where("name is not null").select("eid", "name")
    named = pairs.join(names.toDF("src", "name"), "src").join(names.toDF("dst", "handler"), "dst")
    return named.groupBy("name").agg(F.array_sort(F.collect_set("handler")).alias("handlers"))


def _children(store: GraphStore) -> DataFrame:
    """(eid, module): nodes and the names of those that have them as children; other ways of belonging don't count here."""
    holders = store.nodes.where("name is not null").select(F.col("eid").alias("src"), F.col("name").alias("module"))
    return Code(store).pairs("child").join(holders, "src").select(F.col("dst").alias("eid"), "module").distinct()


def purity(store: GraphStore) -> DataFrame:
    """(module, name, effects): operations in code that perform effects themselves, those of throwing left out, sorted."""
    c = Code(store)
    acts = c.performs.where("label != 'throws'").withColumnRenamed("node", "eid").join(c.side(True), "eid").join(_children(store), "eid")
    return acts.groupBy("module", "name").agg(F.array_sort(F.collect_set("label")).alias("effects"))


def encapsulation_by_module(store: GraphStore) -> DataFrame:
    """(module, operations): by module, the names of public operations in code that the model doesn't cover, sorted."""
    c = Code(store)
    names = unmodelled(store).toDF("eid").join(c.nodes(V.OPERATION), "eid").select("name").distinct()
    public = public_operations(store).join(names, "name", "left_semi").join(_children(store), "eid")
    return public.groupBy("module").agg(F.array_sort(F.collect_set("name")).alias("operations"))


def public_operations(store: GraphStore) -> DataFrame:
    """(eid, name): operations in code that aren't private."""
    c = Code(store)
    return c.side(True).join(c.flagged(V.OPERATION, ("private",)).where("not private").select("eid"), "eid", "left_semi")


def clientele(store: GraphStore) -> DataFrame:
    """(op, module, client): for public operations in code, the names of their module and of the other modules that call them."""
    c = Code(store)
    public = public_operations(store).select(F.col("eid").alias("dst"))
    calls = c.pairs("calls").join(public, "dst", "left_semi")
    who = c.placed(c.placed(calls, "src", "client"), "dst", "module").where("client != module")
    return who.select(F.col("dst").alias("op"), "module", "client").distinct()


def consumed(store: GraphStore) -> DataFrame:
    """(module, n): how many of a module's public operations other modules call."""
    return clientele(store).groupBy("module").agg(F.count_distinct("op").alias("n"))


def co_consumed(store: GraphStore) -> DataFrame:
    """(a, b): public operations of one module that a client shares, each linked with the least that the client calls there: the same groups as all pairs give."""
    return _links(clientele(store))


def _links(who: DataFrame) -> DataFrame:
    least = who.groupBy("module", "client").agg(F.min("op").alias("b"))
    return who.select(F.col("op").alias("a"), "module", "client").join(least, ["module", "client"]).where("a != b").select("a", "b").distinct()


def direct_throwers(store: GraphStore, effect: str = "throws") -> DataFrame:
    """(name): operations in code that perform the effect themselves."""
    return throw_spread(store, effect).where("how = 'direct'").select("name")


def reached_effects(store: GraphStore) -> DataFrame:
    """(node, label): every effect that an operation performs or reaches by calls."""
    return Code(store).reached


def throw_spread(store: GraphStore, effect: str = "throws") -> DataFrame:
    """(name, how): extracted operations that perform the effect ("direct") or only reach it ("transitive"), by name."""
    c = Code(store)
    ops = c.side(True).toDF("node", "name")
    by = lambda df: df.where(F.col("label") == effect).join(ops, "node").select("name").distinct()
    direct = by(c.performs)
    return direct.withColumn("how", F.lit("direct")).unionByName(by(c.reached).subtract(direct).withColumn("how", F.lit("transitive")))


def effect_drift(store: GraphStore, reg: Registry | None = None) -> DataFrame:
    """(name, undeclared, phantom): sorted effects that an operation's twin reaches and it doesn't declare, and the reverse."""
    c = Code(store)
    pairs = c.twins.toDF("o", "e").join(c.side(False).toDF("o", "name"), "o")
    declared = pairs.join(c.performs.withColumnRenamed("node", "o"), "o").select("o", "e", "name", "label").withColumn("d", F.lit(1))
    reached = pairs.join(c.reached.withColumnRenamed("node", "e"), "e").select("o", "e", "name", "label").withColumn("r", F.lit(1))
    both = declared.join(reached, ["o", "e", "name", "label"], "full_outer").where("d is null or r is null")
    sets = lambda c: F.array_sort(F.collect_set(F.when(F.col(c).isNull(), F.col("label"))))
    return both.groupBy("name").agg(sets("d").alias("undeclared"), sets("r").alias("phantom"))


def undeclared_effects(store: GraphStore) -> DataFrame:
    """(name, undeclared): operations whose twin reaches effects that they don't declare."""
    return effect_drift(store).where(F.size("undeclared") > 0).select("name", "undeclared")


def operation_signatures(store: GraphStore) -> DataFrame:
    """(eid, ins, out): schema ids of an operation's inputs in order, and of its output."""
    ops = store.nodes.where(F.col("tag") == V.OPERATION).select("eid")
    edge = lambda kind: store.edges.where(F.col("kind") == kind).select(F.col("src").alias("eid"), F.coalesce("ord", F.lit(-1)).alias("ord"), "dst")
    ins = edge("in").groupBy("eid").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "dst"))), lambda x: x["dst"]).alias("ins"))
    outs = edge("out").groupBy("eid").agg(F.min("dst").alias("out"))
    return ops.join(ins, "eid", "left").join(outs, "eid", "left").select("eid", F.coalesce("ins", F.array().cast("array<long>")).alias("ins"), "out")


def type_drifted_operations(store: GraphStore, reg: Registry | None = None) -> DataFrame:
    """(name): authored operations whose signature differs from the one that their twin's code declares.

    Signatures found in code are stored in normal form (emit() sees to it), so texts are compared.
    """
    from graphlaw.operators.render import schema_forms

    forms = schema_forms(store)
    sigs = operation_signatures(store)
    part = sigs.select("eid", F.posexplode_outer("ins").alias("i", "s")).join(forms.select(F.col("eid").alias("s"), "form"), "s", "left")
    ins = part.groupBy("eid").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.when(F.col("form").isNotNull(), F.struct("i", "form")))), lambda x: x["form"])).alias("ins"))
    outs = sigs.join(forms.select(F.col("eid").alias("out"), F.col("form").alias("result")), "out", "left").select("eid", F.coalesce("result", F.lit(":nil")).alias("result"))
    said = ins.join(outs, "eid").select(F.col("eid").alias("o"), F.concat(F.lit("[:=> [:cat"), F.when(F.col("ins") != "", F.concat(F.lit(" "), "ins")).otherwise(F.lit("")), F.lit("] "), "result", F.lit("]")).alias("said"))
    twins = Code(store).twins.toDF("o", "e").join(store.attr("sig", "string").select(F.col("e"), F.col("v").alias("sig")), "e")
    drift = twins.join(said, "o").where(F.col("said") != F.col("sig"))
    return names_of(store, drift.select("o"))


def latent_boundaries(calls: DataFrame, members: DataFrame) -> DataFrame:
    """(module, ops, clientele): parts of two or more of a module's operations that other modules use together and apart from the rest.

    calls (src, dst), members (op, module). An operation's clientele are the other
    modules that call it; operations of one module are used together if their clienteles meet.
    """
    who = calls.join(members.toDF("src", "client"), "src").join(members.toDF("dst", "module"), "dst").where("client != module").select(F.col("dst").alias("op"), "module", "client").distinct()
    links = _links(who).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    parts = connected_components(links).join(who.select(F.col("op").alias("node"), "module").distinct(), "node")
    sizes = parts.groupBy("module", "component").agg(F.count(F.lit(1)).alias("n"))
    total = who.groupBy("module").agg(F.count_distinct("op").alias("total"))
    good = sizes.join(total, "module").where("n >= 2 and n < total").select("module", "component")
    flat = parts.join(good, ["module", "component"]).join(who.select(F.col("op").alias("node"), "client"), "node")
    return flat.groupBy("module", "component").agg(F.array_sort(F.collect_set("node")).alias("ops"), F.array_sort(F.collect_set("client")).alias("clientele")).drop("component").orderBy("module", F.size("ops").desc(), "ops")
