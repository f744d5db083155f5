"""What a store says of code, as typed frames, and the laws of the shipped vocabulary as plans over them.

Each law is a join of a few narrow frames, reduced before it meets the next, and an
anti-join at the end. Names of modules correspond by equality with every suffix;
dependencies are peeled down to cycles; effects travel back along calls.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlaw.functions.predicates import link_corresponding, tails, whole
from graphlaw.operators import fixpoint
from graphlaw.plans.registry import HELD_BY
from graphlaw.sources.shared import written
from graphlaw.sources.store import GraphStore

OPERATION, MODULE, KIND, EFFECT, SCHEMA, SUBSYSTEM = "code/Operation", "code/Module", "code/Kind", "code/Effect", "type/Schema", "code/Subsystem"
EXEMPT = ("private", "export", "test-support")


class Code:
    """The frames of one store."""

    def __init__(self, store: GraphStore):
        self.store = store

    def nodes(self, tag: str) -> DataFrame:
        """(eid, name)"""
        return self.store.nodes_of(frozenset({tag})).where(F.col("tag") == tag).select("eid", "name")

    def pairs(self, *kinds: str, sources: frozenset[str] | None = None) -> DataFrame:
        """(src, dst) of relations of some kinds, distinct."""
        e = self.store.edges_of(frozenset(kinds), sources).where(F.col("kind").isin(list(kinds)) & F.col("dst").isNotNull())
        return e.select("src", "dst").distinct()

    def text(self, attribute: str, tag: str | None = None) -> DataFrame:
        """(e, v)"""
        return self.store.attr(attribute, "string", frozenset({tag}) if tag else None)

    def flagged(self, tag: str, flags: tuple[str, ...]) -> DataFrame:
        """(eid, a boolean for each flag): true where the node says so; absent is false."""
        held = self.store.values(tag, list(flags))
        of = lambda f: F.exists(F.coalesce(F.col(f"`{f}/boolean`"), F.array().cast("array<boolean>")), lambda v: v) if f"{f}/boolean" in held.columns else F.lit(False)
        return held.select("eid", *[of(f).alias(f) for f in flags])

    @cached_property
    def extracted(self) -> DataFrame:
        """(e): whatever was found in code."""
        return self.store.attr("extracted", "boolean").where("v").select("e").distinct()

    @cached_property
    def operations(self) -> DataFrame:
        """(eid, name, extracted, exempt)"""
        flags = self.flagged(OPERATION, ("extracted", *EXEMPT))
        exempt = reduce(lambda a, b: a | b, (F.col(f"`{x}`") for x in EXEMPT))
        return self.nodes(OPERATION).join(flags.select("eid", "extracted", exempt.alias("exempt")), "eid")

    def side(self, extracted: bool) -> DataFrame:
        """Operations found in code, or authored ones."""
        return self.operations.where(F.col("extracted") == extracted).select("eid", "name")

    @cached_property
    def places(self) -> DataFrame:
        """(e, place): the names of the nodes that something lies in."""
        holders = self.store.nodes.where("name is not null").select(F.col("eid").alias("src"), F.col("name").alias("place"))
        return self.pairs(*HELD_BY).join(holders, "src").select(F.col("dst").alias("e"), "place").distinct()

    def placed(self, df: DataFrame, e: str, place: str) -> DataFrame:
        return df.join(self.places.toDF(e, place), e)

    @cached_property
    def twins(self) -> DataFrame:
        """(a, b): an authored operation and one found in code, of one name, in modules that correspond."""
        a = self.placed(self.side(False).toDF("a", "name"), "a", "short")
        b = self.placed(self.side(True).toDF("b", "name"), "b", "long")
        return link_corresponding(a, b, "short", "long", False, ["name"]).select("a", "b").distinct()

    @cached_property
    def twin_groups(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(g, name), (a, g), (b, g), as tables: what is authored and what was found in code are twins if they share a group, which both sides have.

        As many rows as there are operations and places, where twins are as many as their products.
        """
        a = whole(self.placed(self.side(False).toDF("a", "name"), "a", "short"), "short").select("a", "name", "__tail").distinct()
        b = tails(self.placed(self.side(True).toDF("b", "name"), "b", "long"), "long").select("b", "name", "__tail").distinct()
        key = ["name", "__tail"]
        groups = written(a.select(key).distinct().join(b.select(key).distinct(), key).withColumn("g", F.monotonically_increasing_id()), "groups")
        own, code = (written(df.join(groups, key).select(e, "g"), "members") for df, e in ((a, "a"), (b, "b")))
        return groups.select("g", "name"), own, code

    @cached_property
    def place_pairs(self) -> DataFrame:
        """(c, k): a place of something authored and a corresponding place of something found in code."""
        code = self.extracted
        c = self.places.join(code, "e", "left_anti").select(F.col("place").alias("c")).distinct()
        k = self.places.join(code, "e", "left_semi").select(F.col("place").alias("k")).distinct()
        return link_corresponding(c, k, "c", "k", False).select("c", "k").distinct()

    @cached_property
    def intended(self) -> DataFrame:
        """(x, y, c1, c2): delegations of authored operations from one place to another."""
        d = self.pairs("delegates").toDF("x", "y").join(self.extracted.toDF("x"), "x", "left_anti")
        return self.placed(self.placed(d, "x", "c1"), "y", "c2").where("c1 != c2").select("x", "y", "c1", "c2")

    @cached_property
    def called(self) -> DataFrame:
        """(x, k1, k2): calls between what was found in code, by places."""
        code = self.extracted
        d = self.pairs("calls").toDF("x", "y").join(code.toDF("x"), "x", "left_semi").join(code.toDF("y"), "y", "left_semi")
        return self.placed(self.placed(d, "x", "k1"), "y", "k2").select("x", "k1", "k2")

    @cached_property
    def backed(self) -> DataFrame:
        """(c1, c2): places between whose counterparts there is a call."""
        calls = self.called.select("k1", "k2").distinct()
        return calls.join(self.place_pairs.toDF("c1", "k1"), "k1").join(self.place_pairs.toDF("c2", "k2"), "k2").select("c1", "c2").distinct()

    @cached_property
    def covered(self) -> DataFrame:
        """(k1, k2): places in code between whose counterparts a delegation is intended."""
        wanted = self.intended.select("c1", "c2").distinct()
        return wanted.join(self.place_pairs.toDF("c1", "k1"), "c1").join(self.place_pairs.toDF("c2", "k2"), "c2").select("k1", "k2").distinct()

    @cached_property
    def modelled(self) -> DataFrame:
        """(k): names of modules in code that an authored module corresponds to."""
        flags = self.nodes(MODULE).where("name is not null").join(self.flagged(MODULE, ("extracted",)), "eid")
        c, k = (flags.where(F.col("extracted") == side).select(F.col("name").alias(n)).distinct() for side, n in ((False, "c"), (True, "k")))
        return link_corresponding(c, k, "c", "k", False).select("k").distinct()

    @cached_property
    def members(self) -> DataFrame:
        """(m, x): modules and what they own."""
        own = self.nodes(MODULE).select(F.col("eid").alias("src"))
        return self.pairs(*HELD_BY, sources=frozenset({MODULE})).join(own, "src", "left_semi").toDF("m", "x")

    @cached_property
    def dependencies(self) -> DataFrame:
        """(m, n): a module's operation delegates to another's, or takes or gives a type that refers to another's kind."""
        refs = self.text("kind", SCHEMA).where("v = 'ref'").select(F.col("e").alias("s"))
        adopts = self.pairs("in", "out").toDF("x", "s").join(refs, "s", "left_semi").join(self.pairs("names").toDF("s", "y"), "s").select("x", "y")
        uses = self.pairs("delegates").toDF("x", "y").unionByName(adopts).distinct()
        return uses.join(self.members, "x").join(self.members.toDF("n", "y"), "y").where("m != n").select("m", "n").distinct()

    @cached_property
    def performs(self) -> DataFrame:
        """(node, label): operations and the names of the effects that they perform themselves."""
        names = self.text("name", EFFECT).toDF("dst", "label")
        return self.pairs("performs").join(names, "dst").select(F.col("src").alias("node"), "label").distinct()

    @cached_property
    def reached(self) -> DataFrame:
        """(node, label): effects that operations perform or reach by calls."""
        return fixpoint.reach_labels(self.performs, self.pairs("calls"))


def _one(df: DataFrame, column: str, who: str) -> DataFrame:
    return df.select(F.col(column).alias(who)).distinct()


def _if_any(df: DataFrame, guard: DataFrame) -> DataFrame:
    """df where guard has a row: one row at most is broadcast."""
    return df.join(F.broadcast(guard.select(F.lit(1)).limit(1)), F.lit(True), "left_semi")


def unrealized(store: GraphStore) -> DataFrame:
    """(s): authored operations without a twin, once any operation was found in code."""
    c = Code(store)
    lone = c.side(False).toDF("s", "name").join(c.twins.select(F.col("a").alias("s")), "s", "left_anti")
    return _if_any(_one(lone, "s", "s"), c.side(True))


def unmodelled(store: GraphStore) -> DataFrame:
    """(o): operations in code that are neither exempt nor a twin."""
    c = Code(store)
    return _one(c.operations.where("extracted and not exempt").join(c.twins.select(F.col("b").alias("eid")), "eid", "left_anti"), "eid", "o")


def not_total(store: GraphStore, effect: str = "throws") -> DataFrame:
    """(o): authored operations that take a type of a trust boundary's kind and whose twin performs the effect."""
    c = Code(store)
    lines = c.nodes("code/TrustBoundary").select(F.col("eid").alias("src")).join(c.pairs("kind"), "src").select(F.col("dst").alias("k"))
    refs = c.text("kind", SCHEMA).where("v = 'ref'").select(F.col("e").alias("s"))
    risky = refs.join(c.pairs("names").toDF("s", "k"), "s").join(lines, "k", "left_semi").select("s")
    takes = c.pairs("in").toDF("a", "s").join(risky, "s", "left_semi").select("a")
    throws = c.twins.join(c.performs.where(F.col("label") == effect).select(F.col("node").alias("b")), "b", "left_semi")
    return _one(throws.join(takes, "a", "left_semi"), "a", "o")


def undeclared_effects(store: GraphStore) -> DataFrame:
    """(o): authored operations whose twin reaches an effect that they don't declare."""
    c = Code(store)
    reached = c.twins.join(c.reached.toDF("b", "label"), "b").select(F.col("a").alias("node"), "label").distinct()
    return _one(reached.join(c.performs, ["node", "label"], "left_anti"), "node", "o")


def not_backed(store: GraphStore) -> DataFrame:
    """(o1): authored operations with a delegation between places that no call backs, once a module was found in code."""
    c = Code(store)
    found = c.flagged(MODULE, ("extracted",)).where("extracted")
    return _if_any(_one(c.intended.join(c.backed, ["c1", "c2"], "left_anti"), "x", "o1"), found)


def not_intended(store: GraphStore) -> DataFrame:
    """(e1): operations in code that call from one modelled place to another without an intended delegation."""
    c = Code(store)
    calls = c.called.where("k1 != k2").join(c.modelled.toDF("k1"), "k1", "left_semi").join(c.modelled.toDF("k2"), "k2", "left_semi")
    return _one(calls.join(c.covered, ["k1", "k2"], "left_anti"), "x", "e1")


def circular_modules(store: GraphStore) -> DataFrame:
    """(m): modules on a circle of dependencies."""
    return _one(fixpoint.on_cycle(Code(store).dependencies.toDF("src", "dst")), "node", "m")


def undeclared_dependencies(store: GraphStore) -> DataFrame:
    """(m): modules that depend on one of another subsystem without a declaration between the two."""
    c = Code(store)
    subs = c.nodes(SUBSYSTEM).select(F.col("eid").alias("src"))
    lies = c.pairs("child", sources=frozenset({SUBSYSTEM})).join(subs, "src", "left_semi")
    may = c.pairs("may-depend").join(subs, "src", "left_semi").toDF("s", "t")
    d = c.dependencies.join(lies.toDF("s", "m"), "m").join(lies.toDF("t", "n"), "n").where("s != t")
    return _one(d.join(may, ["s", "t"], "left_anti"), "m", "m")


def circular_subsystems(store: GraphStore) -> DataFrame:
    """(s): subsystems on a circle of declared dependencies."""
    c = Code(store)
    round_ = fixpoint.on_cycle(c.pairs("may-depend")).join(c.nodes(SUBSYSTEM).select(F.col("eid").alias("node")), "node", "left_semi")
    return _one(round_, "node", "s")


def outside_subsystems(store: GraphStore) -> DataFrame:
    """(mod): authored modules in no subsystem, once there is one."""
    c = Code(store)
    subs = c.nodes(SUBSYSTEM).select(F.col("eid").alias("src"))
    inside = c.pairs("child", sources=frozenset({SUBSYSTEM})).join(subs, "src", "left_semi").select(F.col("dst").alias("eid"))
    authored = c.flagged(MODULE, ("extracted",)).where("not extracted").select("eid")
    return _if_any(_one(authored.join(inside, "eid", "left_anti"), "eid", "mod"), subs)


def without_lens(store: GraphStore) -> DataFrame:
    """(r): nodes found in code whose names begin like a convention's and whose reader's lens isn't there."""
    c = Code(store)
    prefixes = c.text("prefix", "lens/ReaderConvention").select(F.col("v").alias("prefix")).distinct()
    lenses = c.nodes("lens/Lens").where("name is not null").select(F.col("name").alias("lens")).distinct()
    named = store.nodes.where("name is not null").select(F.col("eid").alias("e"), F.col("name")).join(c.extracted, "e", "left_semi")
    # every beginning of a name against the conventions, and what then remains against the lenses: equality both times
    cut = named.select("e", "name", F.explode(F.sequence(F.lit(0), F.length("name"))).alias("n"))
    readers = cut.withColumn("prefix", F.left("name", F.col("n"))).join(prefixes, "prefix", "left_semi")
    seen = readers.withColumn("lens", F.substring("name", F.col("n") + 1, F.length("name"))).join(lenses, "lens", "left_semi")
    return _one(readers.join(seen.select("e"), "e", "left_anti"), "e", "r")


def unlinked(store: GraphStore) -> DataFrame:
    """(x): nodes at neither end of any relation."""
    ends = store.edges.select(F.explode(F.array("src", "dst")).alias("x")).where("x is not null").distinct()
    return store.nodes.select(F.col("eid").alias("x")).distinct().join(ends, "x", "left_anti")


def not_held(tag: str, kind: str, holder: str, keep: str | None = None):
    """A plan: (x), nodes of a tag that no holder has by a relation of a kind."""

    def plan(store: GraphStore) -> DataFrame:
        c = Code(store)
        held = c.pairs(kind, sources=frozenset({holder})).join(c.nodes(holder).select(F.col("eid").alias("src")), "src", "left_semi").select(F.col("dst").alias("eid"))
        own = c.nodes(tag)
        if keep is not None:
            own = own.join(c.text("tag", tag).toDF("eid", "said"), "eid").where(keep)
        return _one(own.join(held, "eid", "left_anti"), "eid", "x")

    return plan
