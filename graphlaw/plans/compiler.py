"""From clauses to DataFrames.

Rules with one definition are written out where they are applied. All that a body
says of one relation or node becomes one scan with its filters; where the nodes of a
kind are rows of a table, their values and foreign keys are read from that row.
What a body says of kinds leaves the scans of other tables out. Scans are joined
along shared variables: first those that one side knows by its key, filtered
ones before others, and many-to-many joins last. Predicates filter as soon as their
variables are bound, or join two parts that only they connect; negations come
last, as anti-joins. A part that shares nothing with the rest and isn't asked for
is only tested for being there. Rules that apply themselves are run to their
fixpoint, stratum by stratum, before the bodies that negate them.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlaw import terms as T
from graphlaw.functions.predicates import PREDICATES
from graphlaw.operators.fixpoint import semi_naive
from graphlaw.sources.store import EDGE_ATTRS, NODE_ATTRS, GraphStore, Tags, classify

#: A negation's own variables, apart from those of the body around it.
_INNER = "n~"


def _set(df: DataFrame) -> DataFrame:
    return df.distinct()


#: Relations that aren't rules: name -> a frame of the store, its columns being the arguments in their order.
RELATIONS: dict[str, Callable[[GraphStore], DataFrame]] = {}
#: Rows of the smaller side that parts without a shared variable may be paired with.
FEW = 10_000


def register_relation(name: str, frame: Callable[[GraphStore], DataFrame]) -> None:
    """Make a generating relation known to all queries: (name ?a ?b …) holds for its rows."""
    RELATIONS[name] = frame


@dataclass
class Part:
    """Bindings of some variables. keys: sets of variables that no two rows share; narrow: whether anything filters it."""

    df: DataFrame
    keys: set[frozenset[str]] = field(default_factory=set)
    narrow: bool = False

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def meet(self, other: Part) -> Part:
        on = [c for c in self.columns if c in other.columns]
        if not on:
            raise T.QueryError("no shared variable")
        shared = set(on)
        one, many = any(k <= shared for k in other.keys), any(k <= shared for k in self.keys)
        keys = (self.keys if one else set()) | (other.keys if many else set())
        return Part(self.df.join(other.df, on), keys, self.narrow or other.narrow)

    def only(self, names: set[str]) -> Part:
        """The distinct bindings of some variables."""
        keep = [c for c in self.columns if c in names]
        if len(keep) == len(self.columns):
            return self
        df = self.df.select(*keep)
        keys = {k for k in self.keys if k <= set(keep)}
        return Part(df if keys else df.distinct(), keys, self.narrow)


def _exists(df: DataFrame, guard: DataFrame) -> DataFrame:
    """df if guard has a row, else nothing: one row at most is broadcast."""
    one = F.broadcast(guard.select(F.lit(1).alias("__one")).limit(1))
    return df.withColumn("__one", F.lit(1)).join(one, "__one", "left_semi").drop("__one")


class Engine:
    """Queries over one store with a set of rules."""

    def __init__(self, store: GraphStore, rules: Iterable[T.Rule] = ()):
        self.store = store
        self.rules: dict[str, list[T.Rule]] = {}
        for r in rules:
            self.rules.setdefault(r.name, []).append(r)
        self.done: dict[str, DataFrame] = {}
        self.memo: dict[Any, DataFrame] = {}
        self.names = 0

    # rules

    def rule(self, name: str) -> DataFrame:
        """The rule's tuples, in columns 0, 1, …"""
        if name not in self.done:
            if name not in self.rules:
                if name not in RELATIONS:
                    raise T.UnsupportedClause(f"unknown rule {name}")
                self.done[name] = _set(RELATIONS[name](self.store).toDF(*map(str, range(len(RELATIONS[name](self.store).columns)))))
                return self.done[name]
            group = self._together(name)
            if len(group) == 1 and not any(n == name for r in self.rules[name] for n, _ in T.called(r.body)):
                self.done[name] = _set(reduce(lambda a, b: a.unionByName(b), [self._head(r, self.body(r.body, {v.name for v in r.head})) for r in self.rules[name]]))
            else:
                self._fixpoint(sorted(group))
        return self.done[name]

    def constant(self, name: str, rows: list[tuple], types: str) -> Engine:
        """This engine with a relation of given rows; types: a schema, its fields being the arguments in their order."""
        df = self.store.spark.createDataFrame(rows, types)
        self.done[name] = _set(df.toDF(*map(str, range(len(df.columns)))))
        return self

    def create(self, name: str, types: str) -> Engine:
        """This engine with an empty relation of its own, to put rows into."""
        return self.constant(name, [], types)

    def put(self, name: str, rows: list[tuple]) -> Engine:
        """Rows into a relation of this engine; rows that it has stay once."""
        own = self.done[name]
        self.memo.clear()
        self.done[name] = _set(own.unionByName(self.store.spark.createDataFrame(rows, own.schema)))
        return self

    def unplannable(self) -> dict[str, str]:
        """The rules that can't be planned, with the reason, each also warned of; they only matter to queries that apply them."""
        out = {}
        for name in self.rules:
            try:
                self.rule(name)
            except T.QueryError as e:
                out[name] = str(e)
                warnings.warn(f"rule {name} is left out: {e}", stacklevel=2)
        return out

    def _reach(self, name: str) -> set[str]:
        seen, todo = set(), [name]
        while todo:
            for r in self.rules.get(todo.pop(), ()):
                for n, _ in T.called(r.body):
                    if n not in seen:
                        seen.add(n)
                        todo.append(n)
        return seen

    def _together(self, name: str) -> set[str]:
        """The rules that apply one another in a circle with this one."""
        return {name} | {n for n in self._reach(name) if name in self._reach(n)}

    def _head(self, r: T.Rule, df: DataFrame) -> DataFrame:
        missing = [v.name for v in r.head if isinstance(v, T.Var) and v.name not in df.columns]
        if missing:
            raise T.QueryError(f"rule {r.name}: nothing binds {', '.join(missing)}")
        return df.select(*[(F.col(v.name) if isinstance(v, T.Var) else F.lit(v.value)).alias(str(i)) for i, v in enumerate(r.head)])

    def _fixpoint(self, group: list[str]) -> None:
        for name in group:
            for r in self.rules[name]:
                if any(n in group and negated for n, negated in T.called(r.body)):
                    raise T.QueryError(f"rule {name} negates itself")
        start: dict[str, list[DataFrame]] = {n: [] for n in group}
        steps: list[tuple[T.Rule, int]] = []
        for name in group:
            for r in self.rules[name]:
                own = [i for i, c in enumerate(r.body) if any(n in group for n, _ in T.called((c,)))]
                if not own:
                    start[name].append(self._head(r, self.body(r.body, {v.name for v in r.head})))
                elif any(not isinstance(r.body[i], T.Call) for i in own):
                    raise T.UnsupportedClause(f"rule {name}: recursion only in clauses of its own, not in or-join")
                steps += [(r, i) for i in own]

        def more(total: dict[str, DataFrame], fresh: dict[str, DataFrame]) -> dict[str, list[DataFrame]]:
            out: dict[str, list[DataFrame]] = {n: [] for n in group}
            for r, i in steps:
                self.memo.clear()  # it may hold relations of an earlier round
                self.done.update(total)
                body = list(r.body)
                call = body[i]
                body[i] = T.Call("Δ" + call.name, call.args)
                self.done.update({"Δ" + n: f for n, f in fresh.items()})
                out[r.name].append(self._head(r, self.body(tuple(body), {v.name for v in r.head})))
            return out

        width = {n: len(self.rules[n][0].head) for n in group}
        if any(not x for x in start.values()):
            types = self._types_of(group, start)
            for n in group:
                if not start[n]:
                    start[n] = [self.store.spark.createDataFrame([], ", ".join(f"`{i}` {types.get(n, ['long'] * width[n])[i]}" for i in range(width[n])))]
        result = semi_naive(start, more)
        self.memo.clear()
        for n in [*self.done]:
            if n.startswith("Δ"):
                del self.done[n]
        self.done.update(result)

    def _types_of(self, group: list[str], start: dict[str, list[DataFrame]]) -> dict[str, list[str]]:
        known = {n: [t for _, t in x[0].dtypes] for n, x in start.items() if x}
        first = next(iter(known.values()), None)
        return {n: known.get(n, first or ["long"] * 8) for n in group}

    # clauses

    def _written_out(self, clauses: Iterable[T.Clause]) -> list[T.Clause]:
        """Clauses with rules of one definition, if it is a plain conjunction, in place of their applications."""
        out: list[T.Clause] = []
        for c in clauses:
            own = self.rules.get(c.name, ()) if isinstance(c, T.Call) else ()
            if len(own) != 1 or c.name in self.done or len(own[0].head) != len(c.args) or not all(isinstance(x, T.Triple | T.Call | T.Pred) for x in own[0].body) or c.name in self._reach(c.name):
                out.append(c)
                continue
            rule = own[0]
            self.names += 1
            to: dict[str, T.Term] = {v: T.Var(f"{v}~{self.names}") for x in rule.body for v in T.variables(x)}
            same = []
            for v, arg in zip(rule.head, c.args, strict=True):
                if isinstance(v, T.Lit) or (isinstance(v, T.Var) and isinstance(to.get(v.name), T.Var) and not to[v.name].name.endswith(f"~{self.names}")):
                    same.append(v)  # a value, or a variable twice in the head: left to the rule itself
                else:
                    to[v.name] = arg
            if same:
                out.append(c)
            else:
                out += self._written_out(T.substituted(x, to) for x in rule.body)
        return out

    def _tags(self, clauses: list[T.Clause], seen: frozenset[str] = frozenset()) -> dict[str, Tags]:
        """What tags the nodes can have that variables stand for."""
        out: dict[str, Tags] = {}

        def limit(term: T.Term, tags: Tags) -> None:
            if isinstance(term, T.Var) and tags is not None:
                now = out.get(term.name)
                out[term.name] = tags if now is None else now & tags

        kinds = {c.e: c.v.value for c in clauses if isinstance(c, T.Triple) and c.a == "rel/kind" and isinstance(c.v, T.Lit)}
        for c in clauses:
            if isinstance(c, T.Triple):
                if c.a == "structure/of" and isinstance(c.v, T.Lit):
                    limit(c.e, frozenset({c.v.value}))
                elif c.a in ("rel/from", "rel/to") and c.e in kinds:
                    limit(c.v, self.store.ends(kinds[c.e])[c.a == "rel/to"])
                elif c.a.startswith("val/"):
                    limit(c.e, self.store.holders(c.a[4:]))
            elif isinstance(c, T.Call) and c.name in self.rules and c.name not in seen:
                each = []
                for r in self.rules[c.name]:
                    inner = self._tags(list(r.body), seen | {c.name})
                    each.append([inner.get(v.name) if isinstance(v, T.Var) else None for v in r.head])
                for i, arg in enumerate(c.args):
                    known = [e[i] for e in each if len(e) > i]
                    limit(arg, frozenset().union(*known) if known and all(k is not None for k in known) else None)
        return out

    def _scans(self, body: Iterable[T.Clause], hints: dict[str, set[str]] | None = None, kept: set[str] = frozenset()) -> list[Part]:
        """A part for each scan and rule of a body, in columns named by variables. hints: the types that variables are compared in; kept: variables that are used elsewhere."""
        body = list(body)
        tags = self._tags(body)
        of = lambda e: tags.get(e.name) if isinstance(e, T.Var) else None
        edges: dict[Any, list[T.Triple]] = {}
        nodes: dict[Any, list[T.Triple]] = {}
        values: list[T.Triple] = []
        out: list[Part] = []
        for c in body:
            if isinstance(c, T.Triple):
                if c.a in EDGE_ATTRS:
                    edges.setdefault(c.e, []).append(c)
                elif c.a in NODE_ATTRS:
                    nodes.setdefault(c.e, []).append(c)
                else:
                    values.append(c)
            elif isinstance(c, T.Call):
                df = self.rule(c.name)
                if len(df.columns) != len(c.args):
                    raise T.QueryError(f"rule {c.name} takes {len(df.columns)} arguments")
                named = self._named(df, list(zip(df.columns, c.args, strict=True)))
                key = frozenset(named.columns) if len(named.columns) == len(c.args) else None
                out.append(Part(named, {key} if key else set(), any(isinstance(x, T.Lit) for x in c.args)))
            elif isinstance(c, T.Or):
                keep = [v.name for v in c.over]
                if not _hashable(c):
                    out.append(Part(_set(reduce(lambda a, b: a.unionByName(b), [self.body(b, set(keep)).select(*keep) for b in c.branches])), {frozenset(keep)}))
                    continue
                if c not in self.memo:
                    self.memo[c] = _set(reduce(lambda a, b: a.unionByName(b), [self.body(b, set(keep)).select(*keep) for b in c.branches]))
                out.append(Part(self.memo[c], {frozenset(keep)}))
        # nodes that are rows of one table bring their values and foreign keys along
        used = [v for c in body for v in T.variables(c)]
        for e in list(dict.fromkeys([*nodes, *(c.e for c in values)])):
            row = self.store.row(next(iter(of(e)))) if of(e) is not None and len(of(e)) == 1 else None
            if row is None:
                continue
            tag = next(iter(of(e)))
            pairs = [("eid", e)] + [(NODE_ATTRS[c.a], c.v) for c in nodes.pop(e, [])]
            own = [c for c in values if c.e == e and c.a[4:] in row.values]
            pairs += [(row.values[c.a[4:]][0], self._fitted(c.v, row.values[c.a[4:]][1])) for c in own]
            values = [c for c in values if not (c.e == e and c.a[4:] in row.values)]
            for r, cs in list(edges.items()):
                at = {c.a: c.v for c in cs}
                plain = len(cs) == 3 and set(at) == {"rel/from", "rel/kind", "rel/to"} and isinstance(r, T.Var) and used.count(r.name) == 3 and r.name not in kept
                if plain and at["rel/from"] == e and isinstance(at["rel/kind"], T.Lit) and at["rel/kind"].value in row.links and self.store.ends(at["rel/kind"].value)[0] >= {tag}:
                    pairs.append((row.links[at["rel/kind"].value], at["rel/to"]))
                    del edges[r]
            need = [F.col(f"`{c}`").isNotNull() for c in dict.fromkeys(c for c, _ in pairs)]
            named = self._named(row.frame.where(reduce(lambda a, b: a & b, need)), pairs)
            out.append(Part(named, {frozenset({e.name})}, any(isinstance(v, T.Lit) and c != "tag" for c, v in pairs)))
        for c in values:
            out.append(Part(self._value(c, of(c.e), hints or {}), {frozenset({c.e.name})} if isinstance(c.e, T.Var) else set(), isinstance(c.v, T.Lit)))
        for e, cs in nodes.items():
            df = self.store.nodes_of(of(e)).where(reduce(lambda a, b: a & b, [F.col(NODE_ATTRS[c.a]).isNotNull() for c in cs]))
            named = self._named(df, [("eid", e), *((NODE_ATTRS[c.a], c.v) for c in cs)])
            out.append(Part(named, {frozenset({e.name})} if isinstance(e, T.Var) else set(), any(isinstance(c.v, T.Lit) and c.a != "structure/of" for c in cs)))
        for e, cs in edges.items():
            at = {c.a: c.v for c in cs}
            kind = at.get("rel/kind")
            df = self.store.edges_of(frozenset({kind.value}) if isinstance(kind, T.Lit) else None, of(at.get("rel/from")), of(at.get("rel/to")))
            df = df.where(reduce(lambda a, b: a & b, [F.col(EDGE_ATTRS[c.a]).isNotNull() for c in cs]))
            named = self._named(df, [("rid", e), *((EDGE_ATTRS[c.a], c.v) for c in cs)])
            out.append(Part(named, {frozenset({e.name})} if isinstance(e, T.Var) else set(), any(isinstance(c.v, T.Lit) and c.a != "rel/kind" for c in cs)))
        return out

    @staticmethod
    def _fitted(v: T.Term, kind: str) -> T.Term:
        """A value of another type than the column's matches nothing; whole numbers compare with doubles."""
        if isinstance(v, T.Lit) and v.value is not None:
            given = classify(v.value)
            if given != kind and not (given == "long" and kind == "double"):
                return T.Lit(None)
        return v

    def _value(self, c: T.Triple, tags: Tags, hints: dict[str, set[str]]) -> DataFrame:
        name = c.a.removeprefix("val/")
        kinds = self.store.attr_types.get(name, set())
        if isinstance(c.v, T.Lit):
            kind = classify(c.v.value)
            kind = "double" if kind == "long" and kinds == {"double"} else kind
            df = self.store.attr(name, kind, tags)
        else:
            # what is compared with values of some types can only be of these
            kinds = kinds & hints.get(c.v.name, kinds) or kinds
            cast = "string" if len(kinds) > 1 and not kinds <= {"long", "double"} else "double"
            frames = [self.store.attr(name, k, tags) for k in sorted(kinds or {"string"})]
            # else an attribute of several types compares as text
            df = frames[0] if len(frames) == 1 else reduce(lambda a, b: a.unionByName(b), [f.withColumn("v", F.col("v").cast(cast)) for f in frames])
        return self._named(df, [("e", c.e), ("v", c.v)])

    def _named(self, df: DataFrame, pairs: list[tuple[str, T.Term]]) -> DataFrame:
        """Columns by the names of variables; values and repeated variables filter, blanks go."""
        columns: dict[str, str] = {}
        for column, term in pairs:
            if isinstance(term, T.Lit):
                df = df.where(F.col(f"`{column}`") == F.lit(term.value))
            elif term.name in columns:
                df = df.where(F.col(f"`{column}`") == F.col(f"`{columns[term.name]}`"))
            else:
                columns[term.name] = column
        return df.select(*[F.col(f"`{c}`").alias(n) for n, c in columns.items()])

    @staticmethod
    def _hints(preds: list[T.Pred]) -> dict[str, set[str]]:
        """The types of the values that predicates compare variables with."""
        out: dict[str, set[str]] = {}
        for p in preds:
            given = [a.value for a in p.args if isinstance(a, T.Lit)] if p.name in ("=", "<", ">", "<=", ">=") else []
            for v in T.variables(p) if given else ():
                out[v] = {"long", "double"} if classify(given[0]) in ("long", "double") else {classify(given[0])}
        return out

    def body(self, clauses: tuple[T.Clause, ...], want: set[str], given: DataFrame | None = None) -> DataFrame:
        """The bindings of a body; want: the variables asked for (others may be left out)."""
        clauses = tuple(self._written_out(clauses))
        preds = [c for c in clauses if isinstance(c, T.Pred)]
        nots = [c for c in clauses if isinstance(c, T.Not)]
        for p in preds:
            if p.name not in PREDICATES:
                raise T.UnsupportedClause(f"unknown predicate {p.name}")
        mentioned = {v for c in [*preds, *nots] for v in T.variables(c)}
        parts = self._scans((c for c in clauses if not isinstance(c, T.Pred | T.Not)), self._hints(preds), want | mentioned)
        if given is not None:
            parts.insert(0, Part(given, {frozenset(given.columns)}, True))
        if not parts:
            raise T.QueryError("nothing to scan")
        # parts that share variables become one
        while True:
            preds, parts = self._apply(preds, parts)
            pair = self._next(parts)
            if pair is None:
                linked = self._link(preds, parts, want | mentioned)
                if linked is None:
                    break
                preds, parts = linked
                continue
            i, j = pair
            b = parts.pop(j)
            parts[i] = parts[i].meet(b)
        for p in preds:
            if not any(T.variables(p) <= set(d.columns) for d in parts):
                raise T.QueryError(f"nothing binds {', '.join(sorted(T.variables(p) - set().union(*(d.columns for d in parts))))} of {p.name}")
        need = want | mentioned
        asked = [d for d in parts if set(d.columns) & need]
        guards = [d for d in parts if not set(d.columns) & need]
        if not asked:
            asked, guards = guards[:1], guards[1:]
        # each negation belongs to the one part that it shares variables with
        for n in nots:
            shared = {v for v in T.variables(n)}
            own = [i for i, d in enumerate(asked) if shared & set(d.columns)]
            if len(own) > 1:
                # the answers are pairs of what the parts bind, less the negation: so only that is paired
                still = want | {v for m in nots for v in T.variables(m)}
                joined = reduce(lambda a, b: a.crossJoin(b), [asked[i].only(still).df for i in own])
                asked = [d for i, d in enumerate(asked) if i not in own] + [Part(joined)]
                own = [len(asked) - 1]
            at = own[0] if own else 0
            asked[at] = Part(self._without(asked[at].df, n), asked[at].keys, True)
        out = asked[0].df
        for d in asked[1:]:
            # asked for side by side: their pairs are the answer
            out = out.crossJoin(d.only(want).df) if set(d.columns) & want else _exists(out, d.df)
        for g in guards:
            out = _exists(out, g.df)
        return out

    @staticmethod
    def _next(parts: list[Part]) -> tuple[int, int] | None:
        """The two parts to join next: by a key on both sides or on one, filtered ones first; many-to-many last."""
        best = None
        for i in range(len(parts)):
            for j in range(i + 1, len(parts)):
                shared = set(parts[i].columns) & set(parts[j].columns)
                if shared:
                    keyed = sum(any(k <= shared for k in x.keys) for x in (parts[i], parts[j]))
                    rank = (-keyed, -(parts[i].narrow + parts[j].narrow), i, j)
                    best = min(best, rank) if best else rank
        return best[2:] if best else None

    def _args(self, p: T.Pred) -> list[Any]:
        return [F.col(a.name) if isinstance(a, T.Var) else F.lit(a.value) if isinstance(a, T.Lit) and p.name not in ("value-valid?", "value-invalid?") else a.value if isinstance(a, T.Lit) else a for a in p.args]

    def _apply(self, preds: list[T.Pred], parts: list[Part]) -> tuple[list[T.Pred], list[Part]]:
        left = []
        for p in preds:
            spec, names = PREDICATES[p.name], T.variables(p)
            at = next((i for i, d in enumerate(parts) if names <= set(d.columns)), None)
            if at is not None and names:
                parts[at] = Part(parts[at].df.where(spec.test(*self._args(p))), parts[at].keys, True)
                continue
            new = p.args[spec.binds].name if spec.binds is not None and isinstance(p.args[spec.binds], T.Var) else None
            if new and not any(new in d.columns for d in parts):
                at = next((i for i, d in enumerate(parts) if names - {new} <= set(d.columns)), None)
                if at is not None:
                    others = [a for i, a in enumerate(self._args(p)) if i != spec.binds]
                    parts[at] = Part(parts[at].df.withColumn(new, spec.bind(*others)), parts[at].keys, parts[at].narrow)
                    continue
            left.append(p)
        return left, parts

    def _link(self, preds: list[T.Pred], parts: list[Part], need: set[str]) -> tuple[list[T.Pred], list[Part]] | None:
        """Join two parts that only a predicate connects."""
        for p in preds:
            spec, names = PREDICATES[p.name], T.variables(p)
            own = [i for i, d in enumerate(parts) if names & set(d.columns)]
            if len(own) != 2 or not names <= set().union(*(parts[i].columns for i in own)):
                continue
            a, b = (parts[i].only(need).df for i in own)
            rest = [d for i, d in enumerate(parts) if i not in own]
            if spec.link and len(p.args) == 2:
                x, y = (v.name for v in p.args)
                both = spec.link(a, b, x, y, False) if x in a.columns else spec.link(a, b, y, x, True)
            elif spec.binds is not None and isinstance(p.args[spec.binds], T.Var):
                # the bound argument equals an expression: an equality join where the other arguments are on one side
                new = p.args[spec.binds].name
                others = [v for i, v in enumerate(self._args(p)) if i != spec.binds]
                keyed, other = (b, a) if new in a.columns else (a, b)
                if names - {new} <= set(keyed.columns):
                    both = other.join(keyed.withColumn("__k", spec.bind(*others)), other[new] == F.col("__k")).drop("__k")
                else:
                    both = a.join(b, spec.test(*self._args(p)))
            else:
                both = a.join(b, spec.test(*self._args(p)))
            return [q for q in preds if q is not p], [*rest, Part(both, set(), True)]
        # a predicate over more parts waits until two of them are one: the ones with a small side
        for p in preds:
            own = [i for i, d in enumerate(parts) if T.variables(p) & set(d.columns)]
            if len(own) >= 2:
                return preds, [d for i, d in enumerate(parts) if i not in own[:2]] + [self._paired(parts[own[0]].only(need), parts[own[1]].only(need), p)]
        return None

    @staticmethod
    def _paired(a: Part, b: Part, p: T.Pred) -> Part:
        """All pairs of two parts, one of which has FEW rows at most and is broadcast."""
        for small, large in ((a, b), (b, a)):
            if small.df.limit(FEW + 1).count() <= FEW:
                return Part(large.df.crossJoin(F.broadcast(small.df)))
        raise T.QueryError(f"{p.name} would pair two parts of more than {FEW} rows each")

    def _without(self, df: DataFrame, n: T.Not) -> DataFrame:
        """df less the rows for which the negated body holds. Variables that df doesn't bind only have to exist."""
        shared = sorted(T.variables(n) & set(df.columns))
        if n.over is not None:
            unbound = {v.name for v in n.over} - set(df.columns)
            if unbound:
                raise T.QueryError(f"nothing binds {', '.join(sorted(unbound))} outside not-join")
        # inside, the shared variables may have no scan of their own: then the outside gives their values
        inner_scans = set().union(*(T.variables(c) for c in n.body if not isinstance(c, T.Pred | T.Not))) if n.body else set()
        binds = {p.args[PREDICATES[p.name].binds].name for p in n.body if isinstance(p, T.Pred) and p.name in PREDICATES and PREDICATES[p.name].binds is not None and isinstance(p.args[PREDICATES[p.name].binds], T.Var)}
        loose = [v for v in shared if v not in inner_scans and v not in binds]
        local = {v: T.Var(_INNER + v) for c in n.body for v in _all(c) if v not in shared}
        renamed = tuple(T.substituted(c, local) for c in n.body)
        given = _set(df.select(*loose)) if loose else None
        memo = (renamed, frozenset(shared))
        if given is None and _hashable(memo):
            if memo not in self.memo:
                self.memo[memo] = self.body(renamed, set(shared))
            bad = self.memo[memo]
        else:
            bad = self.body(renamed, set(shared), given)
        if not shared:
            return df.withColumn("__one", F.lit(1)).join(F.broadcast(bad.select(F.lit(1).alias("__one")).limit(1)), "__one", "left_anti").drop("__one")
        return df.join(bad.select(*shared).distinct(), shared, "left_anti")

    # queries

    def optional(self, df: DataFrame, entity: str, attribute: str, default: Any, column: str) -> DataFrame:
        """df with a column for an attribute of the entities in one of its columns: default where an entity has none, a row for each value where it has several."""
        name = attribute.removeprefix("val/")
        if attribute in NODE_ATTRS:
            held = self.store.nodes.select(F.col("eid").alias("__e"), F.col(NODE_ATTRS[attribute]).alias("__v"))
        else:
            held = self.store.attr(name, next(iter(sorted(self.store.attr_types.get(name, ()))), classify(default))).toDF("__e", "__v")
        found = df.join(held.where("__v is not null"), F.col(entity) == F.col("__e"), "left")
        return found.select(*df.columns, F.coalesce("__v", F.lit(default)).alias(column)).distinct()

    def q(self, query: Any, *inputs: Any) -> DataFrame:
        """The answers of a query, as a set. inputs: values, lookup pairs (attribute, value) or rules, for what :in names after $."""
        if self.store.closed:
            raise T.QueryError("the store is closed")
        query = T.query(query)
        to: dict[str, T.Term] = {}
        extra: list[T.Rule] = []
        names = [p for p in query.params if p != "$"]
        if len(names) != len(inputs):
            raise T.QueryError(f":in names {len(names)} inputs, {len(inputs)} given")
        for name, value in zip(names, inputs, strict=True):
            if name == "%":
                extra += T.rules(value)
            else:
                if isinstance(value, tuple) and len(value) == 2 and isinstance(value[0], str):
                    value = self.store.lookup(value[0].removeprefix(":"), value[1])
                to[name.removeprefix("?")] = T.Lit(value)
        engine = Engine(self.store, [*(r for rs in self.rules.values() for r in rs), *extra]) if extra else self
        where = tuple(T.substituted(c, to) for c in query.where)
        find = [v.name for v in query.find]
        df = engine.body(where, set(find))
        missing = [v for v in find if v not in df.columns]
        if missing:
            raise T.QueryError(f"nothing binds {', '.join(missing)}")
        return _set(df.select(*find))


def _hashable(x: Any) -> bool:
    try:
        hash(x)
    except TypeError:
        return False
    return True


def _all(c: T.Clause) -> set[str]:
    """All variables of a clause, also those inside negations."""
    if isinstance(c, T.Not):
        return set().union(*map(_all, c.body)) | {v.name for v in c.over or ()}
    if isinstance(c, T.Or):
        return {v.name for v in c.over}
    return T.variables(c)
