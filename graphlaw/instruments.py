"""Lenses and projections that come with the engine, as instances of the shipped vocabulary, and the relations that their queries use."""

from __future__ import annotations

from graphlaw.plans.code_laws import Code
from graphlaw.plans.compiler import register_relation
from graphlaw.plans.registry import Instance, Ref
from graphlaw.vocab import LENS

register_relation("op-twin", lambda store: Code(store).twins)

_OPERATION = "(Operation ?n)"
_AUTHORED = f"{_OPERATION} (not [?n :val/extracted true])"
#: Name -> what it looks at, and the clauses that find it.
LENSES = {
    "survey": ("all that the model holds", "[?n :structure/of _]"),
    "patterns": ("whatever relates to something", "[_ :rel/from ?n]"),
    "consistency": ("authored operations, which bear the contracts", _AUTHORED),
    "callers": ("whatever calls something", "(calls ?n _)"),
    "purity": ("operations that perform an effect other than throwing", f'{_OPERATION} (performs ?n ?e) [?e :val/name ?said] [(not= ?said "throws")]'),
    "integrity": ("all that laws are about", "[?n :structure/of _]"),
    "coverage": ("operations found in code", f"{_OPERATION} [?n :val/extracted true]"),
    "drift": ("authored operations that nothing in code realizes", f"{_AUTHORED} (not (op-twin ?n _))"),
    "type-drift": ("authored operations whose twin declares a signature", "(op-twin ?n ?o) [?o :val/sig _]"),
}
CONTEXT = "These operations are modelled, and no function realizes them. Implement each of them:"


def instances() -> list[Instance]:
    """The lenses, the reader convention that covers them, and the projections."""
    out = [Instance("lens/ReaderConvention", {"prefix": "probe-"}, "instruments/readers", "readers")]
    out += [Instance(LENS, {"focus": focus, "select": (focus, f"[{query}]")}, f"instruments/{name}", name) for name, (focus, query) in LENSES.items()]
    maps = [Instance("lens/Mapping", {"from": Instance("lens/Notion", {"says": a}), "to": Instance("lens/Notion", {"says": b})}) for a, b in (("a value", "a constant"), ("a record", "a type"), ("a function", "a definition"), ("a law", "a predicate"))]
    out.append(Instance("lens/Projection", {"through": Ref("instruments/survey"), "maps": maps}, "instruments/Blueprint", "Blueprint", "The model as code to be written."))
    out.append(Instance("lens/Projection", {"contextualizes": Ref("instruments/Blueprint"), "through": Ref("instruments/drift"), "context": CONTEXT}, "instruments/DriftClose", "DriftClose", "What is missing in code, as a task."))
    group = [Ref(f"instruments/{n}") for n in (*LENSES, "Blueprint", "DriftClose")]
    return [*out, Instance("group/Grouping", {"child": group}, "instruments/all", "instruments")]
