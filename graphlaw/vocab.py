"""The shipped vocabulary: code, its modules and types, lenses and checks, and the laws about them."""

from __future__ import annotations

from collections.abc import Iterable

from graphlaw import terms as T
from graphlaw.functions import dialect
from graphlaw.functions.dialect import Schema, form_text, parse, render
from graphlaw.plans import code_laws as C
from graphlaw.plans.code_laws import EFFECT, KIND, MODULE, OPERATION, SCHEMA, SUBSYSTEM
from graphlaw.plans.registry import Instance, Law, Ref, Registry, Slot, Structure, at_most_one, emit, has, has_any

LENS, CHECK = "lens/Lens", "lens/Check"


def signature(fields: dict) -> dict:
    """Sugar: a signature [:=> [:catn [:name Type] …] Out] becomes labelled inputs and an output; one found in code is put in normal form."""
    if "sig" in fields:
        fields = fields | {"sig": normal_signature(fields["sig"])}
    if "signature" not in fields:
        return fields
    form = fields.pop("signature")
    s = parse(form)
    if s.kind != "=>" or (len(s.of) > 1 and not s.params):
        raise T.QueryError("a signature is [:=> [:catn [:name Type] …] Out] or [:=> [:cat] Out]")
    return fields | {"in": [(p, schema_instance(t)) for p, t in zip(s.params, s.of, strict=False)], "out": schema_instance(s.of[-1])}


def normal_signature(text: str) -> str:
    """A signature's text without the names of its inputs; what isn't a type stays as it is, and so differs from any."""
    try:
        return form_text(render(parse(text)))
    except (ValueError, TypeError, AttributeError, IndexError):
        return text


def schema_instance(s: Schema | str) -> Instance:
    """A type as a value: equal types are one node."""
    s = parse(s)
    fields: dict = {"kind": "string" if s.kind == "re" else s.kind}
    fields |= {k: v for k, v in (("min", s.min), ("max", s.max), ("regex", s.regex)) if v is not None}
    if s.kind == "ref":
        fields["names"] = Ref(s.names)
    if s.kind == "=>":
        fields |= {"in": [(p, schema_instance(t)) for p, t in zip(s.params or [None] * len(s.of), s.of[:-1], strict=False)], "out": schema_instance(s.of[-1])}
    elif s.of:
        fields["of"] = [schema_instance(x) for x in s.of]
    if s.fields:
        fields["field"] = [Instance("type/SchemaField", {"key": k, "schema": schema_instance(t), "optional": o}) for k, t, o in sorted(s.fields, key=lambda f: f[0])]
    if s.choices:
        # the kind is part of a choice: "a" and :a differ
        kind = lambda c: "keyword" if isinstance(c, T.Keyword) else "symbol" if isinstance(c, T.Symbol) else "boolean" if isinstance(c, bool) else "int" if isinstance(c, int) else "string"
        fields["choice"] = [Instance("type/SchemaChoice", {"value": str(c), "kind": kind(c)}) for c in s.choices]
    return Instance(SCHEMA, fields)


def shipped() -> Registry:
    """A registry with the whole shipped vocabulary."""
    many = lambda rel, to, card="many": Slot(rel, to, card)
    flag = lambda rel: Slot(rel, ":boolean", "optional")
    law = lambda desc, who, plan, scope="global": Law(desc, (who,), scope=scope, plan=plan)
    reg = Registry()
    reg.add(
        Structure("group/Connected", laws=(law("no node is isolated", "x", C.unlinked, None),)),
        Structure("group/Grouping", (many("child", "Any"),)),
        Structure(EFFECT, (Slot("name", ":string"),), value=True, reader=lambda x: {"name": str(x)}),
        Structure("type/SchemaField", (Slot("key", ":string"), Slot("schema", SCHEMA), flag("optional")), value=True),
        Structure("type/SchemaChoice", (Slot("value", ":string"), Slot("kind", '[:enum "keyword" "string" "symbol" "int" "boolean"]')), value=True),
        Structure(
            SCHEMA,
            (Slot("kind", ":string"), Slot("min", ":int", "optional"), Slot("max", ":int", "optional"), Slot("regex", ":string", "optional"), Slot("names", KIND, "optional"), many("of", SCHEMA), many("field", "type/SchemaField", "set"), many("choice", "type/SchemaChoice"), many("in", SCHEMA), Slot("out", SCHEMA, "optional")),
            (has("a reference names its target", "names", {"kind": "ref"}),),
            value=True,
            reader=lambda x: schema_instance(x).fields,
        ),
        Structure(KIND, (Slot("shape", SCHEMA, "optional"),), (at_most_one("a kind is owned by one module at most", "owns"),)),
        Structure(
            OPERATION,
            (many("in", SCHEMA), Slot("out", SCHEMA, "optional"), many("performs", EFFECT), many("delegates", OPERATION), many("dispatches-to", OPERATION), Slot("guidance", ":string", "optional"), many("calls", OPERATION), flag("private"), flag("export"), flag("test-support"), flag("extracted"), Slot("sig", ":string", "optional")),
            includes=("group/Connected",),
            syntax=signature,
        ),
        Structure(MODULE, (many("exposes", OPERATION), many("owns", KIND), many("child", "Any"), flag("extracted"))),
        Structure(SUBSYSTEM, (many("child", MODULE), many("may-depend", SUBSYSTEM))),
        Structure("code/TrustBoundary", (Slot("kind", KIND),)),
        Structure("code/Realization", laws=(law("every authored operation has a realizing operation of its name in a corresponding module", "s", C.unrealized),)),
        Structure("code/Encapsulation", laws=(law("every public extracted operation is covered by the model or exempt", "o", C.unmodelled),)),
        Structure("code/Totality", laws=(law("a reader over a trust boundary is total", "o", C.not_total),)),
        Structure("code/EffectCorrespondence", laws=(law("every effect that an operation's twin reaches is declared", "o", C.undeclared_effects),)),
        Structure("code/CallRealization", laws=(law("every intended delegation between modules is backed by a call between corresponding ones", "o1", C.not_backed),)),
        Structure("code/Fidelity", laws=(law("every call between modelled modules is covered by an intended delegation", "e1", C.not_intended),)),
        Structure(
            "code/ModuleArchitecture",
            laws=(
                law("module dependencies have no cycle", "m", C.circular_modules),
                law("a dependency between subsystems is a declared one", "m", C.undeclared_dependencies),
                law("declared subsystem dependencies have no cycle", "s", C.circular_subsystems),
                law("every authored module is in a subsystem", "mod", C.outside_subsystems),
            ),
        ),
        Structure(LENS, (Slot("focus", ":string"), Slot("select", ":string", "optional", "query"), Slot("query", ":string", "optional"))),
        Structure("lens/Notion", (Slot("says", ":string"),), value=True),
        Structure("lens/Mapping", (Slot("from", "Any"), Slot("to", "Any")), value=True),
        Structure("lens/Projection", (Slot("through", LENS, "optional"), many("maps", "lens/Mapping"), Slot("contextualizes", "lens/Projection", "optional"), Slot("context", ":string", "optional")), (has_any("a projection maps or contextualizes", "maps", "contextualizes"),)),
        Structure(CHECK, (Slot("gates", LENS), Slot("verdict", ":string"))),
        Structure("lens/ReaderConvention", (Slot("prefix", ":string"),)),
        Structure("lens/Coverage", laws=(law("every reader by convention is covered by its lens", "r", C.without_lens),)),
        Structure("grammar/Slot", (Slot("rel", ":string"), Slot("target", ":string"), Slot("card", ":string"), flag("payload"))),
        Structure("grammar/Law", (Slot("desc", ":string"), Slot("scope", ":string", "optional"), Slot("query", ":string", "optional")), (law("a reflected law is owned by a structure", "x", C.not_held("grammar/Law", "law", "grammar/Structure"), None),)),
        Structure(
            "grammar/Structure",
            (Slot("tag", ":string"), flag("value"), many("slot", "grammar/Slot"), many("includes", "grammar/Structure"), many("law", "grammar/Law"), Slot("realizes", ":string", "optional")),
            (law("a reflected structure is in a vocabulary", "x", C.not_held("grammar/Structure", "child", "grammar/Vocabulary", "said != 'Any'"), None),),
        ),
        Structure("grammar/Vocabulary", (many("child", "grammar/Structure"),)),
    )
    return reg


def spaces_from(reg: Registry, seeds: Iterable[str]) -> set[str]:
    """The namespaces that structures of the seeds refer to, by slots, facets and laws, and so on from there."""
    space = lambda tag: tag.rsplit("/", 1)[0]
    seen, todo = set(), list(seeds)
    while todo:
        now = todo.pop()
        if now in seen:
            continue
        seen.add(now)
        for s in reg.structures.values():
            if space(s.tag) == now:
                named = [*(x.target for x in s.slots if not x.scalar), *s.includes, *(x.scope for x in s.laws if x.scope and x.scope != "global")]
                todo += [space(t) for t in named if t in reg.structures]
    return seen


def reflect(reg: Registry, seeds: Iterable[str] | None = None) -> list[Instance]:
    """The registry itself as instances: a vocabulary for each namespace (of those that the seeds lead to), its structures with slots and laws, and what they are realized as."""
    if seeds is not None:
        wanted = spaces_from(reg, seeds)
        reg = Registry({t: s for t, s in reg.structures.items() if t.rsplit("/", 1)[0] in wanted})
    spaces: dict[str, list[Ref]] = {}
    out = []
    for s in reg.structures.values():
        spaces.setdefault(s.tag.rsplit("/", 1)[0], []).append(Ref(f"grammar:{s.tag}"))
        laws = [Instance("grammar/Law", {"desc": x.desc} | ({"scope": x.scope} if x.scope else {}) | ({"query": query_text(x)} if query_text(x) else {})) for x in reg.laws_of(s)]
        slots = [Instance("grammar/Slot", {"rel": x.rel, "target": x.target, "card": x.card, "payload": x.payload is not None}) for x in s.slots]
        fields = {"tag": s.tag, "value": s.value, "slot": slots, "includes": [Ref(f"grammar:{f}") for f in s.includes], "law": laws}
        if s.realized_as is not None:
            fields["realizes"] = s.realized_as if isinstance(s.realized_as, str) else form_text(s.realized_as)
        out.append(Instance("grammar/Structure", fields, f"grammar:{s.tag}", s.name, s.doc))
    return out + [Instance("grammar/Vocabulary", {"child": refs}, f"grammar:{n}", n) for n, refs in spaces.items()]


def query_text(law: Law) -> str | None:
    """A law's clauses as text; plans and laws of slots have none."""
    if law.plan is not None or not law.where or (isinstance(law.where, tuple) and isinstance(law.where[0], str)):
        return None
    return law.where if isinstance(law.where, str) else form_text(law.where)


def reflect_type(reg: Registry, form) -> tuple[str, list[dict], list[dict]] | None:
    """(id, node maps, relation maps) of a type form as values of the dialect's structure; None where no dialect is registered."""
    tag = dialect.DIALECT.get("reflect_tag")
    if tag is None:
        return None
    nodes, rels = emit(reg, [Instance(tag, reg.structures[tag].reader(form))])
    return nodes[0]["id"], nodes, rels
