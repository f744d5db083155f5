"""The type forms of slots and signatures: reading, rendering, and checking as columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from graphlaw.terms import Keyword, QueryError, Symbol, read_form

SCALARS = ("int", "string", "boolean", "keyword", "double", "any", "nil")
#: typeof() of the values of each scalar.
HELD = {"int": ("bigint", "int"), "string": ("string",), "boolean": ("boolean",), "keyword": ("string",), "double": ("double", "float")}


@dataclass(frozen=True)
class Schema:
    """A type: kind, its bounds or pattern or choices or target, and the types within. Fields of a map are (key, Schema, optional)."""

    kind: str
    min: int | None = None
    max: int | None = None
    regex: str | None = None
    names: str | None = None
    of: tuple[Schema, ...] = ()
    fields: frozenset[tuple[str, Schema, bool]] = frozenset()
    choices: tuple[Any, ...] = field(default=())
    params: tuple[str, ...] = ()


def parse(form: Any) -> Schema:
    """A schema from a form or its text."""
    if isinstance(form, Schema):
        return form
    if isinstance(form, str) and not isinstance(form, Keyword | Symbol):
        form = read_form(form)
    if isinstance(form, Symbol):
        return Schema("ref", names=str(form))
    if isinstance(form, Keyword):
        if form not in SCALARS:
            raise QueryError(f"unknown type :{form}")
        return Schema(str(form))
    if form is None:
        return Schema("nil")
    if not isinstance(form, list) or not form or not isinstance(form[0], Keyword):
        raise QueryError(f"not a type: {form!r}")
    head, *rest = form
    props = rest.pop(0) if rest and isinstance(rest[0], dict) else {}
    if head in SCALARS:
        return Schema(str(head), props.get(Keyword("min")), props.get(Keyword("max")), props.get(Keyword("re")))
    if head in ("vector", "set", "sequential", "tuple", "or", "and", "map-of"):
        if head in ("vector", "set", "sequential") and len(rest) != 1 or head == "map-of" and len(rest) != 2:
            raise QueryError(f"wrong number of parts: {form!r}")
        return Schema(str(head), props.get(Keyword("min")), props.get(Keyword("max")), of=tuple(map(parse, rest)))
    if head == "map":
        entries = []
        for key, *value in rest:
            optional = bool(value and isinstance(value[0], dict) and value[0].get(Keyword("optional")))
            entries.append((_text(key), parse(value[-1]), optional))
        return Schema("map", fields=frozenset(entries))
    if head == "enum":
        return Schema("enum", choices=tuple(rest))
    if head == "re":
        return Schema("re", regex=rest[0])
    if head == "ref":
        return Schema("ref", names=str(rest[0]))
    if head == "=>":
        inputs, out = rest
        if not isinstance(inputs, list) or inputs[:1] not in ([Keyword("cat")], [Keyword("catn")]):
            raise QueryError(f"inputs must be [:catn …] or [:cat …]: {form!r}")
        named = inputs[0] == "catn"
        return Schema("=>", of=(*(parse(p[1] if named else p) for p in inputs[1:]), parse(out)), params=tuple(str(p[0]) for p in inputs[1:]) if named else ())
    raise QueryError(f"unknown type {form!r}")


def _text(x: Any) -> str:
    return f":{x}" if isinstance(x, Keyword) else str(x)


def form_text(x: Any) -> str:
    """A form as text."""
    if isinstance(x, Keyword):
        return f":{x}"
    if isinstance(x, Symbol):
        return str(x)
    if isinstance(x, bool) or x is None:
        return {True: "true", False: "false", None: "nil"}[x]
    if isinstance(x, str):
        return '"' + x.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    if isinstance(x, dict):
        return "{" + ", ".join(f"{form_text(k)} {form_text(v)}" for k, v in x.items()) + "}"
    if isinstance(x, list):
        return "[" + " ".join(map(form_text, x)) + "]"
    if isinstance(x, tuple):
        return "(" + " ".join(map(form_text, x)) + ")"
    if isinstance(x, frozenset | set):
        return "#{" + " ".join(sorted(map(form_text, x))) + "}"
    return str(x)


def render(s: Schema | None) -> Any:
    """The form of a schema; fields of maps by key. What can't be rendered is a placeholder, never an error."""
    if s is None:
        return Keyword("any")
    k = Keyword(s.kind)
    bounds = {Keyword(n): v for n, v in (("min", s.min), ("max", s.max), ("re", s.regex)) if v is not None}
    if s.kind in SCALARS:
        return [k, bounds] if bounds else k
    if s.kind in ("vector", "set", "sequential", "tuple", "or", "and", "map-of"):
        return [k, *([bounds] if bounds else []), *map(render, s.of)]
    if s.kind == "map":
        entry = lambda key, value, opt: [Keyword(key[1:]) if key.startswith(":") else key, *([{Keyword("optional"): True}] if opt else []), render(value)]
        return [k, *(entry(*f) for f in sorted(s.fields, key=lambda f: f[0]))]
    if s.kind == "enum":
        return [k, *s.choices]
    if s.kind == "re":
        # a pattern is a string with one: both ways to write it are one type
        return [Keyword("string"), {Keyword("re"): s.regex}]
    if s.kind == "ref":
        return Symbol(s.names or "?")
    if s.kind == "=>":
        return [k, [Keyword("cat"), *map(render, s.of[:-1])], render(s.of[-1])]
    return [Keyword("unknown"), s.kind]


def valid(form: Any, v: Column, of: DataType | None = None) -> Column:
    """Whether a value is of the type, as a column: true or false, never null for a value that is there.

    of: the column's type, where it is an array or a map; other columns hold scalars, which
    are of no type of collections.
    """
    s = parse(form)
    kind = F.typeof(v)
    if s.kind in ("any", "ref"):
        return F.lit(True)
    if s.kind == "nil":
        return v.isNull()
    if s.kind in HELD:
        ok = kind.isin(*HELD[s.kind])
        if s.kind in ("int", "double"):
            for bound, test in ((s.min, lambda c, b: c >= b), (s.max, lambda c, b: c <= b)):
                ok = ok & test(v.cast("double"), F.lit(float(bound))) if bound is not None else ok
        elif s.kind == "string":
            n = F.length(v.cast("string"))
            ok = ok & (n >= s.min) if s.min is not None else ok
            ok = ok & (n <= s.max) if s.max is not None else ok
            ok = ok & F.regexp_like(v.cast("string"), F.lit(f"^(?:{s.regex})$")) if s.regex else ok
        return F.coalesce(ok, F.lit(False))
    if s.kind == "enum":
        choices = [(str(c), ("string",)) if isinstance(c, str) else (str(c).lower(), ("boolean",)) if isinstance(c, bool) else (str(c), ("bigint", "int")) for c in s.choices]
        return F.coalesce(reduce(lambda a, b: a | b, ((v.cast("string") == c) & kind.isin(*t) for c, t in choices), F.lit(False)), F.lit(False))
    if s.kind == "re":
        return F.coalesce(kind.isin("string") & F.regexp_like(v.cast("string"), F.lit(s.regex)), F.lit(False))
    if s.kind in ("or", "and"):
        parts = [valid(p, v, of) for p in s.of]
        return reduce((lambda a, b: a | b) if s.kind == "or" else (lambda a, b: a & b), parts)
    if s.kind in ("vector", "sequential", "set") and isinstance(of, ArrayType):
        each = F.forall(v, lambda x: valid(s.of[0], x, of.elementType))
        return F.coalesce(each & (F.size(F.array_distinct(v)) == F.size(v)) if s.kind == "set" else each, F.lit(False))
    if s.kind == "map-of" and isinstance(of, MapType):
        entries = F.map_entries(v)
        return F.coalesce(F.forall(entries, lambda e: valid(s.of[0], e["key"], of.keyType) & valid(s.of[1], e["value"], of.valueType)), F.lit(False))
    if s.kind == "tuple" and isinstance(of, StructType) and len(of.fields) == len(s.of):
        return F.coalesce(reduce(lambda a, b: a & b, (valid(t, v[f.name], f.dataType) for t, f in zip(s.of, of.fields, strict=True)), v.isNotNull()), F.lit(False))
    if s.kind == "map" and isinstance(of, StructType):
        fields = {f.name: f.dataType for f in of.fields}
        wanted = {k.removeprefix(":"): (t, o) for k, t, o in s.fields}
        if not set(fields) <= set(wanted):
            return F.lit(False)
        one = lambda k, t, o: F.when(v[k].isNull(), F.lit(o)).otherwise(valid(t, v[k], fields[k])) if k in fields else F.lit(o)
        return F.coalesce(reduce(lambda a, b: a & b, (one(k, t, o) for k, (t, o) in wanted.items()), v.isNotNull()), F.lit(False))
    return F.lit(False)


def adheres(authored: Schema, realized: Schema) -> bool:
    """Two signatures agree: equal outputs, equal inputs in order; what isn't a signature never does."""
    if authored.kind != "=>" or realized.kind != "=>":
        return False
    return form_text(render(authored)) == form_text(render(realized))


def matches(form: Any, value: Any) -> bool:
    """Whether a Python value is of the type."""
    s = parse(form)
    if s.kind in ("any", "ref"):
        return True
    if s.kind == "nil":
        return value is None
    if s.kind == "int":
        return isinstance(value, int) and not isinstance(value, bool) and (s.min is None or value >= s.min) and (s.max is None or value <= s.max)
    if s.kind == "double":
        return isinstance(value, float) and (s.min is None or value >= s.min) and (s.max is None or value <= s.max)
    if s.kind == "boolean":
        return isinstance(value, bool)
    if s.kind in ("string", "keyword"):
        return isinstance(value, str) and (s.min is None or len(value) >= s.min) and (s.max is None or len(value) <= s.max) and (not s.regex or re.fullmatch(s.regex, value) is not None)
    if s.kind == "enum":
        return any(type(value) is type(c) and value == c or isinstance(c, str) and isinstance(value, str) and str(c) == str(value) for c in s.choices)
    if s.kind == "re":
        return isinstance(value, str) and re.search(s.regex, value) is not None
    if s.kind == "or":
        return any(matches(p, value) for p in s.of)
    if s.kind == "and":
        return all(matches(p, value) for p in s.of)
    if s.kind in ("vector", "sequential", "set"):
        return isinstance(value, list | tuple | set | frozenset) and (isinstance(value, set | frozenset) == (s.kind == "set")) and all(matches(s.of[0], x) for x in value)
    if s.kind == "tuple":
        return isinstance(value, list | tuple) and len(value) == len(s.of) and all(map(matches, s.of, value))
    if s.kind == "map-of":
        return isinstance(value, dict) and all(matches(s.of[0], k) and matches(s.of[1], x) for k, x in value.items())
    if s.kind == "map":
        keys = {k.removeprefix(":"): (t, o) for k, t, o in s.fields}
        return isinstance(value, dict) and all(k in keys for k in value) and all(matches(t, value[k]) if k in value else o for k, (t, o) in keys.items())
    return False


#: What the engine asks of types, by name; None where nothing is registered. Parts can be replaced one by one.
DIALECT: dict[str, Any] = {"parse": parse, "render": render, "adheres": adheres, "valid": valid, "reflect_tag": "type/Schema"}


def register(**parts: Any) -> None:
    """Replace parts of the dialect: parse(form), render(type), adheres(a, b), valid(form, column), reflect_tag."""
    unknown = set(parts) - {"parse", "render", "adheres", "valid", "reflect_tag"}
    if unknown:
        raise QueryError(f"a dialect has no {', '.join(sorted(unknown))}")
    DIALECT.update(parts)


def clear() -> None:
    """Leave no dialect registered."""
    DIALECT.clear()


def ask(part: str, *args: Any) -> Any:
    """A part of the dialect, applied; None where there is none."""
    f = DIALECT.get(part)
    return f(*args) if f is not None else None


def value_valid(form: Any, v: Column) -> Column:
    """Whether a value is of the type, by the registered dialect. Without one this is an error: a law that passes unchecked is worse."""
    f = DIALECT.get("valid")
    if f is None:
        raise QueryError(f"no type dialect is registered that could check {form_text(form)}")
    return f(form, v)
