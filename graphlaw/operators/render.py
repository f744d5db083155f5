"""Texts of graph contents: types, operations, instances, violations, the architecture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlaw.functions.dialect import form_text
from graphlaw.plans.registry import Registry, Structure
from graphlaw.sources.shared import written
from graphlaw.sources.store import GraphStore


def _ordered(store: GraphStore, kind: str, forms: DataFrame) -> DataFrame:
    """(eid, text): the forms of a node's targets of one kind, in order."""
    e = store.edges.where(F.col("kind") == kind).select("src", "dst", F.coalesce("ord", F.lit(-1)).alias("ord"), F.coalesce("label", F.lit("")).alias("label"))
    e = e.join(forms.toDF("dst", "form"), "dst")
    return e.groupBy(F.col("src").alias("eid")).agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("ord", "form"))), lambda x: x["form"])).alias("text"))


#: Stands for a type whose text isn't known yet.
OPEN = "\0"


def schema_forms(store: GraphStore) -> DataFrame:
    """(eid, form): the text of every stored type, however deep; a type that holds itself shows as … where it does."""
    schemas = store.nodes.where("tag = 'type/Schema'").select("eid")
    text = lambda a: store.attr(a, "string").select(F.col("e").alias("eid"), F.col("v").alias(a))
    number = lambda a: store.attr(a, "long").select(F.col("e").alias("eid"), F.col("v").alias(a))
    base = schemas.join(text("kind"), "eid", "left").join(text("regex"), "eid", "left").join(number("min"), "eid", "left").join(number("max"), "eid", "left")
    names = store.edges.where("kind = 'names'").select(F.col("src").alias("eid"), "dst").join(store.nodes.select(F.col("eid").alias("dst"), F.col("name").alias("target")), "dst").select("eid", "target")
    value = F.when(F.col("kind") == "string", F.concat(F.lit('"'), "value", F.lit('"'))).when(F.col("kind") == "keyword", F.concat(F.lit(":"), "value")).otherwise(F.col("value"))
    choices = store.attr("value", "string").select(F.col("e").alias("eid"), F.col("v").alias("value")).join(text("kind"), "eid").select("eid", value.alias("form"))
    base = base.join(names, "eid", "left").join(_ordered(store, "choice", choices).withColumnRenamed("text", "choices"), "eid", "left")
    bounds = F.concat_ws(", ", F.when(F.col("min").isNotNull(), F.concat(F.lit(":min "), F.col("min").cast("string"))), F.when(F.col("max").isNotNull(), F.concat(F.lit(":max "), F.col("max").cast("string"))), F.when(F.col("regex").isNotNull(), F.concat(F.lit(':re "'), "regex", F.lit('"'))))
    wrapped = F.when(bounds != "", F.concat(F.lit("[:"), "kind", F.lit(" {"), bounds, F.lit("}]"))).otherwise(F.concat(F.lit(":"), "kind"))
    leaf = F.when(F.col("kind") == "ref", F.coalesce("target", F.lit("?"))).when(F.col("kind") == "enum", F.concat(F.lit("[:enum "), F.coalesce("choices", F.lit("")), F.lit("]")))
    compound = ["vector", "set", "sequential", "tuple", "or", "and", "map-of"]
    has = {r["kind"] for r in base.select("kind").distinct().collect()}
    forms = base.select("eid", F.when(F.col("kind").isin([*compound, "map", "=>"]), F.lit(OPEN)).otherwise(F.coalesce(leaf, wrapped)).alias("form"))
    if not has & {*compound, "map", "=>"}:
        return forms
    base = written(base.withColumn("leaf", F.coalesce(leaf, wrapped)), "types")
    forms = written(forms, "forms")
    left, before = forms.where(F.contains("form", F.lit(OPEN))).count(), None
    while left and left != before:  # a round completes the types whose parts are complete
        of = _ordered(store, "of", forms).withColumnRenamed("text", "of")
        ins = _ordered(store, "in", forms).withColumnRenamed("text", "ins")
        outs = _ordered(store, "out", forms).withColumnRenamed("text", "outs")
        field_schema = store.edges.where("kind = 'schema'").select(F.col("src").alias("eid"), "dst").join(forms.toDF("dst", "form"), "dst").select("eid", "form")
        keys = store.attr("key", "string").select(F.col("e").alias("eid"), F.col("v").alias("key")).join(store.attr("optional", "boolean").select(F.col("e").alias("eid"), F.col("v").alias("opt")), "eid", "left")
        entry = F.concat(F.lit("["), "key", F.when(F.coalesce("opt", F.lit(False)), F.lit(" {:optional true} ")).otherwise(F.lit(" ")), "form", F.lit("]"))
        fields = store.edges.where("kind = 'field'").select(F.col("src"), F.col("dst").alias("eid")).join(keys.join(field_schema, "eid").select("eid", "key", entry.alias("entry")), "eid")
        fields = fields.groupBy(F.col("src").alias("eid")).agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("key", "entry"))), lambda x: x["entry"])).alias("fields"))
        rows = base.select("eid", "kind", "leaf").join(of, "eid", "left").join(ins, "eid", "left").join(outs, "eid", "left").join(fields, "eid", "left")
        space = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(" "), c)).otherwise(F.lit(""))
        form = F.when(F.col("kind").isin(compound), F.concat(F.lit("[:"), "kind", space("of"), F.lit("]"))).when(F.col("kind") == "map", F.concat(F.lit("[:map"), space("fields"), F.lit("]"))).when(F.col("kind") == "=>", F.concat(F.lit("[:=> [:cat"), space("ins"), F.lit("] "), F.coalesce("outs", F.lit(":nil")), F.lit("]"))).otherwise(F.col("leaf"))
        forms = written(rows.select("eid", form.alias("form")), "forms")
        left, before = forms.where(F.contains("form", F.lit(OPEN))).count(), left
    return forms.withColumn("form", F.replace("form", F.lit(OPEN), F.lit("…"))) if left else forms


def operations(store: GraphStore) -> DataFrame:
    """(eid, text): each operation with its inputs and their names, its output, effects and guidance."""
    forms = schema_forms(store)
    ops = store.nodes.where("tag = 'code/Operation'").select("eid", "name", "doc")
    e = store.edges.where("kind = 'in'").select("src", "dst", F.coalesce("ord", F.lit(-1)).alias("ord"), F.coalesce("label", F.lit("_")).alias("label")).join(forms.toDF("dst", "form"), "dst")
    ins = e.groupBy(F.col("src").alias("eid")).agg(F.concat_ws(", ", F.transform(F.sort_array(F.collect_list(F.struct("ord", F.concat_ws(" ", "label", "form").alias("x")))), lambda v: v["x"])).alias("ins"))
    outs = _ordered(store, "out", forms).withColumnRenamed("text", "out")
    effects = _ordered(store, "performs", store.attr("name", "string").select(F.col("e").alias("eid"), F.col("v").alias("form"))).withColumnRenamed("text", "effects")
    guide = store.attr("guidance", "string").select(F.col("e").alias("eid"), F.col("v").alias("guidance"))
    rows = ops.join(ins, "eid", "left").join(outs, "eid", "left").join(effects, "eid", "left").join(guide, "eid", "left")
    text = F.concat(F.col("name"), F.lit("("), F.coalesce("ins", F.lit("")), F.lit(") -> "), F.coalesce("out", F.lit(":nil")), F.when(F.col("effects").isNotNull(), F.concat(F.lit(" performs "), "effects")).otherwise(F.lit("")), F.when(F.col("doc").isNotNull(), F.concat(F.lit("\n"), "doc")).otherwise(F.lit("")), F.when(F.col("guidance").isNotNull(), F.concat(F.lit("\nguidance: "), "guidance")).otherwise(F.lit("")))
    return rows.select("eid", text.alias("text"))


def architecture(store: GraphStore) -> DataFrame:
    """(subsystem, text): each subsystem with its modules in order and what it may depend on."""
    names = store.nodes.select("eid", F.col("name").alias("form"))
    subs = store.nodes.where("tag = 'code/Subsystem'").select("eid", "name")
    rows = subs.join(_ordered(store, "child", names).withColumnRenamed("text", "modules"), "eid", "left").join(_ordered(store, "may-depend", names).withColumnRenamed("text", "deps"), "eid", "left")
    return rows.select(F.col("name").alias("subsystem"), F.concat(F.lit("["), F.coalesce("modules", F.lit("")), F.lit("]"), F.when(F.col("deps").isNotNull(), F.concat(F.lit(" -> "), "deps")).otherwise(F.lit(""))).alias("text")).orderBy("subsystem")


def instance(store: GraphStore, reg: Registry, eid: int) -> str:
    """One node as the form that would author it."""
    e = store.entity(eid)
    if e is None:
        return "nil"
    s = reg.structures.get(e.get("structure/of", ""))
    rels = store.edges.where(F.col("src") == eid).join(store.nodes.select(F.col("eid").alias("dst"), F.col("entity_id").alias("to"), F.col("name").alias("to_name")), "dst", "left").orderBy(F.coalesce("ord", F.lit(-1)), "rid").collect()
    parts = []
    for slot in s.slots if s else ():
        if slot.scalar:
            if f"val/{slot.rel}" in e:
                parts.append(f":{slot.rel} {form_text(e[f'val/{slot.rel}'])}")
            continue
        items = [f"[{r['label']} {r['to_name'] or r['to']}]" if r["label"] else (r["to_name"] or r["to"] or "nil") for r in rels if r["kind"] == slot.rel]
        if items:
            parts.append(f":{slot.rel} " + (items[0] if slot.card in ("one", "optional") else f"[{' '.join(items)}]"))
    head = " ".join(x for x in (s.name if s else "?", e.get("entity/name"), form_text(e["entity/doc"]) if e.get("entity/doc") else None) if x)
    return f"({head}{' {' + ', '.join(parts) + '}' if parts else ''})"


def focus_text(store: GraphStore, reg: Registry, nodes: DataFrame) -> str:
    """The nodes (n) as the forms that would author them, by tag and name, an empty line between. For reading: one lookup a node."""
    rows = nodes.select("n").distinct().join(store.nodes.select(F.col("eid").alias("n"), "tag", "name"), "n").orderBy("tag", F.coalesce("name", F.lit("")), "n").select("n").collect()
    return "\n\n".join(instance(store, reg, r["n"]) for r in rows)


def show(store: GraphStore, reg: Registry, name: str) -> str:
    """Every node of a name as its form."""
    return focus_text(store, reg, store.nodes.where(F.col("name") == name).select(F.col("eid").alias("n")))


def violations_text(store: GraphStore, reg: Registry, found: DataFrame) -> str:
    """Offences with each offender quoted as its form. For reading: one lookup an offender."""
    rows = found.orderBy("structure", "law", "offenders").collect()
    if not rows:
        return "Every law holds."
    quoted = lambda x: "\n".join(f"  {line}" for line in (instance(store, reg, int(x)) if x is not None else "nil").splitlines())
    return "\n\n".join("\n".join([f"{r['law']}  [{r['structure'].rsplit('/', 1)[-1]}]", *map(quoted, r["offenders"])]) for r in rows)


def structure(s: Structure) -> str:
    """A declared structure as text."""
    shape = {"one": "{}", "optional": "[:? {}]", "many": "[:* {}]", "some": "[:+ {}]", "set": "[:set {}]"}
    slots = " ".join(f":{x.rel} {shape[x.card].format(x.target)}" for x in s.slots)
    parts = [s.name, *([form_text(s.doc)] if s.doc else []), *(f"(includes {f})" for f in s.includes), *([f"{{{slots}}}"] if slots else []), *(f"(law {form_text(x.desc)})" for x in s.laws)]
    return f"(structure {' '.join(parts)})"


def primer(reg: Registry) -> str:
    return "\n".join(structure(s) for s in sorted(reg.structures.values(), key=lambda s: s.tag))


def violations(store: GraphStore, found: DataFrame) -> DataFrame:
    """(text): a line for each offence, its offenders by name where they have one."""
    each = found.select("structure", "law", F.monotonically_increasing_id().alias("i"), F.posexplode_outer("offenders").alias("p", "o"))
    named = each.join(store.nodes.select(F.col("eid").cast("string").alias("o"), "name"), "o", "left").withColumn("said", F.coalesce("name", "o", F.lit("")))
    who = named.groupBy("i", "structure", "law").agg(F.concat_ws(", ", F.transform(F.sort_array(F.collect_list(F.struct("p", "said"))), lambda x: x["said"])).alias("who"))
    return who.select(F.concat_ws(": ", "structure", "law", "who").alias("text")).orderBy("text")
