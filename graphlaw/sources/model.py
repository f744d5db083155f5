"""Building a whole model: authored instances, extracted facts, calls between them, and the vocabulary itself."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlaw import vocab as V
from graphlaw.plans.registry import Instance, Registry, emit
from graphlaw.sources.extract import Facts
from graphlaw.sources.store import GraphStore

#: Gives the facts of the code that a model is about; without one there are none.
Extractor = Callable[[], Facts]


def discover(package: str) -> list[str]:
    """The modules of a package, sorted, those of tests left out."""
    root = importlib.import_module(package)
    found = [package, *(m.name for m in pkgutil.walk_packages(root.__path__, package + "."))] if hasattr(root, "__path__") else [package]
    return sorted(m for m in found if not m.rsplit(".", 1)[-1].endswith("_test"))


def authored(modules: Iterable[str]) -> list[Instance]:
    """The instances that modules hold in variables; one without an id gets module/variable, and without a name the variable's."""
    out = []
    for name in modules:
        for var, value in vars(importlib.import_module(name)).items():
            if isinstance(value, Instance):
                value.id = value.id or f"{name}/{var}"
                value.name = value.name or var
                out.append(value)
    return out


def resolve_calls(store: GraphStore, usages: DataFrame) -> DataFrame:
    """(src, dst) of usages (caller, callee), given by ids: those between two known operations, distinct, calls of oneself left out."""
    ops = store.nodes.where(F.col("tag") == V.OPERATION).select("eid", "entity_id")
    ends = usages.distinct().join(ops.toDF("src", "caller"), "caller").join(ops.toDF("dst", "callee"), "callee")
    return ends.where("src != dst").select("src", "dst").distinct()


def build(spark: SparkSession, registry: Registry, instances: Iterable[Instance], extractor: Extractor | None = None, grammar: bool = True) -> GraphStore:
    """The store of a model: authored instances, the extractor's facts, the calls among them, and (grammar) the registry reflected."""
    facts = extractor() if extractor else Facts()
    store = GraphStore.from_maps(spark, *emit(registry, [*instances, *facts.instances]))
    if facts.usages:
        store = store.add_relations("calls", resolve_calls(store, spark.createDataFrame(facts.usages, "caller string, callee string")))
    return store.fold(*emit(registry, V.reflect(registry))) if grammar else store
