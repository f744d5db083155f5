import sys
import types

import pytest

from graphlaw import vocab as V
from graphlaw.operators import projection, readings
from graphlaw.plans.registry import Instance, Ref
from graphlaw.sources import extract, model
from tests.test_engine import rows


@pytest.fixture(scope="module")
def built(spark):
    reg = V.shipped()
    spec = types.ModuleType("spec_of_shop")
    spec.pay = Instance(V.OPERATION, {"performs": ["io"], "guidance": "be quick"}, doc="Takes money.")
    spec.shop = Instance(V.MODULE, {"child": [Ref("spec_of_shop/pay")]})
    spec.base = Instance("lens/Projection", {"maps": [Instance("lens/Mapping", {"from": Ref("spec_of_shop/pay"), "to": Ref("spec_of_shop/shop")})]}, name="Blueprint")
    spec.close = Instance("lens/Projection", {"contextualizes": Ref("spec_of_shop/base"), "context": "Close the gap."}, name="Close")
    sys.modules["spec_of_shop"] = spec
    code = "def pay():\n    print(1)\n    check()\n\ndef check():\n    pass\n"
    store = model.build(spark, reg, model.authored(["spec_of_shop"]), lambda: extract.source("app.shop", code))
    return store, reg


def test_discover():
    found = model.discover("graphlaw.plans")
    assert found == sorted(found) and "graphlaw.plans.compiler" in found


def test_build(built):
    store, reg = built
    assert rows(readings.drifted_operations(store, reg)) == []
    assert rows(readings.uncovered_operations(store, reg)) == [("check",)]
    assert rows(readings.effect_drift(store, reg)) == []


def test_projections(built):
    store, reg = built
    q = '[(Operation ?n) [?n :val/guidance _]]'
    assert [r.text for r in projection.materialize(store, reg, "Close", q).collect()] == ["Close the gap.\npay() -> :nil performs io\nTakes money.\nguidance: be quick"]
    assert [r.text for r in projection.materialize(store, reg, "Docs", q).collect()] == ["pay\nTakes money."]
    assert [r.text for r in projection.module(store, reg, "Docs", "shop").collect()] == ["pay\nTakes money."]
    unused = {r.name for r in projection.unused_structures(store).collect()}
    assert {"Realization", "TrustBoundary"} <= unused and not {"Connected", "Operation", "Module"} & unused


def test_without_extractor(spark):
    reg = V.shipped()
    store = model.build(spark, reg, [Instance(V.OPERATION, {}, "m/f")], grammar=False)
    assert store.nodes.count() == 1 and rows(readings.drifted_operations(store, reg)) == []
