"""Registered queries of the shipped vocabulary: the sample tables read as a graph of code, the laws and readings over it, and their SQL.

Nations are modules, authored and (but every fourth) found in code; customers are
operations of their nation, authored and (but every third) found in code; orders are
delegations, calls and dispatches between them; market segments are effects; suppliers are kinds of
data, types, trust boundaries and reflected laws; regions are subsystems.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlaw import instruments
from graphlaw import vocab as V
from graphlaw.operators import lens, probes, projection, readings, render
from graphlaw.operators.check import law_offenders, roll_call
from graphlaw.plans.compiler import Engine
from graphlaw.plans.registry import Instance, Ref, emit
from graphlaw.sources.store import GraphStore
from graphlaw.sources.tables import EdgeTable, NodeTable, from_tables, key_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"]


def code_graph(spark: SparkSession, sf_dir: str) -> GraphStore:
    """The tables as code; keys of authored operations are even, of those found in code odd."""
    nation, region, customer, supplier, orders = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("nation", "region", "customer", "supplier", "orders"))
    c, n, s = F.col("c_custkey"), F.col("n_nationkey"), F.col("s_suppkey")
    yes = lambda test: F.when(test, True)
    never = F.lit(None).cast("boolean")
    modules = nation.select(n.cast("long").alias("k"), F.lower("n_name").alias("name"), never.alias("extracted"))
    modules = modules.unionByName(nation.where(n % 4 != 3).select((n + 1000).cast("long").alias("k"), F.concat(F.lit("src."), F.lower("n_name")).alias("name"), F.lit(True).alias("extracted")))
    op_name = F.concat(F.lit("op"), (c % 400).cast("string")).alias("name")
    found = customer.where(c % 3 != 0)
    sig = F.when(c % 2 == 0, F.concat(F.lit("[:=> [:cat "), "s_name", F.lit("] :nil]"))).otherwise(F.lit("[:=> [:cat :int] :nil]"))
    signed = found.join(supplier.select(s.alias("c_custkey"), "s_name"), "c_custkey", "left")
    flags = [yes(F.col("c_mktsegment") == seg).alias(f) for seg, f in (("BUILDING", "private"), ("MACHINERY", "export"), ("HOUSEHOLD", "support"))]
    operations = customer.select((2 * c).alias("k"), op_name, never.alias("extracted"), *[never.alias(f) for f in ("private", "export", "support")], F.lit(None).cast("string").alias("sig"))
    operations = operations.unionByName(signed.select((2 * c + 1).alias("k"), op_name, F.lit(True).alias("extracted"), *flags, F.when(F.col("s_name").isNotNull(), sig).alias("sig")))
    place = F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment")).cast("long")
    effects = customer.select(place.alias("k"), F.when(F.col("c_mktsegment") == "HOUSEHOLD", "throws").otherwise(F.lower("c_mktsegment")).alias("name")).distinct()
    pairs = lambda test, odd: orders.where(test).join(customer.select(c.alias("o_orderkey")), "o_orderkey").select((2 * F.col("o_custkey") + odd).alias("a"), (2 * F.col("o_orderkey") + odd).alias("b"))
    structures = nation.select(n.alias("k"), "n_name", F.when(n == 0, "Any").otherwise(F.col("n_name")).alias("tag"), F.when(n % 5 == 0, "[(Operation ?x)]").alias("realizes"))
    lenses = nation.select(n.alias("k"), n.cast("string").alias("name"))
    conventions = region.where("r_regionkey in (1, 2)").select(F.col("r_regionkey").alias("k"), F.concat(F.lit("op"), F.col("r_regionkey").cast("string")).alias("prefix"))
    schemas = supplier.select(s.alias("k"), F.lit("ref").alias("kind"))
    r = F.col("r_regionkey")
    may = region.where(r < 4).select(r.alias("a"), (r + 1).alias("b")).unionByName(region.where(r == 3).select(r.alias("a"), F.lit(1).alias("b")))
    e = EdgeTable
    op, mod = V.OPERATION, V.MODULE
    inside = c % 50 != 0
    return from_tables(
        spark,
        [
            NodeTable(mod, modules, "k", "name", values={"extracted": "extracted"}),
            NodeTable(op, operations, "k", "name", values={"extracted": "extracted", "private": "private", "export": "export", "test-support": "support", "sig": "sig"}),
            NodeTable(V.EFFECT, effects, "k", values={"name": "name"}),
            NodeTable(V.KIND, supplier, "s_suppkey", "s_name"),
            NodeTable(V.SCHEMA, schemas, "k", values={"kind": "kind"}),
            NodeTable(V.SUBSYSTEM, region, "r_regionkey", "r_name"),
            NodeTable("code/TrustBoundary", supplier.where(s % 2 == 0), "s_suppkey"),
            NodeTable("lens/Lens", lenses, "k", "name"),
            NodeTable("lens/ReaderConvention", conventions, "k", values={"prefix": "prefix"}),
            NodeTable("lens/Projection", nation, "n_nationkey", "n_name"),
            NodeTable("grammar/Vocabulary", region, "r_regionkey", "r_name"),
            NodeTable("grammar/Structure", structures, "k", "n_name", values={"tag": "tag", "realizes": "realizes"}),
            NodeTable("grammar/Law", supplier, "s_suppkey", "s_name"),
        ],
        [
            e("exposes", customer.where(inside & (c % 2 == 0)).select("c_nationkey", (2 * c).alias("b")), mod, "c_nationkey", op, "b"),
            e("child", customer.where(inside & (c % 2 == 1)).select("c_nationkey", (2 * c).alias("b")), mod, "c_nationkey", op, "b"),
            e("child", found.where("c_nationkey % 4 != 3").select((F.col("c_nationkey") + 1000).alias("a"), (2 * c + 1).alias("b")), mod, "a", op, "b"),
            e("child", nation.where(n % 7 != 6), V.SUBSYSTEM, "n_regionkey", mod, "n_nationkey"),
            e("may-depend", may, V.SUBSYSTEM, "a", V.SUBSYSTEM, "b"),
            e("delegates", pairs("o_orderpriority = '1-URGENT'", 0), op, "a", op, "b"),
            e("calls", pairs("o_orderstatus = 'F' and o_custkey % 3 != 0 and o_orderkey % 3 != 0", 1), op, "a", op, "b"),
            e("dispatches-to", pairs("o_orderpriority = '5-LOW' and o_orderkey % 5 = 0", 0), op, "a", op, "b"),
            e("performs", found.where("c_acctbal < 4000").select((2 * c + 1).alias("a"), place.alias("b")).unionByName(customer.where("c_acctbal > 8000").select((2 * c).alias("a"), place.alias("b"))), op, "a", V.EFFECT, "b"),
            e("owns", supplier, mod, "s_nationkey", V.KIND, "s_suppkey"),
            e("owns", supplier.where("s_acctbal < 0").select(((F.col("s_nationkey") + 1) % 25).alias("a"), "s_suppkey"), mod, "a", V.KIND, "s_suppkey"),
            e("names", supplier.where(s % 10 != 0), V.SCHEMA, "s_suppkey", V.KIND, "s_suppkey"),
            e("in", supplier.select(s, (2 * s).alias("a"), F.lit(0).alias("o")).join(customer.select(c.alias("s_suppkey")), "s_suppkey"), op, "a", V.SCHEMA, "s_suppkey", order="o"),
            e("out", supplier.select(s, (4 * s).alias("a")).join(customer.select((2 * c).alias("a")), "a"), op, "a", V.SCHEMA, "s_suppkey"),
            e("kind", supplier.where(s % 2 == 0), "code/TrustBoundary", "s_suppkey", V.KIND, "s_suppkey"),
            e("maps", nation.where(n % 2 == 0), "lens/Projection", "n_nationkey", "lens/Lens", "n_nationkey"),
            e("contextualizes", nation.where(n % 3 == 0).select(n, F.lit(1).alias("b")), "lens/Projection", "n_nationkey", "lens/Projection", "b"),
            e("child", nation.where(n % 6 != 0), "grammar/Vocabulary", "n_regionkey", "grammar/Structure", "n_nationkey"),
            e("includes", nation.where(n % 4 == 0).select(n, ((n + 5) % 25).alias("b")), "grammar/Structure", "n_nationkey", "grammar/Structure", "b"),
            e("law", supplier.where(s % 2 == 0), "grammar/Structure", "s_nationkey", "grammar/Law", "s_suppkey"),
        ],
    )


#: The same graph: modules, operations with their nation, relations by the keys of operations.
PRE = """WITH RECURSIVE
ops AS (SELECT 2 * c_custkey AS k, 'op' || (c_custkey % 400) AS name, false AS ex, false AS priv, false AS free, CASE WHEN c_custkey % 50 <> 0 THEN c_nationkey END AS m FROM customer
 UNION ALL SELECT 2 * c_custkey + 1, 'op' || (c_custkey % 400), true, c_mktsegment = 'BUILDING', c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD'), CASE WHEN c_nationkey % 4 <> 3 THEN c_nationkey END FROM customer WHERE c_custkey % 3 <> 0),
twin AS (SELECT DISTINCT a.k AS a, b.k AS b, a.name FROM ops a JOIN ops b ON a.name = b.name AND a.m = b.m WHERE NOT a.ex AND b.ex),
pair AS (SELECT o_custkey AS x, o_orderkey AS y, o_orderpriority AS p, o_orderstatus AS s FROM orders JOIN customer ON o_orderkey = c_custkey),
dele AS (SELECT DISTINCT 2 * x AS x, 2 * y AS y FROM pair WHERE p = '1-URGENT'),
call AS (SELECT DISTINCT 2 * x + 1 AS x, 2 * y + 1 AS y FROM pair WHERE s = 'F' AND x % 3 <> 0 AND y % 3 <> 0),
disp AS (SELECT DISTINCT 2 * x AS x, 2 * y AS y FROM pair WHERE p = '5-LOW' AND y % 5 = 0),
perf AS (SELECT 2 * c_custkey + 1 AS op, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'throws' ELSE lower(c_mktsegment) END AS eff FROM customer WHERE c_acctbal < 4000 AND c_custkey % 3 <> 0
 UNION SELECT 2 * c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'throws' ELSE lower(c_mktsegment) END FROM customer WHERE c_acctbal > 8000),
reach AS (SELECT op, eff FROM perf UNION SELECT call.x, reach.eff FROM reach JOIN call ON call.y = reach.op),
meant AS (SELECT x, y, a.m AS m, b.m AS n FROM dele JOIN ops a ON a.k = x JOIN ops b ON b.k = y WHERE a.m <> b.m),
called AS (SELECT x, y, a.m AS m, b.m AS n FROM call JOIN ops a ON a.k = x JOIN ops b ON b.k = y WHERE a.m IS NOT NULL AND b.m IS NOT NULL),
owner AS (SELECT s_suppkey AS k, s_nationkey AS m FROM supplier UNION SELECT s_suppkey, (s_nationkey + 1) % 25 FROM supplier WHERE s_acctbal < 0),
takes AS (SELECT 2 * s_suppkey AS x, s_suppkey AS k, 'in' AS kind FROM supplier JOIN customer ON c_custkey = s_suppkey UNION SELECT 4 * s_suppkey, s_suppkey, 'out' FROM supplier JOIN customer ON c_custkey = 2 * s_suppkey),
dep AS (SELECT m, n FROM meant UNION SELECT o.m, owner.m FROM takes JOIN ops o ON o.k = x JOIN owner ON owner.k = takes.k WHERE takes.k % 10 <> 0 AND o.m <> owner.m),
may(s, t) AS (VALUES (0, 1), (1, 2), (2, 3), (3, 4), (3, 1)),
path AS (SELECT m, n FROM dep UNION SELECT path.m, dep.n FROM path JOIN dep ON path.n = dep.m)
"""


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if sql.startswith("SELECT *") else PRE + sql
        return f

    return put


def law(name: str, tag: str, nth: int, sql: str) -> None:
    """A shipped law: the keys of the first offenders."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = law_offenders(code_graph(spark, sf_dir), V.shipped(), tag, nth)
        return found.select(key_of(F.col(found.columns[0])).alias("k")).distinct()

    run.__name__ = name
    query(f"SELECT DISTINCT k::BIGINT AS k FROM ({sql})")(run)


UNTWINNED = "SELECT k, name FROM ops WHERE NOT ex AND k NOT IN (SELECT a FROM twin)"
UNMODELLED = "SELECT k, name, m FROM ops WHERE ex AND NOT free AND k NOT IN (SELECT b FROM twin)"
RISKY = "SELECT a AS k, name FROM twin JOIN takes ON x = a WHERE kind = 'in' AND takes.k % 10 <> 0 AND takes.k % 2 = 0 AND b IN (SELECT op FROM perf WHERE eff = 'throws')"
UNBACKED = "SELECT x AS k FROM meant WHERE (m, n) NOT IN (SELECT m, n FROM called)"
UNMEANT = "SELECT x AS k FROM called WHERE m <> n AND (m, n) NOT IN (SELECT m, n FROM meant)"
UNREAD = "SELECT k, name FROM ops WHERE ex AND left(name, 3) IN ('op1', 'op2') AND NOT (substr(name, 4) IN (SELECT n_nationkey::VARCHAR FROM nation))"
law("l1_realization", "code/Realization", 0, UNTWINNED)
law("l2_encapsulation", "code/Encapsulation", 0, UNMODELLED)
law("l3_totality", "code/Totality", 0, RISKY)
law("l4_effect_correspondence", "code/EffectCorrespondence", 0, "SELECT a AS k FROM twin JOIN reach ON op = b WHERE (a, eff) NOT IN (SELECT op, eff FROM perf)")
law("l5_call_realization", "code/CallRealization", 0, UNBACKED)
law("l6_fidelity", "code/Fidelity", 0, UNMEANT)
law("l7_module_cycles", "code/ModuleArchitecture", 0, "SELECT m AS k FROM path WHERE m = n")
law("l8_declared_dependencies", "code/ModuleArchitecture", 1, "SELECT m AS k FROM dep WHERE m % 7 <> 6 AND n % 7 <> 6 AND m % 5 <> n % 5 AND (m % 5, n % 5) NOT IN (SELECT s, t FROM may)")
law("l9_subsystem_cycles", "code/ModuleArchitecture", 2, "SELECT unnest([1, 2, 3]) AS k")
law("l10_modules_in_subsystems", "code/ModuleArchitecture", 3, "SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 7 = 6")
law("l11_kind_owned_once", V.KIND, 0, "SELECT k FROM owner GROUP BY k HAVING count(*) > 1")
law("l12_reference_names", V.SCHEMA, 0, "SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 10 = 0")
law("l13_projection_has_any", "lens/Projection", 0, "SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 2 <> 0 AND n_nationkey % 3 <> 0")
law("l14_coverage", "lens/Coverage", 0, UNREAD)
law("l15_connected", "group/Connected", 0, "SELECT k FROM ops WHERE m IS NULL AND k NOT IN (SELECT x FROM dele UNION SELECT y FROM dele UNION SELECT x FROM call UNION SELECT y FROM call UNION SELECT x FROM disp UNION SELECT y FROM disp UNION SELECT op FROM perf UNION SELECT x FROM takes)")
law("l16_law_owned", "grammar/Law", 0, "SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 2 <> 0")
law("l17_structure_in_vocabulary", "grammar/Structure", 0, "SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 6 = 0 AND n_nationkey > 0")


def reading(name: str, f: Callable[..., DataFrame], sql: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df, reg: bool = True) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = code_graph(spark, sf_dir)
        return shape(f(store, V.shipped()) if reg else f(store))

    run.__name__ = name
    query(sql)(run)


reading("q1_module_dependencies", readings.module_dependencies, "SELECT lower(a.n_name) AS m, lower(b.n_name) AS n FROM dep JOIN nation a ON a.n_nationkey = m JOIN nation b ON b.n_nationkey = n")
reading("q2_unrealized_delegates", readings.unrealized_delegates, f"SELECT DISTINCT name FROM ops JOIN ({UNBACKED}) USING (k)")
reading("q3_uncovered_calls", readings.uncovered_calls, "SELECT DISTINCT 'src.' || lower(a.n_name) AS k1, 'src.' || lower(b.n_name) AS k2 FROM called JOIN nation a ON a.n_nationkey = m JOIN nation b ON b.n_nationkey = n WHERE m <> n AND (m, n) NOT IN (SELECT m, n FROM meant)")
reading("q4_unfaithful_calls", readings.unfaithful_calls, f"SELECT DISTINCT name FROM ops JOIN ({UNMEANT}) USING (k)")
STEPS = """, step AS (SELECT x, y FROM call UNION SELECT a.b, b.b FROM disp JOIN twin a ON a.a = x JOIN twin b ON b.a = y),
goal AS (SELECT DISTINCT x, a.b AS s, b.b AS t FROM meant JOIN twin a ON a.a = x JOIN twin b ON b.a = y),
back AS (SELECT step.x AS s, y AS t FROM step WHERE y IN (SELECT t FROM goal) UNION SELECT step.x, back.t FROM back JOIN step ON step.y = back.s)
"""
reading("q5_unrealized_dispatch", readings.unrealized_dispatch, STEPS + "SELECT DISTINCT name FROM goal JOIN ops ON k = x WHERE (s, t) NOT IN (SELECT s, t FROM back)")
reading("q6_drifted_operations", readings.drifted_operations, f"SELECT DISTINCT name FROM ({UNTWINNED})")
reading("q7_uncovered_operations", readings.uncovered_operations, "SELECT DISTINCT name FROM ops WHERE ex AND k NOT IN (SELECT b FROM twin)")
reading("q8_uncovered_public_operations", readings.uncovered_public_operations, f"SELECT DISTINCT name FROM ({UNMODELLED})")


@query("SELECT o.k, CASE WHEN i.k IS NULL THEN [] ELSE [i.k] END AS ins, t.k AS result FROM ops o LEFT JOIN takes i ON i.x = o.k AND i.kind = 'in' LEFT JOIN takes t ON t.x = o.k AND t.kind = 'out'")
def q9_operation_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readings.operation_signatures(code_graph(spark, sf_dir))
    return found.select(key_of(F.col("eid")).alias("k"), F.transform("ins", key_of).alias("ins"), key_of(F.col("out")).alias("result"))


reading(
    "q10_type_drifted_operations",
    readings.type_drifted_operations,
    """SELECT DISTINCT t.name FROM twin t JOIN customer c ON t.b = 2 * c.c_custkey + 1 JOIN supplier s ON s.s_suppkey = c.c_custkey LEFT JOIN takes i ON i.x = t.a AND i.kind = 'in' LEFT JOIN takes o ON o.x = t.a AND o.kind = 'out'
 LEFT JOIN supplier si ON si.s_suppkey = i.k LEFT JOIN supplier so ON so.s_suppkey = o.k
 WHERE '[:=> [:cat' || CASE WHEN i.k IS NULL THEN '' WHEN i.k % 10 = 0 THEN ' ?' ELSE ' ' || si.s_name END || '] ' || CASE WHEN o.k IS NULL THEN ':nil' WHEN o.k % 10 = 0 THEN '?' ELSE so.s_name END || ']'
 <> CASE WHEN c.c_custkey % 2 = 0 THEN '[:=> [:cat ' || s.s_name || '] :nil]' ELSE '[:=> [:cat :int] :nil]' END""",
)
reading("q11_totality_violations", readings.totality_violations, f"SELECT DISTINCT name FROM ({RISKY})")
reading("q12_reached_effects", readings.reached_effects, "SELECT op AS k, eff AS effect FROM reach", lambda df: df.select(key_of(F.col("node")).alias("k"), F.col("label").alias("effect")), False)
reading("q13_direct_throwers", readings.direct_throwers, "SELECT DISTINCT name FROM ops JOIN perf ON op = k WHERE ex AND eff = 'throws'", reg=False)
reading("q14_throw_spread", readings.throw_spread, "SELECT name, CASE WHEN bool_or(direct) THEN 'direct' ELSE 'transitive' END AS how FROM (SELECT name, (op, eff) IN (SELECT op, eff FROM perf) AS direct FROM ops JOIN reach ON op = k WHERE ex AND eff = 'throws') GROUP BY name", reg=False)
DRIFT = """, said AS (SELECT a, b, name, eff FROM twin JOIN perf ON op = a), does AS (SELECT a, b, name, eff FROM twin JOIN reach ON op = b),
odd AS (SELECT name, eff, 'u' AS how FROM (SELECT * FROM does EXCEPT SELECT * FROM said) UNION SELECT name, eff, 'p' FROM (SELECT * FROM said EXCEPT SELECT * FROM does))
"""
DRIFTS = "SELECT name, list_sort(coalesce(list(eff) FILTER (how = 'u'), [])) AS undeclared, list_sort(coalesce(list(eff) FILTER (how = 'p'), [])) AS phantom FROM odd GROUP BY name"
reading("q15_effect_drift", readings.effect_drift, DRIFT + DRIFTS)
reading("q16_undeclared_effects", readings.undeclared_effects, DRIFT + f"SELECT name, undeclared FROM ({DRIFTS}) WHERE len(undeclared) > 0", reg=False)
WHO = ", who AS (SELECT DISTINCT y AS op, n AS m, m AS client FROM called WHERE m <> n)"


def latent(store: GraphStore) -> DataFrame:
    c = readings.Code(store)
    found = readings.latent_boundaries(c.pairs("calls"), c.places.toDF("op", "module"))
    return found.select("module", F.transform("ops", key_of).alias("ops"), "clientele")


reading(
    "q17_latent_boundaries",
    latent,
    WHO
    + """, link AS (SELECT DISTINCT a.op AS a, b.op AS b, a.m FROM who a JOIN who b ON a.m = b.m AND a.client = b.client WHERE a.op <> b.op),
grow AS (SELECT a, a AS b, m FROM link UNION SELECT grow.a, link.b, grow.m FROM grow JOIN link ON link.a = grow.b),
part AS (SELECT a AS op, m, min(b) AS root FROM grow GROUP BY a, m),
size AS (SELECT m, root, count(*) AS n FROM part GROUP BY m, root),
total AS (SELECT m, count(DISTINCT op) AS n FROM who GROUP BY m)
SELECT 'src.' || lower(x.n_name) AS module, list_sort(list(DISTINCT part.op)) AS ops, list_sort(list(DISTINCT 'src.' || lower(y.n_name))) AS clientele
FROM part JOIN size USING (m, root) JOIN total ON total.m = part.m JOIN who ON who.op = part.op JOIN nation x ON x.n_nationkey = part.m JOIN nation y ON y.n_nationkey = who.client
WHERE size.n >= 2 AND size.n < total.n GROUP BY part.m, root, x.n_name""",
    reg=False,
)
reading("q18_uncovered_readers", readings.uncovered_readers, f"SELECT DISTINCT name FROM ({UNREAD})")
reading("q19_unused_structures", projection.unused_structures, "SELECT n_name AS name FROM nation WHERE n_nationkey <> 0 AND n_nationkey % 5 <> 0 AND n_nationkey NOT IN (SELECT (n_nationkey + 5) % 25 FROM nation WHERE n_nationkey % 4 = 0)", reg=False)
reading("s5_public_operations", readings.public_operations, "SELECT k, name FROM ops WHERE ex AND NOT priv", lambda df: df.select(key_of(F.col("eid")).alias("k"), "name"), False)
CLIENTS = WHO.replace("WHERE m <> n", "JOIN ops ON ops.k = y WHERE called.m <> n AND NOT priv").replace("n AS m, m AS client", "n AS m, called.m AS client")
reading("s5_clientele", readings.clientele, CLIENTS + " SELECT op, 'src.' || lower(a.n_name) AS module, 'src.' || lower(b.n_name) AS client FROM who JOIN nation a ON a.n_nationkey = m JOIN nation b ON b.n_nationkey = client", lambda df: df.withColumn("op", key_of(F.col("op"))), False)
reading("s5_consumed", readings.consumed, CLIENTS + " SELECT 'src.' || lower(n_name) AS module, count(DISTINCT op) AS n FROM who JOIN nation ON n_nationkey = m GROUP BY n_name", reg=False)
reading("s5_co_consumed", readings.co_consumed, CLIENTS + ", least AS (SELECT m, client, min(op) AS b FROM who GROUP BY m, client) SELECT DISTINCT op AS a, b FROM who JOIN least USING (m, client) WHERE op <> b", lambda df: df.select(key_of(F.col("a")).alias("a"), key_of(F.col("b")).alias("b")), False)
reading("m8_dispatch", readings.dispatch, "SELECT a.name, list_sort(list(DISTINCT b.name)) AS handlers FROM disp JOIN ops a ON a.k = x JOIN ops b ON b.k = y GROUP BY a.name", reg=False)
reading("m8_purity", readings.purity, "SELECT 'src.' || lower(n_name) AS module, name, list_sort(list(DISTINCT eff)) AS effects FROM ops JOIN perf ON op = k JOIN nation ON n_nationkey = m WHERE ex AND eff <> 'throws' GROUP BY n_name, name", reg=False)
reading("m8_encapsulation", readings.encapsulation_by_module, f"SELECT 'src.' || lower(n_name) AS module, list_sort(list(DISTINCT name)) AS operations FROM ops JOIN nation ON n_nationkey = m WHERE ex AND NOT priv AND name IN (SELECT name FROM ({UNMODELLED})) GROUP BY n_name", reg=False)


@query("SELECT * FROM (SELECT 'code/Operation' AS structure, 13::BIGINT AS planned, 13::BIGINT AS laws)")
def d21_roll_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laws of operations by whether they can be planned: six slots have typed targets, out is one at most, six slots have typed values."""
    rows = roll_call(code_graph(spark, sf_dir), V.shipped(), [V.OPERATION])
    return rows.groupBy("structure").agg(F.count_if(F.col("status") == "planned").alias("planned"), F.count(F.lit(1)).alias("laws"))


def lens_query(name: str, sql: str) -> None:
    """A shipped lens's focus, by the tags of the nodes."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = code_graph(spark, sf_dir)
        found = lens.focus(store, V.shipped(), f"[{instruments.LENSES[name][1]}]")
        return found.join(store.nodes.select(F.col("eid").alias("n"), "tag"), "n").select("tag", key_of(F.col("n")).alias("k"))

    run.__name__ = f"n_{name.replace('-', '_')}_lens"
    query(sql)(run)


EVERY = "SELECT 'code/Module' AS tag, n_nationkey::BIGINT AS k FROM nation UNION ALL SELECT 'code/Module', 1000 + n_nationkey FROM nation WHERE n_nationkey % 4 <> 3 UNION ALL SELECT 'code/Operation', k FROM ops UNION ALL SELECT 'code/Effect', unnest(range(1, 6)) UNION ALL SELECT unnest(['code/Kind', 'type/Schema', 'grammar/Law']), s_suppkey FROM supplier UNION ALL SELECT 'code/TrustBoundary', s_suppkey FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT unnest(['code/Subsystem', 'grammar/Vocabulary']), r_regionkey FROM region UNION ALL SELECT unnest(['lens/Lens', 'lens/Projection', 'grammar/Structure']), n_nationkey FROM nation UNION ALL SELECT 'lens/ReaderConvention', unnest([1, 2])"
lens_query("survey", EVERY)
lens_query("integrity", EVERY)
lens_query("patterns", "SELECT 'code/Operation' AS tag, k::BIGINT AS k FROM (SELECT x AS k FROM dele UNION SELECT x FROM call UNION SELECT x FROM disp UNION SELECT op FROM perf UNION SELECT x FROM takes) UNION SELECT 'code/Module', m FROM ops WHERE NOT ex AND m IS NOT NULL UNION SELECT 'code/Module', 1000 + m FROM ops WHERE ex AND m IS NOT NULL UNION SELECT 'code/Module', m FROM owner UNION SELECT 'code/Subsystem', n_regionkey FROM nation WHERE n_nationkey % 7 <> 6 UNION SELECT 'code/Subsystem', s FROM may UNION SELECT 'type/Schema', s_suppkey FROM supplier WHERE s_suppkey % 10 <> 0 UNION SELECT 'code/TrustBoundary', s_suppkey FROM supplier WHERE s_suppkey % 2 = 0 UNION SELECT 'lens/Projection', n_nationkey FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0 UNION SELECT 'grammar/Vocabulary', n_regionkey FROM nation WHERE n_nationkey % 6 <> 0 UNION SELECT 'grammar/Structure', n_nationkey FROM nation WHERE n_nationkey % 4 = 0 UNION SELECT 'grammar/Structure', s_nationkey FROM supplier WHERE s_suppkey % 2 = 0")
lens_query("consistency", "SELECT 'code/Operation' AS tag, k FROM ops WHERE NOT ex")
lens_query("callers", "SELECT DISTINCT 'code/Operation' AS tag, x AS k FROM call")
lens_query("purity", "SELECT DISTINCT 'code/Operation' AS tag, op AS k FROM perf WHERE eff <> 'throws'")
lens_query("coverage", "SELECT 'code/Operation' AS tag, k FROM ops WHERE ex")
lens_query("drift", "SELECT 'code/Operation' AS tag, k FROM ops WHERE NOT ex AND k NOT IN (SELECT a FROM twin)")
lens_query("type-drift", "SELECT DISTINCT 'code/Operation' AS tag, a AS k FROM twin JOIN customer ON b = 2 * c_custkey + 1 JOIN supplier ON s_suppkey = c_custkey")


def probe(name: str, sql: str, shape: list[Column] | None = None) -> None:
    """A probe's finding over the code graph."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = probes.finding(code_graph(spark, sf_dir), V.shipped(), name)
        return found.select("lens", "as", "note", F.transform("focus", key_of).alias("focus")).select(*(shape or ["*"]))

    run.__name__ = f"b_{name.replace('-', '_')}_finding"
    query(sql)(run)


GAP = "SELECT '{0}' AS lens, 'gap' AS \"as\", name AS note, list_sort(list(DISTINCT k)) AS focus FROM ops WHERE name IN ({1}) GROUP BY name"
probe("coverage", GAP.format("coverage", "SELECT name FROM ops WHERE ex AND k NOT IN (SELECT b FROM twin)"))
probe("drift", GAP.format("drift", f"SELECT name FROM ({UNTWINNED})"))


@query("SELECT * FROM (SELECT 'callers' AS lens, 10::BIGINT AS n)")
def b_callers_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.finding(code_graph(spark, sf_dir), V.shipped(), "callers").groupBy("lens").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT k, name || '(' || CASE WHEN i IS NULL THEN '' ELSE '_ ' || i END || ') -> ' || coalesce(o, ':nil') || CASE WHEN e IS NULL THEN '' ELSE ' performs ' || e END AS text FROM (SELECT o.k, o.name, max(CASE WHEN t.kind = 'in' THEN CASE WHEN t.k % 10 = 0 THEN '?' ELSE s_name END END) AS i, max(CASE WHEN t.kind = 'out' THEN CASE WHEN t.k % 10 = 0 THEN '?' ELSE s_name END END) AS o, max(eff) AS e FROM ops o LEFT JOIN takes t ON t.x = o.k LEFT JOIN supplier ON s_suppkey = t.k LEFT JOIN perf ON op = o.k GROUP BY o.k, o.name)")
def m1_operation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations as text: inputs, output, effects."""
    return render.operations(code_graph(spark, sf_dir)).select(key_of(F.col("eid")).alias("k"), "text")


@query("SELECT r_name AS subsystem, '[' || coalesce(mods, '') || ']' || CASE WHEN deps IS NULL THEN '' ELSE ' -> ' || deps END AS text FROM region LEFT JOIN (SELECT n_regionkey AS r, string_agg(lower(n_name), ' ' ORDER BY lower(n_name)) AS mods FROM nation WHERE n_nationkey % 7 <> 6 GROUP BY 1) ON r = r_regionkey LEFT JOIN (SELECT s, string_agg(r_name, ' ' ORDER BY r_name) AS deps FROM may JOIN region ON r_regionkey = t GROUP BY s) ON s = r_regionkey")
def m6_architecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.architecture(code_graph(spark, sf_dir))


@query("SELECT a AS k, b FROM twin")
def j15_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generating relation of twins, in a query."""
    return Engine(code_graph(spark, sf_dir), V.shipped().rules()).q("[:find ?a ?b :where (op-twin ?a ?b)]").select(key_of(F.col("a")).alias("k"), key_of(F.col("b")).alias("b"))


@query("SELECT name, lower(n_name) AS place FROM ops JOIN nation ON n_nationkey = m WHERE NOT ex UNION SELECT name, 'src.' || lower(n_name) FROM ops JOIN nation ON n_nationkey = m WHERE ex")
def s4_in_module_v7_substrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that no slot gives: where an operation lies, and its name."""
    return Engine(code_graph(spark, sf_dir), V.shipped().rules()).q("[:find ?n ?m :where (Operation ?x) (in-module ?x ?m) (named ?x ?n)]").toDF("name", "place")


def with_instruments(spark: SparkSession, sf_dir: str) -> GraphStore:
    """The code graph with the shipped lenses and projections, and a check of the drift lens, folded onto it."""
    gate = Instance(V.CHECK, {"gates": Ref("instruments/drift"), "verdict": "realize it"}, "gate")
    return code_graph(spark, sf_dir).fold(*emit(V.shipped(), [*instruments.instances(), gate])).stored()


@query(f"SELECT 'gate' AS \"check\", 'realize it' AS verdict, count(*) AS n FROM ({UNTWINNED})")
def q21_run_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks whose lenses find anything, with how much."""
    found = lens.run_checks(with_instruments(spark, sf_dir), V.shipped())
    return found.groupBy("check", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT k, '{instruments.CONTEXT}' || chr(10) || name || '(' || CASE WHEN i IS NULL THEN '' ELSE '_ ' || i END || ') -> ' || coalesce(o, ':nil') || CASE WHEN e IS NULL THEN '' ELSE ' performs ' || e END AS text FROM (SELECT u.k, u.name, max(CASE WHEN t.kind = 'in' THEN CASE WHEN t.k % 10 = 0 THEN '?' ELSE s_name END END) AS i, max(CASE WHEN t.kind = 'out' THEN CASE WHEN t.k % 10 = 0 THEN '?' ELSE s_name END END) AS o, max(eff) AS e FROM ({UNTWINNED}) u LEFT JOIN takes t ON t.x = u.k LEFT JOIN supplier ON s_suppkey = t.k LEFT JOIN perf ON op = u.k GROUP BY u.k, u.name)")
def m2_contextualized_m3_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the drift lens finds, in a projection that lays its context over another."""
    store, reg = with_instruments(spark, sf_dir), V.shipped()
    found = lens.evaluate(store, reg, store.lookup("entity/id", "instruments/drift"))
    return projection.materialize(store, reg, "DriftClose", found).select(key_of(F.col("n")).alias("k"), "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
