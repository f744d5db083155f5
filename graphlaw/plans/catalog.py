"""The registered queries of the graph engine over the sample tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlaw.functions import dialect, predicates
from graphlaw.operators import fixpoint, lens, probes
from graphlaw.operators.check import check
from graphlaw.plans import code_catalog
from graphlaw.plans.code_laws import OPERATION
from graphlaw.plans.compiler import Engine, register_relation
from graphlaw.plans.registry import Law, Registry, Slot, Structure, at_most_one, has, has_any, matched_by, target
from graphlaw.sources.model import resolve_calls
from graphlaw.sources.shared import numbered
from graphlaw.sources.store import GraphStore
from graphlaw.sources.tables import SPAN, EdgeTable, NodeTable, from_tables, key_of

#: Order lines between two nations from which on they count as trading.
TRADE = 150


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry() -> Registry:
    """The sample tables as structures."""
    return Registry().add(
        Structure("shop/Party"),
        Structure("shop/Region", (Slot("name-of", ":string", "optional"),)),
        Structure("shop/Nation", (Slot("in-region", "shop/Region"),), (matched_by("a nation has a customer", "in-nation", "shop/Customer"),)),
        Structure("shop/Customer", (Slot("in-nation", "shop/Nation"), Slot("segment", '[:enum "AUTOMOBILE" "BUILDING" "FURNITURE" "MACHINERY" "HOUSEHOLD"]')), includes=("shop/Party",)),
        Structure("shop/Supplier", (Slot("in-nation", "shop/Nation"), Slot("balance", "[:double {:min 0}]"), Slot("ships", "shop/Order", "many")), includes=("shop/Party",)),
        Structure("shop/Part", (Slot("size", "[:int {:min 1 :max 50}]"),)),
        Structure(
            "shop/Order",
            (Slot("placed-by", "shop/Customer"), Slot("contains", "shop/Part", "some"), Slot("status", '[:enum "F" "O"]')),
            (Law("large orders are urgent", ("o",), '[[?o :val/total ?t] [(> ?t 400000.0)] [?o :val/priority ?p] [(not= ?p "1-URGENT")]]'),),
        ),
        Structure("shop/Rich", realized_as='[[?e :structure/of "shop/Customer"] [?e :val/balance ?b] [(> ?b 9000.0)]]'),
        Structure("shop/linked", coproduct=("in-nation", "placed-by")),
        Structure("shop/order-nation", derived=(("o", "n"), "[(placed-by ?o ?c) (in-nation ?c ?n)]")),
    )


def graph(spark: SparkSession, sf_dir: str) -> GraphStore:
    nation, customer, supplier, part, orders, line = (table(spark, sf_dir, n) for n in ("nation", "customer", "supplier", "part", "orders", "lineitem"))
    return from_tables(
        spark,
        [
            NodeTable("shop/Region", table(spark, sf_dir, "region"), "r_regionkey", "r_name"),
            NodeTable("shop/Nation", nation, "n_nationkey", "n_name", values={"key": "n_nationkey"}),
            NodeTable("shop/Customer", customer, "c_custkey", "c_name", values={"key": "c_custkey", "balance": "c_acctbal", "segment": "c_mktsegment"}),
            NodeTable("shop/Supplier", supplier, "s_suppkey", "s_name", values={"key": "s_suppkey", "balance": "s_acctbal"}),
            NodeTable("shop/Part", part, "p_partkey", "p_name", values={"key": "p_partkey", "brand": "p_brand", "size": "p_size"}),
            NodeTable("shop/Order", orders, "o_orderkey", values={"key": "o_orderkey", "status": "o_orderstatus", "total": "o_totalprice", "priority": "o_orderpriority"}),
        ],
        [
            EdgeTable("in-region", nation, "shop/Nation", "n_nationkey", "shop/Region", "n_regionkey"),
            EdgeTable("in-nation", customer, "shop/Customer", "c_custkey", "shop/Nation", "c_nationkey"),
            EdgeTable("in-nation", supplier, "shop/Supplier", "s_suppkey", "shop/Nation", "s_nationkey"),
            EdgeTable("placed-by", orders, "shop/Order", "o_orderkey", "shop/Customer", "o_custkey"),
            EdgeTable("contains", line, "shop/Order", "l_orderkey", "shop/Part", "l_partkey", order="l_linenumber"),
            EdgeTable("ships", line, "shop/Supplier", "l_suppkey", "shop/Order", "l_orderkey"),
        ],
    )


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): nations from whose suppliers customers of another nation buy much."""
    t = lambda name: table(spark, sf_dir, name)
    j = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    j = j.join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src")), "l_suppkey").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst")), "o_custkey")
    return j.groupBy("src", "dst").count().where(f"count >= {TRADE} and src != dst").select(F.col("src").cast("long"), F.col("dst").cast("long"))


TRADE_SQL = f"""trade AS (SELECT s_nationkey::BIGINT AS src, c_nationkey::BIGINT AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY s_nationkey, c_nationkey HAVING count(*) >= {TRADE})"""
PATHS_SQL = f"WITH RECURSIVE {TRADE_SQL}, path AS (SELECT src, dst FROM trade UNION SELECT p.src, t.dst FROM path p JOIN trade t ON p.dst = t.src)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def datalog(name: str, text: str, columns: list[str], sql: str, *inputs) -> None:
    """A registered query in the query language, over the sample graph and its vocabulary."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(graph(spark, sf_dir), registry().rules()).q(text, *inputs).toDF(*columns)

    run.__name__ = name
    query(sql)(run)


datalog(
    "flagship_nation_regions",
    "[:find ?n ?r :where (in-region ?x ?y) [?x :entity/name ?n] [?y :entity/name ?r]]",
    ["nation", "region"],
    "SELECT DISTINCT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey",
)
datalog("p2_collection", "[:find [?b ...] :where [?p :val/brand ?b]]", ["brand"], "SELECT DISTINCT p_brand AS brand FROM part")
datalog(
    "p4_constants_and_joins",
    '[:find ?k ?n :where [?c :structure/of "shop/Customer"] [?c :val/segment "BUILDING"] [?c :val/key ?k] (in-nation ?c ?x) [?x :entity/name ?n]]',
    ["custkey", "nation"],
    "SELECT DISTINCT c_custkey AS custkey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'",
)
datalog(
    "p5_shared_variable",
    "[:find ?a ?b :where (Customer ?c) (Supplier ?s) (in-nation ?c ?n) (in-nation ?s ?n) [?c :val/balance ?x] [(> ?x 9000.0)] [?s :val/balance ?y] [(> ?y 5000.0)] [?c :val/key ?a] [?s :val/key ?b]]",
    ["custkey", "suppkey"],
    "SELECT DISTINCT c_custkey AS custkey, s_suppkey AS suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal > 9000 AND s_acctbal > 5000",
)
datalog(
    "p8_comparisons",
    "[:find ?k :where [?p :val/size ?s] [(>= ?s 10)] [(< ?s 20)] [(not= ?s 15)] [?p :val/key ?k] (Part ?p)]",
    ["partkey"],
    "SELECT DISTINCT p_partkey AS partkey FROM part WHERE p_size >= 10 AND p_size < 20 AND p_size <> 15",
)
datalog(
    "p9_membership_p10_prefix",
    '[:find ?k ?s :where (Order ?o) [?o :val/status ?s] [(contains? #{"F" "P"} ?s)] [?o :val/priority ?p] [(starts-with? ?p "1-")] [?o :val/key ?k]]',
    ["orderkey", "status"],
    "SELECT DISTINCT o_orderkey AS orderkey, o_orderstatus AS status FROM orders WHERE o_orderstatus IN ('F', 'P') AND starts_with(o_orderpriority, '1-')",
)
datalog(
    "p11_concat_binds",
    '[:find ?n :where (Region ?x) [?x :entity/name ?r] [(reader-realizes? ?n "region-" ?r)]]',
    ["reader"],
    "SELECT DISTINCT 'region-' || r_name AS reader FROM region",
)
datalog(
    "p14_parameters",
    "[:find ?k :in $ ?seg ?least :where [?c :val/segment ?seg] [?c :val/balance ?b] [(>= ?b ?least)] [?c :val/key ?k]]",
    ["custkey"],
    "SELECT DISTINCT c_custkey AS custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal >= 1000.0",
    "MACHINERY",
    1000.0,
)
datalog(
    "p15_caller_rules",
    '[:find ?n ?k :in $ % :where (big ?o ?k) (order-nation ?o ?x) [?x :entity/name ?n]]',
    ["nation", "orderkey"],
    "SELECT DISTINCT n_name AS nation, o_orderkey AS orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000.0",
    "[[(big ?o ?k) (Order ?o) [?o :val/total ?t] [(> ?t 300000.0)] [?o :val/key ?k]]]",
)
datalog(
    "r1_union_r2_or_join",
    '[:find ?k ?n :where (or-join [?x ?k] (and (Customer ?x) [?x :val/key ?k] [?x :val/segment "AUTOMOBILE"]) (and (Supplier ?x) [?x :val/key ?k])) (in-nation ?x ?y) [?y :entity/name ?n]]',
    ["key", "nation"],
    "SELECT c_custkey AS key, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'AUTOMOBILE' UNION SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)
datalog(
    "j3_self_join_unequal",
    "[:find ?a ?b :where (in-region ?x ?r) (in-region ?y ?r) [?x :entity/name ?a] [?y :entity/name ?b] [(not= ?x ?y)]]",
    ["a", "b"],
    "SELECT DISTINCT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey",
)
datalog(
    "j4_ordered_pairs",
    "[:find ?a ?b :where (in-region ?x ?r) (in-region ?y ?r) [?x :entity/name ?a] [?y :entity/name ?b] [(< ?a ?b)]]",
    ["a", "b"],
    "SELECT DISTINCT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name",
)
datalog(
    "j5_not_existential",
    "[:find ?k :where (Order ?o) [?o :val/key ?k] (not (contains ?o ?p))]",
    ["orderkey"],
    "SELECT DISTINCT o_orderkey AS orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
)
datalog(
    "j6_not_join",
    '[:find ?k :where (Customer ?c) [?c :val/key ?k] (not-join [?c] (placed-by ?o ?c) [?o :val/status "F"])]',
    ["custkey"],
    "SELECT DISTINCT c_custkey AS custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
)
datalog(
    "j8_negated_rule",
    '[:find ?n :in $ % :where (Nation ?x) [?x :entity/name ?n] (not (rich-nation ?x))]',
    ["nation"],
    "SELECT DISTINCT n_name AS nation FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900)",
    "[[(rich-nation ?x) (in-nation ?c ?x) (Rich ?c) [?c :val/balance ?b] [(> ?b 9900.0)]]]",
)
datalog(
    "j11_existence_guard",
    '[:find ?r :where (Region ?x) [?x :entity/name ?r] [?o :val/status "F"]]',
    ["region"],
    "SELECT DISTINCT r_name AS region FROM region WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F')",
)
datalog(
    "j12_semi_join",
    "[:find ?k :where (ships ?s ?o) [?s :val/key ?k] [?o :val/total ?t] [(> ?t 350000.0)]]",
    ["suppkey"],
    "SELECT DISTINCT l_suppkey AS suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 350000",
)
datalog(
    "v2_facet",
    "[:find ?k ?n :where (Party ?x) [?x :val/key ?k] (in-nation ?x ?y) [?y :entity/name ?n]]",
    ["key", "nation"],
    "SELECT c_custkey AS key, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)
datalog("v3_realized", "[:find ?k :where (Rich ?x) [?x :val/key ?k]]", ["custkey"], "SELECT DISTINCT c_custkey AS custkey FROM customer WHERE c_acctbal > 9000")
datalog(
    "v4_coproduct",
    "[:find ?a ?b :where (linked ?x ?y) [?x :val/key ?a] [?y :val/key ?b]]",
    ["a", "b"],
    "SELECT o_orderkey AS a, o_custkey AS b FROM orders UNION SELECT c_custkey, c_nationkey FROM customer UNION SELECT s_suppkey, s_nationkey FROM supplier",
)
datalog(
    "v5_derived",
    '[:find ?k ?n :where (order-nation ?o ?x) [?o :val/key ?k] [?x :entity/name ?n]]',
    ["orderkey", "nation"],
    "SELECT DISTINCT o_orderkey AS orderkey, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
)


def trade_store(spark: SparkSession, sf_dir: str) -> GraphStore:
    nation = table(spark, sf_dir, "nation")
    return from_tables(spark, [NodeTable("shop/Nation", nation, "n_nationkey", "n_name", values={"key": "n_nationkey"})], [EdgeTable("trades", trade(spark, sf_dir), "shop/Nation", "src", "shop/Nation", "dst")])


REACH = """[[(trades ?a ?b) [?r :rel/kind "trades"] [?r :rel/from ?a] [?r :rel/to ?b]]
 [(reach ?a ?b) (trades ?a ?b)]
 [(reach ?a ?b) (trades ?a ?m) (reach ?m ?b)]]"""


@query(PATHS_SQL + " SELECT DISTINCT a.n_name AS a, b.n_name AS b FROM path JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey")
def r3_transitive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule that applies itself, over a graph with cycles."""
    q = "[:find ?an ?bn :in $ % :where (reach ?a ?b) [?a :entity/name ?an] [?b :entity/name ?bn]]"
    return Engine(trade_store(spark, sf_dir)).q(q, REACH).toDF("a", "b")


@query(PATHS_SQL + " SELECT DISTINCT n_name AS nation FROM path JOIN nation ON src = n_nationkey WHERE src = dst")
def r6_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(trade_store(spark, sf_dir)).q("[:find ?n :in $ % :where (reach ?a ?a) [?a :entity/name ?n]]", REACH).toDF("nation")


@query(PATHS_SQL + " SELECT a.n_name AS a, b.n_name AS b FROM (SELECT DISTINCT src FROM trade) x JOIN (SELECT DISTINCT dst FROM trade) y ON true JOIN nation a ON x.src = a.n_nationkey JOIN nation b ON y.dst = b.n_nationkey WHERE NOT EXISTS (SELECT 1 FROM path p WHERE p.src = x.src AND p.dst = y.dst)")
def r8_unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursion under a negation: the closure is finished first."""
    q = "[:find ?an ?bn :in $ % :where (trades ?a ?x) (trades ?y ?b) [?a :entity/name ?an] [?b :entity/name ?bn] (not (reach ?a ?b))]"
    return Engine(trade_store(spark, sf_dir)).q(q, REACH).toDF("a", "b")


@query("SELECT c_custkey AS custkey, count(*) + 1 AS size FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def r7_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of customers and their orders; customers without orders are in none."""
    edges = graph(spark, sf_dir).edges.where("kind = 'placed-by'").select("src", "dst")
    parts = fixpoint.connected_components(edges)
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return parts.where((F.col("node") >= 2 * SPAN) & (F.col("node") < 3 * SPAN)).join(sizes, "component").select(key_of(F.col("node")).alias("custkey"), "size")


NEXT_SQL = "nxt AS (SELECT DISTINCT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events)"


@query(f"WITH RECURSIVE {NEXT_SQL}, reach AS (SELECT DISTINCT user_id % 7 AS label, event_type AS node FROM events WHERE value > 95 UNION SELECT r.label, n.src FROM reach r JOIN nxt n ON n.dst = r.node) SELECT node, label FROM reach")
def r9_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that travel back along the edges between event types."""
    e = table(spark, sf_dir, "events")
    follow = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    edges = e.select(F.col("event_type").alias("src"), follow.alias("dst")).where("dst is not null").distinct()
    labels = e.where("value > 95").select(F.col("event_type").alias("node"), (F.col("user_id") % 7).alias("label")).distinct()
    return fixpoint.reach_labels(labels, edges)


@query("SELECT 'shop/Region' AS tag, count(*) AS n FROM region UNION ALL SELECT 'shop/Nation', count(*) FROM nation UNION ALL SELECT 'shop/Customer', count(*) FROM customer UNION ALL SELECT 'shop/Supplier', count(*) FROM supplier UNION ALL SELECT 'shop/Part', count(*) FROM part UNION ALL SELECT 'shop/Order', count(*) FROM orders")
def b1_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.survey(graph(spark, sf_dir))


@query("SELECT * FROM (SELECT 'shop/Nation' AS source, 'in-region' AS kind, 'shop/Region' AS target, count(*) AS n FROM nation UNION ALL SELECT 'shop/Customer', 'in-nation', 'shop/Nation', count(*) FROM customer UNION ALL SELECT 'shop/Supplier', 'in-nation', 'shop/Nation', count(*) FROM supplier UNION ALL SELECT 'shop/Order', 'placed-by', 'shop/Customer', count(*) FROM orders UNION ALL SELECT 'shop/Order', 'contains', 'shop/Part', count(DISTINCT (l_orderkey, l_partkey, l_linenumber)) FROM lineitem UNION ALL SELECT 'shop/Supplier', 'ships', 'shop/Order', count(DISTINCT (l_suppkey, l_orderkey)) FROM lineitem) WHERE n > 1")
def b2_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.patterns(graph(spark, sf_dir))


@query("SELECT p_name AS name, list_sort(list(DISTINCT p_brand)) AS modules FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def b3_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names that several brands use, the brands being the modules."""
    part = table(spark, sf_dir, "part")
    brand = part.groupBy("p_brand").agg(F.min("p_partkey").alias("b"))
    held = part.join(brand, "p_brand")
    store = from_tables(spark, [NodeTable("shop/Part", part, "p_partkey", "p_name"), NodeTable("shop/Brand", brand, "b", "p_brand")], [EdgeTable("child", held, "shop/Brand", "b", "shop/Part", "p_partkey")])
    return probes.consistency(store, "shop/Part")


@query("WITH held AS (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem), shipped AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem), e AS (SELECT 0 AS t, n_nationkey AS k FROM nation UNION ALL SELECT 1, n_regionkey FROM nation UNION ALL SELECT 2, c_custkey FROM customer UNION ALL SELECT 0, c_nationkey FROM customer UNION ALL SELECT 3, s_suppkey FROM supplier UNION ALL SELECT 0, s_nationkey FROM supplier UNION ALL SELECT 4, o_orderkey FROM orders UNION ALL SELECT 2, o_custkey FROM orders UNION ALL SELECT 4, l_orderkey FROM held UNION ALL SELECT 5, l_partkey FROM held UNION ALL SELECT 3, l_suppkey FROM shipped UNION ALL SELECT 4, l_orderkey FROM shipped) SELECT list_extract(['Nation', 'Region', 'Customer', 'Supplier', 'Order', 'Part'], t + 1) AS tag, k::BIGINT AS key, count(*) AS degree FROM e GROUP BY t, k ORDER BY degree DESC, list_extract([1, 0, 2, 3, 5, 4], t + 1), k LIMIT 10")
def b4_callers_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array(*map(F.lit, ["Region", "Nation", "Customer", "Supplier", "Part", "Order"]))
    return probes.callers(graph(spark, sf_dir)).select(F.get(tags, F.floor(F.col("eid") / SPAN).cast("int")).alias("tag"), key_of(F.col("eid")).alias("key"), "degree")


@query("""SELECT * FROM (SELECT 'shop/Order' AS structure, 'Order.contains requires at least one (found none)' AS law, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
 UNION ALL SELECT 'shop/Order', 'Order.status value must satisfy [:enum "F" "O"]', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
 UNION ALL SELECT 'shop/Order', 'large orders are urgent', count(*) FROM orders WHERE o_totalprice > 400000 AND o_orderpriority <> '1-URGENT'
 UNION ALL SELECT 'shop/Supplier', 'Supplier.balance value must satisfy [:double {:min 0}]', count(*) FROM supplier WHERE s_acctbal < 0
 UNION ALL SELECT 'shop/Nation', 'a nation has a customer', count(*) FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey)
 UNION ALL SELECT 'shop/Customer', 'Customer.segment value must satisfy [:enum "AUTOMOBILE" "BUILDING" "FURNITURE" "MACHINERY" "HOUSEHOLD"]', count(*) FROM customer WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY', 'HOUSEHOLD')
 UNION ALL SELECT 'shop/Part', 'Part.size value must satisfy [:int {:max 50, :min 1}]', count(*) FROM part WHERE p_size NOT BETWEEN 1 AND 50
 UNION ALL SELECT 'shop/Region', 'none', 0) WHERE n > 0""")
def d20_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All laws of the sample vocabulary, declared and from slots: offences counted by law."""
    return check(graph(spark, sf_dir), registry(), strict=True).groupBy("structure", "law").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT l_orderkey AS orderkey, l_linenumber::BIGINT AS line FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def d16_found_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-slot with several relations: places of an order that more than one line takes."""
    line = table(spark, sf_dir, "lineitem")
    place = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    # relations of one place are told apart by their number there
    nth = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(F.xxhash64(*line.columns)))
    line = line.select(place.alias("place"), "l_partkey", nth.alias("i"))
    places = line.select("place").distinct()
    part = table(spark, sf_dir, "part")
    reg = Registry().add(Structure("shop/Part"), Structure("shop/Place", (Slot("holds", "shop/Part"),)))
    store = from_tables(spark, [NodeTable("shop/Place", places, "place"), NodeTable("shop/Part", part, "p_partkey")], [EdgeTable("holds", line, "shop/Place", "place", "shop/Part", "l_partkey", order="i")])
    found = check(store, reg, ["shop/Place"], strict=True).where(F.col("law").contains("several"))
    key = F.get("offenders", F.lit(0)).cast("long")
    return found.select(F.floor(key_of(key) / 100).alias("orderkey"), (key_of(key) % 100).alias("line"))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def d9_has(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The has combinator: documents without a label."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    reg = Registry().add(Structure("text/Label"), Structure("text/Document", laws=(has("documents are labelled", "labelled"),)))
    store = from_tables(spark, [NodeTable("text/Document", docs, "doc_id"), NodeTable("text/Label", labels, "doc_id")], [EdgeTable("labelled", labels, "text/Document", "doc_id", "text/Label", "doc_id")])
    return check(store, reg, strict=True).select(key_of(F.get("offenders", F.lit(0)).cast("long")).alias("doc_id"))


@query("SELECT DISTINCT l_orderkey AS orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate")
def p8_across_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that ship before their order's date, each line a node."""
    line = table(spark, sf_dir, "lineitem")
    # a line is named by its order and its number there; no hash, so no two become one
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", F.xxhash64(*line.columns)))
    line = line.select("l_orderkey", "l_shipdate", nth.alias("nth"))
    line = line.withColumn("id", F.when(F.col("nth") < 1024, F.col("l_orderkey") * 1024 + F.col("nth")).otherwise(F.raise_error(F.lit("an order of 1024 lines"))))
    orders = table(spark, sf_dir, "orders")
    store = from_tables(spark, [NodeTable("shop/Line", line, "id", values={"ships-on": "l_shipdate"}), NodeTable("shop/Order", orders, "o_orderkey", values={"key": "o_orderkey", "date": "o_orderdate"})], [EdgeTable("of", line, "shop/Line", "id", "shop/Order", "l_orderkey")])
    q = '[:find ?k :where [?r :rel/kind "of"] [?r :rel/from ?l] [?r :rel/to ?o] [?l :val/ships-on ?s] [?o :val/date ?d] [(< ?s ?d)] [?o :val/key ?k]]'
    return Engine(store).q(q).toDF("orderkey")


@query("SELECT DISTINCT c_custkey AS custkey FROM customer WHERE c_acctbal > 9000 AND c_mktsegment = 'BUILDING'")
def q20_lens_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, reg = graph(spark, sf_dir), registry()
    rich = lens.focus(store, reg, "[(Rich ?n)]")
    return lens.refine(store, reg, rich, '[[?n :val/segment "BUILDING"]]').select(key_of(F.col("n")).alias("custkey"))


MUCH = "l_quantity >= 50 and l_discount >= 0.1 and l_tax >= 0.07"


@query(f"SELECT DISTINCT s_suppkey AS suppkey FROM supplier EXCEPT SELECT DISTINCT l_suppkey FROM lineitem WHERE {MUCH}")
def u2_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").where(MUCH)
    store = from_tables(spark, [NodeTable("shop/Supplier", table(spark, sf_dir, "supplier"), "s_suppkey"), NodeTable("shop/Order", table(spark, sf_dir, "orders"), "o_orderkey")], [EdgeTable("ships-much", line, "shop/Supplier", "l_suppkey", "shop/Order", "l_orderkey")])
    out = Engine(store).q('[:find ?s :where [?s :structure/of "shop/Supplier"] (not-join [?s] [?r :rel/from ?s] [?r :rel/kind "ships-much"])]')
    return out.select(key_of(F.col("s")).alias("suppkey"))


@query("SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def o1_ordered_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of an ordered slot, by their order."""
    c = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 10_000 + F.col("turn"))
    store = from_tables(spark, [NodeTable("chat/Turn", c, "id", values={"role": "role"}), NodeTable("chat/Talk", c.select("conv_id").distinct(), "conv_id")], [EdgeTable("turn", c, "chat/Talk", "conv_id", "chat/Turn", "id", order="turn")])
    role = store.attr("role", "string").select(F.col("e").alias("dst"), F.col("v").alias("role"))
    rows = store.edges.where("kind = 'turn'").join(role, "dst")
    return rows.groupBy(key_of(F.col("src")).alias("conv_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "role"))), lambda x: x["role"]).alias("roles"))


@query("""WITH h AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host FROM pages WHERE url IS NOT NULL)
 SELECT a.host AS short, b.host AS long FROM h a JOIN h b ON len(regexp_split_to_array(a.host, '[-.]')) <= len(regexp_split_to_array(b.host, '[-.]'))
 AND regexp_split_to_array(b.host, '[-.]')[-len(regexp_split_to_array(a.host, '[-.]')):] = regexp_split_to_array(a.host, '[-.]')""")
def j9_suffix_correspondence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host names whose segments end another's, by equality with every suffix."""
    hosts = table(spark, sf_dir, "pages").where("url is not null").select(F.regexp_extract("url", r"^[a-z]+://([^/:]+)", 1).alias("host")).distinct()
    hosts = numbered(hosts, [F.col("host")], "id")
    store = from_tables(spark, [NodeTable("web/Host", hosts, "id", "host")], [])
    return Engine(store).q("[:find ?a ?b :where [?x :entity/name ?a] [?y :entity/name ?b] [(module-corresponds? ?a ?b)]]").toDF("short", "long")


@query("SELECT p_partkey AS partkey, p_size BETWEEN 5 AND 40 AS sized, regexp_full_match(p_brand, 'Brand#[1-3][0-9]') AS branded FROM part")
def t3_value_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("long")
    return p.select(F.col("p_partkey").alias("partkey"), dialect.valid("[:int {:min 5 :max 40}]", size).alias("sized"), dialect.valid('[:re "^Brand#[1-3][0-9]$"]', F.col("p_brand")).alias("branded"))


# the store

@query("SELECT r_name AS name, 1::BIGINT AS n FROM region")
def s8_insert_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph put into itself stays as it is."""
    store = graph(spark, sf_dir)
    both = store.insert(store)
    return both.nodes.where("tag = 'shop/Region'").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def region_facts(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """Facts of the five regions, each told twice, and two values of one attribute."""
    out = []
    for r in table(spark, sf_dir, "region").collect():  # five rows
        e = r["r_regionkey"]
        out += [(e, "structure/of", "Region"), (e, "entity/name", r["r_name"]), (e, "val/size", e), (e, "val/size", e * 10), (e, "val/size", e)]
    return out * 2


@query("SELECT r_name AS name, r_regionkey::BIGINT AS size FROM region UNION SELECT r_name, r_regionkey * 10 FROM region")
def s11_datoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts are a set by entity, attribute and value."""
    store = GraphStore.from_datoms(spark, region_facts(spark, sf_dir))
    return Engine(store).q("[:find ?n ?s :where [?x :entity/name ?n] [?x :val/size ?s]]").toDF("name", "size")


@query("SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT 'NOWHERE', 'ASIA'")
def s14_maps_s16_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph from node and relation maps, and more of them folded onto it: known ids keep their entity."""
    regions, nations = table(spark, sf_dir, "region").collect(), table(spark, sf_dir, "nation").collect()
    link = lambda a, b: {"id": f"{a}|in|{b}", "from": a, "kind": "in", "to": b}
    store = GraphStore.from_maps(spark, [{"id": f"r{r['r_regionkey']}", "tag": "Region", "name": r["r_name"]} for r in regions], [])
    nodes = [{"id": f"n{n['n_nationkey']}", "tag": "Nation", "name": n["n_name"]} for n in nations] + [{"id": "r2", "tag": "Region"}, {"id": "x", "tag": "Nation", "name": "NOWHERE"}]
    store = store.fold(nodes, [*(link(f"n{n['n_nationkey']}", f"r{n['n_regionkey']}") for n in nations), link("x", "r2")])
    return Engine(store).q("[:find ?a ?b :where [?r :rel/kind \"in\"] [?r :rel/from ?x] [?r :rel/to ?y] [?x :entity/name ?a] [?y :entity/name ?b]]").toDF("nation", "region")


@query("SELECT DISTINCT a.c_custkey AS src, b.c_custkey AS dst FROM orders JOIN customer a ON o_custkey = a.c_custkey JOIN customer b ON o_orderkey = b.c_custkey WHERE a.c_custkey <> b.c_custkey")
def s19_resolve_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usages by id between operations that are known; others, repeats and calls of oneself go."""
    ops = table(spark, sf_dir, "customer")
    store = from_tables(spark, [NodeTable(OPERATION, ops, "c_custkey", "c_name")], [])
    usages = table(spark, sf_dir, "orders").select(F.concat_ws("/", F.lit(OPERATION), "o_custkey").alias("caller"), F.concat_ws("/", F.lit(OPERATION), "o_orderkey").alias("callee"))
    found = store.add_relations("calls", resolve_calls(store, usages)).edges
    return found.select(key_of(F.col("src")).alias("src"), key_of(F.col("dst")).alias("dst"))


@query("SELECT 'lookup' AS what, 3::BIGINT AS v UNION ALL SELECT 'unknown', NULL UNION ALL SELECT 'attributes', 5 UNION ALL SELECT 'largest', max(o_orderkey) FROM orders")
def s25_entity_s26_lookup_s27_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lookups: a node by its name, all that is known of it, and the largest id of the nodes."""
    store = graph(spark, sf_dir)
    at = store.lookup("entity/name", "NATION_3")
    rows = [("lookup", at % SPAN), ("unknown", store.lookup("entity/name", "NATION_X")), ("attributes", len(store.entity(at))), ("largest", GraphStore(spark, store.nodes, store.edges.limit(0)).max_eid() % SPAN)]
    return spark.createDataFrame(rows, "what string, v long")


# queries

datalog("p6_blanks", "[:find ?k :where [_ :rel/kind ?k]]", ["kind"], "SELECT unnest(['in-region', 'in-nation', 'placed-by', 'contains', 'ships']) AS kind")
datalog(
    "p7_literals",
    '[:find ?k :where [?o :val/status "F"] [?o :val/priority "1-URGENT"] [?o :val/key ?k] [?p :val/size 7]]',
    ["orderkey"],
    "SELECT o_orderkey AS orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
)
datalog(
    "j1_three_ways",
    "[:find ?r ?s :where (in-region ?n ?x) [?x :entity/name ?r] (in-nation ?s1 ?n) (Supplier ?s1) [?s1 :val/key ?s] [?s1 :val/balance ?b] [(< ?b 0.0)]]",
    ["region", "suppkey"],
    "SELECT DISTINCT r_name AS region, s_suppkey AS suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal < 0",
)


@query("SELECT n_name AS nation, w.v AS weight FROM nation JOIN (VALUES (0, 'a'), (3, 'b'), (3, 'c')) w(k, v) ON n_regionkey = w.k")
def s6_constant_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    eng = Engine(graph(spark, sf_dir), registry().rules()).constant("weight", [(SPAN * 0 + 0, "a"), (3, "b"), (3, "c")], "region long, weight string")
    return eng.q("[:find ?n ?w :where (in-region ?x ?r) [?x :entity/name ?n] (weight ?r ?w)]").toDF("nation", "weight")


@query("SELECT c_custkey AS custkey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < (SELECT avg(c_acctbal) FROM customer) / 100")
def x1_predicate_x2_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate and a generating relation of one's own."""
    predicates.register("hundredth?", predicates.Predicate(lambda x, y: x < y / 100))
    register_relation("average-balance", lambda store: store.attr("balance", "double", frozenset({"shop/Customer"})).agg(F.avg("v")))
    return Engine(graph(spark, sf_dir), registry().rules()).q("[:find ?k ?n :where (average-balance ?a) (Customer ?c) [?c :val/balance ?b] [(hundredth? ?b ?a)] [?c :val/key ?k] (in-nation ?c ?x) [?x :entity/name ?n]]").toDF("custkey", "nation")


@query("SELECT o_orderkey AS orderkey, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 400000")
def r5_recursion_over_coproduct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From orders to regions along relations of three kinds, by a rule over their union."""
    reg = registry().add(Structure("shop/up", coproduct=("placed-by", "in-nation", "in-region")))
    big = "[[(above ?a ?b) (up ?a ?b)] [(above ?a ?b) (up ?a ?m) (above ?m ?b)]]"
    q = "[:find ?k ?n :in $ % :where (above ?o ?x) (Region ?x) [?x :entity/name ?n] (Order ?o) [?o :val/total ?t] [(> ?t 400000.0)] [?o :val/key ?k]]"
    return Engine(graph(spark, sf_dir), reg.rules()).q(q, big).toDF("orderkey", "region")


@query("SELECT doc_id, coalesce(l.toxic, -1)::BIGINT AS toxic FROM documents LEFT JOIN labels l USING (doc_id)")
def j13_optional_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id").distinct(), table(spark, sf_dir, "labels")
    store = from_tables(spark, [NodeTable("text/Document", docs.join(labels, "doc_id", "left"), "doc_id", values={"toxic": "toxic"})], [])
    eng = Engine(store)
    return eng.optional(eng.q('[:find ?d :where [?d :structure/of "text/Document"]]'), "d", "val/toxic", -1, "toxic").select(key_of(F.col("d")).alias("doc_id"), "toxic")


@query("SELECT DISTINCT n_name AS name FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9990 UNION SELECT r_name FROM region")
def u4_union_of_foci(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, reg = graph(spark, sf_dir), registry()
    foci = [lens.focus(store, reg, c) for c in ("[(Region ?n)]", "[(in-nation ?c ?n) (Rich ?c) [?c :val/balance ?b] [(> ?b 9990.0)]]")]
    return lens.union(*foci).join(store.nodes.select(F.col("eid").alias("n"), "name"), "n").select("name")


@query("SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) AS structures, (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem)) + (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)) AS relations")
def a9_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.totals(graph(spark, sf_dir))


def gappy() -> Registry:
    """Structures whose laws the store of the next query breaks, each in its own way."""
    return Registry().add(
        Structure("shop/Customer", (Slot("segment", ":string"), Slot("balance", "[:double {:min 0}]", "optional")), (has_any("a customer has a nation or a friend", "in-nation", "knows"),)),
        Structure("shop/Nation", (), (at_most_one("a nation has one customer at most", "in-nation"), matched_by("a nation has a rich customer", "rich-in"))),
        Structure("shop/Order", (Slot("placed-by", "shop/Customer"), Slot("urgent", ":boolean", "optional")), (target("customers who order build", "placed-by", {"segment": "BUILDING"}),)),
    )


@query("""SELECT * FROM (SELECT 'Customer.segment requires exactly one (found none)' AS law, count(*) AS n FROM customer WHERE c_custkey % 10 <> 0 AND c_mktsegment = 'FURNITURE'
 UNION ALL SELECT 'Customer.balance value must satisfy [:double {:min 0}]', count(*) FROM customer WHERE c_custkey % 10 <> 0 AND c_acctbal < 0
 UNION ALL SELECT 'a customer has a nation or a friend', count(*) FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 7 <> 0
 UNION ALL SELECT 'a nation has one customer at most', count(*) FROM (SELECT c_nationkey FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT 'a nation has a rich customer', count(*) FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000 AND c_custkey % 10 <> 0)
 UNION ALL SELECT 'Order.placed-by target must be a Customer', count(*) FROM orders WHERE o_custkey % 10 = 0
 UNION ALL SELECT 'Order.placed-by requires exactly one (found none)', count(*) FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 10 <> 0
 UNION ALL SELECT 'Order.placed-by requires exactly one (found several)', count(*) FROM orders WHERE o_orderpriority = '1-URGENT' AND (o_orderstatus <> 'P' OR o_custkey % 10 = 0)
 UNION ALL SELECT 'customers who order build', count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE (o_orderstatus <> 'P' OR o_custkey % 10 = 0) AND NOT (c_custkey % 10 <> 0 AND c_mktsegment = 'BUILDING')) WHERE n > 0""")
def d_laws_on_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of laws on a graph with gaps: nodes that relations miss, values left out, relations doubled or lacking."""
    customer, orders, nation = (table(spark, sf_dir, n) for n in ("customer", "orders", "nation"))
    kept = customer.where("c_custkey % 10 != 0").withColumn("segment", F.expr("nullif(c_mktsegment, 'FURNITURE')"))
    placed = orders.where("o_orderstatus != 'P' or o_custkey % 10 = 0").withColumn("i", F.lit(0))
    twice = placed.where("o_orderpriority = '1-URGENT'").withColumn("i", F.lit(1))
    store = from_tables(
        spark,
        [NodeTable("shop/Customer", kept, "c_custkey", values={"segment": "segment", "balance": "c_acctbal"}), NodeTable("shop/Nation", nation, "n_nationkey"), NodeTable("shop/Order", orders, "o_orderkey")],
        [
            EdgeTable("in-nation", customer.where("c_custkey % 3 = 0"), "shop/Customer", "c_custkey", "shop/Nation", "c_nationkey"),
            EdgeTable("knows", customer.where("c_custkey % 7 = 0").withColumn("f", F.lit(1)), "shop/Customer", "c_custkey", "shop/Customer", "f"),
            EdgeTable("rich-in", kept.where("c_acctbal > 9000"), "shop/Customer", "c_custkey", "shop/Nation", "c_nationkey"),
            EdgeTable("placed-by", placed.unionByName(placed).unionByName(twice), "shop/Order", "o_orderkey", "shop/Customer", "o_custkey", order="i"),
        ],
    )
    return check(store, gappy(), strict=True).groupBy("law").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | code_catalog.queries()


def oracle_sql() -> dict[str, str]:
    return SQL | code_catalog.oracle_sql()
