"""The registered graph queries, over the graph view of the test tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.builder import QueryBuilder, all_of, any_of, prop
from graphloom.model import KEYS, EdgeTable, PropertyGraph
from graphloom.operators import mutate, physical, statistics, traverse
from graphloom.plans import predicates as pr
from graphloom.plans.compiler import execute
from graphloom.sources import csv_files
from graphloom.sources.tables import table_graph
from graphloom.storage import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Customer-to-customer links as the SQL side sees them.
LINKS = "e AS (SELECT user_id AS src, CAST(json_extract_string(props, '$.k') AS BIGINT) AS dst, event_id AS edge_id, event_type AS type FROM events)"
BOTH = f"{LINKS}, b AS (SELECT src, dst, edge_id, type FROM e UNION ALL SELECT dst, src, edge_id, type FROM e)"


def add(name: str, sql: str | None):
    """Registers a function of a graph as a query, with SQL for the same rows."""

    def keep(f: Callable[[PropertyGraph], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(table_graph(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _nodes(graph: PropertyGraph, label: str, expr, *props: str) -> DataFrame:
    q = QueryBuilder(graph).match("a", label).filter(expr)
    return physical.bool_filter(graph.label(label), q.spec.predicate).select("id", *props)


P = prop("a", "total")
CUSTOMER, ORDER, DOC = "SELECT c_custkey AS id FROM customer", "SELECT o_orderkey AS id, o_totalprice AS total FROM orders", "SELECT d.doc_id AS id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"

# --- scans, and tests of one property -------------------------------------------------------------------------------
add("label_scan", CUSTOMER)(lambda g: physical.label_scan(g, "Customer", "id"))
add("list_ids", "SELECT s_suppkey AS id FROM supplier")(lambda g: statistics.list_ids(g, "Supplier"))
add("label_count", "SELECT count(*) AS n FROM customer")(lambda g: g.label("Customer").agg(F.count("*").alias("n")))
for _name, _expr, _sql in [
    ("prop_eq", prop("a", "status") == "F", "o_orderstatus = 'F'"),
    ("prop_ne", prop("a", "status") != "F", "o_orderstatus <> 'F'"),
    ("prop_in_small", prop("a", "priority").is_in(["1-URGENT", "2-HIGH", None]), "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    ("prop_date_range", prop("a", "placed") >= pr.literal({"t": "DateTime", "v": 820_454_400 * 10**9}), "o_orderdate >= TIMESTAMP '1996-01-01'"),
    ("pred_and", all_of(P > 1e4, prop("a", "status") == "O", P < 1.2e5), "o_totalprice > 1e4 AND o_orderstatus = 'O' AND o_totalprice < 1.2e5"),
    ("pred_or", any_of(P < 2e4, prop("a", "status") == "P"), "o_totalprice < 2e4 OR o_orderstatus = 'P'"),
    ("pred_not_leaf", ~(P < 1e5), "NOT (o_totalprice < 1e5)"),
    ("pred_empty_and", all_of(), "true"),
    ("pred_empty_or", any_of(), "false"),
]:
    add(_name, f"{ORDER} WHERE {_sql}")(lambda g, e=_expr: _nodes(g, "Order", e, "total"))
SIZE = prop("a", "size")
for _name, _expr, _sql in [  # bounds that parts have as size
    ("prop_lt", SIZE < 20, "p_size < 20"),
    ("prop_le", SIZE <= 20.0, "p_size <= 20"),
    ("prop_gt", SIZE > 40, "p_size > 40"),
    ("prop_ge", SIZE >= 40, "p_size >= 40"),
    ("prop_between_incl", SIZE.between(10, 30), "p_size BETWEEN 10 AND 30"),
    ("prop_between_excl", SIZE.between(10, 30, (False, False)), "p_size > 10 AND p_size < 30"),
    ("prop_between_low", SIZE.between(10, 30, (True, False)), "p_size >= 10 AND p_size < 30"),
    ("prop_between_high", SIZE.between(10, 30, (False, True)), "p_size > 10 AND p_size <= 30"),
]:
    add(_name, f"SELECT p_partkey AS id, p_size AS size FROM part WHERE {_sql}")(lambda g, e=_expr: _nodes(g, "Part", e, "size"))
add("prop_in_large", f"SELECT p_partkey AS id, p_size AS size FROM part WHERE p_size IN ({', '.join(map(str, range(0, 51, 3)))})")(
    lambda g: _nodes(g, "Part", prop("a", "size").is_in(list(range(0, 51, 3))), "size")
)
add("prop_scan", "SELECT p_partkey AS a FROM part WHERE p_size BETWEEN 10 AND 20")(lambda g: physical.prop_scan(g, "Part", "a", (prop("a", "size").between(10, 20)).node))

# --- missing properties: labels cover some documents only -------------------------------------------------------------
Q = prop("a", "quality")
for _name, _expr, _sql in [
    ("is_null", Q.is_null(), "quality IS NULL"),
    ("is_not_null", Q.is_not_null(), "quality IS NOT NULL"),
    ("exists", Q.exists(), "quality IS NOT NULL"),
    ("eq_null", Q == None, "quality IS NULL"),  # noqa: E711
    ("ne_null", Q != None, "quality IS NOT NULL"),  # noqa: E711
    ("pred_not_eq_null", ~(Q == 1), "quality <> 1"),
    ("pred_not_in_null", ~Q.is_in([1]), "NOT coalesce(quality IN (1), false)"),
    ("pred_not_group_null", ~all_of(Q == 1, prop("a", "toxic") == 0), "NOT (coalesce(quality = 1, false) AND coalesce(toxic = 0, false))"),
    ("pred_not_between_null", ~Q.between(1, 2), "NOT coalesce(quality BETWEEN 1 AND 2, false)"),
]:
    add(_name, f"{DOC} WHERE {_sql}")(lambda g, e=_expr: _nodes(g, "Document", e))


def _explicit_nulls(graph: PropertyGraph) -> PropertyGraph:
    """Documents of three languages hold a quality whether they have a value or not; those without one hold null."""
    docs = graph.label("Document")
    names = F.when(F.col("lang").isin("en", "de", "fr") | F.col("quality").isNotNull(), F.array(F.lit("lang"), F.lit("quality"))).otherwise(F.array(F.lit("lang")))
    return graph.with_node_table("Document", docs.select("id", "lang", "quality", names.alias(KEYS)))


for _name, _expr, _sql in [
    ("exists_null", Q.exists(), "quality IS NOT NULL OR lang IN ('en', 'de', 'fr')"),
    ("not_exists_null", ~Q.exists(), "quality IS NULL AND coalesce(lang NOT IN ('en', 'de', 'fr'), true)"),
    ("is_null_explicit", all_of(Q.is_null(), Q.exists()), "quality IS NULL AND lang IN ('en', 'de', 'fr')"),
    ("not_in_explicit", all_of(~Q.is_in([1]), Q.exists()), "coalesce(quality <> 1, true) AND (quality IS NOT NULL OR lang IN ('en', 'de', 'fr'))"),
]:
    add(_name, f"{DOC} WHERE {_sql}")(lambda g, e=_expr: _nodes(_explicit_nulls(g), "Document", e))
add("prop_counts_null", "SELECT d.doc_id AS id, CAST(CASE WHEN quality IS NOT NULL OR lang IN ('en', 'de', 'fr') THEN 2 ELSE 1 END AS BIGINT) AS n_props FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")(
    lambda g: statistics.prop_counts(_explicit_nulls(g), "Document")
)

# --- patterns -----------------------------------------------------------------------------------------------------------


def _query(graph: PropertyGraph) -> QueryBuilder:
    return QueryBuilder(graph)


def flagship_query(graph: PropertyGraph) -> DataFrame:
    q = _query(graph).match("c", "Customer").match("o", "Order").where("c", "PLACED", "o")
    return q.filter(prop("o", "total") > 100_000).select("c.name", "o.total").df()


add("placed_orders", "SELECT c_name AS name, o_totalprice AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000")(flagship_query)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship_query(table_graph(spark, sf_dir))


def _pair(graph: PropertyGraph, type_: str | None, direction: str) -> QueryBuilder:
    return _query(graph).match("a", "Customer").match("b", "Customer").where("a", type_, "b", direction).select(("a.name", "a_name"), ("b.name", "b_name"))


NAMES = "SELECT x.c_name AS a_name, y.c_name AS b_name FROM {l} JOIN customer x ON x.c_custkey = {a} JOIN customer y ON y.c_custkey = {b}"
add("expand_out", f"WITH {LINKS} " + NAMES.format(l="e", a="src", b="dst") + " WHERE type = 'click'")(lambda g: _pair(g, "click", "out").df())
add("expand_in", f"WITH {LINKS} " + NAMES.format(l="e", a="dst", b="src") + " WHERE type = 'click'")(lambda g: _pair(g, "click", "in").df())
add("expand_both", f"WITH {BOTH} " + NAMES.format(l="b", a="src", b="dst") + " WHERE type = 'click'")(lambda g: _pair(g, "click", "both").df())
add("expand_untyped", f"WITH {LINKS} " + NAMES.format(l="e", a="src", b="dst"))(lambda g: _pair(g, None, "out").df())
add("expand_distinct_neighbors", f"WITH {LINKS}, d AS (SELECT DISTINCT src, dst FROM e WHERE type = 'view') " + NAMES.format(l="d", a="src", b="dst"))(
    lambda g: _pair(PropertyGraph(g.nodes, g.edges, distinct_neighbors=True), "view", "out").df()
)
add(
    "expand_two_hop",
    "SELECT c_name AS customer, p_name AS part, CAST(p_size AS DOUBLE) AS size FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_mktsegment = 'BUILDING' AND p_size < 5",
)(
    lambda g: _query(g).match("c", "Customer").match("o", "Order").match("p", "Part").where("c", "PLACED", "o").where("o", "CONTAINS", "p")
    .filter(all_of(prop("c", "segment") == "BUILDING", prop("p", "size") < 5)).select(("c.name", "customer"), ("p.name", "part"), ("p.size", "size")).df().withColumn("size", F.col("size").cast("double"))
)
add("expand_reverse_anchor", "SELECT r_name AS region, c_name AS customer FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE r_name = 'ASIA'")(
    lambda g: _query(g).match("c", "Customer").match("n", "Nation").match("r", "Region").where("c", "LIVES_IN", "n").where("n", "IN_REGION", "r")
    .filter(prop("r", "name") == "ASIA").select(("r.name", "region"), ("c.name", "customer")).df()
)
add("pred_or_cross_var", "SELECT c_custkey AS c, o_orderkey AS o FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal < 0 OR o_totalprice > 200000")(
    lambda g: _ids(_query(g).match("c", "Customer").match("o", "Order").where("c", "PLACED", "o").filter(any_of(prop("c", "balance") < 0, prop("o", "total") > 200_000)))
)


def _ids(builder: QueryBuilder) -> DataFrame:
    return execute(builder.graph, builder.spec)


add("mutual_edges", f"WITH {LINKS} SELECT x.src AS a, x.dst AS b FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src WHERE x.type = 'purchase' AND y.type = 'purchase'")(
    lambda g: _ids(_query(g).match("a", "Customer").match("b", "Customer").where("a", "purchase", "b").where("b", "purchase", "a"))
)
add(
    "mutual_distinct",
    f"WITH {LINKS} SELECT DISTINCT x.src AS a, x.dst AS b FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src",
)(lambda g: _ids(_query(g).match("a", "Customer").match("b", "Customer").where("a", None, "b").where("b", None, "a").distinct()))
add(
    "triangle",
    f"WITH {LINKS}, d AS (SELECT DISTINCT src, dst FROM e WHERE type = 'error') SELECT x.src AS a, y.src AS b, z.src AS c FROM d x JOIN d y ON x.dst = y.src JOIN d z ON y.dst = z.src AND z.dst = x.src",
)(
    lambda g: _ids(_query(PropertyGraph(g.nodes, g.edges, distinct_neighbors=True)).match("a", "Customer").match("b", "Customer").match("c", "Customer").where("a", "error", "b").where("b", "error", "c").where("c", "error", "a"))
)
add("hash_join", f"WITH {LINKS} SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src WHERE x.type = 'signup' AND y.type = 'signup'")(
    lambda g: physical.hash_join(
        physical.links_of(g, ["signup"]).select(F.col("src").alias("a"), F.col("dst").alias("b")), physical.links_of(g, ["signup"]).select(F.col("src").alias("b"), F.col("dst").alias("c"))
    ).select("a", "b", "c")
)
add("intersect_scans", "SELECT p_partkey AS a FROM part WHERE p_size < 20 INTERSECT SELECT p_partkey FROM part WHERE p_size >= 10 AND p_retailprice > 905")(
    lambda g: physical.intersect([physical.prop_scan(g, "Part", "a", (prop("a", "size") < 20).node), physical.prop_scan(g, "Part", "a", all_of(prop("a", "size") >= 10, prop("a", "price") > 905).node)])
)
_small, _cheap = (prop("a", "size") < 20).node, all_of(prop("a", "size") >= 10, prop("a", "price") > 905).node
add("union_bag", "SELECT p_partkey AS a FROM part WHERE p_size < 20 UNION ALL SELECT p_partkey FROM part WHERE p_size >= 10 AND p_retailprice > 905")(
    lambda g: physical.union([physical.prop_scan(g, "Part", "a", _small), physical.prop_scan(g, "Part", "a", _cheap)])
)
add("union_dedup", "SELECT p_partkey AS a FROM part WHERE p_size < 20 UNION SELECT p_partkey FROM part WHERE p_size >= 10 AND p_retailprice > 905")(
    lambda g: physical.union([physical.prop_scan(g, "Part", "a", _small), physical.prop_scan(g, "Part", "a", _cheap)], dedup=True)
)

def _distinct_customers(graph: PropertyGraph) -> DataFrame:
    """Distinct binds ids before it projects: customers repeat by order, and equal segments of different customers stay."""
    rows = physical.expand(physical.label_scan(graph, "Customer", "c"), graph.links(["PLACED"]), "c", "o").select("c")
    return physical.project_prop(graph, physical.distinct_bindings(rows, ["c"]), "Customer", "c", "segment")


add("distinct_bindings", "SELECT c_mktsegment AS segment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")(_distinct_customers)
add("project_ids", "SELECT s_suppkey AS s, n_nationkey AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey")(
    lambda g: _ids(_query(g).match("s", "Supplier").match("n", "Nation").where("s", "BASED_IN", "n"))
)
add("project_prop_alias", "SELECT s_name AS who, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")(
    lambda g: _query(g).match("s", "Supplier").match("n", "Nation").where("s", "BASED_IN", "n").select(("s.name", "who"), ("n.name", "nation")).df()
)
add("project_var", "SELECT CAST(n_nationkey AS BIGINT) AS n_id, n_name AS n_name FROM nation")(
    lambda g: _query(g).match("n", "Nation").select("n").df().select(F.col("n._id").alias("n_id"), F.col("n.props.name").alias("n_name"))
)

# --- neighbours, degrees, traversal -----------------------------------------------------------------------------------
for _d, _table in (("out", "e"), ("in", "(SELECT dst AS src, src AS dst, edge_id, type FROM e)"), ("both", "b")):
    add(f"neighbors_{_d}", f"WITH {BOTH} SELECT src AS node, dst AS neighbor, edge_id, type FROM {_table}")(
        lambda g, d=_d: traverse.neighbors_of(g, g.links(["click", "error", "purchase", "signup", "view"]), d)
    )
EVENTS = ["click", "error", "purchase", "signup", "view"]
add("neighbors_distinct", f"WITH {BOTH} SELECT DISTINCT src AS node, dst AS neighbor FROM b")(lambda g: traverse.neighbors_of(g, g.links(EVENTS), "both", True).select("node", "neighbor"))
add("neighbors_of_one", f"WITH {LINKS} SELECT DISTINCT dst AS neighbor FROM e WHERE src = 7")(lambda g: traverse.neighbors(g, 7, "out", EVENTS).select("neighbor"))
add("degree_out", f"WITH {LINKS} SELECT src AS node, count(*) AS degree FROM e GROUP BY 1")(lambda g: traverse.degrees(g, "out", EVENTS))
add("degree_in", f"WITH {LINKS} SELECT dst AS node, count(*) AS degree FROM e GROUP BY 1")(lambda g: traverse.degrees(g, "in", EVENTS))
add("degree_both", f"WITH {LINKS} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e WHERE src <> dst) GROUP BY 1")(lambda g: traverse.degrees(g, "both", EVENTS))
add("degree_by_type", f"WITH {LINKS} SELECT src AS node, type, count(*) AS degree FROM e GROUP BY 1, 2")(lambda g: traverse.degrees(g, "out", EVENTS, by_type=True))


def _bfs_sql(depth: int, links: str = "SELECT src, dst FROM e") -> str:
    return (
        f"WITH RECURSIVE {LINKS}, l AS ({links}), r AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS depth UNION SELECT l.dst, r.depth + 1 FROM r JOIN l ON r.node = l.src WHERE r.depth < {depth}) "
        "SELECT node, min(depth) AS depth FROM r GROUP BY 1"
    )


for _k in (1, 2, 3):
    add(f"bfs_depth{_k}", _bfs_sql(_k))(lambda g, k=_k: traverse.bfs(g, "Customer", 0, k, "out", EVENTS))

def _rare(graph: PropertyGraph) -> PropertyGraph:
    """Signups of a high value only: few links, so that more hops reach more."""
    return PropertyGraph(graph.nodes, {"rare": EdgeTable(graph.type("signup").df.filter("value > 80"), "Customer", "Customer")})


RARE = "SELECT src, dst FROM e JOIN events ON event_id = edge_id WHERE type = 'signup' AND value > 80"
for _k in (2, 3, 5):
    add(f"bfs_sparse_depth{_k}", _bfs_sql(_k, RARE))(lambda g, k=_k: traverse.bfs(_rare(g), "Customer", 0, k, "out", ["rare"]))
add("bfs_sparse_both", _bfs_sql(3, f"{RARE} UNION SELECT dst, src FROM ({RARE})"))(lambda g: traverse.bfs(_rare(g), "Customer", 0, 3, "both", ["rare"]))
add("bfs_typed", _bfs_sql(3, "SELECT src, dst FROM e WHERE type IN ('error', 'signup')"))(lambda g: traverse.bfs(g, "Customer", 0, 3, "out", ["error", "signup"]))
add("bfs_both", _bfs_sql(2, "SELECT src, dst FROM e UNION SELECT dst, src FROM e"))(lambda g: traverse.bfs(g, "Customer", 0, 2, "both", EVENTS))
add("bfs_limited", _bfs_sql(2) + " ORDER BY depth, node LIMIT 20")(lambda g: traverse.bfs(g, "Customer", 0, 2, "out", EVENTS, 20))
add("traverse_label", f"WITH {LINKS}, d AS (SELECT DISTINCT src, dst FROM e WHERE type = 'error') SELECT DISTINCT node FROM (SELECT dst AS node FROM d WHERE src <> dst UNION SELECT y.dst FROM d x JOIN d y ON x.dst = y.src WHERE x.src <> y.dst)")(
    lambda g: traverse.traverse_label(g, "Customer", 2, "out", ["error"])
)

# --- lookups and statistics ---------------------------------------------------------------------------------------------
BATCH = [5, 3, 999_999_999, 3, 0]
VALUES = "(VALUES " + ", ".join(f"({k}, {i})" for k, i in enumerate(BATCH)) + ") v(pos, id)"
add("get_nodes_batch", f"SELECT CAST(pos AS BIGINT) AS pos, CAST(id AS BIGINT) AS id, c_name AS name FROM {VALUES} LEFT JOIN customer ON c_custkey = id")(
    lambda g: traverse.nodes_batch(g.label("Customer").sparkSession, g, "Customer", BATCH).select("pos", "id", "name")
)
add("nodes_exist", f"SELECT CAST(pos AS BIGINT) AS pos, CAST(id AS BIGINT) AS id, c_custkey IS NOT NULL AS found FROM {VALUES} LEFT JOIN customer ON c_custkey = id")(
    lambda g: traverse.nodes_exist(g.label("Customer").sparkSession, g, "Customer", BATCH)
)
add("prop_counts", "SELECT d.doc_id AS id, CAST((lang IS NOT NULL)::INT + (source IS NOT NULL)::INT + (n_chars IS NOT NULL)::INT + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT AS BIGINT) AS n_props FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")(
    lambda g: statistics.prop_counts(g, "Document")
)
add("find_by_property", "SELECT min(c_custkey) AS id FROM customer WHERE c_mktsegment = 'MACHINERY'")(lambda g: statistics.find_by_property(g, "Customer", "segment", "MACHINERY"))
add("edge_type_count", f"WITH {LINKS} SELECT type, count(*) AS count FROM e GROUP BY 1")(lambda g: statistics.type_counts(PropertyGraph(g.nodes, {k: g.edges[k] for k in EVENTS})))
LABELS = " UNION ALL ".join(
    f"SELECT '{n}' AS label, CAST({k} AS BIGINT) AS id FROM {t}"
    for n, t, k in [("Region", "region", "r_regionkey"), ("Nation", "nation", "n_nationkey"), ("Customer", "customer", "c_custkey"), ("Supplier", "supplier", "s_suppkey"), ("Part", "part", "p_partkey"), ("Order", "orders", "o_orderkey"), ("Document", "documents", "doc_id")]
)
add("analyze_labels", f"SELECT label, count(*) AS count FROM ({LABELS}) GROUP BY 1")(statistics.label_counts)
add("sample_labels", f"SELECT label, count(*) AS count FROM (SELECT * FROM ({LABELS}) ORDER BY id, label LIMIT 100) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4")(lambda g: statistics.sample_labels(g, 100, 4))
add("property_stats", 'SELECT count(*) AS row_count, count(quality) AS non_null_count, count(*) - count(quality) AS null_count, count(DISTINCT quality) AS distinct_count, min(quality) AS "min", max(quality) AS "max" FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id')(
    lambda g: statistics.property_stats(g, "Document", "quality")
)
add("verify_dangling", "SELECT count(*) AS lost FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")(
    lambda g: statistics.verify(PropertyGraph({**g.nodes, "Customer": g.label("Customer").filter("balance > 0")}, {"PLACED": g.edges["PLACED"]})).filter("finding = 'dangling_src'").select(F.col("count").alias("lost"))
)
add("all_edges", f"WITH {LINKS} SELECT type, edge_id, src, dst FROM e")(lambda g: statistics.all_edges(PropertyGraph(g.nodes, {k: g.edges[k] for k in EVENTS})))
add("all_nodes", LABELS)(statistics.all_nodes)
add("full_graph_nodes", "SELECT CAST(s_suppkey AS BIGINT) AS id, 'Supplier' AS labels, s_name AS name, NULL AS brand FROM supplier WHERE s_suppkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT CAST(p_partkey AS BIGINT), CASE WHEN s_suppkey IS NULL THEN 'Part' ELSE 'Part,Supplier' END, p_name, p_brand FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")(
    lambda g: statistics.full_graph_nodes(g, ["Part", "Supplier"]).select("id", F.array_join("labels", ",").alias("labels"), F.col("props")["name"].alias("name"), F.col("props")["brand"].alias("brand"))
)
add("full_graph_edges", f"WITH {LINKS} SELECT DISTINCT src, dst FROM e")(lambda g: statistics.full_graph(g, EVENTS))



def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and their clicks exported as CSV, imported again, and joined."""
    g, folder = table_graph(spark, sf_dir), f"{shared_dir(spark)}/graphloom/csv-{uuid.uuid4().hex}"
    clicks = g.with_edge_table("click", g.type("click").df.drop("ts"))
    csv_files.export_nodes(g, f"{folder}/nodes", ["Customer"])
    csv_files.export_edges(clicks, f"{folder}/edges", ["click"])
    again, _ = csv_files.import_graph(
        spark, [csv_files.NodeFile(f"{folder}/nodes", label_column="labels", types={"name": "string", "balance": "float"})], [csv_files.EdgeFile(f"{folder}/edges", type_column="type", types={"value": "float"})]
    )
    people = again.label("Customer")
    a, b = (people.select(F.col("id").alias(e), F.col("name").alias(f"{n}_name"), F.col("balance").alias(f"{n}_balance")) for e, n in (("src", "a"), ("dst", "b")))
    return again.type("click").df.join(a, "src").join(b, "dst").select("a_name", "a_balance", "b_name", "value")


QUERIES["csv_round_trip"] = _csv_round_trip
ORACLES["csv_round_trip"] = (
    f"WITH {LINKS} SELECT x.c_name AS a_name, x.c_acctbal AS a_balance, y.c_name AS b_name, value FROM e JOIN events ON event_id = edge_id JOIN customer x ON x.c_custkey = src JOIN customer y ON y.c_custkey = dst WHERE type = 'click'"
)

# --- mutations ------------------------------------------------------------------------------------------------------------
add("create_node", "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT max(s_suppkey) + 1, 'new' FROM supplier")(
    lambda g: mutate.create_nodes(g.label("Supplier").sparkSession, g, "Supplier", [{"name": "new"}])[0].label("Supplier").select("id", "name")
)
add("update_node", "SELECT s_suppkey AS id, CASE WHEN s_suppkey = 3 THEN 'changed' ELSE s_name END AS name, CASE WHEN s_suppkey = 3 THEN NULL ELSE s_acctbal END AS balance FROM supplier")(
    lambda g: mutate.update_node(g, "Supplier", 3, {"name": "changed"}, ["balance"]).label("Supplier").select("id", "name", "balance")
)
add("delete_cascade", f"WITH {LINKS} SELECT src, dst, edge_id FROM e WHERE type = 'click' AND src <> 5 AND dst <> 5")(
    lambda g: mutate.delete_node(g, "Customer", 5, cascade=True)[0].type("click").df.select("src", "dst", "edge_id")
)
add("create_edge", "SELECT CAST(n_nationkey AS BIGINT) AS src, CAST(n_regionkey AS BIGINT) AS dst, CAST(n_nationkey AS BIGINT) AS edge_id FROM nation UNION ALL SELECT 1, 2, max(n_nationkey) + 1 FROM nation")(
    lambda g: mutate.create_edges(g.label("Nation").sparkSession, g, "IN_REGION", [{"src": 1, "dst": 2}])[0].type("IN_REGION").df
)
add("delete_edge", "SELECT CAST(n_nationkey AS BIGINT) AS src, CAST(n_regionkey AS BIGINT) AS dst FROM nation WHERE n_nationkey <> 4")(
    lambda g: mutate.delete_edge(g, "IN_REGION", 4).type("IN_REGION").df.select("src", "dst")
)
add("update_edge", "SELECT CAST(n_nationkey AS BIGINT) AS edge_id, CASE WHEN n_nationkey = 4 THEN 'x' END AS note FROM nation")(
    lambda g: mutate.update_edge(g, "IN_REGION", 4, {"note": "x"}).type("IN_REGION").df.select("edge_id", "note")
)


def _script(graph: PropertyGraph) -> PropertyGraph:
    """Changes of all kinds in one transaction: some to the same rows, to new rows, and to rows that go later."""
    ops = [
        {"op": "updateNode", "label": "Supplier", "id": 2, "set": {"name": "two", "grade": 7}},
        {"op": "createNode", "label": "Supplier", "props": {"name": "first"}, "alias": "x"},
        {"op": "updateNode", "label": "Supplier", "id": {"$ref": "x"}, "set": {"grade": 1}, "unset": ["name"]},
        {"op": "createEdge", "type": "BASED_IN", "src": {"$ref": "x"}, "dst": 3},
        {"op": "createEdge", "type": "BASED_IN", "src": 2, "dst": 4},
        {"op": "updateNode", "label": "Supplier", "id": 2, "set": {"grade": 8}, "unset": ["balance"]},
        {"op": "deleteEdge", "type": "BASED_IN", "id": 5},
        {"op": "updateEdge", "type": "BASED_IN", "id": 6, "set": {"note": "six"}},
        {"op": "deleteNode", "label": "Nation", "id": 3, "cascade": True},
        {"op": "createNode", "label": "Supplier", "props": {"name": "second", "grade": 2}},
    ]
    return mutate.mutate(graph.label("Supplier").sparkSession, graph, ops)[0]


add(
    "mutate_script_nodes",
    "SELECT CAST(s_suppkey AS BIGINT) AS id, CASE WHEN s_suppkey = 2 THEN 'two' ELSE s_name END AS name, CASE WHEN s_suppkey = 2 THEN NULL ELSE s_acctbal END AS balance, CAST(CASE WHEN s_suppkey = 2 THEN 8 ELSE 0 END AS BIGINT) AS grade FROM supplier "
    "UNION ALL SELECT CAST(max(s_suppkey) + 1 AS BIGINT), NULL, NULL, 1 FROM supplier UNION ALL SELECT CAST(max(s_suppkey) + 2 AS BIGINT), 'second', NULL, 2 FROM supplier",
)(lambda g: _script(g).label("Supplier").select("id", "name", "balance", F.coalesce("grade", F.lit(0).cast("long")).alias("grade")))
add(
    "mutate_script_edges",
    "SELECT CAST(s_suppkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, CASE WHEN s_suppkey = 6 THEN 'six' END AS note FROM supplier WHERE s_suppkey <> 5 AND s_nationkey <> 3 UNION ALL SELECT 2, 4, NULL",
)(lambda g: _script(g).type("BASED_IN").df.select("src", "dst", "note"))
