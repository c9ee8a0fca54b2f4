"""Neighbours, degrees and breadth-first traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.errors import GraphError, NotFound
from graphloom.model import PropertyGraph, both_ways
from graphloom.storage import written


def _ways(links: DataFrame, direction: str) -> DataFrame:
    """(node, neighbor, edge_id, type, way): links as seen from a node; way 0 out, 1 in."""
    if direction not in ("out", "in", "both"):
        raise GraphError("DirectionInvalid", f"a direction is out, in or both, not '{direction}'")
    if direction == "both":
        return both_ways(links).select(F.col("src").alias("node"), F.col("dst").alias("neighbor"), "edge_id", "type", "way")
    near, far, way = ("src", "dst", 0) if direction == "out" else ("dst", "src", 1)
    return links.select(F.col(near).alias("node"), F.col(far).alias("neighbor"), "edge_id", "type", F.lit(way).alias("way"))


def neighbors(graph: PropertyGraph, node_id: int, direction: str = "out", types: list[str] | None = None, distinct: bool = True) -> DataFrame:
    """(neighbor, edge_id, type) of a node. distinct: one row for each neighbour, the first by way, type and edge id.
    Without it a self-loop is two rows when both ways are asked for."""
    return neighbors_of(graph, graph.links(types), direction, distinct, node_id).drop("node")


def neighbors_of(graph: PropertyGraph, links: DataFrame, direction: str = "out", distinct: bool = False, node_id: int | None = None) -> DataFrame:
    """(node, neighbor, edge_id, type) for all nodes with links, or for one."""
    rows = _ways(links, direction)
    if node_id is not None:
        rows = rows.filter(F.col("node") == node_id)
    if distinct:
        first = F.min(F.struct("way", "type", "edge_id"))
        rows = rows.groupBy("node", "neighbor").agg(first.alias("f")).select("node", "neighbor", "f.edge_id", "f.type")
    return rows.select("node", "neighbor", "edge_id", "type")


def degrees(graph: PropertyGraph, direction: str = "out", types: list[str] | None = None, by_type: bool = False) -> DataFrame:
    """(node[, type], degree) of nodes with links: edges counted; both ways count a self-loop once."""
    rows = _ways(graph.links(types), direction)
    if direction == "both":
        rows = rows.filter((F.col("way") == 0) | (F.col("node") != F.col("neighbor")))
    return rows.groupBy("node", *(["type"] if by_type else [])).agg(F.count("*").alias("degree"))


def degree(graph: PropertyGraph, node_id: int, direction: str = "out", types: list[str] | None = None) -> int:
    rows = _ways(graph.links(types), direction).filter(F.col("node") == node_id)
    if direction == "both":
        rows = rows.filter((F.col("way") == 0) | (F.col("node") != F.col("neighbor")))
    return rows.count()


def bfs(
    graph: PropertyGraph, label: str, start: int, max_depth: int, direction: str = "out", types: list[str] | None = None, max_results: int | None = None
) -> DataFrame:
    """(node, depth): every node within max_depth hops, once, at its smallest depth; the start at depth 0 included.
    max_results keeps the first by depth and id, a total order. An unknown start is NotFound."""
    origin = graph.label(label).filter(F.col("id") == start).select(F.col("id").alias("node")).distinct()
    if origin.isEmpty():
        raise NotFound(f"node {start}")
    found = multi_bfs(graph.links(types), origin.select(F.col("node").alias("root"), "node"), max_depth, direction).drop("root")
    return found if max_results is None else found.orderBy("depth", "node").limit(max_results)


def _pairs(links: DataFrame, direction: str, hops: int) -> DataFrame:
    pairs = _ways(links, direction).select("node", "neighbor")
    return written(pairs, "pairs") if hops > 1 else pairs


def multi_bfs(links: DataFrame, seeds: DataFrame, max_depth: int, direction: str = "out") -> DataFrame:
    """(root, node, depth) from seeds (root, node): one join for each hop, nodes already seen by the root are dropped, and
    the hop is written, so plans and lineage stay short. Ends early when no root reaches anything new. For several hops the
    links are written once, as pairs; parallel ones fall together after each join."""
    pairs = _pairs(links, direction, max_depth)
    seen = frontier = seeds.select("root", "node", F.lit(0).alias("depth")).distinct()
    for depth in range(1, max_depth + 1):
        reached = frontier.select("root", "node").join(pairs, "node").select("root", F.col("neighbor").alias("node")).distinct()
        frontier = written(reached.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def traverse_label(graph: PropertyGraph, label: str, max_depth: int, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """(node): what is reached from any node of a label in 1 to max_depth hops. A start is in it only if another start
    reaches it: a node is at depth 0 of its own traversal.

    Reaching from another start needs no traversal for each start. Two smallest starts are kept for each node and hop;
    among them is one other than the node itself if there is any.
    """
    starts = graph.label(label).select(F.col("id").alias("node")).distinct()
    pairs = _pairs(graph.links(types), direction, max_depth)
    two = Window.partitionBy("node").orderBy("root")
    frontier = starts.select("node", F.col("node").alias("root"))
    found = None
    for _ in range(max_depth):
        step = frontier.join(pairs, "node").select(F.col("neighbor").alias("node"), "root").distinct()
        frontier = written(step.withColumn("n", F.row_number().over(two)).filter("n <= 2").drop("n"), "reach")
        reached = frontier.filter(F.col("node") != F.col("root")).select("node")
        found = reached if found is None else found.union(reached)
    return starts.filter(F.lit(False)) if found is None else found.distinct()


def nodes_batch(spark: SparkSession, graph: PropertyGraph, label: str, ids: list[int]) -> DataFrame:
    """(pos, id, found, properties ...) aligned to the ids given; null properties where a node is missing."""
    wanted = spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "pos long, id long")
    nodes = graph.label(label).withColumn("__hit", F.lit(True))
    return wanted.join(nodes, "id", "left").withColumn("found", F.coalesce("__hit", F.lit(False))).drop("__hit").orderBy("pos")


def nodes_exist(spark: SparkSession, graph: PropertyGraph, label: str, ids: list[int]) -> DataFrame:
    return nodes_batch(spark, graph, label, ids).select("pos", "id", "found")


def get_node(graph: PropertyGraph, label: str, node_id: int) -> dict | None:
    row = graph.label(label).filter(F.col("id") == node_id).first()
    return None if row is None else row.asDict()


def get_edge(graph: PropertyGraph, type_: str, edge_id: int) -> dict | None:
    row = graph.type(type_).df.filter(F.col("edge_id") == edge_id).first()
    return None if row is None else row.asDict()
