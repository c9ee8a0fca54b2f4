"""Counts, samples, property statistics and verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import KEYS, PropertyGraph, present


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def count_label(graph: PropertyGraph, label: str) -> int:
    return graph.label(label).count()


def list_ids(graph: PropertyGraph, label: str) -> DataFrame:
    return graph.label(label).select("id")


def label_counts(graph: PropertyGraph) -> DataFrame:
    """(label, count) of every label, one without nodes included."""
    return _all([df.agg(F.count("*").alias("count")).select(F.lit(n).alias("label"), "count") for n, df in sorted(graph.nodes.items())])


def type_counts(graph: PropertyGraph) -> DataFrame:
    return _all([t.df.agg(F.count("*").alias("count")).select(F.lit(n).alias("type"), "count") for n, t in sorted(graph.edges.items())])


def all_nodes(graph: PropertyGraph) -> DataFrame:
    """(label, id) of all nodes."""
    return _all([df.select(F.lit(n).alias("label"), F.col("id").cast("long").alias("id")) for n, df in sorted(graph.nodes.items())])


def all_edges(graph: PropertyGraph) -> DataFrame:
    """(type, edge_id, src, dst) of all edges."""
    return graph.links().select("type", "edge_id", "src", "dst")


def summary(graph: PropertyGraph) -> dict:
    """Counts of nodes by label and of edges by type."""
    return {"labels": {r.label: r["count"] for r in label_counts(graph).collect()}, "types": {r.type: r["count"] for r in type_counts(graph).collect()} if graph.edges else {}}


def sample_labels(graph: PropertyGraph, nodes: int, labels: int) -> DataFrame:
    """(label, count) among the first nodes by id and label: the most frequent labels, equal ones by name."""
    first = all_nodes(graph).orderBy("id", "label").limit(nodes)
    return first.groupBy("label").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "label").limit(labels)


def property_stats(graph: PropertyGraph, label: str, prop: str) -> DataFrame:
    """One row: row_count, non_null_count, null_count, distinct_count (exact), min, max."""
    p = F.col(prop)
    return graph.label(label).agg(
        F.count("*").alias("row_count"), F.count(p).alias("non_null_count"), (F.count("*") - F.count(p)).alias("null_count"), F.countDistinct(p).alias("distinct_count"), F.min(p).alias("min"), F.max(p).alias("max")
    )


def prop_counts(graph: PropertyGraph, label: str) -> DataFrame:
    """(id, n_props): properties present, explicit nulls included."""
    df = graph.label(label)
    if KEYS in df.columns:
        return df.select("id", F.size(KEYS).cast("long").alias("n_props"))
    return df.select("id", sum((present(df, p).cast("long") for p in graph.props(label)), F.lit(0).cast("long")).alias("n_props"))


def find_by_property(graph: PropertyGraph, label: str, prop: str, value) -> DataFrame:
    """One row: the smallest id whose property equals the value, or null."""
    p = F.col(prop)
    return graph.label(label).filter(p.isNull() if value is None else p == F.lit(value)).agg(F.min("id").alias("id"))


def verify(graph: PropertyGraph) -> DataFrame:
    """(type, finding, count): edges whose source or target node doesn't exist, edge ids that repeat within a type."""
    out = []
    for name, t in sorted(graph.edges.items()):
        for end, label in (("src", t.src_label), ("dst", t.dst_label)):
            nodes = graph.label(label).select(F.col("id").cast("long").alias("id")) if label else all_nodes(graph).select("id").distinct()
            lost = t.df.select(F.col(end).cast("long").alias("id")).join(nodes, "id", "left_anti")
            out.append(lost.agg(F.count("*").alias("count")).select(F.lit(name).alias("type"), F.lit(f"dangling_{end}").alias("finding"), "count"))
        again = t.df.groupBy("edge_id").count().filter("count > 1")
        out.append(again.agg(F.count("*").alias("count")).select(F.lit(name).alias("type"), F.lit("repeated_id").alias("finding"), "count"))
    return _all(out)


def full_graph(graph: PropertyGraph, types: list[str] | None = None) -> DataFrame:
    """(src, dst) of all links, each pair once."""
    return graph.links(types).select("src", "dst").distinct()


def full_graph_nodes(graph: PropertyGraph, labels: list[str] | None = None) -> DataFrame:
    """(id, labels, props) of all nodes, each id once: its labels in order, and its properties by name as text, without those
    that are null. Of labels that share an id and name a property, the first that has a value counts."""
    parts = []
    for name in sorted(graph.nodes if labels is None else labels):
        df = graph.label(name)
        filled = F.filter(F.array(*(F.struct(F.lit(p).alias("key"), F.col(p).cast("string").alias("value")) for p in graph.props(name))), lambda e: e.value.isNotNull()) if graph.props(name) else F.array().cast("array<struct<key:string,value:string>>")
        parts.append(df.select(F.col("id").cast("long").alias("id"), F.lit(name).alias("label"), filled.alias("p")))
    every = _all(parts).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("label", "p"))).alias("own"))
    cells = F.flatten(F.col("own.p"))
    first = F.filter(cells, lambda e, i: F.array_position(F.transform(cells, lambda x: x.key), e.key) == i + 1)
    return every.select("id", F.array_distinct(F.col("own.label")).alias("labels"), F.map_from_entries(first).alias("props"))
