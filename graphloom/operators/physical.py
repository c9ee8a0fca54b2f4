"""The operators of pattern plans, one by one, over binding tables: DataFrames with one id column for each variable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph, both_ways, present
from graphloom.plans import predicates as pr
from graphloom.plans.compiler import node_object


def label_scan(graph: PropertyGraph, label: str, var: str) -> DataFrame:
    return graph.label(label).select(F.col("id").alias(var))


def prop_scan(graph: PropertyGraph, label: str, var: str, test: pr.Predicate) -> DataFrame:
    """Ids of a label's nodes that pass tests of their own properties."""
    df = graph.label(label)
    return bool_filter(df, test).select(F.col("id").alias(var))


def bool_filter(df: DataFrame, predicate: pr.Predicate) -> DataFrame:
    """Rows of a node table, or of any table with the properties as columns, that pass."""
    p = pr.normalize(pr.check(predicate))
    return df.filter(pr.column(p, lambda t: (F.col(t.prop), present(df, t.prop), df.schema[t.prop].dataType)))


def expand(bindings: DataFrame, links: DataFrame, start: str, var: str, direction: str = "out", distinct: bool = False) -> DataFrame:
    """For each row one row for each link of its start node; rows without any go. distinct: one for each neighbour and way."""
    if direction == "both":
        ways = both_ways(links.select("src", "dst"))
        pairs = (ways.distinct() if distinct else ways).select(F.col("src").alias("__s"), F.col("dst").alias(var))
    else:
        near, far = ("src", "dst") if direction == "out" else ("dst", "src")
        pairs = links.select(F.col(near).alias("__s"), F.col(far).alias(var))
        pairs = pairs.distinct() if distinct else pairs
    return bindings.join(pairs, F.col(start) == F.col("__s")).drop("__s")


def union(inputs: list[DataFrame], dedup: bool = False) -> DataFrame:
    df = reduce(DataFrame.unionByName, inputs)
    return df.distinct() if dedup else df


def intersect(inputs: list[DataFrame]) -> DataFrame:
    """Bindings that agree on the first variable of all inputs; further variables are carried along, shared ones must agree."""
    anchor = inputs[0].columns[0]
    return reduce(lambda a, b: a.join(b, [anchor, *(c for c in b.columns if c in a.columns and c != anchor)]), inputs)


def hash_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner equi-join on all shared variables; the strategy is the optimizer's."""
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right, shared)


def distinct_bindings(df: DataFrame, variables: list[str]) -> DataFrame:
    return df.dropDuplicates(variables)


def project_var(graph: PropertyGraph, bindings: DataFrame, label: str, var: str, alias: str | None = None) -> DataFrame:
    """Each binding of var as an object of id and properties."""
    nodes = graph.label(label)
    joined = bindings.select(var).join(nodes, F.col(var) == F.col("id"))
    return joined.select(node_object(F.col("id"), {p: F.col(p) for p in graph.props(label)}).alias(alias or var))


def project_prop(graph: PropertyGraph, bindings: DataFrame, label: str, var: str, prop: str, alias: str | None = None) -> DataFrame:
    nodes = graph.label(label).select(F.col("id").alias("__id"), F.col(prop).alias(alias or prop))
    return bindings.select(var).join(nodes, F.col(var) == F.col("__id")).select(alias or prop)


def links_of(graph: PropertyGraph, types: list[str] | None = None, both: bool = False) -> DataFrame:
    links = graph.links(types)
    return both_ways(links).drop("way") if both else links
