"""Patterns compiled to DataFrames.

The anchor variable is scanned with its own tests; every edge is one equi-join on node ids, every further variable one
more with its own label's nodes. Tests of one variable filter its scan, tests over several the joined rows. Column names
carry the variable, so no join is ambiguous, and only projected or tested properties are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph, both_ways, present
from graphloom.plans import predicates as pr
from graphloom.plans.spec import Edge, Query, from_dict, validate

#: How much a test narrows its variable's scan, for the choice of the anchor.
_NARROWS = {"eq": 4, "in": 3, "between": 2, "lt": 1, "le": 1, "gt": 1, "ge": 1}


@dataclass(frozen=True)
class Step:
    """One node of the logical plan, as explain shows it."""

    op: str
    detail: dict
    inputs: tuple[Step, ...] = ()


@dataclass(frozen=True)
class Compiled:
    df: DataFrame
    plan: Step


def id_column(var: str) -> str:
    return f"__v_{var}"


def prop_column(var: str, prop: str) -> str:
    return f"__p_{var}__{prop}"


def scan(graph: PropertyGraph, var: str, label: str, tests: pr.Predicate, props: list[str], keys: list[str] = ()) -> DataFrame:
    """Node ids of a label under the variable's name, with props and, for keys, whether they are present."""
    df = graph.label(label)
    if tests != pr.TRUE:
        df = df.filter(pr.column(tests, lambda t: (F.col(t.prop), present(df, t.prop), df.schema[t.prop].dataType)))
    return df.select(
        F.col("id").alias(id_column(var)), *(F.col(p).alias(prop_column(var, p)) for p in props), *(present(df, p).alias(f"__k_{var}__{p}") for p in keys)
    )


def steps_links(graph: PropertyGraph, edge: Edge, labels: dict[str, str]) -> DataFrame:
    """(src, dst) of an edge clause as from-variable and to-variable, one row for each edge and way it matches."""
    types = None if edge.type is None else [edge.type]
    a, b = labels[edge.src], labels[edge.dst]
    forward = graph.links(types, a, b).select("src", "dst")
    if edge.direction == "both" and a == b:
        ways = both_ways(forward)
        return (ways.distinct() if graph.distinct_neighbors else ways).drop("way")
    if edge.direction == "out":
        return forward.distinct() if graph.distinct_neighbors else forward
    backward = graph.links(types, b, a).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if graph.distinct_neighbors:
        forward, backward = forward.distinct(), backward.distinct()
    return backward if edge.direction == "in" else forward.unionByName(backward)


def compile_query(graph: PropertyGraph, query: Query | dict | str) -> Compiled:
    query = validate(query if isinstance(query, Query) else from_dict(query), graph)
    labels = query.labels
    own: dict[str, list[pr.Predicate]] = {v: [] for v in labels}
    residual: list[pr.Predicate] = []
    for part in pr.conjuncts(query.predicate):
        used = {t.var for t in pr.tests(part)}
        (own[used.pop()] if len(used) == 1 else residual).append(part)
    projections = query.projections
    props = {v: sorted({t.prop for r in residual for t in pr.tests(r) if t.var == v} | {p.prop for p in projections if p.var == v and p.prop}) for v in labels}
    keys = {v: sorted({t.prop for r in residual for t in pr.tests(r) if t.var == v and t.op == "exists"}) for v in labels}
    for p in projections:
        if p.prop is None:
            props[p.var] = sorted({*props[p.var], *graph.props(labels[p.var])})

    def scanned(v: str) -> tuple[DataFrame, Step]:
        tests = own[v][0] if len(own[v]) == 1 else pr.Group("and", tuple(own[v]))
        step = Step("LabelScan", {"var": v, "label": labels[v]})
        return scan(graph, v, labels[v], tests, props[v], keys[v]), Step("Filter", {"predicate": tests}, (step,)) if own[v] else step

    anchor = max(labels, key=lambda v: (sum(_NARROWS.get(t.op, 0) for part in own[v] if isinstance(part, pr.Test) for t in (part,)), -list(labels).index(v)))
    df, plan = scanned(anchor)
    bound, left = {anchor}, list(query.edges)
    while left:
        # edges between bound variables first: they only narrow
        edge = min((e for e in left if {e.src, e.dst} & bound), key=lambda e: len({e.src, e.dst} - bound))
        left.remove(edge)
        links = steps_links(graph, edge, labels).select(F.col("src").alias("__a"), F.col("dst").alias("__b"))
        a, b = id_column(edge.src), id_column(edge.dst)
        detail = {"from": edge.src, "to": edge.dst, "type": edge.type, "direction": edge.direction}
        if {edge.src, edge.dst} <= bound:
            df = df.join(links, (F.col(a) == F.col("__a")) & (F.col(b) == F.col("__b"))).drop("__a", "__b")
            plan = Step("ExpandInto", detail, (plan,))
            continue
        new = edge.dst if edge.src in bound else edge.src
        near, far = ("__a", "__b") if new == edge.dst else ("__b", "__a")
        df = df.join(links, F.col(id_column(edge.src if new == edge.dst else edge.dst)) == F.col(near)).drop(near)
        right, step = scanned(new)
        df = df.join(right, F.col(far) == F.col(id_column(new))).drop(far)
        plan = Step("Expand", detail, (plan, step))
        bound.add(new)
    for part in residual:
        df = df.filter(
            pr.column(part, lambda t: (F.col(prop_column(t.var, t.prop)), F.col(f"__k_{t.var}__{t.prop}") if t.op == "exists" else F.lit(True), graph.label(labels[t.var]).schema[t.prop].dataType))
        )
        plan = Step("BoolFilter", {"predicate": part}, (plan,))
    if query.distinct:
        df, plan = df.dropDuplicates([id_column(v) for v in labels]), Step("Distinct", {"vars": list(labels)}, (plan,))
    if not projections:
        return Compiled(df.select(*(F.col(id_column(v)).alias(v) for v in labels)), Step("Project", {"fields": list(labels)}, (plan,)))

    def field(p) -> Column:
        if p.prop is not None:
            return F.col(prop_column(p.var, p.prop)).alias(p.name)
        return node_object(F.col(id_column(p.var)), {q: F.col(prop_column(p.var, q)) for q in graph.props(labels[p.var])}).alias(p.name)

    return Compiled(df.select(*map(field, projections)), Step("Project", {"fields": [p.name for p in projections]}, (plan,)))


def node_object(node_id: Column, props: dict[str, Column]) -> Column:
    """A node as struct: _id and props."""
    return F.struct(node_id.alias("_id"), F.struct(*(c.alias(n) for n, c in props.items())).alias("props") if props else F.struct(F.lit(None).alias("_")).alias("props"))


def execute(graph: PropertyGraph, query: Query | dict | str) -> DataFrame:
    """The rows of a query as a lazy DataFrame; its columns are the projections in the order given, else all variables' ids."""
    return compile_query(graph, query).df
