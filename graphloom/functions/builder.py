"""Fluent queries.

    db = Database(graph)
    rows = db.query().match("a", "User").match("b", "User").where("a", "FOLLOWS", "b").filter(prop("a", "name") == "Ada").select("b.name").rows()
"""

from __future__ import annotations

import base64
import inspect
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from graphloom.errors import GraphError
from graphloom.model import PropertyGraph
from graphloom.operators import mutate, statistics, traverse
from graphloom.plans import predicates as pr
from graphloom.plans.compiler import execute
from graphloom.plans.explain import explain
from graphloom.plans.spec import Edge, Match, Projection, Query
from graphloom.streaming.cursor import Cursor, run_as


class Expr:
    """A predicate; combine with &, | and ~."""

    def __init__(self, node: pr.Predicate):
        self.node = node

    def __and__(self, other: Expr) -> Expr:
        return Expr(pr.Group("and", (self.node, other.node)))

    def __or__(self, other: Expr) -> Expr:
        return Expr(pr.Group("or", (self.node, other.node)))

    def __invert__(self) -> Expr:
        return Expr(pr.Group("not", (self.node,)))


class prop:
    """A property of a variable, to be compared with literals."""

    __hash__ = None

    def __init__(self, var: str, name: str):
        self.var, self.name = var, name

    def _test(self, op: str, *values, inclusive=(True, True)) -> Expr:
        return Expr(pr.Test(op, self.var, self.name, tuple(map(pr.literal, values)), inclusive))

    def __eq__(self, v) -> Expr:
        return self._test("eq", v)

    def __ne__(self, v) -> Expr:
        return self._test("ne", v)

    def __lt__(self, v) -> Expr:
        return self._test("lt", v)

    def __le__(self, v) -> Expr:
        return self._test("le", v)

    def __gt__(self, v) -> Expr:
        return self._test("gt", v)

    def __ge__(self, v) -> Expr:
        return self._test("ge", v)

    def between(self, low, high, inclusive: tuple[bool, bool] = (True, True)) -> Expr:
        return self._test("between", low, high, inclusive=inclusive)

    def is_in(self, values: list) -> Expr:
        return self._test("in", *values)

    def exists(self) -> Expr:
        return self._test("exists")

    def is_null(self) -> Expr:
        return self._test("isNull")

    def is_not_null(self) -> Expr:
        return self._test("isNotNull")


def all_of(*parts: Expr) -> Expr:
    return Expr(pr.Group("and", tuple(p.node for p in parts)))


def any_of(*parts: Expr) -> Expr:
    return Expr(pr.Group("or", tuple(p.node for p in parts)))


class QueryBuilder:
    """Each call gives a new builder. Without select() all variables are projected as objects."""

    def __init__(self, graph: PropertyGraph, query: Query | None = None):
        self.graph, self.spec = graph, query or Query(())

    def _with(self, **changes) -> QueryBuilder:
        return QueryBuilder(self.graph, replace(self.spec, **changes))

    def match(self, var: str, label: str) -> QueryBuilder:
        return self._with(matches=(*self.spec.matches, Match(var, label)))

    def where(self, src: str, type_: str | None, dst: str, direction: str = "out") -> QueryBuilder:
        return self._with(edges=(*self.spec.edges, Edge(src, dst, type_, direction)))

    def filter(self, expr: Expr) -> QueryBuilder:
        both = expr.node if self.spec.predicate == pr.TRUE else pr.Group("and", (self.spec.predicate, expr.node))
        return self._with(predicate=both)

    def select(self, *fields: str | tuple[str, str]) -> QueryBuilder:
        """"a" a whole node, "a.name" a property; a pair gives the alias."""
        out = []
        for f in fields:
            text, alias = (f, None) if isinstance(f, str) else f
            var, _, name = text.partition(".")
            out.append(Projection(var, name or None, alias))
        return self._with(projections=(*self.spec.projections, *out))

    def distinct(self, on: bool = True) -> QueryBuilder:
        return self._with(distinct=on)

    def request_id(self, name: str) -> QueryBuilder:
        return self._with(request_id=name)

    def build(self) -> Query:
        if self.spec.projections:
            return self.spec
        return replace(self.spec, projections=tuple(Projection(m.var) for m in self.spec.matches))

    def df(self) -> DataFrame:
        return execute(self.graph, self.build())

    def rows(self, max_rows: int | None = None) -> list[dict]:
        return self.envelope(max_rows)["rows"]

    def envelope(self, max_rows: int | None = None) -> dict:
        """{"request_id", "features", "rows"}; with max_rows also {"row_limit", "truncated"}, told by one row more."""
        df = self.df()
        with run_as(df.sparkSession, self.spec.request_id):
            got = [r.asDict(recursive=True) for r in (df if max_rows is None else df.limit(max_rows + 1)).collect()]
        out = {"request_id": self.spec.request_id, "features": [], "rows": got if max_rows is None else got[:max_rows]}
        return out if max_rows is None else {**out, "row_limit": max_rows, "truncated": len(got) > max_rows}

    def json(self, max_rows: int | None = None) -> str:
        """The envelope as JSON text: bytes as base64, dates and times in ISO form."""
        shown = lambda v: base64.b64encode(v).decode() if isinstance(v, bytes | bytearray) else v.isoformat() if hasattr(v, "isoformat") else str(v)
        return json.dumps(self.envelope(max_rows), default=shown)

    def stream(self) -> Cursor:
        return Cursor(self.df(), self.spec.request_id)

    def explain(self, redact_literals: bool = False) -> dict:
        return explain(self.graph, self.build(), redact_literals)


class Script:
    """Mutations in order. New nodes are handles, which later operations of the script take in place of ids."""

    def __init__(self, db: Database | None = None):
        self.db, self.ops = db, []

    def node(self, label: str, props: dict | None = None, alias: str | None = None) -> dict:
        alias = alias or f"#{len(self.ops)}"
        self.ops.append({"op": "createNode", "label": label, "props": dict(props or {}), "alias": alias})
        return {"$ref": alias}

    def edge(self, type_: str, src: int | dict, dst: int | dict, props: dict | None = None) -> Script:
        return self._add(op="createEdge", type=type_, src=src, dst=dst, props=dict(props or {}))

    def update_node(self, label: str, node: int | dict, set: dict | None = None, unset: list[str] | None = None) -> Script:
        return self._add(op="updateNode", label=label, id=node, set=set, unset=unset)

    def update_edge(self, type_: str, edge_id: int, set: dict | None = None, unset: list[str] | None = None) -> Script:
        return self._add(op="updateEdge", type=type_, id=edge_id, set=set, unset=unset)

    def delete_node(self, label: str, node: int | dict, cascade: bool = False) -> Script:
        return self._add(op="deleteNode", label=label, id=node, cascade=cascade)

    def delete_edge(self, type_: str, edge_id: int) -> Script:
        return self._add(op="deleteEdge", type=type_, id=edge_id)

    def _add(self, **op) -> Script:
        self.ops.append(op)
        return self

    def execute(self) -> mutate.Summary:
        """Runs the script on the database that it was made by; the summary's aliases tell the ids of new nodes."""
        if self.db is None:
            raise GraphError("InvalidMutation", "a transaction runs its script itself")
        return self.db.mutate(self.ops)


class Database:
    """A graph that mutations replace; readers keep the version they started with."""

    def __init__(self, spark: SparkSession, graph: PropertyGraph, schema: dict[str, set[str]] | None = None):
        self.spark, self.graph, self.schema = spark, graph, schema

    def query(self) -> QueryBuilder:
        return QueryBuilder(self.graph)

    def execute(self, spec: dict | str) -> DataFrame:
        return execute(self.graph, spec)

    def explain(self, spec: dict | str, redact_literals: bool = False) -> dict:
        return explain(self.graph, spec, redact_literals)

    def mutate(self, ops: list[dict]) -> mutate.Summary:
        for o in ops:
            self._checked(o)
        self.graph, done = mutate.mutate(self.spark, self.graph, ops)
        return done

    def _checked(self, op: dict) -> None:
        """With a schema, only its labels and properties can be written."""
        if self.schema is None or "label" not in op:
            return
        if op["label"] not in self.schema:
            raise GraphError("UnknownLabel", f"unknown label '{op['label']}'")
        for p in [*op.get("props", {}), *(op.get("set") or {})]:
            if p not in self.schema[op["label"]]:
                raise GraphError("UnknownProperty", f"the schema gives label '{op['label']}' no property '{p}'")

    def mutate_many(self, ops: Iterable[dict]) -> mutate.Summary:
        return self.mutate([dict(o) for o in ops])

    def mutate_batched(self, ops: Iterable[dict], size: int = 10_000) -> list[mutate.Summary]:
        """Chunks, each a transaction of its own; those before a failing one stay done."""
        ops = [dict(o) for o in ops]
        for o in ops:
            self._checked(o)
        try:
            self.graph, done = mutate.mutate_batched(self.spark, self.graph, ops, size)
        except GraphError as e:
            self.graph = getattr(e, "graph", self.graph)
            raise
        return done

    def transaction(self, fn: Callable[[Script], object]) -> tuple[object, mutate.Summary]:
        """What fn returns, and the summary of the operations that it gave the script, done together or, if fn or one of
        them raises, not at all."""
        script = Script()
        out = fn(script)
        if inspect.isawaitable(out):
            if inspect.iscoroutine(out):
                out.close()
            raise TypeError("a transaction's function must not be asynchronous")
        return out, self.mutate(script.ops)

    def create(self) -> Script:
        return Script(self)

    def create_node(self, label: str, **props) -> int:
        return self.mutate([{"op": "createNode", "label": label, "props": props}]).created_nodes[0]

    def create_edge(self, type_: str, src: int, dst: int, **props) -> int:
        return self.mutate([{"op": "createEdge", "type": type_, "src": src, "dst": dst, "props": props}]).created_edges[0]

    def update_node(self, label: str, node_id: int, set: dict | None = None, unset: list[str] | None = None) -> None:
        self.mutate([{"op": "updateNode", "label": label, "id": node_id, "set": set, "unset": unset}])

    def update_edge(self, type_: str, edge_id: int, set: dict | None = None, unset: list[str] | None = None) -> None:
        self.mutate([{"op": "updateEdge", "type": type_, "id": edge_id, "set": set, "unset": unset}])

    def delete_node(self, label: str, node_id: int, cascade: bool = False) -> None:
        self.mutate([{"op": "deleteNode", "label": label, "id": node_id, "cascade": cascade}])

    def delete_edge(self, type_: str, edge_id: int) -> None:
        self.mutate([{"op": "deleteEdge", "type": type_, "id": edge_id}])

    def neighbors(self, node_id: int, direction: str = "out", types: list[str] | None = None, distinct: bool = True) -> list[int]:
        return [r.neighbor for r in traverse.neighbors(self.graph, node_id, direction, types, distinct).orderBy("neighbor", "edge_id").collect()]

    def bfs(self, label: str, start: int, max_depth: int, direction: str = "out", types: list[str] | None = None, max_results: int | None = None) -> list[tuple[int, int]]:
        found = traverse.bfs(self.graph, label, start, max_depth, direction, types, max_results)
        return [(r.node, r.depth) for r in found.orderBy("depth", "node").collect()]

    def count(self, label: str) -> int:
        return statistics.count_label(self.graph, label)

    def find(self, label: str, prop_: str, value) -> int | None:
        return statistics.find_by_property(self.graph, label, prop_, value).first().id

    def pragma(self, name: str, value=None):
        """Durability settings of single-file stores, kept for callers; they have no effect here."""
        if name not in ("synchronous", "wal_coalesce_ms", "autocheckpoint_ms"):
            raise GraphError("UnknownPragma", f"unknown pragma '{name}'")
        self.__dict__.setdefault("_pragmas", {})
        if value is not None:
            self._pragmas[name] = value
        return self._pragmas.get(name)


class TypedSchema:
    """{"nodes": {label: {"properties": {...}}}, "edges": {type: {"from": label, "to": label}}}, checked when used."""

    def __init__(self, schema: dict):
        self.nodes, self.edges = schema.get("nodes", {}), schema.get("edges", {})
        for name, e in self.edges.items():
            for end in ("from", "to"):
                if e.get(end) not in self.nodes:
                    raise GraphError("UnknownLabel", f"the schema has no label '{e.get(end)}', which '{name}' goes {end}")

    def check_node(self, label: str, props: dict) -> None:
        if label not in self.nodes:
            raise GraphError("UnknownLabel", f"unknown label '{label}'")
        if extra := set(props) - set(self.nodes[label].get("properties", {})):
            raise GraphError("UnknownProperty", f"the schema gives label '{label}' no properties {sorted(extra)}")

    def ends(self, type_: str) -> tuple[str, str]:
        if type_ not in self.edges:
            raise GraphError("UnknownEdgeType", f"unknown edge type '{type_}'")
        return self.edges[type_]["from"], self.edges[type_]["to"]


class TypedDatabase(Database):
    """A database whose writes and traversals follow a schema."""

    def __init__(self, spark: SparkSession, graph: PropertyGraph, schema: dict):
        self.typed = TypedSchema(schema)
        super().__init__(spark, graph, {n: set(d.get("properties", {})) for n, d in self.typed.nodes.items()})

    def create_edge(self, type_: str, src: int, dst: int, **props) -> int:
        for node, label in zip((src, dst), self.typed.ends(type_), strict=True):
            if traverse.get_node(self.graph, label, node) is None:
                raise GraphError("NotFound", f"edge '{type_}' needs a node {node} of label '{label}'")
        return super().create_edge(type_, src, dst, **props)

    def traverse(self, label: str, type_: str, direction: str = "out", depth: int = 1) -> set[int]:
        self.typed.check_node(label, {})
        self.typed.ends(type_)
        return {r.node for r in traverse.traverse_label(self.graph, label, depth, direction, [type_]).collect()}

    def ids(self, label: str) -> Iterator[int]:
        return (r.id for r in statistics.list_ids(self.graph, label).toLocalIterator())
