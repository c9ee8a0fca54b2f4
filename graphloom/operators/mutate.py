"""Copy-on-write mutations: each gives a new graph, the old one stays as it was.

A list of operations is one transaction: it gives the new graph or raises and leaves nothing. New ids follow the largest
that the label or type holds, so references to new nodes are resolved on the driver.

Operations in a row, up to the next deletion of a node, are gathered on the driver: one job tells whether what they refer
to exists, then each table that they touch gets one join with all changes and one union with all new rows. Deletions of
nodes in a row are one join a table. Tables are written after every WRITE_AFTER such steps, so that plans stay short.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.errors import GraphError, NotFound
from graphloom.model import EDGE_COLUMNS, KEYS, NODE_COLUMNS, EdgeTable, PropertyGraph
from graphloom.storage import written


@dataclass
class Summary:
    created_nodes: list[int] = field(default_factory=list)
    created_edges: list[int] = field(default_factory=list)
    updated_nodes: int = 0
    updated_edges: int = 0
    deleted_nodes: int = 0
    deleted_edges: int = 0
    #: Ids of the new nodes that have an alias.
    aliases: dict[str, int] = field(default_factory=dict)


#: Steps on a graph before the tables they touched are written, and read again.
WRITE_AFTER = 8


def _largest(df: DataFrame, col: str) -> int:
    found = df.agg(F.max(col)).first()[0]
    return -1 if found is None else int(found)


def _with_columns(df: DataFrame, types: dict[str, T.DataType]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns})


def _append(spark: SparkSession, df: DataFrame, rows: list[dict], fixed: tuple[str, ...]) -> DataFrame:
    """df with rows of properties; new properties become columns, null elsewhere."""
    props = sorted({k for r in rows for k in r} - set(fixed))
    types = {f.name: f.dataType for f in df.schema.fields}
    for p in props:
        values = [r[p] for r in rows if r.get(p) is not None]
        types.setdefault(p, T._infer_type(values[0]) if values else T.StringType())
    df = _with_columns(df, types)
    if KEYS in types:
        rows = [{**r, KEYS: sorted(set(r) - set(fixed))} for r in rows]
    new = spark.createDataFrame([tuple(r.get(c) for c in df.columns) for r in rows], T.StructType([T.StructField(c, types[c]) for c in df.columns]))
    return df.unionByName(new)


def create_nodes(spark: SparkSession, graph: PropertyGraph, label: str, rows: list[dict]) -> tuple[PropertyGraph, list[int]]:
    df = graph.nodes.get(label)
    if df is None:
        df = spark.createDataFrame([], "id long")
    first = _largest(df, "id") + 1
    ids = list(range(first, first + len(rows)))
    return graph.with_node_table(label, _append(spark, df, [{**r, "id": i} for i, r in zip(ids, rows, strict=True)], NODE_COLUMNS)), ids


def create_edges(spark: SparkSession, graph: PropertyGraph, type_: str, rows: list[dict]) -> tuple[PropertyGraph, list[int]]:
    """rows: src, dst and properties. Endpoints must exist."""
    table = graph.edges.get(type_) or EdgeTable(spark.createDataFrame([], "src long, dst long, edge_id long"))
    for end, label in (("src", table.src_label), ("dst", table.dst_label)):
        ids = spark.createDataFrame([(r[end],) for r in rows], "id long").distinct()
        lost = ids
        for df in [graph.label(label)] if label else graph.nodes.values():
            lost = lost.join(df.select("id"), "id", "left_anti")
        if (row := lost.first()) is not None:
            raise NotFound(f"node {row.id}, {end} of a new edge")
    first = _largest(table.df, "edge_id") + 1
    ids = list(range(first, first + len(rows)))
    df = _append(spark, table.df, [{**r, "edge_id": i} for i, r in zip(ids, rows, strict=True)], EDGE_COLUMNS)
    return PropertyGraph(graph.nodes, {**graph.edges, type_: EdgeTable(df, table.src_label, table.dst_label)}, graph.distinct_neighbors, graph.indexes), ids


def _patched(df: DataFrame, hit, sets: dict, unsets: list[str]) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    for p, v in sets.items():
        types.setdefault(p, T._infer_type(v) if v is not None else T.StringType())
    df = _with_columns(df, types)
    changes = {p: F.when(hit, F.lit(v).cast(types[p])).otherwise(F.col(p)) for p, v in sets.items()}
    changes |= {p: F.when(hit, F.lit(None)).otherwise(F.col(p)) for p in unsets if p in types}
    if KEYS in types:
        keys = F.array_except(F.array_union(KEYS, F.array(*map(F.lit, sets)) if sets else F.col(KEYS)), F.array(*map(F.lit, unsets)) if unsets else F.array().cast("array<string>"))
        changes[KEYS] = F.when(hit, keys).otherwise(F.col(KEYS))
    return df.withColumns(changes) if changes else df


def update_node(graph: PropertyGraph, label: str, node_id: int, sets: dict | None = None, unsets: list[str] | None = None) -> PropertyGraph:
    """Properties set, then unset. Labels don't change; a patch without entries does nothing."""
    df = graph.label(label)
    if df.filter(F.col("id") == node_id).isEmpty():
        raise NotFound(f"node {node_id}")
    return graph.with_node_table(label, _patched(df, F.col("id") == node_id, sets or {}, unsets or []))


def _only_edge(graph: PropertyGraph, type_: str, edge_id: int) -> DataFrame:
    """The type's edges, if the id is that of exactly one."""
    df = graph.type(type_).df
    _unique(edge_id, df.filter(F.col("edge_id") == edge_id).limit(2).count())
    return df


def _unique(edge_id: int, count: int) -> None:
    if not count:
        raise NotFound(f"edge {edge_id}")
    if count > 1:
        raise GraphError("AmbiguousEdge", f"several edges have the id {edge_id}")


def update_edge(graph: PropertyGraph, type_: str, edge_id: int, sets: dict | None = None, unsets: list[str] | None = None) -> PropertyGraph:
    df = _only_edge(graph, type_, edge_id)
    return graph.with_edge_table(type_, _patched(df, F.col("edge_id") == edge_id, sets or {}, unsets or []))


def delete_node(graph: PropertyGraph, label: str, node_id: int, cascade: bool = False) -> tuple[PropertyGraph, int]:
    """The graph without the node and, if cascading, its edges; their number. Restricted deletion fails if it has edges."""
    if graph.label(label).filter(F.col("id") == node_id).isEmpty():
        raise NotFound(f"node {node_id}")
    out, gone = graph.with_node_table(label, graph.label(label).filter(F.col("id") != node_id)), 0
    for name, t in graph.edges.items():
        touches = F.lit(False)
        for end, of in (("src", t.src_label), ("dst", t.dst_label)):
            if of in (None, label):
                touches = touches | (F.col(end) == node_id)
        if n := t.df.filter(touches).count():
            if not cascade:
                raise GraphError("NodeHasEdges", f"node {node_id} has edges of type '{name}'")
            out, gone = out.with_edge_table(name, t.df.filter(~touches)), gone + n
    return out, gone


def delete_edge(graph: PropertyGraph, type_: str, edge_id: int) -> PropertyGraph:
    df = _only_edge(graph, type_, edge_id)
    return graph.with_edge_table(type_, df.filter(F.col("edge_id") != edge_id))


def _all_patched(spark: SparkSession, df: DataFrame, key: str, patches: dict[int, dict]) -> DataFrame:
    """df with the patches of rows: {key: {property: (is set, value)}}."""
    types = {f.name: f.dataType for f in df.schema.fields}
    for changes in patches.values():
        for p, (is_set, v) in changes.items():
            if is_set and (p not in types or (p not in df.columns and v is not None and isinstance(types[p], T.NullType))):
                types[p] = T._infer_type(v) if v is not None else T.NullType()
    types = {p: T.StringType() if isinstance(t, T.NullType) else t for p, t in types.items()}
    df = _with_columns(df, types)
    names = sorted({p for changes in patches.values() for p in changes if p in types})
    rows = []
    for k, changes in patches.items():
        cells = [changes.get(p) for p in names]
        rows.append((k, *(c is not None for c in cells), *(c[1] if c else None for c in cells), [p for p, c in changes.items() if c[0]], [p for p, c in changes.items() if not c[0]]))
    fields = [T.StructField("__key", T.LongType()), *(T.StructField(f"__c{i}", T.BooleanType()) for i in range(len(names))), *(T.StructField(f"__n{i}", types[p]) for i, p in enumerate(names))]
    lists = [T.StructField(c, T.ArrayType(T.StringType())) for c in ("__sets", "__unsets")]
    joined = df.join(spark.createDataFrame(rows, T.StructType(fields + lists)), F.col(key) == F.col("__key"), "left")
    out = {p: F.when(F.col(f"__c{i}"), F.col(f"__n{i}")).otherwise(F.col(p)) for i, p in enumerate(names)}
    if KEYS in types:
        out[KEYS] = F.when(F.col("__key").isNotNull(), F.array_except(F.array_union(KEYS, "__sets"), "__unsets")).otherwise(F.col(KEYS))
    return joined.select(*(out.get(c, F.col(c)).alias(c) for c in df.columns))


class _Gathered:
    """Operations other than deletions of nodes, in order, on a graph."""

    def __init__(self, graph: PropertyGraph):
        self.graph = graph
        self.nodes: dict[str, dict[int, dict]] = {}
        self.edges: dict[str, dict[int, dict]] = {}
        self.node_patches: dict[str, dict[int, dict]] = {}
        self.edge_patches: dict[str, dict[int, dict]] = {}
        self.gone: dict[str, set[int]] = {}
        #: What must exist: (label or None, id, what it is), and (type, id).
        self.old_nodes: list[tuple[str | None, int, str]] = []
        self.old_edges: list[tuple[str, int]] = []

    def create_node(self, label: str, node_id: int, props: dict) -> None:
        self.nodes.setdefault(label, {})[node_id] = dict(props)

    def create_edge(self, type_: str, edge_id: int, src: int, dst: int, props: dict) -> None:
        table = self.graph.edges.get(type_)
        for end, node, label in (("src", src, table and table.src_label), ("dst", dst, table and table.dst_label)):
            if not any(node in new for of, new in self.nodes.items() if label in (None, of)):
                self.old_nodes.append((label, node, f"node {node}, {end} of a new edge"))
        self.edges.setdefault(type_, {})[edge_id] = {**props, "src": src, "dst": dst}

    @staticmethod
    def _patch(new: dict[int, dict] | None, patches: dict[int, dict], key: int, sets: dict, unsets: list[str]) -> bool:
        """Whether the row is an old one."""
        if new is not None and key in new:
            new[key].update(sets)
            for p in unsets:
                new[key].pop(p, None)
            return False
        patches.setdefault(key, {}).update({p: (True, v) for p, v in sets.items()} | {p: (False, None) for p in unsets})
        return True

    def update_node(self, label: str, node_id: int, sets: dict, unsets: list[str]) -> None:
        if label not in self.nodes:
            self.graph.label(label)
        if self._patch(self.nodes.get(label), self.node_patches.setdefault(label, {}), node_id, sets, unsets):
            self.old_nodes.append((label, node_id, f"node {node_id}"))

    def update_edge(self, type_: str, edge_id: int, sets: dict, unsets: list[str]) -> None:
        self._known_edge(type_, edge_id)
        if self._patch(self.edges.get(type_), self.edge_patches.setdefault(type_, {}), edge_id, sets, unsets):
            self.old_edges.append((type_, edge_id))

    def delete_edge(self, type_: str, edge_id: int) -> None:
        self._known_edge(type_, edge_id)
        if edge_id in self.edges.get(type_, {}):
            del self.edges[type_][edge_id]
            return
        self.old_edges.append((type_, edge_id))
        self.gone.setdefault(type_, set()).add(edge_id)
        self.edge_patches.get(type_, {}).pop(edge_id, None)

    def _known_edge(self, type_: str, edge_id: int) -> None:
        if type_ not in self.edges:
            self.graph.type(type_)
        if edge_id in self.gone.get(type_, ()):
            raise NotFound(f"edge {edge_id}")

    def _check(self, spark: SparkSession) -> None:
        """One job that finds the nodes and counts the edges that must exist; what it returns is bounded by the operations."""
        wanted: dict[str, set[int]] = {}
        for label, i, _ in self.old_nodes:
            for of in [label] if label else self.graph.nodes:
                wanted.setdefault(of, set()).add(i)
        ids = lambda name, of: spark.createDataFrame([(i,) for i in sorted(of)], f"{name} long")
        parts = [self.graph.label(n).join(ids("id", of), "id", "left_semi").select(F.lit("n").alias("what"), F.lit(n).alias("name"), F.col("id").cast("long").alias("id")) for n, of in wanted.items()]
        edges: dict[str, set[int]] = {}
        for type_, i in self.old_edges:
            edges.setdefault(type_, set()).add(i)
        parts += [
            self.graph.type(n).df.join(ids("edge_id", of), "edge_id", "left_semi").select(F.lit("e").alias("what"), F.lit(n).alias("name"), F.col("edge_id").cast("long").alias("id")) for n, of in edges.items()
        ]
        if not parts:
            return
        found = {(r.what, r.name, r.id): r.n for r in reduce(DataFrame.unionByName, parts).groupBy("what", "name", "id").agg(F.count("*").alias("n")).collect()}
        for label, i, said in self.old_nodes:
            if not any(("n", of, i) in found for of in ([label] if label else self.graph.nodes)):
                raise NotFound(said)
        for type_, i in self.old_edges:
            _unique(i, found.get(("e", type_, i), 0))

    def apply(self, spark: SparkSession) -> tuple[PropertyGraph, set[tuple[str, str]]]:
        """The new graph, and the tables touched."""
        self._check(spark)
        out, touched = self.graph, set()
        for label in {**self.node_patches, **self.nodes}:
            df = out.nodes.get(label)
            df = spark.createDataFrame([], "id long") if df is None else df
            if patches := {i: c for i, c in self.node_patches.get(label, {}).items() if c}:
                df = _all_patched(spark, df, "id", patches)
            if new := self.nodes.get(label):
                df = _append(spark, df, [{**props, "id": i} for i, props in new.items()], NODE_COLUMNS)
            out = out.with_node_table(label, df)
            touched.add(("nodes", label))
        for type_ in {**self.edge_patches, **self.edges, **self.gone}:
            table = out.edges.get(type_) or EdgeTable(spark.createDataFrame([], "src long, dst long, edge_id long"))
            df = table.df
            if gone := self.gone.get(type_):
                df = df.join(spark.createDataFrame([(i,) for i in sorted(gone)], "__gone long"), F.col("edge_id") == F.col("__gone"), "left_anti")
            if patches := {i: c for i, c in self.edge_patches.get(type_, {}).items() if c}:
                df = _all_patched(spark, df, "edge_id", patches)
            if new := self.edges.get(type_):
                df = _append(spark, df, [{**e, "edge_id": i} for i, e in new.items()], EDGE_COLUMNS)
            out = out.with_edge_table(type_, df)
            touched.add(("edges", type_))
        return out, touched


def _without_nodes(spark: SparkSession, graph: PropertyGraph, ops: list[tuple[str, int, bool]]) -> tuple[PropertyGraph, int, set[tuple[str, str]]]:
    """(graph, edges deleted, tables touched) after deletions (label, id, cascade) in order. An edge goes with the first
    deletion of one of its ends; if that one doesn't cascade, it fails."""
    at: dict[str, dict[int, int]] = {}
    for k, (label, i, _) in enumerate(ops):
        graph.label(label)
        if i in at.setdefault(label, {}):
            raise NotFound(f"node {i}")
        at[label][i] = k
    frame = lambda of, name: spark.createDataFrame(sorted(of.items()), f"{name} long, __at_{name} int")
    found = [graph.label(n).join(frame(of, "id"), "id").select(F.lit(n).alias("name"), F.col("__at_id").alias("k")) for n, of in at.items()]
    there = {(r.name, r.k) for r in reduce(DataFrame.unionByName, found).distinct().collect()}
    for k, (label, i, _) in enumerate(ops):
        if (label, k) not in there:
            raise NotFound(f"node {i}")
    hit, ends = [], {}
    for name, t in graph.edges.items():
        sides = {}
        for end, label in (("src", t.src_label), ("dst", t.dst_label)):
            of = at.get(label, {}) if label else {i: min(a[i] for a in at.values() if i in a) for a in at.values() for i in a}
            if of:
                sides[end] = of
        if sides:
            ends[name] = sides
            df = t.df
            for end, of in sides.items():
                df = df.join(frame(of, end), end, "left")
            first = F.least(*(F.col(f"__at_{e}") for e in sides)) if len(sides) > 1 else F.col(f"__at_{next(iter(sides))}")
            hit.append(df.select(first.alias("k")).filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "k", "n"))
    counts = reduce(DataFrame.unionByName, hit).collect() if hit else []
    for r in sorted(counts, key=lambda r: (r.k, r.name)):
        if not ops[r.k][2]:
            raise GraphError("NodeHasEdges", f"node {ops[r.k][1]} has edges of type '{r.name}'")
    out, touched = graph, set()
    for label, of in at.items():
        out = out.with_node_table(label, out.label(label).join(frame(of, "id").select("id"), "id", "left_anti"))
        touched.add(("nodes", label))
    for name in sorted({r.name for r in counts}):
        df = graph.type(name).df
        columns = df.columns
        for end, of in ends[name].items():
            df = df.join(frame(of, end).select(end), end, "left_anti")
        out = out.with_edge_table(name, df.select(columns))
        touched.add(("edges", name))
    return out, sum(r.n for r in counts), touched


def _rewritten(graph: PropertyGraph, touched: set[tuple[str, str]]) -> PropertyGraph:
    for kind, name in sorted(touched):
        if kind == "nodes":
            graph = graph.with_node_table(name, written(graph.label(name), "nodes"))
        else:
            graph = graph.with_edge_table(name, written(graph.type(name).df, "edges"))
    return graph


def mutate(spark: SparkSession, graph: PropertyGraph, ops: list[dict], _steps: list | None = None) -> tuple[PropertyGraph, Summary]:
    """All operations in order, or none. op: createNode {label, props, alias?}, updateNode {label, id, set, unset},
    deleteNode {label, id, cascade}, createEdge {type, src, dst, props}, updateEdge, deleteEdge {type, id}. src, dst and
    id may be {"$ref": alias} of a node created before."""
    done = Summary()
    twice = [a for a, n in Counter(o["alias"] for o in ops if o.get("alias")).items() if n > 1]
    if twice:
        raise GraphError("DuplicateAlias", f"aliases used twice: {twice}")
    steps = _steps if _steps is not None else []
    next_id = _next_ids(graph, ops)

    def of(ref):
        if not isinstance(ref, dict):
            return ref
        if ref.get("$ref") not in done.aliases:
            raise GraphError("UnknownAlias", f"unknown alias '{ref.get('$ref')}'")
        return done.aliases[ref["$ref"]]

    def new_id(kind: str, name: str) -> int:
        next_id[kind, name] += 1
        return next_id[kind, name] - 1

    def stepped(now: PropertyGraph, touched: set[tuple[str, str]]) -> PropertyGraph:
        if touched:
            steps.append(touched)
        if len(steps) < WRITE_AFTER:
            return now
        every = set().union(*steps)
        steps.clear()
        return _rewritten(now, every)

    out, k = graph, 0
    while k < len(ops):
        if ops[k]["op"] == "deleteNode":
            z = next((j for j in range(k, len(ops)) if ops[j]["op"] != "deleteNode"), len(ops))
            out, n, touched = _without_nodes(spark, out, [(o["label"], of(o["id"]), o.get("cascade", False)) for o in ops[k:z]])
            done.deleted_nodes, done.deleted_edges = done.deleted_nodes + z - k, done.deleted_edges + n
            out, k = stepped(out, touched), z
            continue
        some = _Gathered(out)
        while k < len(ops) and ops[k]["op"] != "deleteNode":
            o = ops[k]
            match o["op"]:
                case "createNode":
                    i = new_id("nodes", o["label"])
                    some.create_node(o["label"], i, o.get("props") or {})
                    done.created_nodes.append(i)
                    if o.get("alias"):
                        done.aliases[o["alias"]] = i
                case "createEdge":
                    i = new_id("edges", o["type"])
                    some.create_edge(o["type"], i, of(o["src"]), of(o["dst"]), o.get("props") or {})
                    done.created_edges.append(i)
                case "updateNode":
                    some.update_node(o["label"], of(o["id"]), o.get("set") or {}, o.get("unset") or [])
                    done.updated_nodes += 1
                case "updateEdge":
                    some.update_edge(o["type"], o["id"], o.get("set") or {}, o.get("unset") or [])
                    done.updated_edges += 1
                case "deleteEdge":
                    some.delete_edge(o["type"], o["id"])
                    done.deleted_edges += 1
                case other:
                    raise GraphError("InvalidMutation", f"unknown operation '{other}'")
            k += 1
        out = stepped(*some.apply(spark))
    return out, done


def _next_ids(graph: PropertyGraph, ops: list[dict]) -> dict[tuple[str, str], int]:
    """The first free id of each label and type that gets new rows, by one job."""
    names = dict.fromkeys(("nodes", o["label"]) if o["op"] == "createNode" else ("edges", o["type"]) for o in ops if o["op"] in ("createNode", "createEdge"))
    frames = [
        (graph.label(n) if kind == "nodes" else graph.type(n).df).agg(F.max("id" if kind == "nodes" else "edge_id").cast("long").alias("last")).select(F.lit(kind).alias("kind"), F.lit(n).alias("name"), "last")
        for kind, n in names
        if n in (graph.nodes if kind == "nodes" else graph.edges)
    ]
    last = {(r.kind, r.name): r.last for r in reduce(DataFrame.unionByName, frames).collect()} if frames else {}
    return {key: 0 if last.get(key) is None else last[key] + 1 for key in names}


def mutate_batched(spark: SparkSession, graph: PropertyGraph, ops: list[dict], size: int = 10_000) -> tuple[PropertyGraph, list[Summary]]:
    """Operations in chunks, each its own transaction: an error leaves the chunks before it done, as the exception's
    `graph` and `summaries`."""
    if size < 1:
        raise GraphError("InvalidMutation", "a chunk has one operation at least")
    summaries: list[Summary] = []
    steps: list = []
    for i in range(0, len(ops), size):
        try:
            graph, done = mutate(spark, graph, ops[i : i + size], steps)
        except GraphError as e:
            e.graph, e.summaries = graph, summaries
            raise
        summaries.append(done)
    return graph, summaries


def bulk_nodes(graph: PropertyGraph, label: str, rows: DataFrame) -> PropertyGraph:
    """Nodes of a DataFrame (id and properties) appended at once; repeated or existing ids are an error."""
    df = graph.nodes.get(label)
    clash = rows.groupBy("id").count().filter("count > 1").select("id")
    if df is not None:
        clash = clash.unionByName(rows.join(df.select("id"), "id", "left_semi").select("id"))
    if (row := clash.first()) is not None:
        raise GraphError("DuplicateId", f"node id {row.id} is not unique")
    return graph.with_node_table(label, rows if df is None else df.unionByName(rows, allowMissingColumns=True))


def bulk_edges(graph: PropertyGraph, type_: str, rows: DataFrame, trusted: bool = False) -> PropertyGraph:
    """Edges of a DataFrame (src, dst, edge_id and properties) appended at once; endpoints are checked unless trusted."""
    table = graph.edges.get(type_) or EdgeTable(rows.limit(0))
    if not trusted:
        for end, label in (("src", table.src_label), ("dst", table.dst_label)):
            lost = rows.select(F.col(end).alias("id"))
            for df in [graph.label(label)] if label else graph.nodes.values():
                lost = lost.join(df.select("id"), "id", "left_anti")
            if (row := lost.first()) is not None:
                raise NotFound(f"node {row.id}, {end} of a new edge")
    df = table.df.unionByName(rows, allowMissingColumns=True)
    return PropertyGraph(graph.nodes, {**graph.edges, type_: EdgeTable(df, table.src_label, table.dst_label)}, graph.distinct_neighbors, graph.indexes)
