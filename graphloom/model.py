"""The property graph: node tables by label, edge tables by type.

A node table has a column `id` and one column for each property; an edge table has `src`, `dst`, `edge_id` and property
columns. Where an explicit null must differ from a missing property, a table carries `__keys`, the array of names that
are present; without it a property is present where it isn't null. Ids are unique within a label; labels whose nodes share
an id space (multi-label nodes) simply share rows' ids.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import GraphError

KEYS = "__keys"
NODE_COLUMNS, EDGE_COLUMNS = ("id", KEYS), ("src", "dst", "edge_id", KEYS)


class EdgeTable:
    """Edges of one type. src_label and dst_label are the labels of the endpoints; None: any label. The table may be given
    as a function without arguments, which is called when the edges are first used."""

    def __init__(self, df: DataFrame | Callable[[], DataFrame], src_label: str | None = None, dst_label: str | None = None):
        self._df, self.src_label, self.dst_label = df, src_label, dst_label
        self.source: EdgeSource | None = None
        self.kind: str | None = None

    @property
    def df(self) -> DataFrame:
        if not isinstance(self._df, DataFrame):
            self._df = self._df()
        if missing := {"src", "dst", "edge_id"} - set(self._df.columns):
            raise GraphError("InvalidGraph", f"an edge table has no column {sorted(missing)}")
        return self._df

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c not in EDGE_COLUMNS]


class EdgeSource:
    """Edges of several types in one table with a column `type`, given as a function that is called when they are first used.
    Links of several of its types come from one scan."""

    def __init__(self, df: Callable[[], DataFrame]):
        self.df = cache(df)

    def table(self, kind: str, src_label: str | None = None, dst_label: str | None = None) -> EdgeTable:
        out = EdgeTable(lambda: self.df().filter(F.col("type") == kind).drop("type"), src_label, dst_label)
        out.source, out.kind = self, kind
        return out


class NodeTables(Mapping):
    """Node tables by label, each a DataFrame or a function that gives one when its label is first used."""

    def __init__(self, tables: dict):
        self._tables = dict(tables._tables if isinstance(tables, NodeTables) else tables)

    def __getitem__(self, label: str) -> DataFrame:
        df = self._tables[label]
        if not isinstance(df, DataFrame):
            df = self._tables[label] = df()
        if "id" not in df.columns:
            raise GraphError("InvalidGraph", f"node table '{label}' has no column 'id'")
        return df

    def __iter__(self):
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)

    def plus(self, label: str, df: DataFrame) -> NodeTables:
        return NodeTables({**self._tables, label: df})


@dataclass(frozen=True)
class PropertyGraph:
    nodes: Mapping[str, DataFrame]
    edges: dict[str, EdgeTable]
    distinct_neighbors: bool = False
    indexes: frozenset[tuple[str, str]] = field(default=frozenset())

    def __post_init__(self):
        object.__setattr__(self, "nodes", NodeTables(self.nodes))

    def label(self, name: str) -> DataFrame:
        if name not in self.nodes:
            raise GraphError("UnknownLabel", f"unknown label '{name}'")
        return self.nodes[name]

    def type(self, name: str) -> EdgeTable:
        if name not in self.edges:
            raise GraphError("UnknownEdgeType", f"unknown edge type '{name}'")
        return self.edges[name]

    def props(self, label: str) -> list[str]:
        return [c for c in self.label(label).columns if c not in NODE_COLUMNS]

    def links(self, types: list[str] | None = None, src_label: str | None = None, dst_label: str | None = None) -> DataFrame:
        """(src, dst, edge_id, type) of the types (all by default) that can join the labels (any by default)."""
        names = sorted(self.edges) if types is None else types
        fits = [
            n
            for n in names
            if (t := self.type(n)) and (None in (src_label, t.src_label) or src_label == t.src_label) and (None in (dst_label, t.dst_label) or dst_label == t.dst_label)
        ]
        if not fits:
            some = next(iter(self.edges.values()), None)
            if some is None:
                raise GraphError("UnknownEdgeType", "the graph has no edges")
            return some.df.filter(F.lit(False)).select("src", "dst", "edge_id", F.lit("").alias("type"))
        shared: dict[EdgeSource, list[str]] = {}
        parts = []
        for n in fits:
            if (t := self.edges[n]).source is not None and t.kind == n:
                shared.setdefault(t.source, []).append(n)
            else:
                parts.append(t.df.select("src", "dst", "edge_id", F.lit(n).alias("type")))
        parts += [source.df().filter(F.col("type").isin(*kinds)).select("src", "dst", "edge_id", "type") for source, kinds in shared.items()]
        return reduce(DataFrame.unionByName, parts)

    def with_index(self, label: str, prop: str) -> PropertyGraph:
        """Notes that a property is looked up often. Results don't depend on it; save() sorts the label's files by it, so
        that their statistics prune."""
        if prop not in self.props(label):
            raise GraphError("UnknownProperty", f"nodes of label '{label}' have no property '{prop}'")
        return replace(self, indexes=self.indexes | {(label, prop)})

    def without_index(self, label: str, prop: str) -> PropertyGraph:
        return replace(self, indexes=self.indexes - {(label, prop)})

    def with_node_table(self, label: str, df: DataFrame) -> PropertyGraph:
        return replace(self, nodes=self.nodes.plus(label, df))

    def with_edge_table(self, name: str, df: DataFrame) -> PropertyGraph:
        old = self.edges.get(name)
        return replace(self, edges={**self.edges, name: EdgeTable(df, old.src_label, old.dst_label) if old else EdgeTable(df)})


def present(df: DataFrame, prop: str) -> Column:
    """Whether a row has the property, an explicit null included."""
    return F.array_contains(KEYS, prop) if KEYS in df.columns else F.col(prop).isNotNull()


def both_ways(links: DataFrame) -> DataFrame:
    """Each link as seen from both ends, in one scan, with `way` 0 out, 1 in; a self-loop is seen twice."""
    rest = [c for c in links.columns if c not in ("src", "dst")]
    seen = lambda a, b, way: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), *rest, F.lit(way).alias("way"))
    return links.select(F.inline(F.array(seen("src", "dst", 0), seen("dst", "src", 1))))
