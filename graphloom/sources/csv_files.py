"""CSV import and export of nodes and edges.

Cells are read as text. Cells may hold line breaks if a file says so; then one task reads it as a whole. An empty cell is no property; `null` in any case is none either, except in a text column. Column
types are declared, or inferred over the whole column: bool, int, float, 0x bytes, datetime, date, else text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.errors import GraphError
from graphloom.model import EDGE_COLUMNS, KEYS, NODE_COLUMNS, EdgeTable, PropertyGraph
from graphloom.storage import written

#: Labels that a node may have.
MAX_LABELS = 255

TYPES = ("auto", "bool", "int", "float", "string", "date", "datetime", "bytes")
SPARK_TYPES = {"bool": "boolean", "int": "long", "float": "double", "string": "string", "date": "date", "datetime": "timestamp_ntz", "bytes": "binary"}


@dataclass
class NodeFile:
    path: str
    id_column: str = "id"
    label_column: str | None = None
    labels: list[str] = field(default_factory=list)
    columns: list[str] | None = None
    types: dict[str, str] = field(default_factory=dict)
    multiline: bool = False


@dataclass
class EdgeFile:
    path: str
    src_column: str = "src"
    dst_column: str = "dst"
    type_column: str | None = None
    type: str | None = None
    columns: list[str] | None = None
    types: dict[str, str] = field(default_factory=dict)
    multiline: bool = False


def parse(c: Column, kind: str) -> Column:
    """A text column as values of a type; null where a cell can't be parsed. Dates and datetimes are UTC; integers count
    days and milliseconds since 1970."""
    if kind == "string":
        return c
    c = F.trim(c)
    if kind == "bool":
        return F.when(F.lower(c).isin("true", "1", "yes"), True).when(F.lower(c).isin("false", "0", "no"), False)
    if kind == "bytes":
        return F.when(c.rlike("^0[xX]([0-9a-fA-F]{2})*$"), F.unhex(F.substr(c, F.lit(3))))
    if kind == "date":
        return F.when(c.rlike(r"^\d{4}-\d\d-\d\d$"), c.try_cast("date")).when(c.rlike(r"^-?\d+$"), F.date_add(F.lit("1970-01-01").cast("date"), c.try_cast("int")))
    if kind == "datetime":
        zoned = F.when(c.rlike(r"[zZ]$|[+-]\d\d:\d\d$"), F.to_utc_timestamp(c.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz"))
        plain = F.when(c.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?$"), c.try_cast("timestamp_ntz"))
        number = F.when(c.rlike(r"^-?\d+$"), F.to_utc_timestamp(F.timestamp_millis(c.try_cast("long")), F.current_timezone()).cast("timestamp_ntz"))
        return F.coalesce(zoned, plain, number)
    return c.try_cast(SPARK_TYPES[kind])


def _matches(c: Column, kind: str) -> Column:
    c = F.trim(c)
    if kind == "bool":
        return F.lower(c).isin("true", "false")
    if kind == "int":
        return c.rlike(r"^[+-]?\d+$") & c.try_cast("long").isNotNull()
    if kind == "float":
        return c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    if kind == "date":
        return c.rlike(r"^\d{4}-\d\d-\d\d$") & c.try_cast("date").isNotNull()
    if kind == "datetime":
        return ~c.rlike(r"^-?\d+$") & parse(c, "datetime").isNotNull()
    return parse(c, kind).isNotNull()


def infer(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The narrowest type that all filled cells of each column have, in one pass."""
    order = ("bool", "int", "float", "bytes", "datetime", "date")
    if not columns:
        return {}

    def filled(c: str) -> Column:
        return (F.trim(F.col(c)) != "") & (F.lower(F.trim(F.col(c))) != "null")

    aggs = [F.coalesce(F.bool_and(F.when(filled(c), _matches(F.col(c), k))), F.lit(False)).alias(f"{i}_{k}") for i, c in enumerate(columns) for k in order]
    row = df.agg(*aggs).first()
    return {c: next((k for k in order if row[f"{i}_{k}"]), "string") for i, c in enumerate(columns)}


def _read(spark: SparkSession, f: NodeFile | EdgeFile) -> DataFrame:
    return spark.read.csv(f.path, header=True, multiLine=f.multiline, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _find(df: DataFrame, name: str) -> str:
    for c in df.columns:
        if c.strip().lower() == name.strip().lower():
            return c
    raise GraphError("ColumnNotFound", f"no column '{name}'")


def _props(df: DataFrame, chosen: list[str] | None, skip: set[str], types: dict[str, str]) -> list[Column]:
    names = [_find(df, c) for c in chosen] if chosen is not None else [c for c in df.columns if c not in skip]
    declared = {_find(df, c): t for c, t in types.items()}
    if bad := [t for t in declared.values() if t not in TYPES]:
        raise GraphError("UnknownType", f"unknown column types {bad}")
    inferred = infer(df, [c for c in names if declared.get(c, "auto") == "auto"])
    out, faults = [], []
    for c in names:
        kind = inferred.get(c) or declared[c]
        cell = F.when(F.trim(F.col(c)) != "", F.col(c))
        if kind != "string":
            cell = F.when(F.lower(F.trim(cell)) != "null", cell)
        value = parse(cell, kind)
        if c in declared and declared[c] not in ("auto", "string"):
            faults.append((c, kind, cell.isNotNull() & value.isNull()))
        out.append(value.cast(SPARK_TYPES[kind]).alias(c.strip()))
    if faults:
        row = df.agg(*(F.bool_or(f).alias(str(i)) for i, (_, _, f) in enumerate(faults))).first()
        for i, (c, kind, _) in enumerate(faults):
            if row[i]:
                raise GraphError("InvalidValue", f"column '{c}' has a cell that isn't of type {kind}")
    return out


def import_graph(spark: SparkSession, nodes: list[NodeFile], edges: list[EdgeFile]) -> tuple[PropertyGraph, DataFrame]:
    """(graph, ids): the graph, and (key, id) of the files' own keys, which edges refer to.

    Raises on an empty or repeated key, on a node without a label, and on an edge whose ends aren't nodes of this import.
    """
    frames = []
    for f in nodes:
        df = _read(spark, f)
        key = _find(df, f.id_column)
        label = _find(df, f.label_column) if f.label_column else None
        props = _props(df, f.columns, {key, label}, f.types)
        listed = F.split(F.coalesce(F.col(label), F.lit("")), r"\|") if label else F.array().cast("array<string>")
        names = F.array_distinct(F.filter(F.transform(F.concat(F.array(*map(F.lit, f.labels)) if f.labels else F.array().cast("array<string>"), listed), lambda x: F.trim(x)), lambda x: x != ""))
        frames.append(df.select(F.trim(F.col(key)).alias("__key"), names.alias("__labels"), *props))
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f, allowMissingColumns=True)
    if rows.filter(F.coalesce(F.col("__key"), F.lit("")) == "").limit(1).count():
        raise GraphError("MissingId", "a node row has no id")
    if (row := rows.groupBy("__key").count().filter("count > 1").first()) is not None:
        raise GraphError("DuplicateId", f"node id '{row[0]}' is not unique")
    if (row := rows.filter(F.size("__labels") == 0).first()) is not None:
        raise GraphError("MissingLabel", f"node '{row[0]}' has no label")
    if (row := rows.filter(F.size("__labels") > MAX_LABELS).first()) is not None:
        raise GraphError("TooManyLabels", f"node '{row[0]}' has more than {MAX_LABELS} labels")
    numbered = _numbered(rows, "id")
    ids = numbered.select(F.col("__key").alias("key"), "id")
    columns = [c for c in numbered.columns if c not in ("__key", "__labels", "id")]
    names = [r[0] for r in numbered.select(F.explode("__labels").alias("l")).distinct().orderBy("l").collect()]
    tables = {n: numbered.filter(F.array_contains("__labels", n)).select("id", *columns) for n in names}

    links: dict[str, list[DataFrame]] = {}
    for f in edges:
        df = _read(spark, f)
        src, dst = _find(df, f.src_column), _find(df, f.dst_column)
        kind = _find(df, f.type_column) if f.type_column else None
        if not (kind or f.type):
            raise GraphError("MissingType", "an edge file needs a type or a type column")
        props = _props(df, f.columns, {src, dst, kind}, f.types)
        name = F.coalesce(F.when(F.trim(F.col(kind)) != "", F.trim(F.col(kind))), F.lit(f.type)) if kind else F.lit(f.type)
        part = df.select(F.trim(F.col(src)).alias("__s"), F.trim(F.col(dst)).alias("__d"), name.alias("__t"), *props)
        for end in ("__s", "__d"):
            if (row := part.join(ids, F.col(end) == F.col("key"), "left_anti").first()) is not None:
                raise GraphError("UnknownEndpoint", f"edge end '{row[end]}' is not a node of this import")
        part = part.join(ids.select(F.col("key").alias("__s"), F.col("id").alias("src")), "__s").join(ids.select(F.col("key").alias("__d"), F.col("id").alias("dst")), "__d")
        links.setdefault("all", []).append(part.drop("__s", "__d"))
    if not links:
        return PropertyGraph(tables, {}), ids
    every = links["all"][0]
    for part in links["all"][1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    every = _numbered(every, "edge_id")
    kinds = [r[0] for r in every.select("__t").distinct().orderBy("__t").collect()]
    return PropertyGraph(tables, {k: EdgeTable(every.filter(F.col("__t") == k).drop("__t")) for k in kinds}), ids


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """Consecutive ids from 1, in no particular order, without a sort: places within partitions, as they are written, plus
    the rows of the partitions before. No key's rows need to be in one task."""
    rows = written(df.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33).alias("__part")
    sizes = rows.groupBy(part).agg(F.count("*").alias("n"))  # as many rows as there were partitions
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.withColumn("__part", part).join(before, "__part").withColumn(name, place.cast("long")).drop("__part", "__at", "__before")


def shown(c: str, kind: str) -> Column:
    """A value as text: bytes as 0x hex, dates and datetimes as days and milliseconds since 1970, null as empty."""
    if kind == "binary":
        v = F.concat(F.lit("0x"), F.lower(F.hex(c)))
    elif kind == "date":
        v = F.datediff(F.col(c), F.lit("1970-01-01").cast("date")).cast("string")
    elif kind in ("timestamp_ntz", "timestamp"):
        v = F.unix_millis(F.from_utc_timestamp(F.col(c).cast("timestamp"), F.current_timezone()) if kind == "timestamp_ntz" else F.col(c)).cast("string")
    else:
        v = F.col(c).cast("string")
    return F.coalesce(v, F.lit("")).alias(c)


def export_nodes(graph: PropertyGraph, path: str, labels: list[str] | None = None) -> None:
    """id, labels joined by |, properties; in id order. Rows of one id under several labels are one row."""
    frames = [graph.label(n).drop(KEYS).withColumn("__label", F.lit(n)) for n in (labels or sorted(graph.nodes))]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f, allowMissingColumns=True)
    props = [c for c in rows.columns if c not in (*NODE_COLUMNS, "__label")]
    merged = rows.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("__label")), "|").alias("labels"), *(F.max(p).alias(p) for p in props))
    kinds = dict(merged.dtypes)
    merged.orderBy("id").select("id", "labels", *(shown(p, kinds[p]) for p in props)).write.csv(path, header=True, mode="overwrite", emptyValue="")


def export_edges(graph: PropertyGraph, path: str, types: list[str] | None = None) -> None:
    """src, dst, type, properties; in edge id order within a type."""
    frames = [graph.type(n).df.drop(KEYS).withColumn("type", F.lit(n)) for n in (types or sorted(graph.edges))]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f, allowMissingColumns=True)
    props = [c for c in rows.columns if c not in (*EDGE_COLUMNS, "type")]
    kinds = dict(rows.dtypes)
    rows.orderBy("type", "edge_id").select("src", "dst", "type", *(shown(p, kinds[p]) for p in props)).write.csv(path, header=True, mode="overwrite", emptyValue="")


def save(graph: PropertyGraph, path: str) -> None:
    """A graph as Parquet: one folder for each label and type; files are sorted by an indexed property, edges by source."""
    for n, df in graph.nodes.items():
        if by := sorted(p for label, p in graph.indexes if label == n):
            df = df.sortWithinPartitions(*by)
        df.write.mode("overwrite").parquet(f"{path}/nodes/{n}")
    for n, t in graph.edges.items():
        t.df.sortWithinPartitions("src").write.mode("overwrite").parquet(f"{path}/edges/{n}")


def load(spark: SparkSession, path: str, labels: list[str], types: dict[str, tuple[str | None, str | None]]) -> PropertyGraph:
    return PropertyGraph({n: spark.read.parquet(f"{path}/nodes/{n}") for n in labels}, {n: EdgeTable(spark.read.parquet(f"{path}/edges/{n}"), a, b) for n, (a, b) in types.items()})
