"""A graph view of the star-schema, event and document tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import EdgeSource, EdgeTable, PropertyGraph

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _nodes(df: DataFrame, key: str, **props: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), *(F.col(c).alias(p) for p, c in props.items()))


def _links(df: DataFrame, src: str, dst: str, edge_id: str, **props: str) -> DataFrame:
    ends = (F.expr(e).cast("long").alias(n) for e, n in ((src, "src"), (dst, "dst"), (edge_id, "edge_id")))
    return df.select(*ends, *(F.col(c).alias(p) for p, c in props.items()))


def table_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    """Regions, nations, customers, suppliers, parts, orders and documents with their relations; events link customers.

    Edge ids of lineitem relations come from order and line, and repeat where the table's own key does: operations on one
    edge refuse such ids."""
    t = lambda name: read(spark, folder, name)

    def documents() -> DataFrame:
        labels = t("labels").withColumnRenamed("doc_id", "label_id")
        joined = t("documents").join(labels, F.col("doc_id") == F.col("label_id"), "left")
        return _nodes(joined, "doc_id", lang="lang", source="source", chars="n_chars", quality="quality", toxic="toxic")

    # tables are opened when their label or type is used
    nodes = {
        "Region": lambda: _nodes(t("region"), "r_regionkey", name="r_name"),
        "Nation": lambda: _nodes(t("nation"), "n_nationkey", name="n_name"),
        "Customer": lambda: _nodes(t("customer"), "c_custkey", name="c_name", balance="c_acctbal", segment="c_mktsegment"),
        "Supplier": lambda: _nodes(t("supplier"), "s_suppkey", name="s_name", balance="s_acctbal"),
        "Part": lambda: _nodes(t("part"), "p_partkey", name="p_name", brand="p_brand", type="p_type", size="p_size", price="p_retailprice"),
        "Order": lambda: _nodes(t("orders"), "o_orderkey", status="o_orderstatus", total="o_totalprice", placed="o_orderdate", priority="o_orderpriority"),
        "Document": documents,
    }
    line = "l_orderkey * 8 + l_linenumber"
    edges = {
        "IN_REGION": EdgeTable(lambda: _links(t("nation"), "n_nationkey", "n_regionkey", "n_nationkey"), "Nation", "Region"),
        "LIVES_IN": EdgeTable(lambda: _links(t("customer"), "c_custkey", "c_nationkey", "c_custkey"), "Customer", "Nation"),
        "BASED_IN": EdgeTable(lambda: _links(t("supplier"), "s_suppkey", "s_nationkey", "s_suppkey"), "Supplier", "Nation"),
        "PLACED": EdgeTable(lambda: _links(t("orders"), "o_custkey", "o_orderkey", "o_orderkey"), "Customer", "Order"),
        "CONTAINS": EdgeTable(lambda: _links(t("lineitem"), "l_orderkey", "l_partkey", line, quantity="l_quantity", price="l_extendedprice"), "Order", "Part"),
        "SUPPLIED_BY": EdgeTable(lambda: _links(t("lineitem"), "l_partkey", "l_suppkey", line), "Part", "Supplier"),
    }
    events = EdgeSource(lambda: _links(t("events"), "user_id", "get_json_object(props, '$.k')", "event_id", type="event_type", ts="ts", value="value"))
    return PropertyGraph(nodes, edges | {kind: events.table(kind, "Customer", "Customer") for kind in EVENT_TYPES})
