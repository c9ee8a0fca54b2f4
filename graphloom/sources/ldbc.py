"""Social-network benchmark files: persons and who knows whom, separated by |."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.model import EdgeTable, PropertyGraph


def ldbc_graph(spark: SparkSession, persons: str, knows: str) -> PropertyGraph:
    """Users with the persons' columns, and FOLLOWS both ways for each pair that knows each other."""
    people = spark.read.csv(persons, sep="|", header=True)
    key = next(c for c in people.columns if c.lower() in ("id", "person.id"))
    users = people.select(F.col(f"`{key}`").cast("long").alias("id"), F.concat_ws(" ", "firstName", "lastName").alias("name"), *(c for c in people.columns if c not in (key, "firstName", "lastName")))
    pairs = spark.read.csv(knows, sep="|", header=False)
    since = pairs.columns[2:3]
    pairs = pairs.select(F.col("_c0").try_cast("long").alias("src"), F.col("_c1").try_cast("long").alias("dst"), *(F.col(c).alias("creationDate") for c in since)).filter("src IS NOT NULL AND dst IS NOT NULL")
    back = pairs.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    both = pairs.withColumn("way", F.lit(0)).unionByName(back.withColumn("way", F.lit(1)))
    ids = F.xxhash64("src", "dst", "way")
    return PropertyGraph({"User": users}, {"FOLLOWS": EdgeTable(both.select("src", "dst", ids.alias("edge_id"), *(["creationDate"] if since else [])), "User", "User")})
