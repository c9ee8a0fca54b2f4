"""Small generated graphs."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import SparkSession

from graphloom.model import EdgeTable, PropertyGraph


def follows_demo(spark: SparkSession) -> PropertyGraph:
    """Three users, three follows."""
    users = spark.createDataFrame([(1, "Ada"), (2, "Grace"), (3, "Alan")], "id long, name string")
    follows = spark.createDataFrame([(1, 2, 1), (2, 1, 2), (1, 3, 3)], "src long, dst long, edge_id long")
    return PropertyGraph({"User": users}, {"FOLLOWS": EdgeTable(follows, "User", "User")})


def random_graph(spark: SparkSession, nodes: int, edges: int, types: int = 3, seed: int = 42) -> PropertyGraph:
    """Users and typed links between them; self-loops and parallel links can occur."""
    rng = random.Random(seed)
    users = spark.createDataFrame([(i, f"user-{i}", rng.randrange(1000)) for i in range(nodes)], "id long, name string, score long")
    rows = [(rng.randrange(nodes), rng.randrange(nodes), e, rng.randrange(types), rng.randrange(1, 1000)) for e in range(edges)]
    return PropertyGraph(
        {"User": users},
        {f"T{t}": EdgeTable(spark.createDataFrame([(s, d, e, w) for s, d, e, k, w in rows if k == t], "src long, dst long, edge_id long, weight long"), "User", "User") for t in range(types)},
    )


def social_graph(spark: SparkSession, nodes: int = 400, edges: int = 2400, seed: int = 42) -> PropertyGraph:
    """Persons, some with a second label, and three kinds of unique links without self-loops."""
    rng = random.Random(seed)
    cities, teams = ("Lisbon", "Oslo", "Quito", "Nairobi", "Hanoi"), ("Core", "Data", "Design", "Field")
    more, roles = (None, "Mentor", "Manager", "Contributor"), ("engineer", "analyst", "designer", "lead")
    abilities, plans = ("cooking", "drawing", "mapping", "parsing", "sailing", "tuning"), ("Harbour", "Lantern", "Meadow", "Quarry")
    day = lambda year, years: dt.date(year, 1, 1) + dt.timedelta(days=rng.randrange(365 * years))
    people = [
        (i, f"person-{i}", f"@p{i}", rng.choice(roles), rng.choice(teams), rng.choice(cities), day(2014, 10), ", ".join(sorted(rng.sample(abilities, 3))), rng.choice(more)) for i in range(1, nodes + 1)
    ]
    persons = spark.createDataFrame(people, "id long, name string, handle string, role string, team string, city string, joined_at date, skills string, second string")
    kinds, links = ("FOLLOWS", "MENTORS", "COLLABORATES_WITH"), {}
    while len(links) < edges:
        src, dst, kind = rng.randint(1, nodes), rng.randint(1, nodes), rng.choice(kinds)
        if src != dst:
            links.setdefault((src, dst, kind), (rng.choice(plans), round(rng.uniform(0.1, 1), 2), day(2016, 7)))
    schema = "src long, dst long, edge_id long, project string, strength double, since date"
    tables = {k: EdgeTable(spark.createDataFrame([(s, d, e, *more) for e, ((s, d, t), more) in enumerate(links.items()) if t == k], schema), "Person", "Person") for k in kinds}
    return PropertyGraph({"Person": persons.drop("second")} | {r: persons.filter(persons.second == r).drop("second") for r in more if r}, tables)
