"""Patterns, traversal, mutations, explain and the builder on small graphs."""

import random
from collections import Counter, deque

import pytest

from graphloom.errors import GraphError, NotFound
from graphloom.functions.builder import Database, TypedDatabase, prop
from graphloom.model import EdgeTable, PropertyGraph
from graphloom.operators import mutate, physical, statistics, traverse
from graphloom.plans.compiler import execute
from graphloom.sources.demo import follows_demo, random_graph
from graphloom.streaming.cursor import cancel


@pytest.fixture(scope="module")
def demo(spark):
    return follows_demo(spark)


@pytest.fixture(scope="module")
def rand(spark):
    g = random_graph(spark, 25, 90, seed=3)
    links = [(r.src, r.dst, r.type) for r in g.links().collect()]
    return g, links


def spec(**more):
    return {"$schemaVersion": 1, "matches": [{"var": "a", "label": "User"}, {"var": "b", "label": "User"}], "edges": [{"from": "a", "to": "b", "edgeType": "FOLLOWS"}], **more}


def test_demo(spark, demo):
    db = Database(spark, demo)
    assert db.count("User") == 3
    assert db.neighbors(1) == [2, 3] and db.neighbors(1, "in") == [2]
    assert traverse.degree(demo, 1, "both") == 3
    assert db.bfs("User", 2, 2) == [(2, 0), (1, 1), (3, 2)]
    q = db.query().match("a", "User").match("b", "User").where("a", "FOLLOWS", "b")
    assert sorted((r["a"]["props"]["name"], r["b"]["props"]["name"]) for r in q.rows()) == [("Ada", "Alan"), ("Ada", "Grace"), ("Grace", "Ada")]
    assert q.filter(prop("a", "name") == "Grace").select("b.name").rows() == [{"name": "Ada"}]
    mutual = q.where("b", "FOLLOWS", "a").select(("a.name", "x"), ("b.name", "y")).rows()
    assert sorted(tuple(r.values()) for r in mutual) == [("Ada", "Grace"), ("Grace", "Ada")]
    out = q.envelope(max_rows=2)
    assert len(out["rows"]) == 2 and out["truncated"] and out["row_limit"] == 2
    assert len(list(q.request_id("r1").stream())) == 3
    assert cancel(spark, "r1") is False
    assert db.find("User", "name", "Alan") == 3 and db.find("User", "name", "Nobody") is None
    assert traverse.get_node(demo, "User", 1) == {"id": 1, "name": "Ada"} and traverse.get_node(demo, "User", 9) is None


def test_both_counts_loops_twice_but_degree_once(spark):
    g = PropertyGraph({"N": spark.createDataFrame([(1,), (2,)], "id long")}, {"E": EdgeTable(spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 3), (1, 2, 4)], "src long, dst long, edge_id long"))})
    assert traverse.neighbors(g, 1, "both", distinct=False).count() == 5
    assert traverse.degree(g, 1, "both") == 4
    assert sorted(r.neighbor for r in traverse.neighbors(g, 1, "both").collect()) == [1, 2]
    q = {"$schemaVersion": 1, "matches": [{"var": "a", "label": "N"}, {"var": "b", "label": "N"}], "edges": [{"from": "a", "to": "b", "direction": "both"}]}
    assert Counter((r.a, r.b) for r in execute(g, q).collect()) == {(1, 1): 2, (1, 2): 3, (2, 1): 3}
    assert execute(g, {**q, "distinct": True}).count() == 3


def test_random_graph_against_plain_python(rand):
    g, links = rand
    out = Counter((s, d) for s, d, _ in links)
    q = {"$schemaVersion": 1, "matches": [{"var": v, "label": "User"} for v in "abc"], "edges": [{"from": "a", "to": "b"}, {"from": "b", "to": "c"}, {"from": "c", "to": "a", "edge_type": "T1"}]}
    t1 = Counter((s, d) for s, d, t in links if t == "T1")
    want = Counter({(a, b, c): out[a, b] * out[b, c] * t1[c, a] for a, b in out for c in range(25) if out[b, c] and t1[c, a]})
    assert Counter((r.a, r.b, r.c) for r in execute(g, q).collect()) == want
    deg = {r.node: r.degree for r in traverse.degrees(g, "out").collect()}
    assert deg == dict(Counter(s for s, _, _ in links))
    assert Counter(r.node for r in traverse.neighbors_of(g, g.links(), "in").collect()) == Counter(d for _, d, _ in links)
    for direction in ("out", "in", "both"):
        near = {}
        for s, d, _ in links:
            if direction != "in":
                near.setdefault(s, set()).add(d)
            if direction != "out":
                near.setdefault(d, set()).add(s)
        seen, todo = {0: 0}, deque([0])
        while todo:
            v = todo.popleft()
            for w in near.get(v, ()):
                if w not in seen and seen[v] < 3:
                    seen[w] = seen[v] + 1
                    todo.append(w)
        assert {r.node: r.depth for r in traverse.bfs(g, "User", 0, 3, direction).collect()} == seen
    first = [(r.node, r.depth) for r in traverse.bfs(g, "User", 0, 3, max_results=4).collect()]
    assert len(first) == 4 and first[0] == (0, 0)
    with pytest.raises(NotFound):
        traverse.bfs(g, "User", 999, 2)


def test_traverse_label_counts_starts_reached_by_others(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    g = PropertyGraph({"U": users}, {"E": EdgeTable(spark.createDataFrame([(1, 2, 1), (3, 3, 2)], "src long, dst long, edge_id long"))})
    assert {r.node for r in traverse.traverse_label(g, "U", 2).collect()} == {2}


def test_hub_labels_are_enforced(spark):
    g = PropertyGraph(
        {"A": spark.createDataFrame([(1,)], "id long"), "B": spark.createDataFrame([(2,)], "id long"), "C": spark.createDataFrame([(3,)], "id long")},
        {"E": EdgeTable(spark.createDataFrame([(1, 2, 1), (1, 3, 2)], "src long, dst long, edge_id long"))},
    )
    q = {"$schemaVersion": 1, "matches": [{"var": "a", "label": "A"}, {"var": "b", "label": "B"}], "edges": [{"from": "a", "to": "b"}]}
    assert [(r.a, r.b) for r in execute(g, q).collect()] == [(1, 2)]


@pytest.mark.parametrize(
    ("change", "code"),
    [
        ({"$schemaVersion": 2}, "UnsupportedSchemaVersion"),
        ({"matches": []}, "EmptyMatches"),
        ({"matches": [{"var": "a", "label": "User"}] * 2}, "DuplicateVariable"),
        ({"matches": [{"var": "a"}]}, "MatchMissingLabel"),
        ({"matches": [{"var": "a", "label": "Nope"}]}, "UnknownLabel"),
        ({"matches": [{"var": f"v{i}", "label": "User"} for i in range(1001)]}, "TooManyMatches"),
        ({"edges": [{"from": "a", "to": "z"}]}, "VarNotMatched"),
        ({"edges": [{"from": "a", "to": "a"}]}, "EdgeReflexiveNotAllowed"),
        ({"edges": [{"from": "a", "to": "b", "direction": "up"}]}, "DirectionInvalid"),
        ({"edges": [{"from": "a", "to": "b", "edgeType": "NOPE"}]}, "UnknownEdgeType"),
        ({"edges": []}, "DisconnectedPattern"),
        ({"predicate": {"op": "eq", "var": "a", "prop": "nope", "value": 1}}, "UnknownProperty"),
        ({"predicate": {"op": "eq", "var": "z", "prop": "name", "value": "x"}}, "UnknownVariable"),
        ({"predicate": {"op": "eq", "var": "a", "prop": "name", "value": 1}}, "TypeMismatch"),
        ({"projections": [{"var": "a", "prop": "name", "alias": " "}]}, "EmptyProjectionAlias"),
        ({"projections": [{"var": "a", "prop": "name"}, {"var": "b", "prop": "name"}]}, "DuplicateProjection"),
        ({"projections": [{"var": "z"}]}, "UnknownVariable"),
    ],
)
def test_spec_errors(demo, change, code):
    with pytest.raises(GraphError) as e:
        execute(demo, spec(**change))
    assert e.value.code == code


def test_tagged_literals_and_not(demo):
    p = {"op": "not", "args": [{"op": "eq", "var": "b", "prop": "name", "value": {"t": "String", "v": "Alan"}}]}
    rows = execute(demo, spec(predicate=p, projections=[{"kind": "prop", "var": "b", "prop": "name", "alias": "n"}])).collect()
    assert sorted(r.n for r in rows) == ["Ada", "Grace"]


def test_explain_hash_and_redaction(spark, demo):
    db = Database(spark, demo)
    q = spec(predicate={"op": "eq", "var": "a", "prop": "name", "value": "Ada"})
    full, masked = db.explain(q), db.explain(q, redact_literals=True)
    assert full["plan_hash"] == masked["plan_hash"] and "Ada" in str(full["plan"]) and "Ada" not in str(masked)
    other = db.explain(spec(predicate={"op": "eq", "var": "a", "prop": "name", "value": "Alan"}))
    assert other["plan_hash"] != full["plan_hash"]
    assert full["plan"]["op"] == "Project" and "Physical Plan" in full["spark"]


def test_hand_built_plans(demo):
    names = physical.prop_scan(demo, "User", "a", (prop("a", "name") != "Alan").node)
    pairs = physical.expand(names, demo.links(["FOLLOWS"]), "a", "b")
    assert sorted(map(tuple, pairs.collect())) == [(1, 2), (1, 3), (2, 1)]
    back = physical.expand(names, demo.links(["FOLLOWS"]), "a", "b", "in")
    both = physical.hash_join(pairs, back)
    assert sorted(map(tuple, both.collect())) == [(1, 2), (2, 1)]
    assert physical.union([names, names]).count() == 4 and physical.union([names, names], dedup=True).count() == 2
    assert physical.intersect([pairs, names]).count() == 3
    assert [r.x.props.name for r in physical.project_var(demo, names, "User", "a", "x").orderBy("x._id").collect()] == ["Ada", "Grace"]


def test_mutations(spark, demo):
    db = Database(spark, demo)
    before = db.graph
    done = db.mutate(
        [
            {"op": "createNode", "label": "User", "props": {"name": "Edsger", "age": 40}, "alias": "e"},
            {"op": "createEdge", "type": "FOLLOWS", "src": {"$ref": "e"}, "dst": 1},
            {"op": "updateNode", "label": "User", "id": 1, "set": {"age": 30}, "unset": ["name"]},
            {"op": "deleteNode", "label": "User", "id": 3, "cascade": True},
        ]
    )
    assert done.created_nodes == [4] and done.created_edges == [4] and done.deleted_edges == 1
    assert sorted((r.id, r.name, r.age) for r in db.graph.label("User").collect()) == [(1, None, 30), (2, "Grace", None), (4, "Edsger", 40)]
    assert before.label("User").count() == 3 and db.neighbors(4) == [1]
    for ops, code in [
        ([{"op": "deleteNode", "label": "User", "id": 1}], "NodeHasEdges"),
        ([{"op": "createEdge", "type": "FOLLOWS", "src": 1, "dst": 77}], "NotFound"),
        ([{"op": "updateNode", "label": "User", "id": 77, "set": {}}], "NotFound"),
        ([{"op": "deleteEdge", "type": "FOLLOWS", "id": 77}], "NotFound"),
        ([{"op": "createEdge", "type": "FOLLOWS", "src": {"$ref": "q"}, "dst": 1}], "UnknownAlias"),
        ([{"op": "createNode", "label": "User", "alias": "x"}, {"op": "createNode", "label": "User", "alias": "x"}], "DuplicateAlias"),
        ([{"op": "createNode", "label": "User"}, {"op": "what"}], "InvalidMutation"),
    ]:
        kept = db.graph
        with pytest.raises(GraphError) as e:
            db.mutate(ops)
        assert e.value.code == code and db.graph is kept
    g, sums = mutate.mutate_batched(spark, before, [{"op": "createNode", "label": "User", "props": {"name": str(i)}} for i in range(5)], size=2)
    assert len(sums) == 3 and g.label("User").count() == 8
    assert db.pragma("synchronous", "full") == "full" and db.pragma("synchronous") == "full"


def test_present_keys_follow_patches(spark):
    g = PropertyGraph({"N": spark.createDataFrame([(1, 5, ["p"])], "id long, p long, __keys array<string>")}, {})
    g = mutate.update_node(g, "N", 1, {"q": "x", "p": None})
    row = g.label("N").first()
    assert (row.p, row.q, sorted(row["__keys"])) == (None, "x", ["p", "q"])
    assert [r.n_props for r in statistics.prop_counts(g, "N").collect()] == [2]
    assert mutate.update_node(g, "N", 1, unsets=["p"]).label("N").first()["__keys"] == ["q"]


def test_bulk(spark, demo):
    more = spark.createDataFrame([(10, "x"), (11, "y")], "id long, name string")
    g = mutate.bulk_nodes(demo, "User", more)
    assert g.label("User").count() == 5
    with pytest.raises(GraphError, match="DuplicateId"):
        mutate.bulk_nodes(g, "User", more)
    with pytest.raises(NotFound):
        mutate.bulk_edges(g, "FOLLOWS", spark.createDataFrame([(10, 99, 7)], "src long, dst long, edge_id long"))
    assert mutate.bulk_edges(g, "FOLLOWS", spark.createDataFrame([(10, 11, 7)], "src long, dst long, edge_id long")).links().count() == 4


def test_typed(spark):
    g = PropertyGraph({"Person": spark.createDataFrame([(1, "Alice", 30)], "id long, name string, age long"), "Company": spark.createDataFrame([(2, "Acme")], "id long, name string")}, {})
    schema = {"nodes": {"Person": {"properties": {"name": "s", "age": "i"}}, "Company": {"properties": {"name": "s"}}}, "edges": {"WORKS_AT": {"from": "Person", "to": "Company"}}}
    db = TypedDatabase(spark, g, schema)
    db.create_edge("WORKS_AT", 1, 2, role="dev")
    assert db.traverse("Person", "WORKS_AT") == {2}
    with pytest.raises(GraphError, match="UnknownLabel"):
        db.create_node("Robot", name="x")
    with pytest.raises(GraphError, match="UnknownProperty"):
        db.create_node("Person", wings=2)
    with pytest.raises(GraphError, match="NotFound"):
        db.create_edge("WORKS_AT", 2, 1)
    with pytest.raises(GraphError, match="UnknownLabel"):
        TypedDatabase(spark, g, {"nodes": {}, "edges": {"E": {"from": "X", "to": "Y"}}})


def test_json_profile_and_indexes(spark, demo, tmp_path):
    import json

    from graphloom.sources.csv_files import load, save
    from graphloom.streaming.cursor import profile

    q = Database(spark, demo).query().match("a", "User").filter(prop("a", "name") == "Ada").select("a.name").request_id("r2")
    assert json.loads(q.json(5)) == {"request_id": "r2", "features": [], "rows": [{"name": "Ada"}], "row_limit": 5, "truncated": False}
    told = profile(q.df())
    assert told["rows"] == 1 and told["operators"]
    g = demo.with_index("User", "name")
    save(g, str(tmp_path / "g"))
    assert load(spark, str(tmp_path / "g"), ["User"], {"FOLLOWS": ("User", "User")}).links().count() == 3
    assert not g.without_index("User", "name").indexes
    with pytest.raises(GraphError, match="UnknownProperty"):
        demo.with_index("User", "wings")
    assert statistics.summary(demo) == {"labels": {"User": 3}, "types": {"FOLLOWS": 3}}


def test_generated_and_benchmark_files(spark, tmp_path):
    from graphloom.sources.demo import social_graph
    from graphloom.sources.ldbc import ldbc_graph

    g = social_graph(spark, 60, 200)
    assert g.label("Person").count() == 60 and g.links().count() == 200
    assert g.links().filter("src = dst").count() == 0 and statistics.verify(g).filter("count > 0").count() == 0
    (tmp_path / "p.csv").write_text("id|firstName|lastName|gender\n1|A|B|f\n2|C|D|m\n")
    (tmp_path / "k.csv").write_text("Person.id|Person.id|creationDate\n1|2|2010\n")
    g = ldbc_graph(spark, str(tmp_path / "p.csv"), str(tmp_path / "k.csv"))
    assert sorted((r.src, r.dst) for r in g.links().collect()) == [(1, 2), (2, 1)]
    assert sorted(r.name for r in g.label("User").collect()) == ["A B", "C D"]


def test_edge_feed(spark, tmp_path):
    from graphloom.streaming.cursor import edge_feed

    spark.createDataFrame([(1, 2, 7)], "src long, dst long, edge_id long").write.parquet(str(tmp_path / "in"))
    got = []
    feed = edge_feed(spark, str(tmp_path / "in"), "src long, dst long, edge_id long", lambda df, _: got.extend(map(tuple, df.collect())), str(tmp_path / "ck"))
    feed.awaitTermination(60)
    assert got == [(1, 2, 7)]


def test_stress_invariants(spark):
    rng = random.Random(9)
    for seed in rng.sample(range(100), 2):
        g = random_graph(spark, 12, 60, types=4, seed=seed)
        for d in ("out", "in"):
            deg = {r.node: r.degree for r in traverse.degrees(g, d).collect()}
            assert deg == dict(Counter(r.node for r in traverse.neighbors_of(g, g.links(), d).collect()))
        assert all(r["count"] == 0 for r in statistics.verify(g).filter("finding <> 'repeated_id'").collect())


def test_lookups_and_dumps(spark):
    g = PropertyGraph(
        {"A": spark.createDataFrame([(1, "x", None), (2, "y", 5)], "id long, name string, n long"), "B": spark.createDataFrame([(2, "z", 7)], "id long, name string, m long")},
        {"E": EdgeTable(spark.createDataFrame([(1, 2, 1, 0.5)], "src long, dst long, edge_id long, w double")), "F": EdgeTable(spark.createDataFrame([(9, 2, 1), (1, 8, 1)], "src long, dst long, edge_id long"), "A", "B")},
    )
    assert traverse.get_edge(g, "E", 1) == {"src": 1, "dst": 2, "edge_id": 1, "w": 0.5} and traverse.get_edge(g, "E", 2) is None
    assert sorted(map(tuple, statistics.all_nodes(g).collect())) == [("A", 1), ("A", 2), ("B", 2)]
    dump = {r.id: (r.labels, r.props) for r in statistics.full_graph_nodes(g).collect()}
    assert dump == {1: (["A"], {"name": "x"}), 2: (["A", "B"], {"name": "y", "n": "5", "m": "7"})}
    found = {(r.type, r.finding): r["count"] for r in statistics.verify(g).collect()}
    assert found == {("E", "dangling_src"): 0, ("E", "dangling_dst"): 0, ("E", "repeated_id"): 0, ("F", "dangling_src"): 1, ("F", "dangling_dst"): 1, ("F", "repeated_id"): 1}


def test_one_scan_serves_all_types_of_a_source(spark, tmp_path):
    spark.createDataFrame([(1, 2, 1, "X"), (2, 1, 2, "Y"), (1, 1, 3, "Z")], "src long, dst long, edge_id long, type string").write.parquet(str(tmp_path / "e"))
    from graphloom.model import EdgeSource

    source = EdgeSource(lambda: spark.read.parquet(str(tmp_path / "e")))
    g = PropertyGraph({"N": spark.createDataFrame([(1,), (2,)], "id long")}, {k: source.table(k, "N", "N") for k in "XYZ"})
    assert sorted(map(tuple, g.links(["X", "Y"]).collect())) == [(1, 2, 1, "X"), (2, 1, 2, "Y")]
    plan = traverse.neighbors_of(g, g.links(), "both")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert traverse.neighbors_of(g, g.links(), "both").count() == 6
    changed = mutate.update_edge(g, "X", 1, {"w": 1})
    assert changed.links().count() == 3 and changed.type("X").df.first().w == 1 and changed.type("Y").df.columns == ["src", "dst", "edge_id"]


def test_mutations_in_one_go(spark):
    """A random script against plain Python: new rows, rows changed twice, edges and nodes that go again."""
    rng = random.Random(4)
    users = {i: {"name": f"u{i}", "age": i} for i in range(1, 9)}
    links = {i: [rng.randint(1, 8), rng.randint(1, 8), None] for i in range(1, 15)}
    g = PropertyGraph(
        {"User": spark.createDataFrame([(i, u["name"], u["age"]) for i, u in users.items()], "id long, name string, age long")},
        {"E": EdgeTable(spark.createDataFrame([(s, d, i, w) for i, (s, d, w) in links.items()], "src long, dst long, edge_id long, w long"), "User", "User")},
    )
    ops, next_user, next_link, gone = [], 9, 15, 0
    for k in range(120):
        kind = rng.choice(["node", "edge", "set", "patch", "cut"] + (["drop"] if k % 17 == 16 else []))
        if kind == "node":
            ops.append({"op": "createNode", "label": "User", "props": {"name": f"n{k}"}})
            users[next_user], next_user = {"name": f"n{k}", "age": None}, next_user + 1
        elif kind == "edge":
            s, d = rng.choice(list(users)), rng.choice(list(users))
            ops.append({"op": "createEdge", "type": "E", "src": s, "dst": d, "props": {"w": k}})
            links[next_link], next_link = [s, d, k], next_link + 1
        elif kind == "set":
            i = rng.choice(list(users))
            ops.append({"op": "updateNode", "label": "User", "id": i, "set": {"age": k}, "unset": ["name"] if k % 3 == 0 else None})
            users[i].update({"age": k} | ({"name": None} if k % 3 == 0 else {}))
        elif kind == "patch" and links:
            i = rng.choice(list(links))
            ops.append({"op": "updateEdge", "type": "E", "id": i, "set": {"w": -k}})
            links[i][2] = -k
        elif kind == "cut" and links:
            i = rng.choice(list(links))
            ops.append({"op": "deleteEdge", "type": "E", "id": i})
            del links[i]
            gone += 1
        elif kind == "drop" and len(users) > 3:
            i = rng.choice(list(users))
            ops.append({"op": "deleteNode", "label": "User", "id": i, "cascade": True})
            lost = [e for e, (s, d, _) in links.items() if i in (s, d)]
            del users[i]
            for e in lost:
                del links[e]
            gone += len(lost)
    out, done = mutate.mutate(spark, g, ops)
    assert {r.id: {"name": r.name, "age": r.age} for r in out.label("User").collect()} == users
    assert {r.edge_id: [r.src, r.dst, r.w] for r in out.type("E").df.collect()} == links and done.deleted_edges == gone
    assert g.label("User").count() == 8


def test_thousand_operations_stay_shallow(spark, demo):
    ops = []
    for i in range(250):
        ops += [
            {"op": "createNode", "label": "User", "props": {"name": f"x{i}"}, "alias": f"x{i}"},
            {"op": "createEdge", "type": "FOLLOWS", "src": {"$ref": f"x{i}"}, "dst": 1},
            {"op": "updateNode", "label": "User", "id": {"$ref": f"x{i}"}, "set": {"age": i}},
            {"op": "updateNode", "label": "User", "id": 1 + i % 3, "set": {"age": i}},
        ]
    out, done = mutate.mutate(spark, demo, ops)
    assert len(done.created_nodes) == len(done.created_edges) == 250 and done.updated_nodes == 500
    assert out.label("User").count() == 253 and out.label("User")._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert {r.id: r.age for r in out.label("User").filter("id <= 3").collect()} == {1: 249, 2: 247, 3: 248}
    g = demo
    for i in range(12):  # deletions and creations in turn are written now and then
        g, _ = mutate.mutate_batched(spark, g, [{"op": "createNode", "label": "User", "alias": "a"}, {"op": "deleteNode", "label": "User", "id": {"$ref": "a"}}] * 1)
    many = [o for i in range(12) for o in ({"op": "createNode", "label": "User", "alias": f"a{i}"}, {"op": "deleteNode", "label": "User", "id": {"$ref": f"a{i}"}})]
    g, _ = mutate.mutate(spark, demo, many)
    assert g.label("User").count() == 3 and g.label("User")._jdf.queryExecution().optimizedPlan().toString().count("Join") < mutate.WRITE_AFTER


def test_deletions_in_order(spark):
    g = PropertyGraph(
        {"N": spark.createDataFrame([(1,), (2,), (3,)], "id long")}, {"E": EdgeTable(spark.createDataFrame([(1, 2, 1), (2, 2, 2), (3, 1, 3)], "src long, dst long, edge_id long"), "N", "N")}
    )
    drop = lambda i, cascade: {"op": "deleteNode", "label": "N", "id": i, "cascade": cascade}
    out, done = mutate.mutate(spark, g, [drop(1, True), drop(3, False)])  # 3's only edge went with 1
    assert done.deleted_edges == 2 and [r.edge_id for r in out.type("E").df.collect()] == [2]
    for ops, code in (([drop(3, False), drop(1, True)], "NodeHasEdges"), ([drop(1, True), drop(1, True)], "NotFound"), ([drop(7, True)], "NotFound")):
        with pytest.raises(GraphError) as e:
            mutate.mutate(spark, g, ops)
        assert e.value.code == code


def test_edges_with_repeated_ids_are_refused(spark):
    g = PropertyGraph({"N": spark.createDataFrame([(1,)], "id long")}, {"E": EdgeTable(spark.createDataFrame([(1, 1, 5), (1, 1, 5), (1, 1, 6)], "src long, dst long, edge_id long"))})
    for act in (lambda: mutate.update_edge(g, "E", 5, {"w": 1}), lambda: mutate.delete_edge(g, "E", 5), lambda: mutate.mutate(spark, g, [{"op": "deleteEdge", "type": "E", "id": 5}])):
        with pytest.raises(GraphError, match="AmbiguousEdge"):
            act()
    assert mutate.delete_edge(g, "E", 6).type("E").df.count() == 2


def test_scripts_and_transactions(spark, demo):
    db = Database(spark, demo)
    script = db.create()
    a = script.node("User", {"name": "Barbara"})
    script.edge("FOLLOWS", a, script.node("User", {"name": "Dana"}, alias="d"), {"since": 3}).edge("FOLLOWS", 1, a)
    done = script.execute()
    assert done.aliases["d"] in done.created_nodes and len(done.created_edges) == 2 and db.neighbors(done.created_nodes[0]) == [done.aliases["d"]]
    kept = db.graph

    def fails(tx):
        tx.node("User")
        tx.delete_node("User", 999)

    with pytest.raises(NotFound):
        db.transaction(fails)
    assert db.graph is kept
    out, done = db.transaction(lambda tx: tx.update_edge("FOLLOWS", 1, {"since": 9}) and "ok")
    assert out == "ok" and done.updated_edges == 1 and traverse.get_edge(db.graph, "FOLLOWS", 1)["since"] == 9
    db.update_edge("FOLLOWS", 1, unset=["since"])
    assert traverse.get_edge(db.graph, "FOLLOWS", 1)["since"] is None
    assert len(db.mutate_many(iter([{"op": "createNode", "label": "User"}])).created_nodes) == 1
    n = db.count("User")
    with pytest.raises(NotFound):
        db.mutate_batched([{"op": "createNode", "label": "User"}, {"op": "deleteEdge", "type": "FOLLOWS", "id": 999}], size=1)
    assert db.count("User") == n + 1  # the first chunk stays

    async def later(tx):
        return None

    with pytest.raises(TypeError):
        db.transaction(later)


def test_a_running_request_is_cancelled(spark):
    import threading
    import time

    from pyspark.sql import functions as F

    from graphloom.streaming.cursor import run_as

    ended = []

    def work():
        try:
            with run_as(spark, "slow"):
                spark.range(0, 1 << 40, 1, 4).agg(F.sum(F.sqrt(F.col("id")))).collect()
            ended.append("done")
        except Exception:
            ended.append("cancelled")

    t = threading.Thread(target=work)
    t.start()
    until = time.time() + 30
    while not cancel(spark, "slow") and time.time() < until:
        time.sleep(0.3)
    t.join(60)
    assert ended == ["cancelled"]


def test_shared_folder_is_needed_on_a_cluster(spark):
    from graphloom import storage

    class Elsewhere:
        conf = type("", (), {"get": staticmethod(lambda key, default=None: {"spark.master": "spark://host:7077"}.get(key, default))})

    with pytest.raises(ValueError, match="share"):
        storage.shared_dir(Elsewhere)
    assert storage.shared_dir(spark)
