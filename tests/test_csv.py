"""CSV import and export."""

import datetime as dt

import pytest

from graphloom.errors import GraphError
from graphloom.sources.csv_files import EdgeFile, NodeFile, export_edges, export_nodes, import_graph, load, save


def put(path, text):
    path.write_text(text)
    return str(path)


NODES = """id,labels,Name,age,birth_date,last_seen,avatar,mixed
 ada ,Person|User,Ada,36,1815-12-10,1852-11-27T01:02:03Z,0x00ff,1
bob,Person,NULL,null,,2020-01-01 00:00:00.5,,x
"""
EDGES = """src,dst,type,weight
ada,bob,KNOWS,1.5
bob,ada,LIKES,
ada,bob,KNOWS,2
"""


def test_import(spark, tmp_path):
    files = [NodeFile(put(tmp_path / "n.csv", NODES), label_column="LABELS", types={"name": "string"})]
    g, ids = import_graph(spark, files, [EdgeFile(put(tmp_path / "e.csv", EDGES), type_column="type")])
    key = {r.key: r.id for r in ids.collect()}
    assert set(g.nodes) == {"Person", "User"} and set(g.edges) == {"KNOWS", "LIKES"}
    rows = {r.id: r for r in g.label("Person").collect()}
    ada, bob = rows[key["ada"]], rows[key["bob"]]
    assert (ada.Name, ada.age, ada.birth_date, ada.last_seen, bytes(ada.avatar), ada.mixed) == ("Ada", 36, dt.date(1815, 12, 10), dt.datetime(1852, 11, 27, 1, 2, 3), b"\x00\xff", "1")
    assert (bob.Name, bob.age, bob.birth_date, bob.last_seen, bob.avatar) == ("NULL", None, None, dt.datetime(2020, 1, 1, 0, 0, 0, 500_000), None)
    assert sorted(r.weight for r in g.type("KNOWS").df.collect()) == [1.5, 2.0]
    assert g.label("User").count() == 1

    export_nodes(g, str(tmp_path / "out_n"))
    export_edges(g, str(tmp_path / "out_e"))
    again, _ = import_graph(
        spark,
        [NodeFile(str(tmp_path / "out_n"), label_column="labels", types={"birth_date": "date", "last_seen": "datetime", "Name": "string"})],
        [EdgeFile(str(tmp_path / "out_e"), type_column="type")],
    )
    same = lambda graph: sorted((r.Name, r.age, r.birth_date, r.last_seen, r.avatar and bytes(r.avatar), r.mixed) for r in graph.label("User").collect())
    assert same(again) == same(g)
    save(g, str(tmp_path / "store"))
    assert load(spark, str(tmp_path / "store"), ["User"], {"LIKES": (None, None)}).links().count() == 1


@pytest.mark.parametrize(
    ("nodes", "edges", "more", "code"),
    [
        ("id,labels\na,X\na,X\n", None, {}, "DuplicateId"),
        ("id,labels\n ,X\n", None, {}, "MissingId"),
        ("id,labels\na,\n", None, {}, "MissingLabel"),
        ("key,labels\na,X\n", None, {}, "ColumnNotFound"),
        ("id,labels,b\na,X,0xabc\n", None, {"types": {"b": "bytes"}}, "InvalidValue"),
        ("id,labels,b\na,X,1\n", None, {"types": {"b": "colour"}}, "UnknownType"),
        ("id,labels\na,X\n", "src,dst\na,b\n", {}, "UnknownEndpoint"),
    ],
)
def test_errors(spark, tmp_path, nodes, edges, more, code):
    files = [EdgeFile(put(tmp_path / "e.csv", edges), type="T")] if edges else []
    with pytest.raises(GraphError) as e:
        import_graph(spark, [NodeFile(put(tmp_path / "n.csv", nodes), label_column="labels", **more)], files)
    assert e.value.code == code


def test_edge_file_needs_a_type(spark, tmp_path):
    with pytest.raises(GraphError, match="MissingType"):
        import_graph(spark, [NodeFile(put(tmp_path / "n.csv", "id\na\n"), labels=["X"])], [EdgeFile(put(tmp_path / "e.csv", "src,dst\na,a\n"))])


def test_static_labels_and_chosen_columns(spark, tmp_path):
    g, _ = import_graph(spark, [NodeFile(put(tmp_path / "n.csv", "id,a,b,when\n1,2,3,5\n2,x,4,6\n"), labels=["N"], columns=["B", "when"], types={"when": "datetime"})], [])
    assert g.props("N") == ["b", "when"]
    assert sorted((r.b, r.when) for r in g.label("N").collect()) == [(3, dt.datetime(1970, 1, 1, 0, 0, 0, 5000)), (4, dt.datetime(1970, 1, 1, 0, 0, 0, 6000))]


def test_cells_with_line_breaks_and_many_labels(spark, tmp_path):
    text = 'id,labels,note\na,X,"one\ntwo"\n'
    g, _ = import_graph(spark, [NodeFile(put(tmp_path / "n.csv", text), label_column="labels", multiline=True)], [])
    assert [r.note for r in g.label("X").collect()] == ["one\ntwo"]
    many = "|".join(f"L{i}" for i in range(256))
    with pytest.raises(GraphError, match="TooManyLabels"):
        import_graph(spark, [NodeFile(put(tmp_path / "m.csv", f"id,labels\na,{many}\n"), label_column="labels")], [])


def test_ids_are_consecutive(spark, tmp_path):
    folder = tmp_path / "n"
    folder.mkdir()
    for k in range(5):
        put(folder / f"{k}.csv", "id,labels\n" + "".join(f"{k}-{i},X\n" for i in range(k * 7)))
    g, ids = import_graph(spark, [NodeFile(str(folder), label_column="labels")], [EdgeFile(put(tmp_path / "e.csv", "src,dst\n4-1,3-2\n4-1,4-1\n"), type="T")])
    assert sorted(r.id for r in g.label("X").collect()) == list(range(1, 71)) and ids.count() == 70
    assert sorted(r.edge_id for r in g.type("T").df.collect()) == [1, 2]
