"""Resolution of called names, and library edges in renderings and stores."""

from loomgraph.operators import graph, lookup, store

NODES = "id long, file_path string, package_name string, type_name string, method_name string, field_name string"
LIBRARIES = "id long, package string, class string, method string, field string"
USES = "id long, ast_id long, library_id long"


def test_names_resolve_in_full_else_by_suffix(spark):
    nodes = spark.createDataFrame([(9, "/a", "p", "A", "run", ""), (4, "/b", "p", "A", "run", ""), (2, "/c", "q.r", "B", "run", ""), (7, "/d", "", "", "run", ""), (8, "/e", "p", "", "", ""), (1, "/f", "p", "Xrun", "", ""), (3, "/g", "", "", "", "")], NODES)
    want = {"p.A.run": 4, "A.run": 4, "run": 7, "B.run": 2, "r.B.run": 2, "Xrun": 1, "un": None, "C.run": None, "": None, None: None, "p": 8, "B": None}
    asked = spark.createDataFrame([(i, n) for i, n in enumerate([*want, "run"])], "id long, called string")
    got = [(r.called, r.node_id) for r in lookup.resolve_by_name(asked, nodes).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [*want.items(), ("run", 7)]))


def test_dot_has_each_library_once(spark):
    nodes = spark.createDataFrame([(1, "/a", "p", "A", "f", ""), (2, "/a", "p", "A", "g", "")], NODES)
    edges = spark.createDataFrame([(1, 1, 2, "call")], "id long, from_ast_id long, to_ast_id long, relationship_type string")
    libraries = spark.createDataFrame([(5, "fmt", "", "Print", ""), (6, "fmt", "", "Print", ""), (7, 'a"b', "C", "m", "x"), (8, "os", "", "", "")], LIBRARIES)
    uses = spark.createDataFrame([(1, 1, 6), (2, 2, 5), (3, 2, 7), (4, 3, 8), (5, 1, 99), (6, 1, 6)], USES)
    got = sorted((r.part, r.id, r.line.strip()) for r in graph.dot_lines(nodes, edges, uses, libraries).where("part > 1").collect())
    style = 'style="filled,rounded", fillcolor=lightblue];'
    assert got == [
        (2, 5, f'"lib_fmt.Print" [label="fmt.Print", {style}'), (2, 7, f'"lib_a"b.C.m.x" [label="a\\"b.C.m.x", {style}'),
        (3, 1, 'n1 -> "lib_fmt.Print";'), (3, 2, 'n2 -> "lib_fmt.Print";'), (3, 3, 'n2 -> "lib_a"b.C.m.x";'), (3, 6, 'n1 -> "lib_fmt.Print";'),
    ]


def test_delete_takes_library_edges_along(spark):
    nodes = spark.createDataFrame([(1, "/a", "p", "A", "f", ""), (2, "/b", "p", "A", "g", ""), (3, None, "p", "", "", "")], NODES)
    edges = spark.createDataFrame([(1, 1, 2), (2, 2, 2), (3, 2, None), (4, 2, 1)], "id long, from_ast_id long, to_ast_id long")
    uses = spark.createDataFrame([(1, 1, 6), (2, 2, 5), (3, 3, 5), (4, 1, 5)], USES)
    left = store.delete_file(nodes, edges, "/a", uses)
    assert [sorted(r.id for r in d.collect()) for d in left] == [[2, 3], [2, 3], [2, 3]]


def test_merge_of_libraries(spark):
    before = spark.createDataFrame([(1, "/a", "p", "A", "f", ""), (2, "/a", "p", "A", "g", ""), (3, "/b", "p", "B", "h", "")], NODES)
    after = before.where("id <> 2")
    libraries = spark.createDataFrame([(5, "fmt", "", "Print", ""), (6, "fmt", "", "Print", ""), (7, "os", "", "Exit", "")], LIBRARIES)
    uses = spark.createDataFrame([(1, 1, 7), (2, 2, 6), (3, 3, 7)], USES)
    new_libraries = spark.createDataFrame([(5, "io", "", "Copy", ""), (8, "fmt", "", "Print", ""), (9, "io", "", "Copy", "")], LIBRARIES)
    new_uses = spark.createDataFrame([(11, 1, 5), (12, 1, 8), (13, 2, 8), (14, 1, 9)], USES)
    nodes, edges = store.merge_libraries(libraries, uses, new_libraries, new_uses, before, after, before.where("file_path = '/a'"))
    ids = {(r.package, r.id) for r in nodes.collect()}
    made = next(i for p, i in ids if p == "io")
    assert ids == {("fmt", 5), ("fmt", 6), ("os", 7), ("io", made)} and made not in (5, 6, 7, 9) and nodes.count() == 4
    assert {(r.id, r.ast_id, r.library_id) for r in edges.collect()} == {(3, 3, 7), (11, 1, made), (12, 1, 5), (14, 1, made)} and edges.count() == 4
