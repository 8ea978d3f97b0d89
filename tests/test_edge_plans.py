"""Resolution of edges: names by their endings, and how often the sources are read."""

import __spark_entry__
import pytest

from loomgraph.operators import lookup
from loomgraph.sources import edges

NODES = "id long, file_path string, package_name string, type_name string, method_name string, field_name string"


@pytest.mark.parametrize("name", ["s12_go_edges", "s13_python_edges", "s14_java_edges", "s15_javascript_edges"])
def test_files_are_parsed_thrice_by_more_than_the_scan(spark, name):
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3
    assert plan.count("RepartitionByExpression") == 3


def test_odd_names(spark):
    nodes = spark.createDataFrame([(5, "/a", "p..q", "A", "", ""), (6, "/a", "", "", "B.", ""), (7, "/b", "p", "B", "", "x"), (3, None, "q", "A", "", ""), (2, "/c", "", "", "", "")], NODES)
    want = {"A": 3, ".q.A": 5, "q.A": 3, "p..q.A": 5, ".A": None, "": None, None: None, "B.": 6, "B.x": 7, ".x": None, "B": None, "p..q": None}
    asked = spark.createDataFrame([(n,) for n in want] * 2, "called string")
    got = [(r.called, r.node_id) for r in lookup.resolve_by_name(asked, nodes).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [*want.items()] * 2))


def test_nameless_edges_are_spread(spark):
    nodes = spark.createDataFrame([(5, "/a", "p", "A", "run", ""), (4, "/b", "p", "A", "run", "")], NODES)
    found = spark.createDataFrame([("/a", "p.A.run", None, i, "call", "") for i in range(400)] + [("/a", "p.A.run", "A.run", 400, "call", ""), ("/c", "p.A.run", "run", 401, "call", "")], "file_path string, caller string, called string, line_no int, relationship_type string, text string")
    found = found.selectExpr("*", *[f"IF(line_no % 2 = 1, 'os', NULL) AS {c}" for c in ("package", "class", "method", "framework")])
    own, libraries = edges.resolve(nodes, found)
    assert [(r.from_ast_id, r.to_ast_id) for r in own.where("line_no = 400").collect()] == [(5, 4)] and own.where("to_ast_id IS NOT NULL").count() == 1
    assert own.count() == 201 and libraries.count() == 201 and libraries.where("ast_id IS NULL AND line_no <> 401").count() == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = edges.place(nodes, found).rdd.glom().map(len).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(parts) == 402 and max(parts) < 200
