"""One plan for a rule set, however many statements it has."""

import re

from loomgraph.operators import rule_engine

NODES = "id long, file_path string, package_name string, type_name string, method_name string, field_name string, node_type string, language string, start_line int, cyclomatic_complexity int, parameter_count int, return_count int, line_count int"


def tables(spark):
    rows = [(i, f"/w/{'ab'[i % 2]}/f{i % 5}.go", f"p{i % 3}", ("XController", "YService", "ZRepository")[i % 3] + str(i % 4), f"M{i % 6}", "", "method", "go", i, i % 30, i % 5, 1, i % 60) for i in range(60)]
    edges = [(i, i * 7 % 60, i * 11 % 60 if i % 9 else None, i, "call" if i % 4 else "import") for i in range(200)]
    return spark.createDataFrame(rows, NODES), spark.createDataFrame(edges, "id long, from_ast_id long, to_ast_id long, line_no int, relationship_type string")


STATEMENTS = ("LIMIT(*Controller*.cyclomatic > {0})", "FORBID(*Controller{1}* -> *Repository*)", "REQUIRE(*Service{1}* -> *Repository{2}*)", "FORBID(*Service{1})", "REQUIRE(*Gateway{0}*)", "ALLOW(*)")


def test_a_hundred_rules_make_one_plan(spark):
    nodes, edges = tables(spark)
    text = "\n".join('RULE "r%d" { %s }' % (i, " ".join(STATEMENTS[(i + k) % 6].format(i % 25, i % 4, i % 3) for k in range(3))) for i in range(100))
    got = rule_engine.violations(nodes, edges, text)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bJoin\b", plan)) == 4 and len(re.findall(r"LogicalRDD", plan)) <= 8
    rows = got.collect()
    for i, line in list(enumerate(text.split("\n")))[:6]:  # a rule by itself gives the same
        assert sorted(tuple(r)[1:] for r in rows if r.rule_seq == i) == sorted(tuple(r)[1:] for r in rule_engine.violations(nodes, edges, line).collect())
    assert len(rows) > 300


def test_configured_texts_make_one_plan(spark):
    nodes, edges = tables(spark)
    texts = ['RULE "a" { FORBID(*Service* -> *Repository*) }', 'RULE "b" { LIMIT(*.lines > x) }', 'RULE "c" { REQUIRE(*Service* -> *Repository*) FORBID(*Service* -> *Controller*) }', 'RULE "d" { LIMIT(*.params > 3) }']
    got = rule_engine.run_configured(nodes, edges, texts)
    assert len(re.findall(r"\bJoin\b", got._jdf.queryExecution().optimizedPlan().toString())) == 4
    assert got.where("message like 'rule error%'").count() == 1 and {r.rule for r in got.select("rule").distinct().collect()} >= {"a", "c", "d", ""}


def test_no_rules(spark):
    nodes, edges = tables(spark)
    assert rule_engine.violations(nodes, edges, 'RULE "r" { ALLOW(*) }').count() == 0
    assert rule_engine.violations(nodes.where("false"), edges, 'RULE "r" { REQUIRE(*X*) FORBID(*) REQUIRE(* -> *) }').count() == 1
