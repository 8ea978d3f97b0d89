"""Patterns, matchers, the rule language and its engine on the five-node fixture."""

import re

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import patterns as P
from loomgraph.operators import metric_query, rule_engine
from loomgraph.operators.rules_lang import RuleError, load_rules, load_yaml, parse_rules, to_yaml

NODE = "id long, file_path string, package_name string, type_name string, method_name string, field_name string, node_type string, language string, start_line int, end_line int, cyclomatic_complexity int, parameter_count int, return_count int, line_count int"
EDGE = "id long, from_ast_id long, to_ast_id long, line_no int, relationship_type string"


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [
        (1, "/test/SimpleController.go", "controller", "SimpleController", "GetUser", "", "method", "go", 10, 15, 2, 1, 1, 6),
        (2, "/test/ComplexController.go", "controller", "ComplexController", "ProcessOrder", "", "method", "go", 20, 80, 25, 3, 1, 61),
        (3, "/test/UserService.go", "service", "UserService", "CreateUser", "", "method", "go", 5, 20, 5, 2, 1, 16),
        (4, "/test/UserRepository.go", "repository", "UserRepository", "Save", "", "method", "go", 8, 12, 1, 1, 1, 5),
        (5, "/test/User.go", "model", "User", "", "", "type", "go", 1, 10, 0, 0, 0, 10),
    ]
    return spark.createDataFrame(rows, NODE)


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(1, 1, 3, 12, "call"), (2, 2, 3, 45, "call"), (3, 3, 4, 18, "call")], EDGE)


@pytest.mark.parametrize(
    ("statement", "count"),
    [
        ("LIMIT(*.cyclomatic > 10)", 1), ("LIMIT(*.cyclomatic < 5)", 3), ("LIMIT(*Controller*.cyclomatic > 5)", 1), ("LIMIT(*Service*.cyclomatic >= 5)", 1), ("LIMIT(*.params > 2)", 1),
        ("FORBID(*Controller* -> *Repository*)", 0), ("FORBID(*Service* -> *Controller*)", 0), ("FORBID(*model* -> *)", 0), ("REQUIRE(*Controller* -> *Service*)", 0), ("REQUIRE(*Service* -> *Repository*)", 0),
        ("REQUIRE(*Controller* -> *model*)", 2), ("FORBID(*Controller* -> *Service*)", 2), ("REQUIRE(Missing*)", 1), ("FORBID(User)", 1), ("FORBID(*simplecontroller*)", 1), ("LIMIT(*simplecontroller*.cyclomatic > 0)", 0),
        ("ALLOW(*)", 0), ("LIMIT(controller.*.cyclomatic >= 0)", 2), ("LIMIT(*.UserService.cyclomatic >= 0)", 1), ("LIMIT(*.UserService:CreateUser.cyclomatic >= 0)", 1), ("FORBID(*_epository*)", 1),
    ],
)
def test_fixture_counts(nodes, edges, statement, count):
    assert rule_engine.violations(nodes, edges, f'RULE "r" {{ {statement} }}').count() == count


def test_messages_and_lines(nodes, edges):
    found = rule_engine.violations(nodes, edges, 'RULE "r" { FORBID(*Controller* -> *Service*) REQUIRE(Missing*) REQUIRE(*Controller* -> *model*) }').collect()
    assert sorted(r.line for r in found if "Forbidden call" in r.message) == [12, 45]
    assert [(r.file_path, r.line) for r in found if "not found in codebase" in r.message] == [("", 0)]
    assert sum("Required relationship from" in r.message for r in found) == 2


def test_rule_set_errors(nodes, edges):
    assert rule_engine.violations(nodes, edges, parse_rules("")).count() == 0
    for bad in (None, 'RULE "r" { LIMIT(*.cyclomatic > "x") }'):
        with pytest.raises(RuleError):
            rule_engine.violations(nodes, edges, bad)
    rows = rule_engine.run_configured(nodes, edges, ['RULE "r" { LIMIT(*.cyclomatic > 10) }', "RULE bad"]).collect()
    assert [r.line for r in rows] == [20, 1]


@pytest.mark.parametrize("text", ['RULE { }', 'RULE "r" LIMIT(*.lines > 1)', 'RULE "r" { LIMIT(*) }', 'RULE "r" { LIMIT(*.lines 1) }', 'RULE "r" { LIMIT(*.lines >) }', 'RULE "r" { WHAT(*) }', 'RULE "r" { FORBID(a ->) }', 'RULE "r" { FORBID(a b) }', 'RULE "r" { FORBID(@x) }'])
def test_malformed_rules(text):
    with pytest.raises(RuleError):
        parse_rules(text)


def test_grammar():
    many = "".join(f'RULE "r{i}" {{ LIMIT(*.cyclomatic > {i}) FORBID(a -> b) REQUIRE(C*) }}\n' for i in range(100))
    assert [len(r.statements) for r in parse_rules(many).rules] == [3] * 100
    text = '// comment\nrule "r" { /* c */ limit(*.lines != 10) }'
    rules = load_rules(text)
    assert rules.rules[0].statements[0].condition.value == 10.0
    again = load_rules(to_yaml(parse_rules(many)))
    assert [(s.kind, s.condition and (s.condition.metric, s.condition.op, s.condition.value)) for r in again.rules for s in r.statements] == [(s.kind, s.condition and (s.condition.metric, s.condition.op, s.condition.value)) for r in parse_rules(many).rules for s in r.statements]
    for op in (">", ">=", "<", "<=", "==", "!="):
        assert parse_rules(f'RULE "r" {{ LIMIT(*.params {op} 2.5) }}').rules[0].statements[0].condition.op == op


@pytest.mark.parametrize("text", ["rules: []", "rules: [{statements: [{type: ALLOW, pattern: a}]}]", "rules: [{name: r}]", "rules: [{name: r, statements: [{type: LIMIT}]}]", "rules: [{name: r, statements: [{type: LIMIT, condition: {pattern: '*.lines', operator: '~', value: 1}}]}]", "rules: [{name: r, statements: [{type: LIMIT, condition: {pattern: '*.lines', operator: '>'}}]}]"])
def test_yaml_validation(text):
    with pytest.raises(RuleError):
        load_yaml(text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("*", {"package": "*"}), ("a/b", {"package": "a/b"}), ("Service*", {"type": "Service*"}), ("User", {"type": "User"}), ("user", {"package": "user"}), ("p:T:m:f", {"package": "p", "type": "T", "method": "m", "field": "f"}),
        ("p.T:m:f", {"package": "p", "type": "T", "method": "m:f"}), ("a.b.c:m", {"package": "a.b.c", "type": "m"}), ("x.*", {"package": "x", "type": "*"}), ("*.x", {"package": "*", "type": "x"}), ("go:p:T", {"language": "go", "package": "p", "type": "T"}),
        ("@src/**/*.go", {"file_path": "src/**/*.go", "package": "*"}), ("@src/**/*.go:Service*", {"file_path": "src/**/*.go", "type": "Service*"}), ("path(internal/**/*.go)", {"file_path": "internal/**/*.go", "package": "*"}),
        ("path(src/**/*.go) AND Service*", {"file_path": "src/**/*.go", "type": "Service*"}), ("@c/**/*.go:api:UserService:GetUser", {"file_path": "c/**/*.go", "package": "api", "type": "UserService", "method": "GetUser"}),
        ("@src/*.go:Service*.cyclomatic", {"file_path": "src/*.go", "type": "Service*", "metric": "cyclomatic"}),
    ],
)
def test_pattern_grammar(text, want):
    p = P.parse_pattern(text)
    assert {k: v for k, v in vars(p).items() if v and k != "text"} == want


@pytest.mark.parametrize("text", ["path(missing", "path(x) INVALID y", "a:b:c:d:e"])
def test_pattern_errors(text):
    with pytest.raises(ValueError, match="path|parts"):
        P.parse_pattern(text)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("glob", "path", "want"),
    [
        ("**/controllers/*.go", "/project/src/controllers/a.go", True), ("**/file.go", "/x/y/file.go", True), ("**/*.go", "/x/a.py", False), ("src/**/*.go", "/project/src/a/b.go", False), ("user.go", "/x/user.go", True),
        ("internal/**/*_service.go", "/project/internal/user_service.go", False), ("**/*.{js,ts}", "/x/a.ts", True), ("a?c[0-9].go", "/x/abc7.go", True), ("a[!0-9].go", "/x/a1.go", False),
    ],
)
def test_file_globs(spark, glob, path, want):
    assert one(spark, P.file_glob(F.lit(path), glob)) is want


@pytest.mark.parametrize(
    ("include", "exclude", "path", "want"),
    [(["*.go"], [], "/project/src/main.go", True), ([], ["*_test.go"], "/project/a_test.go", False), ([], ["vendor/**"], "/project/vendor/x/a.go", False), (["src/**/*.go"], [], "/project/src/main.go", True), (["main.go"], [], "/project/cmd/main.go", True), (["*.go"], ["main.go"], "/project/main.go", False)],
)
def test_include_exclude(spark, include, exclude, path, want):
    assert one(spark, P.include_exclude(F.lit(path), include, exclude, "/project")) is want


def test_wildcards_against_a_model(spark):
    texts = ["User", "UserService", "userservice", "aUserb", "", "User*", "x_y"]
    patterns = ["*", "User*", "*Service", "*User*", "U*r", "User", "*ser_ervice", "**"]

    def m1(p, s):
        if p in ("", "*"):
            return True
        return re.fullmatch("".join(".*" if c == "*" else "." if c == "_" else re.escape(c) for c in p), s, re.I) is not None if "*" in p else s == p

    def m2(p, s):
        if p in ("", "*"):
            return True
        if len(p) > 1 and p[0] == p[-1] == "*":
            return p[1:-1] in s
        return s.endswith(p[1:]) if p[0] == "*" else s.startswith(p[:-1]) if p[-1] == "*" else s == p

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    always = lambda c: F.lit(True) if c is None else c
    row = df.select("t", *[always(P.sql_like(F.col("t"), p)).alias(f"a{i}") for i, p in enumerate(patterns)], *[P.wildcard(F.col("t"), p).alias(f"b{i}") for i, p in enumerate(patterns)]).collect()
    for r in row:
        for i, p in enumerate(patterns):
            assert r[f"a{i}"] == m1(p, r.t), (p, r.t)
            assert r[f"b{i}"] == m2(p, r.t), (p, r.t)


def test_metric_queries(spark):
    nodes = spark.createDataFrame([(1, "/test/file1.go", "controllers", "UserController", "GetUser", "", "method", "go", 1, 9, 1, 0, 0, 9), (2, "/test/file2.go", "services", "UserService", "FindUser", "", "method", "go", 1, 60, 1, 0, 0, 60), (3, "/test/file1.go", "controllers", "UserController", "Other", "", "method", "go", 1, 2, 1, 0, 0, 2)], NODE)
    rows = [(1, 1, None, 10, "import"), (2, 1, None, 11, "import"), (3, 1, None, 12, "import"), (4, 1, 2, 20, "call"), (5, 1, None, 21, "call"), (6, 1, 3, 22, "call"), (7, 1, 999, 23, "call")]
    edges = spark.createDataFrame(rows, EDGE)
    run = lambda q: sorted(r.id for r in metric_query.run(nodes, edges, q).collect())
    assert run("calls(*) >= 2") == [1] and run("calls(*) > 2") == [] and run("imports(*) > 2") == [1] and run("imports(*) == 0") == [2, 3]
    assert run("lines() > 50") == run("lines(*) > 50") == run("*.lines > 50") == [2] and run("*Service*") == [2]
    for bad, message in (("unknown(*) > 10", "unknown metric"), ("lines(*) > abc", "invalid numeric value"), ("lines * > 100", "invalid metric query format"), ("lines(*) > 1 && params(*) > 1", "invalid")):
        with pytest.raises(ValueError, match=message):
            metric_query.run(nodes, edges, bad)
