"""Edges from source, resolved and queried; a small Go project as rows."""

import pytest

from loomgraph.functions.nodes import stable_id
from loomgraph.functions.patterns import parse_pattern, query_predicate
from loomgraph.operators import access, graph, metric_query, rule_engine
from loomgraph.sources import edges, extract

SERVICE = """package service

import (
\t"database/sql" // should be the repository's
\t"fmt"
\tlogger "log"
\t"net/http"
)

type OrderService struct {
\tdb *sql.DB
}

func Connect() *OrderService { return &OrderService{} }

func (s *OrderService) FindOrder(id string) (*Order, error) {
\trow := s.handle.QueryRow("SELECT f(x) FROM t", id)
\t_ = row // fmt.Sprint(row)
\tfmt.Printf("order %s", id)
\tif reply, err := http.Get("/" + string(id)); err != nil {
\t\tdefer func() { _ = reply.Body.Close() }()
\t}
\tConnect().DraftOrder()
\treturn &Order{}, nil
}

func (s *OrderService) RecountOrders() { missing(1) }

func (s *OrderService) DraftOrder() *Order {
\tConnect()
\treturn nil
}

type Order struct {
\tID   string
\tName string
}
"""
REPOSITORY = """package repository

import "database/sql"

type OrderArchive struct {
\tdb *sql.DB
}

func OpenArchive(db *sql.DB) *OrderArchive { return nil }

func (r *OrderArchive) Lookup(id string) (*Order, error) { return nil, nil }

func (r *OrderArchive) Create(user *Order) error { return nil }

type Order struct {
\tID, Name string
}
"""
REST = {
    "cmd/main.go": 'package main\n\nimport "example.com/shop/internal/config"\n\nfunc main() {\n\t_ = config.Read()\n}\n',
    "internal/config/config.go": "package config\n\ntype Settings struct {\n\tAddress string\n\tSecret      string\n}\n\nfunc Read() *Settings { return nil }\n",
    "pkg/api/server.go": "package api\n\ntype Gateway struct {\n\t// nothing yet\n}\n\nfunc Listen() *Gateway { return nil }\n\nfunc (s *Gateway) Start() {\n\ts.wire()\n}\n\nfunc (s *Gateway) wire() {}\n",
    "test/order_test.go": 'package test\n\nimport "testing"\n\nfunc TestConnect(t *testing.T) {}\n\nfunc TestDraft(t *testing.T) {}\n\nfunc MockOrderArchive() *FakeStore { return nil }\n\ntype FakeStore struct{}\n\nfunc (m *FakeStore) Reset() {}\n',
}
PROJECT = {"pkg/service/order_service.go": SERVICE, "pkg/repository/order_archive.go": REPOSITORY, **REST}


def read(spark, texts, language):
    rows = spark.createDataFrame([(p, language, t) for p, t in texts.items()], "file_path string, language string, text string")
    nodes = extract.extract(rows).withColumn("id", stable_id())
    return nodes, edges.find(rows)


@pytest.fixture(scope="module")
def project(spark):
    nodes, found = read(spark, PROJECT, "go")
    nodes = nodes.cache()
    return nodes, found.cache(), *edges.resolve(nodes, found)


def test_nodes_of_the_project(project):
    nodes = project[0]
    assert nodes.count() == 31
    for pattern, n in (("*Service*", 5), ("*:*:*", 31), ("*:*:FindOrder", 1), ("service:*Service:*", 5), ("*Order*", 15)):
        assert nodes.where(query_predicate(parse_pattern(pattern))).count() == n, pattern
    for query, n in (("cyclomatic(*) > 5", 0), ("cyclomatic(*) <= 2", 31), ("lines(*) > 100", 0), ("lines(*) < 50", 31), ("params(*) > 3", 0), ("params(*) == 1", 6)):
        assert metric_query.run(nodes, project[2].withColumn("id", stable_free()), query).count() == n, query


def stable_free():
    from pyspark.sql import functions as F

    return F.monotonically_increasing_id()


def test_go_edges_of_the_project(project):
    nodes, found, calls, libraries = project
    got = {(r.caller, r.called, r.line_no, r.text) for r in found.where("file_path like '%order_service.go'").collect()}
    full = "service.OrderService."
    assert got == {
        (full + "FindOrder", None, 17, "call@17:9"), (full + "FindOrder", None, 19, "fmt.Printf() (pkg=fmt;class=;method=Printf;framework=stdlib)"),
        (full + "FindOrder", None, 20, "http.Get() (pkg=net/http;class=;method=Get;framework=third-party)"), (full + "FindOrder", "service.string", 20, "string()"),
        (full + "FindOrder", None, 21, "call@21:9"), (full + "FindOrder", None, 21, "call@21:22"), (full + "FindOrder", None, 23, "call@23:2"), (full + "FindOrder", "service.Connect", 23, "Connect()"),
        (full + "RecountOrders", "service.missing", 27, "missing()"), (full + "DraftOrder", "service.Connect", 30, "Connect()"),
    }
    names = {r.id: ".".join(x for x in (r.package_name, r.type_name, r.method_name) if x) for r in nodes.collect()}
    assert {(names[r.from_ast_id], names[r.to_ast_id]) for r in calls.where("to_ast_id is not null").collect()} == {(full + "FindOrder", "service.Connect"), (full + "DraftOrder", "service.Connect")}
    assert calls.where("from_ast_id is null").count() == 0 and libraries.where("ast_id is null").count() == 0
    assert {(names[r.ast_id], r.package, r.method, r.framework) for r in libraries.collect()} == {(full + "FindOrder", "fmt", "Printf", "stdlib"), (full + "FindOrder", "net/http", "Get", "third-party"), ("main.main", "example.com/shop/internal/config", "Read", "third-party")}


def test_rules_and_graphs_over_real_source(project):
    nodes, _, calls, _ = project
    calls = calls.withColumn("id", stable_free())
    assert rule_engine.violations(nodes, calls, 'RULE "r" { FORBID(*OrderService* -> service:*:Connect) REQUIRE(*Gateway* -> *) }').count() == 2 + 3
    assert access.call_violations(nodes, calls, [access.parse_line("service:!Connect")]).count() == 2
    assert graph.induced(calls, nodes).count() == 2


def test_java_edges(spark):
    texts = {
        "a/Dog.java": 'package zoo;\nimport java.util.List;\nimport static org.acme.Tools.run;\npublic class Dog extends Animal<Bone> implements Pet, Comparable<Dog> {\n  public int speak(int n) {\n    log("f(x)"); // g()\n    if (n > 1) { return helper(n).size(); }\n    return new Bark().sound(n);\n  }\n  private List<X> helper(int n) { return run(n); }\n}\n',
        "a/Animal.java": "package zoo;\nclass Animal<T> {\n  void log(String s) {}\n}\n",
    }
    nodes, found = read(spark, texts, "java")
    got = {(r.caller, r.called, r.line_no, r.relationship_type) for r in found.where("package is null").collect()}
    assert got == {("zoo.Dog", "Animal", 4, "extends"), ("zoo.Dog", "Pet", 4, "implements"), ("zoo.Dog", "Comparable", 4, "implements"), *[("zoo.Dog.speak", c, n, "call") for c, n in (("log", 6), ("helper", 7), ("size", 7), ("sound", 8))], ("zoo.Dog.helper", "run", 10, "call")}
    assert {(r.package, r.framework, r.line_no) for r in found.where("package is not null").collect()} == {("java.util.List", "stdlib", 2), ("org.acme.Tools.run", "third-party", 3)}
    own, _ = edges.resolve(nodes, found)
    names = {r.id: r.type_name + "." + r.method_name for r in nodes.collect()}
    assert {(names.get(r.from_ast_id), names[r.to_ast_id]) for r in own.where("to_ast_id is not null").collect()} == {("Dog.", "Animal."), ("Dog.speak", "Animal.log"), ("Dog.speak", "Dog.helper")}


@pytest.mark.parametrize("language, ending", [("javascript", "js"), ("typescript", "ts")])
def test_script_edges(spark, language, ending):
    text = "import fs from 'node:fs';\nimport {x} from './x';\nconst y = require(\"left-pad\");\nclass A extends Base {\n  run(a) {\n    this.stop(a);\n    return helper(a) + lib.deep.f('g(1)'); // h()\n  }\n  stop(b) {\n    return new Thing(b);\n  }\n}\nfunction helper(x) {\n  if (x) { return parse(x); }\n}\n"
    nodes, found = read(spark, {f"src/a.{ending}": text}, language)
    got = {(r.caller, r.called, r.line_no, r.relationship_type, r.text) for r in found.where("package is null").collect()}
    assert got == {("src.A", "Base", 4, "extends", "extends Base"), ("src.A.run", "src.A.stop", 6, "call", "calls this.stop"), ("src.A.run", "helper", 7, "call", "calls helper"), ("src.A.run", "lib.deep.f", 7, "call", "calls lib.deep.f"), ("src.helper", "parse", 14, "call", "calls parse")}
    assert {(r.package, r.framework, r.line_no) for r in found.where("package is not null").collect()} == {("node:fs", "stdlib", 1), ("./x", "relative", 2), ("left-pad", "third-party", 3)}
    own, _ = edges.resolve(nodes, found)
    names = {r.id: r.type_name + "." + r.method_name for r in nodes.collect()}
    assert {(names.get(r.from_ast_id), names[r.to_ast_id]) for r in own.where("to_ast_id is not null").collect()} == {("A.run", "A.stop"), ("A.run", ".helper")}


def test_python_edges_and_files_that_fail(spark):
    text = "import os, numpy as np\nfrom .near import far\nclass A(Base, mod.Other):\n    def run(self):\n        self.stop()\n        return [help_(x) for x in os.listdir('.')]\n    def stop(self):\n        pass\ndef help_(x):\n    return (lambda y: np.sum(y))(x)\n"
    nodes, found = read(spark, {"src/pkg/a.py": text, "bad.py": "def (", "deep.py": "(" * 3000 + ")" * 3000, "none.py": ""}, "python")
    got = {(r.caller, r.called, r.line_no, r.relationship_type) for r in found.where("package is null").collect()}
    assert got == {("pkg.A", "Base", 3, "inheritance"), ("pkg.A", "mod.Other", 3, "inheritance"), ("pkg.A.run", "pkg.A.stop", 5, "call"), ("pkg.A.run", "help_", 6, "call"), ("pkg.A.run", "os.listdir", 6, "call"), ("pkg.help_", "np.sum", 10, "call")}
    assert {(r.package, r.framework, r.text) for r in found.where("package is not null").collect()} == {("os", "stdlib", "import os (module=os;alias=;framework=python)"), ("numpy", "third-party", "import numpy (module=numpy;alias=np;framework=python)"), (".near", "relative", "import .near (module=.near;alias=;framework=python)")}
    assert {r.file_path for r in nodes.select("file_path").distinct().collect()} == {"src/pkg/a.py"}


def test_go_declarations(spark):
    text = "package p\n\nvar (\n\tone, two = 1, 2\n\t_ = f(3)\n)\n\nconst Three = 3\n\ntype (\n\tID int\n\tBox struct {\n\t\tBase\n\t\tn int\n\t}\n)\n\ntype Fn func(a int) error\n\nfunc f(a, b int) {\n\tvar local int\n\tx := map[string]int{}\n}\n"
    nodes, _ = read(spark, {"p.go": text}, "go")
    assert sorted((r.node_type, r.type_name, r.method_name + r.field_name) for r in nodes.collect()) == [("field", "Box", "n"), ("method", "", "f"), ("type", "Box", ""), ("type", "Fn", ""), ("type", "ID", ""), ("variable", "", "Three"), ("variable", "", "one"), ("variable", "", "two")]
