"""Expressions, streaks by days, cycles, rule files, trees, merges and language lookups on small tables."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import access, expressions, fixtures, graph, reports, stats, store
from loomgraph.sources import extract, languages, manifests

NODES = "id long, file_path string, package_name string, type_name string, method_name string, field_name string, node_type string, start_line int"


def nodes_of(spark, rows):
    return spark.createDataFrame([(i, f, p, t, m, "", "method" if m else "type", 1) for i, f, p, t, m in rows], NODES)


@pytest.fixture(scope="module")
def some(spark):
    return nodes_of(spark, [(1, "/w/a/x.go", "a", "UserService", "Get"), (2, "/w/a/x.go", "a", "UserService", ""), (3, "/w/b/c/y.go", "b", "User", "Put"), (4, "sql://db", "s", "t", "")])


@pytest.mark.parametrize(
    "text, want",
    [
        ("nodes.all(n, n.type_name.contains('User') || n.package_name == \"s\")", True), ("nodes.exists(n, n.method_name.startsWith('P') && n.type_name.endsWith('r'))", True),
        ("size(nodes) == 4 && nodes.size() > 3", True), ("size(nodes.filter(n, n.package_name == 'a'))", 2), ("nodes.filter(n, n.package_name == 'a').exists(n, n.method_name == 'Put')", False),
        ("nodes.exists_one(n, n.package_name + ':' + n.type_name == 'b:User')", True), ("nodes.all(n, size(n.package_name + n.method_name) > 1)", False), ("!nodes.exists(n, n.type_name.matches('^X'))", True),
        ("nodes.filter(n, n.id * 2 - 1 > 5).all(n, n.package_name in ['s'])", True), ("size(nodes) > 10 ? true : nodes.all(n, n.start_line <= 1.5)", True), ("nodes.filter(n, false).all(n, false)", True), ("true", True),
        ("nodes.all(n, n.method_name != null)", True), ("nodes.filter(n, n.id % 2 == 0).filter(n, n.id > 2).size()", 1), ("-1 < 0", True),
    ],
)
def test_expressions(some, text, want):
    assert expressions.evaluate(some, {"v": text}).first().v == want


def test_expressions_over_no_rows_and_by_group(some):
    none = expressions.evaluate(some.where("false"), {"a": "nodes.all(n, false)", "e": "nodes.exists(n, true)", "s": "size(nodes)"}).first()
    assert tuple(none) == (True, False, 0)
    by = expressions.evaluate(some, {"v": "nodes.exists(n, n.method_name == '')"}, ["package_name"])
    assert {tuple(r) for r in by.collect()} == {("a", True), ("b", False), ("s", True)}


@pytest.mark.parametrize("text", ["nodes.all(n, n.nothing == 1)", "nodes.all(n", "nodes", "nodes.all(n, n.id)", "x", "1 +", "nodes.map(n, n.id)", "size(1)", "'a'.all(n, true)", "1 # 2", "nodes.all(n, true) true"])
def test_expressions_that_are_wrong(some, text):
    with pytest.raises(expressions.ExpressionError):
        expressions.evaluate(some, {"v": text})


def test_streaks_and_adaptation_over_days(spark):
    """Random outcomes over several days against a fold run by run."""
    made, rows, want = random.Random(4), [], {}
    for tool in ("a", "b", "c"):
        at, factor, clean, dirty, streaks = datetime.datetime(2024, 1, 1), 1.0, 0, 0, []
        odds = {"a": 0.9, "b": 0.5, "c": 0.1}[tool]
        for _ in range(200):
            at += datetime.timedelta(minutes=made.choice((5, 90, 4000)))
            v = 0 if made.random() < odds else 2
            rows.append((tool, "/w", at, v, 10))
            clean, dirty = (clean + 1, 0) if v == 0 else (0, dirty + 1)
            factor = min(2.0, factor * 1.1) if clean >= 5 else max(0.5, factor * 0.9) if dirty >= 3 else factor
            if streaks and streaks[-1][0] == (v == 0):
                streaks[-1][1] += 1
            else:
                streaks.append([v == 0, 1])
        want[tool] = (round(factor, 9), clean, dirty, [(i + 1, *s) for i, s in enumerate(streaks)])
    runs = spark.createDataFrame(rows, "linter_name string, work_dir string, executed_at timestamp_ntz, violation_count int, duration_ms int").repartition(3)
    found = {r.linter_name: (round(r.factor, 9), r.clean, r.dirty) for r in stats.adaptation(runs).collect()}
    listed = {}
    for r in stats.streaks(runs).orderBy("island").collect():
        listed.setdefault(r.linter_name, []).append((r.island, r.clean, r.runs))
    assert {t: (*found[t], listed[t]) for t in want} == want


def test_cycles_against_a_search_of_paths(spark):
    made = random.Random(2)
    pairs = [(made.randrange(40), made.randrange(40)) for _ in range(60)]
    edges = spark.createDataFrame([(a, b, "call") for a, b in pairs] + [(3, None, "call"), (7, 7, "import")], "from_ast_id long, to_ast_id long, relationship_type string")
    after = {a: {b for x, b in pairs if x == a} for a, _ in pairs}
    for depth in (1, 3, 6):
        want = set()
        for s in after:
            level, reached = {s}, set()
            for _ in range(depth):
                level = {b for a in level for b in after.get(a, ())}
                reached |= level
            if s in reached:
                want.add(s)
        assert {r.id for r in graph.cycles(edges, depth).collect()} == want


def test_rule_files(spark):
    files = spark.createDataFrame([("/b/.RULES", "!x\n# no\n\n [*.go]  +fmt:Print*  # why\nos:!Exit"), ("/a/.RULES", "y/")], "file_path string, text string")
    got = {tuple(r) for r in access.parse_lines(files).collect()}
    assert got == {("/b", 1, "deny", "x", "", "", ""), ("/b", 4, "override", "", "fmt", "Print*", "*.go"), ("/b", 5, "deny", "", "os", "Exit", ""), ("/a", 1, "allow", "y/", "", "", "")}
    for line in ("!x", "[*.go] +fmt:Print*", "os:!Exit", "y/"):  # as the parser of single lines has it
        one = access.parse_line(line)
        row = access.parse_lines(spark.createDataFrame([("/f", line)], "file_path string, text string")).first()
        assert (row.type, row.pattern, row.package, row.method, row.file_pattern) == (one.type, one.pattern, one.package, one.method, one.file_pattern)
    configured = spark.createDataFrame([("**", 0, "deny", "a", "", ""), ("**", 1, "deny", "b", "", "")], "section string, seq int, type string, pattern string, package string, method string")
    merged = access.merge_rule_files(configured, files).orderBy("section", "seq").collect()
    assert [(r.section, r.seq, r.pattern or r.package) for r in merged] == [("**", 0, "a"), ("**", 1, "b"), ("**", 2, "y/"), ("**", 3, "x"), ("**", 4, "os"), ("*.go", 0, "fmt")]
    with pytest.raises(Exception, match="no ]"):
        access.parse_lines(spark.createDataFrame([("/f", "[x")], "file_path string, text string")).collect()


def test_rule_tables_of_any_size_fold_alike(spark, monkeypatch):
    subjects = spark.createDataFrame([("a/b",), ("a",), ("c",)], "package_name string")
    rules = access.rules_frame(spark, [access.AccessRule("deny", pattern="a"), access.AccessRule("allow", pattern="a/b"), access.AccessRule("deny", pattern="c"), access.AccessRule("override", pattern="a")])
    match = F.expr("package_name = pattern OR startswith(package_name, pattern || '/')")
    want = {("a/b", 3, "override"), ("a", 3, "override"), ("c", 2, "deny")}
    assert {tuple(r) for r in access.fold_table(subjects, rules, match, ["package_name"]).collect()} == want
    monkeypatch.setattr(access, "MOST_RULES", 1)
    assert {tuple(r) for r in access.fold_table(subjects, rules, match, ["package_name"]).collect()} == want


def test_display_tree(some):
    tree = lambda **shown: {(r.kind, r.key, r.parent, r.n) for r in reports.display_tree(some, "/w", **shown).collect()}
    whole = tree()
    assert whole >= {("folder", "a", None, 2), ("folder", "b", None, 1), ("folder", "b/c", "b", 1), ("file", "a/x.go", "a", 2), ("file", "b/c/y.go", "b/c", 1), ("package", "a/x.go#a", "a/x.go", 2), ("file", "sql://db", None, 1)}
    assert {r for r in whole if r[0] == "node"} == {("node", "1", "a/x.go#a", 1), ("node", "2", "a/x.go#a", 1), ("node", "3", "b/c/y.go#b", 1), ("node", "4", "sql://db", 1)} and len(whole) == 12
    assert tree(dirs=False, files=False, packages=False) == {("node", str(i), None, 1) for i in range(1, 5)}
    assert ("node", "3", "b/c", 1) in tree(files=False, packages=False)


def test_merged_files_keep_ids_and_drop_what_is_gone(spark):
    """Generation two keeps one node, drops one and adds one; another file's edges follow."""
    old = nodes_of(spark, [(1, "/w/a.go", "main", "", "main"), (2, "/w/a.go", "main", "T", ""), (3, "/w/b.go", "lib", "", "f")])
    new = nodes_of(spark, [(101, "/w/a.go", "main", "", "main"), (102, "/w/a.go", "main", "", "fresh")]).withColumn("start_line", F.lit(9))
    schema = "id long, from_ast_id long, to_ast_id long, line_no int"
    libraries = "id long, package string, class string, method string, field string"
    uses = "id long, ast_id long, library_id long"
    files = "file_path string, file_hash string"
    before = {
        "nodes": old, "edges": spark.createDataFrame([(1, 1, None, 3), (2, 3, 2, 4), (3, 3, 1, 5)], schema), "libraries": spark.createDataFrame([(7, "fmt", "", "Print", "")], libraries),
        "library_edges": spark.createDataFrame([(1, 1, 7), (2, 3, 7)], uses), "metadata": spark.createDataFrame([("/w/a.go", "x"), ("/w/b.go", "y")], files),
    }
    after = store.merge_file_results(before, {
        "nodes": new, "edges": spark.createDataFrame([(9, 101, 102, 1), (10, 102, 3, 2), (11, 101, None, 3)], schema), "libraries": spark.createDataFrame([(55, "fmt", "", "Print", ""), (56, "os", "", "Exit", "")], libraries),
        "library_edges": spark.createDataFrame([(8, 102, 55), (9, 101, 56)], uses), "metadata": spark.createDataFrame([("/w/a.go", "z"), ("/w/empty.go", "e")], files),
    })
    ids = {r.method_name or r.type_name: r.id for r in after["nodes"].collect()}
    assert ids["main"] == 1 and ids["f"] == 3 and set(ids) == {"main", "f", "fresh"} and after["nodes"].where("id = 1").first().start_line == 9
    fresh = ids["fresh"]
    assert {(r.from_ast_id, r.to_ast_id) for r in after["edges"].collect()} == {(1, fresh), (fresh, 3), (1, None), (3, 1)}
    names = {r.id: r.package for r in after["libraries"].collect()}
    assert sorted(names.values()) == ["fmt", "os"] and names[7] == "fmt"
    assert {(r.ast_id, names[r.library_id]) for r in after["library_edges"].collect()} == {(3, "fmt"), (fresh, "fmt"), (1, "os")}
    assert {tuple(r) for r in after["metadata"].collect()} == {("/w/a.go", "z"), ("/w/b.go", "y"), ("/w/empty.go", "e")}


def test_reports_as_lines(spark):
    rows = spark.createDataFrame([(1, "b", 2, "r", 'say "x"'), (2, "a", 1, "r", "<m>"), (3, "a", 1, "r", "<m>")], "id long, file_path string, line int, rule string, message string")
    import json

    lines = reports.json_lines(rows).orderBy("part", "id").collect()
    first = [r for r in lines if r.part == 1 and not r.line.startswith(",")]
    ordered = [lines[0], *first, *[r for r in lines if r.part == 1 and r not in first], lines[-1]]
    whole = json.loads("".join(r.line for r in ordered))
    assert whole["summary"] == {"total": 3} and {v["message"] for v in whole["violations"]} == {'say "x"', "<m>"} and len(whole["violations"]) == 3
    assert json.loads("".join(r.line for r in reports.json_lines(rows.where("false")).orderBy("part").collect())) == {"summary": {"total": 0}, "violations": []}
    assert "<td>&lt;m&gt;</td>" in reports.html_lines(rows).where("id = 2").first().line


def test_languages_and_broken_manifests(spark):
    paths = spark.createDataFrame([("a.cts",), ("b.HPP",), ("c",), ("d.unknown",)], "p string")
    assert [r.v for r in paths.select(languages.of_path(F.col("p")).alias("v")).collect()] == ["typescript", "cpp", None, None]
    assert len(languages.LANGUAGES) == 11 and languages.frame(spark).count() == len(languages.by_extension())
    broken = spark.createDataFrame([("package/pnpm-lock.yaml", "- 1\n- 2"), ("a/Chart.yaml", "dependencies: {a: [1"), ("b/pyproject.toml", "[project]\ndependencies = 3"), ("c/go.mod", "require a.b/c v1.0.0")], "file_path string, text string")
    assert [r.name for r in manifests.scan(broken).collect()] == ["a.b/c"]


def test_schema_objects_have_parents(spark):
    columns = spark.createDataFrame([("s", "t", "table", "c", "int")], "schema string, table string, kind string, column string, type string")
    nodes, _ = extract.sql_schema(spark, columns, columns.select("schema", "table", "column", F.col("table").alias("to_table"), F.col("column").alias("to_column")), spark.createDataFrame([("s", "e", "on")], "schema string, enum string, value string"), spark.createDataFrame([("s", "t", "i")], "schema string, table string, index string"), spark.createDataFrame([("s", "f")], "schema string, name string"))
    names = {r.id: r.type_name + r.method_name + r.field_name for r in nodes.collect()}
    assert {(names[r.id], names.get(r.parent_id)) for r in nodes.collect()} == {("t", None), ("tc", "t"), ("e", None), ("eon", "e"), ("ti", "t"), ("f", None)}


def test_fixtures(spark, some):
    text = "# A\ntext\n| Test Name | Query | Expected Count | CEL Validation | Else |\n|:-|-|-|-|-|\n| n | *User* | 3 | nodes.exists(n, n.id == 1 || n.id == 9) | x |\n| wrong | *User* | 4 | | |\n\n## B\n| Other | Name |\n|-|-|\n| 1 | 2 |\n| Query | Test Name |\n|-|-|\n| p | q |\n"
    found = fixtures.parse(text)
    assert [(f.category, f.name, f.query, f.count, f.check) for f in found] == [("A", "n", "*User*", 3, "nodes.exists(n, n.id == 1 || n.id == 9)"), ("A", "wrong", "*User*", 4, "")]
    edges = spark.createDataFrame([], "id long, from_ast_id long, to_ast_id long, relationship_type string")
    everything = [*found, fixtures.Fixture("all", "", "/w", None, "size(nodes) == 3", kind="expression")]
    assert [(r.name, r.found, r.passed) for r in fixtures.run(some, edges, everything).collect()] == [("n", 3, True), ("wrong", 3, False), ("all", 3, True)]
    assert fixtures.run(some, edges, []).count() == 0 and set(fixtures.by_category(found)) == {"A"}
    with pytest.raises(ValueError, match="already"):
        fixtures.register("query", fixtures.KINDS["query"])


def test_sample_of_types(some):
    kinds = some.withColumn("node_type", F.when(F.col("id") < 3, "a").otherwise("b"))
    assert {tuple(r) for r in reports.sample_types(kinds, 2).collect()} == {("a", 2), ("b", 1)}
    assert {tuple(r) for r in reports.sample_types(kinds, 3).collect()} == {("a", 2), ("b", 2)}
