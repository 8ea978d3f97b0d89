"""Access rules, lookups, stores, statistics, dependencies, quality, graphs and sources on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import paths
from loomgraph.operators import access, deps, graph, lookup, quality, stats, store
from loomgraph.operators.access import AccessRule
from loomgraph.sources import extract, files, linters, manifests
from loomgraph.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("rule", "package", "method", "want"),
    [
        ("internal", "internal", "", True), ("internal/", "internal/utils", "", True), ("*_test", "utils_test", "", True), ("test*", "testing", "", True), ("fmt:Println", "fmt", "Println", True), ("*:Test*", "anything", "TestSomething", True),
        ("internal", "external", "", False), ("fmt:Println", "fmt", "Printf", False), ("internal", "internal.sub", "", True), ("*/private/*", "a/private/b", "", False),
    ],
)
def test_rule_matching(spark, rule, package, method, want):
    assert one(spark, access.rule_matches(access.parse_line(rule), F.lit(package), F.lit(method))) is want


@pytest.mark.parametrize(
    ("rules", "package", "method", "path", "want"),
    [
        (["!internal"], "internal", "", "a.go", False), (["!internal", "+internal/api"], "internal/api", "", "a.go", True), (["!internal"], "external", "", "a.go", True), (["!fmt:Println"], "fmt", "Println", "a.go", False),
        (["!fmt", "[*_test.go] +fmt"], "fmt", "", "service/user_test.go", True), (["!fmt", "[*_test.go] +fmt"], "fmt", "", "user_service.go", False), (["[cmd/*/main.go] !os", "[cmd/admin/main.go] os"], "os", "", "cmd/admin/main.go", True),
        (["[cmd/*/main.go] !os"], "os", "", "pkg/app/main.go", True), (["[internal/*/service/*.go] !os"], "os", "", "internal/user/service/handler.go", False), (["fmt:!Println"], "fmt", "Println", "a.go", False),
    ],
)
def test_ordered_fold(spark, rules, package, method, path, want):
    parsed = [access.parse_line(r) for r in rules]
    assert one(spark, access.is_allowed(parsed, F.lit(package), F.lit(method), F.lit(path))) is want


def test_rule_lines_and_order():
    assert access.parse_line("# comment") is None and access.parse_line("  ") is None
    assert str(access.parse_line("[*.go] !fmt:Println")) == "[*.go] !fmt:Println"
    with pytest.raises(ValueError, match="no ]"):
        access.parse_line("[*.go fmt")
    rule = AccessRule("deny", pattern="x")
    assert [p for p, _ in access.ordered_rules({"main.go": [rule], "*.go": [rule], "src/**": [rule], "**": [rule]})] == ["**", "src/**", "*.go", "main.go"]


def test_node_at_line(spark):
    rows = [(1, "/f", "package", 1, 100), (2, "/f", "type", 10, 50), (3, "/f", "method", 20, 30), (4, "/f", "field", 15, 0)]
    nodes = spark.createDataFrame(rows, "id long, file_path string, node_type string, start_line int, end_line int")
    asked = {25: "method", 35: "type", 75: "package", 15: "field", 20: "method", 30: "method", 19: "type", 31: "type", 0: None, 200: None}
    points = spark.createDataFrame([("/f", k) for k in asked] + [("/g", 25)], "file_path string, line int")
    for bucket in (4, 64):
        found = {r.line: r.node_type for r in lookup.nodes_at_lines(nodes, points, bucket).collect()}
        assert found == {k: v for k, v in asked.items() if v}


KEY = "id long, file_path string, package_name string, type_name string, method_name string, field_name string, start_line int"


def test_merge_keeps_ids(spark):
    old = spark.createDataFrame([(1, "/a", "main", "", "main", "", 3), (2, "/a", "main", "T", "", "Field1", 5), (3, "/b", "main", "", "other", "", 1)], KEY)
    new = spark.createDataFrame([(0, "/a", "main", "", "main", "", 4), (0, "/a", "main", "T", "", "Field1", 6), (0, "/a", "main", "T", "", "Field2", 7)], KEY)
    got = {(r.file_path, r.method_name + r.field_name): (r.id, r.start_line) for r in store.merge_nodes(old, new).collect()}
    assert got["/a", "main"] == (1, 4) and got["/a", "Field1"] == (2, 6) and got["/b", "other"] == (3, 1) and got["/a", "Field2"][0] not in (1, 2, 3) and len(got) == 4
    edges = spark.createDataFrame([(1, 1, 2, "call"), (2, 3, 1, "call"), (3, 3, 77, "call")], "id long, from_ast_id long, to_ast_id long, relationship_type string")
    left = store.replace_edges(edges, edges.where("id = 1").withColumn("id", F.lit(9)), store.merge_nodes(old, new))
    assert sorted(r.id for r in left.collect()) == [2, 9]
    nodes, rest = store.delete_file(old, edges, "/b")
    assert nodes.count() == 2 and [r.id for r in rest.collect()] == [1]


def test_bucketed_store_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([(f"/f{i % 7}", i) for i in range(50)], "file_path string, v int")
    held = store.BucketedStore(spark, str(tmp_path / "t"), 4)
    held.create(rows)
    held.replace_files(spark.createDataFrame([("/f1", 1000)], "file_path string, v int"), spark.createDataFrame([("/f1",), ("/f2",)], "file_path string"))
    got = {(r.file_path, r.v) for r in held.read().collect()}
    assert ("/f1", 1000) in got and not any(f == "/f2" for f, _ in got) and len(got) == 50 - 7 - 7 + 1
    source = tmp_path / "in"
    spark.createDataFrame([("/f3", -1)], "file_path string, v int").write.parquet(str(source))
    incremental.maintain(held, incremental.read_stream(spark, str(source), "file_path string, v int"), str(tmp_path / "ck")).awaitTermination()
    assert {r.v for r in held.read().where("file_path = '/f3'").collect()} == {-1}


def test_debounce_stream_equals_the_batch_fold(spark, tmp_path):
    runs = spark.createDataFrame([("t", "/w", f"2024-01-01 00:{i:02d}:00", c) for i, c in enumerate([0, 0, 0, 0, 0, 0, 2, 1, 1, 0])], "linter_name string, work_dir string, at string, violation_count int").selectExpr("linter_name", "work_dir", "to_timestamp(at) executed_at", "violation_count")
    path = str(tmp_path / "runs")
    runs.coalesce(1).write.parquet(path)
    query = incremental.debounce_stream(spark.readStream.schema(runs.schema).parquet(path)).writeStream.outputMode("update").format("memory").queryName("debounce_out").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("debounce_out").first().factor == pytest.approx(stats.adaptation(runs).first().factor)


@pytest.mark.parametrize(("counts", "start", "want"), [([0] * 5, 1.0, 1.1), ([0] * 5 + [2, 1, 1], 1.0, 0.99), ([0] * 40, 1.0, 2.0), ([1] * 40, 1.0, 0.5), ([1, 1], 0.0, 0.0)])
def test_adaptation(spark, counts, start, want):
    runs = spark.createDataFrame([("t", "/w", i, c) for i, c in enumerate(counts)], "linter_name string, work_dir string, executed_at int, violation_count int")
    assert stats.adaptation(runs, start).first().factor == pytest.approx(want)


def test_debounce_bands(spark):
    bands = {99: 0, 100: 5, 999: 5, 1000: 300, 29_999: 300, 30_000: 3600, 299_999: 3600, 300_000: 10_800, 900_000: 28_800, None: 300}
    rows = spark.createDataFrame([(k,) for k in bands], "ms long").select("ms", stats.base_debounce(F.col("ms")).alias("s")).collect()
    assert {r.ms: r.s for r in rows} == bands


def test_dependencies(spark):
    rows = [("go", "a", "v1"), ("go", "a", "v2"), ("npm", "a", "v2"), ("go", "b", "v1"), ("go", "b", "v1")]
    d = spark.createDataFrame([(*r, i, "", 0) for i, r in enumerate(rows)], "type string, name string, version string, seq int, git string, depth int")
    assert deps.distinct(d, "seq").count() == 4
    assert [(r.name, r.versions) for r in deps.conflicts(d).collect()] == [("a", "v1,v2")]
    image = deps.docker_image(F.lit("reg.io:5000/a/b:1.2"))
    assert [one(spark, image[k]) for k in ("registry", "name", "tag")] == ["reg.io:5000", "reg.io:5000/a/b", "1.2"]
    assert one(spark, deps.substitute(F.lit("a ${V} $W ${X:-d} ${Y}"), {"V": "1", "W": "2"})) == "a 1 2 d ${Y}"
    assert one(spark, deps.go_git_url(F.lit("gopkg.in/yaml.v3"))) == "https://github.com/go-yaml/yaml"


def test_comments(spark):
    for text in ("//", "// TODO", "// word", "// get value", "function to add"):
        assert one(spark, quality.trivial(F.lit(text))), text
    assert not one(spark, quality.trivial(F.lit("// retries because the socket may be closed")))
    assert one(spark, quality.verbose(F.lit(75))) == 0.5 and one(spark, quality.outdated(F.lit("deprecated api"))) == "deprecated"
    assert one(spark, quality.outdated(F.lit("TODO: x"))) is None and one(spark, quality.outdated(F.lit("TODO: x"), fixed=True)) == "TODO"
    none = F.from_json(F.lit("[]"), "array<struct<type:string,word_count:int>>")
    assert one(spark, quality.missing_documentation(F.lit(False), F.lit(12), F.lit(0), none)) and not one(spark, quality.missing_documentation(F.lit(True), F.lit(12), F.lit(0), none))


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 1), (4, 3, 4), (5, 5, 5)], "id long, from_ast_id long, to_ast_id long").withColumn("relationship_type", F.lit("call"))
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6)], "id long")
    assert {(r.id, r.depth) for r in graph.reachable(edges, nodes.where("id = 1"), 5).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert {r.id for r in graph.roots(nodes, edges).collect()} == {6}
    assert {tuple(r.path) for r in graph.call_paths(edges, nodes.where("id = 1"), 4).where("circular").collect()} == {(1, 2, 3, 1)}
    assert {r.id for r in graph.cycles(edges, 3).collect()} == {1, 2, 3, 5}


def test_manifests(spark):
    texts = {
        "a/go.mod": "module m\n\nrequire (\n\tgithub.com/x/y v1.2.3\n\tgolang.org/x/net v0.1.0 // indirect\n\tgithub.com/old/z v1.0.0\n)\nreplace github.com/old/z => github.com/new/z v2.0.0\n",
        "a/go.sum": "github.com/x/y v1.2.3 h1:abc=\ngithub.com/x/y v1.2.3/go.mod h1:def=\n",
        "b/package.json": json.dumps({"dependencies": {"left": "^1.0.0"}, "devDependencies": {"right": "2"}}),
        "b/package-lock.json": json.dumps({"packages": {"": {}, "node_modules/left": {"version": "1.0.1"}}}),
        "b/yarn.lock": '# yarn\n"left@^1.0.0":\n  version "1.0.2"\n',
        "b/pnpm-lock.yaml": "packages:\n  /left@1.0.3: {}\n",
        "c/requirements.txt": "# c\nflask>=2.0 # web\nrequests\n",
        "c/pyproject.toml": '[project]\ndependencies = ["numpy>=1.0"]\n[tool.poetry.dependencies]\npython = "^3"\nrich = "^13.0"\n',
        "c/setup.py": 'setup(install_requires=["attrs==1.0", "six"])',
        "d/pom.xml": "<project><properties><v>3</v></properties><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${v}</version></dependency></dependencies></project>",
        "d/build.gradle": "dependencies {\n  implementation 'g:b:1.0'\n}",
        "e/Dockerfile": "ARG V=1.2\nFROM node:${V} AS build\nRUN a \\\n  b\nFROM alpine\nCOPY --from=build /x /x\nCOPY --from=busybox:1 /y /y\n",
        "e/docker-compose.yml": "services:\n  db:\n    image: postgres:16\n",
        "f/Chart.yaml": "dependencies:\n- {name: redis, version: 1.0.0, repository: https://r}\n",
        "f/values.yaml": "global: {imageRegistry: reg.io}\nweb:\n  image: {repository: acme/web, tag: '2'}\n",
        "g/pyproject.toml": "not toml [",
    }
    df = spark.createDataFrame(list(texts.items()), "file_path string, text string")
    got = {(r.file_path, r.name, r.version, r.type) for r in manifests.scan(df).collect()}
    assert got == {
        ("a/go.mod", "github.com/x/y", "v1.2.3", "go"), ("a/go.mod", "golang.org/x/net", "v0.1.0", "stdlib"), ("a/go.mod", "github.com/new/z", "v2.0.0", "go"), ("a/go.sum", "github.com/x/y", "v1.2.3", "go"),
        ("b/package.json", "left", "1.0.0", "npm"), ("b/package-lock.json", "left", "1.0.1", "npm"), ("b/yarn.lock", "left", "1.0.2", "npm"), ("b/pnpm-lock.yaml", "left", "1.0.3", "npm"),
        ("c/requirements.txt", "flask", "2.0", "pip"), ("c/requirements.txt", "requests", "", "pip"), ("c/pyproject.toml", "numpy", "1.0", "pip"), ("c/pyproject.toml", "rich", "13.0", "pip"), ("c/setup.py", "attrs", "1.0", "pip"), ("c/setup.py", "six", "", "pip"),
        ("d/pom.xml", "g:a", "3", "maven"), ("d/build.gradle", "g:b", "1.0", "maven"), ("e/Dockerfile", "node", "1.2", "docker"), ("e/Dockerfile", "alpine", "latest", "docker"), ("e/Dockerfile", "busybox", "1", "docker"),
        ("e/docker-compose.yml", "postgres", "16", "docker"), ("f/Chart.yaml", "redis", "1.0.0", "helm"), ("f/values.yaml", "reg.io/acme/web", "2", "docker"),
    }


def test_extractors(spark):
    sources = {
        "src/pkg/a.py": ("python", "X = 1\nclass A(B):\n    f: int = 0\n    def run(self, a, *b):\n        if a and b:\n            return 1\n        return [x for x in b if x]\ndef _p() -> int:\n    pass\n"),
        "a.go": ("go", 'package main\n\ntype User struct {\n\tName string\n\tage int\n}\n\nfunc (u *User) Get(a, b int) (string, error) {\n\tif a > b { // }\n\t\treturn "}", nil\n\t}\n\treturn "", nil\n}\n\nvar x = 1\n'),
        "A.java": ("java", "package a.b;\npublic class A extends B {\n  private int n = 1;\n  public int get(int a, String b) {\n    if (a > 1) { return 1; }\n    return 2;\n  }\n}\n"),
        "a.ts": ("typescript", "class A {\n  run(a: number) {\n    return a > 1 ? 1 : 2;\n  }\n}\nfunction f(x, y) { if (x && y) { return 1; } }\nconst g = (z) => { return z; };\n"),
        "bad.py": ("python", "def ("),
    }
    df = spark.createDataFrame([(p, *v) for p, v in sources.items()], "file_path string, language string, text string")
    got = {(r.file_path, r.node_type, r.type_name, r.method_name + r.field_name): r for r in extract.extract(df).collect()}
    run = got["src/pkg/a.py", "method", "A", "run"]
    assert (run.cyclomatic_complexity, run.parameter_count, run.start_line, run.end_line, run.package_name) == (4, 2, 4, 7, "pkg")
    assert got["src/pkg/a.py", "method", "", "_p"].is_private and ("src/pkg/a.py", "variable", "", "X") in got and ("src/pkg/a.py", "field", "A", "f") in got
    get = got["a.go", "method", "User", "Get"]
    assert (get.cyclomatic_complexity, get.parameter_count, get.return_count, get.start_line, get.end_line, get.is_private) == (2, 2, 2, 8, 13, False)
    assert got["a.go", "field", "User", "age"].is_private and not got["a.go", "field", "User", "Name"].is_private
    java = got["A.java", "method", "A", "get"]
    assert (java.cyclomatic_complexity, java.parameter_count, java.return_count) == (2, 2, 1) and got["A.java", "field", "A", "n"].is_private
    assert got["a.ts", "method", "A", "run"].cyclomatic_complexity == 2 and got["a.ts", "method", "", "f"].cyclomatic_complexity == 3 and ("a.ts", "method", "", "g") in got
    assert not any(k[0] == "bad.py" for k in got)


def test_markdown_openapi_and_schema(spark):
    md = spark.createDataFrame([("r.md", "# Top\ntext\n```go\n# no heading\n```\n## Sub\n```\nx\n```\n")], "file_path string, text string")
    assert [(r.heading, r.node_type, r.name) for r in extract.markdown(md).orderBy("start_line").collect()] == [("Top", "type", "Top"), ("Top", "method", "code_go_3"), ("Sub", "type", "Sub"), ("Sub", "method", "code_text_7")]
    spec = {"openapi": "3.0.0", "info": {"title": "Pets", "version": "1.0.0"}, "paths": {"/pets": {"get": {"operationId": "listPets", "parameters": [{"name": "limit"}]}, "post": {"requestBody": {"x": 1}}}, "/pets/{id}": {"get": {"parameters": [{"name": "petId"}]}}}, "components": {"schemas": {"Pet": {"properties": {"id": {"type": "integer"}, "name": {"type": "string"}, "tag": {"type": "string"}}}}}}
    api = extract.openapi(spark.createDataFrame([("p.json", json.dumps(spec)), ("bad.json", "{}")], "file_path string, text string")).collect()
    assert {r.package_name for r in api} == {"v1_0_0"} and sorted(r.node_type for r in api) == ["field"] * 3 + ["method_http_get"] * 2 + ["method_http_post", "type_http_schema"]
    assert all(r.parameter_count == 1 for r in api if r.node_type.startswith("method"))
    columns = spark.createDataFrame([("s", "users", "table", "id", "int"), ("s", "orders", "table", "user_id", "int"), ("s", "v", "view", "x", "int")], "schema string, table string, kind string, column string, type string")
    keys = spark.createDataFrame([("s", "orders", "user_id", "users", "id"), ("s", "orders", "user_id", "gone", "id")], "schema string, table string, column string, to_table string, to_column string")
    nodes, edges = extract.sql_schema(spark, columns, keys)
    assert nodes.where("node_type = 'type_table'").count() == 2 and edges.count() == 2 and edges.where("to_ast_id is null").count() == 1


def test_linter_reports(spark):
    reports = {
        "golangci-lint": {"Issues": [{"FromLinter": "errcheck", "Text": "a.go:3:1: unchecked error (errcheck)", "Pos": {"Filename": "a.go", "Line": 3, "Column": 1}}]},
        "ruff": [{"code": "F401", "message": "unused", "filename": "a.py", "location": {"row": 1, "column": 8}, "fix": {"applicability": "safe"}}],
        "pyright": {"generalDiagnostics": [{"file": "b.py", "severity": "error", "message": "m", "rule": "r", "range": {"start": {"line": 0, "character": 4}}}]},
        "eslint": [{"filePath": "a.js", "messages": [{"ruleId": "semi", "message": "m", "line": 2, "column": 3}]}],
        "markdownlint": [{"fileName": "a.md", "lineNumber": 5, "ruleNames": ["MD001"], "ruleDescription": "d"}],
        "vale": {"b.md": [{"Check": "C", "Message": "m", "Line": 9, "Span": [4, 6], "Severity": "error"}]},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in reports.items()], "tool string, json string")
    got = {r.source: (r.file_path, r.line, r.col, r.code, r.message, r.fixable) for r in linters.read(df).collect()}
    assert got == {"golangci-lint": ("a.go", 3, 1, "errcheck", "unchecked error", False), "ruff": ("a.py", 1, 8, "F401", "unused", True), "pyright": ("b.py", 1, 5, "r", "m", False), "eslint": ("a.js", 2, 3, "semi", "m", False), "markdownlint": ("a.md", 5, 0, "MD001", "d", False), "vale": ("b.md", 9, 4, "C", "m", False)}


def test_files_and_paths(spark, tmp_path):
    for name in ("a.go", "b.py", "vendor/c.go", ".git/d.py", "x/e.md", "x/f.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    root = str(tmp_path)
    found = files.source_files(files.listing(spark, root).withColumn("file_path", F.replace("path", F.lit(f"file:{root}/"), F.lit(""))))
    assert sorted(r.file_path for r in found.collect()) == ["a.go", "b.py", "x/e.md"]
    assert one(spark, paths.sanitize(F.lit("--a b//c--"))) == "a_b_c" and one(spark, paths.sanitize(F.lit("!!"))) == "unknown"
    assert one(spark, paths.connection_id(F.lit("postgres://u:p@h:5432/db?x=1"))) == "postgres_h_5432_db" and one(spark, paths.mask_connection(F.lit("postgres://u:p@h/db"))) == "postgres://u:***@h/db"
    assert [paths.duration_seconds(x) for x in ("7d", "2w", "1h30m", "300ms")] == [604800, 1209600, 5400, pytest.approx(0.3)]
    with pytest.raises(ValueError, match="duration"):
        paths.duration_seconds("x")
