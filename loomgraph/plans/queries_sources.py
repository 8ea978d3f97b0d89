"""Queries on nodes and edges read from source text, whose expected rows SQL gives from the same columns.

Each node of type method becomes a file; what its text holds depends on its id. Names end in the id, so
that a target is known by name in both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.nodes import full_name, stable_id
from loomgraph.plans.registry import query
from loomgraph.sources import edges, extract

GO = r"""package p{id}

import (
	"fmt"
	db "database/sql"
)

type Box struct {
	n int
}

func (t *Box) {name}(a int, b string) error {
	fmt.Println(a) // fmt.Print(b)
[2]	db.Open("f(x)")
	help(a)
[3]	t.n.run(a)
[4]	if a > 1 {
[4]	}
	gone(a)
	return nil
}

func help(a int) {
}
"""
JAVA = """package p{id};
import java.util.List;
public class Box extends Base implements One, Two<Box> {
  private int n = 1;
  public int {name}(int a, String b) {
    help{id}(a);
[2]    x.y.run("f(x)").stop();
[4]    if (a > 1) { }
    return gone(a);
  }
  int help{id}(int b) { return 1; }
}
"""
SCRIPT = """import fs from 'fs';
class Box extends Base {
  {name}(a, b) {
    this.help{id}(a);
[2]    lib.run('f(x)');
[4]    if (a) { }
    return gone{id}(a);
  }
  help{id}(b) {
    return 1;
  }
}
function gone{id}(x) {
  return 2;
}
"""
PYTHON = """import os, json as j
class Box(Base):
    n = 1
    def {name}(self, a, b=1):
        self.help{id}(a)
[2]        os.listdir('f(x)')
[4]        if a: pass
        return gone{id}(a)
    def help{id}(self, b):
        return 1
def gone{id}(x):
    return 2
"""
METHODS = "(SELECT id, method_name AS name, CAST(id % 2 = 0 AS INT) AS k2, CAST(id % 3 = 0 AS INT) AS k3, CAST(id % 4 = 0 AS INT) AS k4 FROM ast_nodes WHERE node_type = 'method') m"


def _files(t, language: str, ending: str, text: str):
    """One file per method node: [n] marks a line that only ids divisible by n have."""
    parts = []
    for line in text.splitlines(keepends=True):
        divisor, body = (int(line[1]), line[3:]) if line.startswith("[") else (0, line)
        pieces = body.replace("{id}", "\0id\0").replace("{name}", "\0name\0").split("\0")
        made = F.concat(*[F.col("id").cast("string") if p == "id" else F.col("method_name") if p == "name" else F.lit(p) for p in pieces if p])
        parts.append(F.when(F.col("id") % divisor == 0, made).otherwise("") if divisor else made)
    # a node makes far more work than its bytes tell, so the few tasks that read the table hand the nodes on to all
    methods = t.ast_nodes.where("node_type = 'method'").select("id", "method_name").repartition(t.spark.sparkContext.defaultParallelism * 4, "id")
    return methods.select(F.concat(F.lit("src/m" if "/" in ending else "src/"), "id", F.lit(ending)).alias("file_path"), F.lit(language).alias("language"), F.concat(*parts).alias("text"))


def _nodes(t, language: str, ending: str, text: str):
    return extract.extract(_files(t, language, ending, text)).withColumn("name", full_name()).select("file_path", "node_type", "name", "start_line", "end_line", "cyclomatic_complexity", "parameter_count", "return_count", "is_private")


def _edges(t, language: str, ending: str, text: str):
    """caller and target by full name, line, type and library of every edge."""
    files = _files(t, language, ending, text)
    placed = edges.place(extract.extract(files).withColumn("id", stable_id()), edges.find(files))
    caller = F.when(F.col("from_ast_id").isNotNull(), F.col("caller"))
    library = F.when(F.col("package").isNull(), "").otherwise(F.concat_ws("|", "package", "method", "framework"))
    return placed.select(caller.alias("caller"), "target", "line_no", "relationship_type", "text", library.alias("library"))


def _node_sql(ending: str, rows: list[tuple[str, ...]]) -> str:
    """rows: node type, name, first and last line, complexity, parameters, results, private, as SQL."""
    return " UNION ALL ".join(f"SELECT concat('src/', id, '{ending}') AS file_path, '{kind}' AS node_type, {name} AS name, CAST({a} AS INT) AS start_line, CAST({b} AS INT) AS end_line, CAST({c} AS INT) AS cyclomatic_complexity, {p} AS parameter_count, {r} AS return_count, {private} AS is_private FROM {METHODS}" for kind, name, a, b, c, p, r, private in rows)


def _edge_sql(rows: list[tuple[str, ...]]) -> str:
    """rows: caller, target, line, type, text, library and condition, as SQL."""
    return " UNION ALL ".join(f"SELECT {caller} AS caller, {target} AS target, CAST({line} AS INT) AS line_no, '{kind}' AS relationship_type, {text} AS text, '{library}' AS library FROM {METHODS} WHERE {where}" for caller, target, line, kind, text, library, where in rows)


NONE, BOX = "CAST(NULL AS VARCHAR)", "concat('p', id, '.Box.', name)"
PRIVATE = "NOT regexp_matches(name, '^[A-Z]')"
query("s12_go_nodes", _node_sql(".go", [
    ("type", "concat('p', id, '.Box')", "8", "10", "0", "0", "0", "false"), ("field", "concat('p', id, '.Box.n')", "9", "9", "0", "0", "0", "true"),
    ("method", BOX, "12", "17 + k2 + k3 + 2 * k4", "1 + k4", "2", "1", PRIVATE), ("method", "concat('p', id, '.help')", "19 + k2 + k3 + 2 * k4", "20 + k2 + k3 + 2 * k4", "1", "1", "0", "true"),
]))(lambda t: _nodes(t, "go", ".go", GO))
query("s12_go_edges", _edge_sql([
    (BOX, NONE, "13", "call", "'fmt.Println() (pkg=fmt;class=;method=Println;framework=stdlib)'", "fmt|Println|stdlib", "true"),
    (BOX, NONE, "14", "call", "'db.Open() (pkg=database/sql;class=;method=Open;framework=database)'", "database/sql|Open|database", "k2 = 1"),
    (BOX, "concat('p', id, '.help')", "14 + k2", "call", "'help()'", "", "true"), (BOX, NONE, "15 + k2", "call", "concat('call@', 15 + k2, ':2')", "", "k3 = 1"),
    (BOX, NONE, "15 + k2 + k3 + 2 * k4", "call", "'gone()'", "", "true"),
]))(lambda t: _edges(t, "go", ".go", GO))
query("s14_java_nodes", _node_sql(".java", [
    ("type", "concat('p', id, '.Box')", "3", "10 + k2 + k4", "0", "0", "0", "false"), ("field", "concat('p', id, '.Box.n')", "4", "4", "0", "0", "0", "true"),
    ("method", BOX, "5", "8 + k2 + k4", "1 + k4", "2", "1", "false"), ("method", "concat('p', id, '.Box.help', id)", "9 + k2 + k4", "9 + k2 + k4", "1", "1", "1", "false"),
]))(lambda t: _nodes(t, "java", ".java", JAVA))
JBOX = "concat('p', id, '.Box')"
query("s14_java_edges", _edge_sql([
    (JBOX, NONE, "3", "extends", "''", "", "true"), (JBOX, NONE, "3", "implements", "''", "", "true"), (JBOX, NONE, "3", "implements", "''", "", "true"), (NONE, NONE, "2", "import", "'import java.util.List'", "java.util.List||stdlib", "true"),
    (BOX, "concat('p', id, '.Box.help', id)", "6", "call", "''", "", "true"), (BOX, NONE, "7", "call", "''", "", "k2 = 1"), (BOX, NONE, "7", "call", "''", "", "k2 = 1"), (BOX, NONE, "7 + k2 + k4", "call", "''", "", "true"),
]))(lambda t: _edges(t, "java", ".java", JAVA))
SBOX = "concat('src.Box.', name)"
for _id, _language, _ending in (("s15_javascript", "javascript", ".js"), ("s16_typescript", "typescript", ".ts")):
    query(_id + "_nodes", _node_sql(_ending, [
        ("type", "'src.Box'", "2", "10 + k2 + k4", "0", "0", "0", "false"), ("method", SBOX, "3", "6 + k2 + k4", "1 + k4", "2", "1", "false"),
        ("method", "concat('src.Box.help', id)", "7 + k2 + k4", "9 + k2 + k4", "1", "1", "1", "false"), ("method", "concat('src.gone', id)", "11 + k2 + k4", "13 + k2 + k4", "1", "1", "1", "false"),
    ]))(lambda t, a=(_language, _ending): _nodes(t, *a, SCRIPT))
    query(_id + "_edges", _edge_sql([
        ("'src.Box'", NONE, "2", "extends", "'extends Base'", "", "true"), (NONE, NONE, "1", "import", "'import fs'", "fs||stdlib", "true"),
        (SBOX, "concat('src.Box.help', id)", "4", "call", "concat('calls this.help', id)", "", "true"), (SBOX, NONE, "5", "call", "'calls lib.run'", "", "k2 = 1"),
        (SBOX, "concat('src.gone', id)", "5 + k2 + k4", "call", "concat('calls gone', id)", "", "true"),
    ]))(lambda t, a=(_language, _ending): _edges(t, *a, SCRIPT))
query("s13_python_nodes", _node_sql(".py", [
    ("type", "concat('m', id, '.Box')", "2", "8 + k2 + k4", "0", "0", "0", "false"), ("field", "concat('m', id, '.Box.n')", "3", "3", "0", "0", "0", "false"),
    ("method", "concat('m', id, '.Box.', name)", "4", "6 + k2 + k4", "1 + k4", "2", "0", "name LIKE '\\_%' ESCAPE '\\'"), ("method", "concat('m', id, '.Box.help', id)", "7 + k2 + k4", "8 + k2 + k4", "1", "1", "0", "false"),
    ("method", "concat('m', id, '.gone', id)", "9 + k2 + k4", "10 + k2 + k4", "1", "1", "0", "false"),
]).replace("concat('src/', id, '.py')", "concat('src/m', id, '/a.py')"))(lambda t: _nodes(t, "python", "/a.py", PYTHON))
PBOX = "concat('m', id, '.Box.', name)"
query("s13_python_edges", _edge_sql([
    ("concat('m', id, '.Box')", NONE, "2", "inheritance", "'inherits Base'", "", "true"), (NONE, NONE, "1", "import", "'import os (module=os;alias=;framework=python)'", "os||stdlib", "true"), (NONE, NONE, "1", "import", "'import json (module=json;alias=j;framework=python)'", "json||stdlib", "true"),
    (PBOX, "concat('m', id, '.Box.help', id)", "5", "call", "concat('calls self.help', id)", "", "true"), (PBOX, NONE, "6", "call", "'calls os.listdir'", "", "k2 = 1"), (PBOX, "concat('m', id, '.gone', id)", "6 + k2 + k4", "call", "concat('calls gone', id)", "", "true"),
]))(lambda t: _edges(t, "python", "/a.py", PYTHON))
