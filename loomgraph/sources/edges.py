"""Edges from source: (file_path, language, text) rows become call, inheritance and import edges.

An edge goes out from the method or type around its line, by full name, and leads to a name as the
source has it; resolve() puts node ids for both. Python is parsed exactly with its own grammar, the
other languages are scanned, as their nodes are. What is found, by language:

go: calls. `f()` leads to `package.f`; `alias.F()` of an imported package is a library call; any other
  call (of a variable's method, or of an expression) has no known target.
java: extends and implements of each class at its first line, calls by their simple name, imports.
javascript, typescript: extends, implements, calls by the name as written (`this.` is the own class), imports and requires.
python: bases, calls by the name as written (`self.` is the own class), imports.

Imports and Go's library calls are library edges: they name a package, class, method and framework. A
Go file's import is no edge by itself. A file that can't be parsed has none.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.batches import steps
from loomgraph.functions.nodes import full_name
from loomgraph.operators.lookup import NODE_BUILTIN, PYTHON_STDLIB, endings, join_called
from loomgraph.sources import extract

SCHEMA = "file_path string, caller string, called string, line_no int, relationship_type string, text string, package string, class string, method string, framework string"
FIELDS = [c.split()[0] for c in SCHEMA.split(", ")]
Edge = dict[str, Any]
#: Words before a parenthesis that aren't calls.
GO_WORDS = frozenset("if for switch select return func go defer case range else chan map interface struct var const type import package".split())
SCRIPT_WORDS = frozenset("if for while switch catch function return typeof await new do else with void delete in of instanceof yield super".split())
JAVA_WORDS = frozenset("if for while switch catch return new synchronized throw try do else super this assert".split())


def go_framework(path: str) -> str:
    known = (("gin-gonic/gin", "gin"), ("gorilla/mux", "gorilla"), ("labstack/echo", "echo"), ("gorm.io", "gorm"), ("database/sql", "database"))
    return next((k for part, k in known if part in path), "third-party") if "/" in path else "stdlib"


class _Lines:
    """Line and column of a place in a text, and the method or type around a line."""

    def __init__(self, text: str, nodes: list[dict[str, Any]]) -> None:
        self.starts = [0, *[m.end() for m in re.finditer("\n", text)]]
        self.around = {kind: sorted((n["start_line"], -n["end_line"], n) for n in nodes if n["node_type"] == kind and n["end_line"] >= n["start_line"]) for kind in ("method", "type")} if nodes else {}
        for kind, found in self.around.items():
            self.around[kind] = [n for _, _, n in found]

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def column(self, at: int) -> int:
        return at - self.starts[self.line(at) - 1] + 1

    def declares(self, text: str, at: int) -> bool:
        """Whether only modifiers and types come before a name in its line."""
        return re.fullmatch(r"[\w\s<>\[\],.?@*]*", text[self.starts[self.line(at) - 1] : at]) is not None

    def owner(self, line: int, kind: str = "method") -> dict[str, Any] | None:
        """The last to start of the nodes around a line."""
        found = None
        for n in self.around.get(kind, ()):
            if n["start_line"] > line:
                break
            if n["end_line"] >= line:
                found = n
        return found


def _name(*parts: str) -> str:
    return ".".join(p for p in parts if p)


def _full(node: dict[str, Any]) -> str:
    return _name(node["package_name"], node["type_name"], node["method_name"])


def _edge(path: str, caller: str, called: str | None, line: int, kind: str, text: str) -> Edge:
    return dict.fromkeys(FIELDS) | {"file_path": path, "caller": caller, "called": called, "line_no": line, "relationship_type": kind, "text": text}


def _import(path: str, line: int, package: str, framework: str, text: str) -> Edge:
    return _edge(path, "", None, line, "import", text) | {"package": package, "class": "", "method": "", "framework": framework}


#: A name with its parts, and an opening parenthesis.
CALL = re.compile(r"(?<![\w.$])([A-Za-z_$][\w$]*(?:\s*\??\.\s*#?[A-Za-z_$][\w$]*)*)\s*(?:<[\w\s,.\[\]]*>)?\(")
#: A call of an expression's result, or of its method.
LATER = re.compile(r"[)\]}](?:\.\s*\w+)?\(")
LITERAL = re.compile(r"\bfunc\s*\([^()]*\)\s*(?:\([^()]*\)|[\w.*\[\]]*)\s*$")


def _opening(text: str, at: int) -> int:
    """Where the bracket that closes at `at` opens."""
    depth = 0
    for i in range(at, -1, -1):
        depth += text[i] in ")]}"
        depth -= text[i] in "([{"
        if depth == 0:
            return i
    return 0


def _expression_start(text: str, close: int) -> int:
    """Where the Go expression starts that ends in the bracket at `close`; -1 for a block's brace."""
    while True:
        start = _opening(text, close)
        before = text[max(0, start - 300) : start]
        if text[close] == "}" and (m := LITERAL.search(before)):
            return start - len(m.group())
        word = re.search(r"[\w.]*$", before)
        start -= len(word.group()) if word else 0
        if text[close] == "}" and not word.group():
            return -1
        if start == 0 or text[start - 1] not in ")]}":
            return start
        close = start - 1


def go_edges(path: str, text: str) -> Iterator[Edge]:
    bare = extract.blank(text, "\"`'")
    nodes = list(extract.extract_go(path, text))
    lines = _Lines(bare, nodes)
    m = re.search(r"^package\s+(\w+)", bare, re.M)
    package = m[1] if m else ""
    imports = {}
    for m in re.finditer(r'^import\s*(?:\(([^)]*)\)|([^\n(]+))', extract.blank(text, "`'", strings=False), re.M):
        for alias, library in re.findall(r'([\w.]*)[ \t]*"([^"]+)"', m[1] or m[2] or ""):
            imports[alias or library.rsplit("/", 1)[-1]] = library
    found = [(m.start(1), re.sub(r"\s", "", m[1]).split(".")) for m in CALL.finditer(bare)]
    # of other calls the name isn't known; they are placed where their expression starts
    found += [(start, []) for m in LATER.finditer(bare) if (start := _expression_start(bare, m.start())) >= 0]
    for at, parts in sorted(found):
        line = lines.line(at)
        owner = lines.owner(line)
        if owner is None or parts[:1] and (parts[0] in GO_WORDS or re.search(r"\bfunc\s*(?:\([^()]*\)\s*)?$", bare[max(0, at - 200) : at])):
            continue
        if len(parts) == 1 and bare[:at].rstrip(" \t")[-1:] == "]":
            parts = []  # a conversion to a slice or map
        caller = _full(owner)
        if len(parts) == 2 and parts[0] in imports:
            library = imports[parts[0]]
            kind, told = go_framework(library), f"{parts[0]}.{parts[1]}()"
            yield _edge(path, caller, None, line, "call", f"{told} (pkg={library};class=;method={parts[1]};framework={kind})") | {"package": library, "class": "", "method": parts[1], "framework": kind}
        elif len(parts) in (1, 2):
            yield _edge(path, caller, _name(package, parts[0]) if len(parts) == 1 else None, line, "call", ".".join(parts) + "()")
        else:
            yield _edge(path, caller, None, line, "call", f"call@{line}:{lines.column(at)}")


def java_edges(path: str, text: str) -> Iterator[Edge]:
    bare = extract.blank(text, "\"'")
    lines = _Lines(bare, list(extract.extract_java(path, text)))
    for m in re.finditer(r"^\s*import\s+(static\s+)?([\w.]+(?:\.\*)?)\s*;", bare, re.M):
        yield _import(path, lines.line(m.start(2)), m[2], "stdlib" if re.match(r"javax?\.", m[2]) else "third-party", f"import {m[2]}")
    for m in re.finditer(r"\b(?:class|interface|enum|record)\s+(\w+)([^{;]*)\{", bare):
        line = lines.line(m.start())
        owner = lines.owner(line, "type")
        for kind, names in re.findall(r"\b(extends|implements)\s+(.+?)(?=\bextends\b|\bimplements\b|\bpermits\b|$)", re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", m[2])), re.S):
            for name in re.split(r"\s*,\s*", names.strip()):
                yield _edge(path, _name(owner["package_name"], m[1]) if owner else m[1], name, line, kind, "")
    starts = {(n["start_line"], n["method_name"]) for n in lines.around.get("method", ())}
    for m in CALL.finditer(bare):
        parts = re.sub(r"\s", "", m[1]).split(".")
        line = lines.line(m.start(1))
        owner = lines.owner(line)
        before = bare[max(0, m.start(1) - 60) : m.start(1)]
        if owner is None or parts[-1] in JAVA_WORDS or re.search(r"\bnew\s*$", before) or len(parts) == 1 and (line, parts[0]) in starts and lines.declares(bare, m.start(1)):
            continue
        yield _edge(path, _full(owner), parts[-1], line, "call", "")
    for m in re.finditer(r"[)\]]\s*\.\s*(\w+)\s*\(", bare):
        line = lines.line(m.start(1))
        owner = lines.owner(line)
        if owner is not None:
            yield _edge(path, _full(owner), m[1], line, "call", "")


def script_edges(path: str, text: str) -> Iterator[Edge]:
    bare = extract.blank(text, "\"'`")
    language = "typescript" if path.endswith((".ts", ".tsx")) else "javascript"
    nodes = list(extract.extract_script(path, text, language))
    lines = _Lines(bare, nodes)
    package = path.rsplit("/", 1)[0].rsplit("/", 1)[-1] if "/" in path else ""
    told = extract.blank(text, "", strings=False)
    for m in re.finditer(r"""(?:^[ \t]*import\b[^"';]*|\brequire\s*\(\s*)(["'])([^"'\n]+)\1""", told, re.M):
        name = m[2]
        bare_name = name.removeprefix("node:").split("/")[0]
        kind = "relative" if re.match(r"\.{0,2}/", name) else "stdlib" if bare_name in NODE_BUILTIN else "third-party"
        yield _import(path, lines.line(m.start()) if m.group().lstrip() == m.group() else lines.line(m.start() + len(m.group()) - len(m.group().lstrip())), name, kind, f"import {name}")
    for m in re.finditer(r"\b(?:class|interface)\s+(\w+)([^{;]*)\{", bare):
        for kind, names in re.findall(r"\b(extends|implements)\s+(.+?)(?=\bextends\b|\bimplements\b|$)", re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", m[2])), re.S):
            for name in re.split(r"\s*,\s*", names.strip()):
                yield _edge(path, _name(package, m[1]), name, lines.line(m.start()), kind, f"{kind} {name}")
    starts = {(n["start_line"], n["method_name"]) for n in lines.around.get("method", ())}
    for m in CALL.finditer(bare):
        name = re.sub(r"[\s?]", "", m[1])
        line = lines.line(m.start(1))
        owner = lines.owner(line)
        before = bare[max(0, m.start(1) - 60) : m.start(1)]
        if owner is None or name.split(".")[-1] in SCRIPT_WORDS or re.search(r"\b(?:function\s*\*?|new)\s*$", before) or (line, name) in starts and lines.declares(bare, m.start(1)):
            continue
        target = _name(package, owner["type_name"], name[5:]) if name.startswith("this.") and owner["type_name"] else name
        yield _edge(path, _full(owner), target, line, "call", f"calls {name}")


def python_edges(path: str, text: str) -> Iterator[Edge]:
    tree, package = ast.parse(text), extract.python_package(path)

    def dotted(n: ast.AST) -> str:
        return n.id if isinstance(n, ast.Name) else f"{dotted(n.value)}.{n.attr}" if isinstance(n, ast.Attribute) and dotted(n.value) else ""

    def library(name: str, alias: str, line: int) -> Edge:
        kind = "relative" if name.startswith(".") else "stdlib" if name.split(".")[0] in PYTHON_STDLIB else "third-party"
        return _import(path, line, name, kind, f"import {name} (module={name};alias={alias};framework=python)")

    def calls(f: ast.AST, owner: str, caller: str) -> Iterator[Edge]:
        for n in ast.walk(f):
            if isinstance(n, ast.Call) and (name := dotted(n.func)):
                first, _, rest = name.partition(".")
                yield _edge(path, caller, _name(package, owner, rest) if first in ("self", "cls") and rest and owner else name, n.lineno, "call", f"calls {name}")

    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            yield from (library(a.name, a.asname or "", n.lineno) for a in n.names)
        elif isinstance(n, ast.ImportFrom):
            yield library("." * n.level + (n.module or ""), "", n.lineno)
    for item in tree.body:
        if isinstance(item, ast.ClassDef):
            for base in item.bases:
                if name := dotted(base):
                    yield _edge(path, _name(package, item.name), name, item.lineno, "inheritance", f"inherits {name}")
            for sub in item.body:
                if isinstance(sub, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    yield from calls(sub, item.name, _name(package, item.name, sub.name))
        elif isinstance(item, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield from calls(item, "", _name(package, item.name))


FINDERS: dict[str, Callable[[str, str], Iterator[Edge]]] = {"go": go_edges, "java": java_edges, "javascript": script_edges, "typescript": script_edges, "python": python_edges}


def find(texts: DataFrame) -> DataFrame:
    """Unresolved edges of (file_path, language, text) rows, a bounded number of files at a time."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out, finders = to_arrow_schema(_parse_datatype_string(SCHEMA)), dict(FINDERS)

    def run(batches: Any) -> Any:
        for batch in batches:
            for b in steps(batch, "text"):
                rows: list[Edge] = []
                for path, language, text in zip(*(b.column(c).to_pylist() for c in ("file_path", "language", "text"))):
                    try:
                        rows += finders[language](path, text or "")
                    except Exception:  # noqa: BLE001, S112: whatever a file holds, the others go on
                        continue
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    return texts.where(F.col("language").isin(*finders)).select("file_path", "language", "text").mapInArrow(run, SCHEMA)


def place(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """found with from_ast_id, to_ast_id and the target's full name. The source is the node of that full name in
    the edge's file, of several the least id; an edge without one has a null there. The target goes by exact full
    name, else by suffix (see resolve_by_name); a library edge has none. found is read once and nodes twice."""
    sources = nodes.select("id", "file_path", full_name().alias("caller")).groupBy("file_path", "caller").agg(F.min("id").alias("from_ast_id"))
    targets = endings(nodes).groupBy("called").agg(F.min(F.struct("part", "id", "name")).alias("_t"))
    asked = found.join(sources, ["file_path", "caller"], "left").withColumn("called", F.when(F.col("package").isNull(), F.col("called")))
    return join_called(asked, targets).withColumns({"to_ast_id": F.col("_t.id"), "target": F.col("_t.name")}).drop("_t")


def resolve(nodes: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (from_ast_id, to_ast_id, line_no, relationship_type, text) and library edges (ast_id, package,
    class, method, framework, line_no, relationship_type, text), of what place() gives."""
    placed = place(nodes, found)
    edges = placed.where("package IS NULL").select("from_ast_id", "to_ast_id", "line_no", "relationship_type", "text")
    return edges, placed.where("package IS NOT NULL").select(F.col("from_ast_id").alias("ast_id"), "package", "class", "method", "framework", "line_no", "relationship_type", "text")
