"""Source extractors: (file_path, text) rows become node rows.

Python is parsed exactly, with its own grammar. Go, Java, JavaScript and TypeScript are scanned by
their declarations and braces, which is approximate where strings or macros hide braces. Markdown
is read line by line. A file that can't be parsed has no nodes.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.batches import steps

SCHEMA = """file_path string, package_name string, type_name string, method_name string, field_name string, node_type string,
language string, start_line int, end_line int, cyclomatic_complexity int, parameter_count int, return_count int, line_count int, is_private boolean"""
FIELDS = [c.split()[0] for c in SCHEMA.replace("\n", " ").split(", ")]
Node = dict[str, Any]


def _node(path: str, package: str, kind: str, language: str, start: int, end: int, **more: Any) -> Node:
    base = dict.fromkeys(("type_name", "method_name", "field_name"), "") | {"cyclomatic_complexity": 0, "parameter_count": 0, "return_count": 0, "is_private": False}
    return base | {"file_path": path, "package_name": package, "node_type": kind, "language": language, "start_line": start, "end_line": end, "line_count": end - start + 1} | more


def python_package(path: str) -> str:
    """The dotted folders below src, lib or app, else the file's folder."""
    parts = path.strip("/").split("/")
    stem = parts[-1].removesuffix(".py")
    for root in ("src", "lib", "app"):
        if root in parts[:-1]:
            below = parts[parts.index(root) + 1 : -1]
            return ".".join(below) or stem
    return parts[-2] if len(parts) > 1 else stem


def python_complexity(node: ast.AST) -> int:
    total = 1
    for n in ast.walk(node):
        if isinstance(n, (ast.If, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.IfExp)):
            total += 1
        elif isinstance(n, ast.BoolOp):
            total += len(n.values) - 1
        elif isinstance(n, ast.comprehension):
            total += len(n.ifs)
    return total


def extract_python(path: str, text: str) -> Iterator[Node]:
    tree, package = ast.parse(text), python_package(path)

    def function(f: ast.FunctionDef | ast.AsyncFunctionDef, owner: str) -> Node:
        a = f.args
        names = [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))] if x.arg not in ("self", "cls")]
        return _node(path, package, "method", "python", f.lineno, f.end_lineno or f.lineno, type_name=owner, method_name=f.name, cyclomatic_complexity=python_complexity(f), parameter_count=len(names), return_count=int(f.returns is not None), is_private=f.name.startswith("_"))

    for item in tree.body:
        if isinstance(item, ast.ClassDef):
            yield _node(path, package, "type", "python", item.lineno, item.end_lineno or item.lineno, type_name=item.name, is_private=item.name.startswith("_"))
            for sub in item.body:
                if isinstance(sub, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    yield function(sub, item.name)
                elif isinstance(sub, (ast.Assign, ast.AnnAssign)):
                    for t in sub.targets if isinstance(sub, ast.Assign) else [sub.target]:
                        if isinstance(t, ast.Name):
                            yield _node(path, package, "field", "python", sub.lineno, sub.end_lineno or sub.lineno, type_name=item.name, field_name=t.id, is_private=t.id.startswith("_"))
        elif isinstance(item, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield function(item, "")
        elif isinstance(item, (ast.Assign, ast.AnnAssign)):
            for t in item.targets if isinstance(item, ast.Assign) else [item.target]:
                if isinstance(t, ast.Name):
                    yield _node(path, package, "variable", "python", item.lineno, item.end_lineno or item.lineno, field_name=t.id, is_private=t.id.startswith("_"))


def _block_end(text: str, at: int) -> int:
    """Where the brace block that opens at or after `at` ends."""
    depth, i = 0, text.find("{", at)
    if i < 0:
        return at
    for m in re.compile(r"[{}]").finditer(text, i):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.start()
    return len(text) - 1


def blank(text: str, quotes: str, strings: bool = True) -> str:
    """The text with comments and, unless strings is false, strings blanked; line breaks are kept."""
    quoted = "|".join(rf"{q}(?:\\.|[^{q}\\{'' if q == '`' else chr(92) + 'n'}])*{q}" for q in (quotes if strings else "\"'`"))
    form = rf"(?P<comment>//[^\n]*|/\*.*?\*/)|{quoted}"
    return re.sub(form, lambda m: re.sub(r"[^\n]", " ", m.group()) if strings or m["comment"] else m.group(), text, flags=re.S)


def _commas(text: str) -> int:
    depth = parts = 0
    for c in text:
        depth += c in "([{<"
        depth -= c in ")]}>"
        parts += c == "," and depth == 0
    return parts + 1 if text.strip() else 0


def _go_private(name: str) -> bool:
    bare = name.lstrip("_")
    return not bare or not bare[0].isupper()


def _in_group(text: str, at: int, words: str) -> bool:
    """Whether a line is one of a parenthesised group of declarations."""
    opened = text.rfind("\n)", 0, at)
    heads = [m for m in re.compile(rf"^(?:{words})[ \t]*\(", re.M).finditer(text, max(opened, 0), at)]
    return bool(heads) and text[heads[-1].end() : at].count("(") == text[heads[-1].end() : at].count(")") and text[heads[-1].end() : at].count("{") == text[heads[-1].end() : at].count("}")


def extract_go(path: str, text: str) -> Iterator[Node]:
    bare = blank(text, "\"`'")
    line = lambda i: bare.count("\n", 0, i) + 1
    m = re.search(r"^package\s+(\w+)", bare, re.M)
    package = m[1] if m else ""
    for m in re.finditer(r"^(?:type\s+|\t)(\w+)(?:\[[^\]]*\])?\s+(struct|interface)\s*\{", bare, re.M):
        end = _block_end(bare, m.end() - 1)
        yield _node(path, package, "type", "go", line(m.start()), line(end), type_name=m[1], is_private=_go_private(m[1]))
        for f in re.finditer(r"^\s*(\w+(?:[ \t]*,[ \t]*\w+)*)(\(|[ \t]+[\w*\[\].(<])", bare[m.end() : end], re.M):
            at = line(m.end() + f.start(1))
            for name in re.split(r"\s*,\s*", f[1]):
                if m[2] == "interface" and f[2] == "(":
                    yield _node(path, package, "method", "go", at, at, type_name=m[1], method_name=name, is_private=_go_private(name))
                elif m[2] == "struct" and f[2] != "(":
                    yield _node(path, package, "field", "go", at, at, type_name=m[1], field_name=name, is_private=_go_private(name))
    for m in re.finditer(r"^func\s+(?:\(\s*\w*\s*\*?(\w+)(?:\[[^\]]*\])?\s*\)\s*)?(\w+)(?:\[[^\]]*\])?\(([^)]*)\)\s*([^{\n]*)\{", bare, re.M):
        end = _block_end(bare, m.end() - 1)
        body = bare[m.end() : end]
        cases = len(re.findall(r"\bcase\b", body))
        complexity = 1 + len(re.findall(r"\b(?:if|for|switch|select)\b", body)) + cases
        result = m[4].strip()
        results = _commas(result[1:-1]) if result.startswith("(") else int(bool(result))
        yield _node(path, package, "method", "go", line(m.start()), line(end), type_name=m[1] or "", method_name=m[2], cyclomatic_complexity=complexity, parameter_count=_commas(m[3]), return_count=results, is_private=_go_private(m[2]))
    for m in re.finditer(r"^(?:type\s+|\t)(\w+)(?:\[[^\]]*\])?[ \t]+(?==?[ \t]*[\w*\[(<])(?!(?:struct|interface)\b)[^\n]*", bare, re.M):
        if m.group().startswith("type") or _in_group(bare, m.start(), "type"):
            yield _node(path, package, "type", "go", line(m.start()), line(m.end()), type_name=m[1], is_private=_go_private(m[1]))
    for m in re.finditer(r"^(?:(?:var|const)[ \t]+|\t)(\w+(?:[ \t]*,[ \t]*\w+)*)(?=[ \t]|$)", bare, re.M):
        if not m.group().startswith("\t") or _in_group(bare, m.start(), "var|const"):
            for name in re.split(r"[ \t]*,[ \t]*", m[1]):
                if name != "_":
                    yield _node(path, package, "variable", "go", line(m.start(1)), line(m.start(1)), field_name=name, is_private=_go_private(name))


def extract_java(path: str, text: str) -> Iterator[Node]:
    bare = blank(text, "\"'")
    line = lambda i: bare.count("\n", 0, i) + 1
    m = re.search(r"^\s*package\s+([\w.]+)\s*;", bare, re.M)
    package = m[1] if m else ""
    types = [(m[1], m.start(), m.end(), _block_end(bare, m.end() - 1)) for m in re.finditer(r"\b(?:class|interface|enum|record)\s+(\w+)[^{;]*\{", bare)]
    owner = lambda i: max(((s, n) for n, s, b, e in types if b <= i <= e), default=(0, ""))[1]
    for name, start, _, end in types:
        yield _node(path, package, "type", "java", line(start), line(end), type_name=name)
    member = r"(?m)^[ \t]*((?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*)(?:<[^>]+>\s*)?([\w<>\[\],.? ]*?)\s*\b(\w+)\s*"
    keywords = {"if", "for", "while", "switch", "catch", "return", "new", "else", "synchronized", "throw", "try", "do"}
    for m in re.finditer(member + r"\(([^)]*)\)\s*(?:throws\s+[\w.,\s]+)?(\{|;)", bare):
        who = owner(m.start(3))
        if m[3] in keywords or not who or m[2].strip().split(" ")[0] in keywords or (not m[2].strip() and m[3] != who):
            continue
        end = _block_end(bare, m.end() - 1) if m[5] == "{" else m.end()
        body = bare[m.end() : end]
        complexity = 1 + len(re.findall(r"\b(?:if|for|while|case|catch)\b", body))
        kind = m[2].strip()
        yield _node(path, package, "method", "java", line(m.start(3)), line(end), type_name=who, method_name=m[3], cyclomatic_complexity=complexity, parameter_count=_commas(m[4]), return_count=int(kind not in ("", "void")), is_private="private" in m[1])
    for m in re.finditer(r"(?m)^[ \t]*((?:(?:public|private|protected|static|final|volatile|transient)\s+)+)([\w<>\[\],.? ]+?)\s+(\w+)\s*(?:=[^;]*)?;", bare):
        if owner(m.start(3)) and m[2].split(" ")[0] not in keywords:
            yield _node(path, package, "field", "java", line(m.start(3)), line(m.start(3)), type_name=owner(m.start(3)), field_name=m[3], is_private="private" in m[1])


def extract_script(path: str, text: str, language: str) -> Iterator[Node]:
    bare = blank(text, "\"'`")
    line = lambda i: bare.count("\n", 0, i) + 1
    package = path.rsplit("/", 1)[0].rsplit("/", 1)[-1] if "/" in path else ""
    classes = [(m[2], m.start(), m.end(), _block_end(bare, m.end() - 1)) for m in re.finditer(r"\b(class|interface|enum)\s+(\w+)[^{;]*\{", bare)]
    for name, start, _, end in classes:
        yield _node(path, package, "type", language, line(start), line(end), type_name=name)

    def method(name: str, params: str, start: int, open_at: int, who: str) -> Node:
        end = _block_end(bare, open_at)
        body = bare[open_at:end]
        complexity = 1 + len(re.findall(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?(?![.?:])", body))
        return _node(path, package, "method", language, line(start), line(end), type_name=who, method_name=name, cyclomatic_complexity=complexity, parameter_count=_commas(params), return_count=len(re.findall(r"\breturn\b", body)), is_private=name.startswith(("_", "#")))

    for m in re.finditer(r"\bfunction\s*\*?\s+(\w+)\s*(?:<[^>]*>)?\(([^)]*)\)[^{;]*\{", bare):
        yield method(m[1], m[2], m.start(), m.end() - 1, "")
    for m in re.finditer(r"\b(?:const|let|var)\s+(\w+)[^=\n]*=\s*(?:async\s*)?\(?([^)=]*)\)?[^=\n]*=>\s*\{", bare):
        yield method(m[1], m[2], m.start(), m.end() - 1, "")
    for name, _, begin, end in classes:
        for m in re.finditer(r"(?m)^[ \t]*(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*(#?\w+)\s*(?:<[^>]*>)?\(([^)]*)\)[^{;\n]*\{", bare[begin:end]):
            if m[1] not in ("if", "for", "while", "switch", "catch", "function", "return"):
                yield method(m[1], m[2], begin + m.start(1), begin + m.end() - 1, name)


EXTRACTORS: dict[str, Callable[[str, str], Iterator[Node]]] = {
    "python": extract_python,
    "go": extract_go,
    "java": extract_java,
    "javascript": lambda p, t: extract_script(p, t, "javascript"),
    "typescript": lambda p, t: extract_script(p, t, "typescript"),
}


def register(language: str, extractor: Callable[[str, str], Iterator[Node]]) -> None:
    """Adds an extractor, or puts another in place of one."""
    EXTRACTORS[language] = extractor


def extract(texts: DataFrame) -> DataFrame:
    """Nodes of (file_path, language, text) rows with a registered extractor."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out, extractors = to_arrow_schema(_parse_datatype_string(SCHEMA)), dict(EXTRACTORS)

    def run(batches: Any) -> Any:
        for batch in batches:
            for b in steps(batch, "text"):
                rows: list[Node] = []
                for path, language, text in zip(*(b.column(c).to_pylist() for c in ("file_path", "language", "text"))):
                    try:
                        rows += extractors[language](path, text or "")
                    except Exception:  # noqa: BLE001, S112: whatever a file holds, the others go on
                        continue
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    return texts.where(F.col("language").isin(*extractors)).select("file_path", "language", "text").mapInArrow(run, SCHEMA)


MARKDOWN = "file_path string, heading string, node_type string, name string, start_line int"
FENCE, HEADING = re.compile(r"\s*```(\w*)", re.A), re.compile(r"#{1,6}\s+(?=\S)", re.A)


def markdown_nodes(path: str | None, text: str) -> Iterator[Node]:
    heading, fenced = "", False
    for at, raw in enumerate(text.split("\n"), 1):
        if m := FENCE.match(raw):
            fenced = not fenced
            if fenced:
                yield {"file_path": path, "heading": heading, "node_type": "method", "name": f"code_{m[1] or 'text'}_{at}", "start_line": at}
        elif not fenced and (m := HEADING.match(raw)):
            heading = raw[m.end() :].strip(" ")
            yield {"file_path": path, "heading": heading, "node_type": "type", "name": heading, "start_line": at}


def markdown(texts: DataFrame) -> DataFrame:
    """file_path, heading, node_type, name, start_line: headings as types, fenced blocks as methods
    `code_<language>_<line>` below the heading before them. Each row is a text of its own, even if several
    have one path."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(MARKDOWN))

    def run(batches: Any) -> Any:
        for batch in batches:
            for b in steps(batch, "text"):
                paths, found = b.column("file_path").to_pylist(), b.column("text").to_pylist()
                yield pa.RecordBatch.from_pylist([n for path, text in zip(paths, found) if text is not None for n in markdown_nodes(path, text)], schema=out)

    return texts.select("file_path", "text").mapInArrow(run, MARKDOWN)


def openapi(texts: DataFrame) -> DataFrame:
    """Nodes of OpenAPI JSON documents: schemas are types, properties fields, operations methods.
    Documents without `openapi`, a title, a version or paths give none."""
    doc = "struct<openapi:string,info:struct<title:string,version:string>,paths:map<string,map<string,struct<operationId:string,parameters:array<struct<name:string>>,requestBody:string>>>,components:struct<schemas:map<string,struct<properties:map<string,struct<type:string>>>>>>"
    d = texts.select("file_path", F.from_json("text", doc).alias("d")).where("d.openapi IS NOT NULL AND d.info.title IS NOT NULL AND d.info.version IS NOT NULL AND size(d.paths) > 0")
    version = F.concat(F.lit("v"), F.replace(F.col("d.info.version"), F.lit("."), F.lit("_")))
    base = d.select("file_path", F.coalesce(F.nullif(version, F.lit("v")), F.lit("api")).alias("package_name"), "d")
    schemas = base.select("file_path", "package_name", F.explode("d.components.schemas").alias("type_name", "s"))
    none = F.lit("")
    types = schemas.select("file_path", "package_name", "type_name", none.alias("method_name"), none.alias("field_name"), F.lit("type_http_schema").alias("node_type"), F.lit(0).alias("parameter_count"))
    fields = schemas.select("file_path", "package_name", "type_name", F.explode("s.properties").alias("field_name", "p")).select("file_path", "package_name", "type_name", none.alias("method_name"), "field_name", F.lit("field").alias("node_type"), F.lit(0).alias("parameter_count"))
    ops = base.select("file_path", "package_name", F.explode("d.paths").alias("url", "verbs")).select("file_path", "package_name", "url", F.explode("verbs").alias("verb", "o"))
    count = F.coalesce(F.size("o.parameters"), F.lit(0)) + F.col("o.requestBody").isNotNull().cast("int")
    methods = ops.select("file_path", "package_name", F.col("url").alias("type_name"), F.coalesce("o.operationId", F.concat("verb", F.lit(" "), "url")).alias("method_name"), none.alias("field_name"), F.concat(F.lit("method_http_"), F.lower("verb")).alias("node_type"), F.greatest(count, F.lit(0)).alias("parameter_count"))
    return types.unionByName(fields).unionByName(methods)


def sql_schema(spark: Any, columns: DataFrame, foreign_keys: DataFrame, enums: DataFrame | None = None, indexes: DataFrame | None = None, procedures: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a database, from rows as an information schema has them: columns (schema, table, kind,
    column, type), foreign keys (schema, table, column, to_table, to_column), enums (schema, enum, value),
    indexes (schema, table, index) and procedures (schema, name). Tables, views and enums are types, columns and
    enum values fields, indexes methods of their table and procedures methods. parent_id is the node of
    the table, view or enum that a node belongs to."""
    none = F.lit("")

    def made(rows: DataFrame, kind: Any, type_name: Any = none, method: Any = none, field: Any = none) -> DataFrame:
        return rows.select(F.concat(F.lit("sql://"), "schema").alias("file_path"), F.col("schema").alias("package_name"), type_name.alias("type_name"), method.alias("method_name"), field.alias("field_name"), kind.alias("node_type"))

    tables = made(columns.select("schema", "table", "kind").distinct(), F.concat(F.lit("type_"), "kind"), F.col("table"))
    nodes = tables.unionByName(made(columns, F.lit("field_column"), F.col("table"), field=F.col("column")))
    if enums is not None:
        nodes = nodes.unionByName(made(enums.select("schema", "enum").distinct(), F.lit("type"), F.col("enum"))).unionByName(made(enums, F.lit("field"), F.col("enum"), field=F.col("value")))
    if indexes is not None:
        nodes = nodes.unionByName(made(indexes, F.lit("method"), F.col("table"), F.col("index")))
    if procedures is not None:
        nodes = nodes.unionByName(made(procedures, F.lit("method"), method=F.col("name")))
    key = lambda t, m, f: F.xxhash64(F.concat(F.lit("sql://"), "schema"), t, m, f)
    owned = (F.col("type_name") != "") & ((F.col("method_name") != "") | (F.col("field_name") != ""))
    nodes = nodes.withColumn("id", F.xxhash64("file_path", "type_name", "method_name", "field_name")).withColumn("parent_id", F.when(owned, F.xxhash64("file_path", "type_name", none, none)))
    edges = foreign_keys.select(key(F.col("table"), none, F.col("column")).alias("from_ast_id"), key(F.col("to_table"), none, F.col("to_column")).alias("_to"), F.lit("foreign_key").alias("relationship_type"))
    known = nodes.select(F.col("id").alias("_to"), F.col("id").alias("to_ast_id"))
    return nodes, edges.join(known, "_to", "left").drop("_to")
