"""Summaries and renderings over nodes and violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.nodes import full_name
from loomgraph.functions.patterns import infer_language


def overview(nodes: DataFrame, folder: str = "") -> DataFrame:
    """Counts by node type and their total."""
    found = nodes.where(F.col("file_path").startswith(folder)) if folder else nodes
    return found.rollup("node_type").agg(F.count("*").alias("n")).select(F.coalesce("node_type", F.lit("total")).alias("node_type"), "n")


def sources(nodes: DataFrame, folder: str = "") -> DataFrame:
    """Counts by detected language, virtual sources always included."""
    path = F.col("file_path")
    kept = nodes.where(path.startswith(folder) | path.contains("://")) if folder else nodes
    return kept.groupBy(F.coalesce(infer_language(path), F.lit("other")).alias("language")).agg(F.count("*").alias("n"))


def cache_stats(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("nodes"), F.count_distinct("file_path").alias("files"), F.max("last_modified").alias("last_modified"))


def analysis_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    method = F.when(F.col("node_type") == "method", F.col("cyclomatic_complexity"))
    top = nodes.agg(
        F.count_distinct("file_path").alias("files"), F.count("*").alias("nodes"), F.count_if(F.col("node_type") == "method").alias("methods"), F.count_if(F.col("node_type") == "type").alias("types"),
        F.coalesce(F.avg(method), F.lit(0.0)).alias("avg_complexity"), F.coalesce(F.max(method), F.lit(0)).alias("max_complexity"),
    )
    return top.join(edges.agg(F.count("*").alias("edges")), F.lit(True))  # one row each


def file_counts(nodes: DataFrame, edges: DataFrame, library_edges: DataFrame) -> DataFrame:
    """Per file the nodes of each type, edges and library edges. Edges are counted by node before the join."""
    out = edges.groupBy(F.col("from_ast_id").alias("id")).agg(F.count("*").alias("e"))
    libs = library_edges.groupBy(F.col("ast_id").alias("id")).agg(F.count("*").alias("l"))
    kinds = [F.count_if(F.col("node_type") == t).alias(t + "s") for t in ("method", "type", "field", "variable")]
    joined = nodes.select("id", "file_path", "node_type").join(out, "id", "left").join(libs, "id", "left")
    return joined.groupBy("file_path").agg(*kinds, F.coalesce(F.sum("e"), F.lit(0)).alias("edges"), F.coalesce(F.sum("l"), F.lit(0)).alias("libraries"))


def complex_nodes(nodes: DataFrame, least: int) -> DataFrame:
    return nodes.where(F.col("cyclomatic_complexity") >= least).orderBy(F.desc("cyclomatic_complexity"), "id")


def query_summary(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("matches"), F.count_distinct("file_path").alias("files"), F.count_distinct(F.nullif("package_name", F.lit(""))).alias("packages"))


def locations(nodes: DataFrame, workdir: str = "") -> DataFrame:
    """file:line, name and line range of each node."""
    return nodes.select("id", F.concat(relative(F.col("file_path"), workdir), F.lit(":"), F.col("start_line")).alias("location"), full_name().alias("name"), F.when(F.col("end_line") > F.col("start_line"), F.concat("start_line", F.lit("-"), "end_line")).otherwise(F.col("start_line").cast("string")).alias("lines"))


def relative(path: Column, workdir: str) -> Column:
    prefix = workdir.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path) if workdir else path


def by_file(violations: DataFrame) -> DataFrame:
    return violations.groupBy("file_path").agg(F.count("*").alias("n"), F.count_distinct("rule").alias("rules"))


def by_source(violations: DataFrame, default: str = "import-rules") -> DataFrame:
    return violations.groupBy(F.coalesce(F.nullif("source", F.lit("")), F.lit(default)).alias("source")).agg(F.count("*").alias("n"))


def tree(violations: DataFrame) -> DataFrame:
    """Totals of every folder, rolled up to its ancestors. Violations are counted per file first, so
    that only files, not violations, are exploded into their ancestors."""
    files = violations.groupBy("file_path").agg(F.count("*").alias("n"))
    parts = F.split("file_path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return files.select(F.explode(ancestors).alias("folder"), "n").groupBy("folder").agg(F.sum("n").alias("n"), F.count("*").alias("files"))


def compact(violations: DataFrame) -> DataFrame:
    """Per file its rules as `rule×n`, sorted."""
    counted = violations.groupBy("file_path", "rule").agg(F.count("*").alias("n"))
    return counted.groupBy("file_path").agg(F.array_join(F.sort_array(F.collect_list(F.concat("rule", F.lit("×"), "n"))), ", ").alias("rules"))


def fixable(violations: DataFrame) -> DataFrame:
    return violations.agg(F.count("*").alias("total"), F.count_if("fixable").alias("fixable"), F.count_if(F.col("fixable") & (F.col("fix_applicability") == "unsafe")).alias("unsafe"))


def consolidated(violations: DataFrame) -> DataFrame:
    origin = F.coalesce(F.nullif("source", F.lit("")), F.lit("import-rules"))
    return violations.agg(F.count_distinct("file_path").alias("files"), F.count_distinct("rule").alias("rules"), F.count_distinct(origin).alias("linters"), F.count_if(origin == "import-rules").alias("own"), F.count_if(origin != "import-rules").alias("external"))


def json_lines(violations: DataFrame) -> DataFrame:
    """part, id, line: the document {"summary": ..., "violations": [...]} as lines in the order of part and
    the violation (file, line, rule, message, id): a head, one line for each violation and an end. No row
    holds more than one violation; all but the first start with a comma."""
    place = F.struct("file_path", "line", "rule", "message", "id")
    top = violations.agg(F.count("*").alias("total"), F.min(place).alias("least"))
    head = top.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("id"), F.concat(F.lit('{"summary":'), F.to_json(F.struct("total")), F.lit(',"violations":[')).alias("line"))
    told = violations.join(F.broadcast(top), F.lit(True))  # one row
    comma = F.when(place == F.col("least"), "").otherwise(",")
    rows = told.select(F.lit(1).alias("part"), "id", F.concat(comma, F.to_json(F.struct("file_path", "line", "rule", "message"))).alias("line"))
    end = top.select(F.lit(2).alias("part"), F.lit(0).cast("long").alias("id"), F.lit("]}").alias("line"))
    return head.unionByName(rows).unionByName(end)


def html_lines(violations: DataFrame) -> DataFrame:
    """part, id, line: an HTML table as lines, a head, one row for each violation, and an end."""
    cell = lambda c: F.concat(F.lit("<td>"), escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>"))
    names = ("file_path", "line", "rule", "message")
    one = violations.sparkSession.range(1)
    fixed = lambda part, text: one.select(F.lit(part).alias("part"), F.lit(0).cast("long").alias("id"), F.lit(text).alias("line"))
    rows = violations.select(F.lit(1).alias("part"), "id", F.concat(F.lit("<tr>"), *map(cell, names), F.lit("</tr>")).alias("line"))
    titles = "".join(f"<th>{n}</th>" for n in ("File", "Line", "Rule", "Message"))
    return fixed(0, f"<table><tr>{titles}</tr>").unionByName(rows).unionByName(fixed(2, "</table>"))


def escaped(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def by_category(rows: DataFrame, column: str, default: str = "") -> DataFrame:
    """Rows by a category column, blank ones under the default."""
    return rows.groupBy(F.coalesce(F.nullif(column, F.lit("")), F.lit(default)).alias(column)).agg(F.count("*").alias("n"))


def csv_lines(violations: DataFrame) -> DataFrame:
    """CSV records, quoted where needed."""
    quoted = lambda c: F.when(F.col(c).cast("string").rlike('[",\n]'), F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c).cast("string"))
    return violations.select("id", F.concat_ws(",", *[F.coalesce(quoted(c), F.lit("")) for c in ("file_path", "line", "col", "rule", "message")]).alias("record"))


def markdown_lines(violations: DataFrame) -> DataFrame:
    cell = lambda c: F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|"))
    return violations.select("id", F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(cell(c), F.lit("")) for c in ("file_path", "line", "rule", "message")]), F.lit(" |")).alias("record"))


def template(nodes: DataFrame, text: str) -> DataFrame:
    """`{{.Field}}` templates over nodes."""
    import re

    fields = {"Package": "package_name", "Type": "type_name", "Method": "method_name", "Field": "field_name", "File": "file_path", "StartLine": "start_line", "EndLine": "end_line", "NodeType": "node_type", "Complexity": "cyclomatic_complexity", "Lines": "line_count", "Params": "parameter_count", "Returns": "return_count", "Language": "language"}
    parts = []
    for piece in re.split(r"(\{\{\.\w+\}\})", text):
        m = re.fullmatch(r"\{\{\.(\w+)\}\}", piece)
        if m and m[1] not in fields:
            raise ValueError(f"unknown field {m[1]}")
        parts.append(F.col(fields[m[1]]).cast("string") if m else F.lit(piece))
    return nodes.select("id", F.concat(*parts).alias("line"))


def hierarchy(nodes: DataFrame) -> DataFrame:
    """Children per parent node, each list in line order."""
    kids = nodes.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "id"))), lambda s: s["id"]).alias("children"))
    return kids.select("parent_id", F.size("children").alias("n_children"), F.array_join(F.transform("children", lambda c: c.cast("string")), ",").alias("children"))


def display_tree(nodes: DataFrame, workdir: str = "", dirs: bool = True, files: bool = True, packages: bool = True) -> DataFrame:
    """kind, key, parent, n: the levels of a tree of folders, files, packages (of a file) and nodes, with the
    number of nodes below each. Hidden levels are left out and what is below them moves up to the next level
    shown, or to the top (parent null). Virtual files have no folders, those of databases no packages. Nodes are
    counted per file and package before these are exploded into their levels."""
    path = relative(F.col("file_path"), workdir)
    virtual = path.contains("://")
    parts = F.split(F.ltrim(path, F.lit("/")), "/")
    level = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    none = F.array().cast("array<struct<kind:string,key:string>>")
    folders = F.when(virtual | (F.size(parts) < 2), none).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: level("folder", F.array_join(F.slice(parts, F.lit(1), k), "/"))))
    named = F.when(path.startswith("sql://") | (F.col("package_name") == ""), none).otherwise(F.array(level("package", F.concat(path, F.lit("#"), "package_name"))))
    shown = F.concat(*[x for x, on in ((folders, dirs), (F.array(level("file", path)), files), (named, packages)) if on] or [none])
    parent = lambda i: F.when(i > 0, F.get("levels", i - 1)["key"])
    groups = nodes.groupBy("file_path", "package_name").agg(F.count("*").alias("n")).withColumn("levels", shown)
    above = groups.select(F.explode(F.transform("levels", lambda x, i: F.struct(x["kind"].alias("kind"), x["key"].alias("key"), parent(i).alias("parent")))).alias("l"), "n").groupBy("l.kind", "l.key", "l.parent").agg(F.sum("n").alias("n"))
    leaves = nodes.withColumn("levels", shown).select(F.lit("node").alias("kind"), F.col("id").cast("string").alias("key"), parent(F.size("levels")).alias("parent"), F.lit(1).cast("long").alias("n"))
    return above.unionByName(leaves)


def sample_types(nodes: DataFrame, most: int = 5) -> DataFrame:
    """node_type, n: counts over the nodes in the order of ids up to the first of the `most`-th type that
    occurs; over all nodes if there are fewer types. Only the types' first ids are ordered."""
    first = nodes.groupBy("node_type").agg(F.min("id").alias("first"))
    last = first.orderBy("first").limit(most).agg(F.when(F.count("*") == most, F.max("first")).alias("last"))
    kept = nodes.join(F.broadcast(last), F.col("last").isNull() | (F.col("id") <= F.col("last")))  # one row
    return kept.groupBy("node_type").agg(F.count("*").alias("n"))
