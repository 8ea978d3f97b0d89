"""Line lookups, neighbourhoods and library resolution."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.nodes import full_name

#: Lines of a bucket of the range join.
BUCKET = 64
STDLIB = ("fmt", "os", "net", "io", "strings", "strconv", "encoding", "database", "time", "sync", "context", "errors", "math", "sort", "bytes", "bufio", "regexp", "path", "log", "testing", "reflect", "crypto", "html", "text", "unicode", "archive", "compress")


def nodes_at_lines(nodes: DataFrame, points: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """For each (file_path, line) the most specific node around it: the last to start, then the
    shortest, then the least id; end_line 0 means a single line. A range join: nodes are laid into
    the buckets of lines that they cover, so it is an equality join however long the file."""
    end = F.when(F.col("end_line") == 0, F.col("start_line")).otherwise(F.col("end_line"))
    spans = nodes.select("file_path", F.col("id").alias("node_id"), F.col("node_type").alias("found_type"), "start_line", end.alias("last_line")).where("last_line >= start_line")
    lo, hi = F.floor(F.col("start_line") / bucket), F.floor(F.col("last_line") / bucket)
    spans = spans.withColumn("bucket", F.explode(F.sequence(lo, hi)))
    asked = points.withColumn("bucket", F.floor(F.col("line") / bucket))
    met = asked.join(spans, ["file_path", "bucket"]).where("line between start_line and last_line")
    best = F.min(F.struct((-F.col("start_line")).alias("s"), (F.col("last_line") - F.col("start_line")).alias("span"), "node_id", "found_type"))
    return met.groupBy("file_path", "line").agg(best.alias("b")).select("file_path", "line", F.col("b.node_id").alias("node_id"), F.col("b.found_type").alias("node_type"))


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges from or to any of the nodes, each once: two equality joins, not an OR."""
    ends = edges.select("*", F.explode(F.array_distinct(F.array("from_ast_id", "to_ast_id"))).alias("_end"))
    return ends.join(ids.select(F.col("id").alias("_end")).distinct(), "_end", "left_semi").drop("_end").dropDuplicates(["id"])


def with_library(relations: DataFrame, libraries: DataFrame) -> DataFrame:
    libs = libraries.select(F.col("id").alias("library_id"), "package", "class", "method", "framework")
    return relations.join(libs, "library_id", "left")


def library_name() -> Column:
    return F.concat_ws(".", *[F.nullif(F.col(c), F.lit("")) for c in ("package", "class", "method")])


def library_info(text: Column) -> Column:
    """map of `(pkg=..;class=..;method=..;framework=..)`"""
    return F.str_to_map(F.regexp_extract(text, r"\((pkg=[^)]*)\)", 1), F.lit(";"), F.lit("="))


def is_stdlib(package: Column) -> Column:
    return ~package.contains("/") | F.split(package, "/")[0].isin(*STDLIB)


PYTHON_STDLIB = tuple(sorted(sys.stdlib_module_names))
NODE_BUILTIN = ("assert", "buffer", "child_process", "crypto", "events", "fs", "http", "https", "net", "os", "path", "process", "querystring", "stream", "url", "util", "zlib")


def resolve_module(name: Column, language: str) -> Column:
    """stdlib, relative or third-party, for the module names of Python, JavaScript and TypeScript."""
    if language == "python":
        return F.when(name.startswith("."), "relative").when(F.split(name, r"\.")[0].isin(*PYTHON_STDLIB), "stdlib").otherwise("third-party")
    bare = F.regexp_replace(name, "^node:", "")
    out = F.when(name.rlike(r"^\.{0,2}/"), "relative").when(F.split(bare, "/")[0].isin(*NODE_BUILTIN), "stdlib")
    return (out.when(name.startswith("@types/"), "types") if language == "typescript" else out).otherwise("third-party")


def resolve_library(packages: DataFrame, known: DataFrame) -> DataFrame:
    """package -> framework: the exact entry, else stdlib, else the longest known prefix, else unknown.
    A package's own path prefixes are joined by equality, so no prefix join is needed."""
    parts = F.split("package", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    asked = packages.select("package").distinct().select("package", F.explode(prefixes).alias("prefix"))
    best = asked.join(known.select(F.col("package").alias("prefix"), F.col("framework")), "prefix").groupBy("package").agg(F.max_by(F.struct("prefix", "framework"), F.length("prefix")).alias("k"))
    out = packages.select("package").distinct().join(best, "package", "left")
    exact = F.col("k.prefix") == F.col("package")
    return out.select("package", F.when(exact, F.col("k.framework")).when(is_stdlib(F.col("package")), "stdlib").when(F.col("k.framework").isNotNull(), F.col("k.framework")).otherwise("unknown").alias("framework"))


def endings(nodes: DataFrame) -> DataFrame:
    """called, part, id, name: every full name under itself, and with part true under each ending after a dot."""
    pieces = F.split("name", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, n, F.size(pieces)), "."))
    named = nodes.select("id", full_name().alias("name")).where("name <> ''")
    return named.select("id", "name", F.posexplode(tails).alias("pos", "called")).where("called <> ''").select("called", (F.col("pos") > 0).alias("part"), "id", "name")


def join_called(asked: DataFrame, found: DataFrame) -> DataFrame:
    """asked with found's columns for its `called`; found has each name once. Rows without a name are spread, not sent to one task."""
    nameless = F.coalesce(F.col("called"), F.lit("")) == ""
    spread = asked.withColumn("_spread", F.when(nameless, F.pmod(F.hash(*asked.columns), F.lit(1024)) + 1).otherwise(0))
    # not a constant, which would be no key of the join
    return spread.join(found.withColumn("_spread", F.when(nameless, -1).otherwise(0)), ["called", "_spread"], "left").drop("_spread")


def resolve_by_name(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """asked with node_id: the node whose full name is `called`, else one whose full name ends in
    `.called`, the least id of several, else null; null and empty names stay unresolved. Nodes are laid
    under each ending of their name, so it is one equality join, and both inputs are read once."""
    exact = F.min(F.when(~F.col("part"), F.col("id")))
    return join_called(asked, endings(nodes).groupBy("called").agg(F.coalesce(exact, F.min("id")).alias("node_id")))


def parents(nodes: DataFrame, kinds: tuple[str, ...] = ("method", "field")) -> DataFrame:
    """id, parent: for nodes of the kinds the type of their package and type name, the least id of several."""
    types = nodes.where("node_type = 'type' OR node_type LIKE 'type!_%' ESCAPE '!'").groupBy("package_name", "type_name").agg(F.min("id").alias("parent"))
    return nodes.where(F.col("node_type").isin(*kinds)).select("id", "package_name", "type_name").join(types, ["package_name", "type_name"]).select("id", "parent")


def references(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """id, file_path, line, what: where a name is used and defined, for renaming. The definition is the node
    of that full name, else one whose full name ends in `.name`, the least id of several."""
    named = nodes.where((full_name() == name) | full_name().endswith("." + name))
    target = resolve_by_name(nodes.sparkSession.createDataFrame([(name,)], "called string"), named).where("node_id IS NOT NULL").select(F.col("node_id").alias("target"))
    users = edges.join(target, F.col("to_ast_id") == F.col("target")).select(F.col("from_ast_id").alias("id"), F.col("line_no").alias("line"))
    used = users.join(nodes.select("id", "file_path"), "id").select("id", "file_path", "line", F.lit("reference").alias("what"))
    defined = nodes.join(target, F.col("id") == F.col("target")).select("id", "file_path", F.col("start_line").alias("line"), F.lit("definition").alias("what"))
    return used.unionByName(defined)


def first_by_key(nodes: DataFrame, key: list[str]) -> DataFrame:
    """Of repeated keys the row of least id."""
    w = Window.partitionBy(*key).orderBy("id")
    return nodes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
