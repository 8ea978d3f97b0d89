"""Call graphs: induced sub-graphs, roots, bounded search, trees and renderings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.nodes import full_name


def induced(edges: DataFrame, ids: DataFrame, kind: str | None = "call") -> DataFrame:
    """Edges with both ends among the ids; parallel edges stay."""
    kept = ids.select("id").distinct()
    found = edges.where(F.col("relationship_type") == kind) if kind else edges
    found = found.join(kept.select(F.col("id").alias("from_ast_id")), "from_ast_id", "left_semi")
    return found.join(kept.select(F.col("id").alias("to_ast_id")), "to_ast_id", "left_semi")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that none of the nodes calls; one that calls itself is no root."""
    called = induced(edges, nodes).select(F.col("to_ast_id").alias("id"))
    return nodes.join(called, "id", "left_anti")


def reachable(edges: DataFrame, start: DataFrame, depth: int, checkpoint: bool = True) -> DataFrame:
    """id, depth: breadth-first from the start ids, level by level, at most depth levels down.
    Each level's new ids are checkpointed in the shared folder, so the plan stays flat."""
    spark = edges.sparkSession
    links = edges.where("relationship_type = 'call' AND to_ast_id IS NOT NULL").select(F.col("from_ast_id").alias("id"), F.col("to_ast_id").alias("next")).distinct()
    if checkpoint:
        _checkpoint_dir(spark)
    level = start.select("id").distinct().withColumn("depth", F.lit(0))
    seen = level
    for d in range(1, depth + 1):
        level = level.join(links, "id").select(F.col("next").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d))
        if checkpoint:
            level = level.checkpoint()
            if level.isEmpty():
                break
        seen = seen.union(level)
    return seen


def _checkpoint_dir(spark) -> None:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        import os
        import tempfile

        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or "file://" + os.path.join(tempfile.gettempdir(), "loomgraph-shared"))


def call_paths(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """path array<bigint>, depth, circular: every call path from the start ids, up to depth calls, for
    renderings of trees; there may be as many as the depth-th power of the calls of a node. A path that comes
    back to one of its own nodes ends there and is marked. Each level is checkpointed, so the plan stays flat."""
    _checkpoint_dir(edges.sparkSession)
    links = edges.where("relationship_type = 'call' AND to_ast_id IS NOT NULL").select(F.col("from_ast_id").alias("_from"), F.col("to_ast_id").alias("_to")).distinct()
    level = start.select(F.array("id").alias("path"), F.lit(0).alias("depth"), F.lit(False).alias("circular"))
    out = level
    for d in range(1, depth + 1):
        open_paths = level.where("NOT circular").withColumn("_from", F.element_at("path", -1))
        level = open_paths.join(links, "_from").select(F.array_append("path", F.col("_to")).alias("path"), F.lit(d).alias("depth"), F.array_contains("path", F.col("_to")).alias("circular")).checkpoint()
        if level.isEmpty():
            break
        out = out.union(level)
    return out


def dot_lines(nodes: DataFrame, edges: DataFrame, library_edges: DataFrame | None = None, library_nodes: DataFrame | None = None) -> DataFrame:
    """Lines of a DOT rendering: nodes, then edges, each as text; with the library tables also each
    library that the nodes use, once by its full name under its least id, and the edges to them."""
    points = nodes.select(F.lit(0).alias("part"), "id", F.format_string('  n%d [label="%s"];', F.col("id"), full_name()).alias("line"))
    arrows = induced(edges, nodes).select(F.lit(1).alias("part"), "id", F.format_string("  n%d -> n%d;", F.col("from_ast_id"), F.col("to_ast_id")).alias("line"))
    if library_edges is None or library_nodes is None:
        return points.union(arrows)
    name = F.concat_ws(".", *[F.nullif(F.col(c), F.lit("")) for c in ("package", "class", "method", "field")])
    used = library_edges.select("id", "ast_id", "library_id").join(nodes.select(F.col("id").alias("ast_id")).distinct(), "ast_id", "left_semi").join(library_nodes.select(F.col("id").alias("library_id"), name.alias("name")), "library_id")
    label = F.replace(F.col("name"), F.lit('"'), F.lit('\\"'))
    boxes = used.groupBy("name").agg(F.min("library_id").alias("id")).select(F.lit(2).alias("part"), "id", F.format_string('  "lib_%s" [label="%s", style="filled,rounded", fillcolor=lightblue];', "name", label).alias("line"))
    calls = used.select(F.lit(3).alias("part"), "id", F.format_string('  n%d -> "lib_%s";', "ast_id", "name").alias("line"))
    return points.union(arrows).union(boxes).union(calls)


def counts(nodes: DataFrame, edges: DataFrame, library_edges: DataFrame) -> DataFrame:
    """The JSON rendering's four counts."""
    sizes = [("nodes", nodes), ("edges", induced(edges, nodes)), ("roots", roots(nodes, edges)), ("libraries", library_edges.join(nodes.select(F.col("id").alias("ast_id")), "ast_id", "left_semi").select("library_id").distinct())]
    out = None
    for name, df in sizes:
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = row if out is None else out.union(row)
    return out


def dependency_walk(manifest: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """name, depth: transitive dependencies over (parent, child), each at its least depth. Levels are
    checkpointed, and the walk ends where a level finds nothing new."""
    _checkpoint_dir(manifest.sparkSession)
    links = manifest.select(F.col("parent").alias("name"), F.col("child").alias("next")).distinct()
    level = roots.select("name").distinct().withColumn("depth", F.lit(0))
    seen = level
    for d in range(1, depth + 1):
        level = level.join(links, "name").select(F.col("next").alias("name")).distinct().join(seen.select("name"), "name", "left_anti").withColumn("depth", F.lit(d)).checkpoint()
        if level.isEmpty():
            break
        seen = seen.union(level)
    return seen


def cycles(edges: DataFrame, depth: int) -> DataFrame:
    """An extension: nodes on a call cycle of at most depth calls. The frontier holds pairs of a start and a
    node that it reaches, each once however many paths there are between them; nodes that nothing calls, or that
    call nothing, start none."""
    _checkpoint_dir(edges.sparkSession)
    links = edges.where("relationship_type = 'call' AND to_ast_id IS NOT NULL").select(F.col("from_ast_id").alias("id"), F.col("to_ast_id").alias("next")).distinct()
    links = links.join(links.select(F.col("id").alias("next")).distinct(), "next", "left_semi").select("id", "next")
    links = links.join(links.select(F.col("next").alias("id")).distinct(), "id", "left_semi").checkpoint()
    level = links.select(F.col("id").alias("start"), F.col("next").alias("id"))
    seen, found = level, level.where("start = id").select("start")
    for _ in range(depth - 1):
        level = level.where("start <> id").join(links, "id").select("start", F.col("next").alias("id")).distinct()
        level = level.join(seen, ["start", "id"], "left_anti").checkpoint()
        if level.isEmpty():
            break
        seen, found = seen.union(level), found.union(level.where("start = id").select("start"))
    return found.select(F.col("start").alias("id")).distinct()
