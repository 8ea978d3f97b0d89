"""The violation and node stores: Parquet, merged per file without a MERGE-capable format.

Rows are spread over hash buckets of the file path, and a write replaces the touched buckets only
(dynamic partition overwrite), each rewritten from a checkpointed merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.nodes import NATURAL_KEY
from loomgraph.functions.patterns import file_glob

BUCKETS = 64
LIBRARY_KEY = ("package", "class", "method", "field")


def needs_analysis(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files without metadata, or whose hash differs."""
    return files.join(known.select("file_path", "file_hash"), ["file_path", "file_hash"], "left_anti")


def needs_rescan(files: DataFrame, scans: DataFrame) -> DataFrame:
    """Never scanned, modified since, or with another hash."""
    old = scans.select("file_path", F.col("last_modified").alias("_at"), F.col("file_hash").alias("_hash"))
    met = files.join(old, "file_path", "left")
    return met.where(F.col("_at").isNull() | (F.col("mod_time") > F.col("_at")) | (F.col("file_hash") != F.col("_hash"))).drop("_at", "_hash")


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The nodes after re-analysis of the files in `new`: keys that stay keep their ids and take the
    new data, keys that are gone go, other files stay. New nodes get ids from their key."""
    files = new.select("file_path").distinct()
    ids = old.groupBy(*NATURAL_KEY).agg(F.min("id").alias("_id"))
    merged = new.join(ids, list(NATURAL_KEY), "left").withColumn("id", F.coalesce("_id", F.xxhash64(*NATURAL_KEY))).drop("_id")
    return old.join(files, "file_path", "left_anti").unionByName(merged)


def delete_file(nodes: DataFrame, edges: DataFrame, path: str, library_edges: DataFrame | None = None) -> tuple[DataFrame, ...]:
    """Nodes without a file's, edges without those that touch it and, if given, library edges without
    those from it."""
    gone = nodes.where(F.col("file_path") == path).select("id")
    left = edges.join(gone.select(F.col("id").alias("from_ast_id")), "from_ast_id", "left_anti").join(gone.select(F.col("id").alias("to_ast_id")), "to_ast_id", "left_anti")
    kept = nodes.where(~F.col("file_path").eqNullSafe(F.lit(path)))
    if library_edges is None:
        return kept, left
    return kept, left, library_edges.join(gone.select(F.col("id").alias("ast_id")), "ast_id", "left_anti")


def replace_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges after a merge: those from re-analysed nodes are replaced, those at vanished nodes go."""
    rebuilt = new.select("from_ast_id").distinct()
    united = old.join(rebuilt, "from_ast_id", "left_anti").unionByName(new)
    ids = nodes.select("id")
    united = united.join(ids.select(F.col("id").alias("from_ast_id")), "from_ast_id", "left_semi")
    gone = united.where("to_ast_id IS NOT NULL").select("to_ast_id").distinct().join(ids.select(F.col("id").alias("to_ast_id")), "to_ast_id", "left_anti")
    return united.join(gone, "to_ast_id", "left_anti")


def merge_libraries(libraries: DataFrame, edges: DataFrame, new_libraries: DataFrame, new_edges: DataFrame, before: DataFrame, after: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Library nodes and edges after re-analysis of the files, whose nodes were `before` and are `after`
    the merge. New libraries of a known key take its least id, others get one from their key, and none
    goes; the files' old library edges go, new ones follow their library's id if their node is there."""
    key = list(LIBRARY_KEY)
    ids = libraries.groupBy(*key).agg(F.min("id").alias("_known"))
    placed = new_libraries.join(ids, key, "left").withColumn("_id", F.coalesce("_known", F.xxhash64(*key)))
    added = placed.where("_known IS NULL").withColumn("id", F.col("_id")).select(libraries.columns).dropDuplicates(["id"])
    gone = before.join(files.select("file_path").distinct(), "file_path", "left_semi").select(F.col("id").alias("ast_id"))
    moved = new_edges.join(placed.select(F.col("id").alias("library_id"), "_id"), "library_id").withColumn("library_id", F.col("_id")).select(edges.columns)
    moved = moved.join(after.select(F.col("id").alias("ast_id")), "ast_id", "left_semi")
    return libraries.unionByName(added), edges.join(gone, "ast_id", "left_anti").unionByName(moved)


def merge_file_results(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables nodes, edges, libraries, library_edges and metadata after files were analysed anew. `new` holds
    what the analysis found, its metadata naming the files, also those that have no nodes now; ids of its nodes
    are its own, and its edges use them (an end that isn't among them is an id of the old tables). Nodes whose
    natural key stays keep their ids and take the new data, others get an id from their key, and those that
    are gone take the edges at them along. Edges and library edges of the files are replaced, library nodes are
    matched by key, metadata rows replaced."""
    files = new["metadata"].select("file_path").distinct()
    key = list(NATURAL_KEY)
    known = old["nodes"].join(files, "file_path", "left_semi").groupBy(*key).agg(F.min("id").alias("_known"))
    placed = new["nodes"].join(known, key, "left").withColumn("_id", F.coalesce("_known", F.xxhash64(*key)))
    ids = placed.select(F.col("id").alias("_new"), "_id")
    merged = placed.withColumn("id", F.col("_id")).select(old["nodes"].columns).dropDuplicates(["id"])
    nodes = old["nodes"].join(files, "file_path", "left_anti").unionByName(merged)

    def moved(rows: DataFrame, column: str) -> DataFrame:
        return rows.join(ids.withColumnRenamed("_new", column), column, "left").withColumn(column, F.coalesce("_id", column)).drop("_id")

    before = old["nodes"].join(files, "file_path", "left_semi").select("id")
    rest = old["edges"].join(before.select(F.col("id").alias("from_ast_id")), "from_ast_id", "left_anti")
    edges = rest.unionByName(moved(moved(new["edges"], "from_ast_id"), "to_ast_id").select(old["edges"].columns))
    vanished = before.join(merged.select("id"), "id", "left_anti")
    edges = edges.join(vanished.select(F.col("id").alias("to_ast_id")), "to_ast_id", "left_anti")
    libraries, library_edges = merge_libraries(old["libraries"], old["library_edges"], new["libraries"], moved(new["library_edges"], "ast_id"), old["nodes"], nodes, files)
    return {"nodes": nodes, "edges": edges, "libraries": libraries, "library_edges": library_edges, "metadata": upsert(old["metadata"], new["metadata"], ["file_path"])}


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def replace_violations(old: DataFrame, new: DataFrame, scanned: DataFrame) -> DataFrame:
    """A tool's rows for the files that it scanned (file_path, source) are replaced, clean files' included."""
    return old.join(scanned.select("file_path", "source").distinct(), ["file_path", "source"], "left_anti").unionByName(new)


def select(violations: DataFrame, since: Column | None = None, glob: str = "", sources: list[str] | None = None) -> DataFrame:
    out = violations
    if since is not None:
        out = out.where(F.col("stored_at") >= since)
    if glob:
        out = out.where(file_glob(F.col("file_path"), glob))
    return out.where(F.col("source").isin(sources)) if sources else out


def clear(violations: DataFrame, before: Column | None = None, glob: str = "") -> DataFrame:
    """What is left when rows older than a time, and of a glob's files, are cleared (both: only rows that are both)."""
    gone = F.lit(True)
    if before is not None:
        gone = gone & (F.col("stored_at") < before)
    if glob:
        gone = gone & file_glob(F.col("file_path"), glob)
    return violations.where(~gone)


class BucketedStore:
    """A table on disk that is merged by file."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("file_path"), F.lit(self.buckets)).cast("int"))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def create(self, df: DataFrame) -> None:
        self._placed(df).repartition("bucket").write.partitionBy("bucket").parquet(self.path)

    def replace_files(self, new: DataFrame, files: DataFrame) -> None:
        """Replaces the rows of the given files; only their buckets are read and rewritten."""
        touched = [r[0] for r in self._placed(files.select("file_path")).select("bucket").distinct().collect()]  # at most `buckets` numbers
        if not touched:
            return
        old = self.spark.read.parquet(self.path).where(F.col("bucket").isin(touched))
        kept = old.join(files.select("file_path").distinct(), "file_path", "left_anti").drop("bucket")
        merged = self._placed(kept.unionByName(new)).checkpoint()
        # a bucket that is left without rows must be emptied too: one null row would be wrong, so it is deleted
        full = {r[0] for r in merged.select("bucket").distinct().collect()}
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        for b in set(touched) - full:
            p = fs_path(f"{self.path}/bucket={b}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
