"""File discovery and source text access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.patterns import include_exclude, infer_language

SKIPPED = ("vendor", "node_modules", "__pycache__")
SKIPPED_BY_COORDINATOR = (*SKIPPED, "venv", "target", "dist", "build")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, modificationTime, length, content of every file below root; content is read only if it is used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def visible(path: Column, skipped: tuple[str, ...] = SKIPPED) -> Column:
    """No part of the path begins with a dot or is a skipped folder."""
    return ~path.rlike(r"(^|/)(\.[^/]+|" + "|".join(skipped) + r")(/|$)")


def source_files(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, workdir: str = "", skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """file_path, language of the files that have a known language and pass the globs."""
    found = files.where(visible(F.col("file_path"), skipped)).withColumn("language", infer_language(F.col("file_path"))).where("language IS NOT NULL")
    return found.where(include_exclude(F.col("file_path"), include or [], exclude or [], workdir)) if include or exclude else found


def languages(files: DataFrame) -> DataFrame:
    return files.select(infer_language(F.col("file_path")).alias("language")).where("language IS NOT NULL").distinct()


def by_language(files: DataFrame) -> DataFrame:
    return source_files(files).groupBy("language").agg(F.count("*").alias("n_files"))


def lines(texts: DataFrame) -> DataFrame:
    """file_path, line (from one), text."""
    return texts.select("file_path", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def lines_at(texts: DataFrame, points: DataFrame) -> DataFrame:
    """The text of each (file_path, line), without exploding the files."""
    met = points.join(texts, "file_path")
    return met.select("file_path", "line", F.get(F.split("text", "\n"), F.col("line") - 1).alias("text"))


def view(texts: DataFrame, nodes: DataFrame, context: int = 2) -> DataFrame:
    """id, first_line, source: each node's lines with some around, clamped to the file."""
    all_lines = F.split("text", "\n")
    last = F.greatest(F.col("end_line"), F.col("start_line"))
    first = F.greatest(F.lit(1), F.col("start_line") - context)
    size = F.least(F.size(all_lines), last + context) - first + 1
    met = nodes.select("id", "file_path", "start_line", "end_line").join(texts, "file_path").where(F.col("start_line") <= F.size(all_lines))
    return met.select("id", first.alias("first_line"), F.array_join(F.slice(all_lines, first, size), "\n").alias("source"))
