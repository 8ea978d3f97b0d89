"""The registry of languages: a lookup table of names, extensions and whether nodes can be extracted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES: dict[str, tuple[str, ...]] = {
    "go": ("go",), "python": ("py", "pyw", "pyi"), "javascript": ("js", "jsx", "mjs", "cjs"), "typescript": ("ts", "tsx", "mts", "cts"),
    "markdown": ("md", "markdown", "mdx"), "yaml": ("yaml", "yml"), "json": ("json", "jsonc"), "rust": ("rs",), "java": ("java",),
    "c": ("c", "h"), "cpp": ("cpp", "cc", "cxx", "hpp", "hh", "hxx"),
}


def register(name: str, *extensions: str) -> None:
    """Adds a language, or puts another in place of one; of an extension the language registered last counts."""
    LANGUAGES.pop(name, None)
    LANGUAGES[name] = extensions


def by_extension() -> dict[str, str]:
    return {e: name for name, extensions in LANGUAGES.items() for e in extensions}


def frame(spark: SparkSession) -> DataFrame:
    """extension, language: a table of a few rows, which Spark broadcasts."""
    return spark.createDataFrame(sorted(by_extension().items()), "extension string, language string")


def of_path(path: Column) -> Column:
    """The language by a path's extension, or null."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.create_map(*[F.lit(x) for pair in by_extension().items() for x in pair])[extension]
