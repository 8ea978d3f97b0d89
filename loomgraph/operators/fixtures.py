"""Fixtures: tables of named queries with the count and the expression that their results must meet.

A fixture file is Markdown: headings are categories, and rows of tables below them fixtures, with the
columns name, folder, query, expected count and expression in the order of the table's header. Each kind of
fixture has a runner, registered by name, that gives the nodes which a fixture selects. All fixtures of a run
are one DataFrame: count and expression are aggregates over the selected nodes.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import expressions, metric_query

COLUMNS = {"test name": "name", "cwd": "folder", "query": "query", "expected count": "count", "cel validation": "check"}
SCHEMA = "category string, name string, found long, expected long, holds boolean, passed boolean"


@dataclass(frozen=True)
class Fixture:
    name: str
    query: str
    folder: str = ""
    count: int | None = None
    check: str = ""
    category: str = ""
    kind: str = "query"


Runner = Callable[[Fixture, DataFrame, DataFrame], DataFrame]
KINDS: dict[str, Runner] = {}


def register(kind: str, runner: Runner) -> None:
    """Adds a kind of fixture; one that is there already is an error."""
    if kind in KINDS:
        raise ValueError(f"fixture kind {kind!r} is registered already")
    KINDS[kind] = runner


def _query(f: Fixture, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return metric_query.run(nodes, edges, f.query, f.folder)


def _every(f: Fixture, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All nodes below the folder; the expression alone is tested."""
    return nodes.where(F.col("file_path").startswith(f.folder.rstrip("/") + "/")) if f.folder else nodes


register("query", _query)
register("expression", _every)


def parse(text: str) -> list[Fixture]:
    """The fixtures of a Markdown text; tables without a column for the query are left out."""
    found: list[Fixture] = []
    category, header = "", []
    for line in text.split("\n"):
        if line.startswith("#"):
            category, header = line.strip("# \t"), []
        elif not line.strip().startswith("|"):
            header = []
        else:
            # a `|` of an expression is written `\|`, or doubled
            cells = [c.replace("\0", "||").replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", line.strip().replace("||", "\0"))[1:-1]]
            if not header:
                header = [COLUMNS.get(c.lower(), "") for c in cells]
            elif "query" in header and not re.fullmatch(r"[-: ]*", cells[0]):
                row = {k: c for k, c in zip(header, cells) if k}
                row["count"] = int(row["count"]) if row.get("count") else None
                found.append(Fixture(category=category, **row))
    return found


def run(nodes: DataFrame, edges: DataFrame, fixtures: list[Fixture]) -> DataFrame:
    """One row per fixture: passed if the count, where one is given, and the expression, likewise, are met."""
    rows = []
    for f in fixtures:
        selected = KINDS[f.kind](f, nodes, edges)
        holds = expressions.compiled(f.check, selected) if f.check else F.lit(True)
        counted = selected.agg(F.count("*").alias("found"), holds.alias("holds"))
        expected = F.lit(f.count).cast("long")
        rows.append(counted.select(F.lit(f.category).alias("category"), F.lit(f.name).alias("name"), "found", expected.alias("expected"), "holds", (F.coalesce(F.col("found") == expected, F.lit(True)) & F.col("holds")).alias("passed")))
    return reduce(DataFrame.union, rows) if rows else nodes.sparkSession.createDataFrame([], SCHEMA)


def by_category(fixtures: list[Fixture]) -> dict[str, list[Fixture]]:
    out: dict[str, list[Fixture]] = {}
    for f in fixtures:
        out.setdefault(f.category, []).append(f)
    return out
