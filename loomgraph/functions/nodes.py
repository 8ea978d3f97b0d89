"""Names, keys and metrics of nodes as Columns."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("package_name", "type_name", "method_name", "field_name")
COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "==": operator.eq, "!=": operator.ne}
NATURAL_KEY = ("file_path", *NAMES)


def full_name(prefix: str = "") -> Column:
    """The non-empty parts joined by dots."""
    return F.concat_ws(".", *[F.nullif(F.col(prefix + n), F.lit("")) for n in NAMES])


def key(prefix: str = "") -> Column:
    """`file/Type:MethodField`"""
    member = F.concat(F.col(prefix + "method_name"), F.col(prefix + "field_name"))
    return F.concat(F.col(prefix + "file_path"), F.lit("/"), F.col(prefix + "type_name"), F.when(member != "", F.concat(F.lit(":"), member)).otherwise(""))


def pattern_name() -> Column:
    """The node as a pattern, with its type: what the metric `len` measures in bytes."""
    parts = F.concat_ws(":", *[F.nullif(F.col(n), F.lit("")) for n in NAMES])
    return F.concat(parts, F.lit(" ["), F.col("node_type"), F.lit("]"))


def stable_id() -> Column:
    """An id that a node keeps through re-analysis."""
    return F.xxhash64(*NATURAL_KEY)


def metric(name: str) -> Column:
    columns = {"cyclomatic": "cyclomatic_complexity", "parameters": "parameter_count", "params": "parameter_count", "returns": "return_count", "lines": "line_count"}
    if name == "len":
        return F.octet_length(pattern_name())
    if name not in columns:
        raise ValueError(f"unknown metric {name!r}")
    return F.col(columns[name])


def compare(column: Column, op: str, value: int) -> Column:
    if op not in COMPARE:
        raise ValueError(f"unknown operator {op!r}")
    return COMPARE[op](column, F.lit(value))


def is_complex(complexity: int, parameters: int, lines: int) -> Column:
    return (F.col("cyclomatic_complexity") > complexity) | (F.col("parameter_count") > parameters) | (F.col("line_count") > lines)


def display_type(types: bool = True, methods: bool = True, fields: bool = True) -> Column:
    """Which node types a display keeps; sub-types go by their prefix, packages and variables with types and fields."""
    t = F.col("node_type")
    kept = F.lit(False)
    if types:
        kept = kept | t.isin("type", "package") | t.startswith("type_")
    if methods:
        kept = kept | (t == "method") | t.startswith("method_")
    if fields:
        kept = kept | t.isin("field", "variable") | t.startswith("field_")
    return kept
