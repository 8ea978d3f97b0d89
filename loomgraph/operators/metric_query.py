"""Pattern and metric queries over nodes: `pattern`, or `metric(pattern) op number`."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.nodes import compare, metric
from loomgraph.functions.patterns import METRICS, Pattern, parse_pattern, query_predicate

FORM = re.compile(r"\s*(\w+)\s*\(([^)]*)\)\s*(>=|<=|==|!=|>|<)\s*(\S.*?)\s*\Z")
QUERY_METRICS = (*METRICS, "len", "imports", "calls")


def import_counts(edges: DataFrame) -> DataFrame:
    """id, import_count: import edges by source; partial counts before the shuffle."""
    return edges.where("relationship_type = 'import'").groupBy(F.col("from_ast_id").alias("id")).agg(F.count("*").alias("import_count"))


def external_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, call_count: edges, of any type, that leave the node's package or have no target; a target id
    that no node has compares as null and doesn't count."""
    source = nodes.select(F.col("id").alias("from_ast_id"), F.col("package_name").alias("from_package"))
    target = nodes.select(F.col("id").alias("to_ast_id"), F.col("package_name").alias("to_package"))
    met = edges.where("relationship_type = 'call'").select("id", "from_ast_id", "to_ast_id").join(source, "from_ast_id").join(target, "to_ast_id", "left")
    out = met.where(F.col("to_ast_id").isNull() | (F.col("to_package") != F.col("from_package")))
    return out.groupBy(F.col("from_ast_id").alias("id")).agg(F.count_distinct("id").alias("call_count"))


def pattern_query(nodes: DataFrame, text: str | Pattern, workdir: str = "") -> DataFrame:
    return nodes.where(query_predicate(parse_pattern(text) if isinstance(text, str) else text, workdir))


def metric_query(nodes: DataFrame, edges: DataFrame, text: str, workdir: str = "") -> DataFrame:
    if "&&" in text or "||" in text:
        raise ValueError("invalid numeric value: conditions can't be combined")
    m = FORM.match(text)
    if not m:
        raise ValueError("invalid metric query format")
    name, inner, op, number = m.groups()
    if name not in QUERY_METRICS:
        raise ValueError(f"unknown metric {name!r}")
    if not re.fullmatch(r"-?\d+", number):
        raise ValueError(f"invalid numeric value {number!r}")
    found = pattern_query(nodes, inner.strip() or "*", workdir)
    if name in ("imports", "calls"):
        counts, column = (import_counts(edges), "import_count") if name == "imports" else (external_calls(nodes, edges), "call_count")
        joined = found.join(counts, "id", "left").withColumn(column, F.coalesce(column, F.lit(0)))
        return joined.where(compare(F.col(column), op, int(number))).drop(column)
    return found.where(compare(metric(name), op, int(number)))


def run(nodes: DataFrame, edges: DataFrame, text: str, workdir: str = "") -> DataFrame:
    """A metric query if the text has a comparison, dotted (`p.lines > 5`) or not, else a pattern."""
    if not re.search(r"[><]|==|!=", text):
        return pattern_query(nodes, text, workdir)
    dotted = re.fullmatch(rf"\s*(\S+)\.({'|'.join(METRICS)})\s*(>=|<=|==|!=|>|<)\s*(-?\d+)\s*", text)
    return metric_query(nodes, edges, f"{dotted[2]}({dotted[1]}) {dotted[3]} {dotted[4]}" if dotted else text, workdir)
