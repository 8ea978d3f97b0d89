"""Rule sets as plans: all statements of a set are evaluated together.

Nodes are read once for the statements on single patterns: the numbers of the statements that a node
violates are an array of its row, which is exploded. For statements on calls the numbers whose source
a node matches, and those whose target, are arrays too; call edges meet the nodes of either side once
for all statements, and a statement holds for an edge if its number is in both arrays. So the plan has
the same few joins however many statements there are. What differs by statement besides its
predicates, its rule and message, is a constant array indexed by the number. The violations carry
(rule_seq, statement_seq) as their order.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.nodes import compare, full_name, metric
from loomgraph.functions.patterns import engine_predicate, matches
from loomgraph.operators.rules_lang import RuleError, RuleSet, Statement, load_rules

SCHEMA = """rule_seq int, statement_seq int, rule string, file_path string, line int,
caller_package string, called_package string, called_line int, message string, source string"""


class Compiled(NamedTuple):
    """A statement: its kind, source predicate, target predicate, and the texts around the name in its message."""

    rule_seq: int
    statement_seq: int
    rule: str
    kind: str
    source: Column
    target: Column | None
    before: str
    after: str


def compile_rules(rules: RuleSet | str | None) -> list[Compiled]:
    """A null rule set is an error, as is a condition that can't be compared."""
    if rules is None:
        raise RuleError("no rule set")
    if isinstance(rules, str):
        rules = load_rules(rules)
    found = [_compiled(i, j, rule.name, s) for i, rule in enumerate(rules.rules) for j, s in enumerate(rule.statements)]
    return [c for c in found if c is not None]


def _compiled(i: int, j: int, rule: str, s: Statement) -> Compiled | None:
    head = f"Rule '{rule}': "
    if s.kind == "ALLOW":  # has no effect
        return None
    if s.kind == "LIMIT" and s.condition:
        c = s.condition
        if isinstance(c.value, (str, bool)):
            raise RuleError(f"{c.metric} can't be compared with {c.value!r}")
        # the pattern must match by both matchers
        return Compiled(i, j, rule, "node", engine_predicate(c.pattern) & matches(c.pattern) & compare(metric(c.metric), c.op, int(c.value)), None, head, " violated limit")
    assert s.pattern
    source = engine_predicate(s.pattern)
    if s.kind == "FORBID":
        if s.target:
            return Compiled(i, j, rule, "forbid_calls", source, matches(s.target), f"{head}Forbidden call from ", "")
        return Compiled(i, j, rule, "node", source, None, f"{head}Forbidden pattern {s.pattern} found in ", "")
    if s.target:
        return Compiled(i, j, rule, "require_calls", source, matches(s.target), f"{head}Required relationship from ", f" to {s.target} not found")
    return Compiled(i, j, rule, "require", source, None, f"{head}Required pattern {s.pattern} not found in codebase", "")


def violations(nodes: DataFrame, edges: DataFrame, rules: RuleSet | str | None) -> DataFrame:
    """One row per violation; no rules give no rows, a null rule set is an error."""
    return evaluate(nodes, edges, compile_rules(rules))


def evaluate(nodes: DataFrame, edges: DataFrame, statements: list[Compiled]) -> DataFrame:
    of = lambda kind: {k: s for k, s in enumerate(statements) if s.kind == kind}
    makers = (("node", lambda s: _nodes(nodes, s)), ("require", lambda s: _require(nodes, s)), ("forbid_calls", lambda s: _forbid_calls(nodes, edges, s)), ("require_calls", lambda s: _require_calls(nodes, edges, s)))
    parts = [make(of(kind)) for kind, make in makers if of(kind)]
    if not parts:
        return nodes.sparkSession.createDataFrame([], SCHEMA)
    told = F.array(*[F.struct(F.lit(s.rule_seq).alias("rule_seq"), F.lit(s.statement_seq).alias("statement_seq"), F.lit(s.rule).alias("rule"), F.lit(s.before).alias("before"), F.lit(s.after).alias("after")) for s in statements])
    found = reduce(DataFrame.unionByName, parts).withColumn("_told", F.get(told, F.col("k")))
    message = F.concat("_told.before", "name", "_told.after")
    return found.select("_told.rule_seq", "_told.statement_seq", "_told.rule", "file_path", "line", "caller_package", "called_package", "called_line", message.alias("message"), F.lit("aql").alias("source"))


def _numbers(predicates: dict[int, Column]) -> Column:
    """array<int>: the numbers of the statements whose predicate holds for the row."""
    return F.array_compact(F.array(*[F.when(p, F.lit(k)) for k, p in predicates.items()]))


def _marked(nodes: DataFrame, predicates: dict[int, Column], name: str) -> DataFrame:
    """nodes that match some predicate, which reaches the scan, with the numbers of those that they match."""
    return nodes.where(reduce(lambda a, b: a | b, predicates.values())).withColumn(name, _numbers(predicates))


def _sources(nodes: DataFrame, statements: dict[int, Compiled], name: str) -> DataFrame:
    return _marked(nodes, {k: s.source for k, s in statements.items()}, name)


def _node_rows(found: DataFrame) -> DataFrame:
    """Violations at the node itself; found: k and the columns of nodes, with name."""
    return found.select("k", "name", "file_path", F.col("start_line").alias("line"), F.col("package_name").alias("caller_package"), F.col("name").alias("called_package"), F.col("start_line").alias("called_line"))


def _nodes(nodes: DataFrame, statements: dict[int, Compiled]) -> DataFrame:
    return _node_rows(_sources(nodes, statements, "ks").select("file_path", "package_name", "start_line", full_name().alias("name"), F.explode("ks").alias("k")))


def _require(nodes: DataFrame, statements: dict[int, Compiled]) -> DataFrame:
    """One row, without a file, for each statement that nothing matches."""
    met = nodes.agg(F.array_compact(F.array(*[F.when(F.coalesce(F.bool_or(s.source), F.lit(False)), F.lit(None)).otherwise(F.lit(k)) for k, s in statements.items()])).alias("ks"))
    none, zero = F.lit(""), F.lit(0)
    return met.select(F.explode("ks").alias("k"), none.alias("name"), none.alias("file_path"), zero.alias("line"), none.alias("caller_package"), none.alias("called_package"), zero.alias("called_line"))


def _calls(nodes: DataFrame, edges: DataFrame, statements: dict[int, Compiled]) -> DataFrame:
    """Call edges with the numbers of the statements whose target they reach."""
    reached = _marked(nodes, {k: s.target for k, s in statements.items() if s.target is not None}, "reached")
    to = reached.select(F.col("id").alias("to_ast_id"), F.col("package_name").alias("to_package"), full_name().alias("to_name"), "reached")
    return edges.where("relationship_type = 'call'").select("from_ast_id", "to_ast_id", "line_no").join(to, "to_ast_id")


def _forbid_calls(nodes: DataFrame, edges: DataFrame, statements: dict[int, Compiled]) -> DataFrame:
    """One violation per call edge and statement, at the edge's line."""
    source = _sources(nodes, statements, "leaving").select(F.col("id").alias("from_ast_id"), "file_path", "package_name", full_name().alias("from_name"), "leaving")
    met = _calls(nodes, edges, statements).join(source, "from_ast_id").withColumn("k", F.explode(F.array_intersect("leaving", "reached")))
    name = F.concat("from_name", F.lit(" to "), "to_name")
    return met.select("k", name.alias("name"), "file_path", F.col("line_no").alias("line"), F.col("package_name").alias("caller_package"), F.col("to_package").alias("called_package"), F.col("line_no").alias("called_line"))


def _require_calls(nodes: DataFrame, edges: DataFrame, statements: dict[int, Compiled]) -> DataFrame:
    """Sources without any call edge to a target, by statement."""
    calling = _calls(nodes, edges, statements).select(F.col("from_ast_id").alias("id"), F.explode("reached").alias("k"))
    source = _sources(nodes, statements, "ks").select("id", "file_path", "package_name", "start_line", full_name().alias("name"), F.explode("ks").alias("k"))
    return _node_rows(source.join(calling, ["id", "k"], "left_anti"))


def run_configured(nodes: DataFrame, edges: DataFrame, texts: list[str]) -> DataFrame:
    """Violations of a list of rule texts, evaluated together; a text that can't be parsed or compiled is itself a violation at line 1."""
    statements: list[Compiled] = []
    errors = []
    for text in texts:
        try:
            statements += compile_rules(text)
        except ValueError as e:
            errors.append((0, 0, "", "", 1, "", "", 1, f"rule error: {e}", "aql"))
    found = evaluate(nodes, edges, statements)
    return found.unionByName(nodes.sparkSession.createDataFrame(errors, SCHEMA)) if errors else found
