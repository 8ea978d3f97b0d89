"""Queries on patterns, rules, metrics, access rules and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import nodes as N
from loomgraph.functions import patterns as P
from loomgraph.operators import access, lookup, metric_query, rule_engine
from loomgraph.plans.registry import query

FULL = "concat_ws('.', nullif({0}package_name, ''), nullif({0}type_name, ''), nullif({0}method_name, ''), nullif({0}field_name, ''))"
NAME = FULL.format("")
ROW = f"'aql' AS source, file_path, start_line AS line, package_name AS caller_package, {NAME} AS called_package, start_line AS called_line"
CONTROLLER, SERVICE, REPOSITORY = ("lower({0}type_name) LIKE '%" + x + "%'" for x in ("controller", "service", "repository"))
M2_CONTROLLER, M2_REPOSITORY = "{0}type_name LIKE '%Controller%'", "{0}type_name LIKE '%Repository%'"


def _rules(t, text):
    return rule_engine.violations(t.ast_nodes, t.ast_relationships, text)


def _limit(pattern: str, where: str, op: str, column: str, value: int) -> str:
    return f"SELECT 0 AS rule_seq, 0 AS statement_seq, 'r' AS rule, {ROW}, concat('Rule ''r'': ', {NAME}, ' violated limit') AS message FROM ast_nodes WHERE {where} AND {column} {op} {value}"


for _name, _pattern, _where, _metric, _column, _op, _value in (
    ("r02_limit", "*Controller*", M2_CONTROLLER.format(""), "cyclomatic", "cyclomatic_complexity", ">", 10),
    ("r02_limit_all", "*", "true", "params", "parameter_count", ">=", 4),
    ("r02_limit_lines", "*Service*", "type_name LIKE '%Service%'", "lines", "line_count", "<", 20),
    ("r02_limit_case", "*service*", "type_name LIKE '%service%'", "returns", "return_count", "==", 1),
    ("r02_limit_package", "pkg3.*", "package_name = 'pkg3'", "cyclomatic", "cyclomatic_complexity", "!=", 0),
):
    query(_name, _limit(_pattern, _where, _op.replace("==", "=").replace("!=", "<>"), _column, _value))(lambda t, text=f'RULE "r" {{ LIMIT({_pattern}.{_metric} {_op} {_value}) }}': _rules(t, text))

query("r03_forbid_pattern", f"SELECT 0 AS rule_seq, 0 AS statement_seq, 'r' AS rule, {ROW}, concat('Rule ''r'': Forbidden pattern *controller* found in ', {NAME}) AS message FROM ast_nodes WHERE {CONTROLLER.format('')}")(lambda t: _rules(t, 'RULE "r" { FORBID(*controller*) }'))

FORBID = f"""SELECT 'aql' AS source, a.file_path, e.line_no AS line, a.package_name AS caller_package, b.package_name AS called_package, e.line_no AS called_line,
  concat('Rule ''r'': Forbidden call from ', {FULL.format('a.')}, ' to ', {FULL.format('b.')}) AS message
FROM ast_relationships e JOIN ast_nodes a ON a.id = e.from_ast_id JOIN ast_nodes b ON b.id = e.to_ast_id
WHERE e.relationship_type = 'call' AND {CONTROLLER.format('a.')} AND {M2_REPOSITORY.format('b.')}"""
REQUIRE = f"""SELECT {ROW}, concat('Rule ''r'': Required relationship from ', {NAME}, ' to *Repository* not found') AS message FROM ast_nodes a
WHERE {SERVICE.format('a.')} AND NOT EXISTS (SELECT 1 FROM ast_relationships e JOIN ast_nodes b ON b.id = e.to_ast_id WHERE e.relationship_type = 'call' AND e.from_ast_id = a.id AND {M2_REPOSITORY.format('b.')})"""
HEAD = "SELECT 0 AS rule_seq, {} AS statement_seq, 'r' AS rule, x.* FROM ({}) x"
query("r04_forbid_calls", HEAD.format(0, FORBID))(lambda t: _rules(t, 'RULE "r" { FORBID(*Controller* -> *Repository*) }'))
query("r06_require_calls", HEAD.format(0, REQUIRE))(lambda t: _rules(t, 'RULE "r" { REQUIRE(*Service* -> *Repository*) }'))
query("r05_require_pattern", "SELECT 0 AS rule_seq, 0 AS statement_seq, 'r' AS rule, 'aql' AS source, '' AS file_path, 0 AS line, '' AS caller_package, '' AS called_package, 0 AS called_line, 'Rule ''r'': Required pattern *Gateway* not found in codebase' AS message WHERE (SELECT count(*) FROM ast_nodes WHERE lower(type_name) LIKE '%gateway%') = 0")(lambda t: _rules(t, 'RULE "r" { REQUIRE(*Gateway*) REQUIRE(*Service*) }'))
query("r07_allow_has_no_effect", HEAD.format(1, FORBID))(lambda t: _rules(t, 'RULE "r" { ALLOW(*Controller* -> *Repository*) FORBID(*Controller* -> *Repository*) }'))
LIMIT = f"SELECT {ROW}, concat('Rule ''r'': ', {NAME}, ' violated limit') AS message FROM ast_nodes WHERE {M2_CONTROLLER.format('')} AND cyclomatic_complexity > 10"
query("r01_rule_set", " UNION ALL ".join(f"SELECT {i} AS rule_seq, {j} AS statement_seq, 'r' AS rule, x.* FROM ({s}) x" for i, j, s in ((0, 0, LIMIT), (0, 1, FORBID), (1, 0, REQUIRE))))(
    lambda t: _rules(t, 'RULE "r" { LIMIT(*Controller*.cyclomatic > 10) FORBID(*Controller* -> *Repository*) } RULE "r" { REQUIRE(*Service* -> *Repository*) }')
)
YAML = """rules:
- name: r
  statements:
  - {type: LIMIT, condition: {pattern: {type: "*Controller*", file_path: "/work/pkg4*/**"}, property: cyclomatic, operator: ">", value: 10}}
"""
query("r12_yaml_rules_with_glob", f"SELECT 0 AS rule_seq, 0 AS statement_seq, 'r' AS rule, x.* FROM ({LIMIT} AND regexp_matches(file_path, '^/work/pkg4[^/]*/.*$')) x")(lambda t: _rules(t, YAML))
query("r14_configured_rules", f"SELECT 0 AS rule_seq, 0 AS statement_seq, 'r' AS rule, x.* FROM ({LIMIT}) x UNION ALL SELECT 0, 0, '', 'aql', '', 1, '', '', 1, 'rule error: expected a statement, found ELSE'")(
    lambda t: rule_engine.run_configured(t.ast_nodes, t.ast_relationships, ['RULE "r" { LIMIT(*Controller*.cyclomatic > 10) }', 'RULE "bad" { ELSE(*) }'])
)
query("r15_cli_query", f"SELECT 0 AS rule_seq, 0 AS statement_seq, 'temp' AS rule, {ROW}, concat('Rule ''temp'': ', {NAME}, ' violated limit') AS message FROM ast_nodes WHERE line_count > 40 AND file_path LIKE '/work/pkg2/%'")(
    lambda t: _rules(t, 'RULE "temp" { LIMIT(*.lines > 40) }').where(F.col("file_path").startswith("/work/pkg2/"))
)

# ---- patterns and filters
IDS = "SELECT id FROM ast_nodes WHERE "
EXT = {"go": "\\.go$", "python": "\\.pyi?$", "javascript": "\\.(js|jsx|mjs)$", "typescript": "\\.tsx?$", "java": "\\.java$", "markdown": "\\.mdx?$"}
LANG = "CASE " + " ".join(f"WHEN regexp_matches(file_path, '{r}') THEN '{n}'" for n, r in EXT.items()) + " END"


def _pattern(text, workdir="", kind=P.query_predicate):
    return lambda t: t.ast_nodes.where(kind(P.parse_pattern(text), workdir) if kind is not P.engine_predicate and kind is not P.matches else kind(P.parse_pattern(text))).select("id")


query("f02_engine_pattern", IDS + "package_name = 'pkg2' AND lower(type_name) LIKE '%service%' AND lower(method_name) LIKE 'b%'")(_pattern("pkg2:*service*:b*", kind=P.engine_predicate))
query("f03_query_pattern", IDS + f"package_name = 'pkg4' AND lower(type_name) LIKE 'user%' AND file_path LIKE '/work/%' AND lower(coalesce(nullif(language, ''), {LANG}, '')) = 'go'")(_pattern("go:pkg4:user*:*:ignored", "/work"))
query("f03_everything", IDS + "true")(_pattern("*:*:*"))
query("f04_matches", IDS + "package_name LIKE 'pkg1%' AND type_name LIKE '%Service%'")(_pattern("pkg1*:*Service*", kind=P.matches))
query("f05_wildcard_equality", IDS + "type_name = 'User*1'")(_pattern("*:User*1", kind=P.matches))
query("f06_include_exclude", IDS + "(regexp_matches(file_path, '\\.go$') OR regexp_matches(file_path, '\\.py$')) AND NOT regexp_matches(file_path, '^/work/pkg3/')")(
    lambda t: t.ast_nodes.where(P.include_exclude(F.col("file_path"), ["*.go", "*.py"], ["pkg3/**"], "/work")).select("id")
)
query("f07_file_glob", IDS + "regexp_matches(file_path, '^/work/[^/]*/[^/]*_1[^/]*\\.(go|java)$')")(lambda t: t.ast_nodes.where(P.file_glob(F.col("file_path"), "/work/*/*_1*.{go,java}")).select("id"))
query("f08_language", IDS + f"lower(coalesce(nullif(language, ''), {LANG}, '')) = 'python'")(lambda t: t.ast_nodes.where(P.language_is(F.col("language"), F.col("file_path"), "Python")).select("id"))
query("f09_infer_language", f"SELECT id, {LANG} AS inferred FROM ast_nodes")(lambda t: t.ast_nodes.select("id", P.infer_language(F.col("file_path")).alias("inferred")))
query("f10_condition", IDS + "type_name LIKE '%Service%' AND parameter_count <= 2")(lambda t: t.ast_nodes.where(P.matches(P.parse_pattern("*Service*")) & N.compare(N.metric("params"), "<=", 2)).select("id"))
query("f12_display_filter", IDS + "node_type IN ('type', 'package') OR node_type LIKE 'type~_%' ESCAPE '~' OR node_type = 'method' OR node_type LIKE 'method~_%' ESCAPE '~'")(lambda t: t.ast_nodes.where(N.display_type(fields=False)).select("id"))
query("f13_location_filter", IDS + "node_type IN ('method', 'variable')")(lambda t: t.ast_nodes.where(F.col("node_type").isin("method", "variable")).select("id"))
query("f14_complexity", IDS + "cyclomatic_complexity >= 20")(lambda t: t.ast_nodes.where("cyclomatic_complexity >= 20").select("id"))
query("f15_node_type", IDS + "node_type = 'field'")(lambda t: t.ast_nodes.where("node_type = 'field'").select("id"))
query("f16_is_complex", IDS + "cyclomatic_complexity > 20 OR parameter_count > 4 OR line_count > 45")(lambda t: t.ast_nodes.where(N.is_complex(20, 4, 45)).select("id"))
query("f17_pattern_with_filter", IDS + "lower(type_name) LIKE '%repository%' AND regexp_matches(file_path, '\\.go$')")(lambda t: metric_query.pattern_query(t.ast_nodes, "*Repository*").where(P.include_exclude(F.col("file_path"), ["*.go"], [])).select("id"))
query("f18_by_package", IDS + "package_name = 'pkg7'")(lambda t: t.ast_nodes.where("package_name = 'pkg7'").select("id"))
query("f20_location_pattern", IDS + "package_name = 'pkg5' AND lower(field_name) LIKE '%a%' AND file_path LIKE '/work/%'")(_pattern("pkg5:*:*:*a*", "/work", P.location_predicate))
query("f25_violations_since", "SELECT id FROM violations WHERE stored_at >= TIMESTAMP '2024-01-20' AND regexp_matches(file_path, '/pkg1[^/]*/d2/[^/]*$')")(
    lambda t: t.violations.where((F.col("stored_at") >= F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")) & P.file_glob(F.col("file_path"), "/work/pkg1*/d2/*")).select("id")
)
query("f26_within_workdir", "SELECT id FROM violations WHERE file_path LIKE '/work/pkg1/%'")(lambda t: t.violations.where(F.col("file_path").startswith("/work/pkg1/")).select("id"))
query("f33_pattern_name", f"SELECT id, {NAME} AS full_name, strlen(concat(concat_ws(':', nullif(package_name, ''), nullif(type_name, ''), nullif(method_name, ''), nullif(field_name, '')), ' [', node_type, ']')) AS len FROM ast_nodes")(
    lambda t: t.ast_nodes.select("id", N.full_name().alias("full_name"), N.metric("len").alias("len"))
)
query("x03_node_key", "SELECT id, concat(file_path, '/', type_name, CASE WHEN method_name || field_name <> '' THEN ':' || method_name || field_name ELSE '' END) AS node_key FROM ast_nodes")(lambda t: t.ast_nodes.select("id", N.key().alias("node_key")))

# ---- metric queries
EXTERNAL = "SELECT e.from_ast_id AS id, count(DISTINCT e.id) AS call_count FROM ast_relationships e JOIN ast_nodes a ON a.id = e.from_ast_id LEFT JOIN ast_nodes b ON b.id = e.to_ast_id WHERE e.relationship_type = 'call' AND (e.to_ast_id IS NULL OR b.package_name <> a.package_name) GROUP BY 1"
IMPORTS = "SELECT from_ast_id AS id, count(*) AS import_count FROM ast_relationships WHERE relationship_type = 'import' GROUP BY 1"


def _metric(text):
    return lambda t: metric_query.run(t.ast_nodes, t.ast_relationships, text).select("id")


query("a03_import_counts", IMPORTS)(lambda t: metric_query.import_counts(t.ast_relationships))
query("a04_external_calls", EXTERNAL)(lambda t: metric_query.external_calls(t.ast_nodes, t.ast_relationships))
query("f11_metric_calls", f"SELECT n.id FROM ast_nodes n LEFT JOIN ({EXTERNAL}) c USING (id) WHERE lower(type_name) LIKE '%controller%' AND coalesce(call_count, 0) >= 8")(_metric("calls(*Controller*) >= 8"))
query("f11_metric_imports", f"SELECT n.id FROM ast_nodes n LEFT JOIN ({IMPORTS}) c USING (id) WHERE coalesce(import_count, 0) < 12")(_metric("imports(*) < 12"))
query("f11_metric_len", IDS + "strlen(concat(concat_ws(':', nullif(package_name, ''), nullif(type_name, ''), nullif(method_name, ''), nullif(field_name, '')), ' [', node_type, ']')) > 35")(_metric("len() > 35"))
query("f11_metric_lines", IDS + "package_name = 'pkg1' AND line_count <> 3")(_metric("lines(pkg1) != 3"))
query("r16_dispatch_dotted", IDS + "lower(type_name) LIKE '%service%' AND cyclomatic_complexity > 12")(_metric("*Service*.cyclomatic > 12"))

# ---- access rules
RULES = [access.parse_line(x) for x in ("!pkg1", "+pkg1:B*", "!pkg2", "[*.go] pkg2", "!pkg3:A*", "[/work/pkg4/*.py] !pkg5", "+pkg3:Az*")]
HITS = (  # SQL of each rule's match, over called package p, method m and file f
    "(p = 'pkg1' OR p LIKE 'pkg1/%' OR p LIKE 'pkg1.%')",
    "(p = 'pkg1' OR p LIKE 'pkg1/%' OR p LIKE 'pkg1.%') AND m LIKE 'B%'",
    "(p = 'pkg2' OR p LIKE 'pkg2/%' OR p LIKE 'pkg2.%')",
    "(p = 'pkg2' OR p LIKE 'pkg2/%' OR p LIKE 'pkg2.%') AND regexp_matches(f, '\\.go$')",
    "(p = 'pkg3' OR p LIKE 'pkg3/%' OR p LIKE 'pkg3.%') AND m LIKE 'A%'",
    "(p = 'pkg5' OR p LIKE 'pkg5/%' OR p LIKE 'pkg5.%') AND regexp_matches(f, '^(.*/)?/work/pkg4/[^/]*\\.py$')",
    "(p = 'pkg3' OR p LIKE 'pkg3/%' OR p LIKE 'pkg3.%') AND m LIKE 'Az%'",
)
LAST = "greatest(" + ", ".join(f"CASE WHEN {h} THEN {i} ELSE -1 END" for i, h in enumerate(HITS)) + ")"
query(
    "j07_access_violations",
    f"SELECT id, f AS file_path, line, caller_package, p AS called_package, m AS called_method, {LAST} AS rule_seq FROM (SELECT e.id, a.file_path AS f, e.line_no AS line, a.package_name AS caller_package, b.package_name AS p, b.method_name AS m FROM ast_relationships e JOIN ast_nodes a ON a.id = e.from_ast_id JOIN ast_nodes b ON b.id = e.to_ast_id WHERE e.relationship_type = 'call') x WHERE {LAST} IN (0, 2, 4, 5)",
)(lambda t: access.call_violations(t.ast_nodes, t.ast_relationships, RULES))
query("a08_ordered_fold", f"SELECT id, {LAST} NOT IN (0, 2, 4, 5) AS allowed FROM (SELECT id, package_name AS p, method_name AS m, file_path AS f FROM ast_nodes) x")(
    lambda t: t.ast_nodes.select("id", access.is_allowed(RULES, F.col("package_name"), F.col("method_name"), F.col("file_path")).alias("allowed"))
)
TABLE = [access.AccessRule("deny", pattern="pkg1"), access.AccessRule("allow", pattern="pkg11"), access.AccessRule("deny", pattern="pkg11")]
query("a09_fold_over_rule_table", "SELECT package_name, CAST(max(seq) AS INT) AS seq, max_by(type, seq) AS type FROM (SELECT DISTINCT package_name FROM ast_nodes) n JOIN (VALUES (0, 'deny', 'pkg1'), (1, 'allow', 'pkg11'), (2, 'deny', 'pkg11')) r(seq, type, pattern) ON package_name = pattern OR starts_with(package_name, pattern || '/') GROUP BY 1")(
    lambda t: access.fold_table(t.ast_nodes.select("package_name").distinct(), access.rules_frame(t.spark, TABLE), F.expr("package_name = pattern OR startswith(package_name, pattern || '/')"), ["package_name"])
)
SECTIONS = {"**": [], "**/pkg1/**": [], "*.go": [], "/work/pkg2/**": []}
query("j17_sections_of_file", "SELECT DISTINCT file_path, concat_ws(' ', '**', CASE WHEN starts_with(file_path, '/work/pkg2/') THEN '/work/pkg2/**' END, CASE WHEN file_path LIKE '%.go' THEN '*.go' END) AS sections FROM ast_nodes")(
    lambda t: t.ast_nodes.select("file_path").distinct().select("file_path", F.array_join(access.section_matches(F.col("file_path"), {k: v for k, v in SECTIONS.items() if k != "**/pkg1/**"}), " ").alias("sections"))
)
query("j18_deepest_rule_directory", "SELECT file_path, CASE WHEN starts_with(file_path, '/work/pkg2/') THEN '/work/pkg2' ELSE '/work' END AS directory FROM (SELECT DISTINCT file_path FROM ast_nodes) n")(
    lambda t: access.deepest_directory(t.ast_nodes.select("file_path").distinct(), t.spark.sql("SELECT * FROM VALUES ('/work'), ('/work/pkg2'), ('/work/pkg') AS d(directory)"))
)

# ---- other joins
query("j02_library_edges", "SELECT r.id, r.ast_id, r.line_no, l.package, l.method FROM library_relationships r LEFT JOIN library_nodes l ON l.id = r.library_id")(lambda t: lookup.with_library(t.library_relationships, t.library_nodes).select("id", "ast_id", "line_no", "package", "method"))
query("j06_violations_with_nodes", "SELECT v.id, a.package_name AS caller, b.package_name AS called FROM violations v LEFT JOIN ast_nodes a ON a.id = v.caller_id LEFT JOIN ast_nodes b ON b.id = v.called_id")(
    lambda t: t.violations.join(t.ast_nodes.select(F.col("id").alias("caller_id"), F.col("package_name").alias("caller")), "caller_id", "left").join(t.ast_nodes.select(F.col("id").alias("called_id"), F.col("package_name").alias("called")), "called_id", "left").select("id", "caller", "called")
)
query("j09_library_text", "SELECT id, regexp_extract(text, 'pkg=([^;)]*)', 1) AS pkg, regexp_extract(text, 'method=([^;)]*)', 1) AS method, regexp_extract(text, 'framework=([^;)]*)', 1) AS framework FROM library_relationships")(
    lambda t: t.library_relationships.select("id", *[lookup.library_info(F.col("text"))[k].alias(k) for k in ("pkg", "method", "framework")])
)
POINTS = "SELECT DISTINCT file_path, CAST(start_line + 3 AS INT) AS line FROM ast_nodes"
query("j10_node_at_line", f"SELECT file_path, line, id AS node_id, node_type FROM ({POINTS}) p JOIN (SELECT file_path AS fp, id, node_type, start_line, CASE WHEN end_line = 0 THEN start_line ELSE end_line END AS last FROM ast_nodes) n ON fp = file_path AND line BETWEEN start_line AND last QUALIFY row_number() OVER (PARTITION BY file_path, line ORDER BY start_line DESC, last - start_line, id) = 1")(
    lambda t: lookup.nodes_at_lines(t.ast_nodes, t.ast_nodes.select("file_path", (F.col("start_line") + 3).alias("line")).distinct())
)
query("j11_touching_edges", "SELECT id, from_ast_id, coalesce(to_ast_id, -1) AS to_ast_id FROM ast_relationships WHERE from_ast_id IN (SELECT id FROM ast_nodes WHERE package_name = 'pkg1') OR to_ast_id IN (SELECT id FROM ast_nodes WHERE package_name = 'pkg1')")(
    lambda t: lookup.touching(t.ast_relationships, t.ast_nodes.where("package_name = 'pkg1'")).select("id", "from_ast_id", F.coalesce("to_ast_id", F.lit(-1)).alias("to_ast_id"))
)
query("j12_edges_of_node", "SELECT id, line_no FROM ast_relationships WHERE from_ast_id = 7 AND relationship_type = 'call'")(lambda t: t.ast_relationships.where("from_ast_id = 7 AND relationship_type = 'call'").select("id", "line_no"))
ASKED = f"SELECT v.id, CASE v.id % 5 WHEN 0 THEN name WHEN 1 THEN regexp_extract(name, '[^.]+$') WHEN 2 THEN regexp_extract(name, '[^.]+[.][^.]+$') ELSE concat('gone.', name) END AS called FROM violations v JOIN (SELECT id, {NAME} AS name FROM ast_nodes) n ON n.id = v.called_id"
query(
    "j14_resolve_called_names",
    f"""WITH n AS (SELECT id, {NAME} AS name FROM ast_nodes), asked AS ({ASKED}), names AS (SELECT DISTINCT called FROM asked WHERE called <> ''),
e AS (SELECT called, min(n.id) AS node_id FROM names JOIN n ON name = called GROUP BY 1), s AS (SELECT called, min(n.id) AS node_id FROM names JOIN n ON ends_with(name, '.' || called) GROUP BY 1)
SELECT asked.id, asked.called, coalesce(e.node_id, s.node_id) AS node_id FROM asked LEFT JOIN e ON e.called = asked.called LEFT JOIN s ON s.called = asked.called""",
)(lambda t: lookup.resolve_by_name(_asked(t), t.ast_nodes).select("id", "called", "node_id"))


def _asked(t):
    """Called names as extractors leave them: in full, their last one or two segments, or of no node."""
    name, turn = F.col("name"), F.col("id") % 5
    called = F.when(turn == 0, name).when(turn == 1, F.regexp_extract(name, "[^.]+$", 0)).when(turn == 2, F.regexp_extract(name, "[^.]+[.][^.]+$", 0)).otherwise(F.concat(F.lit("gone."), name))
    return t.violations.join(t.ast_nodes.select(F.col("id").alias("called_id"), N.full_name().alias("name")), "called_id").select("id", called.alias("called"))


query("j20_resolve_library", "SELECT DISTINCT package, framework FROM library_nodes")(lambda t: lookup.resolve_library(t.library_nodes, t.library_nodes.select("package", "framework").distinct()))
query("w07_first_by_key", "SELECT min(id) AS id FROM ast_nodes GROUP BY package_name, type_name")(lambda t: lookup.first_by_key(t.ast_nodes, ["package_name", "type_name"]).select("id"))
query("s07_parameterised_sql", "SELECT id FROM ast_nodes WHERE cyclomatic_complexity > 9 AND package_name = 'pkg2'")(lambda t: t.spark.sql("SELECT id FROM {n} WHERE cyclomatic_complexity > :c AND package_name = :p", args={"c": 9, "p": "pkg2"}, n=t.ast_nodes))
query("s09_by_id", "SELECT id, file_path FROM ast_nodes WHERE id = 42")(lambda t: t.ast_nodes.where("id = 42").select("id", "file_path"))
query("s11_by_file", "SELECT id, start_line FROM ast_nodes WHERE file_path = '/work/pkg1/economy_1.go'")(lambda t: t.ast_nodes.where("file_path = '/work/pkg1/economy_1.go'").orderBy("start_line").select("id", "start_line"))
