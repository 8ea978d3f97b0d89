"""Queries that exercise the library over the tables where a constant or a formula would do less."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import patterns as P
from loomgraph.functions.nodes import NATURAL_KEY, full_name
from loomgraph.operators import access, config, deps, expressions, fixtures, lookup, reports, stats, store
from loomgraph.plans.registry import query
from loomgraph.sources import extract, languages

NAME = "concat_ws('.', nullif(package_name, ''), nullif(type_name, ''), nullif(method_name, ''), nullif(field_name, ''))"
PATHS = "(SELECT DISTINCT file_path FROM ast_nodes)"


def _paths(t):
    return t.ast_nodes.select("file_path").distinct()


# ---- patterns, rule files and configuration
PATTERNS = ("pkg1:User*", "*Service*", "go:pkg2:*:B*", "@**/*.go:pkg3", "pkg1.User", "*.User", "a/b", "x:y:z:w", "pkg.*", "User*.cyclomatic")
query(
    "f01_parsed_patterns",
    """SELECT * FROM (VALUES (0, 'pkg1', 'User*', '', '', '', '', ''), (1, '', '*Service*', '', '', '', '', ''), (2, 'pkg2', '*', 'B*', '', 'go', '', ''), (3, 'pkg3', '', '', '', '', '**/*.go', ''),
(4, 'pkg1', 'User', '', '', '', '', ''), (5, '*', 'User', '', '', '', '', ''), (6, 'a/b', '', '', '', '', '', ''), (7, 'x', 'y', 'z', 'w', '', '', ''), (8, 'pkg', '*', '', '', '', '', ''), (9, '', 'User*', '', '', '', '', 'cyclomatic')) p(seq, package, type, method, field, language, file_glob, metric)""",
)(
    lambda t: t.spark.createDataFrame(
        [(i, p.package, p.type, p.method, p.field, p.language, p.file_path, p.metric) for i, p in enumerate(map(P.parse_pattern, PATTERNS))],
        "seq int, package string, type string, method string, field string, language string, file_glob string, metric string",
    )
)
RULE_FILE = "concat('# rules of ', s_name, chr(10), '!internal', s_suppkey, chr(10), '  +internal/api # but', chr(10), chr(10), '[*_', s_suppkey % 3, '.go] fmt:!Print', s_suppkey, chr(10), 'os:Exit')"
FOLDER = "concat('/w/', s_nationkey, '/', s_suppkey)"
RULES = f"""SELECT {FOLDER} AS directory, n AS line_number, kind AS type, CASE n WHEN 2 THEN concat('internal', s_suppkey) WHEN 3 THEN 'internal/api' ELSE '' END AS pattern, CASE n WHEN 5 THEN 'fmt' WHEN 6 THEN 'os' ELSE '' END AS package,
  CASE n WHEN 5 THEN concat('Print', s_suppkey) WHEN 6 THEN 'Exit' ELSE '' END AS method, CASE n WHEN 5 THEN concat('*_', s_suppkey % 3, '.go') ELSE '' END AS file_pattern FROM supplier, (VALUES (2, 'deny'), (3, 'override'), (5, 'deny'), (6, 'allow')) k(n, kind)"""


def _rule_files(t):
    return t.supplier.select(F.expr(f"concat({FOLDER}, '/.RULES')").alias("file_path"), F.expr(RULE_FILE.replace("chr(10)", "'\\n'")).alias("text"))


query("s35_rule_rows", RULES)(lambda t: access.parse_lines(_rule_files(t)))
query("u08_merged_rule_rows", f"""SELECT '**' AS section, 0 AS seq, 'deny' AS type, 'a' AS pattern, '' AS package, '' AS method UNION ALL
SELECT section, CAST(CASE WHEN section = '**' THEN 0 ELSE -1 END + row_number() OVER (PARTITION BY section ORDER BY directory, line_number) AS INT), type, pattern, package, method FROM (SELECT *, CASE WHEN file_pattern = '' THEN '**' ELSE file_pattern END AS section FROM ({RULES}) x) y""")(
    lambda t: access.merge_rule_files(t.spark.createDataFrame([("**", 0, "deny", "a", "", "")], "section string, seq int, type string, pattern string, package string, method string"), _rule_files(t))
)
CONFIG = 'variables: {v: pkg}\nrules: {"**": {imports: ["!${v}1", "+${v}11"]}, "/work/pkg2/**": {imports: ["${v}1"]}}\nbuiltin_rules: [no_fmt_print]\n'
query("s37_configuration_rules", "SELECT e.id FROM ast_relationships e JOIN ast_nodes a ON a.id = e.from_ast_id JOIN ast_nodes b ON b.id = e.to_ast_id WHERE e.relationship_type = 'call' AND b.package_name = 'pkg1' AND NOT starts_with(a.file_path, '/work/pkg2/')")(lambda t: _configured(t))


def _configured(t):
    """Call edges that the configuration denies: each section's rules, in the order of the sections, for the files that it fits."""
    sections = config.load(CONFIG)["sections"]
    calls = t.ast_relationships.where("relationship_type = 'call'")
    joined = calls.select("id", "from_ast_id", "to_ast_id").join(t.ast_nodes.select(F.col("id").alias("from_ast_id"), "file_path"), "from_ast_id").join(t.ast_nodes.select(F.col("id").alias("to_ast_id"), "package_name", "method_name"), "to_ast_id")
    denied = F.lit(False)
    for section, rule in access.ordered_rules(sections):
        hit = P.config_path(F.col("file_path"), section) & access.rule_matches(rule, F.col("package_name"), F.col("method_name"))
        denied = F.when(hit, F.lit(rule.type == "deny")).otherwise(denied)
    return joined.where(denied).select("id")


SECTION = "CASE p_partkey % 4 WHEN 0 THEN '**' WHEN 1 THEN concat('src/', p_partkey % 7, '/**') WHEN 2 THEN concat('*_', p_partkey % 5, '.go') ELSE concat('main', p_partkey % 9, '.go') END"
query("w02_section_order", f"SELECT s AS section, row_number() OVER (ORDER BY CASE WHEN s = '**' THEN 0 WHEN contains(s, '**') THEN 1 WHEN contains(s, '*') THEN 2 ELSE 3 END, s) AS seq FROM (SELECT DISTINCT {SECTION} AS s FROM part) x")(lambda t: _ranked(t))


def _ranked(t):
    from pyspark.sql import Window

    sections = t.part.select(F.expr(SECTION).alias("section")).distinct()
    # the sections of a configuration: some dozens
    return sections.select("section", F.row_number().over(Window.orderBy(access.specificity_order(F.col("section")))).cast("long").alias("seq"))


query("a25_enabled_linters", "SELECT DISTINCT linter_name AS linter FROM linter_executions WHERE success AND violation_count = 1")(lambda t: stats.enabled(t.linter_executions.select("linter_name", F.expr("success AND violation_count = 1").alias("enabled"))))
LANGUAGE = "CASE " + " ".join(f"WHEN x = '{e}' THEN '{n}'" for e, n in languages.by_extension().items()) + " END"
FILES = "concat('d/f', p_partkey, '.', CASE p_partkey % 14 WHEN 0 THEN 'go' WHEN 1 THEN 'pyi' WHEN 2 THEN 'mjs' WHEN 3 THEN 'tsx' WHEN 4 THEN 'MDX' WHEN 5 THEN 'yml' WHEN 6 THEN 'jsonc' WHEN 7 THEN 'rs' WHEN 8 THEN 'java' WHEN 9 THEN 'h' WHEN 10 THEN 'hpp' WHEN 11 THEN 'cts' WHEN 12 THEN 'txt' ELSE 'PY' END)"
query("p04_languages", f"SELECT file_path, {LANGUAGE} AS language FROM (SELECT {FILES} AS file_path, lower(regexp_extract({FILES}, '\\.([A-Za-z0-9]+)$', 1)) AS x FROM part) f")(lambda t: t.part.select(F.expr(FILES).alias("file_path")).select("file_path", languages.of_path(F.col("file_path")).alias("language")))
query("p02_extractor_by_extension", f"SELECT file_path, {LANGUAGE} AS language FROM (SELECT file_path, regexp_extract(file_path, '\\.([a-z]+)$', 1) AS x FROM {PATHS} p) f WHERE {LANGUAGE} IN ('go', 'python', 'java', 'javascript', 'typescript')")(
    lambda t: _paths(t).withColumn("extension", F.regexp_extract("file_path", r"\.([a-z]+)$", 1)).join(languages.frame(t.spark), "extension").where(F.col("language").isin(*extract.EXTRACTORS)).select("file_path", "language")
)

# ---- expressions, comments, jobs and categories
CHECKS = {
    "every": "nodes.all(n, n.line_count > 1 && n.package_name.startsWith('pkg'))",
    "some": "nodes.exists(n, n.cyclomatic_complexity > 25 || n.method_name.contains('Azure'))",
    "services": "size(nodes.filter(n, n.type_name.endsWith('Service1') && !n.is_private))",
    "named": "nodes.filter(n, n.node_type == \"method\").all(n, size(n.package_name + ':' + n.type_name) > 12)",
    "enough": "nodes.size() > 3 ? nodes.exists_one(n, n.id % 100 == 7) : false",
    "kinds": "nodes.all(n, n.node_type in ['type', 'method', 'field', 'variable', 'package'])",
}
query("p07_expressions", """SELECT package_name, bool_and(line_count > 1 AND starts_with(package_name, 'pkg')) AS every, bool_or(cyclomatic_complexity > 25 OR contains(method_name, 'Azure')) AS some,
  count(*) FILTER (ends_with(type_name, 'Service1') AND NOT is_private) AS services, coalesce(bool_and(length(concat(package_name, ':', type_name)) > 12) FILTER (node_type = 'method'), true) AS named,
  count(*) > 3 AND count(*) FILTER (id % 100 = 7) = 1 AS enough, true AS kinds FROM ast_nodes GROUP BY 1""")(lambda t: expressions.evaluate(t.ast_nodes, CHECKS, ["package_name"]))  # fmt: skip
query("p07_forall_exists", "SELECT package_name, bool_and(line_count > 1) AS every, bool_or(cyclomatic_complexity > 25) AS some FROM ast_nodes GROUP BY 1")(
    lambda t: expressions.evaluate(t.ast_nodes, {"every": "nodes.all(n, n.line_count > 1)", "some": "nodes.exists(n, n.cyclomatic_complexity > 25)"}, ["package_name"])
)
query("f29_multi_line_comments", "SELECT file_path, type FROM comments WHERE type = 'multi_line'")(lambda t: t.comments.where("type = 'multi_line'").select("file_path", "type"))
JOBS = "CASE WHEN git = '' THEN name ELSE '' END AS path, CASE WHEN git = '' THEN '' ELSE concat(git, '@', version) END AS git, depth"
query("u07_visited_once", f"SELECT CASE WHEN git = '' THEN concat('local:', path) ELSE concat('git:', git) END AS job, min(depth) AS depth FROM (SELECT {JOBS} FROM dependencies) j GROUP BY 1")(lambda t: deps.visited_once(t.dependencies.selectExpr(*JOBS.replace(", CASE", "|CASE").replace(", depth", "|depth").split("|"))))
LINK = "SELECT DISTINCT n_regionkey * 100 + n_nationkey % 7 AS a, n_nationkey * 3 % 25 + 100 * (n_nationkey % 5) AS b FROM nation"
query("u07_walk", f"""WITH RECURSIVE l AS ({LINK}), w AS (SELECT 1::BIGINT AS job, 0 AS depth UNION SELECT b, depth + 1 FROM w JOIN l ON a = job WHERE depth < 6) SELECT job, CAST(min(depth) AS INT) AS depth FROM w GROUP BY 1""")(
    lambda t: deps.walk(t.spark.sql("SELECT 1L AS job"), t.nation.selectExpr("CAST(n_regionkey * 100 + n_nationkey % 7 AS BIGINT) AS job", "CAST(n_nationkey * 3 % 25 + 100 * (n_nationkey % 5) AS BIGINT) AS next").distinct(), 6)
)
TABLE = """# Names
| Test Name | CWD | Query | Expected Count | CEL Validation |
|-|-|-|-|-|
| services | /work | *Service* | 3 | nodes.all(n, n.type_name.contains("Service")) |
| one package | /work/pkg3 | *:*:* | | nodes.all(n, n.package_name == "pkg3" || n.package_name == "none") |

## Metrics
| Test Name | Query | CEL Validation |
|-|-|-|
| long | lines(*) > 40 | nodes.all(n, n.line_count > 40) |
| calls | calls(*Service*) >= 2 | nodes.exists(n, n.cyclomatic_complexity > 1000) |
"""
CALLS = "SELECT e.from_ast_id AS id FROM ast_relationships e JOIN ast_nodes a ON a.id = e.from_ast_id LEFT JOIN ast_nodes b ON b.id = e.to_ast_id WHERE e.relationship_type = 'call' AND (e.to_ast_id IS NULL OR b.package_name <> a.package_name) GROUP BY 1 HAVING count(DISTINCT e.id) >= 2"
SERVICE = "lower(type_name) LIKE '%service%'"
query("p06_fixtures", f"""SELECT 'Names' AS category, 'services' AS name, count(*) AS found, 3::BIGINT AS expected, true AS holds, count(*) = 3 AS passed FROM ast_nodes WHERE {SERVICE} UNION ALL
SELECT 'Names', 'one package', count(*), NULL, true, true FROM ast_nodes WHERE file_path LIKE '/work/pkg3/%' UNION ALL SELECT 'Metrics', 'long', count(*), NULL, true, true FROM ast_nodes WHERE line_count > 40
UNION ALL SELECT 'Metrics', 'calls', count(*), NULL, false, false FROM ast_nodes WHERE {SERVICE} AND id IN ({CALLS})""")(lambda t: fixtures.run(t.ast_nodes, t.ast_relationships, fixtures.parse(TABLE)))  # fmt: skip
query("a29_sample_types", "WITH f AS (SELECT node_type, min(id) AS i FROM ast_nodes GROUP BY 1), l AS (SELECT CASE WHEN count(*) = 3 THEN max(i) END AS i FROM (SELECT i FROM f ORDER BY i LIMIT 3) x) SELECT node_type, count(*) AS n FROM ast_nodes WHERE (SELECT i FROM l) IS NULL OR id <= (SELECT i FROM l) GROUP BY 1")(lambda t: reports.sample_types(t.ast_nodes, 3))
query("a28_group_by_category", "SELECT CASE WHEN source = '' THEN 'none' ELSE source END AS source, count(*) AS n FROM violations GROUP BY 1")(lambda t: reports.by_category(t.violations, "source", "none"))

# ---- names, trees and stores
query("j16_parent_by_key", "SELECT c.id, min(p.id) AS parent FROM ast_nodes c JOIN ast_nodes p ON p.node_type = 'type' AND p.package_name = c.package_name AND p.type_name = c.type_name WHERE c.node_type IN ('method', 'field') GROUP BY 1")(lambda t: lookup.parents(t.ast_nodes))
query("j14_resolve_by_name", f"SELECT v.id, m.id AS node_id FROM violations v JOIN (SELECT id, {NAME} AS name FROM ast_nodes) n ON n.id = v.called_id JOIN (SELECT min(id) AS id, {NAME} AS name FROM ast_nodes GROUP BY 2) m ON m.name = n.name")(
    lambda t: lookup.resolve_by_name(t.violations.join(t.ast_nodes.select(F.col("id").alias("called_id"), full_name().alias("called")), "called_id").select("id", "called"), t.ast_nodes).select("id", "node_id")
)
TARGET = f"(SELECT min(id) FROM ast_nodes WHERE ends_with({NAME}, concat('.', 'UserService3')))"
query("j19_references", f"SELECT a.id, a.file_path, e.line_no AS line, 'reference' AS what FROM ast_relationships e JOIN ast_nodes a ON a.id = e.from_ast_id WHERE e.to_ast_id = {TARGET} UNION ALL SELECT id, file_path, start_line, 'definition' FROM ast_nodes WHERE id = {TARGET}")(lambda t: lookup.references(t.ast_nodes, t.ast_relationships, "UserService3"))
HEAD, TAIL = "concat('{\"summary\":{\"total\":', count(*), '},\"violations\":[')", "']}'"
ROW = "concat('{\"file_path\":\"', file_path, '\",\"line\":', line, ',\"rule\":\"', rule, '\",\"message\":\"', message, '\"}')"
query("s43_json_report", f"SELECT 0 AS part, 0::BIGINT AS id, {HEAD} AS line FROM violations UNION ALL SELECT 1, id, concat(CASE WHEN row_number() OVER (ORDER BY file_path, line, rule, message, id) = 1 THEN '' ELSE ',' END, {ROW}) FROM violations UNION ALL SELECT 2, 0, {TAIL}")(lambda t: reports.json_lines(t.violations))
query("s45_html", "SELECT 0 AS part, 0::BIGINT AS id, '<table><tr><th>File</th><th>Line</th><th>Rule</th><th>Message</th></tr>' AS line UNION ALL SELECT 1, id, concat('<tr><td>', file_path, '</td><td>', line, '</td><td>', rule, '</td><td>', message, ' &lt;b&gt; &amp;</td></tr>') FROM violations UNION ALL SELECT 2, 0, '</table>'")(
    lambda t: reports.html_lines(t.violations.withColumn("message", F.concat("message", F.lit(" <b> &"))))
)
TREE = "(SELECT id, package_name, substr(file_path, 7) AS path, string_split(substr(file_path, 7), '/') AS p FROM ast_nodes) x"
LEVEL = "SELECT '{0}' AS kind, {1} AS key, {2} AS parent, count(*) AS n FROM {3} GROUP BY ALL"
UP = "(SELECT *, unnest(range(1, len(p))) AS k FROM " + TREE + ") y"
query("g10_display_tree", " UNION ALL ".join([
    LEVEL.format("folder", "array_to_string(p[1:k], '/')", "CASE WHEN k > 1 THEN array_to_string(p[1:k - 1], '/') END", UP), LEVEL.format("file", "path", "array_to_string(p[1:len(p) - 1], '/')", TREE),
    LEVEL.format("package", "concat(path, '#', package_name)", "path", TREE), f"SELECT 'node', CAST(id AS VARCHAR), concat(path, '#', package_name), 1 FROM {TREE}",
]))(lambda t: reports.display_tree(t.ast_nodes, "/work"))
query("g10_hoisted_tree", LEVEL.format("package", "concat(path, '#', package_name)", "CAST(NULL AS VARCHAR)", TREE) + f" UNION ALL SELECT 'node', CAST(id AS VARCHAR), concat(path, '#', package_name), 1 FROM {TREE}")(lambda t: reports.display_tree(t.ast_nodes, "/work", dirs=False, files=False))
query("s18_schema_objects", """SELECT 'type_table' AS node_type, concat('s.t', p_partkey) AS name, CAST(NULL AS VARCHAR) AS parent FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'field_column', concat('s.t', p_partkey, '.c'), concat('s.t', p_partkey) FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT 'type', concat('s.e', n_nationkey), NULL FROM nation UNION ALL SELECT 'field', concat('s.e', n_nationkey, '.', v), concat('s.e', n_nationkey) FROM nation, (VALUES ('on'), ('off')) x(v)
UNION ALL SELECT 'method', concat('s.t', p_partkey, '.i', p_size), concat('s.t', p_partkey) FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 'method', concat('s.f', r_regionkey), NULL FROM region""")(lambda t: _schema_objects(t))  # fmt: skip


def _schema_objects(t):
    s = F.lit("s").alias("schema")
    tables = t.part.where("p_partkey % 2 = 0").withColumn("table", F.concat(F.lit("t"), "p_partkey"))
    columns = tables.select(s, "table", F.lit("table").alias("kind"), F.lit("c").alias("column"), F.lit("int").alias("type"))
    keys = columns.select("schema", "table", "column", F.col("table").alias("to_table"), F.col("column").alias("to_column"))
    enums = t.nation.select(s, F.concat(F.lit("e"), "n_nationkey").alias("enum"), F.explode(F.array(F.lit("on"), F.lit("off"))).alias("value"))
    indexes = tables.where("p_partkey % 4 = 0").select(s, "table", F.concat(F.lit("i"), "p_size").alias("index"))
    nodes, _ = extract.sql_schema(t.spark, columns, keys, enums, indexes, t.region.select(s, F.concat(F.lit("f"), "r_regionkey").alias("name")))
    named = nodes.withColumn("name", full_name())
    return named.join(named.select(F.col("id").alias("parent_id"), F.col("name").alias("parent")), "parent_id", "left").select("node_type", "name", "parent")


# ---- a whole-file merge: the files of pkg1 are analysed anew
AGAIN = "(SELECT min(id) AS id, file_path, package_name, type_name, method_name, field_name FROM ast_nodes WHERE package_name = 'pkg1' GROUP BY ALL)"
KEPT = f"(SELECT * FROM {AGAIN} WHERE id % 3 <> 0) k"
GONE = f"SELECT id FROM ast_nodes WHERE package_name = 'pkg1' AND id NOT IN (SELECT id FROM {KEPT})"
query("s41_merge_file_results", f"""SELECT 'node' AS what, id, 0::BIGINT AS other, start_line AS line FROM ast_nodes WHERE package_name <> 'pkg1' UNION ALL SELECT 'node', id, 0, 7 FROM {KEPT}
UNION ALL SELECT 'edge', from_ast_id, to_ast_id, line_no FROM ast_relationships WHERE from_ast_id NOT IN (SELECT id FROM ast_nodes WHERE package_name = 'pkg1') AND (to_ast_id IS NULL OR to_ast_id NOT IN ({GONE}))
UNION ALL SELECT 'edge', id, id, 9 FROM {KEPT} UNION ALL SELECT 'library edge', ast_id, library_id, line_no FROM library_relationships WHERE ast_id NOT IN (SELECT id FROM ast_nodes WHERE package_name = 'pkg1')
UNION ALL SELECT 'library edge', id, 5, 8 FROM {KEPT} UNION ALL SELECT 'library', id, 0, 0 FROM library_nodes UNION ALL SELECT 'file', count(DISTINCT file_path), 0, 0 FROM ast_nodes""")(lambda t: _merged_files(t))  # fmt: skip


def _merged_files(t):
    nodes, key = t.ast_nodes, list(NATURAL_KEY)
    one = nodes.where("package_name = 'pkg1'").groupBy(*key).agg(F.min("id").alias("id")).where("id % 3 <> 0")
    found = one.join(nodes.drop(*key), "id").withColumn("start_line", F.lit(7)).withColumn("id", F.col("id") + 5_000_000_000).select(nodes.columns)
    files = nodes.where("package_name = 'pkg1'").select("file_path", F.lit("new").alias("file_hash")).distinct()
    known = nodes.where("package_name <> 'pkg1'").select("file_path", F.lit("old").alias("file_hash")).distinct()
    edges = found.select(F.lit(1).cast("long").alias("id"), F.col("id").alias("from_ast_id"), F.col("id").alias("to_ast_id"), F.lit(9).alias("line_no"), F.lit("call").alias("relationship_type"), F.lit("x").alias("text"))
    libraries = t.library_nodes.where("id = 5").withColumn("id", F.lit(77).cast("long"))
    uses = found.select(F.lit(1).cast("long").alias("id"), F.col("id").alias("ast_id"), F.lit(77).cast("long").alias("library_id"), F.lit(8).alias("line_no"), F.lit("call").alias("relationship_type"), F.lit("x").alias("text"))
    old = {"nodes": nodes, "edges": t.ast_relationships, "libraries": t.library_nodes, "library_edges": t.library_relationships, "metadata": known}
    merged = store.merge_file_results(old, {"nodes": found, "edges": edges, "libraries": libraries, "library_edges": uses, "metadata": files})
    zero = F.lit(0)
    rows = [
        merged["nodes"].select(F.lit("node").alias("what"), "id", zero.cast("long").alias("other"), F.col("start_line").alias("line")),
        merged["edges"].select(F.lit("edge").alias("what"), F.col("from_ast_id").alias("id"), F.col("to_ast_id").alias("other"), F.col("line_no").alias("line")),
        merged["library_edges"].select(F.lit("library edge").alias("what"), F.col("ast_id").alias("id"), F.col("library_id").alias("other"), F.col("line_no").alias("line")),
        merged["libraries"].select(F.lit("library").alias("what"), "id", zero.cast("long").alias("other"), zero.alias("line")),
        merged["metadata"].agg(F.count_distinct("file_path").alias("id")).select(F.lit("file").alias("what"), "id", zero.cast("long").alias("other"), zero.alias("line")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


# ---- source texts
query("s13_extract_python", """SELECT file_path, package_name, type_name, '' AS method_name, '' AS field_name, 'type' AS node_type, 'python' AS language, 1 AS start_line, 3 AS end_line, 0 AS cyclomatic_complexity, 0 AS parameter_count, 0 AS return_count, 3 AS line_count, false AS is_private FROM ast_nodes WHERE node_type = 'method'
UNION ALL SELECT file_path, package_name, type_name, method_name, '', 'method', 'python', 2, 3, 2, 2, 0, 2, false FROM ast_nodes WHERE node_type = 'method'""")(
    lambda t: extract.extract(t.ast_nodes.where("node_type = 'method'").select("file_path", F.lit("python").alias("language"), F.format_string("class %s:\n    def %s(self, a, b=1):\n        return a if a else b\n", "type_name", "method_name").alias("text")))
)
MARKED = "string_split(concat(regexp_replace(html, '<h1>|<h2>', chr(10) || '# ', 'g'), chr(10), '```go', chr(10), '# no', chr(10), '```', chr(10), '## Last ', page_id), chr(10))"
query("s17_markdown", f"""WITH l AS (SELECT url AS file_path, page_id, unnest({MARKED}) AS raw, unnest(range(1, len({MARKED}) + 1)) AS line, len({MARKED}) AS n FROM pages),
h AS (SELECT *, trim(regexp_replace(raw, '^#{{1,6}}\\s+', ''), ' ') AS title FROM l WHERE regexp_matches(raw, '^#{{1,6}}\\s+\\S') AND line <> n - 2)
SELECT file_path, title AS heading, 'type' AS node_type, title AS name, CAST(line AS INT) AS start_line FROM h
UNION ALL SELECT l.file_path, coalesce((SELECT arg_max(title, line) FROM h WHERE h.page_id = l.page_id AND h.line < l.n - 3), ''), 'method', concat('code_go_', l.n - 3), CAST(l.n - 3 AS INT) FROM l WHERE l.line = l.n - 3""")(
    lambda t: extract.markdown(t.pages.select(F.col("url").alias("file_path"), F.concat(F.regexp_replace("html", r"<h1>|<h2>", "\n# "), F.lit("\n```go\n# no\n```\n## Last "), "page_id").alias("text")))
)
SPEC = '{"openapi": "3", "info": {"title": "%s", "version": "1.0"}, "paths": {"/x": {"get": {"parameters": [{"name": "q"}]}}}, "components": {"schemas": {"S%s": {"properties": {"a": {"type": "string"}}}}}}'
query("s19_openapi", """SELECT concat(p_name, '.json') AS file_path, 'v1_0' AS package_name, concat('S', p_partkey) AS type_name, '' AS method_name, '' AS field_name, 'type_http_schema' AS node_type, 0 AS parameter_count FROM part
UNION ALL SELECT concat(p_name, '.json'), 'v1_0', concat('S', p_partkey), '', 'a', 'field', 0 FROM part UNION ALL SELECT concat(p_name, '.json'), 'v1_0', '/x', 'get /x', '', 'method_http_get', 1 FROM part""")(
    lambda t: extract.openapi(t.part.select(F.concat("p_name", F.lit(".json")).alias("file_path"), F.format_string(SPEC, "p_name", F.col("p_partkey").cast("string")).alias("text")))
)
