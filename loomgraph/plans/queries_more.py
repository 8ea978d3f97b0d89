"""Further queries by inventory id: scalars, configuration, nested rows, manifests and hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import nodes as N
from loomgraph.functions import patterns as P
from loomgraph.functions import paths, text
from loomgraph.operators import access, config, lookup, quality, reports, stats, store
from loomgraph.plans.registry import query
from loomgraph.sources import extract, files, manifests

NAME = "concat_ws('.', nullif(package_name, ''), nullif(type_name, ''), nullif(method_name, ''), nullif(field_name, ''))"
IDS = "SELECT id FROM ast_nodes WHERE "
PATHS = "(SELECT DISTINCT file_path FROM ast_nodes)"


def _paths(t):
    return t.ast_nodes.select("file_path").distinct()


# ---- scans and sinks
query("s01_visible_source_files", f"SELECT file_path FROM {PATHS} x WHERE regexp_matches(file_path, '\\.(go|py|js|ts|java|md)$')")(lambda t: files.source_files(_paths(t)).select("file_path"))
query("s02_filtered_files", f"SELECT file_path FROM {PATHS} x WHERE regexp_matches(file_path, '\\.(go|py)$') AND NOT regexp_matches(file_path, '^/work/pkg1/')")(lambda t: files.source_files(_paths(t), ["*.go", "*.py"], ["pkg1/**"], "/work").select("file_path"))
query("s03_coordinator_files", f"SELECT file_path FROM {PATHS} x WHERE regexp_matches(file_path, '\\.(go|py|js|ts|java|md)$')")(lambda t: files.source_files(_paths(t), skipped=files.SKIPPED_BY_COORDINATOR).select("file_path"))
query("s05_go_and_python_files", f"SELECT file_path, CASE WHEN file_path LIKE '%.go' THEN 'go' ELSE 'python' END AS language FROM {PATHS} x WHERE file_path LIKE '%.go' OR file_path LIKE '%.py'")(lambda t: files.source_files(_paths(t)).where("language IN ('go', 'python')"))
query("s10_by_string_key", "SELECT id FROM ast_nodes WHERE method_name = 'Azure_1' AND type_name <> ''")(lambda t: t.ast_nodes.where(N.key().endswith(":Azure_1") & (F.col("method_name") == "Azure_1")).select("id"))
query("s22_go_sum", "SELECT name AS file_path, concat('m/', split_part(name, ' ', 1)) AS name, 'v1' AS version, 'go' AS type, '' AS git, true AS indirect, 1 AS line FROM (SELECT DISTINCT name FROM dependencies)")(
    lambda t: manifests.go_sum(t.dependencies.select("name").distinct().select(F.col("name").alias("file_path"), F.concat(F.lit("m/"), F.split("name", " ")[0], F.lit(" v1 h1:x=\nm/"), F.split("name", " ")[0], F.lit(" v2 h1:y=")).alias("text")))
)
query("s24_package_lock", "SELECT name AS file_path, name, substr(version, 2) AS version, 'npm' AS type, '' AS git, true AS indirect, 0 AS line FROM dependencies")(
    lambda t: manifests.package_lock(t.dependencies.select(F.col("name").alias("file_path"), F.concat(F.lit('{"packages": {"": {}, "node_modules/'), "name", F.lit('": {"version": "'), F.substring("version", 2, 9), F.lit('"}}}')).alias("text")))
)
query("s28_pipfile_lock", "SELECT name AS file_path, name, substr(version, 2) AS version, 'pip' AS type, '' AS git, true AS indirect, 0 AS line FROM dependencies")(
    lambda t: manifests.lock_pip(t.dependencies.select(F.col("name").alias("file_path"), F.concat(F.lit('{"default": {"'), "name", F.lit('": {"version": "=='), F.substring("version", 2, 9), F.lit('"}}}')).alias("text")))
)
query("s30_gradle", "SELECT name AS file_path, concat('g:', split_part(name, ' ', 1)) AS name, substr(version, 2) AS version, 'maven' AS type, '' AS git, false AS indirect, 1 AS line FROM dependencies")(
    lambda t: manifests.gradle(t.dependencies.select(F.col("name").alias("file_path"), F.concat(F.lit("implementation 'g:"), F.split("name", " ")[0], F.lit(":"), F.substring("version", 2, 9), F.lit("'")).alias("text")))
)
for _id, _file, _body in (
    ("s25_yarn_lock", "yarn.lock", '"%s@^1":\n  version "1.0"\n'), ("s26_pnpm_lock", "pnpm-lock.yaml", "packages:\n  /%s@1.0: {}\n"), ("s29_pom", "pom.xml", "<p><dependencies><dependency><groupId>%s</groupId><artifactId>a</artifactId></dependency></dependencies></p>"),
    ("s31_dockerfile", "Dockerfile", "ARG V=1\nFROM %s:${V}\n"), ("s32_compose", "docker-compose.yml", "services:\n  a:\n    image: %s:1\n"), ("s33_helm", "Chart.yaml", "dependencies:\n- {name: %s, version: 1.0.0}\n"),
):
    query(_id, f"SELECT count(DISTINCT split_part(name, ' ', 2)) AS n FROM dependencies")(  # noqa: F541
        lambda t, file=_file, body=_body: manifests.scan(t.dependencies.select(F.split("name", " ")[1].alias("w")).distinct().select(F.concat("w", F.lit("/" + file)).alias("file_path"), F.format_string(body, "w").alias("text"))).agg(F.count("*").alias("n"))
    )
COLUMNS = "SELECT 's' AS schema, CASE WHEN p_partkey % 3 = 0 THEN 'view' ELSE 'table' END AS kind, concat('t', p_partkey) AS tab FROM part"
query("s18_sql_schema", "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'type_view' ELSE 'type_table' END AS node_type, concat('t', p_partkey) AS type_name FROM part UNION ALL SELECT 'field_column', concat('t', p_partkey) FROM part")(
    lambda t: extract.sql_schema(
        t.spark,
        t.part.select(F.lit("s").alias("schema"), F.concat(F.lit("t"), "p_partkey").alias("table"), F.when(F.col("p_partkey") % 3 == 0, "view").otherwise("table").alias("kind"), F.lit("id").alias("column"), F.lit("int").alias("type")),
        t.spark.createDataFrame([], "schema string, table string, column string, to_table string, to_column string"),
    )[0].select("node_type", "type_name")
)
for _id, _language, _text in (("s12_extract_go", "go", "package p\n\nfunc (s *T) {}() int {{\n\tif x {{\n\t}}\n\treturn 1\n}}\n"), ("s14_extract_java", "java", "package p;\nclass T {{\n  int {}(int a) {{\n    if (a > 1) {{ return 1; }}\n    return 2;\n  }}\n}}\n"), ("s15_extract_javascript", "javascript", "function {}(a) {{\n  if (a) {{ return 1; }}\n  return 2;\n}}\n"), ("s16_extract_typescript", "typescript", "class T {{\n  {}(a: number) {{\n    if (a) {{ return 1; }}\n    return 2;\n  }}\n}}\n")):
    query(_id, "SELECT id, method_name, 2 AS cyclomatic_complexity FROM ast_nodes WHERE node_type = 'method'")(
        lambda t, language=_language, body=_text: extract.extract(t.ast_nodes.where("node_type = 'method'").select(F.col("id").cast("string").alias("file_path"), F.lit(language).alias("language"), F.replace(F.lit(body.replace("{{", "{").replace("}}", "}")) if language == "none" else F.lit(body.format("NAME")), F.lit("NAME"), F.col("method_name")).alias("text"))).where("node_type = 'method'").select(F.col("file_path").cast("long").alias("id"), "method_name", "cyclomatic_complexity")
    )

# ---- filters, projections and nested rows
query("f21_rule_matches", IDS + "(package_name = 'pkg1' OR starts_with(package_name, 'pkg1/') OR starts_with(package_name, 'pkg1.')) AND method_name LIKE 'B%'")(lambda t: t.ast_nodes.where(access.rule_matches(access.parse_line("pkg1:B*"), F.col("package_name"), F.col("method_name"))).select("id"))
query("f22_rule_applies_to_file", f"SELECT file_path FROM {PATHS} x WHERE regexp_matches(file_path, '^(.*/)?pkg1/[^/]*\\.go$')")(lambda t: _paths(t).where(P.rule_file(F.col("file_path"), "pkg1/*.go")))
query("f23_rule_text", "SELECT DISTINCT package_name FROM ast_nodes WHERE NOT (package_name LIKE 'p%1')")(lambda t: t.ast_nodes.select("package_name").distinct().where(P.rule_text(F.col("package_name"), "!p*1")))
query("f24_config_path", f"SELECT file_path FROM {PATHS} x WHERE starts_with(file_path, '/work/pkg3/')")(lambda t: _paths(t).where(P.config_path(F.col("file_path"), "/work/pkg3/**")))
query("f19_cli_pattern", IDS + "package_name = 'pkg4' AND lower(type_name) LIKE 'user%'")(lambda t: t.ast_nodes.where(P.query_predicate(P.parse_pattern("pkg4:user*:*:ignored"))).select("id"))
FUNCTION = "struct(method_name as name, transform(sequence(1, greatest(parameter_count, 1)), i -> struct(concat('parameter_', i) as name)) as parameters)"
query("f28_long_names", "SELECT id, 1 + greatest(parameter_count, 1) AS n_names, CASE WHEN strlen(method_name) > 8 THEN 1 ELSE 0 END + greatest(parameter_count, 1) AS n_long FROM ast_nodes WHERE node_type = 'method'")(
    lambda t: t.ast_nodes.where("node_type = 'method'").withColumn("names", text.names_of(F.expr(FUNCTION))).select("id", F.size("names").alias("n_names"), F.size(F.filter("names", lambda n: F.octet_length(n) > 8)).alias("n_long"))
)
query("f30_poor_comments", "SELECT id FROM comments WHERE contains(lower(text), 'deprecated') OR length(text) < 60")(lambda t: t.comments.withColumn("issues", F.array_compact(F.array(F.when(F.lower("text").contains("deprecated"), "outdated"), F.when(F.length("text") < 60, "short")))).where(F.size("issues") > 0).select("id"))
query("f32_first_analyzer", f"SELECT file_path, CASE WHEN starts_with(file_path, '/work/pkg1/') THEN 'one' WHEN file_path LIKE '%.go' THEN 'go' END AS analyzer FROM {PATHS} x")(lambda t: _paths(t).select("file_path", config.first_analyzer(F.col("file_path"), [("/work/pkg1/**", "one"), ("**/*.go", "go")]).alias("analyzer")))
query("f34_node_map", "SELECT id, concat(node_type, ':', cyclomatic_complexity) AS v FROM ast_nodes")(lambda t: t.ast_nodes.select("id", F.struct("node_type", "cyclomatic_complexity").alias("m")).select("id", F.concat("m.node_type", F.lit(":"), "m.cyclomatic_complexity").alias("v")))
query("f36_table_rows", "SELECT file_path, package_name, type_name, method_name, cyclomatic_complexity, line_count FROM ast_nodes")(lambda t: t.ast_nodes.select("file_path", "package_name", "type_name", "method_name", "cyclomatic_complexity", "line_count"))
query("f37_relative_path", f"SELECT substr(file_path, 7) AS path FROM {PATHS} x")(lambda t: _paths(t).select(reports.relative(F.col("file_path"), "/work").alias("path")))

# ---- joins, aggregates, sets
query("j01_external_edges", "SELECT e.id FROM ast_relationships e JOIN ast_nodes a ON a.id = e.from_ast_id LEFT JOIN ast_nodes b ON b.id = e.to_ast_id WHERE e.to_ast_id IS NULL OR b.package_name <> a.package_name")(
    lambda t: t.ast_relationships.join(t.ast_nodes.select(F.col("id").alias("from_ast_id"), F.col("package_name").alias("a")), "from_ast_id").join(t.ast_nodes.select(F.col("id").alias("to_ast_id"), F.col("package_name").alias("b")), "to_ast_id", "left").where("to_ast_id IS NULL OR b <> a").select("id")
)
query("j08_edge_ends", "SELECT e.id, a.file_path AS caller, b.file_path AS called FROM ast_relationships e JOIN ast_nodes a ON a.id = e.from_ast_id LEFT JOIN ast_nodes b ON b.id = e.to_ast_id WHERE e.relationship_type = 'call'")(
    lambda t: t.ast_relationships.where("relationship_type = 'call'").join(t.ast_nodes.select(F.col("id").alias("from_ast_id"), F.col("file_path").alias("caller")), "from_ast_id").join(t.ast_nodes.select(F.col("id").alias("to_ast_id"), F.col("file_path").alias("called")), "to_ast_id", "left").select("id", "caller", "called")
)
query("a11_repositories", "SELECT count(DISTINCT nullif(git, '')) AS n FROM dependencies")(lambda t: t.dependencies.agg(F.count_distinct(F.nullif("git", F.lit(""))).alias("n")))
QUALITY = {"**": {"max": 500}, "/work/pkg1/**": {"max": 100}, "*.py": {"max": 200}, "*.md": {"max": 0}}
query("a26_quality_setting", f"SELECT file_path, CASE WHEN file_path LIKE '%.py' THEN 200 WHEN starts_with(file_path, '/work/pkg1/') THEN 100 ELSE 500 END AS max FROM {PATHS} x")(lambda t: _paths(t).select("file_path", config.quality_setting(F.col("file_path"), QUALITY, "max").alias("max")))
query("a27_excludes", "SELECT id, CASE WHEN language = 'go' THEN 'vendor,go' ELSE concat('vendor,', language) END AS excludes FROM ast_nodes")(lambda t: t.ast_nodes.select("id", F.array_join(config.excludes(F.array(F.lit("vendor")), F.array("language"), F.array(F.lit("vendor"), F.col("language"))), ",").alias("excludes")))
query("a30_regroup_by_file", "SELECT file_path, count(*) AS n FROM violations GROUP BY 1")(lambda t: t.violations.repartition("file_path").groupBy("file_path").agg(F.count("*").alias("n")))
query("o04_roots_by_name", f"SELECT id, {NAME} AS name FROM ast_nodes WHERE id NOT IN (SELECT to_ast_id FROM ast_relationships WHERE relationship_type = 'call' AND to_ast_id IS NOT NULL AND from_ast_id IN (SELECT id FROM ast_nodes))")(lambda t: _roots(t))
query("o06_last_run", "SELECT max(executed_at) AS executed_at FROM linter_executions")(lambda t: t.linter_executions.orderBy(F.desc("executed_at")).limit(1).select("executed_at"))
query("u03_result_merge", "SELECT id FROM ast_nodes UNION ALL SELECT id FROM library_nodes")(lambda t: t.ast_nodes.select("id").unionByName(t.library_nodes.select("id")))
query("u05_distinct_strings", "SELECT id, package_name AS names FROM ast_nodes")(lambda t: t.ast_nodes.select("id", F.array_join(F.array_distinct(F.array("package_name", "package_name")), ",").alias("names")))
query("u09_edges_within", "SELECT id FROM ast_relationships WHERE from_ast_id IN (SELECT id FROM ast_nodes WHERE node_type = 'method') AND to_ast_id IN (SELECT id FROM ast_nodes WHERE node_type = 'method')")(lambda t: _within(t))
query("g10_folder_hierarchy", f"SELECT folder, count(*) AS files FROM (SELECT unnest(list_transform(range(1, len(p)), lambda k: array_to_string(p[1:k], '/'))) AS folder FROM (SELECT string_split(file_path, '/') AS p FROM {PATHS} x)) GROUP BY 1")(lambda t: reports.tree(_paths(t)).select("folder", "files"))


def _roots(t):
    from loomgraph.operators import graph

    return graph.roots(t.ast_nodes, t.ast_relationships).select("id", N.full_name().alias("name")).orderBy("name")


def _within(t):
    from loomgraph.operators import graph

    return graph.induced(t.ast_relationships, t.ast_nodes.where("node_type = 'method'"), None).select("id")


# ---- scalars
query("x02_full_name", f"SELECT id, {NAME} AS name FROM ast_nodes")(lambda t: t.ast_nodes.select("id", N.full_name().alias("name")))
query("x04_library_name", "SELECT id, concat_ws('.', nullif(package, ''), nullif(class, ''), nullif(method, '')) AS name FROM library_nodes")(lambda t: t.library_nodes.select("id", lookup.library_name().alias("name")))
query("x10_sanitized_url", "SELECT page_id, trim(regexp_replace(url, '[^A-Za-z0-9_]+', '_', 'g'), '_') AS s FROM pages")(lambda t: t.pages.select("page_id", paths.sanitize(F.col("url")).alias("s")))
query("x11_virtual_path", "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS kind, regexp_extract(url, '^[a-z]+://(.*)$', 1) AS rest FROM pages")(lambda t: t.pages.select("page_id", paths.virtual_type(F.col("url")).alias("kind"), paths.virtual_id(F.col("url")).alias("rest")))
query("x16_metric_value", "SELECT id, CASE WHEN parameter_count > 0 THEN parameter_count ELSE 1 END AS v FROM ast_nodes")(lambda t: t.ast_nodes.select("id", text.metric_value(F.col("parameter_count"), F.array(F.lit("x"))).alias("v")))
query("x18_java_complexity", "SELECT id, CAST(1 + 2 + (id % 2) AS INT) AS c FROM ast_nodes")(lambda t: t.ast_nodes.select("id", text.java_complexity(F.concat(F.lit("if (a) { for (;;) {} }"), F.when(F.col("id") % 2 == 1, " while (x)").otherwise(""))).cast("int").alias("c")))
query("x21_tag_default", "SELECT id, concat('d', id) AS v FROM ast_nodes")(lambda t: t.ast_nodes.select("id", text.struct_tag_default(F.concat(F.lit('json:"x" default:"d'), "id", F.lit('"'))).alias("v")))
query("x22_library_class", "SELECT id, CASE WHEN package NOT LIKE '%/%' THEN 'stdlib' WHEN package LIKE '%gin%' THEN 'gin' WHEN package LIKE '%gorm%' THEN 'gorm' WHEN package LIKE '%database%' THEN 'database' ELSE 'third-party' END AS class FROM library_nodes")(lambda t: t.library_nodes.select("id", text.classify_library(F.col("package")).alias("class")))
query("x23_category", "SELECT id, CASE " + " ".join(f"WHEN contains(package, '{w}') THEN '{k}'" for w, k in text.CATEGORIES) + " ELSE 'other' END AS category FROM library_nodes")(lambda t: t.library_nodes.select("id", text.category(F.col("package")).alias("category")))
query("x24_is_stdlib", "SELECT id, package NOT LIKE '%/%' OR split_part(package, '/', 1) IN ('net', 'encoding', 'database') AS std FROM library_nodes")(lambda t: t.library_nodes.select("id", lookup.is_stdlib(F.col("package")).alias("std")))
query("x28_substitution", "SELECT id, concat('a/', 'one', '/', package_name) AS v FROM ast_nodes")(lambda t: t.ast_nodes.select("id", _substitute(F.concat(F.lit("a/${V}/"), "package_name")).alias("v")))
query("x30_git_url", "SELECT id, 'https://h/r' AS repository, concat('sub', id) AS subdir, concat('v', id) AS version FROM ast_nodes")(lambda t: t.ast_nodes.withColumn("u", F.concat(F.lit("https://h/r//sub"), "id", F.lit("@v"), "id")).select("id", *[text.git_url(F.col("u"))[k].alias(k) for k in ("repository", "subdir", "version")]))
TOLD = "lower(concat('function to ', text))"
LONG = f"list_filter(regexp_split_to_array({TOLD}, '\\s+'), lambda w: w <> '')"
query("x36_redundant", f"SELECT id, len(list_filter({LONG}, lambda w: strlen(w) > 2)) / len({LONG}) > 0.8 AS redundant FROM comments")(lambda t: t.comments.withColumn("told", F.concat(F.lit("function to "), "text")).select("id", quality.redundant(F.col("told"), F.col("told")).alias("redundant")))
query("x39_missing_documentation", "SELECT id, NOT is_private AND (line_count >= 10 OR parameter_count > 2) AS missing FROM ast_nodes WHERE node_type = 'method'")(lambda t: t.ast_nodes.where("node_type = 'method'").select("id", quality.missing_documentation(F.col("is_private"), F.col("line_count"), F.col("parameter_count"), F.from_json(F.lit("[]"), "array<struct<type:string,word_count:int>>")).alias("missing")))
query("x41_comment_score", "SELECT id, CASE WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) <= 10 THEN 0.8 ELSE 0.5 END::DOUBLE AS score FROM comments")(lambda t: t.comments.select("id", quality.score(F.col("text")).alias("score")))
query("x44_version_alias", "SELECT id, id % 3 <> 2 AS alias FROM ast_nodes")(lambda t: t.ast_nodes.select("id", text.version_alias(F.when(F.col("id") % 3 == 0, "latest").when(F.col("id") % 3 == 1, "GA~2").otherwise("v1")).alias("alias")))
query("x48_api_namespace", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'v1_2' ELSE lower(replace(p_name, ' ', '_')) END AS ns FROM part")(lambda t: t.part.select("p_partkey", text.api_namespace(F.when(F.col("p_partkey") % 2 == 0, "1.2"), F.col("p_name")).alias("ns")))
query("x49_package_of_path", f"SELECT file_path, regexp_extract(file_path, '([^/]+)/[^/]+$', 1) AS package FROM {PATHS} x")(lambda t: _paths(t).select("file_path", text.package_of_path(F.col("file_path"), "python").alias("package")))
query("x50_import_string", "SELECT id, concat(CASE WHEN id % 3 = 0 THEN '!' WHEN id % 3 = 1 THEN '+' ELSE '' END, package_name) AS rule FROM ast_nodes")(lambda t: t.ast_nodes.select("id", text.rule_to_import(F.when(F.col("id") % 3 == 0, "deny").when(F.col("id") % 3 == 1, "override").otherwise("allow"), F.col("package_name")).alias("rule")))
query("t08_skip_by_path", "SELECT file_path, 1704067300 - last_modified < 60 AS skip FROM file_metadata")(lambda t: t.file_metadata.select("file_path", (F.lit(1704067300) - F.col("last_modified") < 60).alias("skip")))
query("t09_retention", "SELECT file_path FROM file_metadata WHERE last_modified >= 1704067210")(lambda t: t.file_metadata.where("last_modified >= 1704067210").select("file_path"))
query("t14_cached_result", "SELECT id FROM violations WHERE source = 'error'")(lambda t: store.select(t.violations, sources=["error"]).select("id"))
query("s42_latest_per_tool", "SELECT linter_name, work_dir, max(executed_at) AS last_run FROM linter_executions GROUP BY ALL")(lambda t: stats.summary(t.linter_executions).select("linter_name", "work_dir", "last_run"))


def _substitute(column):
    from loomgraph.operators.deps import substitute

    return substitute(column, {"V": "one"})
