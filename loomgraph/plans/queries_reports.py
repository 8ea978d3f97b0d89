"""Queries on reports, statistics, stores, dependencies, quality, graphs and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import nodes as N
from loomgraph.functions import paths
from loomgraph.operators import deps, graph, quality, reports, stats, store
from loomgraph.plans.registry import query
from loomgraph.sources import extract, files, linters, manifests
from loomgraph.streaming import incremental

NAME = "concat_ws('.', nullif(package_name, ''), nullif(type_name, ''), nullif(method_name, ''), nullif(field_name, ''))"
LANG = "CASE " + " ".join(f"WHEN regexp_matches(file_path, '{r}') THEN '{n}'" for n, r in {"go": "\\.go$", "python": "\\.py$", "javascript": "\\.js$", "typescript": "\\.ts$", "java": "\\.java$", "markdown": "\\.md$"}.items()) + " ELSE 'other' END"


def now():
    """The fixed instant that time-dependent queries take as the present."""
    return F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")


# ---- node reports
query("a01_overview", "SELECT coalesce(node_type, 'total') AS node_type, count(*) AS n FROM ast_nodes WHERE file_path LIKE '/work/%' GROUP BY ROLLUP (node_type)")(lambda t: reports.overview(t.ast_nodes, "/work/"))
query("a02_sources", f"SELECT {LANG} AS language, count(*) AS n FROM ast_nodes GROUP BY 1")(lambda t: reports.sources(t.ast_nodes))
query("a05_cache_stats", "SELECT count(*) AS nodes, count(DISTINCT file_path) AS files, max(last_modified) AS last_modified FROM ast_nodes")(lambda t: reports.cache_stats(t.ast_nodes))
query("a06_analysis_summary", "SELECT count(DISTINCT file_path) AS files, count(*) AS nodes, count(*) FILTER (node_type = 'method') AS methods, count(*) FILTER (node_type = 'type') AS types, round(avg(cyclomatic_complexity) FILTER (node_type = 'method'), 6) AS avg_complexity, max(cyclomatic_complexity) FILTER (node_type = 'method') AS max_complexity, (SELECT count(*) FROM ast_relationships) AS edges FROM ast_nodes")(
    lambda t: reports.analysis_summary(t.ast_nodes, t.ast_relationships).withColumn("avg_complexity", F.round("avg_complexity", 6))
)
query("a07_file_counts", """SELECT file_path, count(*) FILTER (node_type = 'method') AS methods, count(*) FILTER (node_type = 'type') AS types, count(*) FILTER (node_type = 'field') AS fields, count(*) FILTER (node_type = 'variable') AS variables,
  CAST(coalesce(sum(e), 0) AS BIGINT) AS edges, CAST(coalesce(sum(l), 0) AS BIGINT) AS libraries FROM ast_nodes LEFT JOIN (SELECT from_ast_id AS id, count(*) AS e FROM ast_relationships GROUP BY 1) USING (id) LEFT JOIN (SELECT ast_id AS id, count(*) AS l FROM library_relationships GROUP BY 1) USING (id) GROUP BY 1""")(
    lambda t: reports.file_counts(t.ast_nodes, t.ast_relationships, t.library_relationships)
)
query("a23_query_summary", "SELECT count(*) AS matches, count(DISTINCT file_path) AS files, count(DISTINCT nullif(package_name, '')) AS packages FROM ast_nodes WHERE lower(type_name) LIKE '%service%'")(lambda t: reports.query_summary(t.ast_nodes.where("lower(type_name) LIKE '%service%'")))
query("o01_complex_nodes", "SELECT id, cyclomatic_complexity FROM ast_nodes WHERE cyclomatic_complexity >= 18")(lambda t: reports.complex_nodes(t.ast_nodes, 18).select("id", "cyclomatic_complexity"))
query("o02_complex_methods", "SELECT id, cyclomatic_complexity FROM ast_nodes WHERE node_type = 'method' AND cyclomatic_complexity > 5")(lambda t: reports.complex_nodes(t.ast_nodes.where("node_type = 'method'"), 6).select("id", "cyclomatic_complexity"))
query("o03_edges_in_order", "SELECT id, from_ast_id, line_no FROM ast_relationships")(lambda t: t.ast_relationships.orderBy("from_ast_id", "line_no").select("id", "from_ast_id", "line_no"))
query("o05_violations_of_sources", "SELECT id, file_path, line FROM violations WHERE source IN ('error', 'click')")(lambda t: store.select(t.violations, sources=["error", "click"]).orderBy("file_path", "line", "col").select("id", "file_path", "line"))
query("o09_limit_offset", "SELECT id, cyclomatic_complexity FROM ast_nodes ORDER BY cyclomatic_complexity DESC, id LIMIT 10 OFFSET 5")(lambda t: t.ast_nodes.select("id", "cyclomatic_complexity").orderBy(F.desc("cyclomatic_complexity"), "id").offset(5).limit(10))
query("o10_signatures", f"SELECT id, concat({NAME}, '(', parameter_count, ')') AS signature FROM ast_nodes WHERE node_type = 'method' AND parameter_count > 0")(lambda t: t.ast_nodes.where("node_type = 'method' AND parameter_count > 0").select("id", F.concat(N.full_name(), F.lit("("), "parameter_count", F.lit(")")).alias("signature")))
query("f35_locations", f"SELECT id, concat(substr(file_path, 7), ':', start_line) AS location, {NAME} AS name, CASE WHEN end_line > start_line THEN concat(start_line, '-', end_line) ELSE start_line::VARCHAR END AS lines FROM ast_nodes")(lambda t: reports.locations(t.ast_nodes, "/work"))
query("s46_template", "SELECT id, concat(package_name, '/', type_name, ' @', start_line, ' [', node_type, '] ', cyclomatic_complexity) AS line FROM ast_nodes")(lambda t: reports.template(t.ast_nodes, "{{.Package}}/{{.Type}} @{{.StartLine}} [{{.NodeType}}] {{.Complexity}}"))
query("j15_hierarchy", "SELECT parent_id, CAST(count(*) AS INT) AS n_children, string_agg(id::VARCHAR, ',' ORDER BY start_line, id) AS children FROM ast_nodes WHERE parent_id IS NOT NULL GROUP BY 1")(lambda t: reports.hierarchy(t.ast_nodes))

# ---- violation reports
query("a13_consolidated", "SELECT count(DISTINCT file_path) AS files, count(DISTINCT rule) AS rules, count(DISTINCT coalesce(nullif(source, ''), 'import-rules')) AS linters, count(*) FILTER (source = '') AS own, count(*) FILTER (source <> '') AS external FROM violations")(lambda t: reports.consolidated(t.violations))
query("a14_by_file", "SELECT file_path, count(*) AS n, count(DISTINCT rule) AS rules FROM violations GROUP BY 1")(lambda t: reports.by_file(t.violations))
query("a15_by_source", "SELECT coalesce(nullif(source, ''), 'import-rules') AS source, count(*) AS n FROM violations GROUP BY 1")(lambda t: reports.by_source(t.violations))
query("a16_tree", "SELECT folder, CAST(sum(n) AS BIGINT) AS n, count(*) AS files FROM (SELECT n, unnest(list_transform(range(1, len(p)), lambda k: array_to_string(p[1:k], '/'))) AS folder FROM (SELECT string_split(file_path, '/') AS p, count(*) AS n FROM violations GROUP BY file_path)) GROUP BY 1")(lambda t: reports.tree(t.violations))
query("a17_compact", "SELECT file_path, string_agg(concat(rule, '×', n), ', ' ORDER BY concat(rule, '×', n)) AS rules FROM (SELECT file_path, rule, count(*) AS n FROM violations GROUP BY ALL) GROUP BY 1")(lambda t: reports.compact(t.violations))
query("a18_fixable", "SELECT count(*) AS total, count(*) FILTER (fixable) AS fixable, count(*) FILTER (fixable AND fix_applicability = 'unsafe') AS unsafe FROM violations")(lambda t: reports.fixable(t.violations))
query("a22_violation_stats", "SELECT count(*) AS violations, count(DISTINCT file_path) AS files FROM violations")(lambda t: t.violations.agg(F.count("*").alias("violations"), F.count_distinct("file_path").alias("files")))
query("s44_csv", "SELECT id, concat_ws(',', file_path, line, col, rule, message) AS record FROM violations")(lambda t: reports.csv_lines(t.violations))
query("s45_markdown", "SELECT id, concat('| ', file_path, ' | ', line, ' | ', rule, ' | ', message, ' |') AS record FROM violations")(lambda t: reports.markdown_lines(t.violations))
query("u02_union_without_dedup", "SELECT file_path, rule FROM violations WHERE source = 'error' UNION ALL SELECT file_path, rule FROM violations")(lambda t: t.violations.where("source = 'error'").select("file_path", "rule").unionByName(t.violations.select("file_path", "rule")))

# ---- incremental
query("t01_needs_analysis", "SELECT f.file_path FROM files f LEFT JOIN file_metadata m ON m.file_path = f.file_path AND m.file_hash = f.file_hash WHERE m.file_path IS NULL")(lambda t: store.needs_analysis(t.files, t.file_metadata).select("file_path"))
query("t04_needs_rescan", "SELECT f.file_path FROM files f LEFT JOIN file_metadata m ON m.file_path = f.file_path WHERE m.file_path IS NULL OR f.mod_time > m.last_modified OR f.file_hash <> m.file_hash")(lambda t: store.needs_rescan(t.files, t.file_metadata).select("file_path"))
GENERATION = "SELECT CASE WHEN id % 10 = 0 THEN id + 5000000 ELSE id END AS id, file_path, package_name, type_name, method_name, CASE WHEN id % 10 = 0 THEN concat(field_name, 'x') ELSE field_name END AS field_name, start_line + 1 AS start_line FROM ast_nodes WHERE package_name IN ('pkg1', 'pkg2') AND id % 9 <> 0"
query("t02_merge_nodes", f"""WITH g AS ({GENERATION}), ids AS (SELECT file_path, package_name, type_name, method_name, field_name, min(id) AS id FROM ast_nodes GROUP BY ALL)
SELECT file_path, package_name, type_name, method_name, field_name, start_line, coalesce(ids.id, -1) AS kept_id FROM g LEFT JOIN ids USING (file_path, package_name, type_name, method_name, field_name)
UNION ALL SELECT file_path, package_name, type_name, method_name, field_name, start_line, id FROM ast_nodes WHERE file_path NOT IN (SELECT file_path FROM g)""")(
    lambda t: _merged(t)
)


def _merged(t):
    columns = ["id", *N.NATURAL_KEY, "start_line"]
    changed = F.col("id") % 10 == 0
    new = t.ast_nodes.where("package_name IN ('pkg1', 'pkg2') AND id % 9 <> 0").withColumn("field_name", F.when(changed, F.concat("field_name", F.lit("x"))).otherwise(F.col("field_name"))).withColumn("start_line", F.col("start_line") + 1)
    merged = store.merge_nodes(t.ast_nodes.select(columns), new.select(columns))
    # ids of new keys are hashes: they show as -1, as the oracle has no such hash
    known = t.ast_nodes.select("id").withColumn("kept_id", F.col("id"))
    return merged.join(known, "id", "left").select(*N.NATURAL_KEY, "start_line", F.coalesce("kept_id", F.lit(-1)).alias("kept_id"))


GONE = "(SELECT id FROM ast_nodes WHERE file_path = '/work/pkg1/economy_1.go')"
query("t03_delete_file", f"SELECT 'node' AS what, id FROM ast_nodes WHERE id NOT IN {GONE} UNION ALL SELECT 'edge', id FROM ast_relationships WHERE from_ast_id NOT IN {GONE} AND coalesce(to_ast_id NOT IN {GONE}, true) UNION ALL SELECT 'library edge', id FROM library_relationships WHERE ast_id NOT IN {GONE}")(lambda t: _without_file(t))


def _without_file(t):
    nodes, edges, uses = (d.select("id") for d in store.delete_file(t.ast_nodes, t.ast_relationships, "/work/pkg1/economy_1.go", t.library_relationships))
    return nodes.withColumn("what", F.lit("node")).union(edges.withColumn("what", F.lit("edge"))).union(uses.withColumn("what", F.lit("library edge")))


query("t10_clear", "SELECT id FROM violations WHERE NOT (stored_at < TIMESTAMP '2024-01-10' AND regexp_matches(file_path, '^/work/pkg1/'))")(lambda t: store.clear(t.violations, F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'"), "/work/pkg1/**").select("id"))
query("s42_replace_violations", "SELECT id FROM violations WHERE NOT (source = 'error' AND file_path IN (SELECT file_path FROM violations WHERE line < 20)) UNION ALL SELECT id + 1000000 FROM violations WHERE source = 'error' AND line < 20")(
    lambda t: store.replace_violations(t.violations, t.violations.where("source = 'error' AND line < 20").withColumn("id", F.col("id") + 1000000), t.violations.where("line < 20").select("file_path", F.lit("error").alias("source"))).select("id")
)
query("s40_upsert_library_nodes", "SELECT id, framework FROM library_nodes WHERE package <> 'os' UNION ALL SELECT id, 'changed' FROM library_nodes WHERE package = 'os'")(lambda t: store.upsert(t.library_nodes, t.library_nodes.where("package = 'os'").withColumn("framework", F.lit("changed")), ["id"]).select("id", "framework"))
query("u04_orphans", "SELECT id FROM ast_nodes EXCEPT SELECT from_ast_id FROM ast_relationships")(lambda t: t.ast_nodes.select("id").join(t.ast_relationships.select(F.col("from_ast_id").alias("id")), "id", "left_anti"))

# ---- execution statistics
KEY = "linter_name, work_dir"
query("a19_execution_summary", f"SELECT {KEY}, count(*) AS runs, round(avg(duration_ms), 6) AS avg_ms, CAST(sum(violation_count) AS BIGINT) AS violations, round(avg(success::INT), 6) AS success_rate, max(executed_at) AS last_run, max_by(duration_ms, executed_at) AS last_ms FROM linter_executions GROUP BY ALL")(
    lambda t: stats.summary(t.linter_executions).withColumns({c: F.round(c, 6) for c in ("avg_ms", "success_rate")})
)
query("a20_recent_stats", f"SELECT {KEY}, count(*) AS recent_runs, max(duration_ms) AS most FROM linter_executions WHERE executed_at >= TIMESTAMP '2024-01-24' GROUP BY ALL")(
    lambda t: t.linter_executions.where(F.col("executed_at") >= now() - F.expr("INTERVAL 7 DAYS")).groupBy(*stats.KEY).agg(F.count("*").alias("recent_runs"), F.max("duration_ms").alias("most"))
)
query("a21_history", "SELECT DISTINCT linter_name FROM linter_executions")(lambda t: t.linter_executions.select("linter_name").distinct().orderBy("linter_name"))
FOLD = f"""WITH RECURSIVE r AS (SELECT {KEY}, violation_count AS v, row_number() OVER (PARTITION BY {KEY} ORDER BY executed_at, violation_count) AS i FROM linter_executions),
s AS (SELECT {KEY}, 0::BIGINT AS i, 1.0::DOUBLE AS factor, 0 AS clean, 0 AS dirty FROM r WHERE i = 1 UNION ALL
  SELECT r.linter_name, r.work_dir, r.i, CASE WHEN r.v = 0 AND s.clean + 1 >= 5 THEN least(2.0, s.factor * 1.1) WHEN r.v > 0 AND s.dirty + 1 >= 3 THEN greatest(0.5, s.factor * 0.9) ELSE s.factor END,
    CASE WHEN r.v = 0 THEN s.clean + 1 ELSE 0 END, CASE WHEN r.v > 0 THEN s.dirty + 1 ELSE 0 END FROM s JOIN r ON r.linter_name = s.linter_name AND r.work_dir = s.work_dir AND r.i = s.i + 1)
SELECT {KEY}, round(factor, 6) AS factor, clean, dirty FROM s QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY i DESC) = 1"""
query("t05_adaptation", FOLD)(lambda t: stats.adaptation(t.linter_executions).withColumn("factor", F.round("factor", 6)))
query("t06_record_is_idempotent", "SELECT count(*) AS runs FROM linter_executions")(lambda t: stats.record(t.linter_executions, t.linter_executions.where("linter_name = 'error'")).agg(F.count("*").alias("runs")))
query("t07_should_skip", f"SELECT {KEY}, max(executed_at) AS last_run, 90000.0::DOUBLE AS debounce_s, date_diff('second', max(executed_at), TIMESTAMP '2024-01-31') < 90000 AS skip FROM linter_executions GROUP BY ALL")(lambda t: stats.should_skip(t.linter_executions, now(), 90000.0))
query("x14_category", f"SELECT {KEY}, CASE WHEN avg(duration_ms) < 1000 THEN 'Fast' WHEN avg(duration_ms) < 5000 THEN 'Medium' WHEN avg(duration_ms) < 15000 THEN 'Slow' ELSE 'Very Slow' END AS category FROM linter_executions GROUP BY ALL")(
    lambda t: stats.summary(t.linter_executions).select(*stats.KEY, stats.category(F.col("avg_ms")).alias("category"))
)
BASE_S = "CASE WHEN a IS NULL THEN 300 WHEN a < 100 THEN 0 WHEN a < 1000 THEN 5 WHEN a < 30000 THEN 300 WHEN a < 300000 THEN 3600 WHEN a < 900000 THEN 10800 ELSE 28800 END"
DEBOUNCE = FOLD.replace(f"SELECT {KEY}, round(factor, 6) AS factor, clean, dirty FROM s", f", f AS (SELECT {KEY}, factor FROM s").replace("ORDER BY i DESC) = 1", f"ORDER BY i DESC) = 1), c AS (SELECT {KEY}, avg(duration_ms) AS a, count(*) AS n FROM linter_executions WHERE executed_at >= TIMESTAMP '2024-01-24' GROUP BY ALL) SELECT {KEY}, round(factor, 6) AS factor, coalesce(n, 0) AS recent_runs, round(least({BASE_S} * factor, 86400), 4) AS debounce_s FROM f LEFT JOIN c USING (linter_name, work_dir)")
query("x15_debounce", DEBOUNCE)(lambda t: stats.debounce(t.linter_executions, now()).withColumns({"factor": F.round("factor", 6), "debounce_s": F.round("debounce_s", 4)}))
query("w03_streaks", f"SELECT {KEY}, CAST(island AS BIGINT) AS island, clean, count(*) AS runs FROM (SELECT *, sum(change) OVER (PARTITION BY {KEY} ORDER BY executed_at, duration_ms ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, violation_count = 0 AS clean, CASE WHEN coalesce(lag(violation_count = 0) OVER (PARTITION BY {KEY} ORDER BY executed_at, duration_ms) <> (violation_count = 0), true) THEN 1 ELSE 0 END AS change FROM linter_executions)) GROUP BY ALL")(
    lambda t: stats.streaks(t.linter_executions)
)
query("w04_latest_run", f"SELECT {KEY}, max(executed_at) AS last_run FROM linter_executions GROUP BY ALL")(lambda t: t.linter_executions.groupBy(*stats.KEY).agg(F.max("executed_at").alias("last_run")))

# ---- dependencies
query("a10_conflicts", "SELECT name, array_to_string(list_sort(list(DISTINCT version)), ',') AS versions, CAST(count(DISTINCT version) AS INT) AS n_versions, 'latest' AS strategy FROM dependencies GROUP BY 1 HAVING count(DISTINCT version) > 1")(lambda t: deps.conflicts(t.dependencies))
query("a12_tree_summary", "SELECT count(*) AS total, count(*) FILTER (depth = 0) AS roots, max(depth) AS max_depth, count(DISTINCT nullif(git, '')) AS repositories FROM dependencies")(lambda t: deps.tree_summary(t.dependencies))
query("u06_distinct_dependencies", "SELECT type, name, version, max_by(depth, depth * 10 + length(git)) AS depth FROM dependencies GROUP BY ALL")(lambda t: deps.distinct(t.dependencies.withColumn("seq", F.col("depth") * 10 + F.length("git")), "seq").select("type", "name", "version", "depth"))
query("f27_dependency_filter", "SELECT name, version, type, depth FROM dependencies WHERE (regexp_matches(name, '^b[^/]*$') OR type = 'npm') AND NOT regexp_matches(name, '^[^/]* a[^/]*$')")(lambda t: t.dependencies.where(deps.matches_filter("b*, npm, !* a*")).select("name", "version", "type", "depth"))
EDGES = "SELECT DISTINCT p_brand AS parent, p_type AS child FROM part UNION SELECT DISTINCT p_type, p_name FROM part"
query("g09_dependency_walk", f"WITH RECURSIVE m AS ({EDGES}), w AS (SELECT 'Brand#1' AS name, 0 AS depth UNION SELECT child, depth + 1 FROM w JOIN m ON parent = name WHERE depth < 2) SELECT name, min(depth) AS depth FROM w GROUP BY 1")(
    lambda t: graph.dependency_walk(t.part.select(F.col("p_brand").alias("parent"), F.col("p_type").alias("child")).unionByName(t.part.select(F.col("p_type").alias("parent"), F.col("p_name").alias("child"))), t.spark.sql("SELECT 'Brand#1' AS name"), 2)
)
query("t11_alias_expired", "SELECT file_path, 1704700000 - last_modified > 604800 AS expired FROM file_metadata")(lambda t: t.file_metadata.select("file_path", deps.alias_expired(F.col("last_modified"), F.lit(1704700000)).alias("expired")))
IMAGE = "concat(CASE WHEN id % 3 = 0 THEN 'ghcr.io/acme/' WHEN id % 3 = 1 THEN 'acme/' ELSE '' END, lower(package_name), CASE WHEN id % 2 = 0 THEN ':1.2' ELSE '' END)"
query("x26_docker_image", f"SELECT id, CASE WHEN id % 3 = 0 THEN 'ghcr.io' ELSE '' END AS registry, regexp_replace({IMAGE}, ':1.2$', '') AS name, CASE WHEN id % 2 = 0 THEN '1.2' ELSE 'latest' END AS tag, CASE WHEN id % 3 = 0 THEN concat('https://github.com/acme/', package_name) WHEN id % 3 = 1 THEN concat('https://hub.docker.com/r/acme/', package_name) ELSE concat('https://hub.docker.com/_/', package_name) END AS url FROM ast_nodes")(
    lambda t: t.ast_nodes.withColumn("image", F.expr(IMAGE)).select("id", *[deps.docker_image(F.col("image"))[k].alias(k) for k in ("registry", "name", "tag")], deps.docker_url(F.col("image")).alias("url"))
)
query("x31_go_git_url", "SELECT id, CASE WHEN package LIKE 'github.com/%' THEN concat('https://', package) WHEN package LIKE 'golang.org/x/%' THEN concat('https://github.com/golang/', substr(package, 14)) ELSE '' END AS url FROM library_nodes")(lambda t: t.library_nodes.select("id", deps.go_git_url(F.col("package")).alias("url")))
query("x29_npm_version", "SELECT id, concat(id % 7, '.', id % 3) AS version FROM ast_nodes")(lambda t: t.ast_nodes.select("id", deps.npm_version(F.concat(F.lit("^"), F.col("id") % 7, F.lit("."), F.col("id") % 3, F.lit(" extra"))).alias("version")))
query("w05_latest_release", "SELECT package_name, max_by(tag, id) AS tag FROM (SELECT package_name, id, concat('v1.', id, CASE WHEN id % 2 = 0 THEN '-rc1' ELSE '' END) AS tag FROM ast_nodes) WHERE tag NOT LIKE '%rc%' GROUP BY 1")(
    lambda t: t.ast_nodes.withColumn("tag", F.concat(F.lit("v1."), "id", F.when(F.col("id") % 2 == 0, "-rc1").otherwise(""))).where(deps.is_release(F.col("tag"))).groupBy("package_name").agg(F.max_by("tag", "id").alias("tag"))
)

# ---- quality and scalars
WORDS = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> ''))"
query("x01_word_count", f"SELECT id, CAST({WORDS.format('text')} AS INT) AS words FROM comments")(lambda t: t.comments.select("id", quality.word_count(F.col("text")).alias("words")))
query("x37_verbose", f"SELECT id, round((w - 50) / 50.0, 6) AS confidence FROM (SELECT id, {WORDS.format('text')} AS w FROM comments) WHERE w > 50")(lambda t: t.comments.select("id", F.round(quality.verbose(quality.word_count(F.col("text"))), 6).alias("confidence")).where("confidence IS NOT NULL"))
query("x38_outdated", "SELECT id, CASE WHEN contains(lower(text), 'deprecated') THEN 'deprecated' WHEN contains(lower(text), 'temporary') THEN 'temporary' WHEN contains(lower(text), 'quick fix') THEN 'quick fix' END AS keyword FROM comments")(lambda t: t.comments.select("id", quality.outdated(F.col("text")).alias("keyword")))
query("x35_trivial", "SELECT id, regexp_matches(trim(text), '^//\\s*\\w+\\s*$') OR " + " OR ".join(f"contains(lower(text), '{p}')" for p in quality.STRUCTURAL) + " AS trivial FROM comments")(lambda t: t.comments.select("id", quality.trivial(F.col("text")).alias("trivial")))
query("x40_summary", "SELECT id, CASE WHEN strpos(text, '.') > 1 AND strpos(text, '.') <= length(text) / 2 THEN substr(text, 1, strpos(text, '.')) ELSE text END AS summary FROM comments")(lambda t: t.comments.select("id", quality.summarize(F.col("text")).alias("summary")))
query("a24_comment_summary", f"SELECT count(*) AS total, count(*) FILTER ({WORDS.format('text')} > 10) AS complex, round(avg(CASE WHEN {WORDS.format('text')} <= 10 THEN 0.8 ELSE 0.5 END), 6) AS score FROM comments")(
    lambda t: t.comments.withColumn("w", quality.word_count(F.col("text"))).agg(F.count("*").alias("total"), F.count_if(F.col("w") > 10).alias("complex"), F.round(F.avg(quality.score(F.col("text"))), 6).alias("score"))
)
query("x33_long_names", "SELECT id, concat('function name ''', method_name, ''' is too long (', strlen(method_name), ' > 9)') AS message FROM ast_nodes WHERE strlen(method_name) > 9")(lambda t: t.ast_nodes.select("id", quality.too_long(F.col("method_name"), 9, "function").alias("message")).where("message IS NOT NULL"))
query("x34_disallowed_names", "SELECT id, CASE WHEN type_name LIKE 'User%1' THEN 'one' WHEN type_name LIKE '%Service_' THEN 'service' END AS reason FROM ast_nodes")(lambda t: t.ast_nodes.select("id", quality.disallowed(F.col("type_name"), [("User*1", "one"), ("*Service?", "service")]).alias("reason")))
query("x19_private_names", "SELECT id, NOT regexp_matches(regexp_extract(method_name, '^_*(.)', 1), '^[A-Z]') AS private FROM ast_nodes")(lambda t: t.ast_nodes.select("id", quality.is_private(F.col("method_name")).alias("private")))
query("x05_file_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")(lambda t: t.documents.select("doc_id", F.sha2("text", 256).alias("hash")))
query("x07_short_hash", "SELECT id, concat('hash_', substr(md5(file_path), 1, 16)) AS h FROM ast_nodes")(lambda t: t.ast_nodes.select("id", paths.short_hash(F.col("file_path")).alias("h")))
query("x08_sanitize", "SELECT id, trim(regexp_replace(regexp_replace(file_path, '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_') AS s FROM ast_nodes")(lambda t: t.ast_nodes.select("id", paths.sanitize(F.col("file_path")).alias("s")))
query("x09_connection_id", "SELECT id, concat('postgres_host', id % 4, '_5432_', package_name) AS c, concat('postgres://u:***@host', id % 4, ':5432/', package_name) AS masked FROM ast_nodes")(
    lambda t: t.ast_nodes.withColumn("url", F.concat(F.lit("postgres://u:secret@host"), F.col("id") % 4, F.lit(":5432/"), "package_name")).select("id", paths.connection_id(F.col("url")).alias("c"), paths.mask_connection(F.col("url")).alias("masked"))
)

# ---- graphs
INDUCED = "SELECT e.* FROM ast_relationships e WHERE e.relationship_type = 'call' AND e.from_ast_id IN (SELECT id FROM m) AND e.to_ast_id IN (SELECT id FROM m)"
M = "WITH m AS (SELECT * FROM ast_nodes WHERE package_name IN ('pkg1', 'pkg2', 'pkg3'))"


def _m(t):
    return t.ast_nodes.where("package_name IN ('pkg1', 'pkg2', 'pkg3')")


query("g01_call_graph", f"{M} SELECT id, from_ast_id, to_ast_id FROM ({INDUCED}) x")(lambda t: graph.induced(t.ast_relationships, _m(t)).select("id", "from_ast_id", "to_ast_id"))
query("g02_roots", f"{M} SELECT id FROM m WHERE id NOT IN (SELECT to_ast_id FROM ({INDUCED}) x)")(lambda t: graph.roots(_m(t), t.ast_relationships).select("id"))
query("g03_induced_subgraph", f"{M} SELECT id FROM ast_relationships WHERE from_ast_id IN (SELECT id FROM m) AND to_ast_id IN (SELECT id FROM m)")(lambda t: graph.induced(t.ast_relationships, _m(t), None).select("id"))
query("g04_bfs_reachability", "WITH RECURSIVE l AS (SELECT DISTINCT from_ast_id AS a, to_ast_id AS b FROM ast_relationships WHERE relationship_type = 'call' AND to_ast_id IS NOT NULL), w AS (SELECT 1::BIGINT AS id, 0 AS depth UNION SELECT b, depth + 1 FROM w JOIN l ON a = id WHERE depth < 3) SELECT id, min(depth) AS depth FROM w GROUP BY 1")(
    lambda t: graph.reachable(t.ast_relationships, t.spark.range(1, 2), 3)
)
query("g05_call_paths", "WITH RECURSIVE l AS (SELECT DISTINCT from_ast_id AS a, to_ast_id AS b FROM ast_relationships WHERE relationship_type = 'call' AND to_ast_id IS NOT NULL), w AS (SELECT [1::BIGINT] AS p, 0 AS depth, false AS circular UNION ALL SELECT list_append(p, b), depth + 1, list_contains(p, b) FROM w JOIN l ON a = p[-1] WHERE depth < 3 AND NOT circular) SELECT array_to_string(p, '>') AS path, depth, circular FROM w")(
    lambda t: graph.call_paths(t.ast_relationships, t.spark.range(1, 2), 3).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "depth", "circular")
)
LIBRARY = "concat_ws('.', nullif(l.package, ''), nullif(l.class, ''), nullif(l.method, ''), nullif(l.field, ''))"
USED = "FROM library_relationships r JOIN library_nodes l ON l.id = r.library_id WHERE r.ast_id IN (SELECT id FROM m)"
query("g06_dot", f"""{M} SELECT 0 AS part, id, concat('  n', id, ' [label="', {NAME}, '"];') AS line FROM m UNION ALL SELECT 1, id, concat('  n', from_ast_id, ' -> n', to_ast_id, ';') FROM ({INDUCED}) x
UNION ALL SELECT 2, min(l.id), concat('  "lib_', {LIBRARY}, '" [label="', {LIBRARY}, '", style="filled,rounded", fillcolor=lightblue];') {USED} GROUP BY {LIBRARY} UNION ALL SELECT 3, r.id, concat('  n', r.ast_id, ' -> "lib_', {LIBRARY}, '";') {USED}""")(
    lambda t: graph.dot_lines(_m(t), t.ast_relationships, t.library_relationships, t.library_nodes)
)
query("g07_graph_counts", f"{M} SELECT 'nodes' AS what, count(*) AS n FROM m UNION ALL SELECT 'edges', count(*) FROM ({INDUCED}) x UNION ALL SELECT 'roots', count(*) FROM m WHERE id NOT IN (SELECT to_ast_id FROM ({INDUCED}) x) UNION ALL SELECT 'libraries', count(DISTINCT library_id) FROM library_relationships WHERE ast_id IN (SELECT id FROM m)")(
    lambda t: graph.counts(_m(t), t.ast_relationships, t.library_relationships)
)

# ---- sources
query("s04_files_by_language", f"SELECT language, count(*) AS n_files FROM (SELECT DISTINCT file_path, {LANG} AS language FROM ast_nodes) GROUP BY 1")(lambda t: files.by_language(t.ast_nodes.select("file_path").distinct()))
query("s06_languages", f"SELECT DISTINCT {LANG} AS language FROM ast_nodes")(lambda t: files.languages(t.ast_nodes))
TEXTS = "SELECT CAST(doc_id AS VARCHAR) AS file_path, text FROM documents"


def _texts(t):
    return t.documents.select(F.col("doc_id").cast("string").alias("file_path"), "text")


query("s49_lines_at", f"SELECT file_path, 2 AS line, string_split(text, chr(10))[2] AS text FROM ({TEXTS})")(lambda t: files.lines_at(_texts(t), _texts(t).select("file_path", F.lit(2).alias("line"))))
query("s50_view", "SELECT doc_id AS id, greatest(1, 2 - 2) AS first_line, array_to_string(string_split(text, chr(10))[1:6], chr(10)) AS source FROM documents WHERE len(string_split(text, chr(10))) >= 2")(
    lambda t: files.view(_texts(t), t.documents.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("file_path"), F.lit(2).alias("start_line"), F.lit(4).alias("end_line")))
)
query("s21_go_mod", "SELECT concat(type, '/go.mod') AS file_path, concat('example.com/', replace(name, ' ', '-')) AS name, concat(version, '.0.0') AS version, 'go' AS type, '' AS git, indirect, CAST(3 AS INT) AS line FROM dependencies")(
    lambda t: manifests.go_mod(t.dependencies.select(F.concat("type", F.lit("/go.mod")).alias("file_path"), F.concat(F.lit("module m\n\nrequire example.com/"), F.replace("name", F.lit(" "), F.lit("-")), F.lit(" "), "version", F.lit(".0.0"), F.when(F.col("indirect"), " // indirect").otherwise("")).alias("text")))
)
query("s23_package_json", "SELECT concat(type, '/package.json') AS file_path, name, version, 'npm' AS type, '' AS git, false AS indirect, 0 AS line FROM dependencies")(
    lambda t: manifests.package_json(t.dependencies.select(F.concat("type", F.lit("/package.json")).alias("file_path"), F.concat(F.lit('{"dependencies": {"'), "name", F.lit('": "^'), "version", F.lit('"}}')).alias("text")))
)
query("s27_requirements", "SELECT name AS file_path, split_part(name, ' ', 1) AS name, substr(version, 2) AS version, 'pip' AS type, '' AS git, false AS indirect, CAST(2 AS INT) AS line FROM dependencies")(
    lambda t: manifests.requirements(t.dependencies.select(F.col("name").alias("file_path"), F.concat(F.lit("# none\n"), F.split("name", " ")[0], F.lit(">="), F.substring("version", 2, 9)).alias("text")))
)
query("s47_linter_reports", "SELECT concat('f', id, '.py') AS file_path, line, col, rule AS code, message, 'ruff' AS source, fixable, fix_applicability FROM violations WHERE source = 'error'")(
    lambda t: linters.read(
        t.violations.where("source = 'error'").select(
            F.lit("ruff").alias("tool"),
            F.to_json(F.array(F.struct(F.col("rule").alias("code"), "message", F.concat(F.lit("f"), "id", F.lit(".py")).alias("filename"), F.struct(F.col("line").alias("row"), F.col("col").alias("column")).alias("location"), F.when(F.col("fixable"), F.struct(F.col("fix_applicability").alias("applicability"))).alias("fix")))).alias("json"),
        )
    )
)
query("ext_daily_events", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")(lambda t: incremental.daily(t.events).withColumn("total", F.round("total", 4)))
query("ext_sessions", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, CASE WHEN coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE, true) THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, s")(lambda t: incremental.sessions(t.events))
