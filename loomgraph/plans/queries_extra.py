"""Queries on the inventory's remaining parts: manifests' discovery, rule rows, registries and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import patterns as P
from loomgraph.functions import paths, text
from loomgraph.operators import access, config, deps, lookup, reports
from loomgraph.plans.registry import query
from loomgraph.sources import extract, files, linters, manifests

PATHS = "(SELECT DISTINCT file_path FROM ast_nodes)"
#: Extensions of the languages that the engine knows: a lookup table.
EXTENSIONS = {"go": "go", "py": "python", "js": "javascript", "ts": "typescript", "java": "java", "md": "markdown"}
VALUES = ", ".join(f"('{e}', '{n}')" for e, n in EXTENSIONS.items())


def _paths(t):
    return t.ast_nodes.select("file_path").distinct()


def _extensions(t):
    return t.spark.sql(f"SELECT * FROM VALUES {VALUES} AS e(extension, language)")


query("s08_raw_sql", "SELECT package_name, max(cyclomatic_complexity) AS most FROM ast_nodes GROUP BY 1")(lambda t: t.spark.sql("SELECT package_name, max(cyclomatic_complexity) AS most FROM {n} GROUP BY package_name", n=t.ast_nodes))
SPEC = 'concat(\'{{"openapi": "3", "info": {{"title": "t", "version": "1"}}, "paths": {{\', CASE WHEN p_partkey % 3 = 0 THEN \'\' ELSE \'"/x": {{"get": {{}}}}\' END, \'}}}}\')'.replace("{{", "{").replace("}}", "}")
query("s20_openapi_validation", "SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0")(lambda t: extract.openapi(t.part.select(F.col("p_partkey").cast("string").alias("file_path"), F.expr(SPEC).alias("text"))).select(F.col("file_path").cast("long").alias("p_partkey")).distinct())
MANIFEST = "CASE p_partkey % 4 WHEN 0 THEN concat('a', p_partkey, '/go.mod') WHEN 1 THEN concat('a', p_partkey, '/pom.xml') WHEN 2 THEN concat('a', p_partkey, '/notes.txt') ELSE concat('a', p_partkey, '/Dockerfile') END"
query("s34_manifest_jobs", f"SELECT {MANIFEST} AS file_path FROM part WHERE p_partkey % 4 <> 2")(
    lambda t: t.part.select(F.expr(MANIFEST).alias("file_path")).where(F.element_at(F.split("file_path", "/"), -1).rlike("|".join(["^" + p for p, _ in manifests.PARSERS] + ["^" + p for p in manifests.JVM])))
)
query("s51_call_violations", "SELECT e.id FROM ast_relationships e JOIN ast_nodes a ON a.id = e.from_ast_id JOIN ast_nodes b ON b.id = e.to_ast_id WHERE e.relationship_type = 'call' AND b.package_name = 'pkg1' AND b.method_name LIKE 'B%'")(
    lambda t: access.call_violations(t.ast_nodes, t.ast_relationships, [access.parse_line("pkg1:!B*")]).select("id")
)
query("f31_excluded_folders", f"SELECT file_path FROM {PATHS} x WHERE NOT list_contains(string_split(file_path, '/'), 'pkg1')")(lambda t: _paths(t).where(files.visible(F.col("file_path"), ("pkg1",))))
query("f38_location_lines", "SELECT id, concat(file_path, ':', start_line) AS location FROM ast_nodes WHERE node_type = 'method'")(lambda t: reports.locations(t.ast_nodes.where("node_type = 'method'")).select("id", "location"))
query("j03_libraries_of_node", "SELECT r.id, l.package FROM library_relationships r LEFT JOIN library_nodes l ON l.id = r.library_id WHERE r.ast_id = 7")(lambda t: lookup.with_library(t.library_relationships.where("ast_id = 7"), t.library_nodes).select("id", "package"))
query("j13_foreign_keys", "SELECT count(*) AS edges, count(*) FILTER (n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey < 3)) AS resolved FROM nation")(lambda t: _foreign_keys(t))
query("j21_module_resolution", "SELECT id, CASE WHEN id % 3 = 0 THEN 'stdlib' WHEN id % 3 = 1 THEN 'relative' ELSE 'third-party' END AS origin FROM ast_nodes")(
    lambda t: t.ast_nodes.select("id", lookup.resolve_module(F.when(F.col("id") % 3 == 0, "os.path").when(F.col("id") % 3 == 1, ".x").otherwise("numpy"), "python").alias("origin"))
)
query("o07_sorted_folders", "SELECT package_name, string_agg(DISTINCT node_type, ',' ORDER BY node_type) AS kinds FROM ast_nodes GROUP BY 1")(lambda t: t.ast_nodes.groupBy("package_name").agg(F.array_join(F.sort_array(F.collect_set("node_type")), ",").alias("kinds")))
query("o08_languages_by_count", f"SELECT e.language, count(*) AS n FROM ast_nodes JOIN (VALUES {VALUES}) e(extension, language) ON extension = regexp_extract(file_path, '\\.([a-z]+)$', 1) GROUP BY 1")(lambda t: reports.sources(t.ast_nodes).orderBy(F.desc("n"), "language"))
query("x06_virtual_path_hash", "SELECT page_id, sha256(url) AS h FROM pages")(lambda t: t.pages.select("page_id", F.sha2("url", 256).alias("h")))
query("x13_since_duration", "SELECT id FROM violations WHERE stored_at >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY")(lambda t: t.violations.where(F.col("stored_at") >= F.expr(f"TIMESTAMP_NTZ '2024-01-31 00:00:00' - INTERVAL {int(paths.duration_seconds('2w'))} SECONDS")).select("id"))
query("x32_interpolated_pattern", "SELECT id FROM ast_nodes WHERE package_name = 'pkg3'")(lambda t: t.ast_nodes.where(P.query_predicate(P.parse_pattern(text.interpolate("${p}:*", {"p": "pkg3"})))).select("id"))
query("x43_release_tags", "SELECT id, id % 2 <> 0 AS release FROM ast_nodes")(lambda t: t.ast_nodes.select("id", deps.is_release(F.concat(F.lit("v1."), "id", F.when(F.col("id") % 2 == 0, "-beta").otherwise(""))).alias("release")))
query("x45_detector_glob", f"SELECT file_path FROM {PATHS} x WHERE regexp_matches(file_path, '_1[^/]*\\.go$')")(lambda t: _paths(t).where(P.file_glob(F.col("file_path"), "*_1*.go")))
query("x46_clean_messages", "SELECT id, message FROM violations")(lambda t: t.violations.select("id", linters.clean_message(F.concat("file_path", F.lit(":1:2: "), "message", F.lit(" (errcheck)"))).alias("message")))
query("x47_all_names", "SELECT id, concat_ws(',', method_name, CASE WHEN parameter_count > 0 THEN 'p1' END) AS names FROM ast_nodes")(
    lambda t: t.ast_nodes.select("id", F.array_join(text.names_of(F.struct(F.col("method_name").alias("name"), F.when(F.col("parameter_count") > 0, F.array(F.struct(F.lit("p1").alias("name")))).alias("parameters"))), ",").alias("names"))
)
query("t12_stale_by_time", "SELECT f.file_path FROM files f JOIN file_metadata m USING (file_path) WHERE f.mod_time > m.last_modified")(lambda t: t.files.join(t.file_metadata.select("file_path", "last_modified"), "file_path").where("mod_time > last_modified").select("file_path"))
query("t13_stale_connections", "SELECT file_path, 1704070000 - last_modified > 3600 AS stale FROM file_metadata")(lambda t: t.file_metadata.select("file_path", deps.alias_expired(F.col("last_modified"), F.lit(1704070000), 3600).alias("stale")))


def _foreign_keys(t):
    columns = t.region.where("r_regionkey < 3").select(F.lit("s").alias("schema"), F.concat(F.lit("r"), "r_regionkey").alias("table"), F.lit("table").alias("kind"), F.lit("id").alias("column"), F.lit("int").alias("type"))
    keys = t.nation.select(F.lit("s").alias("schema"), F.concat(F.lit("n"), "n_nationkey").alias("table"), F.lit("region").alias("column"), F.concat(F.lit("r"), "n_regionkey").alias("to_table"), F.lit("id").alias("to_column"))
    edges = extract.sql_schema(t.spark, columns, keys)[1]
    return edges.agg(F.count("*").alias("edges"), F.count("to_ast_id").alias("resolved"))
