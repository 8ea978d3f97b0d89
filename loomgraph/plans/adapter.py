"""Code-graph tables derived from the driver's tables.

Each derivation is one SQL text that both engines run: with DataFrames in place of the `{name}`s
in Spark, and as a common table expression in the oracle.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

NODE = "CASE p_size % 5 WHEN 0 THEN 'type' WHEN 1 THEN 'method' WHEN 2 THEN 'field' WHEN 3 THEN 'variable' ELSE 'package' END"
EXT = "CASE p_partkey % 7 WHEN 2 THEN 'py' WHEN 3 THEN 'java' WHEN 4 THEN 'ts' WHEN 5 THEN 'js' WHEN 6 THEN 'md' ELSE 'go' END"
LANGUAGE = "CASE p_partkey % 7 WHEN 2 THEN 'python' WHEN 3 THEN 'java' WHEN 4 THEN 'typescript' WHEN 5 THEN 'javascript' WHEN 6 THEN 'markdown' ELSE 'go' END"
TYPE = "concat(CASE p_partkey % 4 WHEN 0 THEN 'UserController' WHEN 1 THEN 'UserService' WHEN 2 THEN 'UserRepository' ELSE 'User' END, CAST(CAST(floor(p_partkey / 4) AS BIGINT) % 9 AS VARCHAR(9)))"
WORD = "concat(upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2), '_', CAST(p_partkey % 997 AS VARCHAR(9)))"

DERIVED = {
    "ast_nodes": f"""
SELECT CAST(p_partkey + 1 AS BIGINT) AS id,
  CASE WHEN p_partkey % 5 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(p_partkey - p_partkey % 5 + 1 AS BIGINT) END AS parent_id,
  concat('/work/pkg', CAST(p_partkey % 12 AS VARCHAR(9)), '/', lower(p_type), '_', CAST(p_partkey % 37 AS VARCHAR(9)), '.', {EXT}) AS file_path,
  concat('pkg', CAST(p_partkey % 12 AS VARCHAR(9))) AS package_name,
  CASE WHEN p_size % 5 = 4 THEN '' ELSE {TYPE} END AS type_name,
  CASE WHEN p_size % 5 = 1 THEN {WORD} ELSE '' END AS method_name,
  CASE WHEN p_size % 5 IN (2, 3) THEN lower({WORD}) ELSE '' END AS field_name,
  {NODE} AS node_type,
  CASE WHEN p_partkey % 6 = 5 THEN '' ELSE {LANGUAGE} END AS language,
  CAST(1 + (p_partkey * 7) % 400 AS INT) AS start_line,
  CAST(CASE WHEN p_size % 5 = 2 THEN 0 ELSE 1 + (p_partkey * 7) % 400 + p_size END AS INT) AS end_line,
  CAST(p_size % 27 AS INT) AS cyclomatic_complexity, CAST(p_size % 6 AS INT) AS parameter_count,
  CAST(p_size % 3 AS INT) AS return_count, CAST(p_size + 1 AS INT) AS line_count,
  CAST(1704067200 + p_partkey * 60 AS BIGINT) AS last_modified, p_partkey % 8 = 0 AS is_private
FROM {{part}}""",
    "ast_relationships": """
SELECT CAST(l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS BIGINT) AS id,
  CAST(l_partkey + 1 AS BIGINT) AS from_ast_id,
  CASE WHEN l_linenumber = 7 THEN CAST(NULL AS BIGINT) WHEN l_linenumber = 6 AND l_suppkey % 10 = 0 THEN CAST(1000000000000 + l_partkey AS BIGINT)
    ELSE CAST((l_partkey * 31 + l_suppkey) % (SELECT count(*) FROM {part}) + 1 AS BIGINT) END AS to_ast_id,
  CAST(l_linenumber AS INT) AS line_no,
  CASE l_returnflag WHEN 'A' THEN 'call' WHEN 'N' THEN 'import' ELSE 'reference' END AS relationship_type,
  concat('call ', CAST(l_suppkey AS VARCHAR(19))) AS text
FROM {lineitem}""",
    "library_nodes": """
SELECT CAST(s_suppkey + 1 AS BIGINT) AS id,
  CASE s_suppkey % 10 WHEN 0 THEN 'fmt' WHEN 1 THEN 'net/http' WHEN 2 THEN 'gorm.io/gorm' WHEN 3 THEN 'github.com/gin-gonic/gin' WHEN 4 THEN 'os' WHEN 5 THEN 'strings'
    WHEN 6 THEN 'encoding/json' WHEN 7 THEN 'database/sql' WHEN 8 THEN 'github.com/acme/tools' ELSE 'golang.org/x/sync' END AS package,
  CASE WHEN s_suppkey % 3 = 0 THEN 'Client' ELSE '' END AS class, concat('Do', CAST(s_suppkey % 7 AS VARCHAR(9))) AS method, '' AS field,
  'method' AS node_type, 'go' AS language, CASE WHEN s_suppkey % 10 IN (2, 3, 8) THEN 'third-party' ELSE 'stdlib' END AS framework
FROM {supplier}""",
    "library_relationships": """
SELECT CAST(l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS BIGINT) AS id,
  CAST(l_partkey + 1 AS BIGINT) AS ast_id, CASE WHEN l_linenumber = 7 THEN CAST(1000000000000 AS BIGINT) ELSE CAST(l_suppkey + 1 AS BIGINT) END AS library_id,
  CAST(l_linenumber AS INT) AS line_no, 'call' AS relationship_type,
  concat('Do (pkg=lib', CAST(l_suppkey % 10 AS VARCHAR(9)), ';class=;method=Do', CAST(l_suppkey % 7 AS VARCHAR(9)), ';framework=', CASE WHEN l_suppkey % 2 = 0 THEN 'stdlib' ELSE 'third-party' END, ')') AS text
FROM {lineitem} WHERE l_linestatus = 'F'""",
    "linter_executions": """
SELECT event_type AS linter_name, concat('/w', CAST(user_id % 3 AS VARCHAR(9))) AS work_dir, ts AS executed_at,
  CAST(floor(value * 10) AS BIGINT) AS duration_ms, CAST(event_id % 3 AS INT) AS violation_count, event_type <> 'error' AS success
FROM {events}""",
    "violations": """
SELECT CAST(e.event_id + 1 AS BIGINT) AS id, concat('/work/pkg', CAST(e.user_id % 12 AS VARCHAR(9)), '/d', CAST(e.user_id % 5 AS VARCHAR(9)), '/f', CAST(e.user_id % 41 AS VARCHAR(9)), '.go') AS file_path,
  CAST(e.event_id % 300 AS INT) AS line, CAST(e.event_id % 80 AS INT) AS col,
  CAST(e.event_id % (SELECT count(*) FROM {part}) + 1 AS BIGINT) AS caller_id,
  CASE WHEN e.event_id % 4 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(e.user_id + 1 AS BIGINT) END AS called_id,
  CASE WHEN e.event_id % 11 = 0 THEN '' ELSE e.event_type END AS source, concat('rule', CAST(e.event_id % 9 AS VARCHAR(9))) AS rule,
  concat('message ', CAST(e.event_id % 17 AS VARCHAR(9))) AS message, e.event_id % 5 = 0 AS fixable,
  CASE WHEN e.event_id % 10 = 0 THEN 'unsafe' WHEN e.event_id % 5 = 0 THEN 'safe' ELSE '' END AS fix_applicability, e.ts AS stored_at
FROM {events} e""",
    "dependencies": """
SELECT DISTINCT p_name AS name, CASE l_returnflag WHEN 'A' THEN 'go' WHEN 'N' THEN 'npm' ELSE 'pip' END AS type, concat('v', CAST(l_linenumber AS VARCHAR(9))) AS version,
  CASE WHEN p_partkey % 3 = 0 THEN concat('https://github.com/acme/', split_part(p_name, ' ', 2)) ELSE '' END AS git,
  CAST(l_linenumber % 4 AS INT) AS depth, l_linenumber > 3 AS indirect
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "comments": """
SELECT doc_id AS id, concat('/doc/', source, '/', CAST(doc_id AS VARCHAR(19)), '.go') AS file_path, text,
  CASE doc_id % 3 WHEN 0 THEN 'single_line' WHEN 1 THEN 'multi_line' ELSE 'documentation' END AS type, CAST(doc_id % 90 AS INT) AS start_line
FROM {documents}""",
    "file_metadata": """
SELECT concat('/doc/', CAST(doc_id AS VARCHAR(19))) AS file_path, CASE WHEN doc_id % 5 = 0 THEN 'stale' ELSE sha256(text) END AS file_hash,
  CAST(n_chars AS BIGINT) AS file_size, CAST(1704067200 + doc_id AS BIGINT) AS last_modified
FROM {documents} WHERE doc_id % 4 <> 3""",
    "files": """
SELECT concat('/doc/', CAST(doc_id AS VARCHAR(19))) AS file_path, sha256(text) AS file_hash, CAST(1704067200 + doc_id + CASE WHEN doc_id % 6 = 0 THEN 5 ELSE 0 END AS BIGINT) AS mod_time
FROM {documents}""",
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


class Tables:
    """The tables of one data folder by name, derived ones included."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            found = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name in DERIVED:
            sql = DERIVED[name].replace("sha256(text)", "sha2(text, 256)")
            found = self.spark.sql(sql, **{n: getattr(self, n) for n in sorted(set(re.findall(r"\{(\w+)\}", sql)))})
        else:
            raise AttributeError(name)
        setattr(self, name, found)
        return found

    @cached_property
    def nodes(self) -> DataFrame:
        return self.ast_nodes


def oracle(sql: str) -> str:
    """The SQL with the derived tables that it names as common table expressions."""
    needed = [n for n in DERIVED if re.search(rf"\b{n}\b", sql)]
    ctes = [f"{n} AS ({re.sub(r'[{}]', '', DERIVED[n])})" for n in needed]
    body = sql.strip()
    if not ctes:
        return body
    return f"WITH {', '.join(ctes)}, " + body[5:] if body.upper().startswith("WITH ") and not body.upper().startswith("WITH RECURSIVE") else (f"WITH RECURSIVE {', '.join(ctes)}, " + body[15:] if body.upper().startswith("WITH RECURSIVE") else f"WITH {', '.join(ctes)} " + body)
